"""The same measurement over a stream of files: the kernels hold no state, so nothing needs a watermark."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.measure import measure


def stream_folder(spark: SparkSession, folder: str, engines: list[str] | None = None) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.py").load(folder)
    return measure(files.select(F.col("path").alias("fragment_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("code")), engines).metrics()
