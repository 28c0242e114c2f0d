"""Relational operators over metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import severity
from ..plans.specs import column_name, delta_column, divergent_column


def _stacked(one: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """From one wide row `<field>__of__<name>` to a row a name; nothing is scanned again."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), *[F.col(f"{f}__of__{n}").alias(f) for f in fields]) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def null_rates(table: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, null_rate), the highest first and ties by name; one pass."""
    one = table.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"null_rate__of__{c}") for c in columns])
    return _stacked(one, columns, ["null_rate"]).orderBy(F.desc("null_rate"), "metric")


def divergence_summary(table: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, compared, divergent, divergent_rate, ratio_median, ratio_max); metrics never compared are left out, and
    without any metric there is no row."""
    if not metrics:
        none = table.sparkSession.createDataFrame([], "metric string, compared long, divergent long, divergent_rate double, ratio_median double, ratio_max double")
        return none
    aggs = []
    for m in metrics:
        ratio, flag = F.col(delta_column(m)), F.col(divergent_column(m))
        aggs += [
            F.count(flag).alias(f"compared__of__{m}"), F.coalesce(F.count_if(flag), F.lit(0)).alias(f"divergent__of__{m}"), F.round(F.avg(flag.cast("int")), 4).alias(f"divergent_rate__of__{m}"), F.round(F.max(ratio), 4).alias(f"ratio_max__of__{m}"),
        ]
    counts = _stacked(table.agg(*aggs), metrics, ["compared", "divergent", "divergent_rate", "ratio_max"]).where("compared > 0 or ratio_max is not null")
    joined = counts.join(medians(table, {m: delta_column(m) for m in metrics}), "metric", "left")
    return joined.select("metric", "compared", "divergent", "divergent_rate", F.round("median", 4).alias("ratio_median"), "ratio_max").orderBy(F.desc("divergent_rate"), "metric")


def medians(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(metric, median) of columns, exactly: equal values are counted first, and the counts of a metric run up to its
    middle in a sort that may spill, so no task holds all values. Nulls don't count; a column of nulls gives no row."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in columns.items()])).alias("x")
    values = table.select(each).select("x.*").where("v is not null").groupBy("metric", "v").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("metric").orderBy("v"))
    placed = values.withColumn("upto", below).join(values.groupBy("metric").agg(F.sum("n").alias("total")), "metric")
    middle = [F.min(F.when(F.col("upto") >= F.expr(f"(total + {k}) div 2"), F.col("v"))) for k in (1, 2)]
    return placed.groupBy("metric").agg(((middle[0] + middle[1]) / 2).alias("median"))


def worst_metric(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("divergent_rate"), "metric").limit(1)


def metric_major(table: DataFrame, comparable: dict[str, list[str]], only_divergent: bool = False, key: str = "fragment_id") -> DataFrame:
    """(fragment_id, metric, readings map, ratio, divergent, severity) for metrics with two readings at least."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.map_filter(F.create_map(*[x for e in engines for x in (F.lit(e), F.col(column_name(m, e)).cast("double"))]), lambda _, v: v.isNotNull()).alias("readings"), F.col(delta_column(m)).alias("ratio"), F.col(divergent_column(m)).alias("divergent"))
        for m, engines in comparable.items()
    ])
    out = table.select(key, F.explode(rows).alias("r")).select(key, "r.*").where(F.size("readings") >= 2)
    if only_divergent:
        out = out.where("divergent")
    return out.withColumn("severity", severity(F.col("ratio"), F.col("divergent")))


def trend(history: DataFrame, column: str, how: str = "mean", compat: bool = False) -> DataFrame:
    """(revision_index, sha, timestamp, value) in order. The sum of nothing is null; 0 under compat."""
    keys = ["revision_index", "sha", "timestamp"]
    if column not in history.columns:
        return history.select(*keys, F.lit(None).cast("double").alias("value")).limit(0)
    how = {"avg": "mean"}.get(how, how)
    if how not in ("sum", "mean", "max", "min", "median", "count"):
        raise ValueError(f"no such aggregate: {how}")
    value = getattr(F, how)(F.col(column))
    if how == "sum" and compat:
        value = F.coalesce(value, F.lit(0))
    return history.groupBy(*keys).agg(value.alias("value")).orderBy("revision_index")


def sample_revisions(rows: DataFrame, sha: str, newest_first: str, path: str, every: int = 1, files: int = 50) -> DataFrame:
    """Each `every`-th revision from the newest, its first `files` paths by name; revision_index counts from the oldest.

    Revisions are ranked on their distinct list, so the rank never sorts the files.
    """
    revisions = rows.select(sha, newest_first).distinct()
    ranked = revisions.withColumn("_position", F.row_number().over(Window.orderBy(F.desc(newest_first), sha)) - 1).where(F.col("_position") % every == 0)
    ranked = ranked.withColumn("revision_index", F.row_number().over(Window.orderBy(newest_first, F.desc(sha))) - 1).select(sha, "revision_index")
    nth = F.row_number().over(Window.partitionBy(sha).orderBy(path))
    return rows.join(ranked, sha).withColumn("_nth", nth).where(F.col("_nth") <= files).drop("_nth")


def wide_embedding(vectors: DataFrame, key: str, column: str, dims: int, model: str) -> DataFrame:
    """(key, model, dim_0 ...): padded with zero or cut to dims."""
    return vectors.select(key, F.lit(model).alias("model"), *[F.coalesce(F.try_element_at(F.col(column), F.lit(i + 1)).cast("double"), F.lit(0.0)).alias(f"dim_{i}") for i in range(dims)])


def masked_mean(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, dim, value): mean of the vectors of each key, place by place; null places are left out."""
    return vectors.select(key, F.posexplode(column).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("value"))
