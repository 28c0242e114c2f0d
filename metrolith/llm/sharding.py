"""Operator 2: shards by extendible hashing, in DataFrame functions only.

A row's hash is 60 bits: 30 of its key, then 30 of the rest of the row and its position. The directory is indexed by
the leading bits; a bucket over the byte limit splits on its next bit, and only such buckets do. Sizes of all prefixes
come from one aggregation by the longest prefix of the round, rolled up over its levels; only prefixes still too large
at that length enter another round with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

BITS = 60
ROUND = 8  # more bits each round


def _prefix(h: str | Column, bits: int) -> Column:
    return F.shiftright(F.col(h) if isinstance(h, str) else h, BITS - bits)


def shards(docs: DataFrame, limit: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, depth, shard_bytes, shard_docs, n_bytes): one row a row of docs.

    shard is the bucket's bits, empty where everything fits one bucket. n_bytes is the UTF-8 length of the text, zero
    for null. Equal keys share their first 30 bits and then part by row, so a key held by a third of all rows splits
    too. Only a bucket of a single row may stay over the limit. A null key hashes like the text "null". An empty table
    gives no row; columns of other names are ignored.
    """
    return _sharded(docs, limit, key, text_col, F.octet_length(F.col(text_col).cast("string")), None)


def write_shards(docs: DataFrame, folder: str, limit: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes whole rows below folder, a folder a shard, and the directory beside them; returns the directory: (shard,
    depth, shard_bytes, shard_docs). Here a row's bytes are those of all its columns as text, so the limit holds for what
    is written before it is compressed."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in docs.columns), F.lit(0))
    whole, part = fresh("_row", docs.columns), fresh("shard", docs.columns)
    got = cut(_sharded(docs, limit, key, text_col, size, whole))
    got.select(F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias(part), f"{whole}.*").repartition(part).write.partitionBy(part).parquet(f"{folder}/rows")
    directory = got.groupBy("shard").agg(F.first("depth").alias("depth"), F.first("shard_bytes").alias("shard_bytes"), F.first("shard_docs").alias("shard_docs"))
    directory.write.parquet(f"{folder}/directory")
    return docs.sparkSession.read.parquet(f"{folder}/directory")


def _sharded(docs: DataFrame, limit: int, key: str, text_col: str, size: Column, whole: str | None) -> DataFrame:
    number = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    rest = F.pmod(F.xxhash64(F.col(text_col).cast("string"), F.monotonically_increasing_id()), F.lit(1 << 30))
    rows = docs.select(F.col(key).alias("doc_id"), (F.shiftleft(F.shiftright(number, 30), 30) + rest).alias("h"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), *([F.struct(*docs.columns).alias(whole)] if whole else []))
    rows = cut(rows)
    kept = [whole] if whole else []
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    bits = min(20, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    sized, known = None, 0
    todo = rows
    while True:
        base = todo.groupBy(_prefix("h", bits).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = base.select(F.explode(F.sequence(F.lit(known), F.lit(bits))).alias("depth"), "p", "b", "n")
        nodes = levels.groupBy("depth", F.expr(f"shiftright(p, {bits} - depth)").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        nodes = cut(nodes)
        fits = (F.col("b") <= limit) | (F.col("n") == 1) | (F.col("depth") == BITS)
        parents = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"))
        # a leaf fits and its parent doesn't; the root of the round has no parent here
        leaves = nodes.where(fits & (F.col("depth") > known)).withColumn("up", F.shiftright("p", 1)).join(parents, ["depth", "up"], "left_semi").drop("up")
        if known == 0:
            leaves = leaves.unionByName(nodes.where(fits & (F.col("depth") == 0)))
        found = leaves.select("depth", "p", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"))
        sized = found if sized is None else sized.unionByName(found)
        large = nodes.where(~fits & (F.col("depth") == bits)).select(F.col("p").alias("large"))
        if bits == BITS or large.isEmpty():
            break
        todo = todo.join(large, _prefix("h", bits) == F.col("large"), "left_semi")
        known, bits = bits, min(BITS, bits + ROUND)
    sized = cut(sized)
    depths = [r["depth"] for r in sized.select("depth").distinct().collect()]  # 61 numbers at most
    if not depths:
        return rows.select("doc_id", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"), "n_bytes", *kept)
    # the directory: entries of one length, each naming the bucket it belongs to; longer buckets have own entries
    deepest = max(depths)
    near = min(deepest, max(min(depths), bits if known == 0 else 20))
    short = sized.where(F.col("depth") <= near).withColumn("entry", F.explode(F.expr(f"sequence(shiftleft(p, {near} - depth), shiftleft(p + 1, {near} - depth) - 1)")))
    got = rows.withColumn("entry", _prefix("h", near)).join(short, "entry", "left").drop("entry")
    if deepest > near:
        long = sized.where(F.col("depth") > near)
        rest_rows = got.where("depth is null").select("doc_id", "h", "n_bytes", *kept)
        tries = rest_rows.withColumn("try", F.explode(F.array(*[F.lit(d) for d in sorted(depths) if d > near])))
        deep = tries.join(long, (F.col("try") == F.col("depth")) & (F.expr(f"shiftright(h, {BITS} - try)") == F.col("p"))).drop("try")
        got = got.where("depth is not null").unionByName(deep)
    bits_text = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(cast(p as string), 10, 2), depth, '0')"))
    return got.select("doc_id", bits_text.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", "n_bytes", *kept)


def oracle(limit: int, table: str = "documents", deepest: int = 24) -> str:
    """The same in DuckDB's SQL for unique keys whose buckets need no more than `deepest` bits."""
    return f"""
with r as (select doc_id, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 15))::ubigint >> 30 as h, cast(coalesce(strlen(text), 0) as bigint) as n_bytes from {table}),
n as (select d as depth, h >> (30 - d) as p, cast(sum(n_bytes) as bigint) as b, count(*) as n from r, range(0, {deepest + 1}) g(d) group by 1, 2),
leaf as (select c.* from n c left join n u on u.depth = c.depth - 1 and u.p = c.p >> 1
         where (c.b <= {limit} or c.n = 1) and (c.depth = 0 or (u.b > {limit} and u.n > 1)))
select doc_id, case when depth = 0 then '' else lpad(bin(p), depth::int, '0') end as shard, depth::int as depth, b as shard_bytes, n as shard_docs, n_bytes
from r join leaf on h >> (30 - depth) = p"""
