"""Native Column expressions over raw texts: lines, words, fenced code blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```([A-Za-z0-9_+-]*)\n(.*?)```"
WHITE = " \t\n\r"


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1)


def total_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(lines(text)))


def blank_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.filter(lines(text), lambda x: F.btrim(x, F.lit(WHITE)) == "")))


def source_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: (F.btrim(x, F.lit(WHITE)) != "") & ~F.startswith(F.btrim(x, F.lit(WHITE)), F.lit("#"))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0))


def code_blocks(raw: Column) -> Column:
    """array<struct<language, code>>: fenced blocks, trimmed, empty ones left out; an unfenced text is one block."""
    found = F.arrays_zip(F.regexp_extract_all(raw, F.lit(FENCE), F.lit(1)).alias("language"), F.regexp_extract_all(raw, F.lit(FENCE), F.lit(2)).alias("code"))
    tidy = F.transform(found, lambda x: F.struct(F.when(x["language"] == "", "python").otherwise(F.lower(x["language"])).alias("language"), F.btrim(x["code"], F.lit(WHITE)).alias("code")))
    whole = F.array(F.struct(F.lit("python").alias("language"), F.btrim(raw, F.lit(WHITE)).alias("code")))
    blocks = F.when(F.size(found) > 0, tidy).otherwise(whole)
    return F.filter(blocks, lambda x: x["code"] != "")


def python_blocks(raw: Column) -> Column:
    return F.filter(code_blocks(raw), lambda x: x["language"].isin("python", "python3", "py", ""))
