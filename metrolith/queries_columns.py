"""Every column of every engine of our own on programs that grow with k = p_size % 4, against closed forms in SQL.

The program has a class of two methods, k + 1 functions that differ in their names only, and two statements; the forms
are counted by hand: a function more brings 7 lines (2 of them blank), 5 statements, 25 tokens, 32 nodes, 4 operators
and 8 operands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.measure import measure
from .plans import specs as S

_HEAD = '''import os
import hashlib


class Shape(Base):
    """A shape."""

    def area(self, a, b):
        # sides
        if a > 0 and b > 0:
            return a * b
        return 0

    def name(self):
        return self.label


'''
_FUNCTION = """def f{}(x, y):
    total = x + y
    while total < 10:
        total += x * y
    return total


"""
_TAIL = '''assert f0(1, 2) == 3
hashlib.md5(b"x")
'''

_N = "(3 + k)"  # functions and methods


def _mean(first: float, each: float, digits: int = 4) -> str:
    """Mean over the two methods, which add up to first, and k + 1 functions of `each`."""
    return f"round(({first}::double + {each}::double * (1 + k)) / {_N}, {digits})"


def _sum(first: str, each: str) -> str:
    return f"round({first} + ({each}) * (1 + k), 6)"


_V = "((27 + 12 * k) * log2(18 + k))"
_D = "(6 / 2.0::double * (18 + 8 * k) / (12 + k))"
_AREA, _NAME, _EACH = "25 * log2(15)", "10 * log2(9)", "25 * log2(17)"
_INDEX = f"((171 - 5.2::double * ln({_V}) - 0.23::double * (11 + 2 * k) / (4 + k) - 16.2::double * ln(17 + 5 * k) + 50 * sin(sqrt(2.4::double * radians(100.0::double / (26 + 7 * k))))) * 100 / 171)"

FORMS: dict[str, dict[str, str]] = {
    "five_op": {
        "lloc": "17 + 5 * k", "sloc": "16 + 5 * k", "comments": "1", "single_comments": "2", "multi_line_comments": "0", "blank_lines": "8 + 2 * k", "total_lines": "26 + 7 * k",
        "cyclomatic_complexity_mean": "round((11 + 2 * k)::double / (4 + k), 4)", "cyclomatic_complexity_max": "5", "cyclomatic_complexity_module": "2", "cc_imputed_module_level": "false",
        "halstead_h1": "6", "halstead_h2": "12 + k", "halstead_n1": "9 + 4 * k", "halstead_n2": "18 + 8 * k", "halstead_vocabulary": "18 + k", "halstead_calculated_length": "round(6 * log2(6) + (12 + k) * log2(12 + k), 6)", "halstead_length": "27 + 12 * k",
        "halstead_volume": f"round({_V}, 6)", "halstead_difficulty": f"round({_D}, 6)", "halstead_effort": f"round({_D} * {_V}, 6)", "halstead_time": f"round({_D} * {_V} / 18, 6)", "halstead_bugs": f"round({_V} / 3000, 6)", "halstead_volume_is_zero": "false",
        "maintainability_index": f"round({_INDEX}, 6)", "maintainability_index_saturated": "false", "maintainability_saturation_path": "0",
    },
    "token": {
        "function_count": _N, "avg_token_count_mean": _mean(35, 25), "avg_token_count_max": "25", "avg_token_count_min": "10", "avg_param_count_mean": _mean(4, 2), "avg_param_count_max": "3", "avg_param_count_min": "1",
        "function_length_mean": _mean(6, 5), "function_length_max": "5", "function_length_min": "2", "cyclomatic_complexity_mean": _mean(4, 2), "cyclomatic_complexity_max": "3", "cyclomatic_complexity_min": "1", "max_nesting_depth": "1", "nloc": "17 + 5 * k", "token_count": "86 + 25 * k",
        "halstead_volume": _sum(f"{_AREA} + {_NAME}", _EACH), "halstead_difficulty": _mean(15, 14.4, 6), "halstead_effort": _sum(f"11 * {_AREA} + 4 * {_NAME}", f"14.4::double * {_EACH}"), "halstead_length": "35 + 25 * (1 + k)", "halstead_vocabulary": _mean(24, 17, 6),
        "halstead_h1": "16 + 12 * (1 + k)", "halstead_h2": "8 + 5 * (1 + k)", "halstead_n1": "20 + 13 * (1 + k)", "halstead_n2": "15 + 12 * (1 + k)", "halstead_time": _sum(f"(11 * {_AREA} + 4 * {_NAME}) / 18", f"14.4::double * {_EACH} / 18"), "halstead_bugs": _sum(f"({_AREA} + {_NAME}) / 3000", f"{_EACH} / 3000"),
        "top_nesting_level_max": "1", "function_token_length_max": "25",
    },
    "ast": {
        "ast_depth": "7", "total_nodes": "93 + 32 * k", "functiondef_count": _N, "classdef_count": "1", "return_count": "4 + k", "call_count": "2", "assign_count": "2 * (1 + k)", "comprehension_count": "0", "try_count": "0", "decorator_count": "0",
        "loop_ratio": "round((1 + k)::double / (93 + 32 * k), 6)", "if_ratio": "round(1.0::double / (93 + 32 * k), 6)", "import_ratio": "round(2.0::double / (93 + 32 * k), 6)",
        "class_count": "1", "dit_max": "1", "dit_mean": "1.0", "noc_max": "0", "rfc_max": "2", "rfc_mean": "2.0", "methods_per_class_mean": "2.0", "base_classes_external": "1", "operational_node_count": "17 + 7 * k",
    },
    "lexical": {
        "distinct_tokens": "42 + k", "lexical_tokens": "86 + 25 * k", "type_token_ratio": "round((42 + k)::double / (86 + 25 * k), 6)", "distinct_identifiers": "15 + k", "distinct_variables": "6", "distinct_functions_defined": _N, "distinct_calls": "2", "distinct_attributes": "2", "distinct_imports": "2",
    },
    "cognitive": {"cognitive_complexity": _N, "cognitive_complexity_mean": _mean(2, 1), "cognitive_complexity_max": "2", "cognitive_complexity_min": "0"},
    "structure": {
        "cbo_mean": "1.0", "cbo_max": "1", "lcom_mean": "2.0", "lcom_max": "2", "class_count": "1", "cognitive_complexity_mean": _mean(2, 1), "cyclomatic_complexity_mean": _mean(3, 2), "cyclomatic_complexity_max": "2", "nesting_depth_mean": _mean(1, 1), "nesting_depth_max": "1",
        "dead_code_findings": "0", "dead_code_ratio": "0.0", "clone_count": "case when k = 0 then 0 else 1 + k end", "clone_pairs": "k * (k + 1) // 2", "clone_groups": "case when k = 0 then 0 else 1 end", "clone_similarity_mean": "case when k > 0 then 1.0 end", "clone_fragments_analysed": "2 + k",
        "function_count": _N, "sloc": "16 + 5 * k", "lloc": "17 + 5 * k", "comment_lines": "1", "docstring_lines": "1",
    },
    "unused": {"dead_code_items": "4 + k", "dead_code_high_confidence": "0", "dead_code_min_confidence": "60"},
    "security": {
        "security_issues": "2", "security_severity_low": "1", "security_severity_medium": "0", "security_severity_high": "1", "security_confidence_low": "0", "security_confidence_medium": "0", "security_confidence_high": "2",
    },
}

_P = "with p as (select cast(p_partkey as varchar) as fragment_id, p_size % 4 as k from part) "
_TYPE = {"i": "bigint", "f": "double", "b": "boolean"}
_KINDS = {s.column: s.kind for s in S.SPECS}


def _sql(key: str, engine: str) -> str:
    return f"({FORMS[engine][key]})::{_TYPE[_KINDS[S.column_name(key, engine)]]}"


def programs(spark: SparkSession, d: str) -> DataFrame:
    """(fragment_id, code), dealt to all cores: the table is one small file, measuring is the work."""
    k = "cast(p_size % 4 as int)"
    part = spark.read.parquet(f"{d}/part.parquet").repartition(spark.sparkContext.defaultParallelism)
    many = F.expr(f"transform(sequence(0, {k}), i -> replace('{_FUNCTION}', '{{}}', cast(i as string)))".replace("\n", "\\n"))
    return part.select(F.col("p_partkey").cast("string").alias("fragment_id"), F.concat(F.lit(_HEAD), F.array_join(many, ""), F.lit(_TAIL)).alias("code"))


def _columns(engine: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = measure(programs(spark, d), [engine]).metrics()
        own = [F.round(c, 6).alias(c) if c == "maintainability_index__five_op" else F.col(c) for c in (S.column_name(k, engine) for k in FORMS[engine])]
        return m.select("fragment_id", *own)

    return run


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ratio and flag of every key that more than one engine reads."""
    m = measure(programs(spark, d)).metrics()
    return m.select("fragment_id", *[F.col(c(k)) for k in S.comparable_keys() for c in (S.delta_column, S.divergent_column)])


def _pairs_sql() -> str:
    out = []
    for key, engines in S.comparable_keys().items():
        values = ", ".join(f"{_sql(key, e)}::double" for e in engines)
        ratio = f"round(greatest({values}) / least({values}), 6)"
        out.append(f"{ratio} as {S.delta_column(key)}, {ratio} - 1.0 > 0.1 as {S.divergent_column(key)}")
    return _P + "select fragment_id, " + ", ".join(out) + " from p"


QUERIES = {f"q_columns_{e}": _columns(e) for e in FORMS} | {"q_divergence_pairs": _pairs}
ORACLE_SQL = {f"q_columns_{e}": _P + "select fragment_id, " + ", ".join(f"{_sql(k, e)} as {S.column_name(k, e)}" for k in own) + " from p" for e, own in FORMS.items()} | {"q_divergence_pairs": _pairs_sql()}
