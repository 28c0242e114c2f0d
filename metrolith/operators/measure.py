"""Fragments to metrics: one Arrow UDF for all chosen engines, everything that is algebra in native columns.

A fragment is a row (fragment_id, code). It is parsed and tokenised once, and all chosen engines read that; what no
engine needs isn't computed. A fragment that doesn't parse keeps its row, with nulls; an engine that fails on one leaves
nulls and a row in `degradations`; nothing raises. Engines that are external programs run where the fragments are.
"""

from __future__ import annotations

import json
import platform
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.columns import divergence, halstead, is_true, maintainability
from ..kernels import code as K
from ..kernels import programs as P
from ..plans import specs as S

L, D, B, T = LongType(), DoubleType(), BooleanType(), StringType()


def _struct(**types) -> StructType:  # noqa: ANN003
    return StructType([StructField(k, t) for k, t in types.items()])


def _longs(names: str) -> dict:
    return {n: L for n in names.split()}


_KERNELS: dict[str, tuple[Callable[[str], dict], StructType]] = {
    "five_op": (K.five_op, _struct(**_longs("lloc sloc comments single_comments multi_line_comments blank_lines total_lines cc_sum cc_n cyclomatic_complexity_max cyclomatic_complexity_module"), cc_imputed_module_level=B, **_longs("halstead_h1 halstead_h2 halstead_n1 halstead_n2"))),
    "token": (K.token, _struct(nloc=L, token_count=L)),
    "ast": (K.tree, _struct(**_longs("ast_depth total_nodes functiondef_count classdef_count return_count call_count assign_count comprehension_count try_count decorator_count loops ifs imports class_count noc_max base_classes_external operational_node_count"), dit=ArrayType(L), rfc=ArrayType(L), methods=ArrayType(L))),
    "lexical": (K.lexical, _struct(**_longs("distinct_tokens lexical_tokens distinct_identifiers distinct_variables distinct_functions_defined distinct_calls distinct_attributes distinct_imports"))),
    "cognitive": (K.whole_cognitive, _struct(cognitive_complexity=L, points=ArrayType(L))),
    "structure": (K.structure, _struct(**_longs("class_count dead_code_findings blocks clone_count clone_pairs clone_groups clone_fragments_analysed function_count sloc lloc comment_lines docstring_lines"), cbo=ArrayType(L), lcom=ArrayType(L), similarity=D)),
    "unused": (K.unused, _struct(found=ArrayType(L))),
    "security": (K.security, _struct(severity=ArrayType(T), confidence=ArrayType(T))),
}
_FUNCTION = _struct(name=T, **_longs("start_line end_line nloc token_count param_count cyclomatic_complexity max_nesting_depth h1 h2 n1 n2 length top cognitive_complexity plain_complexity"))
_USER: dict[str, tuple[list[S.MetricSpec], Callable[[str], dict]]] = {}


def register_engine(name: str, specs: list[tuple[str, str]], kernel: Callable[[str], dict]) -> None:
    """Adds an engine of the user's: specs are (key, kind), kernel gives {key: value} for a valid text."""
    _USER[name] = ([S.MetricSpec(name, k, kind, "file", "count", "invalid_input") for k, kind in specs], kernel)


def _one(kernels: dict[str, tuple[Callable[[str], dict], list[str] | None]], code: object) -> dict:
    """{validity, engine: {values, failure}} of one text; what isn't declared is dropped, what fails is told."""
    out: dict = {"valid": False, **{e: {"values": None, "failure": None} for e in kernels}}
    try:
        s = K.source(code) if isinstance(code, str) else None
    except Exception as e:  # noqa: BLE001
        return out | {k: {"values": None, "failure": f"{type(e).__name__}: {e}"[:300]} for k in kernels}
    if s is None or s.tree is None:
        return out if s is None or not s.failure else out | {k: {"values": None, "failure": s.failure} for k in kernels}
    out["valid"] = True
    for engine, (kernel, names) in kernels.items():
        try:
            got = kernel(code)
            out[engine] = {"values": {k: got.get(k) for k in names} if names else got, "failure": None}
        except Exception as e:  # noqa: BLE001 - a failure is a row, not the end of the batch
            out[engine] = {"values": None, "failure": f"{type(e).__name__}: {e}"[:300]}
    return out


def fused(kernels: dict[str, tuple[Callable, object]]):  # noqa: ANN201
    """An Arrow UDF (code) -> struct<valid, engine: struct<values, failure>...>: one parse a text for all kernels. Equal
    texts of a batch are measured once: kernels are functions of the text alone. Marked as not deterministic, else the
    optimizer copies it into filters (of an explode, say) and they run a second time, below a repartition even."""
    full = StructType([StructField("valid", B), *[StructField(e, _struct(values=t, failure=T)) for e, (_, t) in kernels.items()]])
    run_of = {e: (k, [f.name for f in t] if isinstance(t, StructType) else None) for e, (k, t) in kernels.items()}
    arrow = to_arrow_type(full)

    @F.arrow_udf(full)
    def run(codes: pa.Array) -> pa.Array:
        texts = codes.dictionary_encode(null_encoding="encode")
        return pa.array([_one(run_of, c) for c in texts.dictionary.to_pylist()], arrow).take(texts.indices)

    return run.asNondeterministic()


def _series(c: str, prefix: str, spec: str = "mean max min") -> dict[str, Column]:
    """c: SQL of an array. Written as SQL, since a plan of many lambdas is slow to build from Python."""
    out = {}
    if "mean" in spec:
        out[f"{prefix}_mean"] = F.expr(f"round({_mean(c)}, 4)")
    if "max" in spec:
        out[f"{prefix}_max"] = F.expr(f"array_max({c})")
    if "min" in spec:
        out[f"{prefix}_min"] = F.expr(f"array_min({c})")
    return out


def _sum(c: str) -> str:
    return f"if(size({c}) > 0, aggregate({c}, 0D, (a, x) -> a + x), null)"


def _mean(c: str) -> str:
    return f"{_sum(c)} / nullif(size({c}), 0)"


#: Halstead's quantities of one function f, as in `functions.columns.halstead`.
_VOLUME = "(f.n1 + f.n2) * if(f.h1 + f.h2 > 0, log2(f.h1 + f.h2), 0D)"
_DIFFICULTY = "if(f.h2 = 0, 0D, f.h1 / 2D * f.n2 / nullif(f.h2, 0))"
_OF_FUNCTION = {"volume": _VOLUME, "difficulty": _DIFFICULTY, "effort": f"{_DIFFICULTY} * {_VOLUME}", "time": f"{_DIFFICULTY} * {_VOLUME} / 18D", "bugs": f"{_VOLUME} / 3000D", "vocabulary": "cast(f.h1 + f.h2 as double)", "length": "cast(f.n1 + f.n2 as double)"}


def _values(engine: str) -> dict[str, Column]:
    """The engine's metrics from its kernel's struct (column _<engine>) and the functions (column _functions)."""
    v = lambda k: F.col(f"_{engine}.values.{k}")
    name = lambda k: f"_{engine}.values.{k}"
    each = lambda k: f"_functions.values.{k}"
    of = lambda k: f"transform(_functions.values, f -> {_OF_FUNCTION[k]})"
    most = lambda k: F.expr(f"array_max({each(k)})")
    if engine == "five_op":
        h = halstead(v("halstead_h1"), v("halstead_h2"), v("halstead_n1"), v("halstead_n2"))
        index, full, path = maintainability(h["volume"], v("cc_sum") / v("cc_n"), v("lloc"), v("sloc"), F.coalesce(F.try_divide(v("comments") + v("multi_line_comments"), v("total_lines")), F.lit(0.0)))
        known = v("total_lines").isNotNull()
        out = {k: v(k) for k in "lloc sloc comments single_comments multi_line_comments blank_lines total_lines cyclomatic_complexity_max cyclomatic_complexity_module cc_imputed_module_level halstead_h1 halstead_h2 halstead_n1 halstead_n2".split()}
        out |= {"cyclomatic_complexity_mean": F.round(v("cc_sum") / v("cc_n"), 4), "halstead_vocabulary": h["vocabulary"], "halstead_length": h["length"]}
        out |= {f"halstead_{k}": F.when(known, F.round(h[k], 6)) for k in ("calculated_length", "volume", "difficulty", "effort", "time", "bugs")}
        return out | {"halstead_volume_is_zero": F.when(known, h["volume"] == 0), "maintainability_index": F.when(known, index), "maintainability_index_saturated": F.when(known, full), "maintainability_saturation_path": F.when(known, path)}
    if engine == "token":
        out = {"function_count": F.when(v("nloc").isNotNull(), F.size("_functions.values").cast("long")), "nloc": v("nloc"), "token_count": v("token_count"), "max_nesting_depth": most("max_nesting_depth")}
        for prefix, k in (("avg_token_count", "token_count"), ("avg_param_count", "param_count"), ("function_length", "nloc"), ("cyclomatic_complexity", "cyclomatic_complexity")):
            out |= _series(each(k), prefix)
        out |= {f"halstead_{k}": F.expr(f"round({_sum(of(k))}, 6)") for k in ("volume", "effort", "time", "bugs")}
        out |= {f"halstead_{k}": F.expr(f"round({_mean(of(k))}, 6)") for k in ("difficulty", "vocabulary")}
        out |= {"halstead_length": F.expr(_sum(of("length"))).cast("long")} | {f"halstead_{k}": F.expr(_sum(each(k))).cast("long") for k in ("h1", "h2", "n1", "n2")}
        return out | {"top_nesting_level_max": most("top"), "function_token_length_max": most("token_count")}
    if engine == "ast":
        share = lambda k: F.round(F.try_divide(v(k).cast("double"), v("total_nodes")), 6)
        plain = "ast_depth total_nodes functiondef_count classdef_count return_count call_count assign_count comprehension_count try_count decorator_count class_count noc_max base_classes_external operational_node_count"
        return {k: v(k) for k in plain.split()} | {"loop_ratio": share("loops"), "if_ratio": share("ifs"), "import_ratio": share("imports")} | _series(name("dit"), "dit", "max mean") | _series(name("rfc"), "rfc", "max mean") | _series(name("methods"), "methods_per_class", "mean")
    if engine == "lexical":
        keys = [s.key for s in S.SPECS if s.engine == engine and s.key != "type_token_ratio"]
        return {k: v(k) for k in keys} | {"type_token_ratio": F.round(F.try_divide(v("distinct_tokens").cast("double"), v("lexical_tokens")), 6)}
    if engine == "cognitive":
        return {"cognitive_complexity": v("cognitive_complexity")} | _series(name("points"), "cognitive_complexity")
    if engine == "structure":
        plain = "class_count dead_code_findings clone_count clone_pairs clone_groups clone_fragments_analysed function_count sloc lloc comment_lines docstring_lines"
        out = {k: v(k) for k in plain.split()} | {"dead_code_ratio": F.round(F.try_divide(v("dead_code_findings").cast("double"), v("blocks")), 6), "clone_similarity_mean": F.round(F.try_divide(v("similarity"), v("clone_pairs").cast("double")), 4)}
        for c, prefix, spec in ((name("cbo"), "cbo", "mean max"), (name("lcom"), "lcom", "mean max"), (each("cognitive_complexity"), "cognitive_complexity", "mean"), (each("plain_complexity"), "cyclomatic_complexity", "mean max"), (each("max_nesting_depth"), "nesting_depth", "mean max")):
            out |= _series(c, prefix, spec)
        return out
    if engine == "unused":
        return {"dead_code_items": F.when(v("found").isNotNull(), F.size(v("found")).cast("long")), "dead_code_high_confidence": F.when(v("found").isNotNull(), F.size(F.filter(v("found"), lambda x: x >= 100)).cast("long")), "dead_code_min_confidence": F.array_min(v("found"))}
    if engine == "security":
        known = v("severity").isNotNull()
        out = {"security_issues": F.when(known, F.size(v("severity")).cast("long"))}
        for what in ("severity", "confidence"):
            for grade in ("low", "medium", "high"):
                graded = F.array_size(v(what)) - F.array_size(F.array_remove(v(what), grade.upper()))
                out[f"security_{what}_{grade}"] = F.when(known, graded.cast("long"))
        return out
    return {}


class MetricFrame:
    """The measured fragments; every table is derived lazily from one intermediate, `rows`."""

    def __init__(self, fragments: DataFrame, engines: tuple[str, ...], threshold: float, generation: dict | None, tasks: int | None = None, carry: tuple[str, ...] = ()) -> None:
        self.engines, self.threshold, self.generation, self.carry = engines, threshold, generation, carry
        kernels = {e: _KERNELS[e] for e in engines if e in _KERNELS}
        kernels |= {e: (P.ENGINES[e].kernel, _struct(**{s.key: s.type for s in S.specs_of((e,))})) for e in engines if e in P.ENGINES}
        kernels |= {n: (k, _struct(**{s.key: s.type for s in specs})) for n, (specs, k) in _USER.items()}
        if set(engines) & {"token", "cognitive", "structure"} or not engines:
            kernels["functions"] = (K.function_rows, ArrayType(_FUNCTION))
        self.user = tuple(_USER)
        kept = [F.struct(*carry).alias("carried")] if carry else []
        given = fragments.select(F.col("fragment_id").cast("string").alias("fragment_id"), F.col("code").cast("string").alias("code"), *kept)
        if tasks:
            given = given.repartition(tasks)
        made = given.select("*", fused(kernels)(F.col("code")).alias("_m"))
        parts = [F.col(f"_m.{e}").alias(f"_{e}") for e in kernels]
        if "functions" not in kernels:
            parts.append(F.lit(None).cast(_struct(values=ArrayType(_FUNCTION), failure=T)).alias("_functions"))
        self.rows = made.select("fragment_id", F.sha2("code", 256).alias("code_sha256"), F.coalesce(F.col("_m.valid"), F.lit(False)).alias("is_valid_python"), F.lit("python").alias("language"), *parts, *["carried"] * bool(carry))

    def persist(self) -> MetricFrame:
        self.rows = self.rows.persist()
        return self

    def metrics(self, customary_names: bool = False) -> DataFrame:
        """One row a fragment, all declared columns in their fixed order; engines that aren't here are null blocks."""
        columns = [F.col(c) for c in S.IDENTITY]
        readings: dict[str, Column] = {}
        values = {e: _values(e) for e in self.engines if e in _KERNELS}
        for s in S.specs_of(self.engines):
            got = values[s.engine].get(s.key, F.lit(None)) if s.engine in _KERNELS else F.col(f"_{s.engine}.values.{s.key}") if s.engine in P.ENGINES else F.lit(None)
            readings[s.column] = got.cast(s.type).alias(s.column)
        user = [F.col(f"_{e}.values.{s.key}").cast(s.type).alias(s.column) for e in self.user for s in _USER[e][0]]
        table = self.rows.select(*columns, *readings.values(), *user)
        flags = []
        for key, engines in S.comparable_keys(self.engines).items():
            ratio, flag = divergence([F.col(S.column_name(key, e)) for e in engines], self.threshold)
            flags += [ratio.alias(S.delta_column(key)), flag.alias(S.divergent_column(key))]
        table = table.select("*", *flags)
        if customary_names:
            table = table.toDF(*[S.column_name(k, S.ALIASES.get(e, e)) if e in S.ALIASES else c for c in table.columns for k, e in [S.split_column(c)]])
        return table

    def functions(self) -> DataFrame:
        """Long: one row a function and engine, with the columns that were to be carried."""
        kept = [f"carried.{c}" for c in self.carry]
        engines = F.array(F.lit("token"), F.lit("cognitive"))
        rows = self.rows.select("fragment_id", *kept, F.explode("_functions.values").alias("f")).select("fragment_id", *self.carry, F.explode(engines).alias("engine"), "f")
        h = halstead(F.col("f.h1"), F.col("f.h2"), F.col("f.n1"), F.col("f.n2"))
        token = {c: F.col(f"f.{c}") for c in "start_line end_line nloc token_count param_count cyclomatic_complexity max_nesting_depth".split()} | {f"halstead_{k}": F.round(h[k], 6) for k in ("volume", "difficulty")}
        of = lambda engine, c: F.when(F.col("engine") == engine, c)
        return rows.select("fragment_id", "engine", "f.name", *[of("token", c).alias(k) for k, c in token.items()], of("cognitive", F.col("f.cognitive_complexity")).alias("cognitive_complexity"), *self.carry)

    def degradations(self) -> DataFrame:
        engines = [c[1:] for c in self.rows.columns if c.startswith("_") and c != "_functions"]
        told = F.array(*[F.struct(F.lit(e).alias("engine"), F.col(f"_{e}.failure").alias("detail")) for e in engines])
        return self.rows.select("fragment_id", F.explode(F.filter(told, lambda x: x["detail"].isNotNull())).alias("d")).select("d.engine", "fragment_id", F.lit("engine_failure").alias("kind"), "d.detail")

    @cached_property
    def _flags(self) -> list[str]:
        return [S.divergent_column(k) for k in S.comparable_keys(self.engines)]

    def value(self, key: str, engine: str) -> DataFrame:
        """(fragment_id, value): one reading of every fragment. An unknown one raises ValueError."""
        column = S.column_name(key, engine)
        if column not in S.metric_columns(self.engines):
            raise ValueError(f"no metric {key} of {engine} here")
        return self.metrics().select("fragment_id", F.col(column).alias("value"))

    def head(self, rows: int = 50) -> DataFrame:
        return self.metrics().orderBy("fragment_id").limit(rows)

    def overview(self) -> DataFrame:
        flags = sum((is_true(c).cast("int") for c in self._flags), F.lit(0))
        return self.metrics().select("fragment_id", "is_valid_python", "lloc__five_op", "cyclomatic_complexity_mean__five_op", flags.alias("divergent_metrics"))

    def null_rates(self) -> DataFrame:
        from .tables import null_rates

        return null_rates(self.metrics(), [c for c in self.metrics().columns if c not in S.IDENTITY])

    def divergence_summary(self) -> DataFrame:
        from .tables import divergence_summary

        return divergence_summary(self.metrics(), list(S.comparable_keys(self.engines)))

    def metric_major(self, only_divergent: bool = False) -> DataFrame:
        from .tables import metric_major

        return metric_major(self.metrics(), S.comparable_keys(self.engines), only_divergent)

    @cached_property
    def provenance(self) -> dict:
        """The envelope of a run; what can't be told is null."""
        import hashlib

        body = {"schema_version": S.SCHEMA_VERSION, "engines": list(self.engines), "threshold": self.threshold}
        out = {
            "run_id": hashlib.sha256(json.dumps([body, datetime.now(UTC).isoformat()]).encode()).hexdigest()[:32], "generated_at": datetime.now(UTC).isoformat(), "analysis_chain": [{k: r[k] for k in ("engine", "version", "path", "available")} for r in doctor() if r["engine"] in self.engines],
            "interpreter": {"implementation": platform.python_implementation(), "version": sys.version.split()[0]}, "package": {"name": "metrolith", **body}, "environment": {"os": platform.system(), "host_hash": hashlib.sha256(platform.node().encode()).hexdigest()[:16]},
            "inputs": {"fragment_count": self.rows.select("fragment_id").count()},
        }
        return out | ({"generation": self.generation} if self.generation else {})

    def _tables(self) -> dict[str, DataFrame]:
        return {"metrics": self.metrics(), "functions": self.functions(), "degradations": self.degradations()}

    def write(self, folder: str, kind: str = "parquet", prefix: str = "metrolith_") -> list[str]:
        """Every table that isn't empty, as parquet (authoritative) or csv (types are lost), and provenance as one JSON
        file. The fragments are measured once: unless `rows` is kept already, it is for as long as this takes."""
        kept = not self.rows.is_cached
        if kept:
            self.rows.persist()
        made = []
        try:
            for name, df in self._tables().items():
                if not df.isEmpty():
                    w = df.write.mode("overwrite")
                    (w.parquet if kind == "parquet" else w.option("header", True).csv)(f"{folder}/{prefix}{name}")
                    made.append(name)
            write_text(self.rows.sparkSession, f"{folder}/{prefix}provenance.json", json.dumps(self.provenance, indent=2))
        finally:
            if kept:
                self.rows.unpersist()
        return [*made, "provenance"]


def write_text(spark, uri: str, text: str) -> None:  # noqa: ANN001
    """A small file on any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def measure(fragments: DataFrame, engines: list[str] | None = None, threshold: float = S.THRESHOLD, include_optional: bool = False, generation: dict | None = None, tasks: int | None = None, carry: tuple[str, ...] = ()) -> MetricFrame:
    """fragments: (fragment_id, code). Unknown engine names raise ValueError. tasks: into how many tasks the fragments are
    dealt first; due where a few files hold many, since a fragment takes milliseconds. carry: columns of the fragments that
    functions() has too, so that they needn't be joined again; names of its own are no good."""
    return MetricFrame(fragments, S.select_engines(engines, include_optional), threshold, generation, tasks, carry)


def doctor() -> list[dict]:
    """Of each engine whether it is a default one, and available here: our own always, programs where they answer."""
    out = []
    for e in S.DEFAULT + S.OPTIONAL:
        path, version = P.ENGINES[e].probe() if e in P.ENGINES else (None, S.SCHEMA_VERSION)
        out.append({"engine": e, "default": e in S.DEFAULT, "available": version is not None, "version": version, "path": path})
    return out
