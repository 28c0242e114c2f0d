"""The registered queries over the supplied tables, each with its oracle in SQL.

The tables hold no Python source. Queries on texts take `documents.text` as fragments; queries on syntax write a small
program for each row of `part` whose metrics have a closed form in k = p_size % 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_columns
from .functions import text as X
from .functions.columns import divergence, halstead, maintainability, severity
from .operators import tables as T
from .operators.measure import doctor, measure
from .plans import specs as S

FLAGSHIP = "q_divergence_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ texts as fragments


@_query("select cast(doc_id as varchar) as fragment_id, sha256(text) as code_sha256, cast(length(text) as int) as chars from documents")
def q_identity(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fragment_id"), F.sha2("text", 256).alias("code_sha256"), F.length("text").alias("chars"))


@_query(r"""
with r as (select doc_id, text, case when doc_id % 3 = 0 then '```Python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```sql' || chr(10) || 'select 1' || chr(10) || '```' when doc_id % 3 = 1 then text else '' end as raw from documents),
b as (select doc_id, case when doc_id % 3 = 0 then [{'i': 0, 'l': 'python', 'c': text}, {'i': 1, 'l': 'sql', 'c': 'select 1'}] else [{'i': 0, 'l': 'python', 'c': raw}] end as bs from r)
select doc_id, u.i::int as block_index, u.l as language, sha256(trim(u.c, ' ' || chr(9) || chr(10) || chr(13))) as code_sha256 from (select doc_id, unnest(bs) as u from b) where trim(u.c, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def q_fence_blocks(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```Python\n"), "text", F.lit("\n```\nand\n```sql\nselect 1\n```"))).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise("")
    return _t(spark, d, "documents").select("doc_id", F.posexplode(X.code_blocks(raw)).alias("block_index", "b")).select("doc_id", "block_index", "b.language", F.sha2("b.code", 256).alias("code_sha256"))


_LINES = "case when text = '' then [] else string_split(regexp_replace(text, '\\n$', ''), chr(10)) end"
_TRIM = "trim(x, ' ' || chr(9) || chr(10) || chr(13))"


@_query(f"""select doc_id, len(({_LINES}))::int as total_lines, len(list_filter(({_LINES}), lambda x: {_TRIM} = ''))::int as blank_lines,
len(list_filter(({_LINES}), lambda x: {_TRIM} <> '' and not starts_with({_TRIM}, '#')))::int as sloc from documents""")
def q_text_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", X.total_lines(t).cast("int").alias("total_lines"), X.blank_lines(t).cast("int").alias("blank_lines"), X.source_lines(t).cast("int").alias("sloc"))


@_query("""with w as (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as ws from documents)
select doc_id, len(ws)::int as tokens, len(list_distinct(ws))::int as distinct_tokens, case when len(ws) > 0 then round(len(list_distinct(ws))::double / len(ws), 6) end as type_token_ratio from w""")
def q_text_ttr(spark: SparkSession, d: str) -> DataFrame:
    w = _t(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("ws"))
    n, k = F.size("ws"), F.size(F.array_distinct("ws"))
    return w.select("doc_id", n.alias("tokens"), k.alias("distinct_tokens"), F.round(F.try_divide(k.cast("double"), n), 6).alias("type_token_ratio"))


_READ_SQL = """select doc_id, n_chars::double as chars__stored, length(text)::double as chars__recount, len(regexp_extract_all(text, '[A-Za-z]+'))::double as words__regex,
len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::double as words__split, len(string_split(text, chr(10)))::double as lines__newline, len(regexp_extract_all(text, '[.!?]'))::double as lines__stop from documents"""
_TEXT_METRICS = {"chars": ["stored", "recount"], "words": ["regex", "split"], "lines": ["newline", "stop"]}


def _flag_sql(a: str, b: str) -> tuple[str, str]:
    ratio = f"case when {a} is not null and {b} is not null and {a} <> 0 and {b} <> 0 then round(greatest({a}, {b}) / least({a}, {b}), 6) end"
    return ratio, f"case when {a} is null or {b} is null then null when {a} = 0 and {b} = 0 then false when {a} = 0 or {b} = 0 then true else {ratio} - 1.0 > 0.1 end"


_WIDE_SQL = f"with r as ({_READ_SQL}) select *, " + ", ".join(f"{_flag_sql(f'{m}__{a}', f'{m}__{b}')[0]} as {m}__delta_ratio, {_flag_sql(f'{m}__{a}', f'{m}__{b}')[1]} as {m}__divergent" for m, (a, b) in _TEXT_METRICS.items()) + " from r"


def _text_readings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    rows = _t(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("chars__stored"), F.length(t).cast("double").alias("chars__recount"), count("[A-Za-z]+").alias("words__regex"), count(r"[^ \t\n\r]+").alias("words__split"), F.size(F.split(t, "\n", -1)).cast("double").alias("lines__newline"), count("[.!?]").alias("lines__stop"))
    flags = []
    for m, engines in _TEXT_METRICS.items():
        ratio, flag = divergence([F.col(f"{m}__{e}") for e in engines])
        flags += [ratio.alias(f"{m}__delta_ratio"), flag.alias(f"{m}__divergent")]
    return rows.select("*", *flags)


@_query(_WIDE_SQL)
def q_divergence_rows(spark: SparkSession, d: str) -> DataFrame:
    return _text_readings(spark, d)


_SUMMARY_SQL = f"with w as ({_WIDE_SQL}) " + " union all ".join(
    f"select '{m}' as metric, count({m}__divergent) as compared, coalesce(count(*) filter ({m}__divergent), 0) as divergent, round(avg({m}__divergent::int), 4) as divergent_rate, round(median({m}__delta_ratio), 4) as ratio_median, round(max({m}__delta_ratio), 4) as ratio_max from w" for m in _TEXT_METRICS
)


@_query(_SUMMARY_SQL)
def q_divergence_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.divergence_summary(_text_readings(spark, d), list(_TEXT_METRICS))


@_query(f"select metric from ({_SUMMARY_SQL}) order by divergent_rate desc, metric limit 1")
def q_worst_metric(spark: SparkSession, d: str) -> DataFrame:
    return T.worst_metric(q_divergence_summary(spark, d)).select("metric")


_BANDS = "case when not coalesce({f}, false) then 'agree' when {r} is null then 'absent-present' when {r} >= 5 then 'strong' when {r} >= 1.5 then 'clear' else 'slight' end"


@_query(f"with w as ({_WIDE_SQL}) " + " union all ".join(f"select doc_id, '{m}' as metric, {m}__{a} as low_reading, {m}__{b} as high_reading, {m}__delta_ratio as ratio, {m}__divergent as divergent, {_BANDS.format(f=f'{m}__divergent', r=f'{m}__delta_ratio')} as severity from w" for m, (a, b) in _TEXT_METRICS.items()))
def q_metric_major(spark: SparkSession, d: str) -> DataFrame:
    long = T.metric_major(_text_readings(spark, d), _TEXT_METRICS, key="doc_id")
    first, second = (F.coalesce(*[F.col("readings")[e[i]] for e in _TEXT_METRICS.values()]) for i in (0, 1))
    return long.select("doc_id", "metric", first.alias("low_reading"), second.alias("high_reading"), "ratio", "divergent", "severity")


@_query("""select sha256(text) as code_sha256, count(*) as copies, min(doc_id) as first_id, cast(max(length(text)) as int) as chars from documents group by 1""")
def q_dedup_measure(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("code_sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max(F.length("text")).alias("chars"))


_RULES = (("token", r"token = ", "HIGH", "HIGH"), ("address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "LOW", "MEDIUM"), ("long_number", r"[0-9]{12,}", "MEDIUM", "LOW"))


def _counts(pattern_rules: list, n: Callable) -> list:
    return [n(p) for _, p, _, _ in pattern_rules]


@_query("select doc_id, " + ", ".join([" + ".join(f"len(regexp_extract_all(text, '{p}'))" for _, p, _, _ in _RULES) + " as security_issues", *[(" + ".join(f"len(regexp_extract_all(text, '{r[1]}'))" for r in _RULES if r[i] == g) or "0") + f" as {w}_{g.lower()}" for i, w in ((2, "severity"), (3, "confidence")) for g in ("LOW", "MEDIUM", "HIGH")]]) + " from documents")
def q_text_patterns(spark: SparkSession, d: str) -> DataFrame:
    hits = {r[0]: F.regexp_count("text", F.lit(r[1])).cast("long") for r in _RULES}
    total = lambda rules: sum((hits[r[0]] for r in rules), F.lit(0).cast("long"))
    grades = [total([r for r in _RULES if r[i] == g]).alias(f"{w}_{g.lower()}") for i, w in ((2, "severity"), (3, "confidence")) for g in ("LOW", "MEDIUM", "HIGH")]
    return _t(spark, d, "documents").select("doc_id", total(list(_RULES)).alias("security_issues"), *grades)


# ------------------------------------------------------------------ programs as fragments



def _rep(text: Column | str) -> Column:
    return F.expr(f"repeat('{text}', cast(k as int))")


def _programs(spark: SparkSession, d: str, template: str) -> DataFrame:
    part = _t(spark, d, "part").repartition(spark.sparkContext.defaultParallelism)  # one small file, and measuring is the work
    part = part.select(F.col("p_partkey").cast("string").alias("fragment_id"), (F.col("p_size") % 4).cast("long").alias("k"))
    nl = "\\n"
    code = {
        "A": F.concat(F.lit("def f(a, b):\n    total = 0\n"), _rep(f"    for i in b:{nl}        total += a{nl}"), F.lit("    return total\n")),
        "B": F.concat(F.lit("total = 0\n"), _rep(f"if total > 1 or total < 5:{nl}    total = total + 2{nl}"), F.lit("print(total)\n")),
        "C": F.concat(F.lit("class Base:\n    def run(self):\n        return helper(1)\n"), F.expr("case when k = 0 then '' else array_join(transform(sequence(1, cast(k as int)), i -> concat('class C', i, '(Base):\\n    pass\\n')), '') end")),
        "E": F.when(F.col("fragment_id").cast("int") % 10 == 5, F.concat(F.lit("total = "), F.expr("repeat('-', 20000)"), F.lit("1\n"))).when(F.col("fragment_id").cast("int") % 10 == 0, "def broken(").otherwise("total = 0\n"),
        "D": F.when(F.col("fragment_id").cast("int") % 10 == 0, "def broken(").otherwise(F.concat(F.lit("total = 0\n"), _rep(f"total = total + 1{nl}"))),
    }[template]
    return part.withColumn("code", code)


_P = "with p as (select cast(p_partkey as varchar) as fragment_id, p_size % 4 as k, p_partkey % 10 = 0 as bad from part) "


@_query(_P + """select fragment_id, true as is_valid_python, (12 + 11 * k)::bigint as total_nodes, case when k = 0 then 4 else 5 end::bigint as ast_depth, (1 + k)::bigint as assigns, 1::bigint as returns,
round(k::double / (12 + 11 * k), 6) as loop_ratio, (2 + 2 * k)::bigint as operational, (3 + 2 * k)::bigint as total_lines, (1 + k)::double as cc_mean, k::bigint as cognitive from p""")
def q_ast_nodes(spark: SparkSession, d: str) -> DataFrame:
    m = measure(_programs(spark, d, "A"), ["five_op", "ast", "cognitive"]).metrics()
    return m.select("fragment_id", "is_valid_python", F.col("total_nodes__ast").alias("total_nodes"), F.col("ast_depth__ast").alias("ast_depth"), F.col("assign_count__ast").alias("assigns"), F.col("return_count__ast").alias("returns"), F.col("loop_ratio__ast").alias("loop_ratio"), F.col("operational_node_count__ast").alias("operational"), F.col("total_lines__five_op").alias("total_lines"), F.col("cyclomatic_complexity_mean__five_op").alias("cc_mean"), F.col("cognitive_complexity__cognitive").alias("cognitive"))


@_query(_P + "select fragment_id, (13 + 8 * k)::bigint as lexical_tokens, case when k = 0 then 12 else 16 end::bigint as distinct_tokens, round((case when k = 0 then 12 else 16 end)::double / (13 + 8 * k), 6) as type_token_ratio from p")
def q_lexical(spark: SparkSession, d: str) -> DataFrame:
    m = measure(_programs(spark, d, "A"), ["lexical"]).metrics()
    return m.select("fragment_id", *[F.col(f"{k}__lexical").alias(k) for k in ("lexical_tokens", "distinct_tokens", "type_token_ratio")])


@_query(_P + """select fragment_id, (1 + k)::bigint as class_count, case when k = 0 then 1 else 2 end::bigint as dit_max, round((1 + 2 * k)::double / (1 + k), 4) as dit_mean, k::bigint as noc_max, 2::bigint as rfc_max,
round(2.0::double / (1 + k), 4) as rfc_mean, round(1.0::double / (1 + k), 4) as methods_mean, false as class_count_divergent from p""")
def q_ck(spark: SparkSession, d: str) -> DataFrame:
    m = measure(_programs(spark, d, "C"), ["ast", "structure"]).metrics()
    return m.select("fragment_id", F.col("class_count__ast").alias("class_count"), F.col("dit_max__ast").alias("dit_max"), F.col("dit_mean__ast").alias("dit_mean"), F.col("noc_max__ast").alias("noc_max"), F.col("rfc_max__ast").alias("rfc_max"), F.col("rfc_mean__ast").alias("rfc_mean"), F.col("methods_per_class_mean__ast").alias("methods_mean"), F.col("class_count__divergent").alias("class_count_divergent"))


@_query(_P + """select fragment_id, (1 + 2 * k)::bigint as with_boolean, k::bigint as operators_n1_compare_half, true as imputed, case when k = 0 then true else false end as volume_is_zero,
(2 + 2 * k)::bigint as total_lines, case when k = 0 then 100.0::double end as index_if_blind, case when k = 0 then 1 else 0 end::bigint as blind_path from p""")
def q_mccabe_module(spark: SparkSession, d: str) -> DataFrame:
    m = measure(_programs(spark, d, "B"), ["five_op"]).metrics()
    c = lambda k: F.col(f"{k}__five_op")
    blind = c("halstead_volume_is_zero")
    return m.select("fragment_id", c("cyclomatic_complexity_module").alias("with_boolean"), F.expr("halstead_n1__five_op div 4").alias("operators_n1_compare_half"), c("cc_imputed_module_level").alias("imputed"), blind.alias("volume_is_zero"), c("total_lines").alias("total_lines"), F.when(blind, c("maintainability_index")).alias("index_if_blind"), F.when(blind, c("maintainability_saturation_path")).otherwise(0).cast("long").alias("blind_path"))


@_query(_P + "select fragment_id, not bad as is_valid_python, case when not bad then 1 + k end::bigint as assigns, cast(null as double) as pylint_score, cast(null as boolean) as function_count_divergent from p")
def q_fixed_schema(spark: SparkSession, d: str) -> DataFrame:
    m = measure(_programs(spark, d, "D"), ["ast", "token", "lint"]).metrics()
    return m.select("fragment_id", "is_valid_python", F.col("assign_count__ast").alias("assigns"), F.col("pylint_score__lint").alias("pylint_score"), F.lit(None).cast("boolean").alias("function_count_divergent"))


@_query(_P + "select 'assign_count__ast' as metric, avg(bad::int)::double as null_rate from p union all select 'dit_max__ast', 1.0::double union all select 'total_nodes__ast', avg(bad::int)::double from p")
def q_null_rates(spark: SparkSession, d: str) -> DataFrame:
    return T.null_rates(measure(_programs(spark, d, "D"), ["ast"]).metrics(), ["assign_count__ast", "dit_max__ast", "total_nodes__ast"])


@_query(_P + "select fragment_id, engine, 'f' as name, case when engine = 'token' then 1 + k end::bigint as cyclomatic_complexity, case when engine = 'cognitive' then k end::bigint as cognitive_complexity from p, (values ('token'), ('cognitive')) e(engine)")
def q_functions_long(spark: SparkSession, d: str) -> DataFrame:
    return measure(_programs(spark, d, "A"), ["token", "cognitive"]).functions().select("fragment_id", "engine", "name", "cyclomatic_complexity", "cognitive_complexity")


@_query(_P + "select k::bigint as k, count(*) as functions, round(avg(1 + k), 4)::double as cc_mean, max(1 + k)::bigint as cc_max from p group by k")
def q_function_rollup(spark: SparkSession, d: str) -> DataFrame:
    f = measure(_programs(spark, d, "A"), ["token"], carry=("k",)).functions().where("engine = 'token'")
    return f.groupBy("k").agg(F.count(F.lit(1)).alias("functions"), F.round(F.avg("cyclomatic_complexity"), 4).alias("cc_mean"), F.max("cyclomatic_complexity").alias("cc_max"))


@_query(_P + "select fragment_id, true as is_valid_python, (3 + 2 * k - (1 + k) * 0)::bigint - 0 as lloc, (1 + k)::double as cc_mean from p")
def q_overview(spark: SparkSession, d: str) -> DataFrame:
    o = measure(_programs(spark, d, "A")).overview()
    return o.select("fragment_id", "is_valid_python", F.col("lloc__five_op").alias("lloc"), F.col("cyclomatic_complexity_mean__five_op").alias("cc_mean"))


@_query(None)
def q_metrics_all(spark: SparkSession, d: str) -> DataFrame:
    """Every declared column of every engine."""
    return measure(_programs(spark, d, "C"), include_optional=True).metrics()


@_query("""select engine, cast(p_partkey as varchar) as fragment_id, 'engine_failure' as kind, 'MemoryError' as detail from part,
(values ('five_op'), ('token'), ('ast'), ('lexical'), ('cognitive'), ('structure'), ('unused'), ('security')) e(engine) where p_partkey % 10 = 5""")
def q_degradations(spark: SparkSession, d: str) -> DataFrame:
    """One text in ten is too deep for the parser: a row an engine; a text that isn't Python is none."""
    return measure(_programs(spark, d, "E")).degradations()


# ------------------------------------------------------------------ relational readings

_H = "with h as (select o_orderkey, count(distinct l_returnflag)::double as h1, count(distinct l_suppkey)::double as h2, count(*)::double as n1, sum(l_linenumber)::double as n2 from orders left join lineitem on l_orderkey = o_orderkey group by 1), v as (select *, h1 + h2 as vocabulary, n1 + n2 as length, (n1 + n2) * case when h1 + h2 > 0 then log2(h1 + h2) else 0 end as volume, case when h2 = 0 then 0 else h1 / 2 * n2 / h2 end as difficulty from (select o_orderkey, h1, h2, coalesce(n1, 0) as n1, coalesce(n2, 0) as n2 from h)) "


def _halstead_counts(spark: SparkSession, d: str) -> DataFrame:
    l = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").cast("double").alias("h1"), F.count_distinct("l_suppkey").cast("double").alias("h2"), F.count(F.lit(1)).cast("double").alias("n1"), F.sum("l_linenumber").cast("double").alias("n2"))
    o = _t(spark, d, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("h1", F.lit(0.0)).alias("h1"), F.coalesce("h2", F.lit(0.0)).alias("h2"), F.coalesce("n1", F.lit(1.0)).alias("n1"), F.coalesce("n2", F.lit(0.0)).alias("n2"))


@_query(_H + "select o_orderkey, vocabulary, length, round(volume, 4) as volume, round(difficulty, 4) as difficulty, round(difficulty * volume, 3) as effort, round(difficulty * volume / 18, 3) as time, round(volume / 3000, 6) as bugs from v")
def q_halstead_formula(spark: SparkSession, d: str) -> DataFrame:
    h = halstead(*[F.col(c) for c in ("h1", "h2", "n1", "n2")])
    return _halstead_counts(spark, d).select("o_orderkey", h["vocabulary"].alias("vocabulary"), h["length"].alias("length"), F.round(h["volume"], 4).alias("volume"), F.round(h["difficulty"], 4).alias("difficulty"), F.round(h["effort"], 3).alias("effort"), F.round(h["time"], 3).alias("time"), F.round(h["bugs"], 6).alias("bugs"))


@_query(_H + """, m as (select o_orderkey, volume, case when volume <= 0 then 100.0 else least(100.0, greatest(0.0, (171 - 5.2 * ln(greatest(volume, 1e-9)) - 0.23 * h1 - 16.2 * ln(greatest(n1, 1.0))) * 100 / 171)) end as i from v)
select o_orderkey, round(i, 4) as maintainability, i = 100.0 as saturated, case when i <> 100.0 then 0 when volume <= 0 then 1 else 2 end::bigint as path from m""")
def q_maintainability_formula(spark: SparkSession, d: str) -> DataFrame:
    c = _halstead_counts(spark, d)
    i, full, path = maintainability(halstead(*[F.col(x) for x in ("h1", "h2", "n1", "n2")])["volume"], F.col("h1"), F.col("n1"), F.lit(1), F.lit(0.0))
    return c.select("o_orderkey", F.round(i, 4).alias("maintainability"), full.alias("saturated"), path.alias("path"))


@_query("""with r as (select o_orderkey, max(o_totalprice) as a, round(sum(l_extendedprice), 2) as b, nullif(max(l_quantity), 50) * 1000 as c from orders left join lineitem on l_orderkey = o_orderkey group by 1),
s as (select *, (a is not null)::int + (b is not null)::int + (c is not null)::int as n, greatest(a, b, c) as hi, least(a, b, c) as lo from r)
select o_orderkey, case when n >= 2 then floor(round(hi / lo, 6) * 100 + 1e-6) end as ratio, case when n >= 2 then round(hi / lo, 6) - 1.0 > 0.1 end as divergent, """ + _BANDS.format(f="case when n >= 2 then round(hi / lo, 6) - 1.0 > 0.1 end", r="case when n >= 2 then round(hi / lo, 6) end") + " as severity from s")
def q_divergence_three(spark: SparkSession, d: str) -> DataFrame:
    l = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("b"), F.max("l_quantity").alias("q"))
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("a")).join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ratio, flag = divergence([F.col("a"), F.col("b"), F.nullif(F.col("q"), F.lit(50.0)) * 1000])
    return o.select("o_orderkey", F.floor(ratio * 100 + 1e-6).cast("double").alias("ratio"), flag.alias("divergent"), severity(ratio, flag).alias("severity"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("timestamp"), "o_totalprice")
    months = o.select("timestamp").distinct()
    from pyspark.sql import Window

    index = months.withColumn("revision_index", F.row_number().over(Window.orderBy("timestamp")) - 1)
    return o.join(index, "timestamp").withColumn("sha", F.md5("timestamp"))


_TREND = "with m as (select strftime(o_orderdate, '%Y-%m') as ts, o_totalprice from orders) select (dense_rank() over (order by ts) - 1)::int as revision_index, md5(ts) as sha, ts as timestamp, v as value from (select ts, {} as v from m group by ts)"


def _trend(how: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = T.trend(_history(spark, d), "o_totalprice", how)
        return t.withColumn("value", F.round("value", 2))

    QUERIES[f"q_trend_{how}"], ORACLE_SQL[f"q_trend_{how}"] = run, _TREND.format(f"round({sql}, 2)")


for _how, _sql in (("sum", "sum(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("max", "max(o_totalprice)"), ("min", "min(o_totalprice)")):
    _trend(_how, _sql)


@_query("""with e as (select distinct cast(ts as date) as sha, user_id as path from events), r as (select sha, row_number() over (order by sha desc) - 1 as pos from (select distinct sha from e)),
s as (select sha, row_number() over (order by sha) - 1 as revision_index from r where pos % 3 = 0)
select cast(sha as varchar) as sha, path, revision_index::int as revision_index from e join s using (sha) qualify row_number() over (partition by sha order by path) <= 50""")
def q_history_sample(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.to_date("ts").alias("sha"), F.col("user_id").alias("path")).distinct().withColumn("day", F.col("sha"))
    return T.sample_revisions(e, "sha", "day", "path", every=3).select(F.col("sha").cast("string").alias("sha"), "path", "revision_index")


@_query("select user_id, count(*) as messages, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') as purchase, count(distinct event_type) as tools from events group by 1")
def q_counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    per = [F.count_if(F.col("event_type") == x).alias(x) for x in ("click", "view", "purchase")]
    return _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), *per, F.count_distinct("event_type").alias("tools"))


@_query("select event_id, try_cast(nullif(regexp_extract('Your code has been rated at ' || printf('%.2f', round(value, 2)) || '/10', 'rated at (-?[0-9]+\\.[0-9]+)/10', 1), '') as double) as score from events")
def q_rating_text(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Your code has been rated at "), F.format_string("%.2f", F.round("value", 2)), F.lit("/10"))
    return _t(spark, d, "events").select("event_id", F.regexp_extract(said, r"rated at (-?\d+\.\d+)/10", 1).try_cast("double").alias("score"))


@_query("select vec_id, 'given' as model, " + ", ".join(f"coalesce(embedding[{i + 1}]::double, 0) as dim_{i}" for i in range(70)) + " from embeddings")
def q_embedding_wide(spark: SparkSession, d: str) -> DataFrame:
    return T.wide_embedding(_t(spark, d, "embeddings"), "vec_id", "embedding", 70, "given")


@_query("select label, dim::int as dim, round(avg(x::double), 5) as value from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as dim from embeddings) group by 1, 2")
def q_masked_mean(spark: SparkSession, d: str) -> DataFrame:
    return T.masked_mean(_t(spark, d, "embeddings"), "label", F.transform("embedding", lambda x: x.cast("double"))).withColumn("value", F.round("value", 5))


@_query(None)
def q_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s.column, s.engine, s.key, s.level, s.unit, s.kind, s.null) for s in S.SPECS], "column string, engine string, key string, level string, unit string, kind string, null_means string")


@_query("select * from (values ('five_op', 27), ('token', 29), ('ast', 22), ('lexical', 9), ('cognitive', 4), ('structure', 22), ('unused', 3), ('security', 7), ('lint', 5), ('linters', 9)) t(engine, columns)")
def q_catalogue_counts(spark: SparkSession, d: str) -> DataFrame:
    return q_catalogue(spark, d).groupBy("engine").agg(F.count(F.lit(1)).cast("int").alias("columns"))


@_query("select engine, is_default, case when is_default then '1.0.0' end as version from (values ('five_op', true), ('token', true), ('ast', true), ('lexical', true), ('cognitive', true), ('structure', true), ('unused', true), ('security', true), ('lint', false), ('linters', false)) t(engine, is_default)")
def q_doctor(spark: SparkSession, d: str) -> DataFrame:
    """Versions of our own engines only: those of programs depend on the machine."""
    rows = [(r["engine"], r["default"], r["version"] if r["default"] else None) for r in doctor()]
    return spark.createDataFrame(rows, "engine string, is_default boolean, version string")


QUERIES |= queries_columns.QUERIES
ORACLE_SQL |= queries_columns.ORACLE_SQL
