import pytest
from pyspark.sql import functions as F

from metrolith.functions.columns import divergence
from metrolith.kernels import code as K
from metrolith.operators import tables as T
from metrolith.operators.measure import doctor, measure
from metrolith.plans import specs as S
from metrolith.sources.readers import from_responses, from_strings, read_history, read_paths


@pytest.mark.parametrize(
    ("readings", "ratio", "flag"),
    [([None, None], None, None), ([1.0, None], None, None), ([0.0, 0.0], None, False), ([0.0, 139.0], None, True), ([4.75, 47.5], 10.0, True), ([100.0, 105.0], 1.05, False), ([100.0, 110.0], 1.1, True), ([2.0, 2.0, None], 1.0, False)],
)
def test_divergence_truth_table(spark, readings, ratio, flag):
    df = spark.createDataFrame([tuple(readings)], ", ".join(f"c{i} double" for i in range(len(readings))))
    r, f = divergence([F.col(c) for c in df.columns])
    assert tuple(df.select(r, f).first()) == (ratio, flag)


def test_declared_columns():
    every = S.select_engines(include_optional=True)
    assert len(S.specs_of(every)) == 137 and len(S.comparable_keys(every)) == 18 and len(S.metric_columns(every)) == 173
    assert S.split_column("a__b__five_op") == ("a__b", "five_op")
    with pytest.raises(ValueError):
        S.column_name("x", "")
    with pytest.raises(ValueError):
        S.select_engines(["nope"])
    assert "sloc__five_op" in S.catalogue()


CODE = {
    "plain": "def f(a, b):\n    if a and b:\n        return 1\n    return 0\n",
    "broken": "def broken(",
    "empty": "",
    "nul": "x = 1\x00",
    "deep": "x = " + "[" * 150 + "]" * 150,
    "class": "class A:\n    def m(self):\n        return self.x\n    def n(self):\n        return self.y\nclass B(A, Other):\n    pass\n",
    "dead": "def g():\n    return 1\n    x = 2\n",
    "risky": "import pickle, hashlib\neval('1')\nhashlib.md5(b'')\n",
}


@pytest.fixture(scope="module")
def frame(spark):
    return measure(from_strings(spark, CODE)).persist()


def test_rows_and_schema(frame):
    m = frame.metrics()
    assert m.columns == [f.name for f in S.table_schema(frame.engines)]
    assert [f.dataType for f in m.schema] == [f.dataType for f in S.table_schema(frame.engines)]
    rows = {r.fragment_id: r for r in m.collect()}
    assert set(rows) == set(CODE)
    for k in ("broken", "empty", "nul"):
        assert not rows[k].is_valid_python and rows[k]["total_nodes__ast"] is None and rows[k]["sloc__five_op"] is None
    p = rows["plain"]
    assert (p["cyclomatic_complexity_mean__five_op"], p["cyclomatic_complexity_max__structure"], p["cognitive_complexity__cognitive"], p["function_count__token"]) == (3.0, 2, 2, 1)
    assert p["cyclomatic_complexity_mean__divergent"] is True
    assert rows["deep"]["ast_depth__ast"] > 100
    c = rows["class"]
    assert (c["class_count__ast"], c["dit_max__ast"], c["noc_max__ast"], c["base_classes_external__ast"], c["lcom_max__structure"]) == (2, 2, 1, 1, 2)
    assert rows["dead"]["dead_code_findings__structure"] == 1 and rows["risky"]["security_issues__security"] >= 3
    assert rows["plain"]["dit_max__ast"] is None and rows["plain"]["class_count__ast"] == 0


def test_side_tables(frame, tmp_path, spark):
    assert {r.engine for r in frame.functions().select("engine").distinct().collect()} == {"token", "cognitive"}
    assert frame.degradations().count() == 0
    rates = frame.null_rates().collect()
    assert all(0 <= r.null_rate <= 1 for r in rates) and [r.null_rate for r in rates] == sorted((r.null_rate for r in rates), reverse=True)
    assert frame.divergence_summary().columns == ["metric", "compared", "divergent", "divergent_rate", "ratio_median", "ratio_max"]
    assert frame.overview().count() == len(CODE)
    assert all(len(r.readings) >= 2 for r in frame.metric_major().collect())
    made = frame.write(str(tmp_path))
    assert "degradations" not in made and spark.read.parquet(f"{tmp_path}/metrolith_metrics").count() == len(CODE)


def test_failures_are_rows(spark, monkeypatch):
    from metrolith.operators import measure as M

    def bad(code):
        raise RuntimeError("no")

    monkeypatch.setitem(M._KERNELS, "lexical", (bad, M._KERNELS["lexical"][1]))
    f = M.measure(from_strings(spark, {"a": "x = 1\n", "b": "("}), ["lexical"])
    assert [tuple(r) for r in f.degradations().collect()] == [("lexical", "a", "engine_failure", "RuntimeError: no")]
    assert f.metrics().where("fragment_id = 'a'").first()["lexical_tokens__lexical"] is None


def test_cycle_and_chain_of_bases():
    assert K.tree("class A(B): pass\nclass B(A): pass\n")["class_count"] == 2
    chain = "class C0: pass\n" + "".join(f"class C{i}(C{i - 1}): pass\n" for i in range(1, 1500))
    assert max(K.tree(chain)["dit"]) == 1500


def test_blocks_and_ids(spark):
    r = spark.createDataFrame([(1, "a\n```Py\n x=1 \n```\n```sql\nselect\n```\n``` \n"), (2, "y = 2"), (3, " "), (4, None)], "id int, raw string")
    assert [(x.fragment_id, x.code) for x in from_responses(r, "id", "raw").orderBy("fragment_id").collect()] == [("1#0", "x=1"), ("2#0", "y = 2")]
    assert len({x.fragment_id for x in from_strings(spark, ["a", "a", "b"]).collect()}) == 3


def test_trend_and_missing_column(spark):
    h = spark.createDataFrame([(0, "a", "t", None), (0, "a", "t", None), (1, "b", "u", 2.0)], "revision_index int, sha string, timestamp string, v double")
    assert [r.value for r in T.trend(h, "v", "sum").collect()] == [None, 2.0]
    assert [r.value for r in T.trend(h, "v", "sum", compat=True).collect()] == [0.0, 2.0]
    assert T.trend(h, "nope").count() == 0


def test_git_and_files(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        (tmp_path / "m.py").write_text("x = 1\n" * (i + 1))
        run("add", ".")
        run("commit", "-qm", f"c{i}")
    rows = read_history(spark, str(tmp_path)).orderBy("revision_index").collect()
    assert [len(r.code.splitlines()) for r in rows] == [1, 2, 3]
    assert read_paths(spark, str(tmp_path)).count() == 1


def test_doctor_and_entry(spark):
    import __spark_entry__ as E

    assert all(r["available"] for r in doctor() if r["default"])
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0


def test_a_folder_that_is_no_repository_says_so(spark, tmp_path):
    with pytest.raises(Exception, match="git log"):
        read_history(spark, str(tmp_path)).collect()


def test_history_is_measured(spark, tmp_path):
    import subprocess

    from metrolith.__main__ import main
    from metrolith.sources.readers import measure_history

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        (tmp_path / "m.py").write_text("def f(x):\n    return x\n" * (i + 1))
        (tmp_path / "é x.py").write_bytes(b"y = '\xff'\n")
        run("add", ".")
        run("commit", "-qm", f"c{i}")
    rows = measure_history(spark, str(tmp_path), ["ast"]).orderBy("revision_index", "path").collect()
    assert [(r.revision_index, r.path, r.functiondef_count__ast) for r in rows] == [(i, p, n) for i in range(3) for p, n in (("m.py", i + 1), ("é x.py", 0))]
    assert main(["history", str(tmp_path), "--engines", "ast", "--trend", "functiondef_count__ast", "--how", "sum", "--csv", str(tmp_path / "out")]) == 0
    got = spark.read.option("header", True).csv(str(tmp_path / "out" / "metrolith_history")).orderBy("revision_index").collect()
    assert [int(r.value) for r in got] == [1, 2, 3]


def test_one_parse_a_text(spark, monkeypatch):
    """All engines of a fragment read one parse."""
    from metrolith.operators import measure as M

    calls = []
    real = K.ast.parse
    monkeypatch.setattr(K.ast, "parse", lambda c: calls.append(c) or real(c))
    kernels = {e: (k, [f.name for f in t]) for e, (k, t) in M._KERNELS.items()} | {"functions": (K.function_rows, None)}
    codes = [f"def f{i}(x):\n    return x + {i}\n" for i in range(200)]
    made = [M._one(kernels, c) for c in codes]
    assert len(calls) == 200 and all(m["valid"] and not any(m[e]["failure"] for e in kernels) for m in made)


def test_like_functions_are_not_compared():
    import time

    code = "".join(f"def f{i}(a, b):\n    total = 0\n    for x in b:\n        if x > {i}:\n            total += a * x\n    return total\n" for i in range(1500))
    t = time.process_time()
    s = K.structure(code)
    assert (s["clone_count"], s["clone_pairs"], s["clone_groups"]) == (1500, 1500 * 1499 // 2, 1) and len(K.function_rows(code)) == 1500
    assert time.process_time() - t < 30


FAKE = """#!{python}
import sys, time
if "--version" in sys.argv:
    print("{name} 3.1.4")
elif "pylint" in "{name}":
    print("C:C0114\\nW:W0611\\nE:E0602\\n\\nYour code has been rated at -2.50/10")
else:
    text = open(sys.argv[-1]).read()
    if "slow" in text:
        time.sleep(60)
    print('{{"messages": [{{"source": "pylint", "isFixable": true}}, {{"source": "pyflakes"}}, {{"source": "pylint"}}]}}')
"""


def test_programs_are_engines(spark, tmp_path, monkeypatch):
    import os
    import sys

    from metrolith.kernels import programs as P

    made = measure(from_strings(spark, {"a": "x = 1\n"}), ["lint"]).metrics().first()
    assert made["pylint_score__lint"] is None  # the program isn't here
    for name in ("pylint", "prospector"):
        (tmp_path / name).write_text(FAKE.format(python=sys.executable, name=name))
        (tmp_path / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert P.ENGINES["lint"].probe() == (str(tmp_path / "pylint"), "3.1.4")
    assert P.ENGINES["lint"].kernel("x") == {"pylint_score": -2.5, "pylint_convention": 1, "pylint_refactor": 0, "pylint_warning": 1, "pylint_error": 1}
    got = P.ENGINES["linters"].kernel("x")
    assert (got["prospector_messages"], got["prospector_fixable"], got["prospector_tools_reporting"], got["prospector_pylint"], got["prospector_dodgy"]) == (3, 1, 2, 2, 0)
    monkeypatch.setattr(P.ENGINES["linters"], "seconds", 0.5)
    with pytest.raises(TimeoutError):
        P.ENGINES["linters"].kernel("slow")


def test_bounded_runs():
    import sys
    import time

    from metrolith.kernels.programs import CUT, bounded

    t = time.monotonic()
    late = bounded([sys.executable, "-c", "import subprocess, time; subprocess.Popen(['sleep', '60']); time.sleep(60)"], seconds=1)
    assert late.timed_out and not late.ok and time.monotonic() - t < 20
    much = bounded([sys.executable, "-c", "print('x' * 30_000_000)"], kept=1000)
    assert much.ok and much.cut and len(much.out) == 1000 + len(CUT)
    assert not bounded([sys.executable, "-c", "bytearray(1 << 33)"], memory=1 << 30).ok
    assert bounded(["/nowhere/at/all"]).code is None
    assert bounded([sys.executable, "-c", "print(input())"], given="hé\n").out == "hé\n"


def test_streamed_folder(spark, tmp_path):
    from metrolith.streaming.fragments import stream_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("def f():\n    return 1\n")
    q = stream_folder(spark, str(tmp_path / "in"), ["ast"]).select("fragment_id", "functiondef_count__ast").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.functiondef_count__ast for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_command_line(tmp_path, capsys, spark):
    from metrolith.__main__ import main

    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    assert main(["analyse", str(tmp_path / "a.py"), str(tmp_path), "--engines", "ast", "--parquet", str(tmp_path / "out"), "--summary"]) == 0
    assert {r.fragment_id for r in spark.read.parquet(str(tmp_path / "out" / "metrolith_metrics")).collect()} == {str(tmp_path / "a.py")}
    import json

    assert json.loads((tmp_path / "out" / "metrolith_provenance.json").read_text())["inputs"]["fragment_count"] >= 1
    assert main(["analyse", str(tmp_path), "--engines", "nope"]) == 2 and "unknown" in capsys.readouterr().err
    assert main(["catalogue", "--write", str(tmp_path / "c.md")]) == 0 and "| Column |" in (tmp_path / "c.md").read_text()
    assert main(["doctor", "--json"]) == 0


def test_engines_of_the_user(spark, monkeypatch):
    from metrolith.operators import measure as M

    monkeypatch.setattr(M, "_USER", {})
    M.register_engine("mine", [("size", "i")], lambda code: {"size": len(code), "undeclared": 1})
    f = M.measure(from_strings(spark, {"a": "x = 1\n", "b": "("}), ["ast"])
    assert {r.fragment_id: r.size__mine for r in f.metrics().collect()} == {"a": 6, "b": None}
    assert {r.fragment_id: r.value for r in f.value("total_nodes", "ast").collect()} == {"a": 5, "b": None}
    assert [r.fragment_id for r in f.head(1).collect()] == ["a"]
    with pytest.raises(ValueError):
        f.value("nope", "ast")


def test_exact_medians(spark):
    import random
    from statistics import median

    random.seed(1)
    rows = [(float(random.randint(0, 9)), random.random() if i % 3 else None, None) for i in range(301)]
    got = {r.metric: r.median for r in T.medians(spark.createDataFrame(rows, "a double, b double, c double"), {"x": "a", "y": "b", "z": "c"}).collect()}
    assert got == {"x": median(r[0] for r in rows), "y": median(r[1] for r in rows if r[1] is not None)}


def test_embedding_by_a_model(spark):
    import numpy as np

    from metrolith.operators import embed as E

    def load():
        def encode(texts, most):
            n = min(most, max(map(len, texts)))
            states, mask = np.full((len(texts), n, 3), 99.0), np.zeros((len(texts), n))
            for i, t in enumerate(texts):
                k = min(len(t), n)
                states[i, :k] = np.array([ord(c) for c in t[:k]])[:, None] * [1, 2, 3]
                mask[i, :k] = 1
            return states, mask

        return encode

    E.register_model("letters", 4, load)
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(["ab", "", None, "c" * 600] + ["z"] * 30)], "fragment_id string, code string")
    got = {r.fragment_id: (r.dim_0, r.dim_1, r.dim_3) for r in E.embedding_frame(d, "letters").collect()}
    assert len(got) == 34 and got["0"] == (97.5, 195.0, 0.0) and got["1"] == got["2"] == (32.0, 64.0, 0.0) and got["3"][0] == 99.0 and got["33"][0] == 122.0
    with pytest.raises(ValueError):
        E.embed(d, "nope")


def test_equal_texts_of_a_batch_are_measured_once(spark):
    import pyarrow as pa

    from metrolith.operators.measure import L, _struct, fused

    seen = []
    run = fused({"n": (lambda code: seen.append(code) or {"n": len(code)}, _struct(n=L))}).func
    got = run(pa.array(["x = 1\n", None, "(", "x = 1\n", "y = 20\n", None, ""])).to_pylist()
    assert [(r["valid"], r["n"]["values"]) for r in got] == [(True, {"n": 6}), (False, None), (False, None), (True, {"n": 6}), (True, {"n": 7}), (False, None), (False, None)]
    assert seen == ["x = 1\n", "y = 20\n"]
    assert len(run(pa.array([], pa.string()))) == 0


def test_functions_are_measured_in_one_pass(spark):
    f = measure(spark.createDataFrame([("a", "def f(x):\n    if x:\n        return 1\n"), ("b", "x = 1\n"), ("c", "(")], "fragment_id string, code string").repartition(2), ["token", "cognitive"])
    for df in (f.functions(), f.degradations(), f.metrics().where("function_count__token > 0")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.engine: r for r in f.functions().collect()}
    assert f.functions().count() == 2 and f.functions().columns == "fragment_id engine name start_line end_line nloc token_count param_count cyclomatic_complexity max_nesting_depth halstead_volume halstead_difficulty cognitive_complexity".split()
    assert (got["token"].cyclomatic_complexity, got["token"].cognitive_complexity, got["token"].end_line) == (2, None, 3)
    assert (got["cognitive"].cyclomatic_complexity, got["cognitive"].cognitive_complexity, got["cognitive"].end_line, got["cognitive"].halstead_volume) == (None, 1, None, None)


def test_columns_of_an_engine_are_built_once(spark, monkeypatch):
    from metrolith.operators import measure as M

    built, values = [], M._values
    monkeypatch.setattr(M, "_values", lambda e: built.append(e) or values(e))
    frame = measure(from_strings(spark, {"a": "x = 1\n"}), include_optional=True)
    assert frame.metrics().columns[: len(S.IDENTITY)] == list(S.IDENTITY)
    assert sorted(built) == sorted(S.DEFAULT)


def test_function_rollup_joins_nothing(spark, tmp_path):
    """A key that is there twice counts twice, as in SQL; the table is read once and nothing is broadcast."""
    from metrolith.queries import q_function_rollup

    spark.createDataFrame([(1, 4), (1, 5), (2, 5)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = q_function_rollup(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(0, 1, 1.0, 1), (1, 2, 2.0, 2)]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_children_of_a_node_are_found_once(monkeypatch):
    code = "class A(B):\n    def f(self, x):\n        for y in x:\n            if y and x:\n                return self.g(y)\n    def g(self, x):\n        return [z for z in x]\n"
    looked, real, lines = [], K.ast.iter_child_nodes, []
    monkeypatch.setattr(K.ast, "iter_child_nodes", lambda n: looked.append(n) or real(n))
    whole = K._lines
    monkeypatch.setattr(K, "_lines", lambda s: lines.append(s) or whole(s))
    nodes = len(K.source(code).nodes)
    assert len(looked) == nodes
    for kernel in (K.five_op, K.token, K.tree, K.lexical, K.whole_cognitive, K.structure, K.unused, K.security, K.function_rows):
        kernel(code)
    assert len(looked) <= nodes + 1 and len(lines) == 1  # one: the module without its functions, which is made anew


def test_points_of_a_function_are_counted_once(monkeypatch):
    code, seen, real = "def g(x):\n    if x:\n        return 1\ndef h(y):\n    return y\nprint(g(1))\n", [], K.cognitive
    monkeypatch.setattr(K, "cognitive", lambda n: seen.append(getattr(n, "name", "")) or real(n))
    assert K.whole_cognitive(code) == {"cognitive_complexity": 1, "points": [1, 0]}
    assert [r["cognitive_complexity"] for r in K.function_rows(code)] == [1, 0]
    assert sorted(seen) == ["", "g", "h"]
