"""Fragments from files, model responses and git history."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import code_blocks, python_blocks


def read_paths(spark: SparkSession, *paths: str) -> DataFrame:
    """(fragment_id, code): files, and all *.py below folders; bytes that aren't UTF-8 are replaced. The id is the path as
    it was asked for (without the scheme of local files). A path that isn't there raises, as Spark does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(list(paths))
    return files.select(F.regexp_replace("path", r"^file:/*(?=/)", "").alias("fragment_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("code"))


def from_strings(spark: SparkSession, fragments: dict[str, str] | list[str]) -> DataFrame:
    """Keys stay ids; without keys, the text's hash and its occurrence make one that every retry repeats."""
    if isinstance(fragments, dict):
        return spark.createDataFrame(list(fragments.items()), "fragment_id string, code string")
    import hashlib

    seen: dict[str, int] = {}
    rows = []
    for c in fragments:
        h = hashlib.sha256(c.encode()).hexdigest()
        seen[h] = seen.get(h, 0) + 1
        rows.append((h if seen[h] == 1 else f"{h}-{seen[h]}", c))
    return spark.createDataFrame(rows, "fragment_id string, code string")


def from_responses(responses: DataFrame, key: str, raw: str, python_only: bool = True) -> DataFrame:
    """(fragment_id, block_index, language, code) of the fenced blocks of each response."""
    blocks = (python_blocks if python_only else code_blocks)(F.col(raw))
    out = responses.select(F.col(key).cast("string").alias("k"), F.posexplode(blocks).alias("block_index", "b"))
    return out.select(F.concat_ws("#", "k", "block_index").alias("fragment_id"), "block_index", "b.language", "b.code")


class GitError(ValueError):
    """What git said of a folder or revision that it can't read."""


def _git(repo: str, *args: str, given: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=given, capture_output=True, timeout=60, check=False)
    if done.returncode:
        raise GitError(f"git {args[0]} in {repo}: {done.stderr.decode('utf-8', 'replace').strip()[:300]}")
    return done.stdout


def _blobs(repo: str, names: list[str]) -> list[str | None]:
    """Texts of revision:path names, in their order, from one process; null for what is no file."""
    raw, at, out = _git(repo, "cat-file", "--batch", given="".join(f"{n}\n" for n in names).encode()), 0, []
    for _ in names:
        end = raw.index(b"\n", at)
        kind, at = raw[at:end].split(b" "), end + 1
        if len(kind) == 3 and kind[1] == b"blob":
            out.append(raw[at : at + int(kind[2])].decode("utf-8", "replace"))
        else:
            out.append(None)
        if len(kind) == 3 and kind[-1].isdigit():
            at += int(kind[2]) + 1
    return out


class _Revision(InputPartition):
    def __init__(self, fields: list[str]) -> None:
        self.fields = fields


class GitReader(DataSourceReader):
    """One partition a revision; its files are read by one process, where the partition runs. A folder that is no
    repository, or a branch that isn't there, raises when the table is planned."""

    def __init__(self, options: dict) -> None:
        self.repo, self.branch = options["path"], options.get("branch", "HEAD")
        self.limit, self.every, self.files, self.suffix = int(options.get("limit", 200)), int(options.get("every", 1)), int(options.get("files", 50)), options.get("suffix", ".py")

    def partitions(self) -> list[InputPartition]:
        log = _git(self.repo, "log", f"--max-count={self.limit}", "--format=%H%x1f%aI%x1f%an%x1f%s", self.branch).decode("utf-8", "replace")
        rows = [r for line in log.splitlines() if len(r := line.split("\x1f")) == 4][:: self.every]
        return [_Revision([*r, len(rows) - 1 - i]) for i, r in enumerate(rows)]

    def read(self, partition):  # noqa: ANN001, ANN201
        sha, when, author, subject, index = partition.fields
        listed = _git(self.repo, "ls-tree", "-r", "-z", "--name-only", sha).decode("utf-8", "surrogateescape").split("\0")
        paths = sorted(p for p in listed if p.endswith(self.suffix) and "\n" not in p)[: self.files]
        for path, text in zip(paths, _blobs(self.repo, [f"{sha}:{p}" for p in paths]) if paths else [], strict=True):
            if text is not None:
                yield (sha, index, when, author, subject, path, text)


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "sha string, revision_index int, timestamp string, author string, subject string, path string, code string"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return GitReader(self.options)


def read_history(spark: SparkSession, repo: str, **options: object) -> DataFrame:
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").options(**{k: str(v) for k, v in options.items()}).load(repo)


def measure_history(spark: SparkSession, repo: str, engines: list[str] | None = None, include_optional: bool = False, **options: object) -> DataFrame:
    """A row a revision and file: its identity, then all metrics."""
    from ..operators.measure import measure

    rows = read_history(spark, repo, **options).withColumn("fragment_id", F.concat_ws(":", F.substring("sha", 1, 12), "path"))
    metrics = measure(rows.select("fragment_id", "code"), engines or (None if include_optional else ["five_op", "token", "ast", "cognitive"]), include_optional=include_optional).metrics()
    return rows.drop("code").join(metrics, "fragment_id").drop("fragment_id", "code_sha256", "language")
