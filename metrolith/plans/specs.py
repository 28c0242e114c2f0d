"""What is measured: every metric column, declared before any text is seen.

Our engines are named for their definitions. `ALIASES` gives the customary name of the tool family that popularised
each definition; equality with any release of such a tool isn't claimed. `lint` and `linters` need external programs,
so they are declared, and null where those are absent.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = "1.0.0"
THRESHOLD = 0.10
IDENTITY = ("fragment_id", "code_sha256", "is_valid_python", "language")
ALIASES = {"five_op": "radon", "token": "lizard", "ast": "ast", "lexical": "lexical", "cognitive": "complexipy", "structure": "pyscn", "unused": "vulture", "security": "bandit", "lint": "pylint", "linters": "prospector"}
DEFAULT = ("five_op", "token", "ast", "lexical", "cognitive", "structure", "unused", "security")
OPTIONAL = ("lint", "linters")
_TYPES = {"i": LongType(), "f": DoubleType(), "b": BooleanType()}


@dataclass(frozen=True)
class MetricSpec:
    engine: str
    key: str
    kind: str  # i, f or b
    level: str  # file, function or class
    unit: str
    null: str  # invalid_input, not_applicable or unmeasured

    @property
    def column(self) -> str:
        return column_name(self.key, self.engine)

    @property
    def type(self):  # noqa: ANN201
        return _TYPES[self.kind]


# engine; then groups of "level/unit: key:kind ..."
_TABLE = """
five_op
file/lines: lloc:i sloc:i comments:i single_comments:i multi_line_comments:i blank_lines:i total_lines:i
file/paths: cyclomatic_complexity_mean:f cyclomatic_complexity_max:i cyclomatic_complexity_module:i
file/flag: cc_imputed_module_level:b
file/count: halstead_h1:i halstead_h2:i halstead_n1:i halstead_n2:i halstead_vocabulary:i halstead_calculated_length:f halstead_length:i
file/bits: halstead_volume:f
file/ratio: halstead_difficulty:f
file/bits: halstead_effort:f
file/seconds: halstead_time:f
file/count: halstead_bugs:f
file/flag: halstead_volume_is_zero:b
file/index: maintainability_index:f
file/flag: maintainability_index_saturated:b
file/code: maintainability_saturation_path:i
token
file/count: function_count:i
function/tokens: avg_token_count_mean:f avg_token_count_max:i avg_token_count_min:i
function/count: avg_param_count_mean:f avg_param_count_max:i avg_param_count_min:i
function/lines: function_length_mean:f function_length_max:i function_length_min:i
function/paths: cyclomatic_complexity_mean:f cyclomatic_complexity_max:i cyclomatic_complexity_min:i
function/levels: max_nesting_depth:i
file/lines: nloc:i
file/tokens: token_count:i
function/bits: halstead_volume:f
function/ratio: halstead_difficulty:f
function/bits: halstead_effort:f
function/count: halstead_length:i halstead_vocabulary:f halstead_h1:i halstead_h2:i halstead_n1:i halstead_n2:i
function/seconds: halstead_time:f
function/count: halstead_bugs:f
function/levels: top_nesting_level_max:i
function/tokens: function_token_length_max:i
ast
file/levels: ast_depth:i
file/count: total_nodes:i functiondef_count:i classdef_count:i return_count:i call_count:i assign_count:i comprehension_count:i try_count:i decorator_count:i
file/ratio: loop_ratio:f if_ratio:f import_ratio:f
file/count: class_count:i
class/levels: dit_max:i dit_mean:f
class/count: noc_max:i rfc_max:i rfc_mean:f methods_per_class_mean:f
file/count: base_classes_external:i operational_node_count:i
lexical
file/count: distinct_tokens:i lexical_tokens:i
file/ratio: type_token_ratio:f
file/count: distinct_identifiers:i distinct_variables:i distinct_functions_defined:i distinct_calls:i distinct_attributes:i distinct_imports:i
cognitive
file/points: cognitive_complexity:i
function/points: cognitive_complexity_mean:f cognitive_complexity_max:i cognitive_complexity_min:i
structure
class/count: cbo_mean:f cbo_max:i lcom_mean:f lcom_max:i
file/count: class_count:i
function/points: cognitive_complexity_mean:f
function/paths: cyclomatic_complexity_mean:f cyclomatic_complexity_max:i
function/levels: nesting_depth_mean:f nesting_depth_max:i
file/count: dead_code_findings:i
file/ratio: dead_code_ratio:f
file/count: clone_count:i clone_pairs:i clone_groups:i
function/ratio: clone_similarity_mean:f
file/count: clone_fragments_analysed:i function_count:i
file/lines: sloc:i lloc:i comment_lines:i docstring_lines:i
unused
file/count: dead_code_items:i dead_code_high_confidence:i
function/percent: dead_code_min_confidence:i
security
file/count: security_issues:i security_severity_low:i security_severity_medium:i security_severity_high:i security_confidence_low:i security_confidence_medium:i security_confidence_high:i
lint
file/score: pylint_score:f
file/count: pylint_convention:i pylint_refactor:i pylint_warning:i pylint_error:i
linters
file/count: prospector_messages:i prospector_fixable:i prospector_tools_reporting:i prospector_pylint:i prospector_pyflakes:i prospector_pycodestyle:i prospector_mccabe:i prospector_dodgy:i prospector_profile_validator:i
"""


def _read() -> tuple[MetricSpec, ...]:
    out, engine = [], ""
    for line in _TABLE.strip().splitlines():
        if ":" not in line:
            engine = line
            continue
        where, _, keys = line.partition(": ")
        level, unit = where.split("/")
        out += [MetricSpec(engine, *k.split(":"), level, unit, "invalid_input" if level == "file" else "not_applicable") for k in keys.split()]
    return tuple(out)


SPECS = _read()


def column_name(key: str, engine: str) -> str:
    if not engine:
        raise ValueError("a metric column names its engine")
    return f"{key}__{engine}"


def split_column(column: str) -> tuple[str, str]:
    key, _, engine = column.rpartition("__")
    return key, engine


def delta_column(key: str) -> str:
    return f"{key}__delta_ratio"


def divergent_column(key: str) -> str:
    return f"{key}__divergent"


def select_engines(names: list[str] | None = None, include_optional: bool = False) -> tuple[str, ...]:
    if names is None:
        return DEFAULT + (OPTIONAL if include_optional else ())
    known = DEFAULT + OPTIONAL
    back = {v: k for k, v in ALIASES.items()}
    got = [back.get(n, n) for n in names]
    if bad := [n for n in got if n not in known]:
        raise ValueError(f"unknown engines {bad}; there are {list(known)}")
    return tuple(got)


def specs_of(engines: tuple[str, ...]) -> list[MetricSpec]:
    return [s for e in engines for s in SPECS if s.engine == e]


def comparable_keys(engines: tuple[str, ...] | None = None) -> dict[str, list[str]]:
    """Keys that more than one engine reads, with those engines; in sorted order."""
    by = defaultdict(list)
    for s in specs_of(engines or select_engines()):
        by[s.key].append(s.engine)
    return {k: v for k, v in sorted(by.items()) if len(v) > 1}


def metric_columns(engines: tuple[str, ...]) -> list[str]:
    return [s.column for s in specs_of(engines)] + [c for k in comparable_keys(engines) for c in (delta_column(k), divergent_column(k))]


def table_schema(engines: tuple[str, ...]) -> StructType:
    fields = [StructField("fragment_id", StringType()), StructField("code_sha256", StringType()), StructField("is_valid_python", BooleanType()), StructField("language", StringType())]
    fields += [StructField(s.column, s.type, True, {"unit": s.unit, "level": s.level, "null": s.null}) for s in specs_of(engines)]
    for k in comparable_keys(engines):
        fields += [StructField(delta_column(k), DoubleType()), StructField(divergent_column(k), BooleanType())]
    return StructType(fields)


def catalogue(engines: tuple[str, ...] | None = None) -> str:
    """All columns as a Markdown table."""
    engines = engines or select_engines(include_optional=True)
    rows = [f"| `{s.column}` | {s.level} | {s.unit} | {s.kind} | {s.null} |" for s in specs_of(engines)]
    pairs = [f"| `{delta_column(k)}`, `{divergent_column(k)}` | derived | ratio, flag | f, b | nothing to compare ({', '.join(v)}) |" for k, v in comparable_keys(engines).items()]
    return "\n".join([f"# Metric catalogue, schema {SCHEMA_VERSION}", "", "| Column | Level | Unit | Type | Null means |", "|-|-|-|-|-|", *rows, *pairs, ""])
