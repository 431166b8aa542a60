"""Kinds of nodes and edges, their traits, and the lists that queries filter by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, kind string, path string, name string, start_line bigint, end_line bigint, content_hash string, stable_key string, source_file string, indexer string, metadata_json string"
EDGE = "id string, from_id string, to_id string, kind string, source string, certainty string, status string, confidence float, evidence_json string, source_file string, indexer string, metadata_json string"
RANGE = "file_path string, symbol_id string, start_line bigint, end_line bigint, symbol_kind string, qualified_name string, parent_symbol_id string"
SCHEMA_VERSION = 5

# The labels of node kinds, by language and family.
CALLABLE = {
    "dart": ["method", "function", "constructor"],
    "swift": ["method", "function", "initializer"],
    "go": ["method", "function"],
    "python": ["function", "method"],
    "typescript": ["function", "method"],
    "java": ["method", "constructor"],
    "rust": ["function", "method"],
    "c": ["function"],
    "cpp": ["function", "method"],
    "csharp": ["method", "function"],
    "ruby": ["method", "function"],
    "php": ["method", "function"],
    "kotlin": ["method", "function"],
}
TYPE = {
    "dart": ["class"],
    "swift": ["class", "struct", "enum", "protocol"],
    "go": ["struct", "interface"],
    "python": ["class"],
    "typescript": ["class", "interface", "enum"],
    "java": ["class", "interface", "enum"],
    "rust": ["struct", "enum", "trait", "macro"],
    "c": ["struct", "enum"],
    "cpp": ["class", "struct", "enum"],
    "csharp": ["class", "interface", "struct", "enum"],
    "ruby": ["module", "class"],
    "php": ["class", "interface", "trait", "enum"],
    "kotlin": ["class", "interface", "enum", "object"],
}
MODULE = {"python": ["module"], "typescript": ["module"], "java": ["package"], "rust": ["module"], "cpp": ["namespace"]}
SHARED = {
    "file": ("generic", "module"),
    "requirement": ("doc", "doc"),
    "acceptance_criterion": ("doc", "doc"),
    "adr": ("doc", "doc"),
    "doc_section": ("doc", "doc"),
    "test_case": ("generic", "test"),
    "test_group": ("generic", "test"),
    "dart_provider": ("dart", "framework"),
    "route": ("synthetic", "framework"),
    "storage": ("synthetic", "framework"),
    "http_route": ("synthetic", "framework"),
    "business_candidate": ("generic", "candidate"),
    "db_table": ("generic", "schema"),
    "sql_mapper_stmt": ("generic", "schema"),
}
EDGE_KINDS = ["contains", "imports", "documents", "declares_implementation", "declares_verification", "references", "calls", "reads_provider", "navigates_to", "persists_to", "subscribes_stream", "derives_from"]
SOURCES = ["filesystem", "language_adapter", "markdown", "external_manifest", "git_diff"]
CERTAINTIES, STATUSES = ["fact", "declared"], ["confirmed", "deprecated"]
SEMANTIC = ["calls", "references", "reads_provider", "navigates_to", "persists_to", "subscribes_stream"]
USAGE = [*SEMANTIC, "declares_verification"]
TRACE_KINDS = ["calls", "references", "reads_provider", "persists_to", "navigates_to", "subscribes_stream", "derives_from", "declares_implementation"]
EXPANSION_KINDS = [k for k in EDGE_KINDS if k != "imports"]
#: Languages whose kinds a search covers unless asked otherwise.
SEARCHED_LANGUAGES = ["dart", "swift", "go", "python", "typescript", "java", "rust", "c", "cpp"]
SEARCHED_SHARED = ["file", "test_case", "test_group", "route", "storage", "dart_provider", "doc_section", "business_candidate", "db_table", "sql_mapper_stmt", "http_route"]
NOISE_TARGETS = ["toString", "hashCode", "noSuchMethod", "runtimeType", "copyWith", "dispose", "initState", "build", "didChangeDependencies", "didUpdateWidget", "deactivate", "reassemble", "createState", "createElement"]
TRACE_NOISE = ["toString", "hashCode", "noSuchMethod", "runtimeType", "copyWith", "dispose", "initState", "build", "equals", "getClass", "valueOf"]


def traits() -> dict[str, tuple[str, str]]:
    """(language, family) of every kind."""
    out = dict(SHARED)
    for family, table in (("callable", CALLABLE), ("type", TYPE), ("module", MODULE)):
        out |= {f"{lang}_{k}": (lang, family) for lang, kinds in table.items() for k in kinds}
    return out


def of_family(*families: str) -> list[str]:
    return sorted(k for k, (_, f) in traits().items() if f in families)


CODE = sorted([*of_family("callable", "type"), *[f"{lang}_{k}" for lang, ks in MODULE.items() for k in ks]])
CODE_OR_TEST = sorted([*CODE, "test_case", "test_group"])
SEARCHED = sorted([*SEARCHED_SHARED, *[k for k, (lang, f) in traits().items() if lang in SEARCHED_LANGUAGES and f in ("callable", "type", "module") and k != "rust_macro"]])


def kind_traits(spark: SparkSession) -> DataFrame:
    """The 83-row dimension (kind, language, family, is_code, is_callable, is_type, is_module_or_file, is_test)."""
    rows = [(k, lang, f, k in CODE, f == "callable", f == "type", f == "module", f == "test") for k, (lang, f) in sorted(traits().items())]
    return spark.createDataFrame(rows, "kind string, language string, family string, is_code boolean, is_callable boolean, is_type boolean, is_module_or_file boolean, is_test boolean")


def unknown_kinds(nodes: DataFrame) -> DataFrame:
    """Rows whose kind is none of the known ones; reading such a table is an error."""
    return nodes.filter(~F.coalesce(F.col("kind").isin(sorted(traits())), F.lit(False)))


def confidence(value: Column) -> Column:
    """A confidence between 0 and 1: NaN counts as 1, anything else is clamped."""
    return F.when(F.isnan(value), F.lit(1.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).cast("float")


def edge_tier(kind: Column, source: Column, certainty: Column, status: Column, indexer: Column) -> Column:
    """high, medium or low, from an edge's provenance."""
    precise = F.coalesce(F.endswith(indexer, F.lit("_lsp")) | indexer.isin("dart_analyzer", "scip") | F.startswith(indexer, F.lit("scip:")), F.lit(False))
    return (
        F.when((status == "deprecated") | (kind == "derives_from") | (source == "git_diff"), "low")
        .when(kind.isin("contains", "imports"), "high")
        .when((kind == "documents") & (source == "markdown"), "high")
        .when(kind.isin("declares_implementation", "declares_verification") & (source == "external_manifest"), "high")
        .when(kind.isin(SEMANTIC) & ((certainty == "declared") | precise), "high")
        .otherwise("medium")
    )
