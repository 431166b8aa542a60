"""Column expressions on paths, ids and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names of tests and of auxiliary code, suffixes of generated files.
TEST_DIRS = ["test", "tests", "testing", "integration_test", "test_driver", "__tests__", "spec", "specs"]
AUX_DIRS = ["tools", "tool", "scripts", "script", "bench", "benches", "benchmark", "benchmarks", "examples", "example", "demo", "demos", "samples", "sample", "fixtures", "playground"]
GENERATED = [".freezed.dart", ".g.dart", ".gr.dart", ".config.dart", ".mocks.dart", ".pb.dart", ".pbenum.dart", ".pbjson.dart", ".pbserver.dart", ".gen.dart", ".generated.ts", ".g.ts"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def _slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_test_path(path: Column) -> Column:
    """Test or spec scaffolding, by directory, file name, or CamelCase ``Test(s)``."""
    norm = _slashed(path)
    low = ascii_lower(norm)
    in_dir = F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_DIRS)))
    return in_dir | low.rlike(r"(^|/)test_[^/]*$|_test\.|\.test\.|\.spec\.|_spec\.") | norm.rlike(r"Tests?/|(^|/)[^/.]*Tests?(\.[^/]*)?$")


def is_auxiliary_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(ascii_lower(_slashed(path)), "/"), F.array(*map(F.lit, AUX_DIRS)))


def is_generated_path(path: Column) -> Column:
    low = ascii_lower(_slashed(path))
    return low.rlike("(" + "|".join(map(re.escape, GENERATED)) + ")$") | low.rlike(r"(^|/)app_localizations[^/]*$") | F.contains(low, F.lit("/generated/"))


def is_plain_test_path(path: Column) -> Column:
    """The narrower rule that reachability uses for helper functions."""
    return F.startswith(path, F.lit("test/")) | F.contains(path, F.lit("/test/"))


def glob_match(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the whole path (``**`` crosses directories)."""
    if not globs:
        return F.lit(False)
    one = lambda g: re.sub(r"\\\*\\\*/?", ".*", re.sub(r"(?<!\\\*)\\\*(?!\\\*)", "[^/]*", re.escape(g))).replace(r"\?", "[^/]")
    return path.rlike("^(" + "|".join(map(one, globs)) + ")$")


def label_of(node_id: Column) -> Column:
    """The last part of an id, after ``::`` and then ``#``."""
    return F.substring_index(F.substring_index(node_id, "::", -1), "#", -1)


def leaf_method(node_id: Column, trace: bool = False) -> Column:
    """The method that noise lists name: after ``#`` only, or (trace) after ``::`` as well."""
    if trace:
        return F.substring_index(label_of(node_id), ".", -1)
    return F.when(F.contains(node_id, F.lit("#")), F.substring_index(F.substring_index(node_id, "#", -1), ".", -1)).otherwise("")


def layer(kind: Column, path: Column) -> Column:
    p = F.coalesce(path, F.lit(""))
    return (
        F.when(kind == "db_table", "table")
        .when(kind == "sql_mapper_stmt", "sql")
        .when(kind == "http_route", "route")
        .when(p.rlike("Controller|/controller/"), "controller")
        .when(p.rlike("ServiceImpl|/impl/"), "service_impl")
        .when(p.rlike("Service|/service/"), "service")
        .when(p.rlike("Mapper|/mapper/|/dao/"), "mapper")
        .otherwise("other")
    )


def concrete_segments(path: Column) -> Column:
    """Lower-cased path segments without parameters and wildcards."""
    param = r"^(\{.*\}|<.*>|[:*$].*)$"
    return F.transform(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(param)), F.lower)


def route_key(path: Column, suffix: int) -> Column:
    segs = concrete_segments(path)
    last = F.when(F.size(segs) > suffix, F.slice(segs, -suffix, suffix)).otherwise(segs) if suffix else segs
    return F.array_join(last, "/")


def route_service(path: Column) -> Column:
    segs = concrete_segments(path)
    return F.when(F.size(segs) > 0, F.element_at(segs, 1)).otherwise("")


def name_key(name: Column, alnum_only: bool = False) -> Column:
    """The key of a symbol's name: without leading underscores, lower case."""
    bare = F.regexp_replace(name, r"[^\p{L}\p{N}]", "") if alnum_only else F.regexp_replace(name, "^_+", "")
    return F.lower(bare)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def slug(text: Column) -> Column:
    """ASCII slug of a heading; headings beyond ASCII get a content hash (``fnv1a64`` of the bytes) by the caller."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", "-"), "^-+", ""), "-+$", "")


def literal_kind(value: Column) -> Column:
    return (
        F.when(value.rlike(r'^".*"$') | value.rlike("^'.*'$"), "string")
        .when(value.isin("true", "false"), "bool")
        .when(value.rlike(r"^-?0[xX][0-9a-fA-F]+$"), "hex")
        .when(value.rlike(r"^-?\d+\.\d+$"), "float")
        .when(value.rlike(r"^-?\d+$"), "int")
        .otherwise("other")
    )


def is_trivial_literal(value: Column) -> Column:
    return value.isin("0", "1", "-1", "0.0", "1.0", '""', "''", "true", "false", "")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the patterns of a ``.gitignore`` at the top leave a path out: the last
    that fits decides, ``!`` takes back, a slash inside binds to the top, one at the
    end means a directory."""
    out = F.lit(False)
    for raw in patterns:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        folder, bound = line.endswith("/"), "/" in line.rstrip("/")
        steps = [{"**/": "(.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|[^*?/]+|/", line.strip("/"))]
        fits = path.rlike(("^" if bound or line.startswith("/") else "(^|/)") + "".join(steps) + ("/" if folder else "(/|$)"))
        out = F.when(fits, F.lit(not back)).otherwise(out)
    return out
