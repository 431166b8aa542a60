"""Parsers of text sources: diffs, headings, requirements, SQL references, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, line) with 1-based numbers."""
    return texts.select(key, F.posexplode(F.split(column, "\n")).alias("at", "line")).withColumn("at", F.col("at") + 1)


def parse_diffs(texts: DataFrame, key: str = "id", column: str = "diff") -> DataFrame:
    """(key, path, status, new_start, new_end) of each hunk of unified diffs
    without context; a file without hunks has nulls; a hunk that only removes
    counts as its line."""
    rows = lines(texts, key, column)
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("file", F.sum(F.startswith("line", F.lit("diff --git ")).cast("int")).over(before)).filter("file > 0")
    head = rows.groupBy(key, "file").agg(
        F.max(F.when(F.startswith("line", F.lit("diff --git ")), F.regexp_extract("line", " b/(.*)$", 1))).alias("path"),
        F.when(F.max(F.startswith("line", F.lit("new file")).cast("int")) == 1, "added").when(F.max(F.startswith("line", F.lit("deleted file")).cast("int")) == 1, "deleted").when(F.max(F.startswith("line", F.lit("rename to")).cast("int")) == 1, "renamed").otherwise("modified").alias("status"),
    )
    mark = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    hunks = rows.filter(F.col("line").rlike(mark)).select(key, "file", F.regexp_extract("line", mark, 1).cast("bigint").alias("new_start"), F.regexp_extract("line", mark, 2).alias("n"))
    count = F.when(F.col("n") == "", 1).otherwise(F.expr("try_cast(n as bigint)"))
    hunks = hunks.withColumn("new_end", F.col("new_start") + F.greatest(count, F.lit(1)) - 1).drop("n")
    return head.join(hunks, [key, "file"], "left").select(key, "path", "status", "new_start", "new_end")


def unfenced(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, line, last): the lines outside fences, with the number of the text's last line."""
    rows = lines(texts, key, column)
    fences = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(Window.partitionBy(key).orderBy("at"))
    rows = rows.withColumn("fences", fences).withColumn("last", F.max("at").over(Window.partitionBy(key)))
    return rows.filter("fences % 2 = 0").drop("fences")


def headings(texts: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """(key, at, level, title, end_at) of Markdown headings outside fences; a
    section ends before the next heading that is not deeper, or at the end."""
    by = Window.partitionBy(key).orderBy("at")
    h = unfenced(texts, key, column).filter(F.col("line").rlike(r"^#{1,6}\s+\S"))
    h = h.select(key, "at", "last", F.char_length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.regexp_replace(F.regexp_extract("line", r"(?s)^#+\s+(.*?)\s*#*\s*$", 1), r"\s+$", "").alias("title"))
    end = F.lit(None).cast("int")
    for k in range(6, 0, -1):
        end = F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("at"))).over(by.rowsBetween(1, Window.unboundedFollowing)) - 1).otherwise(end)
    return h.withColumn("end_at", F.coalesce(end, F.col("last"))).drop("last")


def requirements(texts: DataFrame, key: str = "path", column: str = "text") -> DataFrame:
    """(key, requirement, title, relation, target) of ``# REQ-1 Title`` blocks with
    ``- docs|implementations|tests: a, b`` lists; fences are inert."""
    h = headings(texts, key, column).filter(F.col("title").rlike(r"^[A-Z][A-Z0-9]*-\d+"))
    h = h.select(key, F.col("at").alias("top"), "end_at", F.regexp_extract("title", r"^(\S+)", 1).alias("requirement"), F.regexp_extract("title", r"^\S+\s*(.*)$", 1).alias("title"))
    item = r"(?s)^\s*[-*]\s*(docs|implementations?|tests?)\s*:\s*(\S.*?)\s*$"
    refs = unfenced(texts, key, column).filter(F.col("line").rlike(item))
    refs = refs.select(key, "at", F.regexp_extract("line", item, 1).alias("word"), F.explode(F.split(F.regexp_extract("line", item, 2), r"\s*,\s*")).alias("target"))
    relation = F.when(F.col("word") == "docs", "documents").when(F.startswith("word", F.lit("impl")), "declares_implementation").otherwise("declares_verification")
    joined = h.alias("h").join(refs.alias("r"), (F.col(f"h.{key}") == F.col(f"r.{key}")) & (F.col("at") > F.col("top")) & (F.col("at") <= F.col("end_at")))
    return joined.select(F.col(f"h.{key}").alias(key), "requirement", "title", relation.alias("relation"), F.trim("target").alias("target"))


def sql_table_refs(sql: Column) -> Column:
    """Tables that a statement names after from, join, update, into; without those of its WITH."""
    text = F.lower(F.regexp_replace(sql, r"(?i)on\s+duplicate\s+key\s+update", " "))
    named = F.regexp_extract_all(text, F.lit(r"\b(?:from|join|update|into)\s+[`\"]?([a-z_][a-z0-9_.]*)"), F.lit(1))
    local = F.regexp_extract_all(text, F.lit(r"(?:\bwith|,)\s+([a-z_][a-z0-9_]*)\s+as\s*\("), F.lit(1))
    return F.array_except(F.array_distinct(named), local)


def inline_refs(line: Column) -> Column:
    """Inline code of a line of prose, classified: path, file, symbol, or none."""
    spans = F.regexp_extract_all(line, F.lit("`([^`]+)`"), F.lit(1))
    kind = lambda s: F.when(s.rlike(r"^[\w.-]+(/[\w.-]+)+$"), "path").when(s.rlike(r"^[\w-]+\.[A-Za-z]{1,5}$"), "file").when(s.rlike(r"^[A-Za-z_]\w*((::|\.|#)[A-Za-z_]\w*)*(\(\))?$"), "symbol").otherwise("none")
    return F.transform(spans, lambda s: F.struct(s.alias("ref"), kind(s).alias("kind")))


def json_keys(body: Column) -> Column:
    """Keys that code reads from JSON: ``x['k']`` and ``.get("k"``."""
    return F.regexp_extract_all(body, F.lit(r"""(?:\[|\.get\()\s*['"]([\w.-]+)['"]"""), F.lit(1))


def json_reads(body: Column) -> Column:
    """(key, default) of each read from JSON: ``x['k']`` has none, ``.get("k", d)`` may."""
    rule = r"""\[\s*['"]([\w.-]+)['"]\s*\]|\.get\(\s*['"]([\w.-]+)['"]\s*(?:,\s*([^()]*?)\s*)?\)"""
    each = F.regexp_extract_all(body, F.lit(rule), F.lit(0))
    part = lambda x, i: F.nullif(F.regexp_extract(x, rule, i), F.lit(""))
    return F.transform(each, lambda x: F.struct(F.coalesce(part(x, 1), part(x, 2)).alias("key"), part(x, 3).alias("default")))


def http_routes(line: Column) -> Column:
    """(verb, path) of a line that declares an HTTP route in a common framework."""
    verb = F.upper(F.regexp_extract(line, r"""(?i)[.@](?:\w+\.)?(get|post|put|delete|patch)(?:Mapping)?\s*\(\s*['"]""", 1))
    path = F.regexp_extract(line, r"""(?i)[.@](?:\w+\.)?(?:get|post|put|delete|patch)(?:Mapping)?\s*\(\s*['"]([^'"]*)""", 1)
    return F.when(verb != "", F.struct(verb.alias("verb"), path.alias("path")))


#: Words that begin a constraint of a table, not a column.
CONSTRAINTS = ["PRIMARY", "FOREIGN", "UNIQUE", "KEY", "CONSTRAINT", "INDEX", "CHECK", "EXCLUDE"]


def table_columns(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, table, position, name, definition) of the columns that CREATE TABLE
    statements declare; parentheses inside a definition may nest once."""
    head = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\(((?:[^()]|\([^()]*\))*)\)"
    found = texts.select(key, F.arrays_zip(F.regexp_extract_all(column, F.lit(head), F.lit(1)).alias("t"), F.regexp_extract_all(column, F.lit(head), F.lit(2)).alias("b")).alias("z"))
    found = found.select(key, F.explode("z").alias("z")).select(key, F.col("z.t").alias("table"), F.col("z.b").alias("body"))
    pieces = F.split(F.regexp_replace("body", r",(?![^()]*\))(?=(?:[^']*'[^']*')*[^']*$)", "\u0001"), "\u0001")
    piece = found.select(key, "table", F.posexplode(F.filter(F.transform(pieces, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")).alias("at", "piece"))
    first = F.regexp_replace(F.regexp_extract("piece", r"^(\S+)", 1), "[`\"\\[\\]]", "")
    rows = piece.select(key, "table", "at", first.alias("name"), F.regexp_extract("piece", r"^\S+\s*(.*)$", 1).alias("definition"))
    rows = rows.filter((F.col("name") != "") & ~F.upper("name").isin(CONSTRAINTS))
    place = F.row_number().over(Window.partitionBy(key, "table").orderBy("at"))
    return rows.select(key, "table", place.alias("position"), "name", "definition")


def mapper_statements(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, namespace, id, verb, sql) of the statements of XML mappers, with the
    fragments that they include put in (fragments may include others)."""
    body = F.regexp_replace(column, r'(?s)<include\s+refid="([^"]*)"\s*(?:/>|>\s*</include>)', '<include refid="$1"/>')
    fragment = r'(?s)<sql\s+[^>]*?id="([^"]*)"[^>]*>(.*?)</sql>'
    verb = r'(?s)<(select|insert|update|delete)\s+[^>]*?id="([^"]*)"[^>]*>(.*?)</\1>'
    each = lambda rule, i: F.regexp_extract_all("body", F.lit(rule), F.lit(i))
    rows = texts.filter(F.lower(column).contains("<mapper")).select(key, F.regexp_extract(column, r'<mapper[^>]*?namespace="([^"]*)"', 1).alias("namespace"), body.alias("body"))
    rows = rows.select(key, "namespace", F.arrays_zip(each(fragment, 1).alias("i"), each(fragment, 2).alias("s")).alias("parts"), F.explode(F.arrays_zip(each(verb, 1).alias("verb"), each(verb, 2).alias("id"), each(verb, 3).alias("sql"))).alias("x"))
    put = lambda sql: F.aggregate("parts", sql, lambda b, f: F.replace(b, F.concat(F.lit('<include refid="'), f["i"], F.lit('"/>')), f["s"]))
    return rows.select(key, "namespace", F.col("x.id").alias("id"), F.col("x.verb").alias("verb"), F.trim(F.regexp_replace(put(put(F.col("x.sql"))), r"\s+", " ")).alias("sql"))


def consumed_route(line: Column) -> Column:
    """(verb, path) of a client's call in a line, if any: what varies in the path is ``:param``."""
    call = r"""\w\.(get|post|put|delete|patch)(?:<[^>]*>)?\s*\(\s*['"](/[^'"]*)['"]"""
    path = F.regexp_replace(F.regexp_extract(line, call, 2), "[?#].*$", "")
    path = F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(F.contains(s, F.lit("$")), ":param").otherwise(s)), "/")
    return F.when(line.rlike(call), F.struct(F.upper(F.regexp_extract(line, call, 1)).alias("verb"), path.alias("path")))


def links_manifest(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, requirement, relation, target) of a manifest: requirements, under each
    docs, implementations, tests, with targets as ``- item`` lines or ``[a, b]``."""
    rows = lines(texts, key, column).filter(~F.col("line").rlike(r"^\s*(#.*)?$"))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda rule, when: F.last(F.when(when, F.regexp_extract("line", rule, 1)), ignorenulls=True).over(upto)
    top, name, part = r"^(\w+):", r"^  ['\"]?([^\s'\":]+)['\"]?:\s*$", r"^    (docs|implementations?|tests?):"
    rows = rows.withColumn("top", last(top, F.col("line").rlike(top))).withColumn("requirement", last(name, F.col("line").rlike(name)))
    rows = rows.withColumn("word", last(part, F.col("line").rlike(part))).filter("top = 'requirements' and requirement is not null")
    inline = F.regexp_extract("line", r"^    \w+:\s*\[(.*)\]\s*$", 1)
    items = F.when(inline != "", F.split(inline, r"\s*,\s*")).when(F.col("line").rlike(r"^\s+-\s+\S"), F.array(F.regexp_extract("line", r"^\s+-\s+(.*?)\s*$", 1)))
    out = rows.select(key, "requirement", "word", F.explode(items).alias("target")).filter("word is not null")
    relation = F.when(F.col("word") == "docs", "documents").when(F.startswith("word", F.lit("impl")), "declares_implementation").otherwise("declares_verification")
    return out.select(key, "requirement", relation.alias("relation"), F.regexp_replace(F.trim("target"), "^['\"]|['\"]$", "").alias("target"))


def port_map(texts: DataFrame, column: str) -> DataFrame:
    """(key, alias) of lines ``name: other``; comments and blank lines don't count."""
    rows = texts.select(F.explode(F.split(column, "\n")).alias("line")).filter(F.col("line").rlike(r"^\s*[^#\s:][^:]*:\s*\S"))
    clean = lambda i: F.regexp_replace(F.trim(F.regexp_extract("line", r"^\s*([^:]+?)\s*:\s*(.*?)\s*$", i)), "^['\"]|['\"]$", "")
    return rows.select(clean(1).alias("key"), clean(2).alias("alias"))


#: What a line of comment begins with; lines of code that begin with # all the same.
COMMENTS = ["//", "--", "/*", "*", '"""', "@"]
DIRECTIVES = ["include", "define", "undef", "if", "ifdef", "ifndef", "elif", "else", "endif", "pragma", "error", "line", "import"]


def is_comment(line: Column) -> Column:
    text = F.ltrim(line)
    own = F.startswith(text, F.lit("#")) & ~text.rlike(r"^#\s*(" + "|".join(DIRECTIVES) + r")\b")
    for mark in COMMENTS:
        own = own | F.startswith(text, F.lit(mark))
    return own


def span(all_lines: Column, start: Column, end: Column, most_lines: int = 40, most_bytes: int = 8000, comments: bool = True) -> Column:
    """The lines ``start`` to ``end`` (from 1, cut at the text's end), with up to
    ``most_lines`` of comment right above them, up to ``most_bytes`` on a character's edge."""
    first = F.greatest(start, F.lit(1)).cast("int")
    if comments:
        above = F.reverse(F.slice(all_lines, F.greatest(first - most_lines, F.lit(1)), F.least(first - 1, F.lit(most_lines))))
        run = F.aggregate(above, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & is_comment(x)).cast("int")).alias("n"), (a["on"] & is_comment(x)).alias("on")))["n"]
        first = first - F.coalesce(run, F.lit(0))
    text = F.array_join(F.slice(all_lines, first, F.greatest(F.least(end.cast("int"), F.size(all_lines)) - first + 1, F.lit(0))), "\n")
    cut = F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), 1, most_bytes), "UTF-8"), "\uFFFD+$", "")
    return F.when(F.octet_length(text) > most_bytes, cut).otherwise(text)
