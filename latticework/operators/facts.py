"""Behaviour of symbol bodies: counts, signals of impurity, suggested tests, roles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.lexers import without_noise

# Words that count for each kind of behaviour.
WORDS = {
    "branches": ["if", "elif", "elsif", "switch", "case", "when", "guard", "match"],
    "loops": ["for", "while", "loop", "repeat", "foreach", "forEach"],
    "early_returns": ["return"],
    "throws": ["throw", "raise", "panic", "fatalError", "abort", "unreachable"],
    "catches": ["catch", "except", "rescue", "recover"],
    "null_checks": ["null", "nil", "None", "undefined"],
    "awaits": ["await"],
}
RUST_THROWS = ["unwrap", "expect"]
COMPARISONS = r"==|!=|<=|>=| < | > "
# What betrays each kind of side effect, as it stands in code; words stand alone.
SIGNAL_WORDS = {
    "async": ["await", "async", "Future", "Promise", "Deferred"],
    "randomness": ["random", "Random", "rand", "shuffle", "uuid", "UUID"],
    "global_mutation": ["global"],
}
SIGNAL_TEXTS = {
    "io": ["print(", "println", "eprintln", "fmt.Print", "console.log", "fopen", "fwrite", "fread", "File(", "open(", ".read(", ".write(", "readFile", "writeFile", "std::fs", "fs::", "fs.", "ioutil", "os.Open", "http", "fetch(", "axios", "reqwest", "dio", "sqlite", "execute(", ".query(", "prepare(", "localStorage", "getenv", "std::env", "malloc(", "calloc(", "URLSession", "Socket", "SharedPreferences", "UserDefaults", "ModelContext", "ModelContainer", "NSManagedObjectContext", "DynamicLibrary"],
    "ui": ["setState", "WidgetCenter", "UIView", "NSView", "Scaffold", "some View", ".draw(", "render(", "runApp(", "UIApplication", "NSApplication"],
    "time": ["DateTime.now", ".now(", "SystemTime", "Instant::now", "currentTimeMillis", "time.Now", "Date.now", "Clock"],
    "randomness": ["Math.random"],
    "global_mutation": ["static mut", "setenv"],
}


def _signal(name: str) -> str:
    words = [rf"\b{re.escape(w)}\b" for w in SIGNAL_WORDS.get(name, [])]
    return "|".join(words + [re.escape(t) for t in SIGNAL_TEXTS.get(name, [])])


def _count(words: list[str]) -> Column:
    return F.size(F.filter("_tokens", lambda t: t.isin(words)))


def symbol_facts(bodies: DataFrame, body: str = "body", rust: Column | None = None) -> DataFrame:
    """Bodies with their counts, ``impurity`` (signals, sorted) and ``purity``
    (unknown without a body). Comments and strings don't count; where ``rust``
    holds, what may panic counts as a throw."""
    text = F.col("_text")
    rows = bodies.withColumn("_text", without_noise(F.coalesce(F.col(body), F.lit(""))))
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    rows = rows.withColumn("_tokens", tokens)
    for name, words in WORDS.items():
        rows = rows.withColumn(name, _count(words))
    if rust is not None:
        rows = rows.withColumn("throws", F.col("throws") + F.when(rust, _count(RUST_THROWS)).otherwise(0))
    rows = rows.withColumn("comparisons", F.regexp_count(text, F.lit(COMPARISONS)))
    rows = rows.withColumn("null_checks", F.col("null_checks") + F.regexp_count(text, F.lit(r"\?\?|\?\.")))
    signals = F.array_compact(F.array(*[F.when(text.rlike(_signal(s)), F.lit(s)) for s in sorted({*SIGNAL_WORDS, *SIGNAL_TEXTS})]))
    rows = rows.withColumn("impurity", signals)
    purity = F.when(F.trim(F.coalesce(F.col(body), F.lit(""))) == "", "unknown").when(F.size("impurity") == 0, "pure").otherwise("impure")
    return rows.withColumn("purity", purity).drop("_text", "_tokens")


def suggest_tests(facts: DataFrame) -> DataFrame:
    """(id, suggestion, priority): a table of rules over the facts."""
    rules: list[tuple[str, int, Column]] = [
        ("smoke", 1, F.lit(True)),
        ("branch", 2, F.col("branches") > 0),
        ("boundary", 2, F.col("comparisons") > 0),
        ("null", 2, F.col("null_checks") > 0),
        ("error", 1, F.col("throws") > 0),
        ("loop", 3, F.col("loops") > 0),
        ("purity", 3, F.col("purity") == "pure"),
        ("dependency", 2, F.col("purity") == "impure"),
    ]
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("suggestion"), F.lit(p).alias("priority"))) for n, p, test in rules]))
    return facts.select("id", F.explode(each).alias("s")).select("id", "s.*")


def framework_role(decorator: Column) -> Column:
    """The role family of a Python decorator (without ``@``); none: null."""
    head = F.regexp_replace(F.regexp_extract(decorator, r"^([\w.]+)", 1), r"^self\.", "")
    verb = r"^(app|router|api|api_router|\w+_router)\.(get|post|put|delete|patch|head|options|websocket|api_route)$"
    table = [
        ("fastapi_route", head.rlike(verb)),
        ("flask_route", head.rlike(r"^(app|bp|blueprint|router)\.route$")),
        ("django_view", head.isin("require_http_methods", "login_required", "permission_required", "csrf_exempt", "require_POST", "require_GET")),
        ("background_task", head.rlike(r"^(app|celery|celery_app)\.task$") | head.isin("shared_task", "job", "rq.job", "actor", "dramatiq.actor")),
        ("cli_command", head.isin("click.command", "click.group") | head.rlike(r"^(app|cli|typer_app)\.(command|callback)$")),
        ("event_handler", head.isin("app.on_event", "router.on_event")),
        ("asgi_infrastructure", head.rlike(r"^(app|router)\.(exception_handler|middleware)$")),
        ("sqlalchemy_event", head.isin("event.listens_for", "listens_for")),
        ("pydantic_validator", head.isin("validator", "field_validator", "model_validator", "root_validator")),
        ("data_class", head.isin("dataclass", "dataclasses.dataclass", "attr.s", "attrs.define", "define")),
    ]
    return reduce(lambda c, r: c.when(r[1], r[0]), table[1:], F.when(table[0][1], table[0][0]))
