"""Custom rule scan and signature prefilter.

Both catalogs are small configuration tables, so every pattern becomes a
literal ``rlike`` in one projection: the pattern is compiled once per task and
the scan needs no join. Substring tests are far cheaper than regular expressions
and replace them where the result is the same: a rule whose pattern is a list of
plain words is tested word by word in the lower-cased text, and a rule with a
guard runs its pattern only where one of the texts every match must contain is
present.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.functions import url

URI, ARGS, NAMES, BODY, AGENT, TYPE = "uri", "args", "arg_names", "body", "agent", "content_type"
TARGETS = (URI, ARGS, NAMES, BODY, AGENT, TYPE)
CRITICAL_WEIGHT = 5
# No rule pattern matches this character (the only ``.`` is applied to the URI), so texts
# joined by it match exactly when one of them does.
SEPARATOR = "\u0001"
CHUNK = 200


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    description: str
    targets: tuple[str, ...]
    pattern: str
    guard: tuple[str, ...] = ()
    literal: bool = False
    words: tuple[str, ...] = ()
    word_guard: tuple[str, ...] = ()

    def all_patterns(self) -> tuple[str, ...]:
        return (self.pattern,)


# The custom rule catalog.
RULES = [
    Rule("990001", "LFI", "Custom LFI Protection: etc/passwd access denied", (URI,), "/etc/passwd", literal=True),
    Rule("990002", "LFI", "Custom LFI Protection: etc/shadow access denied", (URI,), "/etc/shadow", literal=True),
    Rule("990003", "LFI", "Custom LFI Protection: Windows System32 access denied", (URI,), r"windows[\\/]system32"),
    Rule("990004", "CMDi", "Custom CMDi Protection: Backtick operator detected", (ARGS,), "`", literal=True),
    Rule("990005", "RCE", "Custom Log4Shell Protection: JNDI in User-Agent", (AGENT,), "${jndi:", literal=True),
    Rule("990006", "Protocol", "Custom Protocol Protection: CRLF Injection detected", (ARGS,), "\r\n", literal=True),
    Rule("990007", "XXE", "Custom XXE Protection: DTD/Entity detected in body", (TYPE,), "xml", literal=True),
    Rule("990008", "NoSQLi", "Custom NoSQLi Protection: MongoDB operator detected", (NAMES, ARGS, BODY),
         r"\$(?:gt|lt|ne|eq|in|nin|where)", ("$",)),
    Rule("990009", "NoSQLi", "Custom NoSQLi Protection: URI based NoSQLi detected", (URI,),
         r"(?i)(?:%20|\s|\+)+(?:or|and)(?:%20|\s|\+)+'.*==", ("==",)),
    Rule("990010", "NoSQLi", "Custom NoSQLi Protection: $where operator detected", (URI, NAMES, ARGS),
         "$where", literal=True),
    Rule("990011", "SSTI", "Custom SSTI Protection: Handlebars Template markers detected", (ARGS, URI),
         "{{", literal=True),
    Rule("990012", "SSTI", "Custom SSTI Protection: EL/JEXL Template markers detected", (ARGS, URI),
         "${", literal=True),
    Rule("990020", "SQLi", "Custom SQLi Protection: SQL keyword detected", (ARGS,),
         r"(?i)(?:union|select|insert|update|delete|drop|create|alter|truncate|exec|execute|xp_)",
         words=("union", "select", "insert", "update", "delete", "drop", "create", "alter", "truncate", "exec", "xp_")),
    Rule("990021", "SQLi", "Custom SQLi Protection: SQL keyword in URI detected", (URI,),
         r"(?i)(?:union|select|insert|update|delete|drop|create|alter|truncate)",
         words=("union", "select", "insert", "update", "delete", "drop", "create", "alter", "truncate")),
    Rule("990022", "SQLi", "Custom SQLi Protection: SQL phrase detected", (ARGS,),
         r"(?i)(?:union\s+select|select\s+from|insert\s+into|delete\s+from|drop\s+table)",
         word_guard=("select", "insert", "delete", "drop")),
    Rule("990023", "SQLi", "Custom SQLi Protection: OR/AND 1=1 detected", (ARGS,),
         r"(?i)(?:or\s+1\s*=\s*1|and\s+1\s*=\s*1|'?\s*=\s*'?|1\s*=\s*1)", ("=",)),
    Rule("990024", "SQLi", "Custom SQLi Protection: Time-based SQL injection detected", (ARGS,),
         r"(?i)(?:sleep\s*\(|benchmark\s*\(|waitfor\s+delay)", word_guard=("sleep", "benchmark", "waitfor")),
    Rule("990030", "XSS", "Custom XSS Protection: HTML tag detected", (ARGS,),
         r"(?i)<script|<\/script|<iframe|<object|<embed|<applet", ("<",),
         words=("<script", "</script", "<iframe", "<object", "<embed", "<applet")),
    Rule("990031", "XSS", "Custom XSS Protection: Event handler detected", (ARGS,), r"(?i)on\w+\s*=", ("=",)),
    Rule("990032", "XSS", "Custom XSS Protection: javascript: URI detected", (ARGS,), r"(?i)javascript:", (":",),
         words=("javascript:",)),
    Rule("990033", "XSS", "Custom XSS Protection: JS function detected", (ARGS,),
         r"(?i)alert\s*\(|prompt\s*\(|confirm\s*\(", ("(",), word_guard=("alert", "prompt", "confirm")),
    Rule("990040", "CMDi", "Custom CMDi Protection: Pipe command detected", (ARGS,),
         r"(?i)\|\s*whoami|\|\s*cat|\|\s*ls|\|\s*dir|\|\s*rm|\|\s*cp", ("|",)),
    Rule("990041", "CMDi", "Custom CMDi Protection: Command injection chars detected", (ARGS,),
         r"(?i)(?:;\s*rm\s+|\$\(|`)", (";", "$(", "`")),
    Rule("990042", "CMDi", "Custom CMDi Protection: Shell command in URI", (URI,),
         r"(?i)(?:\&|\||\;)\s*(?:whoami|cat|ls|dir|rm|cp|mv|chmod|chown)", ("&", "|", ";")),
    Rule("990050", "SSRF", "Custom SSRF Protection: URL scheme detected", (ARGS,),
         r"(?i)http[s]?://|ftp://|file://|gopher://", ("://",),
         words=("http://", "https://", "ftp://", "file://", "gopher://")),
    Rule("990051", "SSRF", "Custom SSRF Protection: Localhost/internal IP detected", (ARGS,),
         r"(?i)localhost|127\.0\.0\.1|0\.0\.0\.0|169\.254\.169\.254",
         words=("localhost", "127.0.0.1", "0.0.0.0", "169.254.169.254")),
]

RULE_CATALOG = "id string, category string, description string, enabled boolean, target string, pattern string"


def rule_catalog(spark: SparkSession) -> DataFrame:
    rows = [(r.id, r.category, r.description, True, "|".join(r.targets), r.pattern) for r in RULES]
    return spark.createDataFrame(rows, RULE_CATALOG)


def rule_targets(df: DataFrame) -> DataFrame:
    """Add one ``_t_*`` text and its lower-case form ``_l_*`` per rule target to a request table."""
    headers = F.col("headers")
    uri, body = F.coalesce("uri", F.lit("")), F.coalesce("body", F.lit(""))

    def header(name: str) -> Column:
        hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
        return F.coalesce(F.when(F.size(hits) > 0, F.element_at(hits, 1)["value"]), F.lit(""))

    is_form = F.lower(F.col(f"_t_{TYPE}")).contains("application/x-www-form-urlencoded")
    pairs = F.concat(
        url.param_pairs(url.query_of(uri)),
        url.param_pairs(F.when(is_form, body).otherwise("")),
    )
    return (
        df.withColumns({f"_t_{AGENT}": header("user-agent"), f"_t_{TYPE}": header("content-type")})
        .withColumn("_pairs", pairs)
        .withColumns(
            {
                f"_t_{URI}": uri,
                f"_t_{BODY}": body,
                f"_t_{ARGS}": F.array_join(F.transform("_pairs", lambda p: p["v"]), SEPARATOR),
                f"_t_{NAMES}": F.array_join(F.transform("_pairs", lambda p: p["k"]), SEPARATOR),
            }
        )
        .drop("_pairs")
        .withColumns({f"_l_{n}": F.lower(f"_t_{n}") for n in TARGETS})
    )


def _any(target: Column, texts: tuple[str, ...]) -> Column:
    found = target.contains(texts[0])
    for text in texts[1:]:
        found = found | target.contains(text)
    return found


def _test(target: Column, lower: Column, rule: Rule | Signature) -> Column:
    """Whether the rule matches a text, given the text and its lower-case form."""
    if rule.words:
        hit = _any(lower, rule.words)
        return _any(target, rule.guard) & hit if rule.guard else hit
    hit = None
    for pattern in rule.all_patterns():
        one = target.contains(pattern) if rule.literal else target.rlike(pattern)
        hit = one if hit is None else hit | one
    if rule.word_guard:
        hit = _any(lower, rule.word_guard) & hit
    return _any(target, rule.guard) & hit if rule.guard else hit


def _matches(rule: Rule) -> Column:
    out = None
    for name in rule.targets:
        one = _test(F.col(f"_t_{name}"), F.col(f"_l_{name}"), rule)
        out = one if out is None else out | one
    return out


def scan_rules(df: DataFrame, disabled: Iterable[str] = (), weight: int = CRITICAL_WEIGHT) -> DataFrame:
    """Add ``rule_hits`` (ids in catalog order) and ``rule_score`` to a request table."""
    off = set(disabled)
    hits = F.array_compact(F.array(*[F.when(_matches(r), r.id) for r in RULES if r.id not in off]))
    scanned = rule_targets(df).withColumn("rule_hits", hits)
    names = [f"_{kind}_{n}" for n in TARGETS for kind in "tl"]
    return scanned.drop(*names).withColumn("rule_score", (F.size("rule_hits") * weight).cast("double"))


# ---- signatures ------------------------------------------------------------


@dataclass(frozen=True)
class Signature:
    """Patterns of which any may match; words and guards are optional shortcuts as for rules."""

    id: str
    patterns: tuple[str, ...]
    name: str = ""
    category: str = ""
    severity: str = ""
    description: str = ""
    guard: tuple[str, ...] = ()
    literal: bool = False
    words: tuple[str, ...] = ()
    word_guard: tuple[str, ...] = ()

    def all_patterns(self) -> tuple[str, ...]:
        return self.patterns


def default_signatures() -> list[Signature]:
    """The rule catalog as signatures over the whole request text."""
    return [
        Signature(r.id, (r.pattern,), r.description, r.category, "CRITICAL", "", r.guard, r.literal, r.words, r.word_guard)
        for r in RULES
    ]


def request_text(method: Column, uri: Column, body: Column, headers: Column) -> Column:
    """Method, URI, body and header values (key order) except user agent and cookie."""
    kept = F.filter(
        F.array_sort(F.map_entries(headers)), lambda e: ~F.lower(e["key"]).isin("user-agent", "cookie")
    )
    values = F.transform(kept, lambda e: e["value"])
    parts = F.concat(F.array(method, uri, body), F.coalesce(values, F.array().cast("array<string>")))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), " ")


def matched_signatures(text: Column, lower: Column, signatures: list[Signature]) -> Column:
    """Ids of the signatures with a matching pattern, in catalog order."""
    active = [s for s in signatures if s.patterns]
    chunks = [
        F.array_compact(F.array(*[F.when(_test(text, lower, s), s.id) for s in active[i : i + CHUNK]]))
        for i in range(0, len(active), CHUNK)
    ]
    if not chunks:
        return F.array().cast("array<string>")
    return F.concat(*chunks) if len(chunks) > 1 else chunks[0]


def prefilter(df: DataFrame, signatures: list[Signature]) -> DataFrame:
    """Add ``matched_signatures`` to a request table."""
    text = request_text(*[F.col(c) for c in ("method", "uri", "body", "headers")])
    return (
        df.withColumn("_text", text)
        .withColumn("_lower", F.lower("_text"))
        .withColumn("matched_signatures", matched_signatures(F.col("_text"), F.col("_lower"), signatures))
        .drop("_text", "_lower")
    )
