"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "cmpid"]
RESTRICTED_PHRASES = ["access denied", "verify you are human", "enable javascript and cookies", "subscribe to continue", "sign in to read", "we do not host the original article"]
SENSITIVE_KEYS = ["key", "token", "secret", "password", "authorization", "cookie", "contact"]
QUOTE_PAGES = {"finance.yahoo.com": ["/quote/", "/chart/"], "seekingalpha.com": ["/symbol/"], "barrons.com": ["/market-data/"], "nasdaq.com": ["/market-activity/"]}
WHITE = r"(?U)[\s\x1c-\x1f]+"


def known_at(available: Column, received: Column, published: Column) -> Column:
    return F.coalesce(available, received, published)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(part), part)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, no fragment; other parameters in order, encoded anew."""
    u = F.split(F.trim(url), "#")[0]
    head, query = F.split(u, r"\?", 2)[0], F.get(F.split(u, r"\?", 2), F.lit(1))
    origin = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    keep = F.filter(
        F.split(F.coalesce(query, F.lit("")), "&"),
        lambda p: (p != "") & ~F.lower(F.coalesce(F.try_url_decode(F.split(p, "=", 2)[0]), F.lit(""))).isin(TRACKING_PARAMS),
    )
    pairs = F.transform(keep, lambda p: F.concat(_encoded(F.split(p, "=", 2)[0]), F.lit("="), _encoded(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("")))))
    text = F.array_join(pairs, "&")
    return F.concat(F.lower(origin), F.substring(head, F.length(origin) + 1, F.length(head)), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def folded(text: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(text, WHITE, " ")))


def json_quoted(text: Column, upper: bool = False) -> Column:
    """The text as a JSON string: quotes, backslashes and control characters escaped, hexadecimal digits in lower case, or upper if asked."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    clean = out
    for k in range(32):
        clean = F.replace(clean, F.lit(chr(k)), F.lit(short.get(k, f"\\u{k:04X}" if upper else f"\\u{k:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), clean).otherwise(out), F.lit('"'))


def body_hash(body: Column, upper: bool = False) -> Column:
    """SHA-256 of the folded body as a JSON string, whose escapes have upper-case digits if asked; empty for no body. Bodies of white space alone are alike."""
    return F.when(F.coalesce(body, F.lit("")) == "", F.lit("")).otherwise(F.sha2(json_quoted(folded(body), upper).cast("binary"), 256))


def iso(ts: Column) -> Column:
    """ISO text with offset; microseconds only if there are any."""
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(plain), F.lit("+00:00"))


def event_id(published: Column, security_ids: Column, title: Column, url: Column) -> Column:
    text = F.concat(
        F.lit('{"published_at":'),
        F.coalesce(F.concat(F.lit('"'), iso(published), F.lit('"')), F.lit('""')),
        F.lit(',"security_ids":'),
        F.to_json(F.array_sort(security_ids)),
        F.lit(',"title":'),
        json_quoted(F.lower(stripped(title))),
        F.lit(',"url":'),
        json_quoted(canonical_url(url)),
        F.lit("}"),
    )
    return F.concat(F.lit("evt-"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def restricted(body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 4000))
    out = F.lit(False)
    for phrase in RESTRICTED_PHRASES:
        out = out | F.contains(head, F.lit(phrase))
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def excerpt(body: Column, n: int = 200) -> Column:
    return F.array_join(F.slice(words(body), 1, n), " ")


def publication_time(text: Column) -> Column:
    """A timestamp from ISO or RFC-2822 text with an explicit offset; null otherwise."""
    t = F.trim(text)
    zoned = t.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & t.rlike(r"^[0-9]{4}-")
    mail = F.regexp_replace(t, r"^[A-Za-z]{3}, *", "")
    return F.when(zoned, t.try_cast("timestamp")).otherwise(F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx"))))


def parse_time(text: Column) -> Column:
    """A timestamp; without a zone UTC, and on failure midnight of its first ten characters."""
    t = F.trim(text)
    compact = F.regexp_replace(t, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return F.coalesce(compact.try_cast("timestamp"), F.substring(compact, 1, 10).try_cast("date").cast("timestamp"))


def parse_day(text: Column) -> Column:
    return F.substring(F.replace(F.trim(text), F.lit("/"), F.lit("-")), 1, 10).try_cast("date")


def release_available(day: Column) -> Column:
    """The end of a release day in New York."""
    return F.to_utc_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:59")), "America/New_York")


def security_id(market: Column, exchange: Column, ticker: Column) -> Column:
    part = lambda c: F.replace(F.upper(F.coalesce(F.nullif(c, F.lit("")), F.lit("UNKNOWN"))), F.lit(" "), F.lit(""))
    return F.concat_ws(":", part(market), part(exchange), part(ticker))


def markdown_cell(text: Column) -> Column:
    """A table cell: a dash for nothing, no bars, line ends or tags."""
    t = F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))
    for old, new in (("|", "／"), ("\n", " "), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def safe_component(text: Column) -> Column:
    """A file name's part: other characters as one underscore, 80 at most, never empty."""
    t = F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def redacted(params: Column, keys: list[str] = SENSITIVE_KEYS) -> Column:
    """A map with the values of keys that hold one of the given words replaced."""
    hit = lambda k: F.lower(k).rlike("|".join(keys))
    return F.transform_values(params, lambda k, v: F.when(hit(k), F.lit("***")).otherwise(v))


def public_url(url: Column) -> Column:
    """An https address of another machine that is not a quote page."""
    where = r"^(?i:https)://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]+)(?::[0-9]*)?([^?#]*)"
    host, path = F.lower(F.regexp_extract(url, where, 1)), F.regexp_extract(url, where, 2)
    quote = F.lit(False)
    for domain, heads in QUOTE_PAGES.items():
        quote = quote | (host.endswith(domain) & path.rlike("^(" + "|".join(heads) + ")"))
    return F.coalesce((host != "") & ~host.isin("localhost", "127.0.0.1", "[::1]") & ~quote, F.lit(False))


def fixed(value: Column, places: int, sign: bool = False) -> Column:
    """A number with so many places, halves to the even digit, as reports print it; with a plus sign if asked."""
    text = F.bround(value.cast("decimal(38,18)"), places).cast(f"decimal(38,{places})").cast("string")
    return F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text) if sign else text


#: Names of machines that are no public hosts.
LOCAL_NAMES = ["localhost"]
LOCAL_ENDS = [".localhost", ".local", ".internal", ".lan", ".home"]
#: Address blocks that are not global, as first octets or pairs of octets.
PRIVATE = r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."


def outbound_url(url: Column) -> Column:
    """Whether an address may be fetched: https, the usual port, no user, and no host or literal address of the own network.

    Names are not looked up; whoever connects must check what they resolve to.
    """
    where = r"^(?i:https)://(\[[^\]]*\]|[^/?#:@]+)(:443)?(?:[/?#].*)?$"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, where, 1)), r"\.$", "")
    local = host.isin(LOCAL_NAMES) | host.startswith("[")
    for end in LOCAL_ENDS:
        local = local | host.endswith(end)
    literal = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return F.coalesce(url.rlike(where) & (host != "") & ~local & ~(literal & host.rlike(PRIVATE)), F.lit(False))


def loopback_url(url: Column) -> Column:
    """Whether a service's address stays on this machine: http or https, a loopback host, a port, no user and no query."""
    return F.coalesce(url.rlike(r"^(?i:https?)://(?i:localhost|127\.0\.0\.1|\[::1\]):[0-9]{1,5}(/[^?#@]*)?$"), F.lit(False))


def normal_title(text: Column) -> Column:
    """Letters, digits and underscores in lower case, all else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def session_close(day: Column, offset_hours: Column, close_hour: int = 16) -> Column:
    """When a session of a local day closes, in UTC, for a place so many hours ahead of it."""
    return F.timestamp_micros((F.unix_date(day).cast("bigint") * 24 + close_hour - offset_hours) * 3_600_000_000)


def canonical_json(columns: dict[str, Column]) -> Column:
    """A flat object as JSON with its keys in order, texts quoted alike everywhere, nulls kept."""
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))) for name, value in sorted(columns.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
