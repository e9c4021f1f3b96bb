"""License scan by ordered signature rules, in DataFrame functions alone.

Texts that hold one of the gate's keywords are cut to words; the rules are grouped by keyword,
and the groups whose keyword occurs are matched, which gives intervals. Intervals are taken by start, longer first, then by
priority; one that lies inside an interval taken earlier is suppressed, so the most specific
reading of a place stays. All is done within the row: there is no shuffle.

Defined cases: a null or empty text has no words, no label and score 0; rows are scanned one
by one, whatever their ids, equal rows alike; of two rules with one interval and priority the
label that comes first counts; an empty table gives an empty table; a very long text is
scanned whole, in its row; other columns pass through, whatever their names (but for the
prefix ``__license_``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_rules import rules

#: Fixed values of the contract: phrase and label.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: A text that has none of these in lower case can match neither a phrase nor a rule's keyword: parts of words that are rare elsewhere,
GATE = ["licen", "spdx", "gpl", "cddl", "eupl", "cecill", "openrail", "beerware", "wtfpl"]
#: and words, of which a rule's keyword holds one of these runs at least; all are looked for in one pass.
GATE_WORDS = [
    "advertising", "affirmer", "all rights reserved", "altered source", "any and all copyrights", "anyone is free to copy", "bsd", "cc by", "cc zero", "cc0", "commercial purposes", "confidential and proprietary", "creative commons", "dedicated the work", "distribute the modified",
    "endorse or promote", "epl", "font software", "held liable", "hosted or managed", "interacting with it", "llama", "mpl", "package may be copied", "perl itself", "permission is", "permission notice", "permission to", "polyform", "product includes software", "public domain",
    "redistribute your version", "redistribution", "redistributions", "retain this notice", "third parties as a service", "unauthorized copying", "unencumbered", "unmodified copies", "w3c", "what the fuck", "zlib",
]
_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GATE_REGEX = "(?<![a-z0-9])(?:" + "|".join(w.replace(" ", _SEP) for w in GATE_WORDS) + ")|0bsd|freebsd"
PREFIX = "__license_"


def _gate(low: Column) -> Column:
    out = F.lit(False)
    for word in GATE:
        out = out | F.contains(low, F.lit(word))
    return out | low.rlike(GATE_REGEX)


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    at = F.transform(words, lambda w, i: F.when(_follows(words, w, i, parts), i))
    return F.filter(at, lambda i: i.isNotNull())


def _finder(phrase: str):
    return lambda words: _places(words, phrase)


def _follows(words: Column, w: Column, i: Column, parts: list[str]) -> Column:
    out = w == parts[0]
    for k, part in enumerate(parts[1:], 1):
        out = out & F.coalesce(F.get(words, i + k) == part, F.lit(False))
    return out


def _rule_groups() -> Column:
    """The rules by keyword as one constant, which Spark folds when it plans."""
    groups: dict[str, list[dict]] = {}
    for r in rules():
        groups.setdefault(r.keyword, []).append({"x": r.regex, "l": r.label, "p": r.priority})
    return F.from_json(F.lit(json.dumps([{"k": k, "r": r} for k, r in groups.items()])), "array<struct<k:string,r:array<struct<x:string,l:string,p:int>>>>")


def _intervals(norm: Column, rule: Column) -> Column:
    """Where the rule matches: struct(s start, e -end, p -priority, l label), in order."""
    hits = F.regexp_extract_all(norm, rule["x"], F.lit(0))
    parts = F.split(norm, rule["x"], -1)
    steps = F.zip_with(parts, hits, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b")))
    empty = F.array().cast("array<struct<s:int,e:int,p:int,l:string>>")
    return F.aggregate(
        F.filter(steps, lambda x: x["b"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["a"] + x["b"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["a"]).alias("s"), (-(acc["at"] + x["a"] + x["b"])).alias("e"), (-rule["p"]).alias("p"), rule["l"].alias("l")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _resolved(found: Column) -> Column:
    """struct(end, covered, labels) after containment suppression in one pass."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"), F.array().cast("array<string>").alias("labels"))
    return F.aggregate(
        F.sort_array(found),
        start,
        lambda a, x: F.when(-x["e"] <= a["end"], a).otherwise(
            F.struct((-x["e"]).alias("end"), (a["covered"] - x["e"] - F.greatest(x["s"], a["end"])).alias("covered"), F.array_union(a["labels"], F.array(x["l"])).alias("labels"))
        ),
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __license_ columns: n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    p = PREFIX
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # A column of its own: the gate reads it some twenty times.
    docs = docs.withColumn(f"{p}low", F.lower(t))
    gate = _gate(F.col(f"{p}low"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    norm = F.when(gate, F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate(t, upper, lower), f"{NOT_WORD}+", " ")), F.lit(" ")))
    out = docs.withColumns({f"{p}n_words": F.regexp_count(t, F.lit(f"[^{NOT_WORD[1:-1]}]+")).cast("bigint"), f"{p}norm": norm}).drop(f"{p}low")
    norm = F.col(f"{p}norm")
    none = F.array().cast("array<int>")
    words = F.when(norm.isNotNull(), F.split(F.btrim(norm), " "))
    places = F.array(*[F.struct(F.lit(label).alias("l"), F.when(F.contains(norm, F.lit(f" {phrase} ")), let(words, _finder(phrase))).otherwise(none).alias("at")) for phrase, label in BASE])
    near = F.filter(_rule_groups(), lambda g: F.contains(norm, g["k"]))
    found = F.flatten(F.transform(F.flatten(F.transform(near, lambda g: g["r"])), lambda r: _intervals(norm, r)))
    resolved = F.when(norm.isNotNull(), _resolved(found))
    out = out.withColumns({f"{p}places": F.when(norm.isNotNull(), places), f"{p}resolved": resolved})
    at = F.coalesce(F.flatten(F.transform(F.col(f"{p}places"), lambda x: x["at"])), none)
    out = out.withColumn(f"{p}at", at)
    labels = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    base = F.transform(F.filter(F.col(f"{p}places"), lambda x: F.size(x["at"]) > 0), lambda x: x["l"])
    out = out.withColumns(
        {
            f"{p}n_base": F.size(f"{p}at").cast("bigint"),
            f"{p}first_word": F.array_min(f"{p}at").cast("bigint"),
            f"{p}last_word": F.array_max(f"{p}at").cast("bigint"),
            f"{p}base_labels": labels(base),
            f"{p}labels": labels(F.array_union(F.coalesce(base, F.array().cast("array<string>")), F.coalesce(F.col(f"{p}resolved.labels"), F.array().cast("array<string>")))),
            f"{p}score": F.coalesce(F.least(F.lit(1.0), F.col(f"{p}resolved.covered") / F.greatest(F.length(norm) - 2, F.lit(1))), F.lit(0.0)),
        }
    )
    return out.drop(f"{p}norm", f"{p}places", f"{p}resolved", f"{p}at")


def report(docs: DataFrame) -> DataFrame:
    p = PREFIX
    out = scan(docs.select("doc_id", "text"))
    plain = [F.col(p + c).alias(c) for c in ("n_words", "n_base", "first_word", "last_word")]
    return out.select("doc_id", *plain, *[F.array_join(p + c, ",").alias(c) for c in ("base_labels", "labels")], F.col(f"{p}score").alias("score"))
