"""Quality rules with host verdicts, in DataFrame functions alone.

Each text is measured against rules. Rule failures are summed by host, the hosts' failure
rates are shrunk with a beta prior fitted to all hosts by moments, and the verdict of a host
is joined back to its documents. A document goes if it fails a base rule, or if it fails a
soft rule on a host whose shrunk rate is above ``host_rate``; other documents stay.

Defined cases: a null text counts as empty (no words: rejected); a null host is the host
``""``; rows are judged one by one, so repeated rows and null ids get a row each; a share or
rate on its threshold passes, as only what lies above fails; an empty table gives an empty
table; a very long text is measured whole, in its row; other columns are passed through,
whatever their names (but for the prefix ``__quality_``), and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, staged

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOL_SHARE = 0.10
DUP_LINE_SHARE = 0.30
HOST_RATE = 0.5
PREFIX = "__quality_"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _window_hashes(words: Column, n: Column) -> Column:
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs again; called for texts that have such windows."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def twins(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        hit = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["p"]))
        return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

    def union(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        )

    return let(let(placed, twins), union)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns __quality_<count> and __quality_base_failed."""
    p = PREFIX
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    trimmed = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WS}+"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = docs.withColumns({f"{p}words": words, f"{p}lines": lines})
    out = out.withColumns({f"{p}n_words": F.size(f"{p}words").cast("bigint"), f"{p}hashes": _window_hashes(F.col(f"{p}words"), F.size(f"{p}words"))})
    repeats = F.size(F.array_distinct(f"{p}hashes")) < F.size(f"{p}hashes")
    out = out.withColumns(
        {
            f"{p}word_chars": F.length(F.regexp_replace(t, f"{WS}+", "")).cast("bigint"),
            f"{p}n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint"),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("bigint"),
            f"{p}n_repeat_words": F.when(repeats, _covered(F.col(f"{p}hashes"))).otherwise(F.lit(0)).cast("bigint"),
        }
    ).drop(f"{p}words", f"{p}hashes")
    n = F.col(f"{p}n_words")
    failed = (n < MIN_WORDS) | (F.lit(100) * F.col(f"{p}n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * n)
    soft = (F.col(f"{p}n_symbols") > SYMBOL_SHARE * F.col(f"{p}word_chars")) | (F.col(f"{p}n_dup_lines") > DUP_LINE_SHARE * F.size(f"{p}lines"))
    return out.withColumns({f"{p}base_failed": failed, f"{p}soft_failed": soft}).drop(f"{p}lines")


def _host(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))


def host_verdicts(flags: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(__quality_host, __quality_rate, __quality_bad) from rows with a host and a failed flag.

    The prior's mean m is the share of failures over all hosts' documents and its strength s
    comes from the variance of the hosts' rates: s = m(1-m)/v - 1, at least 1. The two moments
    are sums over hosts: one row, whatever the number of hosts.
    """
    p = PREFIX
    hosts = staged(flags.groupBy(f"{p}host").agg(F.count("*").alias("n"), F.count_if(f"{p}failed").alias("f")), "hosts")
    x = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.var_pop(F.col("f") / F.col("n")).alias("v")).first()
    m = (x["f"] / x["n"]) if x["n"] else 0.0
    s = max(1.0, m * (1 - m) / x["v"] - 1) if x["n"] and x["v"] else 1.0
    rate = (F.col("f") + F.lit(m * s)) / (F.col("n") + F.lit(s))
    return hosts.select(f"{p}host", rate.alias(f"{p}rate"), (rate > host_rate).alias(f"{p}bad"))


def judged(docs: DataFrame, text: str = "text", host: str = "source", host_rate: float = HOST_RATE, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with their measures, __quality_rate and __quality_kept; ``keep`` names the columns to keep, by default all.

    The texts are measured once: the rows go to the shared folder with their measures, as
    the hosts' verdicts need them all.
    """
    p = PREFIX
    rows = measured(docs, text).withColumn(f"{p}host", _host(host))
    names = docs.columns if keep is None else keep
    rows = staged(rows.select(*[F.col(f"`{c}`") for c in names], *[c for c in rows.columns if c.startswith(p)]), "measures")
    flags = rows.select(f"{p}host", (F.col(f"{p}base_failed") | F.col(f"{p}soft_failed")).alias(f"{p}failed"))
    # Written out, so its size is known: Spark broadcasts it if small and else joins by shuffle.
    verdicts = staged(host_verdicts(flags, host_rate), "verdicts")
    out = rows.join(verdicts, f"{p}host", "left")
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & ~(F.col(f"{p}bad") & F.col(f"{p}soft_failed")))


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    return judged(docs, text, host).filter(f"{PREFIX}kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, base_failed, kept, host_rate."""
    p = PREFIX
    out = judged(docs.select("doc_id", "text", "source"), keep=["doc_id"])
    return out.select("doc_id", *[F.col(p + c).alias(c) for c in COUNTS], F.col(f"{p}base_failed").alias("base_failed"), F.col(f"{p}kept").alias("kept"), F.round(f"{p}rate", 9).alias("host_rate"))
