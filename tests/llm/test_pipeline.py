"""The corpus pipeline against a brute-force version of its stages."""

import collections
import hashlib
import random

import numpy as np
import xxhash
from test_llm_operators import CLASHING, ITEMS, ascii_lower, benchmark_words, brute_place, brute_quality, hostile_rows, tik, words_of

import corpus_pipeline
from tidemark.llm import decontaminate

LINE = "This very line stands in many of the documents."
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "er", "ong", "il", "ou")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, near = text(30), text(400)
    texts = [text(60) for _ in range(12)] + ["", None, "too short", "ab " * 200, near, near + " " + text(1), near]
    texts += [f"{text(40)}\n{LINE}\n{text(30)}" for _ in range(5)] + [f"{text(40)} {item} {text(20)}", f"{text(30)}\n{item.upper()}"]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], [(1, item), (2, None)]


def mark(text):
    w = words_of(ascii_lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs, items):
    kept = {q[0] for q in brute_quality([(k, t, s) for k, t, _, s, _ in docs]) if q[-1]}
    texts = {k: t or "" for k, t, *_ in docs if k in kept}
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for k, t in texts.items():
        for x in t.split("\n"):
            held[key(x)].add(k)
    lost = lambda k, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and k < max(held[key(x)])
    texts = {k: "\n".join(x for x in t.split("\n") if not lost(k, x)) for k, t in texts.items()}
    lead, marks = {k: k for k in texts}, {k: mark(t) for k, t in texts.items()}
    for _ in texts:
        lead = {k: min(lead[j] for j in texts if (marks[k] ^ marks[j]).bit_count() <= 2) for k in texts}
    texts = {k: t for k, t in texts.items() if lead[k] == k}
    for _, item in items:
        own = benchmark_words(item)
        for k in [k for k in texts if own]:
            if brute_place(own, benchmark_words(texts[k]), decontaminate.allowed(len(own))):
                del texts[k]
    enc, out = tik(), []
    for k, t in texts.items():
        ids = enc.encode_ordinary(t)
        out.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_pipeline(spark, tmp_path):
    docs, items = documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(docs, items)
    assert got == want and 12 <= len(want) < len(docs)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == COLUMNS


def test_hostile_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeated and very long rows, extremes of ids, and columns whose names the stages use, too."""
    rows = [r + tuple(range(len(CLASHING))) for r in hostile_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, docs = docs.count(), spark.read.schema(docs.schema).parquet(path)
        assert 0 < docs.count() <= before, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_table_through_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
