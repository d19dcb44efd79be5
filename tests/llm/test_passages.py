"""op11 against a plain search for repeated strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import passages
from tidemark.llm.queries import op11_passages

DATA = "/root/testdata/sf0.001"


def plain(rows, length):
    """Per row (id or None, bytes): its removed runs."""
    first = {}
    for i, text in rows:
        for p in range(len(text) - length + 1):
            s = text[p:p + length]
            first[s] = min(first.get(s, (2, 0)), (i is None, i or 0))
    out = []
    for i, text in rows:
        runs = []
        for p in range(len(text) - length + 1):
            if first[text[p:p + length]] < (i is None, i or 0):
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        out.append([tuple(r) for r in runs])
    return out


def key(row):
    return tuple(map(str, row))


def compare(spark, rows, length, **sizes):
    docs = spark.createDataFrame([(i, t.decode("utf-8") if t is not None else None, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))
           for r in passages.remove_repeats(docs.repartition(3), length, keep=["doc_id", "kept"], **sizes).collect()]
    want = []
    for (i, text), runs in zip(rows, plain([(i, t or b"") for i, t in rows], length), strict=True):
        text, kept, at = text or b"", b"", 0
        for a, b in runs:
            kept, at = kept + text[at:a], b
        want.append((i, len(text), runs, kept + text[at:]))
    assert sorted(got, key=key) == sorted(want, key=key)


def corpus(seed, letters, n=40):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice(letters) for _ in range(k))
    base, rows = say(400), []
    for i in range(n):
        a = rng.randrange(350)
        rows.append((i % 30, (say(rng.randrange(80)) + base[a:a + rng.randrange(120)] + say(rng.randrange(40))).encode()))
    rows += [(100, None), (101, b""), (102, b"a" * 700), (103, b"a" * 90), (None, base.encode()), (None, base.encode()), (7, base[:60].encode())]
    return rows + rows[:3]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop", "aéß中"])
@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 400, "part_bytes": 300}, {"batch_bytes": 500, "part_bytes": 300, "least_docs": 4}])
def test_passages_match_a_plain_search(spark, letters, sizes):
    compare(spark, corpus(len(letters), letters), 20, **sizes)


def test_passages_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 1000)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    compare(spark, [(1, text.encode()), (2, (text[500:20_000] + "zz" + text[20_001:]).encode()), (3, b"x" * 10_000), (4, b"x" * 9_000)], 50, batch_bytes=9_000, part_bytes=5_000)


def test_documents_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, (r.text or "").encode()) for r in rows]
    runs = plain(rows, 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op11_passages(spark, DATA).collect()}
    assert len(got) == len(rows)
    for (i, text), spans in zip(rows, runs, strict=True):
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        assert got[i] == (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_nothing_to_remove(no_docs, odd_docs):
    assert passages.remove_repeats(no_docs).count() == 0
    out = passages.remove_repeats(odd_docs)
    assert out.count() == odd_docs.count() and out.columns == [*(c for c in odd_docs.columns if c != "kept"), "n_bytes", "spans", "kept"]
    with pytest.raises(ValueError):
        passages.remove_repeats(odd_docs, 10)


def test_intervals_come_from_the_transform():
    """Ends by backward extension are where sorted contexts differ."""
    rng = np.random.default_rng(4)
    for letters, length in ((2, 20), (5, 30), (200, 20)):
        text = np.concatenate([rng.integers(0, letters, 500).astype(np.uint8)] * 2 + [np.zeros(100, np.uint8)])
        order = passages.context_order(text, length)
        around = np.concatenate([text, text]).tobytes()
        contexts = [around[p:p + length] for p in order.tolist()]
        assert contexts == sorted(contexts)
        want = [True] + [a != b for a, b in zip(contexts, contexts[1:], strict=False)]
        assert passages.interval_ends(text[order - 1], length).tolist() == want


def test_frequent_hashes_are_a_hint_only(spark):
    docs = spark.createDataFrame([(i, "the same long line in all of these documents, word for word " * 2 + str(i)) for i in range(50)], "doc_id long, text string")
    plain_docs = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    assert len(passages.frequent(plain_docs, 50, 50, 40)) and not len(passages.frequent(plain_docs, 50, 50, 51))
