"""op12 against filters applied one after another, op13 against a plain scoring of all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import regex

from tidemark.llm import audit, lexical

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def failures(rows, i):
    doc_id, text = rows[i][0], rows[i][1] or ""
    words = WORD.findall(text)
    copy = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(regex.findall("[A-Z]", text)) > 10 * len(text), "D": bool(regex.search("[#$%&*|]", text)), "E": copy}


def audited(rows, labels):
    marks = {}
    for i, q, t in labels:
        old = marks.get(i, (False, False))
        marks[i] = (old[0] or q == 1, old[1] or t == 1)
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs = [(failures(rows, i), marks.get(r[0], (False, False)) if r[0] is not None else (False, False)) for i, r in enumerate(rows) if (r[2] or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                total[f] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), sum(d[0][f] for d in gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                                                   sum(d[1][0] for d in hit), sum(d[1][1] for d in hit)]
                gone = gone + hit
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def test_audit_matches_filters_in_turn(spark, odd_docs):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    for i in range(200, 240):
        text = " ".join(rng.choice(["a", "Bc", "DEF", "x#", "yy", "$"] + [f"w{k}" for k in range(150 * (i % 3))]) for _ in range(rng.choice([20, 150])))
        rows += [(i, text, rng.choice(["en", "de", None])), (i + 100 * (i % 3), text, "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = audit.audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = audited(rows, labels)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got.collect()} == want


def test_audit_broadcasts_no_table_of_rows(spark, monkeypatch):
    """Small files of ids are large tables once there is a row for each prefix: the driver gathers none, by plan or at run time."""
    plans = {}

    def staged(df, label, stage=audit.stage):
        df.collect()
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(audit, "stage", staged)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', 'a#', repeat('B ', int(id div 2 % 7)), id div 2) AS text", "'en' AS lang")
    labels = spark.range(0, 400, 3).selectExpr("id AS doc_id", "int(id % 2) AS quality", "int(id % 5 = 0) AS toxic")
    assert audit.audit(docs, labels).count() == 600
    assert plans.keys() == {"measured", "documents", *(f"failing-{n}" for n in "ABCDE"), "kept", "removed"}
    assert all("isFinalPlan=true" in plans[k] for k in ("documents", "failing-E", "kept", "removed"))
    joins = {k: plans[k].partition("== Initial Plan ==")[0] for k in plans}
    assert not [k for k, plan in joins.items() if "Broadcast" in plan]
    assert all(f"], {kind}" in joins["removed"] for kind in ("LeftAnti", "LeftSemi"))


def test_audit_of_nothing(spark, no_docs):
    assert audit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# op13

def scored(rows, items, k):
    docs = [(i, Counter(TERM.findall(regex.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for i, text in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        query = Counter(TERM.findall(regex.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        found = []
        for i, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, q in query.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"limit": 3, "tree": 16, "leaf": 3}, {"tree": 7, "leaf": 1}])
def test_search_matches_plain_scoring(spark, odd_docs, sizes):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(30)] + ["Élan", "中文", "ABC", "x_y", "a-b", "été"]
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(i, " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(30)))) for i in range(300, 420)]
    rows += [(500, "t1 t2 t3"), (499, "t1 t2 t3"), (None, "t1 t2 t3"), (498, "t1 t2 t3")]
    items = [(1, "T1 t2 t2 of"), (2, "élan ABC abc 中文"), (3, None), (4, "nowhere"), (5, ""), (6, "the der t3."), (6, "the der t3."), (7, " ".join(words))]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = lexical.rank(docs, spark.createDataFrame(items, "item_id long, text string"), 5, **sizes)
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(scored(rows, items, 5), key=order)


def test_search_of_nothing(spark, no_docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.rank(no_docs, items).count() == 0
    assert lexical.rank(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    """No leaf scores more than the bounds above it; a query like one document opens few leaves."""
    rng = np.random.default_rng(8)
    n, terms = 2_000, 60
    row = np.repeat(np.arange(n), 8)
    term = np.concatenate([rng.choice(terms // 4, 8, replace=False) + (i % 4) * (terms // 4) for i in range(n)])
    value = rng.integers(1, 900_000, len(row))
    tree = lexical.Tree(n, row, term, value, 16)
    queries = [(np.sort(rng.choice(terms, 6, replace=False)), rng.integers(0, 25_000, 6)) for _ in range(20)]
    bounds = tree.bounds(queries)
    grid = np.zeros((n, terms), np.int64)
    grid[row, term] = value
    for q, (t, w) in enumerate(queries):
        def highest(node, q=q, t=t, w=w):
            below = tree.below[node]
            if isinstance(below, tuple):
                top = max(map(highest, below))
            else:
                rows, scores = tree.leaf_scores(node, t, w)
                assert (scores == grid[rows][:, t] @ w).all()
                top = int(scores.max())
            assert top <= bounds[q, node]
            return top
        highest(0)
    leaves = sum(not isinstance(b, tuple) for b in tree.below)
    one = [(np.arange(terms // 4), np.ones(terms // 4, np.int64))]
    assert lexical.search(tree, one, [(1, -i) for i in range(n)], lexical.Best(1, 5)) < leaves / 2
