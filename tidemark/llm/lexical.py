"""Ranked lexical search as exact inner-product search in ball trees of sparse vectors.

A score is an inner product: a document's component at a term is an integer of the term's share in it, a query's is the term's
weight times its repeats. Only terms of the queries matter, so a document's vector holds those alone. Every task cuts its
documents into blocks and builds a ball tree over each: a node has the centroid of its vectors and a radius around it, so no
document below it scores more than ``q . centroid + |q| * radius``. For each query the nodes are opened best bound first, and
the search of a block ends at the first bound below the score of the k-th best found so far in the task. Bounds are rounded
up by more than floating point can lose; scores are 64-bit integers.

Each task hands on its k best per query, so little is shuffled. Queries are taken in blocks of at most ``TERMS`` different
terms against all documents.

Null and empty texts have no term; they score nothing and don't count. A document that scores 0 isn't returned. Rows of equal
doc_id are documents of their own; rows without one rank after the others of equal score. Equal queries under one item_id are
one. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_from, small_batches, text_of
from tidemark.session import stage

#: Different query terms of a block of queries at most; a block's tables travel to the tasks (some 100 kB).
TERMS = 8_192
#: Documents of a tree and of a leaf at most.
TREE, LEAF = 4_096, 32
#: A bound is raised by this share and by one: far more than the rounding of its sums.
SAFE = 1e-9
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """ASCII letters and digits, A-Z lower-cased, and all other characters beyond ASCII, in runs."""
    return text.encode("utf-8").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def components(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The documents' vector components: ``tf`` of terms in documents of ``size`` terms."""
    m = 75 + 25 * size * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """Ball tree over sparse vectors ``(row, term, value)`` of ``n`` documents; ``values`` are positive integers."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF):
        order = np.argsort(row, kind="stable")
        self.term, self.value = term[order], value[order]
        self.start = np.searchsorted(row[order], np.arange(n + 1))
        self.names, self.at = np.unique(self.term, return_inverse=True)
        self.real = self.value.astype(np.float64)
        self.norm = np.add.reduceat(np.append(self.real ** 2, 0.0), np.minimum(self.start[:-1], len(self.real))) * (np.diff(self.start) > 0)
        self.centers, self.radii, self.below = [], [], []  # below: two children, or the rows of a leaf
        self._grow(np.arange(n), leaf)
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)
        self.dense: dict[int, np.ndarray] = {}

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of ``rows`` are, and the place of each entry's row in ``rows``."""
        length = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(length)
        return np.repeat(self.start[rows] - ends + length, length) + np.arange(ends[-1]), np.repeat(np.arange(len(rows)), length)

    def _distances(self, rows: np.ndarray, entry: np.ndarray, owner: np.ndarray, point: np.ndarray) -> np.ndarray:
        dot = np.bincount(owner, self.real[entry] * point[self.at[entry]], len(rows))
        square = float(point @ point)
        # what cancels is bounded by the terms of the sum, so the square is raised by a share of those
        return np.sqrt(np.maximum(self.norm[rows] - 2 * dot + square, 0) + SAFE * (self.norm[rows] + 2 * np.abs(dot) + square))

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        entry, owner = self._entries(rows)
        center = np.bincount(self.at[entry], self.real[entry], len(self.names)) / len(rows)
        far = self._distances(rows, entry, owner, center)
        node = len(self.radii)
        self.centers.append(center)
        self.radii.append(float(far.max()) * (1 + SAFE))
        self.below.append(rows)
        if len(rows) <= leaf:
            return node
        one = self._point(rows[int(far.argmax())])
        from_one = self._distances(rows, entry, owner, one)
        from_two = self._distances(rows, entry, owner, self._point(rows[int(from_one.argmax())]))
        order = np.argsort(from_one - from_two, kind="stable")
        near = int((from_one < from_two).sum())
        # a split that takes off little would make a deep tree: halve instead
        cut = near if len(rows) // 8 <= near <= len(rows) - len(rows) // 8 and 0 < near < len(rows) else len(rows) // 2
        self.below[node] = (self._grow(rows[order[:cut]], leaf), self._grow(rows[order[cut:]], leaf))
        return node

    def _point(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.names))
        part = slice(self.start[row], self.start[row + 1])
        out[self.at[part]] = self.real[part]
        return out

    def bounds(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Upper bounds of the scores below each node, a row per query (terms, weights)."""
        out = np.zeros((len(queries), len(self.radii)))
        for i, (terms, weights) in enumerate(queries):
            at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
            has = self.names[at] == terms
            w = weights.astype(np.float64)
            # terms which no vector of the tree has add nothing, to scores and to the query's norm alike
            dot = self.centers[:, at[has]] @ w[has]
            out[i] = (dot + math.sqrt(float(w[has] @ w[has])) * self.radii) * (1 + SAFE) + 1
        return out

    def leaf_scores(self, node: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a leaf and their exact scores."""
        rows = self.below[node]
        if node not in self.dense:
            entry, owner = self._entries(rows)
            names, column = np.unique(self.at[entry], return_inverse=True)
            grid = np.zeros((len(names), len(rows)), np.int64)
            grid[column, owner] = self.value[entry]
            self.dense[node] = (self.names[names], grid)
        names, grid = self.dense[node]
        at = np.minimum(np.searchsorted(names, terms), len(names) - 1)
        has = names[at] == terms
        return rows, weights[has] @ grid[at[has]]


class Best:
    """The ``k`` best of each query: highest score first, ties to the smaller place, an order of the documents' ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.found = k, [[] for _ in range(queries)]

    def bar(self, query: int) -> int:
        """A score below this one can't be among the best."""
        heap = self.found[query]
        return heap[0][0] if len(heap) == self.k else 1

    def add(self, query: int, score: int, key: tuple) -> None:
        heap, item = self.found[query], (score, *key)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)


def search(tree: Tree, queries: list[tuple[np.ndarray, np.ndarray]], keys: list[tuple], best: Best) -> int:
    """Take the tree's documents into ``best``; how many leaves were opened. Larger ``keys`` win among equal scores."""
    bounds, opened = tree.bounds(queries), 0
    for q, (terms, weights) in enumerate(queries):
        ahead = [(-bounds[q, 0], 0)]
        while ahead:
            bound, node = heapq.heappop(ahead)
            if -bound < best.bar(q):
                break
            below = tree.below[node]
            if isinstance(below, tuple):
                for child in below:
                    heapq.heappush(ahead, (-bounds[q, child], child))
                continue
            opened += 1
            rows, scores = tree.leaf_scores(node, terms, weights)
            for i in np.flatnonzero(scores >= best.bar(q)).tolist():
                best.add(q, int(scores[i]), keys[rows[i]])
    return opened


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, size, terms, tfs``: the number of terms of each text, and places and counts of those in the vocabulary."""

    def make_step():
        place = {t: i for i, t in enumerate(vocabulary)}

        def step(texts) -> dict:
            size, terms, tfs = [], [], []
            for text in texts.to_pylist():
                all_ = terms_of(text)
                found = Counter(filter(None.__ne__, map(place.get, all_)))
                size.append(len(all_))
                terms.append(list(found))
                tfs.append(list(found.values()))
            return {"size": size, "terms": terms, "tfs": tfs}

        return step

    return add_from(docs, text_of(), make_step, "size long, terms array<int>, tfs array<int>", ["doc_id"])


def blocks(items: DataFrame, limit: int = TERMS) -> Iterator[list[tuple]]:
    """Blocks of queries ``(item_id, Counter of terms)`` that have at most ``limit`` different terms, or are one query."""
    block, seen = [], set()
    for item_id, text in items.select("item_id", text_of()).distinct().orderBy("item_id").toLocalIterator():
        terms = Counter(terms_of(text))
        if not terms:
            continue
        if block and len(seen | terms.keys()) > limit:
            yield block
            block, seen = [], set()
        block.append((item_id, terms))
        seen |= terms.keys()
    if block:
        yield block


def block_hits(docs: DataFrame, block: list[tuple], k: int, tree: int, leaf: int) -> DataFrame:
    """``query, doc_id, score``: the k best of each task for the queries of a block, by their place in it."""
    vocabulary = sorted({t for _, terms in block for t in terms})
    table = stage(vectors(docs, vocabulary), "vectors")
    total = table.where("size > 0").agg(F.count("*").alias("n"), F.sum("size").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 1
    # one number per term of the block
    df = dict(table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect())
    place = {t: i for i, t in enumerate(vocabulary)}
    queries = []
    for _, terms in block:
        at = sorted((place[t], n) for t, n in terms.items() if place[t] in df)
        queries.append((np.array([a for a, _ in at], np.int64), np.array([n * weight(n_docs, df[a]) for a, n in at], np.int64)))
    small_batches(docs.sparkSession)
    schema = "query int, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, count = Best(len(queries), k), [], 0

        def work() -> None:
            ids, size, terms, tfs = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
            length = np.diff(terms.offsets.to_numpy())
            owner = np.repeat(np.arange(len(ids)), length)
            value = components(tfs.flatten().to_numpy().astype(np.int64), size.to_numpy()[owner], n_docs, n_terms)
            # the smaller doc_id is the better one, none is the worst
            keys = [(0, 0) if i is None else (1, -i) for i in ids.to_pylist()]
            search(Tree(len(ids), owner, terms.flatten().to_numpy().astype(np.int64), value, leaf), queries, keys, best)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= tree:
                work()
                held, count = [], 0
        if count:
            work()
        rows = [(q, -key if named else None, score) for q, found in enumerate(best.found) for score, named, key in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()), strict=True)],
            names=["query", "doc_id", "score"])

    return table.where(F.size("terms") > 0).select("doc_id", "size", "terms", "tfs").mapInArrow(run, schema)


def rank(docs: DataFrame, items: DataFrame, k: int = 20, limit: int = TERMS, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best ``docs`` (``doc_id, text``) for each of ``items`` (``item_id, text``)."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, limit):
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query int, item_id long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        # a task hands on at most k rows per query
        top = block_hits(docs, block, k, tree, leaf).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(stage(top, "hits").join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out
