"""Approximate nearest neighbours by inner product along shifted space-filling curves.

Vectors are dealt into bands of similar norm, and those of a band are turned into points of one sphere (a further coordinate
makes up for shorter ones), so that the largest inner product in a band is the nearest point. Bands of few points are one
together, which is compared whole. In each band, each of ``CURVES`` curves projects the points on ``DIMS`` directions of its own random
rotation, shifts them and orders them along a Hilbert curve. The order is cut into cells of equally many points; a query is
compared with the points of its cell and of the cells beside it, on every curve, and the finds are merged and reranked.

The window is ``WINDOW_CELLS`` cells on each side out of ``CELLS``: a share of all points, since in vectors without
structure any fixed number of neighbours on a curve loses recall as the table grows. Cells hold at most ``CELL_ROWS`` points
(larger tables get more cells, and windows of more of them).

Equal vectors are one point, with the least ids that a result can need, so copies cost nothing. Vectors that are null, zero,
of another length than most, or that hold null or non-finite numbers, take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_from
from tidemark.llm.hilbert import hilbert_keys
from tidemark.session import stage

CURVES, DIMS, BITS = 8, 6, 9
CELLS, WINDOW_CELLS = 25, 2
CELL_ROWS = 4096
LEAST_ROWS = 32
#: The norms of a band differ by this factor at most; bands outside +-``MOST_BAND`` are the outermost ones.
BAND, MOST_BAND = 1.25, 3000
#: The band of all points whose own has fewer than two cells.
FEW = MOST_BAND + 1
#: Queries of a cell that are one group; a cell of more is compared in several, each with all its points.
ASK_ROWS = 16_384
SEED = 11
#: Queries of a cell that are scored at once.
STEP = 256


def usable(vector: str) -> Column:
    """Whether the vector takes part, its length aside."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def points(vectors: DataFrame, is_query: Column, id_col: str, vector: str) -> DataFrame:
    """``id, h1, h2, v, query, norm, band`` of the vectors that take part; ``h1, h2`` name equal vectors."""
    live = vectors.where(usable(vector)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    common = live.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    live = live.where(F.size("v") == (common["n"] if common else 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # rounded, so that unit norms are amid a band
    band = F.round(F.log("norm") / math.log(BAND))
    band = F.greatest(F.lit(-MOST_BAND), F.least(F.lit(MOST_BAND), F.coalesce(band, F.lit(-MOST_BAND)))).cast("int")
    return live.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(SEED)), "norm": norm}).withColumn("band", band)


def rotations(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of all curves."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    each = [np.linalg.qr(rng.normal(size=(length, max(length, DIMS))))[0] if length >= DIMS
            else rng.normal(size=(length, DIMS)) / math.sqrt(length) for _ in range(CURVES)]
    return np.stack([r[:, :DIMS] for r in each]), rng.random((CURVES, DIMS))


def places(x: np.ndarray) -> np.ndarray:
    """Places of points on all curves, one row each; ``x`` lies on the unit sphere."""
    turn, shift = rotations(x.shape[1])
    out = np.empty((len(x), CURVES), np.int64)
    for c in range(CURVES):
        cell = (x @ turn[c] * 0.5 + 0.5 + 0.5 * shift[c]) / 1.5
        out[:, c] = hilbert_keys(np.clip(cell * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
    return out


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_places(reps: DataFrame) -> DataFrame:
    """``own`` and ``sought``: places of each vector as a candidate, on the sphere of ``radius``, and as a query of any band."""

    def make_step():
        def step(column) -> dict:
            v, radius = matrix(column.field(0)), column.field(1).to_numpy(zero_copy_only=False)
            as_point = v / np.where(radius > 0, radius, 1.0)[:, None]
            as_point = np.column_stack([as_point, np.sqrt(np.maximum(1 - (as_point * as_point).sum(axis=1), 0))])
            as_query = np.column_stack([v / np.sqrt((v * v).sum(axis=1))[:, None], np.zeros(len(v))])
            # a few bits of chance tell apart points in one place
            salt = (np.abs(v[:, 0]) * 1e9).astype(np.int64) & 127
            tie = lambda p: list((p << 7) | salt[:, None])
            return {"own": tie(places(as_point)), "sought": tie(places(as_query))}

        return step

    return add_from(reps, F.struct("v", "radius"), make_step, "own array<long>, sought array<long>")


def routed(reps: DataFrame, plans: dict[int, tuple[int, int, int]], bounds: dict[tuple[int, int], list[int]]) -> DataFrame:
    """A row per point, curve and part, and one per query, band, curve and cell of its window: ``band, curve, cell, part, ask,
    rep, v``. ``plans`` has the cells, the window and the parts of each band."""
    edges = {at: np.array(b, np.int64) for at, b in bounds.items()}
    none = np.zeros(0, np.int64)

    def make_step():
        def step(column) -> dict:
            own, sought = (column.field(i).flatten().to_numpy().reshape(-1, CURVES) for i in (0, 1))
            asks, bands, reps = (column.field(i).to_pylist() for i in (2, 3, 4))
            out = [[] for _ in asks]
            for band, (cells, window, parts) in plans.items():
                # one cell is the same on every curve
                for c in range(CURVES if cells > 1 else 1):
                    edge = edges.get((band, c), none)
                    at, to = np.searchsorted(edge, own[:, c], "right").tolist(), np.searchsorted(edge, sought[:, c], "right").tolist()
                    for i, ask in enumerate(asks):
                        if bands[i] == band:
                            out[i] += [{"band": band, "curve": c, "cell": at[i], "part": p, "ask": False} for p in range(parts)]
                        if ask:
                            out[i] += [{"band": band, "curve": c, "cell": k, "part": reps[i] * 40503 // 8 % parts, "ask": True}
                                       for k in range(max(0, to[i] - window), min(cells, to[i] + window + 1))]
            return {"to": out}

        return step

    way = add_from(reps.select("rep", "v", "own", "sought", "query", "band"), F.struct("own", "sought", "query", "band", "rep"), make_step,
                   "to array<struct<band: int, curve: int, cell: int, part: int, ask: boolean>>", ["rep", "v"])
    return way.select("rep", "v", F.explode("to").alias("t")).select("t.*", "rep", "v")


def cell_finds(table: pa.Table, count: int) -> pa.Table:
    """The best ``count`` candidates of each query in one cell."""
    ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
    v, rep = matrix(table.column("v").combine_chunks()), table.column("rep").to_numpy()
    q, c = np.flatnonzero(ask), np.flatnonzero(~ask)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(q) if len(c) else 0, STEP):
        part = q[i:i + STEP]
        scores = v[part] @ v[c].T
        n = min(count, len(c))
        best = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(part), 1))
        a, b = np.repeat(part, n), c[best.ravel()]
        # summed anew, so that a pair has one score in every cell
        got.append((rep[a], rep[b], (v[a] * v[b]).sum(axis=1)))
    columns = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("asker", "rep", "score"), columns, strict=True)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query but itself."""
    live = stage(points(vectors, is_query, id_col, vector), "points")
    reps = live.groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.first("v").alias("v"), F.max("query").alias("query"), F.first("band").alias("own_band"))
    # one row for each factor BAND between the norms
    found_bands = live.groupBy("band", "h1", "h2").agg(F.max("norm").alias("norm"), F.max("query").alias("query")).groupBy("band").agg(
        F.count("*").alias("n"), F.max("norm").alias("radius"), F.count_if("query").alias("asks")).collect()
    asks = sum(r["asks"] for r in found_bands)
    # a band too small to be cut goes to the common one
    name = {r["band"]: r["band"] if r["n"] >= 2 * LEAST_ROWS else FEW for r in found_bands}
    plans, radius = {}, {}
    for band in sorted(set(name.values())):
        members = [r for r in found_bands if name[r["band"]] == band]
        total, radius[band] = sum(r["n"] for r in members), max(r["radius"] for r in members)
        # a small band has fewer cells, the common one a single cell, which is exhaustive
        cells = 1 if band == FEW else max(CELLS, math.ceil(total / CELL_ROWS))
        cells = max(1, min(cells, total // LEAST_ROWS))
        window = math.ceil(WINDOW_CELLS * cells / CELLS)
        plans[band] = cells, window, max(1, math.ceil(asks * min(1, (2 * window + 1) / cells) / ASK_ROWS))
    table = live.sparkSession.createDataFrame(
        [(b, g, float(radius[g]), plans[g][0]) for b, g in name.items()], "own_band int, band int, radius double, cells int")
    placed = stage(with_places(reps.join(F.broadcast(table), "own_band")), "places")
    # one list of bounds per band and curve
    sizes = sorted({cells for cells, *_ in plans.values()} - {1})
    cut = placed.where("cells > 1").select("band", "cells", F.posexplode("own").alias("curve", "at")).groupBy("band", "curve").agg(
        *(F.percentile_approx(F.when(F.col("cells") == n, F.col("at")), [i / n for i in range(1, n)], 20 * n).alias(f"b{n}")
          for n in sizes)).collect() if sizes else []
    bounds = {(r["band"], r["curve"]): r[f"b{plans[r['band']][0]}"] for r in cut}
    found = routed(placed, plans, bounds).groupBy("band", "curve", "cell", "part").applyInArrow(
        lambda t: cell_finds(t, k + 1), "asker long, rep long, score double")
    itself = placed.where("query").select(F.col("rep").alias("asker"), "rep", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("score"))
    first = lambda *order: F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), *order))
    # points found on several curves count once
    best = found.union(itself).groupBy("asker", "rep").agg(F.max("score").alias("score")).withColumn(
        "_n", first("rep")).where(F.col("_n") <= k + 1).drop("_n")
    # the least ids of each point, and the queries at each point
    own = Window.partitionBy("h1", "h2").orderBy("id")
    some = live.select("h1", "h2", "id").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k + 1)
    names = placed.select("h1", "h2", "rep")
    members = some.join(names, ["h1", "h2"]).select("rep", F.col("id").alias("vec_id"))
    lists = best.join(members, "rep").withColumn("_n", first("vec_id")).where(F.col("_n") <= k + 1).groupBy("asker").agg(
        F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("l"))  # k + 1 entries
    queries = live.where("query").select("h1", "h2", F.col("id").alias("query_id")).join(names, ["h1", "h2"])
    mine = F.slice(F.filter("l", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.join(lists, F.col("rep") == F.col("asker")).select("query_id", F.posexplode(mine).alias("p", "e"))
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")
    )
