"""Near-duplicate documents by circulant MinHash, with every link confirmed on the full shingle sets.

Two fixed permutations of ``DOMAIN`` positions make all coordinates of a signature: the first one scatters the
shingles, and coordinate k is the least value which the second one, shifted by k, gives to a shingle. Bands of
coordinates are the buckets in which candidates meet.

* Copies of a text are one class before anything is compared, so thousands of copies cost one row.
* In a bucket each text is compared with the least one only (a star), which is enough where all are alike. Buckets that
  the stars leave with several components are compared whole, in blocks of bounded size whose intersections are one
  matrix product; of the links found, those that join components leave the block, never its pairs.
* Components are the least label, spread by hooking and pointer jumping over the links. Nothing is collected.

Nulls and texts without a word have an empty set and no link. Fewer than five words are one shingle. Rows that repeat a
doc_id are judged one by one; rows of equal text belong to one class whatever their doc_id, also without one. A component's
id is its least doc_id; if none of its rows has one it is null. ``one_per_group`` keeps one row of each component all the same.
A text of very many shingles (the domain has 2^20 places) shares buckets with other such texts; that costs comparisons only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_from, map_batches, small, text_of
from tidemark.session import cut_lineage, stage

WORDS = 5
DOMAIN = 1 << 20
#: The chance to miss a pair whose similarity is just the one asked for, and the coordinates of a band at most.
MISS, MOST_ROWS = 3e-5, 9
#: Rows of a partition, and so of a file, in the tables of the component rounds.
PART_ROWS = 20_000
#: A mixed bucket is compared in blocks of so many classes, or of so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
SEED = 20_240_229

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], hashes: dict) -> np.ndarray:
    """The distinct 64-bit hashes of the word windows, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=SEED)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    total = h[:n] * _ODD[0]
    for i in range(1, WORDS):
        total += mix(h[i:i + n] + _ODD[i]) * _ODD[i]
    return np.unique(mix(total))


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all shifts of the second one as rows of a view."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    scatter = rng.permutation(DOMAIN).astype(np.uint32)
    order = rng.permutation(DOMAIN).astype(np.uint32)
    ring = np.concatenate([order, order[:coordinates]])
    return scatter, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(hashes: np.ndarray, scatter: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """All coordinates of the circulant MinHash of a non-empty set."""
    at = scatter[(hashes >> np.uint64(44)).astype(np.int64)]
    out = np.full(shifted.shape[1], np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, shifted[at[i:i + 2048]].min(axis=0), out=out)
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and coordinates of each, so that a pair of that similarity is missed with a chance of ``MISS`` at most."""
    s = min(max(percent, 1), 99) / 100
    # a band agrees with a chance of a sixth at least, so that some sixty do
    rows = min(MOST_ROWS, max(1, math.floor(math.log(1 / 6) / math.log(s))))
    return math.ceil(math.log(MISS) / math.log1p(-s ** rows)), rows


def bands(sig: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One signed 64-bit bucket key per band, which its number enters."""
    part = sig.reshape(count, rows).astype(np.uint64)
    key = np.arange(count, dtype=np.uint64) * _ODD[1]
    for i in range(rows):
        key = mix(key * _ODD[2] + part[:, i] + np.uint64(1))
    return key.astype(np.int64)


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, ref, key, n_shingles, bands``: the class key of the word sequence and the bucket keys of its set."""
    count, width = banding(percent)

    def make_step():
        hashes, (scatter, shifted) = _WordHashes(), permutations(count * width)

        def step(texts) -> dict:
            out = {"key": [], "n_shingles": [], "bands": []}
            for text in texts.to_pylist():
                words = words_of(text)
                s = shingles(words, hashes)
                out["key"].append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                out["n_shingles"].append(len(s))
                out["bands"].append(bands(signature(s, scatter, shifted), count, width) if len(s) else None)
            return out

        return step

    return add_from(docs, text_of(), make_step, "key binary, n_shingles long, bands array<long>", keep=["doc_id", "ref"])


def referenced(docs: DataFrame) -> DataFrame:
    """``doc_id, text, ref`` of the rows; a hash of the text is the reference."""
    return docs.select("doc_id", "text", F.xxhash64(text_of()).alias("ref"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, set`` of the wanted classes, the set as shingle hashes."""
    def make_step():
        hashes = _WordHashes()

        def step(rows: dict) -> dict:
            out = {"key": [], "set": []}
            for text, key in zip(rows["text"], rows["want"], strict=True):
                words = words_of(text)
                if xxhash.xxh3_128_digest(b" ".join(words)) != key:  # another text of the same reference
                    continue
                out["key"].append(key)
                out["set"].append(shingles(words, hashes).astype(np.int64))
            return out

        return step

    rows = referenced(docs).select("ref", text_of().alias("text")).join(
        small(wanted.select("ref", F.col("key").alias("want"))), "ref")
    # a repeated row gives its class twice
    return map_batches(rows, make_step, "key binary, set array<long>").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of class keys whose sets reach ``percent`` of Jaccard similarity."""
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in as many partitions as they fill and no more than it has."""
    return df.coalesce(max(1, math.ceil(rows / PART_ROWS)))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of the links ``a, b``: the least node it reaches.

    Each round every node hooks to its least neighbour, chains are shortened by pointer jumping until each node points to
    a root, and links between different roots form the next round. Every round halves the nodes at least. Each round's
    tables are written in as few files as its links need, whatever the session's number of shuffle partitions: every
    file of a local or shared folder costs a process that sets its mode. ``links`` is read twice.
    """
    edges = cut_lineage(packed(links.select("a", "b").where("a <> b").distinct(), links.count()))
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = ends.withColumn("label", F.col("node"))
    while rows := edges.count():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hook = cut_lineage(packed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                                  .select("node", F.least("node", "m").alias("up")), 2 * rows))
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut_lineage(packed(hook.join(above, "up").select("node", "up", "top"), 2 * rows))
            moved = not jumped.where("up <> top").isEmpty()
            hook = jumped.select("node", F.col("top").alias("up"))
            if not moved:
                break
        found = found.join(hook.withColumnRenamed("node", "label"), "label", "left").select(
            "node", F.coalesce("up", "label").alias("label"))
        up = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        edges = cut_lineage(packed(
            edges.join(up("a"), "a").join(up("b"), "b").where("a_up <> b_up")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), rows))
    return found


def stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's least class with its other classes."""
    center = buckets.groupBy("bucket").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return buckets.join(center, "bucket").where("a <> key").select("a", F.col("key").alias("b")).distinct()


def mixed(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """``key, bucket, label, size`` of the buckets that still hold several components."""
    labelled = buckets.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    spread = labelled.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return labelled.join(spread.select("bucket", "size"), "bucket").select("key", "bucket", "label", "size")


def block_links(keys: list, labels: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links between components, as few as join the same classes as all links would."""
    sizes = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[at] > 1  # what one class alone has is in no intersection
    _, at = np.unique(at[shared], return_inverse=True)
    owner = owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    for low in range(0, int(at.max(initial=-1)) + 1, 4096):
        part = order[np.searchsorted(at[order], low):np.searchsorted(at[order], low + 4096)]
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[part], at[part] - low] = 1
        both += grid @ grid.T
    a, b = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    root: dict = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(labels[i]), top(labels[j])
        if x != y:
            root[x] = y
            out.append((keys[i], keys[j]))
    return out


def residual_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` across components in the mixed buckets.

    A large bucket is cut into blocks by a hash of the key, and every pair of its blocks is one group.
    """
    rows = rest.join(sets.select("key", "set"), "key")
    total = rest.join(sets.select("key", F.size("set").alias("n")), "key").groupBy("bucket").agg(F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j")))
    grouped = (
        rows.join(total, "bucket").withColumn("blocks", blocks).withColumn("own", own)
        .select("key", "bucket", "label", "set", F.explode(pairs).alias("p")).select("key", "bucket", "label", "set", "p.i", "p.j")
    )

    def compare(table: pa.Table) -> pa.Table:
        column = table.column("set").combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        found = block_links(table.column("key").to_pylist(), table.column("label").to_pylist(),
                            [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return grouped.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, ref, n_shingles, label, component_id`` for every row; ``label`` names its component (null: an empty set)."""
    rows = stage(sketch(referenced(docs), percent), "minhash")
    classes = rows.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.min("ref").alias("ref"), F.first("bands").alias("bands"))
    # bucket rows of classes, kept because stars and leftovers both read them
    buckets = stage(classes.select("key", "ref", F.explode("bands").alias("bucket")), "buckets")
    buckets = buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "bucket")
    buckets = stage(buckets, "shared")
    sets = stage(sets_of(docs, buckets.groupBy("key").agg(F.first("ref").alias("ref"))), "sets")
    pairs = buckets.select("key", "bucket")
    links = cut_lineage(verified(stars(pairs), sets, percent))
    label = cut_lineage(components(links).withColumnRenamed("node", "key"))
    rest = cut_lineage(mixed(pairs, label))
    if not rest.isEmpty():
        more = cut_lineage(residual_links(rest, sets, percent))
        if not more.isEmpty():
            label = cut_lineage(components(links.union(more)).withColumnRenamed("node", "key"))
    reps = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    named = reps.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    # only classes with a link need their component's least doc_id looked up
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    owner = named.join(least, "label").select("key", "label", "component_id")
    return rows.select("doc_id", "ref", "key", "n_shingles").join(owner, "key", "left").drop("key")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked when their sets of five-word shingles have a Jaccard similarity of ``percent`` / 100 or more.
    The bands follow from it: a pair at 0.85 is missed with a chance of 2.6e-5 (40 bands of 9 coordinates), one at 0.80 with
    2.8e-5 (57 bands of 8).
    """
    return (
        grouped(docs, percent)
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_per_group(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group, that of the least doc_id (then text hash), and all rows without words; with their columns."""
    rows = stage(grouped(docs, percent).where("label IS NOT NULL"), "groups")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref")).alias("b"))
    won = rows.groupBy("label", "doc_id", "ref").agg(F.count("*").alias("n")).join(best, "label").withColumn(
        "won", F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("ref") == F.col("b.ref")))
    # a row that loses or occurs several times
    judged = stage(won.where("NOT won OR n > 1").select(F.col("doc_id").alias("_judged_id"), F.col("ref").alias("_judged_ref"), F.col("won").alias("_judged_won")), "copies")
    keyed = docs.withColumn("_text_hash", F.xxhash64(text_of()))
    same = F.col("doc_id").eqNullSafe(F.col("_judged_id")) & (F.col("_text_hash") == F.col("_judged_ref"))
    left = keyed.join(small(judged), same, "left_anti")
    again = judged.where("_judged_won")
    if not again.isEmpty():
        repeated = keyed.join(small(again), same, "left_semi")
        columns = [F.col(f"`{c}`") for c in docs.columns]
        one = repeated.groupBy("doc_id", "_text_hash").agg(F.first(F.struct(*columns)).alias("_row"))
        left = left.select(*columns).union(one.select("_row.*"))
    return left.select(docs.columns)
