"""Byte-level BPE encoding and decoding over overlapping chunks.

A text is cut into chunks of ``CHUNK`` characters that overlap the next one by ``OVERLAP``. Each chunk is pre-tokenised
on its own. Where a chunk and its successor place a pre-token boundary at the same character, they agree from there on
(the pattern never looks behind itself), so the text is stitched there and its pieces are encoded one by one. Boundaries
near the end of a chunk, which the missing text could move, are not trusted. Chunks without a common boundary (a word or
a run of spaces longer than the overlap) are scanned again as one.

Texts of up to ``SPREAD`` characters do all this in one task. Longer ones are spread: their chunks are rows that
tasks pre-tokenise in parallel, a join of neighbouring chunks finds the stitches, and their pieces are rows again for the
encoding. Copies of a long text are encoded once. Decoding puts the bytes of the ids together.

A null text is empty and has no ids. Extra columns stay as they are; ``ids`` and ``decoded`` replace columns of that name.
"""

from __future__ import annotations

import base64
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_from, map_batches, text_of
from tidemark.session import stage

CHUNK = 16_384
OVERLAP = 256
SPREAD = 65_536
#: The pattern of contractions looks up to two characters ahead of a boundary.
AHEAD = 3


class Vocabulary:
    """Merge ranks and the pre-token pattern; travels to tasks as its file's bytes (about 1 MB)."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern = data, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines()) if a}


class Encoder:
    """Ids of texts, piece by piece; a piece is whole pre-tokens, so the library merges within the same pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, size: int = CHUNK, overlap: int = OVERLAP):
        self.split, self.size, self.overlap = regex.compile(vocabulary.pattern).findall, size, overlap
        self.library = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks(), special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        found = [self.library.encode_to_numpy(text[a:b], disallowed_special=()) for a, b in pieces(text, self.split, self.size, self.overlap)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def column(self, texts: pa.Array) -> pa.Array:
        return lists([self.encode(t) for t in texts.to_pylist()], np.int32)


class Spelling:
    """The bytes of ids, looked up in one pool."""

    def __init__(self, ranks: dict[bytes, int]):
        self.length, self.start = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, np.int64)
        at, pool = 0, []
        for word, i in ranks.items():
            self.length[i], self.start[i] = len(word), at
            at += len(word)
            pool.append(word)
        self.pool = np.frombuffer(b"".join(pool), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.pool[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def column(self, ids: pa.ListArray) -> pa.Array:
        """A binary column; the ids of some rows at a time."""
        return pa.array([self.decode(v.values.to_numpy(zero_copy_only=False)).tobytes() for v in ids], pa.binary())


def lists(arrays: list[np.ndarray], kind) -> pa.Array:
    """A list column of the arrays."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)))


def ends_of(tokens: list[str], start: int) -> list[int]:
    """Where each pre-token ends in the text."""
    return list(accumulate(map(len, tokens), initial=start))[1:]


def trusted(ends: list[int], part: str, start: int) -> list[int]:
    """The ends at which ``part``, from ``start`` on, may be cut: text after it can't move them, and the text before them
    splits alike on its own (the pattern looks past white space only)."""
    stop = start + len(part) - AHEAD
    return [e for e in ends[:-1] if e <= stop and not part[e - 1 - start].isspace()]


def pieces(text: str, split, size: int, overlap: int):
    """Where the pieces between two stitches begin and end."""
    n = len(text)
    if n <= size + overlap:
        yield 0, n
        return
    at, stop = 0, size + overlap  # the chunk in hand begins at a true boundary
    ends = ends_of(split(text[:stop]), 0)
    for start in range(size, n, size):
        if stop >= n:
            break
        own = ends_of(split(text[start:start + size + overlap]), start)
        sure = trusted(ends, text[at:stop], at)
        theirs = {start, *own}
        meet = next((e for e in sure if e >= start and e in theirs), None)
        stop = min(n, start + size + overlap)
        if meet is None:  # scan both as one, from the last boundary that is sure
            if sure:
                yield at, sure[-1]
                at = sure[-1]
            ends = ends_of(split(text[at:stop]), at)
        else:
            yield at, meet
            at, ends = meet, [e for e in own if e > meet]
    yield at, n


def encode(docs: DataFrame, vocabulary: Vocabulary, spread: int = SPREAD, size: int = CHUNK, overlap: int = OVERLAP,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``ids array<int>`` of every whole text."""
    box = docs.sparkSession.sparkContext.broadcast((vocabulary.data, vocabulary.pattern))
    names = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    length = F.coalesce(F.length("text"), F.lit(0))

    def make_step():
        encoder = Encoder(Vocabulary(*box.value), size, overlap)
        return lambda texts: {"ids": encoder.column(texts)}

    done = add_from(docs.where(length <= spread), text_of(), make_step, "ids array<int>", names)
    plain = docs.where(length > spread).select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), text_of().alias("x"))
    long = spread_encode(plain, box, size, overlap)
    return done.unionByName(long.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "ids"))


def spread_encode(docs: DataFrame, box, size: int, overlap: int) -> DataFrame:
    """``docs`` with ``ids`` of the texts ``x``, the chunks of each text in tasks of their own."""
    spark = docs.sparkSession
    tasks = max(8, spark.sparkContext.defaultParallelism * 2)
    texts = stage(docs.select(F.sha2("x", 256).alias("h"), F.col("x").alias("t")).dropDuplicates(["h"]), "long")
    starts = texts.select("h", "t", F.sequence(F.lit(0), F.length("t") - 1, F.lit(size)).alias("a"))
    chunks = cut(starts.withColumn("b", F.transform("a", lambda a: a + F.lit(size + overlap))))

    def make_scan():
        split = regex.compile(box.value[1]).findall

        def step(rows: dict) -> dict:
            heads, tails = [], []
            for start, part in zip(rows["start"], rows["part"], strict=True):
                ends = ends_of(split(part), start)
                heads.append([e for e in [start, *ends] if e <= start + overlap])
                tails.append([e for e in trusted(ends, part, start) if e >= start + size])
            return {"h": rows["h"], "k": rows["k"], "head": heads, "tail": tails}

        return step

    scanned = map_batches(chunks.repartition(tasks, "h", "k"), make_scan, "h string, k int, head array<int>, tail array<int>")
    scanned = stage(scanned, "boundaries")
    after = scanned.select("h", (F.col("k") - 1).alias("k"), F.col("head").alias("next"))
    cuts = scanned.join(after, ["h", "k"]).groupBy("h").agg(
        # one number per chunk of a text
        F.sort_array(F.collect_list(F.array_min(F.array_intersect("tail", "next")))).alias("cuts"),
        F.count("*").alias("n"))
    # a missing stitch leaves its chunk and the next to be scanned from the last one
    whole = texts.join(cuts, "h", "left").select(
        "h", "t", F.col("n").isNotNull() & (F.size("cuts") < F.col("n")), F.coalesce("cuts", F.array().cast("array<int>")).alias("cuts"))
    whole = whole.toDF("h", "t", "torn", "cuts")
    spans = cut(whole.select(
        "h", "t", F.when(F.col("torn"), F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), "cuts")).alias("a"),
        F.when(F.col("torn"), F.array(F.length("t"))).otherwise(F.concat("cuts", F.array(F.length("t")))).alias("b")))

    def make_encode():
        encoder = Encoder(Vocabulary(*box.value), size, overlap)
        return lambda parts: {"ids": encoder.column(parts)}

    encoded = add_from(spans.repartition(tasks, "h", "k"), F.col("part"), make_encode, "ids array<int>", ["h", "k"])
    # a group is one text
    joined = encoded.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p")).select(
        "h", F.flatten(F.col("p")["ids"]).alias("ids"))
    return docs.withColumn("h", F.sha2("x", 256)).join(joined, "h")


def cut(texts: DataFrame) -> DataFrame:
    """``h, k, start, part``: the pieces of each text ``t`` between its places ``a`` and ``b``, in one pass over it."""

    def make_step():
        def step(rows: dict) -> dict:
            out = {"h": [], "k": [], "start": [], "part": []}
            for h, t, a, b in zip(rows["h"], rows["t"], rows["a"], rows["b"], strict=True):
                out["h"] += [h] * len(a)
                out["k"] += range(len(a))
                out["start"] += a
                out["part"] += [t[i:j] for i, j in zip(a, b, strict=True)]
            return out

        return step

    return map_batches(texts, make_step, "h string, k int, start int, part string")


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """``encoded`` (its columns ``keep``, or all) with ``decoded binary``, the bytes of ``ids`` one after another (null: none)."""
    box = encoded.sparkSession.sparkContext.broadcast((vocabulary.data, vocabulary.pattern))

    def make_step():
        spell = Spelling(Vocabulary(*box.value).ranks())
        return lambda ids: {"decoded": spell.column(ids)}

    return add_from(encoded, F.coalesce("ids", F.array().cast("array<int>")), make_step, "decoded binary", keep)
