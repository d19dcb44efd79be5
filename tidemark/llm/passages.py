"""Removal of repeated passages by interval expansion on Burrows-Wheeler transforms.

A byte is removed if a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id. No transform
holds the whole corpus: every string of that length belongs to the *part* that the least hash of its substrings names, so equal
strings meet. Neighbouring strings mostly share that least hash; such a run of them travels as one *stretch* of text.

1. Documents are dealt into batches. A batch sends 32 bits per different least hash, and learns which of them others have, too.
2. It then sends the stretches with a hash that is not its alone to their parts. Equal stretches of a batch travel once, for
   the least doc_id of the batch; in its other documents they are removed at once.
3. A part sorts its positions by the next ``length`` bytes, takes the Burrows-Wheeler transform and finds the longest common
   prefixes of neighbours by increasing value: backward extension maps the intervals of all strings of length l to those of
   l + 1, breadth first, and an interval whose end is known already is not followed. It stops at ``length``: what has no end yet
   shares that much. The least doc_id of each such interval decides on its strings. Stretches that equal each other are one there.
4. The batch puts the ranges found together and cuts them out.

A hash that very many documents have (estimated from a sample of documents, see ``frequent``) would fill one part. Its stretches
are taken apart into single strings, each named by its own hash; any choice of such hashes gives the same result.

All batches come from one shuffle of the texts, which the plan reads three times. A null text is empty; texts shorter than
``length`` keep all. Rows are documents of their own, also with equal doc_id, of which none is smaller; rows without doc_id
come after all others and remove nothing from each other. Columns named like results are replaced; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_from, text_of
from tidemark.llm.minhash import mix

LENGTH = 50
#: Bytes of text in a batch, and of text per part (a part gets some 0.6 bytes of stretches for each).
BATCH_BYTES, PART_BYTES = 12_000_000, 2_500_000
LEAST_BATCH = 1_000_000
#: Different hashes of a bucket in which batches compare them.
BUCKET_HASHES = 1_000_000
#: Documents in the sample for frequent hashes: so many, or one of so many; occurrences there; documents they must stand for.
SAMPLE, SAMPLE_RATE, SAMPLE_SEEN, FREQUENT = 20_000, 50_000, 20, 10_000
#: Frequent hashes at most; the most frequent ones.
MOST_FREQUENT = 200_000
#: Positions hashed at once; their arrays fit the caches.
CHUNK = 65_536
NO_ID = np.iinfo(np.int64).max
_LAST = np.iinfo(np.uint64).max
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BASE = 0xD6E8FEB86659FD93


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``k`` bytes, eight at least."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,)).copy()
    n = len(data) - k + 1
    h = words[:n] * _ODD[0]
    for at in [*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h ^= words[at:at + n]
        h *= _ODD[1]
        h ^= h >> np.uint64(29)
    h *= _ODD[2]
    h ^= h >> np.uint64(32)
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    size = 1
    while size < width:
        step = min(size, width - size)
        h = np.minimum(h[:len(h) - step], h[step:])
        size += step
    return h


class Powers:
    """Powers of an odd number and its inverse modulo 2^64."""

    def __init__(self, n: int):
        self.up = np.cumprod(np.full(n, _BASE, np.uint64))
        self.down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


@dataclass
class Stretches:
    """Runs of strings with one key: key, where the first starts, how many follow each other, a hash of the whole."""

    key: np.ndarray
    start: np.ndarray
    count: np.ndarray
    mark: np.ndarray


def stretches(data: np.ndarray, bounds: np.ndarray, length: int, frequent: np.ndarray, powers: Powers) -> Stretches:
    """The stretches of all documents in ``data``, which begin and end at ``bounds``; sorted ``frequent`` keys are taken apart."""
    k = 2 * length // 5
    width = length - k + 1
    windows = len(data) - length + 1
    out = []
    if windows > 0:
        edge = np.zeros(len(data) + 1, np.int32)
        # windows that leave their document
        np.add.at(edge, np.maximum(bounds[:-1], bounds[1:] - length + 1), 1)
        np.add.at(edge, bounds[1:], -1)
        leaves = np.cumsum(edge[:windows]) > 0
    for c in range(0, windows, CHUNK):
        m = min(CHUNK, windows - c)
        h = grams(data[c:c + m + length - 1], k)
        key = least(h, width)
        key[leaves[c:c + m]] = _LAST
        at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        count = np.diff(np.append(at, m))
        inside = key[at] != _LAST
        at, count = at[inside], count[inside]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers.up[:len(h)])])
        found = key[at]
        if len(frequent):
            apart = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
            ends = np.cumsum(count[apart])
            one = np.repeat(at[apart] - ends + count[apart], count[apart]) + np.arange(ends[-1] if len(ends) else 0)
            at, count = np.concatenate([at[~apart], one]), np.concatenate([count[~apart], np.ones(len(one), np.int64)])
            mark = (sums[at + count + width - 1] - sums[at]) * powers.down[at]
            found = np.concatenate([found[~apart], mark[len(mark) - len(one):]])
        else:
            mark = (sums[at + count + width - 1] - sums[at]) * powers.down[at]
        out.append((mix(found), at + c, count, mark))
    if not out:
        return Stretches(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint64)))
    return Stretches(*(np.concatenate([o[i] for o in out]) for i in range(4)))


def share_of(key: np.ndarray, n: int) -> np.ndarray:
    """The upper half of the keys scaled to 0 .. n - 1."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Batch:
    """The documents of a batch in order of doc_id and text, as one run of bytes."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("data").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.data = np.frombuffer(b"".join(texts[i] for i in self.order), np.uint8)
        self.bounds = np.cumsum([0, *(len(texts[i]) for i in self.order)])

    def documents(self, places: np.ndarray) -> np.ndarray:
        """Which document each place of the run is in."""
        return np.searchsorted(self.bounds, places, "right") - 1


def copy_out(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the pieces, one after another."""
    ends = np.cumsum(length)
    return data[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


def _column(values: list, kind) -> pa.Array:
    return pa.array(values, kind)


def send_hashes(batch: Batch, number: int, length: int, frequent: np.ndarray, buckets: int, powers: Powers) -> dict[str, list]:
    """Rows ``bucket, batch, hashes``: the lower halves of the batch's different keys, in their order."""
    keys = np.unique(stretches(batch.data, batch.bounds, length, frequent, powers).key)
    cuts = np.searchsorted(share_of(keys, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts)).tolist()
    return {"bucket": used, "batch": [number] * len(used),
            "hashes": [keys[cuts[b]:cuts[b + 1]].astype(np.uint32).tobytes() for b in used]}


def compare_hashes(hashes: list[bytes]) -> list[bytes]:
    """For each batch's hashes a bit each: whether another batch has it."""
    parts = [np.frombuffer(h, np.uint32) for h in hashes]
    _, at, often = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    ends = np.cumsum([0, *map(len, parts)])
    return [np.packbits(often[at[a:b]] > 1).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def send_stretches(batch: Batch, bits: dict[int, bytes], length: int, frequent: np.ndarray, buckets: int, parts: int,
                   powers: Powers) -> dict[str, list]:
    """Rows ``part, strings, sizes, document, start, id`` of the stretches that aren't alone; the last row, of no text, has in
    ``document, start, sizes`` what is removed already."""
    found = stretches(batch.data, batch.bounds, length, frequent, powers)
    owner = batch.documents(found.start)
    order = np.lexsort((owner, found.mark, found.count, found.key))
    key, mark, count, own = found.key[order], found.mark[order], found.count[order], owner[order]
    first = np.append(True, key[1:] != key[:-1])[:len(key)]
    names, group = key[first], np.cumsum(first) - 1
    ids = batch.ids[own]
    starts = np.flatnonzero(first)
    shared = (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)) if len(starts) else np.zeros(0, bool)
    cuts = np.searchsorted(share_of(names, buckets), np.arange(buckets + 1))
    for b, packed in bits.items():
        n = cuts[b + 1] - cuts[b]
        shared[cuts[b]:cuts[b + 1]] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
    # of equal stretches the first, which has the least doc_id, stands for all
    fresh = first | np.append(True, (mark[1:] != mark[:-1]) | (count[1:] != count[:-1]))[:len(key)]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    later = ids > ids[lead]
    go, done = shared[group] & ~later, shared[group] & later
    start = found.start[order] - batch.bounds[own]
    out = {c: [] for c in ("part", "strings", "sizes", "document", "start", "id")}
    place = share_of(mix(key[go] + np.uint64(1)), parts)
    turn = np.argsort(place, kind="stable")
    rows = np.flatnonzero(go)[turn]
    cuts = np.searchsorted(place[turn], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        r = rows[cuts[p]:cuts[p + 1]]
        sizes = count[r] + length - 1
        out["part"].append(p)
        out["strings"].append(copy_out(batch.data, found.start[order[r]], sizes).tobytes())
        _append(out, sizes, own[r], start[r], ids[r])
    if done.any():
        out["part"].append(int(mix(np.array([batch.ids[0]], np.int64).view(np.uint64))[0] % np.uint64(parts)))
        out["strings"].append(b"")
        _append(out, count[done] + length - 1, own[done], start[done], ids[done])
    return out


def _append(out: dict[str, list], sizes, document, start, ids) -> None:
    for name, values, kind in (("sizes", sizes, np.int32), ("document", document, np.int32), ("start", start, np.int32), ("id", ids, np.int64)):
        out[name].append(values.astype(kind).tobytes())


def pair_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pairs, whose numbers are below the length of the arrays, and where in it a pair differs from the last."""
    n, bits = len(a), np.uint64(max(1, len(a).bit_length()))
    if 3 * int(bits) <= 64:  # the place fits beside the pair: sorting values is faster than sorting places
        packed = np.sort((a << (bits + bits)) | (b << bits) | np.arange(n, dtype=np.uint64))
        order, packed = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), packed >> bits
    else:
        packed = (a << np.uint64(32)) | b
        order = np.argsort(packed)
        packed = packed[order]
    return order, packed[1:] != packed[:-1]


def context_order(text: np.ndarray, length: int) -> np.ndarray:
    """All positions of the circular text, sorted by the next ``length`` bytes: by eight bytes, then by doubling."""
    n = len(text)
    first = np.ndarray((n,), ">u8", buffer=np.resize(text, n + 8), strides=(1,)).astype(np.uint64)
    order, known = np.argsort(first), 8
    differs = first[order][1:] != first[order][:-1]
    while known < length:
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(differs)])
        step = min(known, length - known)
        order, differs = pair_order(rank, np.roll(rank, -step))
        known += step
    return order


def interval_ends(bwt: np.ndarray, length: int) -> np.ndarray:
    """Whether each place starts a new interval of the strings of ``length`` bytes: the common prefix with the place before it
    is shorter. Prefixes come by increasing value, from the intervals whose ends the value before has found."""
    n = len(bwt)
    place = np.argsort(bwt, kind="stable")  # by letter; its inverse is the backward extension of a place
    back = np.empty(n, np.int64)
    back[place] = np.arange(n)
    same = bwt[place][1:] == bwt[place][:-1]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[place[:-1][same]] = place[1:][same]
    preceding[place[1:][same]] = place[:-1][same]
    run = np.concatenate([[0], np.where(bwt[1:] != bwt[:-1], np.arange(1, n), 0)])
    run = np.maximum.accumulate(run)  # where the run of equal letters began
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(low):
            break
        plain = run[high] <= low  # one letter before all of the interval
        lows, highs = back[low[plain]], back[high[plain]]
        low, high = low[~plain], high[~plain]
        size = high - low + 1
        ends = np.cumsum(size)
        each = np.repeat(low - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        # of each letter the first and the last in its interval; extended intervals don't overlap, so both sort alike
        firsts = np.sort(back[each[preceding[each] < np.repeat(low, size)]])
        lasts = np.sort(back[each[following[each] > np.repeat(high, size)]])
        low, high = np.concatenate([lows, firsts]), np.concatenate([highs, lasts])
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
    return known[:n]


def repeated(strings: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Per position of the strings, one after another: whether the ``length`` bytes from there are inside their string and in
    one with a smaller id, too."""
    n, ends = len(strings), np.cumsum(sizes)
    if not n:
        return np.zeros(0, bool)
    _, smaller = np.unique(ids, return_inverse=True)
    own = np.repeat(smaller.astype(np.int64), sizes)
    whole = np.arange(n) + length <= np.repeat(ends, sizes)
    order = context_order(strings, length)
    starts = interval_ends(strings[order - 1], length)
    at = np.where(whole[order], own[order], n)
    first = np.minimum.reduceat(at, np.flatnonzero(starts))
    out = np.empty(n, bool)
    out[order] = whole[order] & (first[np.cumsum(starts) - 1] < at)
    return out


def fold(pieces: list[bytes], ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different pieces, the least id of each, and which of them every piece is."""
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(p, len(place)) for p in pieces], np.int64)
    lowest = np.full(len(place), NO_ID)
    np.minimum.at(lowest, which, ids)
    return list(place), lowest, which


def find(table: dict[str, list], length: int) -> list[np.ndarray]:
    """Per row of a part, the ranges ``document, start, end`` to remove.

    Equal stretches enter the transform once, under their least id; where that id is beaten all are removed, and those of
    larger ids are removed whole.
    """
    numbers = lambda c, kind: [np.frombuffer(v, kind) for v in table[c]]
    sizes, document, start, ids = (numbers(c, k) for c, k in (("sizes", np.int32), ("document", np.int32), ("start", np.int32), ("id", np.int64)))
    out = [np.stack([d, s, s + z], axis=1) for d, s, z in zip(document, start, sizes, strict=True)]
    live = [i for i, s in enumerate(table["strings"]) if s]
    if not live:
        return out
    join = lambda parts: np.concatenate([parts[i] for i in live]).astype(np.int64)
    size, doc, at, own = join(sizes), join(document), join(start), join(ids)
    text, ends = b"".join(table["strings"][i] for i in live), np.cumsum(size).tolist()
    strings, lowest, which = fold([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], own)
    offset = np.cumsum([0, *map(len, strings)])
    hit = repeated(np.frombuffer(b"".join(strings), np.uint8), np.diff(offset), lowest, length)
    # the last positions of a string are never hits, so no run of hits leaves its string
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.searchsorted(begin, offset)
    later = own > lowest[which]
    runs = np.where(later, 1, np.diff(cuts)[which])
    last = np.cumsum(runs)
    one = np.repeat(np.arange(len(own)), runs)
    run = np.minimum(np.arange(len(one)) - np.repeat(last - runs - cuts[which], runs), max(0, len(begin) - 1))
    whole, base = later[one], at[one]
    begin, end = (np.append(begin, 0)[run] - offset[which[one]], np.append(end, 0)[run] - offset[which[one]] + length - 1)
    ranges = np.stack([doc[one], base + np.where(whole, 0, begin), base + np.where(whole, size[one], end)], axis=1)
    rows = np.cumsum([0, *(len(sizes[i]) for i in live)])
    edges = np.concatenate([[0], last])[rows]
    for k, i in enumerate(live):
        out[i] = ranges[edges[k]:edges[k + 1]]
    return out


def cut(batch: Batch, ranges: np.ndarray) -> tuple[list, list]:
    """Per document, in the batch's order, the maximal removed runs and the bytes kept."""
    edge = np.zeros(len(batch.data) + 1, np.int32)
    base = batch.bounds[ranges[:, 0]]
    np.add.at(edge, base + ranges[:, 1], 1)
    np.add.at(edge, base + ranges[:, 2], -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans, kept = [], []
    for a, b in zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist(), strict=True):
        part = gone[a:b]
        step = np.diff(np.concatenate([[0], part.astype(np.int8), [0]]))
        spans.append([{"start": int(i), "end": int(j)} for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
        kept.append(batch.data[a:b][~part].tobytes())
    return spans, kept


def frequent(docs: DataFrame, rows: int, length: int, least_docs: int = FREQUENT) -> np.ndarray:
    """Sorted keys that an estimated ``least_docs`` documents have, from a sample that a hash of the rows draws."""
    rate = min(1.0, max(SAMPLE / max(1, rows), 1 / SAMPLE_RATE))
    if rows < least_docs:
        return np.zeros(0, np.uint64)
    seen = max(SAMPLE_SEEN if rate < 1 else 1, least_docs * rate)

    def make_step():
        powers = Powers(CHUNK + length)

        def step(texts) -> dict:
            out = []
            for text in texts.to_pylist():
                data = np.frombuffer(text, np.uint8)
                key = raw_keys(data, length, powers)
                out.append(key.astype(np.int64))
            return {"keys": out}

        return step

    drawn = docs.where(F.xxhash64("doc_id", F.lit(length)) / 2.0 ** 64 + 0.5 < rate)
    each = add_from(drawn, F.col("data"), make_step, "keys array<long>", []).select(F.explode("keys").alias("key"))
    top = each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= seen).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT)
    return np.sort(np.array([r.key for r in top.select("key").collect()], np.int64).view(np.uint64))


def raw_keys(data: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """The different least hashes of a text, as ``stretches`` compares them with the frequent ones."""
    k, out = 2 * length // 5, [np.zeros(0, np.uint64)]
    for c in range(0, len(data) - length + 1, CHUNK):
        part = data[c:c + CHUNK + length - 1]
        out.append(np.unique(least(grams(part, k), length - k + 1)))
    return np.unique(np.concatenate(out))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, batch_bytes: int = BATCH_BYTES,
                   part_bytes: int = PART_BYTES, least_docs: int = FREQUENT) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``n_bytes``, ``spans`` (the maximal removed runs) and ``kept`` (binary)."""
    if length < 20:
        raise ValueError("strings of 20 bytes at least")
    added = ("n_bytes", "spans", "kept")
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    data = text_of().cast("binary")
    total = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(data)).alias("bytes")).first()
    size = total["bytes"] or 0
    # small tables are dealt to all cores
    cores = docs.sparkSession.sparkContext.defaultParallelism
    batches, parts = 1 + max(size // batch_bytes, min(4 * cores, size // LEAST_BATCH)), 1 + size // part_bytes
    buckets = 1 + size // (16 * BUCKET_HASHES)  # a key for every 16 bytes or so
    plain = docs.select("doc_id", data.alias("data"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    often = frequent(plain, total["rows"], length, least_docs)
    box = docs.sparkSession.sparkContext.broadcast(often)
    dealt = plain.withColumn("batch", F.pmod(F.xxhash64("doc_id", "data"), F.lit(batches)).cast("int"))

    def hashes(table: pa.Table) -> pa.Table:
        rows = send_hashes(Batch(table), table.column("batch")[0].as_py(), length, box.value, buckets, Powers(CHUNK + length))
        return pa.table({"bucket": _column(rows["bucket"], pa.int32()), "batch": _column(rows["batch"], pa.int32()),
                         "hashes": _column(rows["hashes"], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"),
                         "bits": _column(compare_hashes(table.column("hashes").to_pylist()), pa.binary())})

    def send(table: pa.Table, bits: pa.Table) -> pa.Table:
        known = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
        rows = send_stretches(Batch(table), known, length, box.value, buckets, parts, Powers(CHUNK + length))
        number = table.column("batch")[0].as_py()
        return pa.table({"part": _column(rows["part"], pa.int32()), "batch": _column([number] * len(rows["part"]), pa.int32()),
                         **{c: _column(rows[c], pa.binary()) for c in ("strings", "sizes", "document", "start", "id")}})

    def search(table: pa.Table) -> pa.Table:
        found = find({c: table.column(c).to_pylist() for c in ("strings", "sizes", "document", "start", "id")}, length)
        return pa.table({"batch": table.column("batch"), "ranges": _column([f.astype(np.int32).tobytes() for f in found], pa.binary())})

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        batch = Batch(table)
        ranges = np.frombuffer(b"".join(found.column("ranges").to_pylist()), np.int32).reshape(-1, 3).astype(np.int64)
        spans, kept = cut(batch, ranges)
        taken = table.take(pa.array(batch.order, pa.int64()))
        return pa.table([*(taken.column(f"c{i}") for i in range(len(names))), pa.array(np.diff(batch.bounds)),
                         _column(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), _column(kept, pa.binary())],
                        names=[*(f"c{i}" for i in range(len(names))), *added])

    by_batch = dealt.groupBy("batch")
    bits = by_batch.applyInArrow(hashes, "bucket int, batch int, hashes binary").groupBy("bucket").applyInArrow(
        compare, "batch int, bucket int, bits binary")
    sent = by_batch.cogroup(bits.groupBy("batch")).applyInArrow(
        send, "part int, batch int, strings binary, sizes binary, document binary, start binary, id binary")
    ranges = sent.groupBy("part").applyInArrow(search, "batch int, ranges binary")
    kinds = ", ".join(f"c{i} {dealt.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(names)))
    done = by_batch.cogroup(ranges.groupBy("batch")).applyInArrow(
        finish, f"{kinds}{', ' if kinds else ''}n_bytes long, spans array<struct<start: int, end: int>>, kept binary")
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *added)
