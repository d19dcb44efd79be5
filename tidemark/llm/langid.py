"""Language identification by a small convolutional network over bytes, trained in numpy.

The text is cut into windows of ``WINDOW`` bytes. Filters of two, three and four bytes run over a window, their maxima go
through a softmax, and the log-probabilities of all windows of a text, weighted by their length, are added. A filter is a
table of 256 rows per byte it covers, so applying it is a look-up: a pair of bytes needs one.

The network is fitted on the driver, on windows of at most ``PER_LANGUAGE`` different texts of each language, chosen by a hash
of the text; windows are cut where the texts are. Rows that repeat a text or a doc_id, or have none, count by their texts. A
null text or one without a letter is ``und`` with score 0, as is every text if there is nothing to learn from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_from, small, text_of
from tidemark.session import stage

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: The bound of the training sample: documents of a language, and windows of a document.
PER_LANGUAGE = 400
PER_DOCUMENT = 4
EPOCHS = 8
UNKNOWN = "und"
#: Windows handled at once; small enough for the caches.
STEP = 96
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Languages, filter tables by width (``width x 256 x FILTERS``) with biases, and the softmax layer."""

    languages: list[str]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray


def held_out(key: Column, buckets: int, rest: int) -> Column:
    """Whether the row is kept from learning: CRC-32 of the doc_id as text has this remainder."""
    return F.crc32(key.cast("string").cast("binary")) % buckets == rest


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``lang, text`` of the chosen learning rows: the different texts of each language that have the least hashes.

    Hashes are uniform, so the number of a language's texts tells below which hash its chosen ones lie, but for a chance of less
    than 1e-9; only texts below that are ranked, however large the table. Copies of a text have one hash and are combined
    before they meet, so a language gives ``per_language`` rows at most.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(text_of()).alias("_hash"))
    place = F.col("_hash") / 2.0 ** 64 + 0.5
    texts = usable.select("lang", "_hash").distinct()
    least = texts.groupBy(F.col("lang").alias("_lang")).agg(
        ((per_language + 8 * per_language ** 0.5 + 32) / F.count("*")).alias("_below"))
    order = Window.partitionBy("lang").orderBy("_hash")
    chosen = (texts.join(small(stage(least, "languages")), F.col("lang") == F.col("_lang"))
              .where(place <= F.col("_below")).withColumn("_n", F.row_number().over(order))
              .where(F.col("_n") <= per_language).select("lang", "_hash"))
    found = usable.join(small(stage(chosen, "chosen")), ["lang", "_hash"], "left_semi")
    return found.groupBy("lang", "_hash").agg(F.min("text").alias("text")).select("lang", "text")


def windows(data: bytes) -> np.ndarray:
    """All windows of the bytes, the last one filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def cut(text: str) -> list[bytes]:
    """The windows of a text that are learnt from: ``PER_DOCUMENT``, evenly spread; none if it has no letter."""
    if not _LETTER.search(text):
        return []
    w = windows(text.encode("utf-8", "surrogatepass"))
    return [w[i].tobytes() for i in np.unique(np.linspace(0, len(w) - 1, min(PER_DOCUMENT, len(w))).astype(int))]


def convolve(x: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter values at every place of every window."""
    n = x.shape[1] - len(table) + 1
    total = np.take(table[0], x[:, :n], axis=0)
    for j in range(1, len(table)):
        total += np.take(table[j], x[:, j:j + n], axis=0)
    return total + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(parts: list[list[bytes]], languages: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """The network for the windows of labelled texts, by Adam on cross-entropy with equal weight for each language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    xs = [np.frombuffer(w, np.uint8)[None, :] for part in parts for w in part]
    ys = [np.full(1, names.index(lang)) for part, lang in zip(parts, languages, strict=True) for _ in part]
    net = Network(
        names, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(names)))).astype(np.float32), np.zeros(max(1, len(names)), np.float32))
    if not xs:
        return net
    x, y = np.concatenate(xs).astype(np.int64), np.concatenate(ys)
    share = 1 / np.maximum(np.bincount(y, minlength=len(names)), 1)
    share = (share / share[y].mean()).astype(np.float32)
    params = [*net.filters, *net.biases, net.weights, net.offset]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    k = len(WIDTHS)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 64):
            b = order[i:i + 64]
            conv = [convolve(x[b], net.filters[j], net.biases[j]) for j in range(k)]
            at = [c.argmax(axis=1) for c in conv]
            top = np.concatenate([np.take_along_axis(c, a[:, None, :], 1)[:, 0, :] for c, a in zip(conv, at, strict=True)], axis=1)
            hidden = np.maximum(top, 0)
            p = softmax(hidden @ net.weights + net.offset)
            p[np.arange(len(b)), y[b]] -= 1
            p *= (share[y[b]] / len(b))[:, None]
            grads = [np.zeros_like(q) for q in params]
            grads[2 * k], grads[2 * k + 1] = hidden.T @ p, p.sum(axis=0)
            back = (p @ net.weights.T) * (top > 0)
            for j, width in enumerate(WIDTHS):
                g = back[:, j * FILTERS:(j + 1) * FILTERS]
                grads[k + j] = g.sum(axis=0)
                for o in range(width):
                    value = x[b][np.arange(len(b))[:, None], at[j] + o]
                    np.add.at(grads[j][o], (value, np.arange(FILTERS)[None, :]), g)
            t += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.02 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return net


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    """A network from the sample of ``docs``; its text and lang only."""

    def make_step():
        return lambda texts: {"windows": [cut(t) for t in texts.to_pylist()]}

    # the documented bound: per_language rows a language, and PER_DOCUMENT windows of each
    rows = add_from(sample(docs, per_language), text_of(), make_step, "windows array<binary>", ["lang"]).collect()
    rows = sorted((r.lang, [bytes(w) for w in r.windows]) for r in rows)
    return fit([w for _, w in rows], [lang for lang, _ in rows])


def scorer(net: Network):
    """A function from texts to languages and scores, with the filters folded into tables of byte pairs."""
    pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
    two = pair(net.filters[0][0], net.filters[0][1]) + net.biases[0]
    three, third = pair(net.filters[1][0], net.filters[1][1]) + net.biases[1], net.filters[1][2]
    four, rest = pair(net.filters[2][0], net.filters[2][1]) + net.biases[2], pair(net.filters[2][2], net.filters[2][3])

    def log_probabilities(x: np.ndarray) -> np.ndarray:
        code = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        top = np.concatenate([
            np.take(two, code, axis=0).max(axis=1),
            (np.take(three, code[:, :-1], axis=0) + np.take(third, x[:, 2:], axis=0)).max(axis=1),
            (np.take(four, code[:, :-2], axis=0) + np.take(rest, code[:, 2:], axis=0)).max(axis=1)], axis=1)
        return np.log(softmax(np.maximum(top, 0) @ net.weights + net.offset) + 1e-6)

    def score(texts: list[str]) -> tuple[list[str], list[float]]:
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if net.languages and _LETTER.search(t)]
        if not live:
            return languages, scores
        data = [texts[i].encode("utf-8", "surrogatepass") for i in live]
        parts = [windows(d) for d in data]
        x = np.concatenate(parts)
        logs = np.concatenate([log_probabilities(x[i:i + STEP]) for i in range(0, len(x), STEP)])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        length = np.full(len(x), float(WINDOW))
        ends = np.cumsum([len(p) for p in parts]) - 1
        length[ends] = [len(d) - (len(p) - 1) * WINDOW for d, p in zip(data, parts, strict=True)]
        total = np.stack([np.bincount(owner, logs[:, c] * length) for c in range(logs.shape[1])], axis=1)
        mean = softmax(total / np.bincount(owner, length)[:, None])
        for row, i in enumerate(live):
            best = int(mean[row].argmax())
            languages[i], scores[i] = net.languages[best], float(mean[row, best])
        return languages, scores

    return score


def identify(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``lang_pred`` and ``score`` of every whole text."""

    def make_step():
        score = scorer(net)  # some 100 kB

        def step(texts) -> dict:
            return dict(zip(("lang_pred", "score"), score(texts.to_pylist()), strict=True))

        return step

    return add_from(docs, text_of(), make_step, "lang_pred string, score double", keep)


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose language is found with a score of ``least`` or more, with their columns."""
    clash = [c for c in docs.columns if c in ("lang_pred", "score")]
    aside = docs.withColumnsRenamed({c: f"own_{c}" for c in clash})
    found = identify(aside, train(docs)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*(F.col(f"own_{c}" if c in clash else c).alias(c) for c in docs.columns))
