"""The operators against brute force and the libraries, on small tables with every odd case."""

from __future__ import annotations

import itertools
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tidemark.llm import ann, bpe, langid, minhash, mixing, pages, quality, toxicity, unigram, urls
from tidemark.llm.queries import vocabulary
from tidemark.session import cut_lineage

DATA = "/root/testdata/sf0.001"


def same(got, want):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


# op1

@pytest.mark.parametrize("spread,size,overlap", [(65_536, 16_384, 256), (300, 120, 20), (50, 40, 6)])
def test_bpe_matches_the_library_and_decodes(odd_docs, spread, size, overlap):
    v = vocabulary()
    library = tiktoken.Encoding("o", pat_str=v.pattern, mergeable_ranks=v.ranks(), special_tokens={})
    docs = odd_docs.where("length(coalesce(text, '')) < 35000") if spread < 1000 else odd_docs
    out = bpe.decode(bpe.encode(docs, v, spread, size, overlap), v).collect()
    assert len(out) == docs.count() and out[0].kept == "mine"
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_of_a_long_text_in_linear_time(spark):
    v = vocabulary()
    text = "der Müller und the 123 thing's  end\n" * 120_000  # 4.4 million characters
    start = time.time()
    got = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), v).first().ids
    library = tiktoken.Encoding("o", pat_str=v.pattern, mergeable_ranks=v.ranks(), special_tokens={})
    taken = time.time() - start
    assert got == library.encode_ordinary(text) and taken < 60


def test_bpe_of_nothing(no_docs):
    v = vocabulary()
    assert bpe.decode(bpe.encode(no_docs, v), v).count() == 0


# op2

def toxic_rows(spark, n=240):
    rng = np.random.default_rng(1)
    words = ["the", "that", "other", "inner", "thing", "stone", "water", "green", "house"]
    rows = []
    for i in range(n):
        bad = int(i % 4 == 0)
        text = list(rng.choice(words, 40))
        for _ in range(3 * bad):
            text[rng.integers(40)] = "zorgk" + str(rng.choice(["a", "en", "ish", "ul"]))
        rows.append((i, " ".join(text), bad))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_stems_and_both_ways_agree(spark, odd_docs):
    rows = toxic_rows(spark)
    learn = rows.where("doc_id < 160").select("text", "toxic", (F.col("doc_id") % 5 == 1).alias("spare"))
    asked = rows.where("doc_id >= 160")
    a = {r.doc_id: r for r in toxicity.score(asked, learn).collect()}
    b = {r.doc_id: r for r in toxicity.score(asked, learn, limit=0).collect()}
    assert len(a) == 80 and all(abs(a[i].score - b[i].score) < 1e-4 for i in a)
    assert np.mean([a[i].predicted == a[i].toxic for i in a]) > 0.95
    out = toxicity.score(odd_docs, learn)
    assert out.count() == odd_docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    none = no_docs.select("text", F.lit(1).alias("toxic"), F.lit(False).alias("spare"))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.5}
    assert toxicity.score(no_docs, none).count() == 0


def test_toxicity_curve_keeps_the_share_of_a_large_table(spark):
    rng = np.random.default_rng(4)
    say = lambda: " ".join(rng.choice(["stone", "water", "green", "house"], 6))
    rows = [(say(), int(i % 21 == 0), i % 10 > 0) for i in range(7000)]  # texts say nothing about the label
    learn = spark.createDataFrame(rows, "text string, toxic int, spare boolean")
    asked = spark.createDataFrame([(say(),) for _ in range(200)], "text string")
    score = np.array([r.score for r in toxicity.score(asked, learn).collect()])
    assert abs(score.mean() - 1 / 21) < 0.02


def test_toxicity_counts_match_brute_force(spark):
    learn = spark.createDataFrame([("abab ab", 1, False), ("abab", 0, True)], "text string, toxic int, spare boolean")
    got = toxicity.counts(learn).agg(*(F.sum(c) for c in ("fit_0", "fit_1", "all_0", "all_1"))).first()
    assert tuple(got) == (0, len(" abab ab ") - 3, len(" abab ") - 3, len(" abab ab ") - 3)


def plain_evidence(learn, text):
    """The difference of class-conditional log-likelihoods by dictionaries of strings, over the root of the length."""
    from collections import Counter, defaultdict

    spell = lambda t: "".join(map(chr, toxicity.letters(t).tolist()))
    split = lambda t: [spell(t)[i:i + 4] for i in range(len(spell(t)) - 3)]
    c = [Counter(g for t, k in learn if k == kind for g in split(t)) for kind in (0, 1)]
    grams = set(c[0]) | set(c[1])
    left = defaultdict(set)
    for g in grams:
        left[g[1:]].add(g[0])
    follow = Counter()
    for lower, before in left.items():
        follow[lower[:2]] += len(before)
    d = []
    for k in (0, 1):
        n1, n2 = (sum(n == i for n in c[k].values()) for i in (1, 2))
        d.append(n1 / max(1, n1 + 2 * n2) if n1 else 0.5)
    total, types = [Counter(), Counter()], [Counter(), Counter()]
    for k in (0, 1):
        for g, n in c[k].items():
            total[k][g[:3]] += n
            types[k][g[:3]] += 1
    weight = lambda k, h: d[k] * types[k][h] / total[k][h] if total[k][h] else 1.0
    out = 0.0
    for g in split(text):
        h = g[:3]
        if g in grams:
            p = [(max(c[k][g] - d[k], 0) / total[k][h] if total[k][h] else 0) + weight(k, h) * len(left[g[1:]]) / follow[g[1:3]] for k in (0, 1)]
            out += np.log(p[1]) - np.log(p[0])
        elif total[0][h] or total[1][h]:
            out += np.log(weight(1, h)) - np.log(weight(0, h))
    return out / np.sqrt(max(1, len(split(text))))


def test_toxicity_evidence_is_plain_kneser_ney(spark):
    rows = [(r.text, r.toxic) for r in toxic_rows(spark, 60).collect()]
    learn = spark.createDataFrame([(t, k, False) for t, k in rows], "text string, toxic int, spare boolean")
    llr = toxicity.model(toxicity.counts(learn), "all")
    asked = ["the stone zorgken water", "zorgk", "entirely unseen wörds", "", "green green house zorgka that", "a"]
    df = spark.createDataFrame([(t,) for t in asked], "text string")
    for r in toxicity.evidence(df, llr, 10_000).collect() + toxicity.evidence(df, llr, 0).collect():
        assert abs(r.evidence - plain_evidence(rows, r.text)) < 1e-4, r.text


# op3

def test_pages(spark):
    cases = {
        "<html><body><nav><a href=x>Home</a></nav><article><h1>A&amp;B</h1><p>one\n two<br>three<p>four</article><footer>f</footer>": "A&B\n\none two three\n\nfour",
        "<div class='cookie-notice'>no</div><div><p>A long enough paragraph of text.</p><p>Another one follows it.</p></div><form>x</form>":
            "A long enough paragraph of text.\n\nAnother one follows it.",
        "<article><p>t</p><script>var a='</p>';</script><div class=comments><p>c</p></div></article>": "t",
        "plain &lt;text&gt;": "plain <text>", "": "", None: "", "<p>cut off <b>he": "cut off he"}
    df = spark.createDataFrame([(i, h, "own") for i, h in enumerate(cases)], "page_id int, html string, text string")
    got = {r.page_id: r for r in pages.main_text(df).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert pages.main_text(df.limit(0)).count() == 0


def test_pages_keep_linked_lines_of_an_article():
    links = "".join(f"<li><a href=x>Reference number {i}</a></li>" for i in range(4))
    html = f"<article><h1><a href=x>Title</a></h1><p>{'A long text. ' * 40}</p><ul>{links}</ul><p>The end.</p></article><p>no</p>"
    assert pages.extract(html).split("\n\n") == ["Title", ("A long text. " * 40).strip(), *(f"Reference number {i}" for i in range(4)), "The end."]


def test_pages_by_line_blocks():
    text = "A paragraph of the story that is long enough to be one. " * 6
    story = [f"{text}{i}" for i in range(8)]
    body = "".join(f"<p>{p}</p>" for p in story)
    for html in (f"<div>{body}</div><article class='comment'><p>First! great post</p></article>", f"<form>{body}</form>",
                 f"<form><div class=nav>menu</div><article>{body}</article></form>", f"<header>{body}",
                 f"<p>Our newsletter is free of charge.</p><article>{body}</article><p>Other words after it all, and more of them here.</p>",
                 f"<div><a href=x>Home and away</a></div>{body}<ul>{'<li><a href=x>another story</a>' * 9}</ul>"):
        assert pages.extract(html).split("\n\n") == story, html
    assert pages.extract(f"<article><header><h1>Title</h1></header>{body}<p>x</p></article>").split("\n\n") == ["Title", *story, "x"]
    # a page whose only article is a teaser without a mark doesn't lose its text
    assert pages.extract(f"<div>{body}</div><article>Other story</article>").split("\n\n")[:8] == story
    assert pages.extract("<nav>menu</nav><footer>imprint</footer>") == ""


def test_pages_in_linear_time():
    start = time.time()
    pages.extract("<div><b>" * 100_000 + "x" + "</i></u>" * 100_000)
    assert time.time() - start < 20


def test_windows_rise_and_fall():
    assert pages.runs([5, 9, 0, 0, 0, 0, 8, 0, 9, 0, 0, 0, 1], [5, 9, 0, 0, 0, 0, 8, 0, 9, 0, 0, 0, 1]) == [(0, 2), (6, 9)]
    assert pages.runs([], []) == [] and pages.runs([0, 0], [0, 0]) == []


# op4

def plain_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in set(windows) if windows.count(w) > 1}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len({i + j for i, w in enumerate(windows) if w in twice for j in range(5)}))


def test_quality_counts_and_verdict(spark, odd_docs, no_docs):
    docs = odd_docs.where("length(coalesce(text, '')) < 30000").unionByName(spark.createDataFrame(
        [(900, "a b\na b\n\na # | <b> c", "en", "s0"), (901, "p q r s t " * 4, "en", "s0"), (902, "a%%% b### c&&& d*** " * 1 + "e%%% f### g&&& h*** i%%% j### k&&&", "en", "s0")],
        "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    out = quality.assess(docs.drop("kept", "score", "ids")).collect()
    assert len(out) == docs.count()
    for r in out:
        want = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert {r.doc_id: r.kept for r in out}[902] is False
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.kept for r in kept.collect()} == {"mine"}
    assert quality.assess(no_docs.drop("kept")).count() == 0


def test_quality_sketch_merges(spark):
    rows = [("en", "a" if i % 3 else "b", 10 + i % 7, 10 + i % 3, i % 2, 0, 0, False) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, word_chars long, n_words long, n_symbols long, n_dup_lines long, "
                                     "n_repeat_words long, base_failed boolean")
    one = quality.quantiles(quality.sketches(df), "lang").first()["at"]
    values = sorted((10 + i % 7) / (10 + i % 3) for i in range(300))
    assert abs(one.mean_word_q1 / values[74] - 1) < 0.02 and abs(one.mean_word_q3 / values[224] - 1) < 0.02
    assert abs(one.length / 11 - 1) < 0.02 and one.symbols_q1 == 0 and one.dup_lines_top == 0


def test_quality_verdict_against_exact_quantiles(spark):
    """The verdict of every document whose measures aren't within the sketch's error of a fence, and what each measure rejects."""
    got = quality.assess(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    live = got[~got.base_failed]
    assert not got[got.base_failed].kept.any()
    x = {"mean_word": live.word_chars / live.n_words, "symbols": live.n_symbols / live.n_words, "dup_lines": live.n_dup_lines / live.n_words}
    least = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    rejected, near = {m: np.zeros(len(live), bool) for m in x}, np.zeros(len(live), bool)
    for (lang, _), rows in live.groupby(["lang", "source"], dropna=False).groups.items():
        at = live.index.isin(rows)
        of_lang = (live.lang == lang).to_numpy()
        wide = of_lang if of_lang.sum() >= quality.MIN_DOCS else np.ones(len(live), bool)
        own = at if at.sum() >= quality.MIN_DOCS else wide
        short = np.sqrt(np.maximum(1, least(live.n_words[own], 0.5) / live.n_words[at]))
        for m, v in x.items():
            q1, q3, top = least(v[own], 0.25), least(v[own], 0.75), least(v[wide], quality.PASS[m])
            lo, hi = q1 - 3 * (q3 - q1) * short, np.maximum(q3 + 3 * (q3 - q1) * short, top)
            rejected[m][at] = (v[at] < lo) | (v[at] > hi)
            slack = (quality.GAMMA - 1) * np.maximum(top, q3 + 3 * (q1 + q3) * short) * 1.01
            near[at] |= ((np.abs(v[at] - lo) < slack * (q1 > 0)) | (np.abs(v[at] - hi) < slack) & (v[at] != top)).to_numpy()
    want = ~np.logical_or.reduce(list(rejected.values()))
    assert (live.kept.to_numpy() == want)[~near].all() and near.mean() < 0.1
    assert all(r.any() for r in rejected.values())


# op5

def plain_components(rows, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (least.get(top(i)), d) if x is not None]
        least[top(i)] = min(known) if known else None
    return [(d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows)]


def test_minhash_matches_all_pairs(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    base = [str(w) for w in rng.integers(0, 10_000, 150)]
    rows = []
    for i in range(120):  # a family around the threshold, so that stars leave links to the blocks
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            words[at] = f"n{i}_{at}"
        rows.append((2000 + i, " ".join(words)))
    rows += [(None, " ".join(base) + " x"), (None, " ".join(base) + " y"), (None, "a copy without any id " * 3), (None, "a copy without any id " * 3)]
    docs = odd_docs.where("doc_id is null or doc_id <> 111").select("doc_id", "text").union(
        spark.createDataFrame(rows, "doc_id long, text string"))
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    same([tuple(r) for r in got], plain_components(plain, 85))
    assert minhash.near_duplicates(no_docs).count() == 0


def test_minhash_finds_pairs_at_a_lower_threshold(spark):
    rows = []
    for i in range(2000):  # 80 shingles, and the same with 20 more
        words = [f"w{i}x{j}" for j in range(104)]
        rows += [(2 * i, " ".join(words[:84])), (2 * i + 1, " ".join(words))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert out.where("doc_id % 2 = 1 AND kept").count() == 0


def test_one_per_group_keeps_columns(odd_docs):
    out = minhash.one_per_group(odd_docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd_docs.columns and 100 in ids and 101 not in ids and 104 in ids and 105 in ids


def test_one_per_group_decides_by_row(spark):
    """Near copies with missing, equal and repeated ids: one row of each group stays, with its columns."""
    words = [f"w{i}" for i in range(100)]
    near = lambda i: " ".join([*words[:i], f"z{i}", *words[i + 1:]])
    rows = [(3, near(1), 1), (None, near(2), 2), (None, near(3), 3), (None, "only here without id and long enough", 4), (None, "only here without id and long enough", 5),
            (7, "one text of a repeated id that is here", 6), (7, "another text of the same id, not alike", 7), (8, "the same row twice is here in full", 8),
            (8, "the same row twice is here in full", 8), (9, None, 9), (9, None, 10), (None, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ref int")
    out = minhash.one_per_group(docs, 80)
    assert out.columns == docs.columns
    got = sorted(r._ref for r in out.collect())
    assert got in ([1, 4, 6, 7, 8, 9, 10, 11], [1, 5, 6, 7, 8, 9, 10, 11])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)], "a binary, b binary")
    assert {bytes(r.label) for r in minhash.components(links).collect()} == {bytes([0])}


def test_component_rounds_write_few_files(spark, monkeypatch):
    """Small tables of links are not written in as many files as the session has shuffle partitions."""
    written = []

    def kept(df):
        out = cut_lineage(df)
        written.append((out.rdd.getNumPartitions(), out.count()))
        return out

    monkeypatch.setattr(minhash, "cut_lineage", kept)
    monkeypatch.setattr(minhash, "PART_ROWS", 20)
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)], "a binary, b binary")
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = [spark.conf.get(n) for n in names]
    try:
        for n, value in zip(names, ("16", "false"), strict=True):
            spark.conf.set(n, value)
        found = minhash.components(links).collect()
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
    assert len(found) == 61 and {bytes(r.label) for r in found} == {bytes([0])}
    assert written[0] == (3, 60) and max(n for n, _ in written) <= 6


# op6

def test_unigram_matches_the_library(odd_docs, no_docs):
    pieces = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    low = min(s for _, s, k in pieces if k == unigram.NORMAL)
    vocab = [(p, s) if k in unigram.MATCHING else (p if k == unigram.BYTE else f"\0{i}", low) for i, (p, s, k) in enumerate(pieces)]
    library = Tokenizer(models.Unigram(vocab, 0, True))
    mark = lambda t: unigram.MARK + t.replace(" ", unigram.MARK) if t else ""
    for r in unigram.count_tokens(odd_docs.where("doc_id <> 111"), pieces).collect():
        assert r.n_tokens == len(library.encode(mark(r.text), add_special_tokens=False).ids)
    assert unigram.count_tokens(no_docs, pieces).count() == 0
    ties = unigram.Counter([("a", -1.0, 1), ("b", -1.0, 1), ("ab", -2.0, 1), ("c", -9.0, 1)])
    assert ties.best("ab") == 1 and ties.best("xxab") == 2  # the longer last piece; neighbouring unknowns are one


# op7

def plain_targets(size, weights, share):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(size.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        capped = {s for s in free if w[s] * level > 2 * size[s]}
        if not capped:
            out.update({s: w[s] * level for s in free})
            break
        out.update({s: 2.0 * size[s] for s in capped})
        left -= sum(2 * size[s] for s in capped)
        free -= capped
    return out


def test_mixing(odd_docs, no_docs):
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in odd_docs.collect()]
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    want = plain_targets(size, mixing.WEIGHTS, mixing.SHARE)
    out = mixing.taken(odd_docs).collect()
    same([(r.doc_id, r.size) for r in out], [(d, n) for d, _, n in rows])
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    targets = sorted(round(t, 3) for t in want.values())
    assert sorted({round(r.target, 3) for r in out}) == sorted(set(targets))
    assert abs(sum(r.taken for r in out) - sum(int(t) for t in want.values())) <= len(want)
    same([tuple(r) for r in out], [tuple(r) for r in mixing.taken(odd_docs.repartition(5)).collect()])
    assert mixing.taken(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0


# op8

def test_ann_reaches_its_recall_and_order(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    v[500:800] = v[7]  # copies
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [1.0, None] + [0.0] * 22), (5060, [float("nan")] * 24), (5080, [1.0]), (5100, [float("inf")] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        want = sorted(range(1500), key=lambda i: (-round(s[i], 9), i))[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in found]
        assert all(abs(s[i] - score) < 1e-9 for i, score in found)
        hit += len(set(want) & {i for i, _ in found})
    assert hit / (20 * len(got)) >= 0.9
    assert ann.nearest(df.where("vec_id < 3"), F.lit(True)).count() == 6
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_ann_beside_a_few_very_long_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[[1, 2, 3]] *= np.array([10, 100, 1000])[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        order = [i for i in np.argsort(-(v @ v[q]), kind="stable") if i != q][:20]
        hits += len(got[q] & set(order))
    assert hits / (200 * 20) >= 0.9


def test_langid_sample_is_the_least_hashes(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"),
                                    F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 97 != 0, "a").alias("lang"))
    got = {"a": set(), "b": set()}
    for r in langid.sample(docs, 50).collect():
        got[r.lang].add(int(r.text))
    for lang, ids in got.items():
        first = docs.where(F.col("lang") == lang).orderBy(F.xxhash64("text")).limit(50).collect()
        assert ids == {r.doc_id for r in first}


def test_langid_sample_with_repeated_and_missing_ids(spark):
    rows = [(1, f"text {i}", "a") for i in range(3000)] + [(None, f"other {i}", "b") for i in range(600)] + [(2, "the same", "c")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limit, want in ((50, {"a": 50, "b": 50, "c": 1}), (5000, {"a": 3000, "b": 600, "c": 1})):
        got = langid.sample(docs, limit).collect()
        assert {k: sum(r.lang == k for r in got) for k in "abc"} == want
    assert langid.train(docs).languages == ["a", "b", "c"]


def test_langid(spark, odd_docs, no_docs):
    net = langid.train(odd_docs.where("doc_id % 4 <> 2"))
    out = langid.identify(odd_docs, net).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    plain = [r for r in out if r.doc_id is not None and r.doc_id < 60]
    assert np.mean([r.lang == r.lang_pred for r in plain]) > 0.9 and all(0 <= r.score <= 1 for r in out)
    assert langid.keep_identified(odd_docs).columns == odd_docs.columns
    assert langid.identify(odd_docs, langid.train(no_docs)).where("lang_pred <> 'und'").count() == 0
    crc = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in crc)


def test_folded_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    net = langid.fit([langid.cut("abc def" * 9), langid.cut("xyz uvw" * 9)], ["a", "b"], epochs=1)
    text = "".join(chr(c) for c in rng.integers(97, 122, 256))
    x = langid.windows(text.encode()).astype(int)
    top = np.concatenate([langid.convolve(x, t, b).max(axis=1) for t, b in zip(net.filters, net.biases, strict=True)], axis=1)
    want = langid.softmax(np.maximum(top, 0) @ net.weights + net.offset)[0].max()
    assert abs(langid.scorer(net)([text])[1][0] - want) < 1e-3


# op10

def plain_rule(host, path):
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_urls(spark):
    given = ["http://a.Example.ORG/es/1", "https://example.org/en/12?x=1#t", "http://notexample.org/es/", "http://b.com/de/x", "http://com/fr/", "http://x.com",
             "http://q.net/en", None, "no url", "", "http://x.net?a://b/c"]
    spam = [f"http://www.spam.net/buy/{i}" for i in range(40)] + [f"http://good.net/read/{i}" for i in range(40)]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(given + spam + given[:2])], "page_id int, url string, rule string")
    labelled = df.where("page_id >= 11").select("url", F.coalesce(F.col("url").contains("spam"), F.lit(False)).alias("bad"))
    out = urls.judge(df, labelled).collect()
    assert len(out) == df.count()
    for r in out:
        rule = plain_rule(r.host, r.path)
        assert (r.rule, r.verdict) == rule if rule else (r.rule is None and r.verdict == ("block" if "spam" in r.host else "allow"))
    by = {r.page_id: (r.host, r.path) for r in out}
    assert by[0] == ("a.example.org", "/es/1") and by[7] == ("", "") and by[8] == ("", "") and by[10] == ("x.net", "")
    assert urls.judge(df.limit(0), labelled.limit(0)).count() == 0


def test_urls_are_mined_whole(spark):
    bad = ["http://h.net/a/b/c/casino/{}", "http://h.net/?a=1&b=2&c=3&affid={}", "http://x{}.bad.co.a.b.c.net/"]
    good = ["http://h.net/a/b/c/other/{}", "http://h.net/?a=1&b=2&c=3&d={}", "http://x{}.good.co.a.b.c.net/"]
    labelled = spark.createDataFrame([(u.format(i), u in bad) for u in bad + good for i in range(20)], "url string, bad boolean")
    asked = spark.createDataFrame([(u.format("new"),) for u in bad + good], "url string")
    got = {r.url: r.verdict for r in urls.judge(asked, labelled).collect()}
    assert got == {u.format("new"): "block" if u in bad else "allow" for u in bad + good}


def test_url_rules_outlast_the_growth_of_the_table(spark):
    labelled = spark.range(10_000).select(F.concat(F.lit("http://good.net/"), "id").alias("url"), F.lit(False).alias("bad")).union(
        spark.range(12).select(F.concat(F.lit("http://bad.net/"), "id"), F.lit(True)))
    asked = spark.createDataFrame([("http://bad.net/new",), ("http://good.net/new",)], "url string")
    assert {r.url: r.verdict for r in urls.judge(asked, labelled).collect()} == {"http://bad.net/new": "block", "http://good.net/new": "allow"}


def plain_rules(labelled):
    """Minimal sure token sets by looking at all sets of tokens that bad URLs share."""
    sets = [(frozenset(t), b) for t, b in labelled]
    tried, sure = set(), {}
    for t, b in sets:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k) if b else ():
                tried.add(frozenset(c))
    for c in tried:
        n, bad = sum(c <= t for t, _ in sets), sum(c <= t for t, b in sets if b)
        if bad >= urls.LEAST and bad / n >= urls.CONFIDENCE:
            sure[c] = bad / n
    return sure


def test_url_rules_against_all_token_sets(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(400):
        host = rng.choice(["a.net", "b.net", "c.d.net"])
        path = "/".join(rng.choice(["p", "q", "r"], rng.integers(0, 3)))
        key = "?k=1" if rng.random() < 0.4 else ""
        rows.append((f"http://{host}/{path}{key}", bool(rng.random() < (0.85 if ("q" in path and key) or host == "c.d.net" else 0.15))))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    split = labelled.withColumn("key", F.col("url")).withColumns(urls.parts("key"))
    tokens = [(r.t, r.bad) for r in split.select(urls.tokens(F.col("key")).alias("t"), "bad").collect()]
    sure = plain_rules(tokens)
    asked = labelled.select("url").distinct()
    own = {r.url: r.t for r in split.select("url", urls.tokens(F.col("key")).alias("t")).distinct().collect()}
    for r in urls.judge(asked, labelled, rules=()).collect():
        assert (r.verdict == "block") == any(c <= set(own[r.url]) for c in sure), r.url


def test_url_rules_of_a_long_shared_path(spark):
    path = "/".join(f"part{i}" for i in range(25))
    rows = [(f"http://site.net/{path}/{i}", i % 4 != 0) for i in range(16)] + [(f"http://ok.net/{i}", False) for i in range(50)]
    start = time.time()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    asked = spark.createDataFrame([(f"http://site.net/{path}/new",), ("http://ok.net/new",)], "url string")
    assert {r.verdict for r in urls.judge(asked, labelled).collect()} == {"block", "allow"}
    assert time.time() - start < 60
