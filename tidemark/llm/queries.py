"""One registered query per operator over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, audit, bpe, langid, lexical, minhash, mixing, pages, passages, quality, toxicity, unigram, urls

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary.read(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, path: str) -> DataFrame:
    ranks = vocabulary()
    coded = bpe.encode(read(spark, path, "documents"), ranks, keep=["doc_id"])
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    plain = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids")
    done = bpe.decode(plain, ranks, keep=["doc_id", "n_tokens", "ids_sha256"])
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, path: str) -> DataFrame:
    docs = read(spark, path, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learn = toxicity.learning_rows(docs, read(spark, path, "labels"), fold)
    scored = toxicity.score(docs.withColumn("held_out", fold == 0), learn, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_html(spark: SparkSession, path: str) -> DataFrame:
    return pages.main_text(read(spark, path, "pages"), keep=["page_id", "url"])


def op4_quality(spark: SparkSession, path: str) -> DataFrame:
    return quality.assess(read(spark, path, "documents"), ["doc_id", "lang", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_minhash(spark: SparkSession, path: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, path, "documents"), percent=85)


def op6_unigram(spark: SparkSession, path: str) -> DataFrame:
    pieces = unigram.read_pieces(public_tokenizers.path(PIECES))
    return unigram.count_tokens(read(spark, path, "documents"), pieces, ["doc_id"])


def op7_mixing(spark: SparkSession, path: str) -> DataFrame:
    return mixing.taken(read(spark, path, "documents")).drop("position")


def op8_ann(spark: SparkSession, path: str) -> DataFrame:
    return ann.nearest(read(spark, path, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_langid(spark: SparkSession, path: str) -> DataFrame:
    docs = read(spark, path, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    net = langid.train(docs.where(~held))
    return langid.identify(docs.withColumn("held_out", held), net, ["doc_id", "held_out"])


def op10_urls(spark: SparkSession, path: str) -> DataFrame:
    pages_, labels = read(spark, path, "pages"), read(spark, path, "labels")
    labelled = pages_.select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id")).select(
        "url", F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("bad"))
    return urls.judge(pages_, labelled).select("page_id", "host", "path", "rule", "verdict")


def op11_passages(spark: SparkSession, path: str) -> DataFrame:
    done = passages.remove_repeats(read(spark, path, "documents"), keep=["doc_id"])
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op12_audit(spark: SparkSession, path: str) -> DataFrame:
    return audit.audit(read(spark, path, "documents"), read(spark, path, "labels"))


def op13_lexical(spark: SparkSession, path: str) -> DataFrame:
    return lexical.rank(read(spark, path, "documents"), read(spark, path, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_html, op4_quality, op5_minhash, op6_unigram, op7_mixing,
                                op8_ann, op9_langid, op10_urls, op11_passages, op12_audit, op13_lexical)}
_UP = "ORDER BY 2.0 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

#: What SQL can state. The others are tested against brute force, the libraries or held-out rows in tests/llm.
SQL: dict[str, str] = {"op7_mixing": rf"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 16) AS turn FROM documents),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY 1),
      w AS (SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w FROM s),
      l AS (SELECT *, coalesce(CAST(sum(2 * ss) OVER ({_UP}) AS BIGINT), 0) AS caps, coalesce(CAST(sum(w) OVER ({_UP}) AS BIGINT), 0) AS ws FROM w),
      v AS (SELECT max((CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(ss) AS BIGINT) FROM s) - caps) / ((SELECT CAST(sum(w) AS BIGINT) FROM w) - ws)) AS top FROM l),
      t AS (SELECT source, ss, least(CAST(2 * ss AS DOUBLE), top * w) AS target FROM l, v),
      p AS (SELECT doc_id, size, ss, target, CAST(floor(target) AS BIGINT) AS f, coalesce(CAST(sum(size) OVER (PARTITION BY d.source
        ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS b
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, ss AS source_size, target,
      least(b + size, f) - least(b, f) + least(b + ss + size, f) - least(b + ss, f) AS taken FROM p""", "op12_audit": r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
      w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
      first AS (SELECT text, min(doc_id) AS least FROM t GROUP BY 1),
      l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
      f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, len(words) < 100 AS a,
          100 * len(list_distinct(words)) < 80 * len(words) AS b,
          100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) AS c,
          regexp_matches(w.text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e
        FROM w JOIN first ON w.text = first.text LEFT JOIN l ON l.doc_id = w.doc_id),
      s AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
          || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n,
          count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM f GROUP BY 1, 2),
      k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
      o AS (SELECT p.k || q.k || r.k || u.k || v.k AS filter_order FROM k p, k q, k r, k u, k v
        WHERE len(list_distinct([p.k, q.k, r.k, u.k, v.k])) = 5),
      z AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
        FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
      h AS (SELECT part, filter_order, step, f, fails, n, g, x, contains(fails, f) AS hit,
          length(before) > 0 AND length(translate(fails, before, '')) < length(fails) AS gone FROM z, s),
      c AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
          CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
          CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
          CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
          CAST(coalesce(sum(g) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
          CAST(coalesce(sum(x) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM h GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c""", "op13_lexical": r"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
      s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM d WHERE len(terms) > 0),
      i AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
      q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
      qt AS (SELECT item_id, text, term, count(*) AS qtf FROM q GROUP BY 1, 2, 3),
      t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
      w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
      x AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)) AS x FROM t, s),
      r AS (SELECT item_id, text, row, doc_id, CAST(sum(qtf * w * x) AS BIGINT) AS score FROM qt JOIN w USING (term) JOIN x USING (term)
        GROUP BY 1, 2, 3, 4),
      o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
        doc_id, score FROM r WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""}
