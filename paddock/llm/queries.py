"""The registered queries of this package over the supplied tables, and the SQL that checks some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import audit, bpe, contamination, html, langid, lengths, minhash, mixing, negatives, quality, suffix, tokenfile, vectors
from paddock.llm.texts import table
from paddock.session import tune

#: Folder of the vocabulary files; the installed package's if not given.
VOCABULARIES: str | None = None
END_ID = 2


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return f"{VOCABULARIES.rstrip('/')}/{name}" if VOCABULARIES else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = langid.learn(docs.where("NOT held_out"), vocabulary_file("piece_bpe_32k.model"))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), most_copies=None)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"), pattern())


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), END_ID)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lengths.encoded_lengths(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))
    return lengths.length_table(found)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 50 == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: (lambda spark, sf_dir, f=f: f(tune(spark), sf_dir))
    for f in (
        op1_language_id,
        op2_vector_dedup,
        op3_minhash_dedup,
        op4_mixing,
        op5_html_text,
        op6_quality_rules,
        op7_bpe,
        op8_token_files,
        op9_suffix_dedup,
        op10_token_counts,
        op11_hard_negatives,
        op12_decontamination,
        op13_source_audit,
        pipeline,
    )
}

SQL: dict[str, str] = {
    "op4_mixing": f"""
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars, pow(sum(length(coalesce(text, '')))::DOUBLE, {mixing.TEMPERATURE}) AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(chars) FROM sizes) / chars ELSE 1.0 END AS rate
  FROM sizes),
steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k)),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('{mixing.SEED}:count:' || doc_id), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents d),
counted AS (
  SELECT d.* EXCLUDE (u), (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u) AS n FROM drawn d)
SELECT * EXCLUDE (n), ('0x' || substr(md5('{mixing.SEED}:place:' || doc_id || ':' || copy), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n)) AS copy FROM counted WHERE n > 0)
""",
    "op2_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON node = e.vec_id LEFT JOIN counts ON a = e.vec_id
""",
    "op3_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON node = doc_id
""",
    "op9_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(0, len(h) // 2 - 200)) AS i FROM d WHERE len(h) >= 400),
keyed AS (SELECT s.doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM starts s JOIN d USING (doc_id)),
twice AS (SELECT doc_id, i FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w > 200 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM twice WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grouped AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, g, min(i) AS low, max(i) + 200 AS high FROM grouped GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS after, low AS upto FROM spans
  UNION ALL SELECT doc_id, 9000000000000, max(high), 9000000000000 FROM spans GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * after + 1, 2 * (least(upto, len(h) // 2) - after)), '' ORDER BY low) AS k FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.u, a.id AS anchor, b.id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s
  FROM v a JOIN v b ON a.u <> b.u AND len(a.e) = len(b.e) WHERE a.id % 50 = 0),
positives AS (
  SELECT u, anchor, id, s, row_number() OVER (PARTITION BY u ORDER BY s DESC, id) AS k FROM scores WHERE same QUALIFY k <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.u, p.k ORDER BY n.s DESC, n.id) AS INT) AS rank,
  n.id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON n.u = p.u AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
QUALIFY rank <= 3
""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
parts AS (SELECT item_id, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, hash(n, list_slice(w, i, i + n - 1)) AS h FROM parts),
places AS (SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM d, sizes WHERE len(w) >= n),
hashed AS (SELECT r, n, i, hash(n, list_slice(w, i, i + n - 1)) AS h FROM places),
hits AS (SELECT DISTINCT r, hashed.n, i, item_id FROM hashed JOIN windows ON hashed.h = windows.h AND hashed.n = windows.n),
covered AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS word FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
    "op13_source_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::HUGEINT AS p
  FROM dense WINDOW w AS (PARTITION BY lang, source)),
q AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::HUGEINT AS q
  FROM kept WINDOW w AS (PARTITION BY lang)),
priced AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN priced ON priced.lang = a.lang AND priced.source = a.source AND item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms QUALIFY rank <= 200
""",
}
