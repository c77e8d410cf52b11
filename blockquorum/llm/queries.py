"""The operators of this folder as named queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockquorum.llm import bpe, decontaminate, languages, lmscore, mainpage, middle, pseudonyms, resample, shinglejoin, simhash, spotsigs, tokenids, toxicity
from blockquorum.llm.common import table

#: Of the runs over the test tables; a real run gets its own secret.
PSEUDONYM_KEY = "test-tables"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as the shard files hold them."""
    return tokenids.write_and_read(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end=2)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and its near-duplicate component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or in reordered pieces."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes they decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages.identify(table(spark, sf_dir, "documents"))


def op8_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page."""
    return mainpage.extract(table(spark, sf_dir, "pages"))


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the counts of all others."""
    found = lmscore.score(table(spark, sf_dir, "documents"), order=3)
    return found.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_longest")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal numbers and dates replaced, and how many were."""
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, count_col="n_replaced")
    return found.select("doc_id", "text", "n_replaced")


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and the text that comes back from that."""
    found = middle.transform(table(spark, sf_dir, "documents"), seed=1)
    back = middle.restored(F.col("form"), F.col("output"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


def op12_shinglejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, and its component of sets alike by 85 per cent."""
    return shinglejoin.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the benchmark."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_tokenids": op1_tokenids,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_spotsigs": op4_spotsigs,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_languages": op7_languages,
    "op8_mainpage": op8_mainpage,
    "op9_lmscore": op9_lmscore,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_middle": op11_middle,
    "op12_shinglejoin": op12_shinglejoin,
    "op13_resample": op13_resample,
}

#: Order 3, counts of all other documents, 0.4 for each context left off.
LM_SCORES = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split(
    regexp_replace(lower(coalesce(text, '')), '[^A-Za-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM documents),
tokens AS MATERIALIZED (
  SELECT doc_id, p, ws[p] AS c, CASE WHEN p > 1 THEN ws[p - 1] END AS b, CASE WHEN p > 2 THEN ws[p - 2] END AS a
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM docs)),
others AS (
  SELECT doc_id, p,
         count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS l1,
         count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) AS l2,
         count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) AS l3,
         greatest(1, count(*) OVER () - count(*) OVER (PARTITION BY doc_id)) AS n
  FROM tokens),
placed AS (
  SELECT *, lag(l1) OVER v AS before1, lag(l2) OVER v AS before2, p >= 3 AND l3 > 0 AS longest
  FROM others WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
scored AS (
  SELECT doc_id, longest,
         CASE WHEN longest THEN ln(l3 / before2)
              WHEN p >= 2 AND l2 > 0 THEN ln(l2 / before1) + (least(2, p - 1) - 1) * ln(0.4)
              ELSE ln(CASE WHEN l1 > 0 THEN l1 ELSE 0.4 END / n) + least(2, p - 1) * ln(0.4) END AS s
  FROM placed)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, round(coalesce(x.total, 0.0), 3) AS log_score,
       CASE WHEN len(d.ws) > 0 THEN round(x.total / len(d.ws), 6) END AS mean_log_score, coalesce(x.hits, 0)::BIGINT AS n_longest
FROM docs d LEFT JOIN (
  SELECT doc_id, sum(s) AS total, count(*) FILTER (longest) AS hits FROM scored GROUP BY doc_id) x USING (doc_id)
"""

MIDDLE = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draws AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
cut AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM cut
"""

#: Sets of 4 words; pairs counted by their common shingles, then links followed until no new document is reached.
SHINGLE_LINKS = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\t-\r]+') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, sha256(array_to_string(ws[i : i + 3], ' ')) AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM docs WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b
  WHERE 100 * c >= 85 * (s.n + t.n - c)),
reached AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.other)) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reached r USING (doc_id) GROUP BY d.doc_id, s.n
"""

#: The crc32 as a sum of what each byte of a feature adds by its distance from the end, and of what the length adds.
TARGET_DRAW = r"""
WITH RECURSIVE bytes AS MATERIALIZED (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
words AS MATERIALIZED (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
placed AS (SELECT side, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
features AS MATERIALIZED (
  SELECT side, doc_id, ws[i] AS f, count(*) AS c FROM placed GROUP BY ALL
  UNION ALL
  SELECT side, doc_id, ws[i] || ' ' || ws[i + 1], count(*) FROM placed WHERE i < len(ws) GROUP BY ALL),
names AS MATERIALIZED (SELECT f, hex(encode(f)) AS x, strlen(f) AS n FROM (SELECT DISTINCT f FROM features)),
added AS (
  SELECT 0 AS away, b, v FROM bytes
  UNION ALL
  SELECT a.away + 1, a.b, xor(a.v >> 8, t.v) FROM added a JOIN bytes t ON t.b = a.v & 255 WHERE a.away < (SELECT max(n) FROM names)),
lengths AS (
  SELECT 0 AS n, 4294967295 AS r
  UNION ALL
  SELECT l.n + 1, xor(l.r >> 8, t.v) FROM lengths l JOIN bytes t ON t.b = l.r & 255 WHERE l.n < (SELECT max(n) FROM names)),
buckets AS MATERIALIZED (
  SELECT g.f, xor(xor(g.v, l.r), 4294967295) % 10000 AS bucket
  FROM (SELECT p.f, p.n, bit_xor(a.v) AS v FROM (SELECT f, x, n, unnest(range(n)) AS k FROM names) p
        JOIN added a ON a.away = p.n - 1 - p.k AND a.b = ('0x' || p.x[2 * p.k + 1 : 2 * p.k + 2])::BIGINT GROUP BY p.f, p.n) g
  JOIN lengths l ON l.n = g.n),
counts AS (SELECT bucket, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (
  SELECT c.bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS gain FROM counts c, totals a),
weights AS (SELECT doc_id, floor(sum(c * gain) / sum(c))::BIGINT AS weight FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.ws) AS n, coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.doc_id::VARCHAR)[1:8])::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM words d LEFT JOIN weights w USING (doc_id) WHERE d.side = 0),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n >= 20)
SELECT s.doc_id, greatest(2 * s.n - 1, 0)::BIGINT AS n_features, s.weight, s.score, CASE WHEN d.rank <= 25 * d.able // 100 THEN d.rank END AS rank
FROM scored s LEFT JOIN drawn d USING (doc_id)
"""

ORACLE: dict[str, str] = {"op9_lmscore": LM_SCORES, "op11_middle": MIDDLE, "op12_shinglejoin": SHINGLE_LINKS, "op13_resample": TARGET_DRAW}
