"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daygrain.llm.ann_postings import search
from daygrain.llm.common import read_table
from daygrain.llm.decontaminate import contamination
from daygrain.llm.html_wrapper import extract_text
from daygrain.llm.lexical_rank import rank_documents
from daygrain.llm.license_index import LIBRARY, MIN_SHARE, RARE_WORDS, scan_licenses
from daygrain.llm.line_dedup import dedup_lines
from daygrain.llm.quality_gbt import classify
from daygrain.llm.secret_scan import BASE, find_secrets
from daygrain.llm.sentencepiece_codec import round_trip
from daygrain.llm.simhash import near_duplicates
from daygrain.llm.source_divergence import audit
from daygrain.llm.url_trie import judge_urls
from daygrain.llm.warc_bundles import read_warc, write_warc

# The contract's url rules (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again: number and hash of its pieces, and whether it came back."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    both = round_trip(docs)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                       F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that other documents hold too stay in the smallest document only."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, with the fewest edits."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = contamination(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.errors")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; a third of the ids is never learnt from."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    scored = classify(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return scored.select("doc_id", "held_out", "score", "predicted")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the base kinds counted and hashed, and all spans."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    spans, names = F.col("spans"), [r.kind for r in BASE]
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in names]
    base = of(*names)
    return find_secrets(docs).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url's longest fitting rule and verdict."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from its bundle."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return read_warc(write_warc(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector among all others."""
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return search(vectors, F.col("vec_id") % 100 == 0, k=10).select("query_id", "rank", "vec_id", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest document reachable over links of three bits."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = near_duplicates(docs, shingle_words=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of the highest score for every benchmark item."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return rank_documents(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]), k=10)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and labels."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = scan_licenses(docs)
    base = F.filter("matches", lambda m: m["base"])
    starts = F.flatten(F.transform(base, lambda m: m["starts"]))
    labels = lambda matches: F.array_join(F.sort_array(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size(starts).cast("long").alias("n_base"),
                        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distance to the others of its language, and the terms that set it apart."""
    docs = read_table(spark, sf_dir, "documents", ["lang", "source", "text"])
    return audit(docs, min_docs=30, top_terms=50)


SQL_LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
first_doc AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id > keeper, false) AS gone
  FROM keyed LEFT JOIN first_doc ON keyed.k = first_doc.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL_URL_FILTER = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fitting ON split.page_id = fitting.page_id
"""

SQL_WARC = """
WITH digests AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_id FROM digests GROUP BY payload)
SELECT page_id, octet_length(encode(digests.payload))::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(bits, (i * 5 + 1)::BIGINT, 5))::BIGINT + 1, 1), '' ORDER BY i)
        FROM (SELECT string_agg(lpad(bin(('0x' || substr(sha1(digests.payload), (j * 2 + 1)::BIGINT, 2))::BIGINT), 8, '0'), '' ORDER BY j) AS bits
              FROM range(20) AS t(j)), range(32) AS u(i)) AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM digests JOIN firsts ON digests.payload = firsts.payload
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_LEXICAL_RANK = rf"""
WITH said AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

_POSTINGS = ",\n    ".join(f"({i}, '{t.label}', {t.base}, '{w}', {pos}, {key})"
                          for i, t in enumerate(LIBRARY) for w, pos, key in t.words())

SQL_LICENSE_SCAN = rf"""
WITH library(tid, label, base, word, pos, key) AS (VALUES
    {_POSTINGS}),
sizes AS (SELECT tid, count(*) AS n, count(*) FILTER (key) AS n_keys FROM library GROUP BY tid),
files AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
hits AS (
  SELECT * FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS at FROM files) WHERE word IN (SELECT word FROM library)),
frequency AS (SELECT word, count(DISTINCT doc_id) AS df FROM hits GROUP BY word),
rare AS (
  SELECT doc_id, tid, pos FROM (SELECT DISTINCT doc_id, word FROM hits) JOIN library USING (word) JOIN frequency USING (word)
  QUALIFY row_number() OVER (PARTITION BY doc_id, tid ORDER BY df, word, pos) <= {RARE_WORDS}),
n_rare AS (SELECT doc_id, tid, count(*) AS wanted FROM rare GROUP BY doc_id, tid),
places AS (
  SELECT h.doc_id, l.tid, h.at - l.pos AS start, count(*) AS n, count(*) FILTER (l.key) AS n_keys, count(r.pos) AS agreed
  FROM hits h JOIN library l USING (word) LEFT JOIN rare r ON r.doc_id = h.doc_id AND r.tid = l.tid AND r.pos = l.pos
  GROUP BY ALL),
found AS (
  SELECT p.doc_id, p.tid, count(*) AS places, min(start) AS first, max(start) AS last, sum(p.n)::DOUBLE / (any_value(s.n) * count(*)) AS share
  FROM places p JOIN sizes s ON p.tid = s.tid AND p.n_keys = s.n_keys JOIN n_rare w ON w.doc_id = p.doc_id AND w.tid = p.tid AND p.agreed = w.wanted
  GROUP BY p.doc_id, p.tid),
good AS (
  SELECT found.*, label, base FROM found JOIN (SELECT DISTINCT tid, label, base FROM library) USING (tid) WHERE base OR share >= {MIN_SHARE}),
per_file AS (
  SELECT doc_id, (sum(places) FILTER (base))::BIGINT AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(share) AS score
  FROM good GROUP BY doc_id)
SELECT files.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM files LEFT JOIN per_file ON files.doc_id = per_file.doc_id
"""

SQL_SOURCE_DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
said AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT groups.lang, groups.source, term, lang_n, coalesce(n, 0) AS n
  FROM groups JOIN kept USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL) AS counts USING (lang, source, term)),
shares AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
  FROM cells WINDOW g AS (PARTITION BY lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) AS d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_line_dedup, op3_html_extraction, op4_decontamination, op5_quality_classifier,
    op6_secret_scan, op7_url_filter, op8_warc, op9_nearest_neighbours, op10_simhash,
    op11_lexical_rank, op12_license_scan, op13_source_divergence)}
ORACLES = {"op2_line_dedup": SQL_LINE_DEDUP, "op7_url_filter": SQL_URL_FILTER, "op8_warc": SQL_WARC, "op11_lexical_rank": SQL_LEXICAL_RANK,
           "op12_license_scan": SQL_LICENSE_SCAN, "op13_source_divergence": SQL_SOURCE_DIVERGENCE}
