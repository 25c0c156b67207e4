"""The registered queries of this subpackage, thin over its operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chunk_bpe, decontaminate, edit_counts, jaccard_join, langid, language_model, packed_ids, quality, reversed_search, secret_scan, source_audit, url_filter
from .common import bounded_batches, read_table
from .tokenizers_io import word_encoder

WORD_FILE, WORD_VOCABULARY, WORD_END = "word_bpe_49k.json", 49_408, 1
BYTE_FILE = "byte_bpe_50k.json"


def op1_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, from packed files written and read back."""
    path = public_tokenizers.path(WORD_FILE)
    manifest = packed_ids.write_packed(read_table(spark, sf_dir, "documents"), lambda: word_encoder(path, WORD_END), WORD_VOCABULARY)
    return packed_ids.read_packed(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    path = public_tokenizers.path(BYTE_FILE)
    ids = chunk_bpe.encode(read_table(spark, sf_dir, "documents"), path)
    return chunk_bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every embedding whose id is divisible by 20."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    return jaccard_join.join(read_table(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i : i + 2], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS m FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m)
SELECT n.doc_id, n AS n_shingles, min(m) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY 1, 2
"""

#: What the edit query takes out of each text: addresses, long numbers, links.
REDACTIONS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"https?://[^\s]+", "<link>"),
    (r"\+?[0-9](?:[0-9 .()-]{5,18})[0-9]", "<number>"),
    (r"[A-Za-z0-9_-]{32,}", "<key>"),
]


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its redactions."""
    edits = edit_counts.redactions(read_table(spark, sf_dir, "documents"), REDACTIONS)
    return edit_counts.count_with_edits(edits, public_tokenizers.path(BYTE_FILE))


#: (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

BLOCK_TERMS = ["ads", "adult", "banner", "bet", "bets", "casino", "porn", "track", "tracker", "xxx"]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages, learned from the pages whose document is labelled.

    The labelled URL table: pages whose path names a document with labels.  Junk
    and toxic documents count as pages to block, and so do hosts with a name
    part that is one of the listed terms.
    """
    pages = read_table(spark, sf_dir, "pages")
    named = pages.select("url", F.regexp_extract("url", "/([0-9]{1,18})(?:[./?#]|$)", 1).try_cast("long").alias("doc_id"))
    labelled = named.join(read_table(spark, sf_dir, "labels"), "doc_id").withColumn(
        "block", ((F.col("quality") == 0) | (F.col("toxic") == 1) | F.arrays_overlap(F.split(url_filter.host_of(F.col("url")), "[.-]"), F.array(*map(F.lit, BLOCK_TERMS)))).cast("int"))
    return url_filter.judge(pages, URL_RULES, url_filter.train(labelled))


def held_out(remainder: int, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under the model of those not held out."""
    scored = language_model.score(read_table(spark, sf_dir, "documents"), ~held_out(1, 5))
    return scored.select("doc_id", (~F.col("in_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out."""
    docs = read_table(spark, sf_dir, "documents")
    out = held_out(2, 4)
    net = langid.train(docs.filter(~out))
    return langid.identify(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; good ones are of quality and not toxic."""
    return read_table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents and whether they are kept."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, good_labels(spark, sf_dir))
    return quality.score(docs, model).withColumn("keep", F.col("quality") >= QUALITY_LEAST)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, with the contamination verdict."""
    found = decontaminate.find_windows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT cast(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, list_aggregate(w[i : i + least(13, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dwin.n, i, item FROM dwin JOIN win ON dwin.s = win.s AND dwin.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: the base kinds' numbers and digest, and all spans."""
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))

    def told(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, secret_scan.KINDS[:3]), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that set each apart."""
    return source_audit.audit(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT lang, source, row_number() OVER () AS row, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT lang, row, term FROM t) GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
own AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM own JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p AS x JOIN p AS y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return reversed_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT count(*) AS docs, sum(len(w)) AS length FROM d WHERE len(w) > 0),
it AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
dt AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN it USING (term) GROUP BY ALL),
wt AS (SELECT term, cast(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM dt, f GROUP BY term),
s AS (
  SELECT item, item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS score
  FROM dt JOIN wt USING (term) JOIN it USING (term), f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, cast(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""

QUALITY_LEAST = 0.4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packed_ids": op1_packed_ids,
    "op2_url_filter": op2_url_filter,
    "op3_chunk_bpe": op3_chunk_bpe,
    "op4_neighbours": op4_neighbours,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_edit_counts": op6_edit_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_langid": op8_langid,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_secret_scan": op11_secret_scan,
    "op12_source_audit": op12_source_audit,
    "op13_reversed_search": op13_reversed_search,
}


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bounded(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": OP5_SQL, "op10_decontaminate": OP10_SQL, "op12_source_audit": OP12_SQL, "op13_reversed_search": OP13_SQL}
