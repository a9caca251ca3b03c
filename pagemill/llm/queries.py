"""Registered queries of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (
    decontaminate,
    language_models,
    order_minhash,
    pieces,
    secret_scan,
    simhash,
    source_divergence,
    spelling_variants,
    suffix_dedup,
    token_counts,
    url_rules,
    vector_tiles,
    warc_revisits,
)
from pagemill.llm.batches import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [  # host, path, verdict
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

SQL_URL = """WITH parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
  rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
  SELECT page_id, host, path, (SELECT arg_max(r_host || r_path, length(r_host || r_path)) FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host))
      AND starts_with(path, r_path)) AS rule,
    coalesce((SELECT arg_max(r_verdict, length(r_host || r_path)) FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host))
      AND starts_with(path, r_path)), 'allow') AS verdict FROM parts"""


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    found = pieces.encode_and_decode("text", model).alias("found")
    decoded = table(spark, folder, "documents").select("doc_id", "text", found).select("doc_id", "text", "found.*")
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


@query("op4_decontaminate")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.decontaminate(docs, benchmark).drop("text_hash")


@query("op5_url_rules", SQL_URL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rules = prepare(spark).createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_secret_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scanned = secret_scan.scan(docs, secret_scan.learn_formats(docs))
    counts = [secret_scan.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base_text = secret_scan.spans_text(F.col("base"))
    return scanned.select(
        "doc_id",
        *counts,
        F.sha2(base_text, 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
        secret_scan.count_kind(F.col("spans"), "format").alias("n_format"),
    )


@query("op7_order_minhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pairs = order_minhash.edited_pairs(table(spark, folder, "documents"))
    own, edited, after = F.col("sketches"), F.col("edited_sketches"), F.col("next_sketches")
    return pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.fingerprint_text(own).alias("fingerprint"),
        order_minhash.fingerprint_text(edited).alias("edited_fingerprint"),
        order_minhash.likeness(own, edited).alias("near_edited"),
        order_minhash.likeness(own, after).alias("near_next"),
    )


@query("op8_language_models")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = language_models.training_fold(F.col("doc_id"))
    classifier = language_models.train(docs.filter(fold != 2))
    judged = language_models.identify(docs, classifier)
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return judged.select("doc_id", held_out, "lang_pred", "score", "entropy", "rejected")


# Captures of the given pages: a full response, and two later checks that found nothing new.  Every third
# page's first check names another version, every fourth page's second check knows only the date.
CAPTURES = """
    SELECT page_id * 4 AS record_id, url, 'response' AS kind, 200 AS status, CAST(page_id * 600 AS BIGINT) AS seconds, md5(html) AS digest,
      concat('Content-Type: text/html', chr(13), chr(10), 'ETag: "', md5(html), '"', chr(13), chr(10), 'Last-Modified: ', CAST(length(html) % 97 AS STRING),
        chr(13), chr(10), 'Cache-Control: max-age=60', chr(13), chr(10), 'Content-Length: ', CAST(length(html) AS STRING)) AS block FROM pages
    UNION ALL SELECT page_id * 4 + 1, url, 'revisit', 304, CAST(page_id * 600 + 7 AS BIGINT), CAST(NULL AS STRING),
      concat('ETag: W/"', CASE WHEN page_id % 3 = 0 THEN 'old' ELSE md5(html) END, '"', chr(10), 'Cache-Control: max-age=', CAST(page_id % 900 AS STRING),
        chr(10), 'Content-Length: 0', chr(10), 'Age: 5') FROM pages
    UNION ALL SELECT page_id * 4 + 2, url, 'revisit', 304, CAST(page_id * 600 + 90000 AS BIGINT), CAST(NULL AS STRING),
      concat(CASE WHEN page_id % 4 = 0 THEN concat('Last-Modified: ', CAST(length(html) % 97 AS STRING)) ELSE concat('ETag: "', md5(html), '"') END,
        chr(10), 'Expires: never') FROM pages"""

SQL_WARC = rf"""WITH records AS ({CAPTURES.replace("STRING", "VARCHAR")}),
  cut AS (SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '(?s)#.*$', '') AS rest FROM records),
  known AS (SELECT record_id, kind, seconds, digest, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '(?s)^[^/?]*(.*)$', 1), '/+(\?|$)', '\1', 'g') AS canonical,
      [line FOR line IN str_split(replace(block, chr(13), ''), chr(10))] AS lines FROM cut),
  named AS (SELECT *, map_from_entries([struct_pack(k := lower(str_split(l, ':')[1]), v := substr(l, length(str_split(l, ':')[1]) + 3)) FOR l IN lines]) AS own FROM known),
  met AS (SELECT r.*, f.record_id AS f_id, f.own AS f_own, f.digest AS f_digest FROM (SELECT * FROM named WHERE kind = 'revisit') r
      ASOF LEFT JOIN (SELECT * FROM named WHERE kind = 'response') f ON r.canonical = f.canonical AND r.seconds > f.seconds),
  judged AS (SELECT *, CASE WHEN f_id IS NULL THEN 'no_response'
      WHEN own['etag'] IS NOT NULL THEN CASE WHEN ltrim(own['etag'], 'W/') = f_own['etag'] THEN 'resolved' ELSE 'mismatch' END
      WHEN own['last-modified'] = f_own['last-modified'] THEN 'resolved' ELSE 'mismatch' END AS outcome FROM met),
  merged AS (SELECT *, CASE WHEN outcome = 'resolved' THEN list_concat(
        [e FOR e IN map_entries(f_own) IF e.key = 'content-length' OR own[e.key] IS NULL],
        [e FOR e IN map_entries(own) IF e.key <> 'content-length']) ELSE map_entries(own) END AS entries FROM judged)
  SELECT record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN f_id END AS ref_id,
    array_to_string([e.key || ': ' || e.value FOR e IN list_sort(entries)], chr(10)) AS headers, CASE WHEN outcome = 'resolved' THEN f_digest END AS digest FROM merged
  UNION ALL SELECT record_id, canonical, 'full', NULL, array_to_string([e.key || ': ' || e.value FOR e IN list_sort(map_entries(own))], chr(10)), digest
    FROM named WHERE kind = 'response'"""


@query("op9_warc_revisits", SQL_WARC)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    captures = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    records = captures.withColumn("date", F.timestamp_seconds("seconds")).withColumn(
        "headers", warc_revisits.parse_headers(F.col("block"))
    )
    resolved = warc_revisits.resolve_revisits(records)
    return resolved.withColumn("headers", warc_revisits.header_lines(F.col("headers")))


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


SLIPS = 97  # one of so many different words of a document loses a character


# CRC-32 by its rule (reflected polynomial 0xEDB88320), then words that meet with one character left out
SQL_SPELLING = r"""WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
  d AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+') AS runs FROM documents),
  r AS (SELECT name, run, count(*) AS n FROM (SELECT name, unnest(runs) AS run FROM d) WHERE length(run) >= 5 GROUP BY name, run),
  h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(name || run)), '..')]),
     lambda c, b: xor(t[1 + xor(c & 255, b)], c >> 8)), 4294967295) AS h FROM r, t),
  w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY word
     HAVING length(word) >= 5 AND sum(n) >= 3),
  cut AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
  gaps AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM w),
  open AS (SELECT word, n, left(word, i) || '$' || substr(word, i + 2) AS k FROM cut),
  near AS (SELECT a.word AS a, b.word AS b, b.n AS m FROM open a JOIN open b ON a.k = b.k AND a.word <> b.word
    UNION SELECT c.word, g.word, g.n FROM open c JOIN (SELECT word, n, left(word, i) || '$' || substr(word, i + 1) AS k FROM gaps) g ON c.k = g.k
    UNION SELECT g.word, c.word, c.n FROM open c JOIN (SELECT word, n, left(word, i) || '$' || substr(word, i + 1) AS k FROM gaps) g ON c.k = g.k),
  best AS (SELECT a, count(*) AS n_near, arg_min(b, (-m, b)) AS b, arg_min(m, (-m, b)) AS m FROM near GROUP BY a),
  f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best ON a = word),
  chain AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
  roots AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
  SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)"""


@query("op11_spelling_variants", SQL_SPELLING)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, folder, "documents"), drop_every=SLIPS)


SQL_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN e IF x <> 0]) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
  least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
  counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
    vec_id <= coalesce(least.b, vec_id) AS kept
  FROM v LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id"""


@query("op12_vector_tiles", SQL_VECTORS)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vector_tiles.near_vectors(table(spark, folder, "embeddings"))


SQL_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
  found AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
  langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
  uses AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
  totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN uses USING (lang, source) GROUP BY lang, source),
  shares AS (SELECT t.lang, t.source, k.term, coalesce(u.n, 0) AS n,
      1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (t.total + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN uses u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term),
  pairs AS (SELECT a.lang, a.source, b.source AS item FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  items AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM items)
  SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query("op13_source_divergence", SQL_DIVERGENCE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergence(table(spark, folder, "documents"))
