"""Embedding and vector-table operators over documents, chunks and the given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.operators import embed, vectors
from pagemill.plans import query, sql
from pagemill.session import cut_lineage, scratch_dir

MODEL = "hashing-64"


@query("emb_content_hash", f"SELECT doc_id, sha256({sql.strip('text')}) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", embed.content_key(F.col("text")).alias("hash"))


@query(
    "emb_query_prefix",
    f"""SELECT conv_id, turn, {sql.lit(fv.QUERY_PREFIX)} || text AS bge, text AS other FROM conversations""",
)
def _(t):
    return t.conversations.select(
        "conv_id", "turn",
        embed.query_text(F.col("text"), "bge-small-en-v1.5").alias("bge"),
        embed.query_text(F.col("text"), MODEL).alias("other"),
    )


def chunk_docs(t):
    """All documents with their whole texts, and a blank one per region, to meet every state."""
    blank = t.region.select(
        (-1 - F.col("r_regionkey")).cast("long").alias("doc_id"), F.lit("  ").alias("text"),
        F.lit("en").alias("lang"), F.lit("blank").alias("source"),
    )
    return t.documents.select("doc_id", "text", "lang", "source").unionByName(blank)


def doc_chunks(t):
    """Documents as chunks."""
    meta = F.struct(
        F.concat(F.lit("https://docs.example.com/"), F.col("doc_id")).alias("source_url"),
        F.col("source").alias("title"),
        F.lit("general").alias("category"),
        F.col("lang").alias("heading"),
        F.when(F.col("lang") == "en", "website").alias("source_type"),
        F.col("source").alias("collection"),
    )
    return chunk_docs(t).select(
        F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"),
        F.col("text").alias("content"),
        meta.alias("metadata"),
        F.col("doc_id").alias("pos"),
    )


def doc_cache(t):
    """A cache that knows the labelled documents, some of them with a vector of a wrong size."""
    known = t.documents.join(t.labels, "doc_id", "left_semi")
    hashed = known.groupBy(embed.content_key(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("d"))
    dim = F.when(F.col("d") % 10 == 0, 3).otherwise(64)
    vector = F.transform(F.sequence(F.lit(1), dim), lambda i: (i / 64.0).cast("float"))
    return hashed.select(
        F.lit(MODEL).alias("model"), "content_hash", vector.alias("embedding"),
        F.struct(F.concat(F.lit("c"), F.col("d")).alias("chunk_id")).alias("metadata"),
    )


STATES = f"""d AS (SELECT doc_id, text, source, lang FROM documents UNION ALL SELECT -1 - r_regionkey, '  ', 'blank', 'en' FROM region),
    h AS (SELECT doc_id, text, source, lang, {sql.strip('text')} = '' AS blank, sha256({sql.strip('text')}) AS hash FROM d),
    cache AS (SELECT hash, min(doc_id) % 10 = 0 AS broken FROM h WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY hash),
    st AS (SELECT h.*, broken, CASE WHEN blank THEN 'failed' WHEN row_number() OVER (PARTITION BY hash, blank ORDER BY doc_id) > 1 THEN 'duplicate'
      WHEN broken IS NULL THEN 'pending' WHEN broken THEN 'failed' ELSE 'cached' END AS state FROM h LEFT JOIN cache USING (hash))"""


@query(
    "emb_partition_inputs",
    f"""WITH {STATES} SELECT doc_id AS pos, state, CASE WHEN state = 'failed' THEN CASE WHEN blank THEN 'empty content' ELSE 'invalid cached embedding' END END AS reason FROM st""",
)
def _(t):
    states = embed.partition_inputs(doc_chunks(t), doc_cache(t), MODEL, 64, ["pos"])
    return states.select("pos", "state", "reason")


@query(
    "emb_cache_lookup",
    f"""WITH {STATES} SELECT doc_id, broken IS NOT NULL AS hit, CASE WHEN broken THEN 3 WHEN NOT broken THEN 64 END AS dims FROM st""",
)
def _(t):
    keyed = chunk_docs(t).select("doc_id", embed.content_key(F.col("text")).alias("content_hash"))
    found = embed.lookup_cache(keyed, doc_cache(t), MODEL)
    return found.select(
        "doc_id",
        F.col("cached").isNotNull().alias("hit"),
        F.when(F.col("cached").isNotNull(), F.size("cached")).alias("dims"),
    )


def embedded(t):
    return embed.embed_chunks(doc_chunks(t), doc_cache(t), MODEL, 64, ["pos"])


@query(
    "emb_cache_write",
    f"WITH {STATES} SELECT hash AS content_hash, 'c' || doc_id AS chunk_id FROM st WHERE state = 'pending'",
)
def _(t):
    rows = cut_lineage(embedded(t), "embedded")
    added = embed.cache_additions(rows, doc_cache(t), MODEL)
    return added.select("content_hash", F.col("metadata.chunk_id").alias("chunk_id"))


@query(
    "emb_encode",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
    h AS (SELECT doc_id, CAST('0x' || left(sha256(word), 8) AS BIGINT) AS h FROM w),
    v AS (SELECT doc_id, (h // 2) % 64 AS dim, sum(CASE WHEN h % 2 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY ALL)
    SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 4) AS value FROM v WHERE x <> 0""",
)
def _(t):
    coded = embed.encode_texts(t.documents.select("doc_id", "text"), "text")
    flat = coded.select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    return flat.filter(F.col("x") != 0).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 4).alias("value")
    )


@query("emb_validate", "SELECT vec_id, label <> 3 AS ok FROM embeddings")
def _(t):
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return t.embeddings.select("vec_id", embed.valid_vector(cut, F.lit(64)).alias("ok"))


@query(
    "emb_record",
    f"""WITH {STATES} SELECT 'c' || doc_id AS id, length({sql.strip('text')}) AS chars, 'd' || doc_id AS document_id, source AS title, lang AS heading,
      'website' AS source_type, source AS collection FROM st WHERE state IN ('pending', 'cached')""",
)
def _(t):
    records = embed.embedding_records(embedded(t))
    m = F.col("metadata")
    return records.select(
        "id", F.length("document").alias("chars"), m["document_id"].alias("document_id"), m["title"].alias("title"),
        m["heading"].alias("heading"), m["source_type"].alias("source_type"), m["collection"].alias("collection"),
    )


@query(
    "emb_failures",
    f"""WITH {STATES} SELECT 'c' || doc_id AS id, CASE WHEN blank THEN 'empty content' ELSE 'invalid cached embedding' END AS error FROM st WHERE state = 'failed'""",
)
def _(t):
    return embed.embedding_failures(embedded(t)).select("id", "error")


@query(
    "emb_summary",
    f"""WITH {STATES} SELECT count(*) AS total_chunks, count(*) FILTER (state IN ('pending', 'cached')) AS embedded, count(*) FILTER (state = 'cached') AS cached,
      count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'duplicate') AS duplicates FROM st""",
)
def _(t):
    return embed.embedding_summary(embedded(t))


# --- vector table: the given vectors as records, each sent twice, some broken ----------------------

def sent_records(t):
    """Every vector twice; the rows of one label lack a document, of another a metadata field."""
    label = F.col("label")
    meta = F.struct(
        F.concat(F.lit("v"), F.col("vec_id")).alias("chunk_id"),
        F.concat(F.lit("d"), F.col("vec_id")).alias("document_id"),
        F.lit("https://v.example.com/").alias("source_url"),
        F.lit("t").alias("title"),
        F.when(label != 4, "general").alias("category"),
        F.when(label != 4, "h").alias("heading"),
        F.lit("website").alias("source_type"),
        F.concat(F.lit("col_"), label).alias("collection"),
    )
    twice = t.embeddings.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return twice.select(
        F.when(label != 5, F.concat(F.lit("v"), F.col("vec_id"))).otherwise("").alias("id"),
        F.when(label == 6, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("embedding"),
        F.when(label == 7, " ").otherwise(F.concat(F.lit("text "), F.col("vec_id"))).alias("document"),
        meta.alias("metadata"),
        (F.col("vec_id") * 2 + F.col("copy")).alias("pos"),
    )


def stored_ids(t):
    return t.embeddings.filter(F.col("label") == 1).select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"))


SENT = """s AS (SELECT vec_id, label, vec_id * 2 + copy AS pos, copy, CASE label WHEN 5 THEN 'missing id' WHEN 7 THEN 'empty document' WHEN 6 THEN 'missing embedding'
      WHEN 4 THEN 'missing metadata fields: category, heading' ELSE '' END AS problem FROM embeddings, (SELECT unnest([0, 1]) AS copy)),
    o AS (SELECT *, CASE WHEN problem <> '' THEN 'failure' WHEN label = 1 OR copy = 1 THEN 'duplicate' ELSE 'insert' END AS outcome FROM s)"""


@query("vec_validate", f"WITH {SENT} SELECT pos, problem FROM s")
def _(t):
    return sent_records(t).select("pos", vectors.record_problem().alias("problem"))


@query(
    "vec_metadata_coerce",
    f"""WITH {SENT} SELECT pos, 'v' || vec_id AS chunk_id, CASE WHEN label = 4 THEN '' ELSE 'general' END AS category, 'col_' || label AS collection FROM s""",
)
def _(t):
    coerced = sent_records(t).select("pos", vectors.coerce_metadata().alias("m"))
    return coerced.select("pos", "m.chunk_id", "m.category", "m.collection")


@query("vec_existing_ids", "SELECT 'v' || vec_id AS id FROM embeddings WHERE label = 1")
def _(t):
    asked = t.embeddings.select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"))
    return vectors.existing_ids(stored_ids(t), asked)


@query("vec_insert_new", f"WITH {SENT} SELECT pos, outcome FROM o")
def _(t):
    return vectors.plan_insert(sent_records(t), stored_ids(t), ["pos"]).select("pos", "outcome")


@query(
    "vec_insert_summary",
    f"""WITH {SENT} SELECT count(*) FILTER (outcome = 'insert') AS vectors_inserted, count(*) FILTER (outcome = 'duplicate') AS duplicates_skipped,
      count(*) FILTER (outcome = 'failure') AS insert_failures FROM o""",
)
def _(t):
    return vectors.insert_summary(vectors.plan_insert(sent_records(t), stored_ids(t), ["pos"]))


def _table(t):
    """Two batches: all vectors, then those of label 2 again with a new text."""
    meta = F.struct(*[F.lit("x").alias(f) for f in fv.METADATA_FIELDS[:-1]], F.concat(F.lit("col_"), F.col("label")).alias("collection"))
    first = t.embeddings.select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("id"), "embedding", F.lit("old").alias("document"), meta.alias("metadata"), "label"
    )
    second = first.filter(F.col("label") == 2).withColumn("document", F.lit("new"))
    table = vectors.VectorTable(t.spark, scratch_dir(t.spark, "vector-table"))
    table.write(first, 0)
    table.write(second, 1)
    table.write(second, 1)
    return table


@query("vec_upsert", "SELECT 'v' || vec_id AS id, 'col_' || label AS collection, CASE WHEN label = 2 THEN 'new' ELSE 'old' END AS document FROM embeddings")
def _(t):
    return _table(t).read().select("id", "collection", "document")


@query("vec_count", "SELECT 'col_' || label AS collection, count(*) AS vectors FROM embeddings GROUP BY 1")
def _(t):
    return _table(t).counts()


@query("vec_list", "SELECT DISTINCT 'col_' || label AS collection FROM embeddings")
def _(t):
    return _table(t).collections()


@query("vec_drop", "SELECT 'col_' || label AS collection, count(*) AS vectors FROM embeddings WHERE label <> 2 GROUP BY 1")
def _(t):
    return _table(t).drop("col_2").counts()


@query(
    "ret_resolve_collection",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'rag_documents' ELSE 'col_' || (o_custkey % 10) END AS resolved FROM orders""",
)
def _(t):
    counts = vectors.collection_counts(t.embeddings.select(F.when(F.col("label") == 0, fv.LEGACY_COLLECTION).otherwise("other").alias("collection")))
    asked = F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.concat(F.lit("col_"), F.col("o_custkey") % 10))
    requests = t.orders.select("o_orderkey", asked.alias("collection"))
    return vectors.resolve_collection(requests, counts).select("o_orderkey", "resolved")
