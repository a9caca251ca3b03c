"""Retrieval, ranking, confidence and answers.

Every given vector is asked within the collection of its label: as it is (labels below 5) and with
its components reversed (labels from 3), so that some questions have two sub-questions.  The
document of the same number is its text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions import scores
from pagemill.operators import retrieve
from pagemill.plans import query, sql
from pagemill.plans.text_queries import _CHUNKED, chunked_text

# --- Spark side ----------------------------------------------------------------------------


def stored(t):
    return t.embeddings.select(
        F.concat(F.lit("col_"), F.col("label")).alias("collection"),
        F.concat(F.lit("v"), F.col("vec_id")).alias("id"),
        "embedding",
    )


def asked(t):
    label = F.col("label")
    plain = F.struct(F.lit(0).alias("sub_idx"), F.col("embedding").alias("e"))
    turned = F.struct(F.lit(1).alias("sub_idx"), F.reverse("embedding").alias("e"))
    subs = F.when(label < 3, F.array(plain)).when(label < 5, F.array(plain, turned)).otherwise(F.array(turned))
    return t.embeddings.select(
        F.col("vec_id").alias("question_id"),
        F.concat(F.lit("col_"), label).alias("collection"),
        F.explode(subs).alias("s"),
    ).select("question_id", F.col("s.sub_idx").alias("sub_idx"), "collection", F.col("s.e").alias("embedding"))


def hits(t):
    return retrieve.nearest_vectors(asked(t), stored(t))


def cands(t, max_distance: float = 1.6):
    return retrieve.candidates(hits(t), max_distance)


def chunk_rows(documents):
    meta = F.struct(F.col("source").alias("title"), F.col("lang").alias("heading"))
    return documents.select(
        F.concat(F.lit("v"), F.col("doc_id")).alias("chunk_id"),
        chunked_text().alias("document"),
        meta.alias("metadata"),
    )


def stored_chunks(t):
    """The chunks that have a vector: no other can be a candidate, so no other text is worked on.

    They may lie close together in the table, so they are dealt out by the key that they are met by.
    """
    held = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    return chunk_rows(t.documents.join(held, "doc_id", "left_semi")).repartition("chunk_id")


def sub_counts(t):
    """How many sub-questions each question has, as ``asked`` makes them."""
    label = F.col("label")
    subs = F.when((label >= 3) & (label < 5), F.lit(2)).otherwise(F.lit(1)).cast("long")
    return t.embeddings.select(F.col("vec_id").cast("string").alias("question_id"), subs.alias("subs"))


def question_rows(t):
    texts = t.documents.select(F.col("doc_id").cast("string").alias("question_id"), "text")
    return sub_counts(t).join(texts, "question_id").repartition("question_id")  # as in stored_chunks


def flagged(t):
    return cands(t).join(sub_counts(t), "question_id").withColumn("skip", retrieve.skip_rerank(F.col("subs")))


def scored(t):
    """Candidates with skip flag and pair score; only keywords are met, texts stay where they are until ``accepted``.

    A skipped question has no pair score, so no keywords travel for it.
    """
    from pagemill.functions import text

    questions = question_rows(t).select("question_id", text.keywords(F.col("text")).alias("qk"))
    chunks = stored_chunks(t).select("chunk_id", text.keywords(retrieve.rank_text()).alias("ck"))
    found = flagged(t).join(chunks, "chunk_id").withColumn("ck", F.when(~F.col("skip"), F.col("ck")))
    found = found.join(questions, "question_id")
    raw = F.when(~F.col("skip"), text.overlap(F.col("qk"), F.col("ck")))
    return found.withColumn("raw_score", raw).drop("qk", "ck")


def ranked(t):
    return retrieve.rerank(scored(t))


def accepted(t):
    return retrieve.accept(ranked(t)).join(retrieve.with_judgements(stored_chunks(t)), "chunk_id")


# --- SQL side --------------------------------------------------------------------------------

HITS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    q AS (SELECT vec_id, label, 0 AS sub_idx, e FROM e WHERE label < 5 UNION ALL SELECT vec_id, label, 1, list_reverse(e) FROM e WHERE label >= 3),
    d AS (SELECT CAST(q.vec_id AS VARCHAR) AS question_id, sub_idx, 'v' || e.vec_id AS id, round(pow(list_distance(q.e, e.e), 2), 9) AS distance FROM q JOIN e ON q.label = e.label),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, sub_idx ORDER BY distance, id) AS rank FROM d) WHERE rank <= 20)"""


def _cands(floor: float) -> str:
    return f"""{HITS}, sem AS (SELECT *, greatest(0.0, 1.0 - distance / 2.0) AS semantic_score FROM hits),
    near AS (SELECT * FROM sem WHERE semantic_score >= {floor!r}),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY question_id, id ORDER BY sub_idx, rank) AS rn FROM near),
    cands AS (SELECT question_id, id AS chunk_id, semantic_score, row_number() OVER (PARTITION BY question_id ORDER BY sub_idx, rank) AS cand_pos FROM firsts WHERE rn = 1)"""


FLOOR = 1.0 - 1.6 / 2.0
_BODY = sql.body("document")
DOCS = f"""docs AS (SELECT doc_id, text, source AS title, lang AS heading, {_CHUNKED} AS document FROM documents),
    texts AS (SELECT *, {_BODY} AS body FROM docs),
    rtexts AS (SELECT *, title || ' ' || heading || ' ' || {sql.compact('body', 1000)} AS rank_text FROM texts),
    kws AS (SELECT *, {sql.keywords('text')} AS qk, {sql.keywords('rank_text')} AS ck FROM rtexts)"""
SCORED = f"""{_cands(FLOOR)}, {DOCS}, subs AS (SELECT CAST(vec_id AS VARCHAR) AS question_id, count(*) AS subs FROM q GROUP BY 1),
    flagged AS (SELECT c.*, subs = 1 AND max(CASE WHEN cand_pos = 1 THEN semantic_score END) OVER (PARTITION BY c.question_id) > 0.82 AS skip
      FROM cands c JOIN subs USING (question_id)),
    scored AS (SELECT f.*, CASE WHEN NOT skip THEN CASE WHEN len(a.qk) = 0 THEN 0.0 ELSE len(list_intersect(a.qk, b.ck)) / CAST(len(a.qk) AS DOUBLE) END END AS raw_score,
      b.document, b.title, b.heading, b.body, b.rank_text
      FROM flagged f JOIN kws a ON a.doc_id = CAST(f.question_id AS BIGINT) JOIN kws b ON 'v' || b.doc_id = f.chunk_id)"""
RANKED = f"""{SCORED}, mm AS (SELECT *, min(raw_score) OVER w AS lo, max(raw_score) OVER w AS hi FROM scored WINDOW w AS (PARTITION BY question_id)),
    sm AS (SELECT *, CASE WHEN skip THEN 0.0 ELSE 0.05 + 0.9 * CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 0.5 ELSE (raw_score - lo) / (hi - lo) END END AS rerank_score FROM mm),
    fused AS (SELECT *, CASE WHEN skip THEN semantic_score ELSE 0.75 * rerank_score + 0.25 * semantic_score END AS final_score FROM sm),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN skip THEN 0.0 ELSE -final_score END, cand_pos) AS rank FROM fused)"""
ACCEPTED = f"""{RANKED}, good AS (SELECT *, bool_or(semantic_score >= 0.2 AND rerank_score >= 0.0) OVER (PARTITION BY question_id) AS anyone FROM ranked),
    placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM good WHERE NOT anyone OR semantic_score >= 0.2),
    accepted AS (SELECT * FROM placed WHERE place <= 5)"""
_REFUSAL = "|".join(fv.REFUSAL_PHRASES).replace("'", "''")
CONF = f"""{ACCEPTED}, g AS (SELECT question_id, avg(semantic_score) AS s, list_sort(list(rerank_score), 'DESC') AS r, arg_min(final_score, place) AS t, count(*) AS n,
      avg(CASE WHEN regexp_matches(lower(document), '{_REFUSAL}') THEN 1.0 ELSE 0.0 END) AS refused FROM accepted GROUP BY question_id),
    f AS (SELECT *, 1.0 / (1.0 + exp(-(r[1] - coalesce(r[2], 0.0)))) AS rr, n / (n + 2.0) AS grounding FROM g),
    conf AS (SELECT *, round_even(greatest(0.0, least(1.0, 0.30 * s + 0.35 * rr + 0.27 * t + 0.08 * grounding + 0.03)), 2) AS confidence FROM f),
    labelled AS (SELECT *, CASE WHEN confidence >= 0.65 THEN 'high' WHEN confidence >= 0.40 THEN 'med' ELSE 'low' END AS confidence_label FROM conf)"""

# --- vectors and scores ---------------------------------------------------------------------------


def _r(c, n=6):
    return F.round(c, n)


@query("ret_topk", f"WITH {HITS} SELECT question_id, sub_idx, id, round(distance, 6) AS distance, rank FROM hits")
def _(t):
    return hits(t).withColumn("distance", _r("distance"))


@query("ret_semantic_score", f"WITH {_cands(FLOOR)} SELECT question_id, sub_idx, id, round(semantic_score, 6) AS score FROM sem")
def _(t):
    return hits(t).select("question_id", "sub_idx", "id", _r(scores.semantic_score(F.col("distance"))).alias("score"))


@query(
    "ret_cosine",
    """SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))))), 6) AS cosine FROM embeddings""",
)
def _(t):
    return t.embeddings.select("vec_id", _r(scores.cosine(F.col("embedding"), F.reverse("embedding"))).alias("cosine"))


@query("sigmoid", "SELECT event_id, round(1.0 / (1.0 + exp(-(value - 10.0))), 6) AS s FROM events")
def _(t):
    return t.events.select("event_id", _r(scores.sigmoid(F.col("value") - 10.0)).alias("s"))


@query("ret_min_score", f"WITH {_cands(0.425)} SELECT question_id, sub_idx, id FROM near")
def _(t):
    floor = scores.minimum_semantic_score()
    near = hits(t).filter(scores.semantic_score(F.col("distance")) >= floor)
    return near.select("question_id", "sub_idx", "id")


@query(
    "ret_subquestions",
    f"""WITH q AS (SELECT doc_id AS question_id, {sql.strip('text')} AS text FROM documents WHERE {sql.strip('text')} <> '')
    SELECT question_id, coalesce(turn, 0) AS sub_idx, coalesce(c.text, q.text) AS sub_text FROM q
      LEFT JOIN (SELECT * FROM conversations WHERE {sql.strip('text')} <> '') c ON conv_id = question_id""",
)
def _(t):
    expansions = t.conversations.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("sub_idx"), "text")
    questions = t.documents.select(F.col("doc_id").alias("question_id"), "text")
    subs = retrieve.sub_questions(questions, expansions)
    return subs.select("question_id", "sub_idx", "sub_text")


@query("ret_merge_subquestions", f"WITH {_cands(FLOOR)} SELECT question_id, chunk_id, round(semantic_score, 6) AS score, cand_pos FROM cands")
def _(t):
    return cands(t).select("question_id", "chunk_id", _r("semantic_score").alias("score"), "cand_pos")


@query("rank_skip_rule", f"WITH {SCORED} SELECT question_id, bool_or(skip) AS skip, count(*) AS candidates FROM flagged GROUP BY 1")
def _(t):
    return flagged(t).groupBy("question_id").agg(F.bool_or("skip").alias("skip"), F.count("*").alias("candidates"))


@query("rank_text", f"WITH {DOCS} SELECT 'v' || doc_id AS chunk_id, rank_text FROM rtexts")
def _(t):
    return chunk_rows(t.documents).select("chunk_id", retrieve.rank_text().alias("rank_text"))


@query("rank_score", f"WITH {SCORED} SELECT question_id, chunk_id, round(raw_score, 6) AS raw_score FROM scored")
def _(t):
    return scored(t).select("question_id", "chunk_id", _r("raw_score").alias("raw_score"))


def _shared_words():
    """A stand-in for a model: the share of the question's distinct words that the chunk has."""

    def score(pairs):
        split = [(set(q.split(" ")) - {""}, set(c.split(" ")) - {""}) for q, c in pairs]
        return [len(q & c) / max(1, len(q)) for q, c in split]

    return score


@query(
    "rank_pair_model",
    """WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(string_split(text, ' ')), lambda x: x <> '') AS ws FROM conversations),
    p AS (SELECT a.conv_id, a.turn, a.ws AS q, b.ws AS c FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, round(len(list_intersect(q, c)) / greatest(1, len(q)), 6) AS score FROM p""",
)
def _(t):
    """Every turn against the next one, scored in batches by a model that is loaded on the workers."""
    after = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chunk"))
    pairs = t.conversations.select("conv_id", "turn", "text").join(after, ["conv_id", "turn"])
    score = retrieve.pair_scorer(_shared_words)(F.col("text"), F.col("chunk"))
    return pairs.select("conv_id", "turn", F.round(score, 6).alias("score"))


@query("rank_minmax_smooth", f"WITH {RANKED} SELECT question_id, chunk_id, round(rerank_score, 6) AS rerank_score FROM sm")
def _(t):
    return ranked(t).select("question_id", "chunk_id", _r("rerank_score").alias("rerank_score"))


@query("rank_fuse_sort", f"WITH {RANKED} SELECT question_id, chunk_id, round(final_score, 6) AS final_score, rank FROM ranked")
def _(t):
    return ranked(t).select("question_id", "chunk_id", _r("final_score").alias("final_score"), "rank")


@query("conf_filter", f"WITH {ACCEPTED} SELECT question_id, chunk_id, place FROM accepted")
def _(t):
    return accepted(t).select("question_id", "chunk_id", "place")


@query("conf_topk_rule", "SELECT o_orderkey, CAST(greatest(1, least(greatest(1, o_custkey % 9 - 1), 5)) AS INT) AS k FROM orders")
def _(t):
    asked_k = (F.col("o_custkey") % 9 - 1).cast("int")
    return t.orders.select("o_orderkey", scores.final_top_k(asked_k).alias("k"))


@query("conf_score", f"WITH {CONF} SELECT question_id, confidence FROM conf")
def _(t):
    return retrieve.confidence(accepted(t)).select("question_id", "confidence")


@query("conf_answerability", f"WITH {CONF} SELECT question_id, round_even((1.0 - refused) * 100.0, 2) AS answerability FROM f")
def _(t):
    return retrieve.confidence(accepted(t)).select("question_id", "confidence_factors.answerability")


@query(
    "conf_factors_pct",
    f"""WITH {CONF} SELECT question_id, round_even(s * 100.0, 2) AS semantic, round_even(rr * 100.0, 2) AS rerank, round_even(t * 100.0, 2) AS top_score,
      round_even((1.0 - refused) * 100.0, 2) AS answerability, round_even(grounding * 100.0, 2) AS grounding FROM f""",
)
def _(t):
    done = retrieve.confidence(accepted(t))
    return done.select("question_id", *[f"confidence_factors.{c}" for c in ("semantic", "rerank", "top_score", "answerability", "grounding")])


@query("conf_label", f"WITH {CONF} SELECT question_id, confidence_label FROM labelled")
def _(t):
    return retrieve.confidence(accepted(t)).select("question_id", "confidence_label")


# --- answers ---------------------------------------------------------------------------------------

_ANSWER = f"array_to_string(list_filter(list(CASE WHEN place <= 3 THEN {sql.compact('body', 250)} ELSE '' END ORDER BY place), lambda b: b <> ''), chr(10) || chr(10))"


def results(t):
    return retrieve.query_results(question_rows(t), accepted(t))


RESULTS = f"""{CONF}, answers AS (SELECT question_id, {_ANSWER} AS answer, string_agg(chunk_id, ',' ORDER BY place) AS chunk_ids FROM accepted GROUP BY 1),
    seen AS (SELECT question_id, count(*) AS retrieved FROM scored GROUP BY 1),
    base AS (SELECT question_id, {sql.strip('text')} AS question FROM subs JOIN documents ON CAST(doc_id AS VARCHAR) = question_id)"""


@query(
    "ret_reject_empty",
    f"""WITH {RESULTS} SELECT question_id, answer IS NOT NULL AS answered, coalesce(confidence, 0.0) AS confidence, coalesce(confidence_label, 'low') AS confidence_label,
      coalesce(answer, {sql.lit(fv.EMPTY_RESULT_ANSWER)}) AS answer FROM base LEFT JOIN answers USING (question_id) LEFT JOIN labelled USING (question_id)""",
)
def _(t):
    return results(t).select(
        "question_id", F.col("chunks").isNotNull().alias("answered"), "confidence", "confidence_label", "answer"
    )


@query("ans_extractive", f"WITH {RESULTS} SELECT question_id, answer FROM answers")
def _(t):
    nested = accepted(t).groupBy("question_id").agg(retrieve.ranked_chunks("excerpt").alias("c"))
    return nested.select("question_id", retrieve.extractive_answer(F.col("c"), "excerpt").alias("answer"))


def _prompt(x: str) -> str:
    return sql.strip(f"translate({x}, '<>', '  ')")


_CONTEXT = f"""left(string_agg(chr(10) || '[S' || place || ']' || chr(10) || chr(10) || 'TITLE:' || chr(10) || title || chr(10) || chr(10) || 'HEADING:' || chr(10) || heading
    || chr(10) || chr(10) || 'CONTENT:' || chr(10) || {_prompt(sql.compact('body', 1200))} || chr(10), chr(10) || chr(10) ORDER BY place), 7000)"""


@query("ans_context_block", f"WITH {ACCEPTED} SELECT question_id, {_CONTEXT} AS context FROM accepted GROUP BY 1")
def _(t):
    nested = accepted(t).groupBy("question_id").agg(retrieve.ranked_chunks().alias("c"))
    return nested.select("question_id", retrieve.context_block(F.col("c")).alias("context"))


_RULES = "\n".join(fv.BASE_CONSTRAINTS)
_PROMPT_SQL = f"""'<role>' || chr(10) || 'Helper of ' || question_id || chr(10) || '</role>' || chr(10) || chr(10) || '<context>' || chr(10) || context || chr(10) || '</context>'
    || chr(10) || chr(10) || '<question>' || chr(10) || {_prompt('question')} || chr(10) || '</question>' || chr(10) || chr(10) || '<constraints>' || chr(10)
    || {sql.lit(fv.CUSTOM_CONSTRAINTS_LEAD)} || chr(10) || '- Be brief.' || chr(10) || '- Quote ' || question_id || chr(10) || chr(10) || {sql.lit(fv.BASE_CONSTRAINTS_LEAD)} || chr(10)
    || {sql.lit(_RULES)} || chr(10) || chr(10) || '</constraints>' || chr(10) || chr(10) || 'Answer:' || chr(10)"""


@query(
    "ans_prompt",
    f"WITH {RESULTS}, ctx AS (SELECT question_id, {_CONTEXT} AS context FROM accepted GROUP BY 1) SELECT question_id, {_PROMPT_SQL} AS prompt FROM ctx JOIN base USING (question_id)",
)
def _(t):
    nested = accepted(t).groupBy("question_id").agg(retrieve.ranked_chunks().alias("c"))
    joined = nested.join(question_rows(t), "question_id")
    constraints = F.array(F.lit("- Be brief."), F.lit("be  BRIEF."), F.concat(F.lit("* Quote "), F.col("question_id")))
    prompt = retrieve.answer_prompt(
        F.concat(F.lit("Helper of "), F.col("question_id")), F.col("text"),
        retrieve.context_block(F.col("c")), constraints,
    )
    return joined.select("question_id", prompt.alias("prompt"))


@query(
    "ans_clean",
    f"""SELECT conv_id, turn, regexp_replace(regexp_replace({sql.strip('text')}, '^(?i)\\s*answer\\s*:\\s*', ''), '\\n{{3,}}', chr(10) || chr(10), 'g') AS answer FROM conversations""",
)
def _(t):
    said = F.concat(F.lit(" Answer : "), F.col("text"))
    return t.conversations.select("conv_id", "turn", retrieve.clean_answer(said).alias("answer"))


@query(
    "ans_is_bad",
    f"""SELECT conv_id, turn, {sql.strip('text')} = '' OR role = 'system' OR regexp_matches(lower(text), '{"|".join(fv.BAD_ANSWER_PHRASES).replace("'", "''")}') AS bad FROM conversations""",
)
def _(t):
    said = F.when(F.col("role") == "system", F.concat(F.col("text"), F.lit(" Not PROVIDED."))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", retrieve.is_bad_answer(said).alias("bad"))


@query(
    "ret_metrics",
    f"""WITH {RESULTS}, m AS (SELECT question_id, {sql.tok_estimate('question')} AS i, {sql.tok_estimate('answer')} AS o, retrieved, n, s, r FROM base JOIN answers USING (question_id) JOIN seen USING (question_id) JOIN g USING (question_id))
    SELECT question_id, i AS input_tokens, o AS output_tokens, i + o AS total_tokens, round_even(o / 0.25, 2) AS throughput_tokens_per_sec, retrieved AS retrieved_chunks,
      n AS accepted_chunks, round(s, 6) AS avg_semantic_score, round(list_sum(r) / n, 6) AS avg_rerank_score FROM m""",
)
def _(t):
    from pagemill.functions.text import estimate_tokens

    done = results(t).filter(F.col("chunks").isNotNull())
    metrics = retrieve.answer_metrics(
        estimate_tokens(F.col("question")), estimate_tokens(F.col("answer")), F.lit(250.0)
    )
    counted = ["input_tokens", "output_tokens", "total_tokens", "throughput_tokens_per_sec", "retrieved_chunks", "accepted_chunks"]
    # the metric's own four decimals fall on exact halves, which engines round apart
    return done.withColumn("m", metrics).select(
        "question_id", *[f"m.{c}" for c in counted], _r("avg_semantic_score").alias("avg_semantic_score"),
        _r("avg_rerank_score").alias("avg_rerank_score"),
    )


@query(
    "ret_result",
    f"""WITH {RESULTS} SELECT question_id, question, coalesce(answer, {sql.lit(fv.EMPTY_RESULT_ANSWER)}) AS answer, coalesce(confidence, 0.0) AS confidence,
      coalesce(chunk_ids, '') AS chunk_ids, coalesce(retrieved, 0) AS retrieved_chunks FROM base LEFT JOIN answers USING (question_id)
      LEFT JOIN labelled USING (question_id) LEFT JOIN seen USING (question_id)""",
)
def _(t):
    return results(t).select(
        "question_id", "question", "answer", "confidence",
        F.coalesce(F.array_join("chunks.chunk_id", ","), F.lit("")).alias("chunk_ids"), "retrieved_chunks",
    )
