"""Batch retrieval: exact nearest vectors, reranking, confidence and answers per question."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed_values as fv
from pagemill.functions import scores, text
from pagemill.functions.slices import ROWS
from pagemill.functions.text import compact, content_body, let, strip, text_or_empty
from pagemill.operators import vector_cells

PairScorer = Callable[[list[tuple[str, str]]], Sequence[float]]


def input_problem() -> Column:
    """Why a question or vector cannot be compared; empty if it can."""
    return (
        F.when(F.col("collection").isNull(), "no collection")
        .when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "no embedding")
        .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), "incomplete embedding")
        .when(F.exists("embedding", lambda x: F.abs(x) == float("inf")), "infinite embedding")
        .otherwise("")
    )


def unanswerable(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``question_id, sub_idx, reason`` of questions that ``nearest_vectors`` gives no hits for.

    Beside unusable ones, those whose collection holds no vector, or none of the question's width.
    """
    asked = questions.select("question_id", "sub_idx", "collection", "embedding", input_problem().alias("problem"))
    held = vectors.filter(input_problem() == "").select("collection", F.size("embedding").alias("width")).distinct()
    widths = held.groupBy("collection").agg(F.collect_set("width").alias("widths"))
    reason = (
        F.when(F.col("problem") != "", F.col("problem"))
        .when(F.col("widths").isNull(), "empty collection")
        .when(~F.array_contains("widths", F.size("embedding")), "other width than the collection")
        .otherwise("")
    )
    marked = asked.join(widths, "collection", "left").withColumn("reason", reason)
    return marked.filter("reason <> ''").select("question_id", "sub_idx", "reason")


def nearest_vectors(
    questions: DataFrame, vectors: DataFrame, k: int = fv.VECTOR_TOP_K, cell_rows: int = vector_cells.CELL_ROWS
) -> DataFrame:
    """Exact ``k`` nearest vectors (squared L2) of every sub-question in its collection.

    ``questions(question_id, sub_idx, collection, embedding)``, ``vectors(collection, id, embedding)``.  Questions
    visit only the cells that can hold one of their nearest (``vector_cells``); what they find is cut to ``k`` in each
    cell, again in each task before the last shuffle, and once more behind it.  One plan, whatever the number of
    questions.  Ties are broken by id.  Collections may hold vectors of any width; ``unanswerable`` names the
    questions that meet none.
    """
    if k <= 0:
        none = "question_id string, sub_idx int, id string, distance double, rank int"
        return questions.sparkSession.createDataFrame([], none)
    key = F.concat_ws("\x1f", F.col("question_id").cast("string"), F.col("sub_idx").cast("string"))
    usable = input_problem() == ""
    asked = questions.filter(usable).select(F.col("collection").cast("string"), key.alias("key"), "embedding")
    stored = vectors.filter(usable).select(F.col("collection").cast("string"), F.col("id").cast("string"), "embedding")
    hits = vector_cells.nearest(asked, stored, k, cell_rows)
    nearest = Window.partitionBy("question").orderBy("distance", "id")
    ranked = hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    parts = F.split("question", "\x1f")
    return ranked.select(
        parts[0].alias("question_id"), parts[1].cast("int").alias("sub_idx"), "id", "distance", "rank"
    )


def sub_questions(questions: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """Sub-questions in order; a question without any stands for itself as number 0."""
    trimmed = questions.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    if expansions is None:
        return trimmed.withColumns({"sub_idx": F.lit(0), "sub_text": F.col("text")})
    named = expansions.select("question_id", "sub_idx", F.col("text").alias("sub_text"))
    joined = trimmed.join(named.filter(strip(F.col("sub_text")) != ""), "question_id", "left")
    return joined.withColumns(
        {"sub_idx": F.coalesce("sub_idx", F.lit(0)), "sub_text": F.coalesce("sub_text", "text")}
    )


def candidates(hits: DataFrame, max_distance: float = fv.MAX_SEARCH_DISTANCE) -> DataFrame:
    """Score hits, drop the far ones, and keep a chunk once per question, at its first place."""
    floor = scores.minimum_semantic_score(max_distance)
    scored = hits.withColumn("semantic_score", scores.semantic_score(F.col("distance")))
    near = scored.filter(F.col("semantic_score") >= floor)
    first = near.groupBy("question_id", F.col("id").alias("chunk_id")).agg(
        F.min(F.struct("sub_idx", "rank", "semantic_score")).alias("f")
    )
    place = Window.partitionBy("question_id").orderBy("f.sub_idx", "f.rank")
    return first.select(
        "question_id",
        "chunk_id",
        F.col("f.semantic_score").alias("semantic_score"),
        F.row_number().over(place).alias("cand_pos"),
    )


def skip_rerank(sub_count: Column, enabled: bool = True) -> Column:
    """Per question: one sub-question whose first candidate already scores high."""
    per_question = Window.partitionBy("question_id")
    top = F.max(F.when(F.col("cand_pos") == 1, F.col("semantic_score"))).over(per_question)
    return F.lit(not enabled) | ((sub_count == 1) & F.coalesce(top > fv.SKIP_RERANK_ABOVE, F.lit(False)))


def rank_text() -> Column:
    """What the pair scorer reads of a chunk: title, heading, compact body."""
    parts = F.array(
        text_or_empty(F.col("metadata.title")),
        text_or_empty(F.col("metadata.heading")),
        compact(content_body(F.col("document")), 1000),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def keyword_scorer(question: Column, chunk: Column) -> Column:
    """Default pair scorer: share of the question's keywords found in the chunk."""
    return text.overlap(text.keywords(question), text.keywords(chunk))


def pair_scorer(load: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """A column of scores from a loader of a model that scores a batch of (question, chunk) pairs.

    The loader runs once per Python task, the model on a few hundred pairs at a time.  A batch whose model fails gets nulls, which ``rerank`` reads as no score
    for the whole question.
    """

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, chunks in batches:
            scored = [pd.Series([], dtype="float64")]
            for at in range(0, len(questions), ROWS):
                asked, given = (c.iloc[at : at + ROWS].fillna("") for c in (questions, chunks))
                pairs = list(zip(asked, given, strict=True))
                try:
                    scored.append(pd.Series(list(model(pairs)), dtype="float64"))
                except Exception:  # noqa: BLE001 - ranking goes on without the model
                    scored.append(pd.Series([None] * len(pairs), dtype="float64"))
            yield pd.concat(scored, ignore_index=True)

    return score


def smooth_scores(raw: Column) -> Column:
    """Min-max within the question, 0.5 when all are equal, pulled in from the extremes."""
    per_question = Window.partitionBy("question_id")
    low, high = F.min(raw).over(per_question), F.max(raw).over(per_question)
    close = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    n = F.when(close, F.lit(0.5)).otherwise((raw - low) / (high - low))
    return F.lit(0.05) + F.lit(0.9) * n


def rerank(cands: DataFrame, raw: str | None = "raw_score") -> DataFrame:
    """Add rerank and final scores and the final ``rank``.

    ``cands`` holds ``skip`` and, unless there is no scorer, the ``raw`` pair score.  A skipped
    question keeps its order, with rerank score 0 and the semantic score as final score.  Where a pair of
    a question has no score, its model failed: all its pairs get the constant score as it is.
    """
    score = F.lit(fv.CONSTANT_RERANK)
    if raw:
        missing = F.bool_or(F.col(raw).isNull() | F.isnan(raw)).over(Window.partitionBy("question_id"))
        score = F.when(missing, score).otherwise(smooth_scores(F.col(raw)))
    scored = cands.withColumn("rerank_score", F.when(F.col("skip"), F.lit(0.0)).otherwise(score))
    final = F.when(F.col("skip"), F.col("semantic_score")).otherwise(
        F.lit(0.75) * F.col("rerank_score") + F.lit(0.25) * F.col("semantic_score")
    )
    fused = scored.withColumn("final_score", final)
    order = Window.partitionBy("question_id").orderBy(
        F.when(F.col("skip"), F.lit(0.0)).otherwise(-F.col("final_score")), "cand_pos"
    )
    return fused.withColumn("rank", F.row_number().over(order))


def accept(ranked: DataFrame, top_k: Column | int = fv.FINAL_TOP_K) -> DataFrame:
    """Chunks over both floors, or all when none is; the first ``top_k`` of them, with how many were ``retrieved_chunks``."""
    good = (F.col("semantic_score") >= fv.MIN_SEMANTIC_SCORE) & (F.col("rerank_score") >= fv.MIN_RERANK_SCORE)
    per_question = Window.partitionBy("question_id")
    kept = ranked.withColumns({"_good": good, "retrieved_chunks": F.count("*").over(per_question)})
    kept = kept.withColumn("_any", F.max("_good").over(per_question)).filter(F.col("_good") | ~F.col("_any"))
    place = F.row_number().over(per_question.orderBy("rank"))
    limit = top_k if isinstance(top_k, Column) else F.lit(top_k)
    return kept.withColumn("place", place).filter(F.col("place") <= limit).drop("_good", "_any")


def has_refusal(document: Column) -> Column:
    return F.lower(text_or_empty(document)).rlike("|".join(fv.REFUSAL_PHRASES))


def excerpt(document: Column) -> Column:
    """What an extractive answer quotes of a chunk."""
    return compact(content_body(document), 250)


def with_judgements(chunks: DataFrame) -> DataFrame:
    """Chunks with ``refuses`` and ``excerpt``, told from ``document`` once a chunk, however many questions accept it."""
    return chunks.withColumns({"refuses": has_refusal(F.col("document")), "excerpt": excerpt(F.col("document"))})


def confidence(accepted: DataFrame, *also: Column) -> DataFrame:
    """One row per question: confidence, its label and the five factors as percentages; ``also`` adds named aggregates.

    Where ``accepted`` has ``refuses`` (``with_judgements``), no document is read.
    """
    refuses = F.col("refuses") if "refuses" in accepted.columns else has_refusal(F.col("document"))
    top = F.reverse(F.sort_array(F.collect_list("rerank_score")))
    grouped = accepted.groupBy("question_id").agg(
        F.avg("semantic_score").alias("s"),
        top.alias("r"),
        F.min_by("final_score", "place").alias("t"),
        F.count("*").alias("n"),
        F.avg(F.when(refuses, 1.0).otherwise(0.0)).alias("g"),
        *also,
    )
    own = [c for c in grouped.columns if c not in ("question_id", "s", "r", "t", "n", "g")]
    gap = F.get("r", F.lit(0)) - F.coalesce(F.get("r", F.lit(1)), F.lit(0.0))
    factors = grouped.withColumns(
        {
            "rr": scores.sigmoid(gap),
            "grounding": F.col("n") / (F.col("n") + 2),
            "answerability": F.greatest(F.lit(0.0), F.lit(1.0) - F.col("g")),
        }
    )
    total = (
        F.lit(0.30) * F.col("s") + F.lit(0.35) * F.col("rr") + F.lit(0.27) * F.col("t")
        + F.lit(0.08) * F.col("grounding") + F.lit(0.03)
    )
    value = F.bround(scores.clamp01(total), 2)
    percent = {
        name: F.bround(F.col(c) * 100.0, 2).alias(name)
        for name, c in (
            ("semantic", "s"), ("rerank", "rr"), ("top_score", "t"),
            ("answerability", "answerability"), ("grounding", "grounding"),
        )
    }
    return factors.select(
        "question_id",
        value.alias("confidence"),
        scores.confidence_label(value).alias("confidence_label"),
        F.struct(*percent.values()).alias("confidence_factors"),
        F.col("n").alias("accepted_chunks"),
        F.col("s").alias("avg_semantic_score"),
        (F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("avg_rerank_score"),
        *own,
    )


def extractive_answer(chunks: Column, told: str = "document") -> Column:
    """First three chunk bodies of a ranked array of chunks, or the fallback; ``told`` is ``excerpt`` if they have it."""
    bodies = F.transform(F.slice(chunks, 1, 3), lambda c: c[told] if told == "excerpt" else excerpt(c[told]))
    joined = strip(F.array_join(F.filter(bodies, lambda b: b != ""), "\n\n"))
    return F.when(joined == "", F.lit(fv.EMPTY_EXTRACT_ANSWER)).otherwise(joined)


def prompt_text(c: Column) -> Column:
    out = F.translate(text_or_empty(c), "<>", "  ")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return strip(F.regexp_replace(out, "\r\n?", "\n"))


def context_block(chunks: Column) -> Column:
    """Up to ten chunks in numbered blocks, cut to the context budget."""
    def block(c: Column, i: Column) -> Column:
        return F.concat(
            F.lit("\n[S"), (i + 1).cast("string"), F.lit("]\n\nTITLE:\n"), prompt_text(c["metadata"]["title"]),
            F.lit("\n\nHEADING:\n"), prompt_text(c["metadata"]["heading"]),
            F.lit("\n\nCONTENT:\n"), prompt_text(compact(content_body(c["document"]), 1200)), F.lit("\n"),
        )

    joined = F.array_join(F.transform(F.slice(chunks, 1, 10), block), "\n\n")
    return F.substring(joined, 1, fv.CONTEXT_CHARS)


def constraints_block(constraints: Column) -> Column:
    """The user's constraints first, where they say something new; then the fixed rules."""
    rules = "\n".join(fv.BASE_CONSTRAINTS)
    known = [b.lower() for b in fv.BASE_CONSTRAINTS]
    extra = F.filter(
        text.merge_constraints(F.coalesce(constraints, F.array().cast("array<string>"))),
        lambda c: ~F.lower(text.collapse_ws(c)).isin(known),
    )

    def compose(items: Column) -> Column:
        custom = F.array_join(F.transform(items, lambda c: F.concat(F.lit("- "), c)), "\n")
        lead = F.concat(
            F.lit(fv.CUSTOM_CONSTRAINTS_LEAD + "\n"), custom, F.lit("\n\n" + fv.BASE_CONSTRAINTS_LEAD + "\n" + rules)
        )
        return F.when(F.size(items) == 0, F.lit(rules)).otherwise(lead)

    return let(extra, compose)


def answer_prompt(role: Column, question: Column, context: Column, constraints: Column) -> Column:
    spoken = prompt_text(F.coalesce(F.nullif(text_or_empty(role), F.lit("")), F.lit(fv.DEFAULT_ROLE)))
    return F.concat(
        F.lit("<role>\n"), spoken, F.lit("\n</role>\n\n<context>\n"), context,
        F.lit("\n</context>\n\n<question>\n"), prompt_text(question),
        F.lit("\n</question>\n\n<constraints>\n"), constraints_block(constraints),
        F.lit("\n\n</constraints>\n\nAnswer:\n"),
    )


def clean_answer(answer: Column) -> Column:
    out = F.regexp_replace(strip(text_or_empty(answer)), r"(?i)^\s*answer\s*:\s*", "")
    out = strip(F.regexp_replace(out, "\n{3,}", "\n\n"))
    return F.when(out == "", F.lit(fv.EMPTY_CLEAN_ANSWER)).otherwise(out)


def is_bad_answer(answer: Column) -> Column:
    low = F.lower(strip(text_or_empty(answer)))
    return (low == "") | low.rlike("|".join(fv.BAD_ANSWER_PHRASES))


def answer_metrics(input_tokens: Column, output_tokens: Column, generation_ms: Column) -> Column:
    """Token totals, throughput, chunk counts and mean scores of a result row.

    Latencies come from whoever ran the model.
    """
    rate = F.when(
        generation_ms > 0,
        F.bround(output_tokens / F.greatest(generation_ms / 1000.0, F.lit(1e-6)), 2),
    ).otherwise(F.lit(0.0))
    return F.struct(
        input_tokens.alias("input_tokens"),
        output_tokens.alias("output_tokens"),
        (input_tokens + output_tokens).alias("total_tokens"),
        rate.alias("throughput_tokens_per_sec"),
        F.col("retrieved_chunks").alias("retrieved_chunks"),
        F.col("accepted_chunks").alias("accepted_chunks"),
        F.bround("avg_semantic_score", 4).alias("avg_semantic_score"),
        F.bround("avg_rerank_score", 4).alias("avg_rerank_score"),
    )


def ranked_chunks(told: str = "document") -> Column:
    """Aggregate: the accepted chunks of a question as an array in rank order, with their ``document`` or ``excerpt``."""
    return F.sort_array(
        F.collect_list(
            F.struct("place", "chunk_id", told, "metadata", "semantic_score", "rerank_score", "final_score")
        )
    )


def query_results(questions: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per question: answer, confidence, factors, metrics and its chunks.

    A question with no accepted chunk gets the fixed answer with confidence 0.  Where ``accepted`` has ``excerpt``
    (``with_judgements``), the chunks have it in place of their ``document``.
    """
    told = "excerpt" if "excerpt" in accepted.columns else "document"
    judged = confidence(accepted, ranked_chunks(told).alias("chunks"), F.first("retrieved_chunks").alias("retrieved_chunks"))
    base = questions.select("question_id", strip(F.col("text")).alias("question"))
    joined = base.join(judged, "question_id", "left")
    answered = F.col("chunks").isNotNull()
    answer = F.when(answered, extractive_answer(F.col("chunks"), told)).otherwise(F.lit(fv.EMPTY_RESULT_ANSWER))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("accepted_chunks", "retrieved_chunks")}
    nil = {c: F.coalesce(c, F.lit(0.0)) for c in ("confidence", "avg_semantic_score", "avg_rerank_score")}
    label = F.coalesce("confidence_label", F.lit("low"))
    return joined.withColumns({"answer": answer, **zero, **nil, "confidence_label": label})
