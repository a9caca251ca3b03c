"""Texts are cleaned and cut once a row, whatever number of columns is told from them."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import repair, text
from pagemill.operators import chunk, clean, metadata, retrieve
from pagemill.plans import corpus_queries, retrieval_queries

RAW = ["", " ", "a  b", "a \n b", "a\t\n\n\n\nb", "x\r\ny\rz", "\f\x0b q \n", "  a ", "one\n\n \n\ntwo", "\r", "a\r\n\r\n\r\nb", "\x1c a \x85"]


def written(df, pattern):
    """How often the plan works out what holds ``pattern``."""
    return df._jdf.queryExecution().executedPlan().toString().count(pattern)


@pytest.fixture
def parsed(spark):
    class Given:
        documents = spark.createDataFrame([(0, "One line.\nOne line.\n\nTwo", "en", "s")], "doc_id long, text string, lang string, source string")

    return corpus_queries.as_parsed(Given)


def test_cleaning_is_worked_out_once(parsed):
    assert written(clean.add_clean_text(parsed), "skip to content") == 1
    once = clean.clean_documents(parsed, materialize=False)
    assert once.select("cleaned_content", "repeated_lines_removed").first() == ("s\n\nOne line.\n\nTwo", 1)


def test_hash_and_sections_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "https://a.b/c", "t", "Head\n\nbody text", "en")], "pos long, url string, title string, cleaned_content string, language string")
    meta = metadata.add_metadata(docs, F.lit("c"), F.lit("d"))
    assert written(meta, "\\x85") == 1
    row = meta.first()
    assert row["section_heading"] == "Head" and len(row["content_hash"]) == 64
    plan = chunk.split_documents(meta).select("content", "heading")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(content") <= 1


def test_later_steps_read_no_text(spark, parsed):
    plan = clean.clean_documents(parsed).select("url", "reason", "duplicate_of", "content_length")._jdf.queryExecution().executedPlan().toString()
    assert "cleaned_content" not in plan


def test_marks_change_no_result(spark):
    """The rules that look for a mark first give what their patterns give on every text."""
    rows = spark.createDataFrame([(t,) for t in RAW], "t string")
    c = F.col("t")
    plain = F.regexp_replace(F.regexp_replace(c, r"[ \t\f\x0b]+", " "), " *\n *", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, "\r\n?", "\n"), "[ \t]+\n", "\n")
    plain = text.strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))
    found = rows.select(text.normalize_whitespace(c).alias("a"), plain.alias("b"), text.strip_text(c).alias("d"), text.strip(c).alias("e"))
    assert all(r["a"] == r["b"] and r["d"] == r["e"] for r in found.collect())


def test_latin_letters_need_no_repair(spark):
    letters = "".join(map(chr, range(0xC0, 0x100)))
    assert all(repair._settle(x + y) == x + y for x in letters for y in letters)
    rows = spark.createDataFrame([("Straße é",), ("Ã©",), ("naïve",)], "t string")
    assert [r[0] for r in rows.select(repair.normalize_text(F.col("t"))).collect()] == ["Straße é", "é", "naïve"]


def test_answers_read_the_texts_of_stored_chunks_once(spark):
    """Only chunks with a vector are worked on; refusal and excerpt are told once a chunk, not once a question."""
    rows = [(i, f"Page title: x\nbody {i} " + ("not provided" if i % 2 else "given") + " word" * 90, "en", "s") for i in range(6)]

    class Given:
        documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        embeddings = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in (1, 2, 3)], "vec_id long, label int, embedding array<float>")

    stored = retrieval_queries.stored_chunks(Given)
    assert sorted(r["chunk_id"] for r in stored.collect()) == ["v1", "v2", "v3"]
    told = retrieve.with_judgements(stored)
    asked = spark.createDataFrame([(q, f"v{1 + (q + p) % 3}", p, 0.5, 0.5 / p, 0.4) for q in (1, 2) for p in (1, 2, 3)], "question_id long, chunk_id string, place int, semantic_score double, rerank_score double, final_score double")
    with_texts, without = asked.join(stored, "chunk_id"), asked.join(told, "chunk_id")
    got = [sorted(map(str, retrieve.confidence(a).collect())) for a in (with_texts, without)]
    assert got[0] == got[1] and len(got[0]) == 2
    answers = [
        sorted(map(tuple, a.groupBy("question_id").agg(retrieve.ranked_chunks(c).alias("c")).select("question_id", retrieve.extractive_answer(F.col("c"), c)).collect()))
        for a, c in ((with_texts, "document"), (without, "excerpt"))
    ]
    assert answers[0] == answers[1] and "..." in answers[0][0][1]
    top = retrieve.confidence(without)._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]
    assert "document" not in top and "RLIKE" not in top
