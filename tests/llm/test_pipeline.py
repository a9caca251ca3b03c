"""The pipeline on planted documents, and what its stages keep and change."""

import random

import corpus_pipeline
import pytest

from pagemill.llm import queries, simhash
from pagemill.llm.batches import prepare

SOUNDS = {"en": ["the", "ing", "an", "er", "sh", "wh"], "fr": ["ou", "eau", "tion", "ré", "qu", "le"]}


def words(rnd, lang, n):
    return ["".join(rnd.choices(SOUNDS[lang], k=rnd.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(21)
    rows = [[i, " ".join(words(rnd, lang, rnd.randint(30, 120))), lang, f"s{i % 3}"] for i, lang in enumerate(["en", "fr"] * 60)]
    leak = " ".join(words(rnd, "en", 25))
    rows[10][1] = rows[4][1]  # an exact copy
    rows[12][1] = rows[6][1].upper().replace(" ", "\n")  # a copy but for case and white space
    rows[20][1] += " " + leak + " " + rows[20][1][:50]
    rows[30][1] += ' api_key = "abcd1234efgh5678"'
    rows += [[500, None, "en", "s"], [501, "### 12 !!", "fr", "s"], [502, "zkqxv wjjk pxzq vvkq " * 30, None, "s"], [10, rows[4][1], "en", "s1"]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, planted):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut_lineage(stage(prepare(spark), docs, folder), "stage")
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    clean = set(range(120))
    assert kept[0] == sorted([*clean, 10])  # no text, no letters, no known language
    assert set(kept[1]) == clean - {10, 12} and len(kept[1]) == 118
    assert set(kept[2]) == set(kept[1]) - {20}
    assert kept[3] == kept[2] == kept[4]
    found = {r["doc_id"]: r for r in docs.collect()}
    assert found[30]["text"] == rows[30][1].split(" api_key")[0] + " [secret]\""
    assert found[30]["n_chars"] == len(found[30]["text"])
    assert all(r["round_trip"] for r in found.values())
    assert all(found[i]["text"] == rows[i][1] for i in kept[4] if i != 30)
    again = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["piece_ids"] for r in again} == {i: r["piece_ids"] for i, r in found.items()}


def test_stages_on_an_empty_table(spark, planted, tmp_path):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(prepare(spark), docs, folder)
        assert docs.count() == 0


def test_one_of_equal_rows_stays(spark):
    rows = [(1, "same words here now"), (1, "same words here now"), (None, "same words here now"), (None, "alone"), (None, "alone"), (2, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(docs).collect()), key=str)
    assert left == sorted([(1, "same words here now"), (None, "alone"), (2, "other text")], key=str)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    named = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= named
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
