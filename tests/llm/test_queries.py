"""The registered queries on the smallest tables: SQL twins, and the contracts' columns recomputed plainly."""

import hashlib
import re
import zlib

import duckdb
import pytest
from test_join_operators import slow_repeats
from test_row_operators import slow_base
from test_simhash import slow_fingerprint

from pagemill.llm import queries, token_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def rows_of(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)


def test_op1(spark, docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_sentencepiece")}
    assert all(got[i]["ids"] == library.encode(t) and got[i]["n_tokens"] == len(got[i]["ids"]) for i, t, _ in docs)
    assert all(got[i]["round_trip"] and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t, _ in docs)


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op2_simhash_near_dedup")}
    fps = {i: slow_fingerprint(t) for i, t, _ in docs}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    for i, f in fps.items():
        near = [j for j, g in fps.items() if (f ^ g).bit_count() <= 2]
        assert {got[j]["component_id"] for j in near} == {got[i]["component_id"]} and got[i]["component_id"] <= min(near)


def test_op3(spark, docs):
    got = rows_of(spark, "op3_suffix_dedup")
    want = slow_repeats([(i, t.encode()) for i, t, _ in docs], 100)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {
        i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()
    }


def test_op4(spark, docs, duck):
    split = lambda t: re.findall(r"[^\W\d_]+|\d+", t.lower())
    items = {i: split(t) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    grams = {i: {tuple(w[k : k + 8]) for k in range(len(w) - 7)} for i, w in items.items()}
    got = {r["doc_id"]: r["items"] for r in rows_of(spark, "op4_decontaminate")}
    for i, text, _ in docs:
        w = split(text)
        own = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        assert {j for j in items if len(own & grams[j]) > len(grams[j]) / 2} == set(got[i])


def test_op6(spark, docs):
    for r in rows_of(spark, "op6_secret_scan"):
        base = slow_base(next(t for i, t, _ in docs if i == r["doc_id"]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [base.count(f"{k}:") for k in ("assign", "access", "hex")]


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op7_order_minhash")}
    ordered = docs[::-1]
    for k, (i, text, _) in enumerate(ordered):
        third = len(text) // 3
        edited = text[: len(text) - third] + ordered[(k + 1) % len(ordered)][1][:third]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    near = [sum(r[c] for r in got.values()) / len(got) for c in ("near_edited", "near_next")]
    assert near[0] > 0.15 > 10 * near[1]


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op8_language_models")}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held_out = [(got[i]["lang_pred"], lang) for i, _, lang in docs if got[i]["held_out"]]
    assert sum(a == b for a, b in held_out) >= 0.97 * len(held_out)
    assert not any(r["rejected"] for r in got.values())


def test_op10(spark, docs):
    tokenizer = token_counts.load_tokenizer(queries.tokenizer_file("byte_bpe_50k.json"))
    got = {tuple(r)[:4] for r in rows_of(spark, "op10_token_counts")}
    assert got == {(i, len(t.encode()), n := len(tokenizer.encode(t).ids), n > 1024) for i, t, _ in docs}
