"""URL rules, token counts, SentencePiece, language models and secrets against plain versions, with odd rows."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import language_models, pieces, queries, secret_scan, token_counts, url_rules
from pagemill.llm.batches import prepare

ODD = [None, "", " ", "\n\n", "a", "é" * 3, "x" * 70_000, "word " * 20_000, "<|endoftext|>", "tab\t \x1c  end "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"clash {i}") for i, t in enumerate(ODD)] + [(1, "", "again"), (1, "", "again"), (None, "null id", "")]
    return prepare(spark).createDataFrame(rows, "doc_id long, text string, score string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# --- URL rules --------------------------------------------------------------------------------------


def slow_verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark):
    rules = [*queries.URL_RULES, ("a.b", "", "block"), ("b", "/x", "allow")]
    rnd = random.Random(1)
    urls = [None, "", "no scheme", "://", "http://", "http://A.B", "x://a.b?q#f", "http://b/x://y", "http://É.com/en/"]
    hosts = ["example.com", "WWW.Example.com", "com", "xcom", "a.b", "c.a.b", "example.net", ".com", "org", "a" * 50 + ".org"]
    for _ in range(300):
        urls.append(f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/7', '/en/77?x', '/de/8#y', '/es/', '/x'])}")
    rows = [(i % 200, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.b/", "")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.filter_urls(df, known).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(i, *slow_verdict(u, rules)) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert url_rules.filter_urls(df.limit(0), known).count() == 0
    assert {r["verdict"] for r in url_rules.filter_urls(df, known.limit(0)).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark):
    """The contract's list word by word, and the query's verdict on every page of the smallest table."""
    words = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    split = [re.fullmatch(r"(\w+) ([^/]+)(/.*)", w).groups() for w in words.split(", ")]
    contract = [(host, path, verdict) for verdict, host, path in split]
    assert contract == queries.URL_RULES
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    want = sorted((i, *slow_verdict(u, contract)) for i, u in pages)
    assert sorted(map(tuple, queries.QUERIES["op5_url_rules"](spark, folder).collect())) == want
    assert any(r[3:] == ("net/de/", "allow") for r in want)


def test_url_filter_runs_no_python(spark):
    known = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    df = url_rules.filter_urls(spark.range(5).selectExpr("id page_id", "'http://a.com/en/' url"), known)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# --- token counts --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.load_tokenizer(queries.tokenizer_file("byte_bpe_50k.json"))


def test_splices_and_segments_count_like_the_library(tokenizer):
    rnd = random.Random(2)
    parts = ["foo", "Bar", " ", "  ", "\n", "\t ", "é", "<|endoftext|>", "!!", "'s", "123", "日本", " the", "\x1c ", "a" * 30, " " * 40]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 150)))
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert "".join(token_counts.segments(text)) == text
        assert sum(len(tokenizer.encode(s, add_special_tokens=False).ids) for s in token_counts.segments(text)) == n
        assert token_counts.spliced_count(tokenizer, text, rnd.choice([20, 60]), rnd.choice([2, 8]))[0] == n


def test_overlaps_are_widened(tokenizer):
    text = "a" * 5000 + " b" * 500
    n, chunks, widened = token_counts.spliced_count(tokenizer, text, 200, 10)
    assert n == len(tokenizer.encode(text).ids) and widened and chunks > 5


def test_token_rows(docs, nothing, tokenizer):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    got = token_counts.count_tokens(docs, path, chunk_chars=1000, overlap_chars=50).collect()
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), n := len(tokenizer.encode(r["text"] or "").ids), n > 1024)
        for r in docs.collect()
    ]
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(nothing, path).count() == 0


# --- SentencePiece ----------------------------------------------------------------------------------------


def test_pieces_match_the_library():
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model, library = pieces.load_model(path), SentencePieceProcessor(model_file=path)
    rnd = random.Random(4)
    parts = ["a", "b", "the", "▁", " ", "  ", "é", "日本", "𠀀", "\n", "\t", ".", ".com", "don't", "123", "http://", "<s>", "ing", "er", "\x00", "²,", "aaaa", "!!!", " ,"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids.tolist()) == library.decode(ids.tolist()) == text.replace("▁", " ")
    for _ in range(500):
        ids = [rnd.randrange(3, 259) if rnd.random() < 0.5 else rnd.randrange(259, 32000) for _ in range(8)]
        assert model.decode(ids) == library.decode(ids)


def test_very_long_words():
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_file("piece_bpe_32k.model")
    model, library = pieces.PieceModel(path), SentencePieceProcessor(model_file=path)
    rnd = random.Random(10)
    for letters in ("abcdeinrst", "日本語の文字𠀀", "aZ09+/"):
        word = "".join(rnd.choices(letters, k=3000))
        assert model.encode([word])[0].tolist() == library.encode(word)
    word = "".join(rnd.choices("ab日𠀀", k=1_000_000))
    assert model.decode(model.encode([word])[0].tolist()) == word
    assert model.held > 4_000_000


def test_piece_rows(docs, nothing):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    ids = docs.withColumn("ids", pieces.encode_pieces("text", path))
    rows = ids.withColumn("back", pieces.decode_pieces("ids", path)).collect()
    assert len(rows) == docs.count() and all(r["back"] == r["text"] for r in rows)
    assert all((r["ids"] is None) == (r["text"] is None) for r in rows)
    assert nothing.select(pieces.encode_pieces("text", path)).count() == 0


def test_each_text_is_encoded_once(spark, docs, nothing):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    ids = pieces.encode_pieces("text", path)
    found = docs.select(pieces.encode_and_decode("text", path).alias("s"), ids.alias("ids"), pieces.decode_pieces(ids, path).alias("back"))
    assert found.filter(~F.col("s.ids").eqNullSafe(F.col("ids")) | ~F.col("s.decoded").eqNullSafe(F.col("back"))).count() == 0
    assert nothing.select(pieces.encode_and_decode("text", path)).count() == 0
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (queries.QUERIES["op1_sentencepiece"](spark, folder), corpus_pipeline.sentence_pieces(spark, documents, folder)):
        (asked,) = re.findall(r"ArrowEvalPython \[(.*?)\], \[", df._jdf.queryExecution().executedPlan().toString())
        assert len(re.findall(r"\(text#", asked)) == 1


def test_a_worker_keeps_no_more_words_than_asked(docs):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    small, large = pieces.PieceModel(path, 20_000), pieces.PieceModel(path)
    for i in range(40):
        batch = [f"word{i}x{k} and more" for k in range(10)]
        assert [x.tolist() for x in small.encode(batch)] == [x.tolist() for x in large.encode(batch)]
    assert small.held < 30_000 < large.held
    ids = pieces.encode_pieces("text", path, 20_000)
    back = pieces.decode_pieces(ids, path, 20_000).eqNullSafe(pieces.decode_pieces(pieces.encode_pieces("text", path), path))
    assert docs.filter(~back | ~ids.eqNullSafe(pieces.encode_pieces("text", path))).count() == 0


# --- language models -----------------------------------------------------------------------------------------


def slow_bits(models, gram, order):
    """Surprisal of the last character of ``gram`` after the others."""
    cost = 0.0
    for begin in range(max(0, len(gram) - order), len(gram)):
        part = gram[begin:]
        size = len(part)
        place = models.find(size, language_models.gram_hashes(language_models._codes(part), size)[-1])[0]
        if place >= 0 and not np.isnan(models.logs[size - 1][place, 0]):
            return cost - float(models.logs[size - 1][place, 0])
        if size > 1:
            front = models.find(size - 1, language_models.gram_hashes(language_models._codes(part[:-1]), size - 1)[-1])[0]
            cost -= float(models.backoffs[size - 2][front, 0]) if front >= 0 else 0.0
    return cost - float(models.unknown[0])


def test_probabilities_add_up_to_one():
    words = Counter("abba ab bab cab a abc".split())
    models = language_models.fit({"x": dict(language_models._grams(words, 3)), "y": {"d": 2, "de": 1, " d": 1}}, 3)
    alphabet = "abcd ?"  # all characters of both languages and one that is unknown
    for context in ["", "a", "b", "ab", " a", "zz", "ez"]:
        assert sum(2 ** -slow_bits(models, context + c, 3) for c in alphabet) == pytest.approx(1.0, abs=1e-5)


def test_word_scores_match_a_walk_over_n_grams():
    counts = language_models._grams(Counter("hello help held yellow".split()), 4)
    models = language_models.fit({"x": dict(counts), "y": dict(language_models._grams(Counter(["jello"]), 4))}, 4)
    words = ["hello", "x", "helz", "yell", "jello"]
    got = language_models.score_words(models, words, 4)[:, 0]
    for word, bits in zip(words, got, strict=True):
        marked = f" {word} "
        assert bits == pytest.approx(sum(slow_bits(models, marked[:end], 4) for end in range(2, len(marked) + 1)), abs=1e-4)


def test_languages(spark, docs, nothing):
    rnd = random.Random(6)
    sounds = {"xx": ["ba", "do", "mi"], "yy": ["sch", "tz", "ug"], "zz": ["ñe", "rru", "ll"]}
    make = lambda lang, n: " ".join("".join(rnd.choices(sounds[lang], k=rnd.randint(1, 4))) for _ in range(n))
    rows = [(i, make(lang, rnd.randint(1, 40)), lang, lang) for i, lang in enumerate(list(sounds) * 80)]
    rows += [(900, make("xx", 3), None, ""), (901, None, "xx", ""), (902, "12 !", "yy", "")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, entropy string")
    held_out = language_models.training_fold(df["doc_id"]) == 2
    classifier = language_models.train(df.filter(~held_out))
    judged = {r["doc_id"]: r for r in language_models.identify(df, classifier).collect()}
    assert len(judged) == len(rows)
    assert all(judged[i]["lang_pred"] == lang for i, _, lang, _ in rows[:240])
    assert not any(judged[i]["rejected"] for i in range(240))
    assert all(0 <= r["score"] <= 1 for r in judged.values())
    for i in (901, 902):
        assert (judged[i]["lang_pred"], judged[i]["score"], judged[i]["rejected"]) == ("und", 0.0, True)
    odd = language_models.identify(docs, classifier).collect()
    assert len(odd) == docs.count()
    foreign = spark.createDataFrame([(1, "qwx kpfv jjq wvx " * 20)], "doc_id long, text string")
    assert language_models.identify(foreign, classifier).first()["rejected"]
    assert language_models.keep_known(df, classifier).columns == df.columns
    empty = language_models.train(nothing)
    assert {r["lang_pred"] for r in language_models.identify(docs, empty).collect()} == {"und"}
    assert language_models.identify(nothing, classifier).count() == 0


def test_fifth_characters_tell_languages_apart(spark):
    rows = [(i, "abcde fbcdg" if i % 2 else "abcdg fbcde", "xx" if i % 2 else "yy") for i in range(80)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    judged = {r["doc_id"]: r["lang_pred"] for r in language_models.identify(df, language_models.train(df)).collect()}
    assert judged == {i: lang for i, _, lang in rows}


def test_weights_of_the_table_match_a_plain_fit(spark):
    counts = {"x": dict(language_models._grams(Counter("hello help held yellow a 𠀀é".split()), 5)), "y": dict(language_models._grams(Counter(["jello"]), 5))}
    rows = [(lang, gram, n) for lang, grams in counts.items() for gram, n in grams.items()]
    table = spark.createDataFrame(rows, "lang string, gram string, n long")
    langs, got = language_models.load(*language_models.weigh(table, 5), 5)
    want = language_models.fit(counts, 5)
    assert langs == ["x", "y"]
    assert got.unknown == pytest.approx(want.unknown)
    for k in range(5):
        assert (got.hashes[k] == want.hashes[k]).all()
        np.testing.assert_allclose(got.logs[k], want.logs[k], atol=1e-5)
        np.testing.assert_allclose(got.backoffs[k], want.backoffs[k], atol=1e-5)


def test_a_rare_language_keeps_its_words_beside_a_large_one(spark):
    rnd = random.Random(7)
    large = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxy", k=6)) for _ in range(80_000))
    rows = [(i, large, "xx") for i in range(6)] + [(900 + i, "zqz zqqz", "yy") for i in range(3)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    classifier = language_models.train(docs)
    assert classifier.langs == ["xx", "yy"] and sum(map(len, classifier.models.hashes)) > 500_000
    assert language_models.identify(docs.filter("lang = 'yy'"), classifier).first()["lang_pred"] == "yy"


def test_copies_calibrate_once(spark):
    rows = [(i, "copy" if i % 3 else f"own {i}", "xx") for i in range(300)] + [(400, "copy", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = [(r["text"], r["lang"]) for r in language_models.calibration_texts(docs, 1000).collect()]
    assert len(texts) == len(set(texts)) == 102
    assert language_models.calibration_texts(docs, 50).count() == 50
    assert language_models.calibration_texts(docs.limit(0), 50).count() == 0


def test_pruning_keeps_what_fits(spark):
    rows = [("x", f"g{i}", i) for i in range(1, 200)]
    kept = language_models.prune(spark.createDataFrame(rows, "lang string, gram string, n long"), 50).collect()
    assert 0 < len(kept) <= 50 and min(r["n"] for r in kept) > 100


# --- secrets ----------------------------------------------------------------------------------------------------


def slow_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_match_plain_search():
    rnd = random.Random(8)
    parts = ["password", "PassWD", "secret", "api_key", "APIKEY", "token", " = ", ":", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789", "é", " ", "K", "ſecret=", "-_./+="]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k, _ in secret_scan.base_spans(text)) == slow_base(text)


def test_learned_format_finds_its_like_only(spark, docs, nothing):
    rnd = random.Random(9)
    key = lambda: "sk-" + "".join(rnd.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=24))
    rows = [(i, f"see token={key()} here") for i in range(150)]
    bare = key()
    rows += [(900, f"plain {bare} text"), (901, "mail someone.4711@example-domain.com or 192.168.100.200/24 2024-01-01T00:00:00"), (902, "Supercalifragilistic words only")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    formats = secret_scan.learn_formats(df)
    got = {r["doc_id"]: r for r in secret_scan.scan(df, formats).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in got[900]["spans"]] == [(6, 6 + len(bare), "format")]
    assert not got[901]["spans"] and not got[902]["spans"]
    assert all(got[i]["base"] == got[i]["spans"] for i in range(150))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, formats).collect()}
    assert clean[900] == "plain [secret] text" and clean[0] == "see [secret] here" and clean[902] == rows[-1][1]
    odd = secret_scan.scan(docs, formats).collect()
    assert len(odd) == docs.count() and secret_scan.redact(docs, formats).columns == docs.columns
    assert secret_scan.learn_formats(nothing) == [] and secret_scan.scan(nothing, []).count() == 0


def test_parts_short_ones_and_tails_are_candidates(spark):
    rnd = random.Random(11)
    key = lambda n: "sk-" + "".join(rnd.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=n))
    rows = [(i, f"see token={key(rnd.randint(10, 40))} here") for i in range(300)]
    short, hidden, letters = key(10), key(24), "sk-" + "qwjkzpvmxgthyr"
    long = "sk-" + "zk9x8wptrv" + "a3f9ac0be8dfc4ed" + "q7wzmn"
    planted = {900: ("a ", short, " b"), 901: ("AUTH=", hidden, ""), 902: ("http://x.org/v1/get/", hidden, "/more"), 903: ("q=1.", hidden, " ."), 904: ("a ", long, " b")}
    rows += [(i, "".join(t)) for i, t in planted.items()] + [(905, "Supercalifragilistic internationally-known words/and/paths.html")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    formats = secret_scan.learn_formats(df.filter("doc_id < 300"))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, formats).collect()}
    assert {i: clean[i] for i in planted} == {i: f"{a}[secret]{b}" for i, (a, _, b) in planted.items()}
    assert clean[905] == rows[-1][1]
    assert (2, 2 + len(letters)) in secret_scan.candidates(f"a {letters}", [])
