"""Whole operators on small fixtures, against brute force; skew, restarts and plan shape."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom
from pagemill.functions.split import split_text
from pagemill.operators import chunk, clean, crawl, embed, pages, retrieve, vectors
from pagemill.operators.dedup import is_first, keep_first_rows, with_first
from pagemill.session import scratch_dir
from pagemill.sources import robots, sitemaps, stage
from pagemill.streaming.indexer import SiteIndexer

PAGE = """<!doctype html><html lang="en"><head><title> My <b>Page</b> &amp; more</title>
<meta name="description" content=" about "></head><body><nav><p>skip</p></nav>
<div class="x cookie-wall"><p>cookies</p></div>
<main><h1>Top</h1><p>one<p><b>two<p>one<ul><li>a<li>b <i>c</i><li></ul>
<table><tr><th>h<td> <tr><td>v<td>w</table><p>new <script>no()</script>end</p></main>
<a href="/x?utm_source=1#f">x</a><a href="mailto:a@b">m</a><a href="y/z/">y</a></body></html>"""


# --- duplicates ------------------------------------------------------------------------------

def test_first_wins_with_null_keys(spark):
    rows = [(0, None, "a"), (1, None, "a"), (2, "k", "a"), (3, None, "b")]
    df = spark.createDataFrame(rows, "pos long, k string, w string")
    marked = with_first(df, ["k"], ["pos"], where=F.col("w") == "a").withColumn("f", is_first(["pos"]))
    got = {r["pos"]: (r["_first"] and r["_first"]["pos"], r["_n"]) for r in marked.collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (None, None)}
    urls = spark.createDataFrame([(0, None), (1, None)], "pos long, url string")
    assert sorted(r["outcome"] for r in crawl.filter_urls(urls, ["pos"]).collect())[-1] == "duplicate"
    assert crawl.filter_urls(urls, ["pos"]).filter("outcome = 'duplicate'").count() == 1


def test_wide_pages_lose_boilerplate_in_one_pass():
    html = "<html><body><main>" + "<nav>x</nav>" * 50_000 + "<p>kept</p></main></body></html>"
    root = dom.build(html)
    dom.drop_boilerplate(root)
    assert dom.body_of(root).text() == "kept"


@pytest.mark.parametrize("partitions", [1, 7])
def test_first_wins_with_a_hot_key(spark, partitions):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", f"u{i}") for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "pos long, k string, u string").repartition(partitions)
    marked = with_first(df, ["k"], ["pos"], carry=["u"], salts=8)
    got = {r["pos"]: (r["f"], r["_first"]["u"], r["_n"]) for r in marked.withColumn("f", is_first(["pos"])).collect()}
    first, count = {}, {}
    for pos, k, u in sorted(rows):
        first.setdefault(k, (pos, u))
        count[k] = count.get(k, 0) + 1
    assert got == {pos: (first[k][0] == pos, first[k][1], count[k]) for pos, k, _ in rows}
    kept = keep_first_rows(df, ["k"], ["pos"])
    assert {(r["k"], r["pos"], r["u"]) for r in kept.collect()} == {(k, *v) for k, v in first.items()}


def test_clean_marks_duplicates_and_short_pages(spark):
    body = "Plain words that fill a page well beyond the limit of one hundred characters, again and again, until it is enough."
    docs = [(1, "u1", "T", body), (2, "u2", "T", "short"), (3, "u3", "t!", body.upper()), (4, "u4", "", "")]
    df = spark.createDataFrame(docs, "pos long, url string, title string, content string").withColumns(
        {
            "headings": F.array().cast("array<struct<level:int,text:string>>"),
            "lists": F.array().cast("array<array<string>>"),
            "tables": F.array().cast("array<struct<rows:array<array<string>>>>"),
        }
    )
    rows = {r["pos"]: r for r in clean.clean_documents(df).collect()}
    assert [rows[i]["reason"] for i in (1, 2, 3, 4)] == ["", "extremely short page", "duplicate document", "empty document"]
    assert rows[3]["duplicate_of"] == "u1" and rows[1]["document_id"] == "doc-00001"
    summary = clean.clean_summary(clean.clean_documents(df)).first()
    assert (summary["total_documents"], summary["cleaned_documents"], summary["duplicates_removed"]) == (4, 1, 1)


# --- pages ----------------------------------------------------------------------------------------

def test_page_structure():
    doc = dom.document(dom.build(PAGE))
    assert doc["title"] == "My Page & more" or doc["title"].startswith("My")
    assert doc["meta_description"] == "about"
    assert doc["headings"] == [{"level": 1, "text": "Top"}]
    assert doc["content"] == "Top\n\none\n\ntwo\n\nnew end"
    assert doc["lists"] == [["a", "b c"]]
    assert doc["tables"] == [{"rows": [["h", ""], ["v", "w"]]}]
    assert "cookies" not in dom.visible_text(dom.build("<p>a<style>cookies</style></p>"))


def test_bad_pages_do_not_fail_the_job(spark):
    df = spark.createDataFrame([(1, "http://a.b/c/", PAGE), (2, "http://a.b/", None), (3, "http://[x", "<a href='q'>")], "i int, url string, html string")
    rows = {r["i"]: r for r in pages.read_pages(df, ["links", "needs_render"]).collect()}
    assert rows[1]["links"] == ["http://a.b/x?utm_source=1#f", "http://a.b/c/y/z/"]
    assert rows[2]["content"] == "" and rows[2]["needs_render"] is True
    links = pages.extract_links(df.filter("i = 1")).orderBy("pos").collect()
    assert [r["link"] for r in links] == ["http://a.b/x", "http://a.b/c/y/z"]


def test_open_comments_and_unknown_sections_are_no_text_and_no_error(spark):
    words = "<p>" + "word " * 100 + "</p>"
    htmls = ["<body><![foo bar]>" + words, "<body><p>x</p><!-- " + words, "<body><p>x</p><!-->" + words, "<body>" + words + "<![x y", "<body>x<!-- a --!>" + words]
    df = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    rows = {r["i"]: (r["needs_render"], r["error"], r["visible_text"][:3]) for r in pages.read_pages(df, ["needs_render", "visible_text"]).collect()}
    assert rows == {0: (False, None, "wor"), 1: (True, None, "x"), 2: (False, None, "x w"), 3: (False, None, "wor"), 4: (False, None, "x w")}


def test_robots_and_sitemaps(spark):
    body = "User-agent: badbot\nDisallow: /\n\nUser-agent: *\nAllow: /a/ok\nDisallow: /a\nDisallow:\nSITEMAP: https://h/s.xml\n"
    rules = robots.robots_rules(spark.createDataFrame([("h", body), ("g", "")], "host string, body string"))
    asked = spark.createDataFrame([("https://h/a/ok/1",), ("https://h/a/no",), ("https://h/b",), ("https://g/a",), ("https://q/a",)], "url string")
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(asked, rules).collect()}
    assert list(got[u[0]] for u in asked.collect()) == [True, False, True, True, True]
    assert rules.filter("host = 'h'").first()["sitemaps"] == ["https://h/s.xml"]
    index = "<sitemapindex><sitemap><loc>https://h/s1.xml</loc></sitemap><sitemap><loc>https://h/ar/s.xml</loc></sitemap></sitemapindex>"
    leaf = "<urlset xmlns='x'><url><loc>https://h/p/</loc><priority>2</priority></url><url><lastmod>x</lastmod></url></urlset>"
    bodies = spark.createDataFrame([("https://h/i.xml", index), ("https://h/s1.xml", leaf)], "url string, body string")
    reached = sitemaps.follow_indexes(bodies, bodies.filter("url like '%i.xml'").select("url"))
    assert {(r["url"], r["level"]) for r in reached.collect()} == {("https://h/i.xml", 0), ("https://h/s1.xml", 1)}
    found = sitemaps.sitemap_urls(bodies).collect()
    assert [(r["url"], r["priority"], r["last_modified"]) for r in found] == [("https://h/p", 1.0, "")]


def bfs(target, pages_, links, depth, cap):
    queue, visited, out = [(target, 0)], [], []
    while queue and len(visited) < cap:
        url, d = queue.pop(0)
        if url in visited:
            continue
        visited.append(url)
        if not pages_.get(url):
            continue
        out.append(url)
        if d < depth:
            queue += [(u, d + 1) for u in links.get(url, [])]
    return set(visited), set(out)


@pytest.mark.parametrize("cap", [3, 6, 80])
def test_reachability_matches_a_queue(spark, cap):
    rng = random.Random(cap)
    names = [f"https://h/p{i}" for i in range(30)]
    usable = {n: rng.random() < 0.8 for n in names}
    usable[names[0]] = True
    links = {n: rng.sample(names, 4) for n in names}
    p = spark.createDataFrame(list(usable.items()), "url string, usable boolean")
    e = spark.createDataFrame([(n, i, u) for n, us in links.items() for i, u in enumerate(us)], "url string, pos int, link string")
    seeds = spark.createDataFrame([(1, names[0])], "seed_id int, target string").withColumn("target", F.lit("https://h/"))
    p = p.withColumn("url", F.when(F.col("url") == names[0], "https://h/").otherwise(F.col("url")))
    e = e.replace(names[0], "https://h/")
    rename = lambda u: "https://h/" if u == names[0] else u
    plain_links = {rename(k): [rename(u) for u in v] for k, v in links.items()}
    visited, out = bfs("https://h/", {rename(k): v for k, v in usable.items()}, plain_links, 2, cap)
    rows = crawl.reachable_pages(seeds, p, e, 2, cap).collect()
    assert {r["url"] for r in rows} == visited
    assert {r["url"] for r in rows if r["discovered"]} == out


# --- chunks -----------------------------------------------------------------------------------------

def test_split_keeps_every_character_and_the_limit():
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 60))]
        sample = "".join(w + rng.choice([" ", ". ", "\n", "\n\n"]) for w in words)
        pieces = split_text(sample, 40, 0)
        assert all(0 < len(p) <= 40 for p in pieces)
        assert "".join("".join(pieces).split()) == "".join(sample.split())
        assert all(len(p) <= 40 for p in split_text(sample, 40, 15))
    assert split_text("aa bb cc", 5, 0) == ["aa bb", "cc"] or split_text("aa bb cc", 5, 0) == ["aa", "bb", "cc"]
    assert split_text("x" * 10, 4, 2) == ["xxxx", "xxxx", "xxxx", "xxxx"]
    assert split_text("", 4, 0) == []


def sequential_chunks(doc):
    """The stage written as a plain loop over one document."""
    import hashlib
    import re

    def est(t):
        n = len(t.strip())
        return 0 if not n else max(1, round(n / 4))

    ps = [p.strip() for p in re.split(r"\n\s*\n", doc["content"]) if p.strip()]
    head = lambda p: "\n" not in p and not p.startswith("- ") and len(p.split()) <= 10 and len(p) <= 90
    secs = []
    for i, p in enumerate(ps):
        if i == 0 or head(p):
            secs.append([p[:240] if head(p) else doc["section_heading"], [p]])
        else:
            secs[-1][1].append(p)
    merged, hold = [], []
    for h, parts in secs:
        hold.append((h, "\n\n".join(parts)))
        if est(hold[-1][1]) >= 12:
            merged.append(hold)
            hold = []
    merged += [hold] if hold else []
    out, seen = [], set()
    for group in merged:
        heading = next((h for h, _ in group if h), "")
        content = "\n\n".join(c for _, c in group)
        full = f"Page title: {doc['title']}\nSource URL: {doc['source_url']}\nSection: {heading}\n{content}"
        for piece in split_text(full, 2800, 400):
            key = re.sub(r"\W+", " ", piece.lower()).strip()
            if key not in seen:
                seen.add(key)
                out.append((heading, piece))
    return [
        (hashlib.sha256(f"{doc['document_id']}|{i}|{re.sub(chr(92) + 's+', ' ', c).strip()}".encode()).hexdigest(), h, c, est(c))
        for i, (h, c) in enumerate(out, 1)
    ]


@pytest.mark.parametrize("partitions", [1, 5])
def test_chunk_stage_matches_a_loop(spark, partitions):
    rng = random.Random(9)
    docs = []
    for i in range(40):
        paras = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([2, 5, 9, 30, 700]))) for _ in range(rng.randint(1, 12))]
        docs.append((i, f"d{i}", f"https://h/{i}", f"T{i}", "First line of it", "general", "website", "c", "\n\n".join(paras)))
    df = spark.createDataFrame(docs, "pos int, document_id string, source_url string, title string, section_heading string, category string, source_type string, collection string, content string")
    rows = chunk.chunk_documents(df.repartition(partitions)).collect()
    got = sorted((r["chunk_id"], r["metadata"]["heading"], r["content"], r["token_count"]) for r in rows)
    names = df.columns
    want = sorted(c for d in docs for c in sequential_chunks(dict(zip(names, d))))
    assert got == want
    assert {r["reason"] for r in rows} <= {"", "extremely small chunk", "duplicate chunk"}


# --- embedding, vectors, retrieval ----------------------------------------------------------------------

def test_embedding_states_and_failures(spark):
    rows = [(1, "a", "d", "one two"), (2, "b", "d", " "), (3, "c", "d", "one two "), (4, "e", "d", "boom"), (5, "f", "d", "cached")]
    meta = F.struct(*[F.lit("m").alias(c) for c in ("source_url", "title", "category", "heading", "collection")], F.lit(None).cast("string").alias("source_type"))
    chunks = spark.createDataFrame(rows, "pos int, chunk_id string, document_id string, content string").withColumn("metadata", meta)
    key = embed.content_key(F.lit("cached"))
    cache = spark.range(1).select(F.lit("m1").alias("model"), key.alias("content_hash"), F.array([F.lit(1.0).cast("float")] * 2).alias("embedding"))

    def load():
        def encode(texts):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    done = embed.embed_chunks(chunks.repartition(5, "pos"), cache, "m1", 2, ["pos"], load)
    got = {r["pos"]: (r["state"], r["error"]) for r in done.collect()}
    assert got[2] == ("failed", "empty content") and got[3][0] == "duplicate" and got[5] == ("cached", None)
    assert got[4] == ("failed", "boom")
    record = embed.embedding_records(done).filter("id = 'f'").first()
    assert record["metadata"]["source_type"] == "website" and record["embedding"] == [1.0, 1.0]
    s = embed.embedding_summary(done).first()
    assert s["total_chunks"] == 5 and s["embedded"] + s["failed"] + s["duplicates"] == 5


def brute_nearest(q, v, k):
    out = {}
    for (qid, sub, col), x in q.items():
        ds = sorted((round(float(((x - y) ** 2).sum()), 9), vid) for (c, vid), y in v.items() if c == col)
        out[(str(qid), sub)] = [(vid, d) for d, vid in ds[:k]]
    return out


@pytest.mark.parametrize("cell_rows", [1024, 12])
def test_nearest_is_exact_with_ties_and_a_hot_vector(spark, cell_rows):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).astype("float32")
    v = {("c%d" % (i % 2), f"v{i:03d}"): (hot if i % 3 == 0 else rng.normal(size=8).astype("float32")) for i in range(300)}
    q = {(i, 0, "c%d" % (i % 3)): (hot if i == 4 else rng.normal(size=8).astype("float32")) for i in range(12)}
    qs = spark.createDataFrame([(a, b, c, [float(z) for z in x]) for (a, b, c), x in q.items()], "question_id int, sub_idx int, collection string, embedding array<float>")
    vs = spark.createDataFrame([(c, i, [float(z) for z in x]) for (c, i), x in v.items()], "collection string, id string, embedding array<float>")
    hits = retrieve.nearest_vectors(qs, vs.repartition(6), k=7, cell_rows=cell_rows).collect()
    got = {}
    for r in sorted(hits, key=lambda r: r["rank"]):
        got.setdefault((r["question_id"], r["sub_idx"]), []).append((r["id"], r["distance"]))
    want = {k: x for k, x in brute_nearest(q, v, 7).items() if x}
    assert {k: [i for i, _ in x] for k, x in got.items()} == {k: [i for i, _ in x] for k, x in want.items()}
    assert retrieve.nearest_vectors(qs, vs, k=0).count() == 0


def test_vectors_of_two_widths_and_unusable_questions(spark):
    wide, narrow = [1.0, 2.0, 3.0], [1.0, 2.0]
    vs = spark.createDataFrame([("a", "w", wide), ("a", "n", narrow), ("b", "n2", narrow), ("b", "z", [1.0, None])], "collection string, id string, embedding array<float>")
    rows = [(1, 0, "a", wide), (2, 0, "a", narrow), (3, 0, "b", wide), (4, 0, "c", narrow), (5, 0, None, narrow), (6, 0, "b", None), (7, 0, "b", [None, 1.0])]
    qs = spark.createDataFrame(rows, "question_id int, sub_idx int, collection string, embedding array<float>")
    got = {(r["question_id"], r["id"]) for r in retrieve.nearest_vectors(qs, vs).collect()}
    assert got == {("1", "w"), ("2", "n")}
    reasons = {r["question_id"]: r["reason"] for r in retrieve.unanswerable(qs, vs).collect()}
    assert reasons == {3: "other width than the collection", 4: "empty collection", 5: "no collection", 6: "no embedding", 7: "incomplete embedding"}


def test_a_failing_pair_model_gives_the_constant_score(spark):
    """The batch's pairs have no score; ``rerank`` gives their questions the constant.  tests/test_scale.py has several batches."""
    def load():
        def score(pairs):
            if any(q == "bad" for q, _ in pairs):
                raise RuntimeError("no model")
            return [float(len(q) + len(c)) for q, c in pairs]

        return score

    scorer = retrieve.pair_scorer(load)
    for rows, want, ranks in (([("a", "bc"), (None, "x")], [3.0, 1.0], [0.95, 0.05]), ([("bad", "x"), ("a", "b")], [None, None], [0.65, 0.65])):
        df = spark.createDataFrame(rows, "q string, c string").coalesce(1)
        assert [r[0] for r in df.select(scorer(F.col("q"), F.col("c"))).collect()] == want
        scored = df.select(F.lit(1).alias("question_id"), scorer(F.col("q"), F.col("c")).alias("raw_score"), F.monotonically_increasing_id().alias("cand_pos"))
        ranked = retrieve.rerank(scored.withColumns({"skip": F.lit(False), "semantic_score": F.lit(0.5)}))
        assert [r["rerank_score"] for r in ranked.orderBy("cand_pos").collect()] == pytest.approx(ranks)


def test_rerank_and_confidence_edges(spark):
    rows = [(1, 1, 0.5, 0.2), (1, 2, 0.4, 0.2), (2, 1, 0.9, None), (2, 2, 0.3, None), (3, 1, 0.1, 0.5), (3, 2, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "question_id int, cand_pos int, semantic_score double, raw_score double").withColumns(
        {"skip": F.col("question_id") == 2, "document": F.when(F.col("cand_pos") == 1, "I don't know").otherwise("x")}
    )
    ranked = retrieve.rerank(df)
    got = {(r["question_id"], r["cand_pos"]): r for r in ranked.collect()}
    assert got[(1, 1)]["rerank_score"] == pytest.approx(0.5) and got[(2, 1)]["final_score"] == 0.9
    assert (got[(3, 1)]["rerank_score"], got[(3, 2)]["rerank_score"]) == (pytest.approx(0.95), pytest.approx(0.05))
    kept = retrieve.accept(ranked, 5)
    assert kept.filter("question_id = 3").count() == 2  # nobody reaches the floor: all stay
    c = {r["question_id"]: r for r in retrieve.confidence(kept).collect()}
    one = 0.30 * 0.45 + 0.35 * 0.5 + 0.27 * (0.75 * 0.5 + 0.25 * 0.5) + 0.08 * 0.5 + 0.03
    assert c[1]["confidence"] == pytest.approx(round(one, 2)) and c[1]["confidence_factors"]["answerability"] == 50.0
    assert all(0 <= r["confidence"] <= 1 for r in c.values())


def test_factors_are_all_five(spark, tmp_path):
    """The reference tells five factors; a chunk that refuses lowers ``answerability``."""
    from pagemill.plans import Tables, load_all

    said = ["Plain words on the first thing.", "We Cannot Answer this one.", "Plain words on the third thing."]
    docs = [(i, said[i], "en", "src", len(said[i])) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [1.0, 0.0], 1)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = load_all()["conf_factors_pct"].build(Tables(spark, str(tmp_path))).collect()
    got = {r["question_id"]: r.asDict() for r in rows}
    assert {q: (r.get("answerability"), r["grounding"]) for q, r in got.items()} == {"0": (50.0, 50.0), "1": (50.0, 50.0), "2": (100.0, 33.33)}
    assert set(got["0"]) == {"question_id", "semantic", "rerank", "top_score", "answerability", "grounding"}


def test_vector_table_replays_and_upserts(spark):
    def batch(pairs):
        meta = F.struct(*[F.lit("m").alias(f) for f in ("chunk_id", "document_id", "source_url", "title", "category", "heading", "source_type")], F.lit("c").alias("collection"))
        return spark.createDataFrame(pairs, "id string, document string").select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"), "document", meta.alias("metadata"))

    table = vectors.VectorTable(spark, scratch_dir(spark, "t"))
    assert table.read().count() == 0
    table.write(batch([("a", "1"), ("b", "1")]), 0)
    for _ in range(2):
        table.write(batch([("b", "2"), ("d", "2")]), 1)
    state = {(r["id"], r["document"]) for r in table.read("c").collect()}
    assert state == {("a", "1"), ("b", "2"), ("d", "2")}
    assert {(r["id"], r["document"]) for r in table.compact().read().collect()} == state
    table.write(batch([]), 1)  # a replay without rows leaves none behind
    assert {(r["id"], r["document"]) for r in table.read("c").collect()} == {("a", "1"), ("b", "1")}
    assert [r[0] for r in table.collections().collect()] == ["c"]
    table.drop("c")
    assert table.counts().count() == 0  # in place: the same table, not a copy


def page_tables(spark, rows, files=1):
    """A folder with a page table alone, and an SQL connection to it."""
    import duckdb

    from pagemill.plans import Tables

    folder = scratch_dir(spark, "tables")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.repartitionByRange(files, "page_id").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return Tables(spark, folder), con


def test_raw_pages_of_one_url_keep_their_own_file(spark):
    from pagemill.plans import load_all

    rows = [(0, "https://a/x", "one"), (1, "https://a/x", "three"), (2, "https://a/y#top", "z"), (3, "http://a/x", "n"), (4, None, "u")]
    t, con = page_tables(spark, rows)
    query = load_all()["src_raw_pages"]
    want = con.execute(query.sql)
    names = [d[0] for d in want.description]
    got = query.build(t).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and len(got) == 3


def test_workers_hold_few_rows_at_a_time(spark):
    import pyarrow as pa

    from pagemill.functions import tokens
    from pagemill.functions.slices import small_batches

    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": ["x" * 100] * 1000})
    for size, most in ((1 << 20, 256), (2000, 20), (1, 1)):
        got = list(small_batches(iter([batch, batch.slice(0, 0)]), ["t"], size=size))
        assert [i for b in got for i in b.column("i").to_pylist()] == list(range(1000)) and max(map(len, got)) <= most
        assert len(got[-1]) == 0 and got[-1].schema == batch.schema

    most = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            if len(texts) > 256:
                most.add(1)
            return [t.split() for t in texts]

        return encode

    def load_model():
        def score(pairs):
            if len(pairs) > 256:
                most.add(1)
            return [len(a) for a, _ in pairs]

        return score

    df = spark.range(0, 1000, 1, 1).select(F.concat_ws(" ", "id", F.lit("a")).alias("t"))
    counted = df.select("t", tokens.bpe_counter(load)(F.col("t")).alias("n"), retrieve.pair_scorer(load_model)(F.col("t"), F.col("t")).alias("s"))
    assert all(r["n"] == 2 and r["s"] == len(r["t"]) for r in counted.collect()) and most.value == 0


# --- streaming ----------------------------------------------------------------------------------------

def page(i, words):
    return (i, f"https://h/en/{i}?utm_source=x", f"<html lang=en><title>P{i}</title><article><h1>Page {i}</h1><p>{words} {i}.</p></article></html>")


def test_stream_restart_and_replay_add_nothing(spark):
    words = "This is a page about the number that it has, with words for the gate and a body of text to index"
    rows = [page(i, words) for i in range(6)] + [(6, "https://h/fr/6", "<html lang=fr><p>Bonjour le monde</p></html>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_dir(spark, "pages")
    frame.filter("page_id < 3").coalesce(1).write.parquet(path)
    split_run = SiteIndexer(spark, scratch_dir(spark, "a"), "site")
    split_run.run(path)
    frame.filter("page_id >= 2").coalesce(1).write.mode("append").parquet(path)
    split_run.run(path).run(path)
    whole = scratch_dir(spark, "pages")
    frame.coalesce(1).write.parquet(whole)
    one_run = SiteIndexer(spark, scratch_dir(spark, "b"), "site").run(whole)
    pick = lambda job: {(r["id"], r["document"]) for r in job.vectors().read().collect()}
    assert pick(split_run) == pick(one_run) and len(pick(one_run)) == 6
    assert split_run.summary().first()["pages"] == 7 and split_run.summary().first()["non_english"] == 1
    before = pick(split_run)
    split_run.index_batch(frame.filter("page_id >= 2"), 1)  # the same batch once more
    assert pick(split_run) == before and split_run.stats().count() == 2
    assert split_run.progress().first()["status"] == "done"


def test_stream_batches_do_not_follow_the_files_of_the_table(spark):
    from pagemill.plans import stream_queries

    rows = [(i, f"https://a/{i % 30}", PAGE) for i in range(40)]
    t, _ = page_tables(spark, rows, files=7)
    assert stream_queries.files_of(t, f"{t.folder}/pages.parquet") == 7
    path, files = stream_queries.page_files(t)
    job = SiteIndexer(spark, scratch_dir(spark, "parts"), "site").run(path, files)
    assert sorted((r["batch"], r["pages"]) for r in job.stats().collect()) == [(0, 20), (1, 10)]


def test_stream_retries_pages_that_failed_and_forces_in_place(spark):
    words = "This is a page about the number that it has, with words for the gate and a body of text to index"
    names = "page_id long, url string, html string"
    path = scratch_dir(spark, "pages")
    first = [page(0, words), (1, "https://h/en/1", None)]
    spark.createDataFrame(first, names).write.parquet(path)
    job = SiteIndexer(spark, scratch_dir(spark, "retry"), "site", crawled_at="2024-01-01T00:00:00+00:00").run(path)
    assert [r["url_key"] for r in job.processed_urls().collect()] == ["https://h/en/0"]
    spark.createDataFrame([page(1, words)], names).write.mode("append").parquet(path)
    assert job.run(path).processed_urls().count() == 2
    other = scratch_dir(spark, "pages")
    spark.createDataFrame([page(5, words)], names).write.parquet(other)
    job.run(other, force=True)
    assert [r["url_key"] for r in job.run(other).processed_urls().collect()] == ["https://h/en/5"]
    assert {r["document"].split()[0] for r in job.vectors().read().collect()} and job.stats().count() == 1


# --- sources ---------------------------------------------------------------------------------------------

def test_lenient_and_strict_json(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("a", "long")
    (tmp_path / "ok.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "bad.json").write_text('[{"a": 1}, {"a"')
    assert stage.read_stage_json(spark, str(tmp_path / "ok.json"), schema).count() == 2
    with pytest.raises(Exception):
        stage.read_stage_json(spark, str(tmp_path / "bad.json"), schema).collect()
    assert stage.read_lenient_table(spark, str(tmp_path / "bad.json"), schema).collect() == []
    assert stage.read_lenient_table(spark, str(tmp_path / "none.json"), schema).collect() == []


# --- plans -------------------------------------------------------------------------------------------------

def test_no_query_plans_a_cartesian_product(spark):
    from pagemill.plans import Tables, load_all

    slow = ("stream_", "sink_", "src_", "vec_", "chunk_documents", "chunk_summary")
    t = Tables(spark, "/root/testdata/sf0.001")
    for name, q in load_all().items():
        if name.startswith(slow):
            continue
        plan = q.build(t)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
