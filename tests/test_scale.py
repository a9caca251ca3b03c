"""What plans do at size: no wide column in a de-duplication shuffle, stored sides left in place, cells left out."""

import random
import re
import time
from urllib.robotparser import RobotFileParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators import crawl, dedup, embed, retrieve, usage, vector_cells, vectors
from pagemill.session import scratch_dir
from pagemill.sources import robots, sitemaps, stage
from pagemill.sources.bucketed import BucketedTable
from pagemill.streaming import usage as stream_usage
from pagemill.streaming.indexer import SiteIndexer


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(plan):
    """The output columns of what each exchange of a formatted plan moves."""
    return re.findall(r"Exchange\n(?:Input \[\d+\]: \[([^\]]*)\])", plan)


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# --- first wins ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_first_rows_are_marked_whatever_the_sketch_confuses(spark, bits):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([None, "hot", "hot", *"abcdefgh", f"own{k}"]), rnd.choice([None, 1, 2]), rnd.random() < 0.8) for k in range(900)]
    df = spark.createDataFrame(rows, "pos int, key string, part int, ok boolean").withColumn("text", F.repeat("key", 3))
    for where in (None, F.col("ok")):
        got = {r["pos"]: r["_is_first"] for r in dedup.mark_first(df.repartition(5), ["key", "part"], ["pos"], where, bits).collect()}
        seen, want = set(), {}
        for pos, key, part, ok in rows:
            if where is not None and not ok:
                want[pos] = None
            else:
                want[pos] = (key, part) not in seen
                seen.add((key, part))
        assert got == want
    assert dedup.mark_first(df.limit(0), ["key"], ["pos"]).collect() == []


def test_no_wide_column_is_shuffled_to_mark_repeats(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("key"), F.repeat(F.lit("x"), 100).alias("wide_text"))
    dedup_only = dedup.mark_first(df.filter("pos < 900"), ["key"], ["pos"])
    moved = [m for m in exchanged(formatted(dedup_only)) if "wide_text" in m]
    assert len(moved) <= 1  # the first rows and what the sketches take for such
    few = spark.createDataFrame([(k, f"k{k % 5}", "w") for k in range(2000)], "pos int, url string, wide_text string")
    marked = crawl.filter_urls(few, ["pos"], "url")
    doubtful = marked.filter("outcome <> 'duplicate'").count()
    assert doubtful == 5 and marked.count() == 2000


# --- nearest vectors -----------------------------------------------------------------------------------------


def clustered(rng, clusters, each, width=16):
    centres = rng.normal(size=(clusters, width)) * 4
    return [(f"v{k * each + i}", [float(x) for x in (centres[k] + rng.normal(size=width) * 0.2).astype("float32")]) for k in range(clusters) for i in range(each)]


def brute(questions, stored, k):
    q, v = np.array([e for _, e in questions]), np.array([e for _, e in stored])
    d = np.round((q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * q @ v.T, 9)
    return {name: [stored[j][0] for j in sorted(range(len(stored)), key=lambda j: (row[j], stored[j][0]))[:k]] for (name, _), row in zip(questions, d, strict=True)}


def test_questions_visit_few_cells_and_lose_nothing(spark):
    rng = np.random.default_rng(3)
    stored = clustered(rng, 40, 30)
    stored += [(f"copy{i}", stored[0][1]) for i in range(200)]  # a hot vector
    questions = [(str(i), [float(x) for x in np.array(stored[int(rng.integers(1200))][1]) + rng.normal(size=16) * 0.1]) for i in range(50)]
    vs = spark.createDataFrame([("c", *r) for r in stored], "collection string, id string, embedding array<double>").repartition(6)
    qs = spark.createDataFrame([(q, 0, "c", e) for q, e in questions], "question_id string, sub_idx int, collection string, embedding array<double>")
    hits = retrieve.nearest_vectors(qs, vs, k=7, cell_rows=10).collect()
    got = {}
    for r in sorted(hits, key=lambda r: r["rank"]):
        got.setdefault(r["question_id"], []).append(r["id"])
    assert got == brute(questions, stored, 7)

    asked = qs.select("collection", F.col("question_id").alias("key"), "embedding", F.size("embedding").alias("width"))
    held = vs.withColumn("width", F.size("embedding"))
    cells = vector_cells.centres(held, 10)
    placed = vector_cells.place_vectors(held, cells)
    routed = vector_cells.route(asked, vector_cells.summaries(placed).join(cells, ["collection", "width", "cell"]), 7)
    scanned = routed.agg(F.sum("n")).first()[0]
    assert scanned < len(questions) * len(stored) / 3


def test_slices_of_cells_and_portions_of_questions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for name, value in (("SLICE_ROWS", 25), ("QUESTIONS", 9), ("TILE_ROWS", 4)):
        monkeypatch.setattr(vector_cells, name, value)
    stored, other = clustered(rng, 5, 40, 4), clustered(rng, 3, 10, 3)
    questions = [(str(i), [float(x) for x in rng.normal(size=4) * 4]) for i in range(30)]
    rows = [("c", *r) for r in stored] + [("c", *r) for r in other] + [("d", "inf", [float("inf")] * 4)]
    vs = spark.createDataFrame(rows, "collection string, id string, embedding array<double>")
    asked = [(q, 0, "c", e) for q, e in questions] + [("x", 0, "d", [1.0] * 4), ("y", 0, "none", [1.0] * 4)]
    qs = spark.createDataFrame(asked, "question_id string, sub_idx int, collection string, embedding array<double>")
    got = {}
    for r in sorted(retrieve.nearest_vectors(qs, vs, k=3, cell_rows=20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["question_id"], []).append(r["id"])
    assert got == brute(questions, stored, 3)
    few = retrieve.nearest_vectors(qs.filter("question_id = '1'"), vs.filter("id in ('v1', 'v2')"), k=5, cell_rows=20)
    assert few.filter("rank <= 2").count() == few.count() <= 3


def test_a_failed_pair_model_gives_the_constant_after_smoothing(spark):
    """One question's pairs lie in two batches, of which one fails; another question is scored."""

    def load():
        def score(pairs):
            if any(c == "boom" for _, c in pairs):
                raise RuntimeError("no model")
            return [float(len(c)) for _, c in pairs]

        return score

    rows = [(1, k, "q", "boom" if k == 39 else "x" * (k + 1)) for k in range(40)] + [(2, k, "q", "x" * (k + 1)) for k in range(20)]
    df = spark.createDataFrame(rows, "question_id int, cand_pos int, q string, c string").repartition(12, "cand_pos")
    scored = df.withColumns({"raw_score": retrieve.pair_scorer(load)(F.col("q"), F.col("c")), "skip": F.lit(False), "semantic_score": F.lit(0.5)})
    got = {(r["question_id"], r["cand_pos"]): r["rerank_score"] for r in retrieve.rerank(scored).collect()}
    assert {s for (q, _), s in got.items() if q == 1} == {0.65}
    if all(s == 0.65 for (q, _), s in got.items() if q == 2):  # its pairs shared the failed batch
        return
    assert got[2, 0] == pytest.approx(0.05) and got[2, 19] == pytest.approx(0.95)


# --- tables bucketed by key ------------------------------------------------------------------------------------


def test_stored_sides_stay_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = BucketedTable(spark, scratch_dir(spark, "cache"), T.StructType().add("model", "string").add("content_hash", "string").add("embedding", embed.VECTOR), "content_hash", 4)
        held = spark.range(100).select(F.lit("m").alias("model"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
        for batch in (0, 1, 1):
            cache.write(held.filter(F.col("content_hash") > ("8" if batch else "")).limit(60), batch)
        keyed = spark.range(50, 150).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
        found = embed.lookup_cache(keyed, cache, "m")
        assert plan_of(found).count("Exchange") == 1  # of the looked-up keys
        want = {r["content_hash"] for r in cache.read().collect()} & {r["content_hash"] for r in keyed.collect()}
        assert {r["content_hash"] for r in found.filter("cached is not null").collect()} == want
        assert {r["batch"] for r in cache.before(1).read().select("batch").distinct().collect()} == {0}
        spark.sql(f"DROP TABLE {cache.name}")  # as in a new session: the files tell all
        assert {r["batch"] for r in cache.read().select("batch").distinct().collect()} == {0, 1}

        table = vectors.VectorTable(spark, scratch_dir(spark, "vt"), buckets=4)
        meta = F.struct(*[F.lit("m").alias(f) for f in vectors.METADATA.fieldNames()[:-1]], (F.col("id") % 2).cast("string").alias("collection"))
        rows = spark.range(40).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("embedding"), F.lit("old").alias("document"), meta.alias("metadata"))
        table.write(rows, 0)
        table.write(rows.filter("id < 10").withColumn("document", F.lit("new")), 1)
        assert "Exchange" not in plan_of(table.read())
        assert table.read().filter("document = 'new'").count() == 10 and table.read().count() == 40
        assert {(r["collection"], r["vectors"]) for r in table.counts().collect()} == {("0", 20), ("1", 20)}
        folded = table.compact()
        assert folded.read().count() == 40 and folded.stored.read().count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_usage_counts_late_and_repeated_batches(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), f"2024-0{rnd.randint(1, 3)}-{rnd.randint(10, 28)} 0{rnd.randint(0, 9)}:00:00", rnd.randint(0, 50)) for _ in range(300)]
    events = spark.createDataFrame(rows, "user_id long, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("b", (F.col("tokens") % 4).cast("int"))
    kept = usage.UsageTotals(spark, scratch_dir(spark, "totals"), buckets=4)
    for batch in (0, 1, 2, 1, 3, 3):  # every batch has events of all months
        kept.add(events.filter(F.col("b") == batch), batch)
    columns = ["user_id", "date", "queries", "chats", "tokens", "label"]
    pick = lambda df, cs: sorted(tuple(r[c] for c in cs) for r in df.collect())
    assert pick(kept.daily(), columns) == pick(usage.daily_usage(events), columns)
    months = ["user_id", "month", "queries", "chats", "tokens", "label"]
    assert pick(kept.monthly(), months) == pick(usage.monthly_usage(events), months)
    assert pick(kept.fold(scratch_dir(spark, "folded")).daily(), columns) == pick(kept.daily(), columns)
    assert "Exchange" not in plan_of(kept.daily())


def test_an_event_ten_days_late_is_counted(spark):
    path, out = scratch_dir(spark, "events"), scratch_dir(spark, "daily")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    days = [("2024-03-20", 1.0), ("2024-03-21", 2.0), ("2024-03-10", 4.0)]
    for k, (day, value) in enumerate(days):
        row = spark.createDataFrame([(k, day + " 12:00:00", 7, "click", value, "")], "event_id long, ts string, user_id long, event_type string, value double, props string")
        row.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(path)
        stream_usage.start_daily(spark, path, out).awaitTermination()
    got = {str(r["date"]): (r["queries"], r["tokens"]) for r in stream_usage.read_daily(spark, out).collect()}
    assert got == {day: (1, int(value)) for day, value in days} and schema


# --- streams -----------------------------------------------------------------------------------------------------

WORDS = "This is a page about the number that it has, with words for the gate and a body of text to index"


def page(i):
    return (i, f"https://h/en/{i}", f"<html lang=en><title>P{i}</title><article><h1>Page {i}</h1><p>{WORDS} {i}.</p></article></html>")


def test_batches_read_no_processed_urls_and_repeats_stay_out(spark, monkeypatch):
    path = scratch_dir(spark, "pages")
    names = "page_id long, url string, html string"
    job = SiteIndexer(spark, scratch_dir(spark, "keyed"), "site", crawled_at="2024-01-01T00:00:00+00:00")
    monkeypatch.setattr(SiteIndexer, "processed_urls", lambda self: pytest.fail("a batch read the processed URLs"))
    rows = [page(0), page(1), (2, "https://h/en/1/?utm_source=x", page(1)[2]), (3, "https://h/en/3", "  ")]
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(path)
    job.run(path)
    spark.createDataFrame([(4, "https://h/en/0", page(0)[2]), (5, "https://h/en/3", page(3)[2]), page(6)], names).coalesce(1).write.mode("append").parquet(path)
    job.run(path)
    stats = {r["batch"]: r for r in job.stats().collect()}
    assert (stats[0]["pages"], stats[0]["english"]) == (3, 2) and (stats[1]["pages"], stats[1]["english"]) == (2, 2)
    assert {r["document"].split()[0] for r in job.vectors().read().collect()} and job.summary().first()["pages"] == 5


def test_the_listener_tells_running_done_and_failed(spark):
    path, names = scratch_dir(spark, "pages"), "page_id long, url string, html string"
    spark.createDataFrame([page(0)], names).coalesce(1).write.parquet(path)
    job = SiteIndexer(spark, scratch_dir(spark, "told"), "site")
    query = job.start(path, pause="1 second")
    query.processAllAvailable()
    assert job.progress().select("status", "stored_chunks", "message").first() == ("indexing", 1, "")
    query.stop()
    assert job.listener.ended().status == "done" and job.progress().first()["status"] == "done"
    assert job.listener.state.rows == 1

    def broken():
        raise RuntimeError("no encoder here")

    spark.createDataFrame([page(1)], names).coalesce(1).write.mode("append").parquet(path)
    job.load_encoder = broken
    with pytest.raises(Exception, match="no encoder here"):
        job.run(path)
    row = job.progress(total_batches=5).first()
    assert row["status"] == "error" and "no encoder here" in row["message"] and row["current_batch"] == 1
    job.load_encoder = embed.hashing_encoder
    assert job.run(path).progress().first()["status"] == "done" and job.stats().count() == 2


# --- sources and sinks -----------------------------------------------------------------------------------------------


def slow_rules(body, agent):
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    groups = [g for g in parser.entries if g.applies_to(agent)]
    group = groups[0] if groups else parser.default_entry
    return [(r.path, r.allowance) for r in group.rulelines] if group else []


def test_robots_rules_are_those_of_the_standard_parser(spark):
    rnd = random.Random(6)
    agents = ["*", "goodbot", "GoodBot/2.1", "bad", "", "other", "%2A"]
    paths = ["/", "", "/a", "/a%20b", "/a b", "/x?q=1", "/x?", "/y#frag", "/z;p", "/z;", "*", "/ü", "/%zz", "/%41%zz", "/a+b", "/~u/*", "/%2F/c"]

    def line():
        kind = rnd.random()
        if kind < 0.2:
            return rnd.choice(["", "", "  ", "# note", "nonsense", "Host: x", "\t"])
        if kind < 0.5:
            return f"{rnd.choice(['User-agent', 'user-AGENT ', ' User-Agent'])}:{rnd.choice(['', ' '])}{rnd.choice(agents)}{rnd.choice(['', '  # c'])}"
        name = rnd.choice(["Disallow", "disallow ", "Allow", " ALLOW", "Crawl-delay", "Request-rate", "Sitemap"])
        return f"{name}: {rnd.choice(paths)}{rnd.choice(['', '', ' #x'])}"

    bodies = [(f"h{k}", rnd.choice(["\n", "\r\n", "\n"]).join(line() for _ in range(rnd.randint(0, 25))) + rnd.choice(["", "\n"])) for k in range(400)]
    df = spark.createDataFrame([*bodies, ("null", None)], "host string, body string")
    for agent in ("*", "GoodBot", "bad/1.0"):
        found = robots.rules_of(robots.body_lines(df), agent)
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["pos"]):
            got.setdefault(r["host"], []).append((r["path"], r["allow"]))
        want = {h: rules for h, b in bodies if (rules := slow_rules(b, agent))}
        assert got == want
    plan = plan_of(robots.rules_of(robots.body_lines(df), "*"))
    assert "Python" not in plan and "Arrow" not in plan


def test_robots_files_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "robots.txt").write_text("User-agent: *\n" + "\n".join(f"Disallow: /p{k}" for k in range(5000)) + "\nSitemap: https://h/s.xml\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = robots.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 2
        got = [r["path"] for r in robots.rules_of(lines).orderBy("pos").collect()]
        assert got == [f"/p{k}" for k in range(5000)] and robots.sitemaps_of(lines).first()["sitemap"] == "https://h/s.xml"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_sitemap_file_is_read_by_several_tasks(spark, tmp_path):
    entries = "".join(f"<url>\n<loc> https://h/p{k}?a=1&amp;b=2 </loc><priority>0.{k % 10}</priority></url>\n" for k in range(4000))
    broken = "<url><loc>https://h/broken</url><url lang='x'><loc>https://h/after</loc><lastmod>2024-01-01</lastmod></url>"
    (tmp_path / "s.xml").write_text(f"<?xml version='1.0'?><urlset xmlns='x'>{entries}{broken}<url><lastmod>none</lastmod></url></urlset>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = sitemaps.read_entries(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        assert rows.filter("corrupt is not null").count() == 1
        found = sitemaps.entry_urls(rows)
        assert found.count() == 4001 and found.filter("last_modified = '2024-01-01'").first()["url"] == "https://h/after"
        ordered = [r["url"] for r in found.orderBy("pos").collect()]
        assert ordered[:3] == [f"https://h/p{k}?a=1&b=2" for k in range(3)] and ordered[-1] == "https://h/after"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_both_sides_are_written_by_one_run_of_the_stage(spark):
    runs, place = spark.sparkContext.accumulator(0), scratch_dir(spark, "sides")

    @F.udf("string")
    def reason(x):
        runs.add(1)
        if x == 400:
            raise RuntimeError("task lost")
        return "odd" if x % 2 else None

    good = spark.range(100).repartition(3).withColumn("reason", reason("id"))
    stage.write_split(good, "reason", f"{place}/a", f"{place}/r")
    read = lambda side: spark.read.parquet(f"{place}/{side}")
    assert runs.value <= 200 and read("a").count() == 50 and read("a").filter("reason is not null").count() == 0
    assert {r["reason"] for r in read("r").collect()} == {"odd"}
    before = sorted(r["id"] for r in read("a").collect())
    with pytest.raises(Exception, match="task lost"):
        stage.write_split(spark.range(1000).repartition(3).withColumn("reason", reason("id")), "reason", f"{place}/a", f"{place}/r")
    assert sorted(r["id"] for r in read("a").collect()) == before
    stage.write_split(good.filter("id % 2 = 0"), "reason", f"{place}/a", f"{place}/r")
    assert read("r").count() == 0 and read("r").columns == ["id", "reason"]


def test_time_of_batches_does_not_grow_with_urls_seen(spark):
    """The stateful part alone: later batches take as long as earlier ones."""
    path, names = scratch_dir(spark, "pages"), "page_id long, url string, html string"
    job = SiteIndexer(spark, scratch_dir(spark, "steady"), "site")
    took = []
    job.index_parsed = lambda rows, batch: took.append((time.perf_counter(), rows.count()))
    for k in range(12):
        spark.createDataFrame([page(10 * k + i) for i in range(10)], names).coalesce(1).write.mode("append").parquet(path)
    job.run(path, files_per_batch=1)
    assert [n for _, n in took] == [10] * 12
