"""Hand-written rows for every rule with a threshold, an order or an edge."""

import pytest
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions import language, policy, repair, scores, text, tokens, urls
from pagemill.operators import chunk, tenants

C = F.col


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Example.COM/A/B/?UTM_Source=x&b=2&B=3&a=&gclid=1#frag", "https://example.com/a/b?b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com///", "https://example.com/"),
        ("https://example.com/p?z=1&a=2", "https://example.com/p?z=1&a=2"),
        ("https://example.com/p?q=a%20b&ref=x", "https://example.com/p?q=a+b"),
        ("https://example.com/p?q=caf%C3%A9", "https://example.com/p?q=caf%c3%a9"),
        ("https://example.com/p?novalue&k=v", "https://example.com/p?k=v"),
        ("  https://example.com/p?q=100%zz ", "https://example.com/p?q=100%25zz"),
    ],
)
def test_normalize_url(spark, one, url, expected):
    assert one(urls.normalize_url(C("u")), u=url) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Example.COM/A/?b=2&a=9&a=1&c=#f", "https://example.com/A?a=1&a=9&b=2"),
        ("https://example.com/?", "https://example.com/"),
        ("/only/path/", "/only/path"),
    ],
)
def test_canonicalize_url(spark, one, url, expected):
    assert one(urls.canonicalize_url(C("u")), u=url) == expected


def test_site_names(spark, one):
    assert one(urls.normalize_site_url(C("u")), u="WWW.Example.com") == "https://www.example.com"
    assert one(urls.normalize_site_url(C("u")), u="http://EX.com/Path/?q=1") == "http://ex.com/Path"
    assert one(urls.site_domain(C("u")), u="www.example.com") == "example.com"
    assert one(urls.site_slug(C("u")), u="https://www.my-site.co.uk/x") == "my_site_co_uk"
    assert one(urls.tenant_slug(C("u")), u="__User--42@Example.org.very.long") == "user_42_example_org"
    assert one(urls.tenant_slug(C("u")), u="---") == "user"
    assert one(urls.collection_name(C("u"), C("w")), u="https://a.b/", w="U 1") == "website_a_b_u_u_1"
    assert one(urls.collection_name(C("u"), C("w")), u="https://a.b/", w="") == "website_a_b"


@pytest.mark.parametrize(
    "path, category",
    [("/en/", "home"), ("/hi/blog/x", "blog"), ("/en/team/work", "case_study"), ("/en/team", "general"), ("/uses", "resources")],
)
def test_category(spark, one, path, category):
    assert one(urls.url_category(C("u")), u="https://a.b" + path) == category


@pytest.mark.parametrize(
    "url, blocked",
    [
        ("https://a.b/file.PDF", True),
        ("https://a.b/file.pdf/", True),
        ("https://a.b/.pdf", False),
        ("https://a.b/x?f=a.pdf", False),
        ("https://a.b/midterms-2020", True),
        ("https://a.b/x.pdf.html", False),
        ("https://a.b/Sign-Up", True),
    ],
)
def test_blocked(spark, one, url, blocked):
    assert one(urls.is_blocked_url(C("u")), u=url) is blocked


def test_scope_and_sitemap_rules(spark, one):
    inside = urls.in_scope(C("u"), F.lit("https://a.b/en"))
    assert one(inside, u="https://a.b/en") and one(inside, u="https://a.b/en/x")
    assert not one(inside, u="https://a.b/english") and not one(inside, u="https://c.b/en/x")
    assert one(urls.should_index_sitemap(C("u")), u="https://a.b/en/sitemap.xml")
    assert not one(urls.should_index_sitemap(C("u")), u="https://a.b/AR-SA/sitemap.xml")
    assert [one(urls.sitemap_priority(C("p")), p=p) for p in ("", "0.7", "9", "-1", "high", "nan")] == [0.5, 0.7, 1.0, 0.0, 0.5, 0.5]


def english(words, hits):
    return " ".join(["the"] * hits + ["zorp"] * (words - hits))


@pytest.mark.parametrize(
    "sample, expected",
    [
        ("", False),
        (english(24, 1), True),
        (english(24, 0), False),
        (english(25, 0), False),
        (english(100, 3), True),
        (english(100, 2), False),
        (english(67, 2), False),
        (english(66, 2), True),
        ("the cat и", False),
        ("the " + "a" * 14 + "é" * 3, True),
        ("the " + "a" * 13 + "é" * 3, False),
        ("12345 !!", False),
    ],
)
def test_english_gate(spark, one, sample, expected):
    assert one(language.looks_english(C("t")), t=sample) is expected


def test_declared_language(spark, one):
    page = "<!-- <html lang='fr'> --><HTML dir=ltr LANG='en-US'><meta content='de' name='Language'>"
    assert one(language.declared_languages(C("h")), h=page) == ["en-us", "de"]
    assert one(language.looks_english(F.lit("zzz"), C("h")), h="<html lang=x-default>") is True
    assert one(language.looks_english(F.lit("zzz"), C("h")), h="<html hreflang=en>") is False


def test_repair(spark, one):
    assert one(repair.fix_encoding(C("t")), t="cafÃ© â€œhiâ€\x9d &amp; ok") == 'café "hi" & ok'
    assert one(repair.fix_encoding(C("t")), t="a &lt;b&gt; <i>") == "a &lt;b&gt; <i>"
    assert one(repair.fix_encoding(C("t")), t="ﬁne\x00 text\r\nx") == "fine text\nx"
    assert one(repair.nfkc(C("t")), t="ＡＢＣ①") == "ABC1"
    assert one(repair.normalize_text(C("t")), t="  Ａ \t b \n\n\n\n c  ") == "A b\n\nc"


def test_lines_and_paragraphs(spark, one):
    got = one(text.drop_repeated_lines(C("t")), t="\n\nAb\n\n\n ab \nX\r\n\nAB\n\nY\n")
    assert (got["text"], got["removed"]) == ("Ab\n\nX\n\nY", 2)
    got = one(text.drop_duplicate_paragraphs(C("t")), t="One  two\nthree\n \n\nX\n\none TWO three\n\n")
    assert (got["text"], got["removed"]) == ("One  two\nthree\n\nX", 1)
    assert one(text.strip_boilerplate_lines(C("t")), t="A\nBook a demo\nAll Rights Reserved.\nTerms of service x") == "A\n\nTerms of service x"
    assert one(text.first_heading(C("t")), t="\n  \n Title \nx") == "Title"
    assert one(text.fingerprint(C("t")), t="Hello,  WORLD_1!") == one(text.fingerprint(C("t")), t="hello world_1")


def test_text_functions(spark, one):
    assert one(text.normalize_terms(C("t")), t="fooBar HTTPServer a_b-c/d") == "foo bar http server a b c d"
    assert one(text.keywords(C("t")), t="The quick brown quick fox is it") == ["quick", "brown", "fox"]
    assert one(text.ngrams(C("t"), 2), t="one two three one two") == ["one two", "two three", "three one"]
    assert one(text.ngrams(C("t"), 2), t="one") == []
    assert one(text.sentences(C("t")), t=" Hi there.  Ok?Yes! ") == ["Hi there.", "Ok?Yes!"]
    assert one(text.compact(C("t"), 10), t="abcdef ghijkl") == "abcdef..."
    assert one(text.compact(C("t"), 10), t="abcde  ghij") == "abcde ghij"
    assert one(text.humanize(C("t")), t="website_my-site  of_x") == "My-Site Of X"
    assert one(text.humanize(C("t")), t=" ") == fv.DEFAULT_LABEL
    assert one(text.title_ellipsis(C("t")), t="x" * 42) == "x" * 42
    assert one(text.title_ellipsis(C("t")), t="x" * 43) == "x" * 39 + "..."
    assert one(text.title_ellipsis(C("t")), t=None) == "New Chat"
    assert [one(text.estimate_tokens(C("t")), t=t) for t in ("", " ", "ab", "a" * 10, "a" * 14)] == [0, 0, 1, 2, 4]
    assert one(text.estimate_tokens_ceil(C("t")), t="a" * 9) == 3
    raw = ["- Be <b>brief</b>", "*  be  B BRIEF /b", "", "be  b  brief  /b"] + ["x"] * 20
    got = one(text.normalize_constraints(C("t")), t=(raw, "array<string>"))
    assert got == ["Be b brief /b", "x"]


def test_policy(spark, one):
    clean = one(policy.full_violations(policy.combined_prompt(C("r"), C("c"))), r="Helper", c="Be kind")
    assert clean == []
    for group, phrases in fv.POLICY_GROUPS.items():
        for phrase in phrases[:1]:
            got = one(policy.full_violations(policy.combined_prompt(C("r"), C("c"))), r="x", c=phrase.upper())
            assert group in [v["category"] for v in got]
    spam = {"a" * 7: True, "a" * 6 + "b": False, " 12": True, "go go go go gone": True, "go go go go": False, "été té té té té": False}
    for sample, expected in spam.items():
        assert one(policy.is_spam(C("t")), t=sample) is expected, sample
    for n, expected in ((3000, []), (3001, [fv.BASIC_LENGTH_MESSAGE])):
        assert one(policy.basic_violations(C("t")), t="ab " * 999 + "abc" + "d" * (n - 3000)) == expected


def test_spam_agrees_with_a_plain_regex(spark):
    import random
    import re

    rng = random.Random(5)
    samples = ["".join(rng.choice("ab \n1é") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rules = [
        re.compile(r"(.)\1{6,}"),
        re.compile(r"^(?:[^A-Za-z_]){0,5}\Z"),
        re.compile(r"(\b\w+\b)(\s+\1){4,}", re.ASCII),
    ]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", policy.is_spam(C("t")).alias("s")).collect()}
    assert got == {i: any(r.search(s) for r in rules) for i, s in enumerate(samples)}


def test_scores(spark, one):
    assert [one(scores.confidence_label(F.lit(x))) for x in (0.65, 0.6499, 0.40, 0.3999)] == ["high", "med", "med", "low"]
    assert [one(scores.final_top_k(F.lit(k))) for k in (-3, 0, 1, 5, 9)] == [1, 1, 1, 5, 5]
    assert one(scores.semantic_score(F.lit(None).cast("double"))) == 0.5
    assert one(scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(scores.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(None)))) == 1.0
    assert scores.minimum_semantic_score() == pytest.approx(0.425)


def test_sections_and_merge(spark, one):
    big = "This paragraph is long enough to be a body of text, with well over ten words in it for sure."
    ps = [big, "Heading one", "Heading two", big, "- bullet that is short", "Tail"]
    got = one(chunk.sections(C("p"), F.lit("Start")), p=(ps, "array<string>"))
    assert [(s["heading"], s["content"].split("\n\n")[0]) for s in got] == [
        ("Start", big), ("Heading one", "Heading one"), ("Heading two", "Heading two"), ("Tail", "Tail")
    ]
    merged = one(chunk.merge_small(chunk.sections(C("p"), F.lit("Start"))), p=(ps, "array<string>"))
    assert [s["heading"] for s in merged] == ["Start", "Heading one", "Tail"]
    assert merged[1]["content"].startswith("Heading one\n\nHeading two\n\n" + big)
    ten, eleven = " ".join(["w"] * 10), " ".join(["w"] * 11)
    assert one(chunk.is_heading(C("p")), p=ten) and not one(chunk.is_heading(C("p")), p=eleven)
    assert one(chunk.sections(C("p"), F.lit("")), p=([], "array<string>")) == []


def test_facts(spark, one):
    ps = ["Jane Doe", "Lead Engineer", "Likes tea.", "John Smith", "No title here", "- " + "x" * 23, "- " + "x" * 22, "Ann Lee", "CEO"]
    got = one(chunk.facts(C("p")), p=(ps, "array<string>"))
    assert [f["content"] for f in got] == ["Jane Doe\n\nLead Engineer\n\nLikes tea.", "- " + "x" * 23, "Ann Lee\n\nCEO"]
    assert not one(chunk.is_role(C("p")), p="CEO " + "x" * 87)
    assert not one(chunk.is_person_name(C("p")), p="Jane\nDoe") and not one(chunk.is_person_name(C("p")), p="Jane doe")


def test_context_header(spark, one):
    made = chunk.with_context(F.lit(""), F.lit("u"), F.lit("h"), F.lit(" body "))
    assert one(made) == "Page title:\nSource URL: u\nSection: h\nbody"
    assert one(text.content_body(made)) == "body"


def test_token_windows(spark):
    df = spark.createDataFrame([(1, "a" * 4100)], "i int, t string")
    rows = tokens.explode_windows(df, tokens.char_tokens(C("t")), 500, 100).orderBy("start").collect()
    assert [r["start"] for r in rows] == [0, 400, 800] and rows[-1]["tokens"] == 225
    every = tokens.explode_windows(df, tokens.char_tokens(C("t")), 5, 9)
    assert every.count() == 1025


def test_quota_and_change_set(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, v string, updated_at int")
    changes = spark.createDataFrame(
        [(1, "update", "x", 1), (1, "update", None, 2), (2, "delete", None, 1), (3, "upsert", "n", 1), (4, "update", "z", 1)],
        "id int, op string, v string, changed_at int",
    )
    merged = {r["id"]: (r["v"], r["outcome"]) for r in tenants.merge_changes(base, changes, "id", ["v"], ["changed_at"]).collect()}
    assert merged == {1: ("a", "updated"), 2: ("b", "deleted"), 3: ("n", "inserted"), 4: ("z", "missing key")}
