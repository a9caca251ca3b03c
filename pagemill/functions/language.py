"""English gate: declared language first, then script, ASCII share and stopwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions.text import let, strip, text_or_empty

_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = r"(?is)[\s\"'/]" + name + _VALUE
    found = [F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]
    return F.lower(strip(F.concat(*found)))


def declared_languages(html: Column) -> Column:
    """``lang`` of the html tag, then content of the language meta tags; lowercase."""
    live = F.regexp_replace(text_or_empty(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")

    def read(page: Column) -> Column:
        root = _attribute(F.regexp_extract(page, r"(?is)<html\b[^>]*>", 0), "lang")
        metas = F.regexp_extract_all(page, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))

        def meta_value(tag: Column) -> Column:
            name = _attribute(tag, "name")
            name = F.when(name == "", _attribute(tag, "http-equiv")).otherwise(name)
            return F.when(
                name.isin("language", "content-language"), _attribute(tag, "content")
            ).otherwise(F.lit(""))

        values = F.concat(F.array(root), F.transform(metas, meta_value))
        return F.filter(values, lambda v: v != "")

    return let(live, read)


def declares_english(html: Column) -> Column:
    return F.exists(
        declared_languages(html), lambda v: v.startswith("en") | (v == "x-default")
    )


def reads_english(text: Column) -> Column:
    """The gate on the text alone."""
    def judge(t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
        ascii_letters = F.length(F.regexp_replace(t, "[^A-Za-z]+", ""))
        words = F.regexp_extract_all(F.lower(t), F.lit("(" + fv.ENGLISH_WORD + ")"), F.lit(1))

        def by_words(ws: Column) -> Column:
            hits = F.size(F.filter(ws, lambda w: w.isin(fv.ENGLISH_STOPWORDS)))
            n = F.size(ws)
            return (
                F.when(n == 0, F.lit(False))
                .when(n < fv.SHORT_TEXT_WORDS, hits >= 1)
                .otherwise((hits / n >= fv.MIN_STOPWORD_SHARE) | (hits >= 3))
            )

        return (
            F.when(t == "", F.lit(False))
            .when(t.rlike(fv.NON_LATIN_CLASS), F.lit(False))
            .when(letters == 0, F.lit(False))
            .when(ascii_letters / letters < fv.MIN_ASCII_SHARE, F.lit(False))
            .otherwise(let(words, by_words))
        )

    return let(strip(text_or_empty(text)), judge)


def looks_english(text: Column, html: Column | None = None) -> Column:
    if html is None:
        return reads_english(text)
    return F.when(declares_english(html), F.lit(True)).otherwise(reads_english(text))


def detect_language(text: Column, html: Column | None = None) -> Column:
    return F.when(looks_english(text, html), F.lit("en")).otherwise(F.lit("other"))
