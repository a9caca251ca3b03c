"""Text functions, normalizers, language gate and policy flags over the whole text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions import language, policy, repair, split, text, tokens
from pagemill.plans import query, sql



def _texts(t):
    return t.documents.select("doc_id", "text")


# --- scalar text functions ----------------------------------------------------

@query("txt_normalize_terms", f"SELECT doc_id, {sql.norm_terms('text')} AS terms FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.normalize_terms(F.col("text")).alias("terms"))


_CHUNKED = (
    "'Page title: ' || source || chr(10) || 'Source URL: ' || doc_id || chr(10) || "
    "'Section: ' || lang || chr(10) || text"
)


def chunked_text():
    return F.concat(
        F.lit("Page title: "), F.col("source"), F.lit("\nSource URL: "), F.col("doc_id"),
        F.lit("\nSection: "), F.col("lang"), F.lit("\n"), F.col("text"),
    )


@query("txt_content_body", f"SELECT doc_id, {sql.body(_CHUNKED)} AS body FROM documents")
def _(t):
    return t.documents.select("doc_id", text.content_body(chunked_text()).alias("body"))


@query(
    "txt_sentences",
    f"""SELECT doc_id, pos, sentence FROM (
      SELECT doc_id, unnest(parts) AS sentence, unnest(range(1, len(parts) + 1)) AS pos FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({sql.collapse('text')},
          '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts
        FROM documents))""",
)
def _(t):
    parts = _texts(t).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("p", "sentence"))
    return parts.select("doc_id", (F.col("p") + 1).alias("pos"), "sentence")


@query("txt_compact", f"SELECT doc_id, {sql.compact('text', 160)} AS short FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.compact(F.col("text"), 160).alias("short"))


@query(
    "txt_keywords",
    f"""SELECT doc_id, array_to_string(list_sort({sql.keywords('text')}), ' ') AS keywords
    FROM documents""",
)
def _(t):
    return _texts(t).select(
        "doc_id", F.array_join(F.sort_array(text.keywords(F.col("text"))), " ").alias("keywords")
    )


@query(
    "txt_ngrams",
    f"""WITH ts AS (SELECT doc_id, {sql.terms('text')} AS t FROM documents)
    SELECT doc_id, len(grams) AS n, sha256(array_to_string(list_sort(grams), '|')) AS digest FROM (
      SELECT doc_id, CASE WHEN len(t) < 2 THEN [] ELSE list_distinct(list_transform(
        range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS grams FROM ts)""",
)
def _(t):
    grams = _texts(t).select("doc_id", text.ngrams(F.col("text"), 2).alias("g"))
    return grams.select(
        "doc_id",
        F.size("g").alias("n"),
        text.sha256(F.array_join(F.sort_array("g"), "|")).alias("digest"),
    )


@query(
    "txt_overlap",
    f"""WITH k AS (
      SELECT conv_id, turn, {sql.keywords('text')} AS w FROM conversations),
    p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM k)
    SELECT conv_id, turn, round(CASE WHEN len(w) = 0 THEN 0.0
      ELSE len(list_intersect(w, prev)) / CAST(len(w) AS DOUBLE) END, 6) AS score
    FROM p WHERE prev IS NOT NULL""",
)
def _(t):
    words = t.conversations.select("conv_id", "turn", text.keywords(F.col("text")).alias("w"))
    before = words.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("prev"))
    both = words.join(before, ["conv_id", "turn"])
    return both.select(
        "conv_id", "turn", F.round(text.overlap(F.col("w"), F.col("prev")), 6).alias("score")
    )


@query(
    "txt_near_dup_key",
    f"""SELECT sha256(key) AS key_hash, count(*) AS copies, min(doc_id) AS first_doc FROM (
      SELECT doc_id, array_to_string(list_slice({sql.terms('text')}, 1, 80), ' ') AS key
      FROM documents) GROUP BY key""",
)
def _(t):
    keyed = _texts(t).select("doc_id", text.sha256(text.near_duplicate_key(F.col("text"))).alias("key_hash"))
    return keyed.groupBy("key_hash").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")
    )


@query("tok_estimate", f"SELECT doc_id, {sql.tok_estimate('text')} AS tokens FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "tok_estimate_ceil",
    "SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations",
)
def _(t):
    return t.conversations.select(
        "conv_id", "turn", text.estimate_tokens_ceil(F.col("text")).alias("tokens")
    )


_T = sql.collapse("text")


@query(
    "txt_title_ellipsis",
    f"""SELECT conv_id, turn, CASE WHEN {_T} = '' THEN 'New Chat' WHEN length({_T}) <= 42 THEN {_T}
      ELSE trim(left({_T}, 39)) || '...' END AS title FROM conversations""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", text.title_ellipsis(F.col("text")).alias("title"))


@query(
    "txt_humanize",
    """SELECT p_partkey, array_to_string(list_transform(string_split(trim(p_name), ' '),
      lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label FROM part""",
)
def _(t):
    slug = F.concat(F.lit("website_"), F.translate("p_name", " ", "_"))
    return t.part.select("p_partkey", text.humanize(slug).alias("label"))


@query("txt_sanitize", f"SELECT doc_id, {sql.sanitize('text', 240)} AS safe FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.sanitize(F.col("text"), 240).alias("safe"))


_LINES = "list_slice(string_split(text, chr(10)), 1, 12)"


@query(
    "txt_constraint_normalize",
    rf"""WITH c AS (SELECT doc_id, list_filter(list_transform({_LINES}, lambda l:
        trim(regexp_replace({sql.sanitize('l', 240)}, '^\s*[-*]+\s*', ''))), lambda x: x <> '') AS xs
      FROM documents)
    SELECT doc_id, array_to_string(list_filter(xs, lambda x, i:
      list_position(list_transform(xs, lambda y: lower(y)), lower(x)) = i), '|') AS constraints FROM c""",
)
def _(t):
    items = F.split(F.col("text"), "\n")
    return _texts(t).select(
        "doc_id", F.array_join(text.normalize_constraints(items), "|").alias("constraints")
    )


# --- normalizers ---------------------------------------------------------------

@query(
    "text_collapse_ws", f"SELECT doc_id, {sql.collapse('text')} AS flat FROM documents"
)
def _(t):
    return _texts(t).select("doc_id", text.collapse_ws(F.col("text")).alias("flat"))


def _garbled():
    """The text as a reader that takes UTF-8 for Latin-1 would see it."""
    return F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")


@query(
    "text_fix_encoding",
    "SELECT doc_id, text AS fixed, regexp_matches(text, '[^\\x00-\\x7f]') AS changed FROM documents",
)
def _(t):
    fixed = _texts(t).select("doc_id", _garbled().alias("raw"))
    fixed = fixed.withColumn("fixed", repair.fix_encoding(F.col("raw")))
    return fixed.select("doc_id", "fixed", (F.col("fixed") != F.col("raw")).alias("changed"))


@query("text_nfkc", "SELECT doc_id, nfc_normalize(text) AS normal FROM documents")
def _(t):
    return _texts(t).select("doc_id", repair.nfkc(F.col("text")).alias("normal"))


def _line_breaks(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+\\n', chr(10), 'g')"
    return sql.strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _whitespace(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t\\f\\v]+', ' ', 'g')"
    return _line_breaks(f"regexp_replace({x}, ' *\\n *', chr(10), 'g')")


@query("text_line_breaks", f"SELECT doc_id, {_line_breaks('text')} AS clean FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.normalize_line_breaks(F.col("text")).alias("clean"))


@query("text_whitespace", f"SELECT doc_id, {_whitespace('text')} AS clean FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.normalize_whitespace(F.col("text")).alias("clean"))


@query(
    "text_normalize",
    f"""SELECT doc_id, {_whitespace('nfc_normalize(text)')} AS clean, {_whitespace('nfc_normalize(text)')} <> text
      OR regexp_matches(text, '[^\\x00-\\x7f]') AS changed FROM documents""",
)
def _(t):
    normal = _texts(t).select("doc_id", _garbled().alias("raw"))
    normal = normal.withColumn("clean", repair.normalize_text(F.col("raw")))
    return normal.select("doc_id", "clean", (F.col("clean") != F.col("raw")).alias("changed"))


_LINE_LIST = f"list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\v\\f]'), lambda l: {sql.strip('l')})"


@query(
    "doc_drop_repeated_lines",
    f"""WITH l AS (SELECT doc_id, {_LINE_LIST} AS xs FROM documents),
    u AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS pos FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS rn FROM u)
    SELECT doc_id, {sql.strip("regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (x = '' OR rn = 1), ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS clean,
      CAST(count(*) FILTER (x <> '' AND rn > 1) AS INT) AS removed FROM r GROUP BY doc_id""",
)
def _(t):
    done = _texts(t).select("doc_id", text.drop_repeated_lines(F.col("text")).alias("r"))
    return done.select("doc_id", F.col("r.text").alias("clean"), F.col("r.removed").alias("removed"))


# lines stand in for paragraphs: the given texts hold no blank lines
_PARAS = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql.strip('l')}), lambda p: p <> '')"


@query(
    "doc_drop_dup_paragraphs",
    f"""WITH l AS (SELECT doc_id, {_PARAS} AS xs FROM documents),
    u AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS pos FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower({sql.collapse('x')}) ORDER BY pos) AS rn FROM u)
    SELECT d.doc_id, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY pos) FILTER (rn = 1), '') AS clean,
      CAST(count(*) FILTER (rn > 1) AS INT) AS removed
    FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
)
def _(t):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    done = _texts(t).select("doc_id", text.drop_duplicate_paragraphs(spaced).alias("r"))
    return done.select("doc_id", F.col("r.text").alias("clean"), F.col("r.removed").alias("removed"))


@query(
    "doc_strip_boilerplate_lines",
    f"""WITH l AS (SELECT doc_id, string_split(text || chr(10) || source || chr(10) || 'Privacy Policy', chr(10)) AS xs FROM documents)
    SELECT doc_id, {sql.strip(
        "regexp_replace(array_to_string(list_transform(xs, lambda x: CASE WHEN regexp_matches(x, '^(?i:"
        + "|".join(fv.BOILERPLATE_LINES)
        + ")$') THEN '' ELSE x END), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')"
    )} AS clean FROM l""",
)
def _(t):
    tailed = F.concat(F.col("text"), F.lit("\n"), F.col("source"), F.lit("\nPrivacy Policy"))
    return t.documents.select("doc_id", text.strip_boilerplate_lines(tailed).alias("clean"))


@query("doc_fingerprint", f"SELECT doc_id, {sql.fingerprint('text')} AS fp FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query(
    "chunk_fingerprint",
    f"SELECT conv_id, turn, {sql.fingerprint('text')} AS fp FROM conversations",
)
def _(t):
    return t.conversations.select("conv_id", "turn", text.fingerprint(F.col("text")).alias("fp"))


_HEAD = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql.strip('l')}), lambda l: l <> '')"


@query("meta_first_heading", f"SELECT doc_id, coalesce(left({_HEAD}[1], 240), '') AS heading FROM documents")
def _(t):
    return _texts(t).select("doc_id", text.first_heading(F.col("text")).alias("heading"))


@query(
    "meta_content_hash",
    f"SELECT doc_id, sha256(coalesce(array_to_string({_HEAD}, chr(10)), '')) AS hash FROM documents",
)
def _(t):
    return _texts(t).select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query(
    "chunk_token_window",
    """WITH p AS (SELECT doc_id, list_transform(range(1, length(text) + 1, 4), lambda i: substr(text, i, 4)) AS ts FROM documents),
    w AS (SELECT doc_id, ts, unnest(range(0, len(ts), 400)) AS start FROM p)
    SELECT doc_id, start, CAST(least(500, len(ts) - start) AS INT) AS tokens,
      array_to_string(ts[start + 1 : start + 500], '') AS piece FROM w""",
)
def _(t):
    pieces = tokens.char_tokens(F.col("text"))
    return tokens.explode_windows(_texts(t), pieces, 500, 100).select(
        "doc_id", "start", "tokens", "piece"
    )


# --- language gate ----------------------------------------------------------------

@query(
    "lang_looks_english",
    f"""WITH s AS (SELECT doc_id, {sql.strip('text')} AS x FROM documents)
    SELECT doc_id, {sql.reads_english('x')} AS english FROM s""",
)
def _(t):
    return _texts(t).select("doc_id", language.looks_english(F.col("text")).alias("english"))


@query(
    "lang_detect",
    f"""WITH s AS (SELECT lang, {sql.strip('text')} AS x FROM documents),
    d AS (SELECT lang, CASE WHEN {sql.reads_english('x')} THEN 'en' ELSE 'other' END AS detected FROM s)
    SELECT lang, detected, count(*) AS n FROM d GROUP BY ALL""",
)
def _(t):
    detected = t.documents.select("lang", language.detect_language(F.col("text")).alias("detected"))
    return detected.groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query(
    "lang_declared",
    r"""SELECT page_id, lower(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1)) AS declared
    FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        F.array_join(language.declared_languages(F.col("html")), ",").alias("declared"),
    )


# --- policy -----------------------------------------------------------------------

def _sql_hits(phrases: list[str], message: str, x: str = "x") -> str:
    before, after = message.split("%s")
    return (
        f"list_transform(list_filter({sql.strings(phrases)}, lambda p: contains({x}, p)), "
        f"lambda p: {sql.lit(before)} || p || {sql.lit(after)})"
    )


# every turn is screened as a prompt; a phrase per role makes each list fire on the given data
_PROMPT = "lower(role || ' ' || CASE role WHEN 'user' THEN 'You are now ' WHEN 'system' THEN 'help with illegal ' ELSE '' END || text)"


def prompts(t):
    lead = (
        F.when(F.col("role") == "user", "You are now ")
        .when(F.col("role") == "system", "help with illegal ")
        .otherwise("")
    )
    return t.conversations.select(
        "conv_id", "turn", policy.combined_prompt(F.col("role"), F.concat(lead, F.col("text"))).alias("prompt")
    )


@query(
    "policy_basic",
    f"""WITH p AS (SELECT conv_id, turn, {_PROMPT} AS x FROM conversations),
    v AS (SELECT conv_id, turn, list_concat(list_concat({_sql_hits(fv.BASIC_FORBIDDEN, fv.BASIC_FORBIDDEN_MESSAGE)},
      {_sql_hits(fv.BASIC_RISKY_ROLES, fv.BASIC_RISKY_MESSAGE)}),
      CASE WHEN length({sql.strip('x')}) > 3000 THEN [{sql.lit(fv.BASIC_LENGTH_MESSAGE)}] ELSE [] END) AS v FROM p)
    SELECT conv_id, turn, len(v) = 0 AS passed, coalesce(array_to_string(v, ';'), '') AS violations FROM v""",
)
def _(t):
    found = prompts(t).select(
        "conv_id", "turn", policy.basic_violations(F.col("prompt")).alias("v")
    )
    return found.select(
        "conv_id", "turn", (F.size("v") == 0).alias("passed"), F.array_join("v", ";").alias("violations")
    )


_TOKS = "regexp_extract_all(x, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')"
_BLANK = r"'[\s\v]+'"
_SPAM = f"""(len(list_filter(list_distinct(string_split(x, '')), lambda c: c <> chr(10) AND c <> chr(13) AND contains(x, repeat(c, 7)))) > 0
  OR regexp_full_match(x, '[^A-Za-z_]{{0,5}}')
  OR len(list_filter(range(1, len(tk) - 7), lambda i: regexp_matches(tk[i], '^[A-Za-z0-9_]')
    AND tk[i + 2] = tk[i] AND tk[i + 4] = tk[i] AND tk[i + 6] = tk[i] AND starts_with(tk[i + 8], tk[i])
    AND regexp_full_match(tk[i + 1], {_BLANK}) AND regexp_full_match(tk[i + 3], {_BLANK})
    AND regexp_full_match(tk[i + 5], {_BLANK}) AND regexp_full_match(tk[i + 7], {_BLANK}))) > 0)"""


def _sql_group(group: str) -> str:
    message = fv.POLICY_MESSAGES[group]
    if group == "spam":
        return f"CASE WHEN {_SPAM} THEN [{sql.lit(message)}] ELSE [] END"
    if group == "length":
        return f"CASE WHEN length({sql.strip('x')}) > 3000 THEN [{sql.lit(message)}] ELSE [] END"
    return _sql_hits(fv.POLICY_GROUPS[group], message)


def _sql_all() -> str:
    out = "[]"
    for group in fv.POLICY_GROUPS:
        out = f"list_concat({out}, {_sql_group(group)})"
    return out


_PROMPTS = f"""WITH q AS (SELECT conv_id, turn, {_PROMPT} AS x FROM conversations),
    p AS (SELECT *, {_TOKS} AS tk FROM q)"""


@query(
    "policy_full",
    f"""{_PROMPTS}, v AS (SELECT conv_id, turn, {_sql_all()} AS v FROM p)
    SELECT conv_id, turn, len(v) = 0 AS passed, coalesce(array_to_string(v, ';'), '') AS violations FROM v""",
)
def _(t):
    found = prompts(t).select("conv_id", "turn", policy.full_violations(F.col("prompt")).alias("v"))
    return found.select(
        "conv_id",
        "turn",
        (F.size("v") == 0).alias("passed"),
        F.array_join(F.col("v.message"), ";").alias("violations"),
    )


@query(
    "policy_summary",
    f"{_PROMPTS}, h AS ("
    + " UNION ALL ".join(
        f"SELECT {sql.lit(g)} AS category, unnest({_sql_group(g)}) AS message FROM p"
        for g in fv.POLICY_GROUPS
    )
    + ") SELECT category, message, count(*) AS n FROM h GROUP BY ALL",
)
def _(t):
    found = prompts(t).select(F.explode(policy.full_violations(F.col("prompt"))).alias("v"))
    by_kind = found.groupBy(
        F.col("v.category").alias("category"), F.col("v.message").alias("message")
    )
    return by_kind.agg(F.count("*").alias("n"))


# --- token windows by a tokenizer that is loaded on the workers ----------------------------------

class _Words:
    """A stand-in for a tokenizer: runs of letters and digits, and each other character that is no space."""

    def encode(self, text):
        import re

        return re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9 \n]", text)

    def decode(self, ids):
        return " ".join(ids)


def _load_words():
    return lambda texts: [_Words().encode(x) for x in texts]


_PIECE = r"[A-Za-z0-9]+|[^A-Za-z0-9 \n]"


@query(
    "chunk_token_budget",
    f"""WITH n AS (SELECT doc_id, text, regexp_extract_all(text, '{_PIECE}') AS t FROM documents),
    w AS (SELECT doc_id, len(t) AS tokens, CASE WHEN len(t) <= 500 THEN [text]
      ELSE [array_to_string(t[i + 1:i + 500], ' ') FOR i IN range(0, len(t), 400)] END AS pieces FROM n)
    SELECT doc_id, tokens, len(pieces) AS windows, list_sum([length(p) FOR p IN pieces])::BIGINT AS chars,
      sha256(array_to_string(pieces, '|')) AS digest FROM w""",
)
def _(t):
    """Tokens of whole texts, and their windows of 500 tokens with an overlap of 100 as the tokenizer decodes them."""
    count = tokens.token_count(F.col("text"), tokens.bpe_counter(_load_words)).cast("long")
    counted = t.documents.select("doc_id", "text", count.alias("tokens"))
    cut = split.split_by_tokens(counted, "text", 500, 100, _Words)
    chars = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    digest = F.sha2(F.array_join("pieces", "|"), 256)
    return cut.select("doc_id", "tokens", F.size("pieces").cast("long").alias("windows"), chars.alias("chars"), digest.alias("digest"))
