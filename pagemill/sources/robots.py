"""robots.txt texts as rows of rules, by a state machine over lines that windows run.

A file's lines fall into blocks at empty lines.  In a block, agent lines that follow one another open a group and the
rule lines after them belong to it; the next agent line opens the next group.  Rule lines before any agent line, and
groups without a rule line, count for nothing.  The first group that names the agent applies, else the first one for
``*``.  Every line is a row, so a file may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions.text import strip, text_or_empty

_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def body_lines(robots: DataFrame) -> DataFrame:
    """``robots(host, body)`` to ``host, line, text``."""
    return robots.select("host", F.posexplode(F.split(text_or_empty(F.col("body")), _BREAKS)).alias("line", "text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stored robots files to ``host`` (the file), ``line`` and ``text``; Spark splits large files over tasks."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("host"), place.alias("line"), F.col("value").alias("text"))


def _unquoted(c: Column) -> Column:
    """Percent signs decoded; one that starts no escape stands for itself."""
    safe = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(F.contains(c, F.lit("%")), F.try_url_decode(safe)).otherwise(c)


def _rule_path(c: Column) -> Column:
    """A decoded path as rules compare it: without an empty fragment, query, parameter or host, and percent-encoded."""
    bare = F.regexp_replace(c, "^([^#]*)#$", "$1")
    bare = F.regexp_replace(bare, r"^([^?#]*)\?(#.*)?$", "$1$2")
    bare = F.regexp_replace(bare, "^((?:[^?#]*/)?[^?#;/]*);([?#].*)?$", "$1$2")
    quoted = F.url_encode(F.regexp_replace(bare, "^//(?=$|[?#]|/(?!/))", ""))
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(coded), F.lit(plain))
    return quoted


def rules_of(lines: DataFrame, agent: str = fv.ROBOTS_AGENT) -> DataFrame:
    """``host, line, text`` to ``host, pos, path, allow``: the agent's rules in file order."""
    bare = strip(F.regexp_replace("text", "(?s)#.*$", ""))
    colon = F.instr(bare, ":")
    name = F.when(colon > 0, F.lower(strip(F.substring(bare, F.lit(1), colon - 1))))
    value = _unquoted(strip(F.substring(bare, colon + 1, F.length(bare))))
    kind = (
        F.when(F.col("text") == "", "blank")
        .when(name == "user-agent", "agent")
        .when(name.isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    events = lines.select("host", "line", kind.alias("kind"), name.alias("name"), value.alias("value")).filter("kind is not null")
    in_file, in_block = Window.partitionBy("host").orderBy("line"), Window.partitionBy("host", "block").orderBy("line")
    blocks = events.withColumn("block", F.count_if(F.col("kind") == "blank").over(in_file)).filter("kind <> 'blank'")
    opens = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(in_block), F.lit("rule")) == "rule")
    grouped = blocks.withColumn("opens", opens).withColumn("entry", F.count_if("opens").over(in_block)).filter("entry > 0")

    asked, named = F.lit(agent.split("/")[0].lower()), F.lower("value")
    is_agent = F.col("kind") == "agent"
    entries = grouped.groupBy("host", "block", "entry").agg(
        F.bool_or(~is_agent).alias("ruled"),
        F.bool_or(is_agent & (F.col("value") == "*")).alias("everyone"),
        F.bool_or(is_agent & F.contains(asked, named)).alias("meant"),
    )
    fitting = entries.filter("ruled and (everyone or meant)")
    chosen = fitting.groupBy("host").agg(F.min(F.struct("everyone", "block", "entry")).alias("c")).select("host", "c.block", "c.entry")
    rules = grouped.filter(F.col("name").isin("allow", "disallow")).join(chosen, ["host", "block", "entry"])
    allow = (F.col("name") == "allow") | (F.col("value") == "")
    return rules.select("host", (F.row_number().over(in_file) - 1).alias("pos"), _rule_path(F.col("value")).alias("path"), allow.alias("allow"))


def sitemaps_of(lines: DataFrame) -> DataFrame:
    """``host, line, text`` to ``host, pos, sitemap``: what sitemap lines name, in file order."""
    named = lines.filter(F.lower("text").startswith("sitemap:"))
    found = named.select("host", "line", strip(F.substring("text", len("sitemap:") + 1, 1 << 30)).alias("sitemap")).filter("sitemap <> ''")
    place = F.row_number().over(Window.partitionBy("host").orderBy("line")) - 1
    return found.select("host", place.alias("pos"), "sitemap")


def robots_rules(robots: DataFrame, agent: str = fv.ROBOTS_AGENT) -> DataFrame:
    """``robots(host, body)`` to one row per host: the agent's rules and the named sitemaps as arrays."""
    lines = body_lines(robots)
    rules = rules_of(lines, agent).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "allow"))).alias("r"))
    maps = sitemaps_of(lines).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "sitemap"))).alias("s"))
    joined = robots.select("host").join(rules, "host", "left").join(maps, "host", "left")
    ruled = F.transform("r", lambda x: F.struct(x["path"].alias("path"), x["allow"].alias("allow")))
    none = F.array().cast("array<struct<path:string,allow:boolean>>")
    return joined.select("host", F.coalesce(ruled, none).alias("rules"), F.coalesce(F.col("s.sitemap"), F.array().cast("array<string>")).alias("sitemaps"))
