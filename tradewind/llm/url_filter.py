"""URL filters: pattern rules in a table, indexed by their rarest literal token, in DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fenced, lower_ascii, materialize, unfenced

#: (host, path prefix, verdict)
HOST_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: (regular expression over the lower-cased URL, literal tokens that every match holds as whole tokens, verdict)
PATTERN_RULES = (
    (r"^[a-z]+://([^/?#]*\.)?doubleclick\.", ("doubleclick",), "block"),
    (r"/wp-(admin|login)(/|\.|$)", ("wp",), "block"),
    (r"[?&]sessionid=", ("sessionid",), "block"),
    (r"/cgi-bin/", ("cgi", "bin"), "block"),
)


#: A host rule's weight is this and its length, so that it wins over any pattern.
HOST_WEIGHT = 1_000_000
RULE = "rule string, pattern string, verdict string, tokens array<string>, weight int"


def host_rule(host: str, path: str, verdict: str) -> tuple:
    """A rule for a host, all its subdomains and a path prefix. A token that the prefix may cut short isn't an index token."""
    pattern = rf"^[^:]*?://([^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    whole = path[: path.rfind("/") + 1]
    tokens = [x for x in re.split(r"[^a-z0-9]+", host.lower()) + re.split(r"[^a-z0-9]+", whole.lower()) if x]
    return host + path, pattern, verdict, tokens, HOST_WEIGHT + len(host + path)


def pattern_rule(pattern: str, tokens: Sequence[str], verdict: str) -> tuple:
    return pattern, pattern, verdict, list(tokens), len(pattern)


def rules_table(spark: SparkSession, host_rules: Sequence[tuple] = HOST_RULES, pattern_rules: Sequence[tuple] = PATTERN_RULES) -> DataFrame:
    """Lists of rules as a table (RULE). A table of very many rules is better read from a file of these columns."""
    rules = [host_rule(*x) for x in host_rules] + [pattern_rule(*x) for x in pattern_rules]
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(p).alias("pattern"), F.lit(v).alias("verdict"), texts(t).alias("tokens"), F.lit(w).cast("int").alias("weight")) for n, p, v, t, w in rules]
    kind = "array<struct<" + ",".join(":".join(x.split()) for x in RULE.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, ASCII lower case) and path; both empty for null or a URL without ://."""
    at = F.locate("://", url)
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, url: str = "url", host_rules: Sequence[tuple] = HOST_RULES, pattern_rules: Sequence[tuple] = PATTERN_RULES, default: str = "allow", rules: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, pattern and verdict to every row.

    Rules are a table (columns RULE) of any number, or the two lists. Each rule is filed under the rarest of its literal tokens, by
    their counts over these URLs; a rule without one is filed under the empty token, which every URL has. The tokens of a URL
    fetch its candidate rules by a join with that index (which Spark broadcasts or not, by its size), and only those run their
    regular expressions: neither plan nor work of a URL grows with the number of rules. A host rule wins over any pattern rule,
    a longer rule over a shorter one, the alphabetically last on ties; ``rule`` is the host rule's name, else null; ``verdict`` is
    the winner's, else default.

    Null and empty URLs have empty host and path and get the default (unless a rule without tokens fits the empty string).
    Rules without a pattern fit nothing. Repeated rows are judged each; an empty table gives an empty result. Columns named like
    a result are replaced, all others carried along, whatever their names.
    """
    names = ("host", "path", "rule", "pattern", "verdict")
    seen, inner, outer = fenced(pages, {url: "url"}, names)
    host, path = url_parts(F.col("url"))
    seen = seen.withColumns({"host": host, "path": path})
    # The canonical form that rules see: lower-cased scheme and host, the rest as it is.
    tail = F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3 + length(host))"))
    seen = seen.withColumn("u", F.coalesce(F.concat(F.lit("u://"), F.col("host"), tail), F.col("url"), F.lit("")))
    own = rules_table(pages.sparkSession, host_rules, pattern_rules) if rules is None else rules.select(*[x.split()[0] for x in RULE.split(", ")])
    own = materialize(own.filter("pattern is not null"))

    tokens = F.array_distinct(F.concat(F.split(F.lower("u"), r"[^a-z0-9]+"), F.array(F.lit(""))))
    words = seen.select("u", F.explode(tokens).alias("token"))
    literal = own.select("*", F.explode_outer("tokens").alias("token"))
    asked = literal.filter("token is not null").select("token").distinct()
    counts = words.join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("token", F.lit("")).alias("token")))["token"]
    filed = literal.join(counts, "token", "left").groupBy("rule", "pattern", "verdict", "weight").agg(rarest.alias("token"))
    filed = materialize(filed)
    fetched = words.join(filed, "token").filter(F.expr("regexp_like(u, pattern)"))
    best = fetched.groupBy("u").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best"))
    judged = seen.join(best.withColumnRenamed("u", "of"), F.col("u") == F.col("of"), "left")
    host_won = F.col("best.weight") >= HOST_WEIGHT
    added = [F.when(host_won, F.col("best.rule")).alias("rule"), F.when(~host_won, F.col("best.rule")).alias("pattern")]
    return unfenced(judged, inner, outer, ["host", "path", *added, F.coalesce("best.verdict", F.lit(default)).alias("verdict")])
