"""URL filters: pattern rules found through their rarest literal token.

A rule is written as three patterns, of host, path and query, in which `*` stands for
anything. Its regular expression and the literal tokens that any matching URL must
contain as whole tokens are read off the patterns. The rule is posted under the one
token that is rarest among the tokens of the URLs at hand. A URL's tokens fetch
candidate rules by an equi-join, and only those candidates run their expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, stored, table

RULE_TYPE = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("priority", T.IntegerType()),
    ]
)

#: (verdict, host, path prefix): fixed values of the contract.
BASE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Host labels whose sites are never wanted; they only decide where no host rule fits.
BLOCKED_LABELS = ["adserver", "casino", "doubleclick", "porn", "tracker", "xxx"]

#: (verdict, host, path, query) patterns that only decide where no host rule fits: pages without a text of their own, and copies made for feeds.
PATTERN_RULES = [
    ("block", "*", "*/wp-admin/*", "*"), ("block", "*", "*/wp-login.php", "*"), ("block", "*", "*/cgi-bin/*", "*"), ("block", "*", "*/login", "*"), ("block", "*", "*/login/*", "*"),
    ("block", "*", "*/signup", "*"), ("block", "*", "*/cart", "*"), ("block", "*", "*/cart/*", "*"), ("block", "*", "*/checkout/*", "*"), ("block", "*", "*", "*add-to-cart=*"),
    ("block", "*", "*", "sessionid=*"), ("block", "*", "*", "*&sessionid=*"), ("block", "*", "*", "utm_source=feed"), ("block", "*", "*", "*&utm_source=feed"),
    ("block", "ads.*", "*", "*"), ("block", "*.ads.*", "*", "*"),
]

#: Text between tokens of a URL.
SPLIT = r"[^\p{L}\p{N}]+"


def host_rule(verdict: str, host: str, path: str) -> tuple:
    """A rule that fits a host, its subdomains, and paths with a prefix; longer rules come first."""
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}\n{re.escape(path)}"
    whole = path[: path.rfind("/") + 1]  # the last piece may be a part of a token only
    tokens = [t for t in re.split(r"[\W_]+", f"{host}/{whole}".lower()) if t]
    return (host + path, verdict, pattern, tokens, len(host + path))


def label_rule(label: str) -> tuple:
    """Blocks hosts that have the label; comes after every host rule."""
    return (f"label:{label}", "block", rf"^(?:[^/?#\n]*\.)?{re.escape(label)}[.\n]", [label], 0)


def pattern_rule(verdict: str, host: str, path: str, query: str, priority: int = 0) -> tuple:
    """A rule by patterns of the whole host, path and query (in any case), in which `*` is any text.

    Its literals are the tokens that no `*` touches."""
    parts = [p.lower() for p in (host, path, query)]
    pattern = "(?i)^" + r"\n".join("".join(r"[^\n]*" if c == "*" else re.escape(c) for c in p) for p in parts) + "$"
    tokens = []
    for p in parts:
        for m in re.finditer(r"[^\W_]+", p):
            if p[m.start() - 1 : m.start()] != "*" and p[m.end() : m.end() + 1] != "*":
                tokens.append(m[0])
    return (f"pattern:{host} {path} {query}", verdict, pattern, tokens, priority)


def all_rules() -> list[tuple]:
    return [host_rule(*r) for r in BASE_RULES] + [label_rule(x) for x in BLOCKED_LABELS] + [pattern_rule(*r) for r in PATTERN_RULES]


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://' or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' without '://' or for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """What follows the path's `?` up to `#` or the end, A-Z lower-cased; '' if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)), F.lit(""))


def rule_index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """rules with the column `token`: each rule's rarest literal.

    url_tokens has one row per URL token; only its occurrences of literals are
    counted, so what is gathered is bounded by the rules."""
    literals = rules.select("rule", F.explode("tokens").alias("token"))
    counts = url_tokens.join(F.broadcast(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        literals.join(F.broadcast(counts), "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
        .select("rule", F.col("best.token").alias("token"))
    )
    return rules.join(F.broadcast(rarest), "rule")


def filter_urls(pages: DataFrame, rules: list[tuple], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url; other columns are ignored).

    Of the rules that fit, the one with the highest priority wins, then the
    smallest name; without one the verdict is `default` and rule is null. A null
    or malformed url has empty host and path. Repeated rows stay repeated; an
    empty table gives an empty result. Rules are a given list, so they are
    broadcast; a rule needs at least one literal token.
    """
    spark = pages.sparkSession
    if any(not r[3] for r in rules):
        raise ValueError("a rule without a literal token cannot be indexed")
    rule_rows = spark.createDataFrame(rules, RULE_TYPE).coalesce(1)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"))
    place = ["host", "path", "query"]
    # a line break within a part is not one between parts
    part = lambda c: F.regexp_replace(c, "\n", " ")
    subject = F.concat(part("host"), F.lit("\n"), part("path"), F.lit("\n"), part("query"))
    subject = F.when(F.col("host") != "", subject).otherwise("")
    places = urls.select(*place).distinct()
    tokens = places.select(*place, F.explode(F.array_distinct(F.split(F.lower(subject), SPLIT))).alias("token"))
    index = rule_index(rule_rows, tokens).select("rule", "verdict", "pattern", "priority", "token")
    index = F.broadcast(stored(index.coalesce(1), "rules"))
    hits = (
        tokens.join(index, "token")
        .where(F.regexp_like(subject, F.col("pattern")))
        .groupBy(*place)
        .agg(F.min(F.struct((-F.col("priority")).alias("p"), "rule", "verdict")).alias("best"))
    )
    return urls.join(hits, place, "left").select(
        "page_id", "host", "path",
        F.when(F.col("best.p") < 0, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.rule").alias("matched_rule"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), all_rules()).select("page_id", "host", "path", "rule", "verdict")


def _like(pattern: str) -> str:
    """The pattern for LIKE; `\\` keeps what LIKE would read otherwise."""
    return re.sub(r"([%_\\])", r"\\\1", pattern.lower()).replace("*", "%")


#: The same verdicts without an index: every rule is tried on every URL, patterns by LIKE on each part.
ORACLE = rf"""
WITH u AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
      translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
      regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
      lower(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*\?([^#]*)', 1)) END AS query
  FROM pages),
r(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b(l) AS (VALUES {", ".join(f"('{x}')" for x in BLOCKED_LABELS)}),
g(h, p, q) AS (VALUES {", ".join(f"('{_like(h)}', '{_like(p)}', '{_like(q)}')" for _, h, p, q in PATTERN_RULES)})
SELECT page_id, host, path,
  (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, h || p LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, h || p LIMIT 1),
    CASE WHEN EXISTS (SELECT 1 FROM b WHERE contains('.' || host, '.' || l || '.')) THEN 'block'
      WHEN host <> '' AND EXISTS (SELECT 1 FROM g WHERE host LIKE h ESCAPE '\' AND lower(path) LIKE p ESCAPE '\' AND query LIKE q ESCAPE '\') THEN 'block' ELSE 'allow' END) AS verdict
FROM u
"""
