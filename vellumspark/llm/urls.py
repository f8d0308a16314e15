"""URL filters: rules are indexed by their rarest literal token, and only what a URL's tokens fetch is tried.

Rules are rows of a table: ``rule`` and ``action`` (``allow`` or ``block``), of two kinds.

* ``site``: a host and a path, such as ``example.com/en/``.  It fits its host and all subdomains,
  if the URL's path begins with the rule's (any path, without one).
* ``pattern``: a part of a URL, in any case.  ``*`` stands for any characters, ``^`` for one that is
  neither a letter, a digit nor one of ``_ - . %``, or for the end; ``|`` first or last means the URL's
  begin or end, ``||`` first the begin of its host or of a domain in it.

A token is a run of letters and digits that cannot go on in any URL which the rule fits, so such a
URL has it as a whole token.  Each rule is filed under that one of its tokens which the fewest
URLs have; rules without a token are tried on every URL.  The URLs' distinct tokens are exploded and
joined with that index, regular expressions run on the rows that come out, and the rows of a URL
are summed where they are made, so one row for each URL is shuffled.

Of the sites that fit, the longest decides, then that with the longer host.  Without one the
patterns do: ``allow`` before ``block``, then the longest, then the last in order.  Without any the URL is allowed.

The index is broadcast while its text stays below ``INDEX_BYTES``, else joined by shuffling.

Defined results: a null URL, or one without ``://``, has an empty host and path and is tried on
patterns only; repeated rows give repeated results; a rule that stands twice counts once, ``allow``
before ``block``; null and empty rules fit nothing; a URL of any length is read whole; columns
besides id and URL, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rules up to which the index is broadcast.
INDEX_BYTES = 4 << 20

# The rules of the query.
SITES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
PATTERNS = [
    ("block", "||spam-farm."), ("block", "||cheap-pills."), ("block", "-casino."), ("block", "/adserver/*/click^"), ("block", "?utm_source=feed|"),
    ("block", "||blog.*/print^"), ("allow", "||m.*.org/en/"), ("block", "^sessionid="),
]


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    part = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k)
    return F.coalesce(ascii_lower(part(1)), F.lit("")), F.coalesce(part(2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct runs of letters and digits of a URL."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(url), F.lit("[a-z0-9]++"), F.lit(0)))


def rule_tokens(rule: Column, kind: Column) -> Column:
    """Runs that end on both sides within the rule; a site's host begins one."""
    whole = F.concat(F.lit("|"), rule, F.when(rule.contains("/"), "").otherwise("|"))
    marked = F.when(kind == "site", whole).otherwise(rule)
    return F.array_distinct(F.regexp_extract_all(ascii_lower(marked), F.lit("(?<=[^a-z0-9*])[a-z0-9]++(?=[^a-z0-9*])"), F.lit(0)))


def rule_regex(rule: Column, kind: Column) -> Column:
    """The regular expression of a rule: for sites on host and path, for patterns on the URL."""
    literal = lambda s: F.regexp_replace(s, r"([^A-Za-z0-9_/\x80-\x{10FFFF}-])", r"\\$1")
    site = F.concat(F.lit(r"^(?:[^/]*\.)?"), literal(rule), F.when(rule.contains("/"), "").otherwise(r"(?=/|\z)"))
    body = literal(F.regexp_replace(F.regexp_replace(rule, r"^\|\|?", ""), r"\|$", ""))
    body = F.replace(F.replace(body, F.lit(r"\*"), F.lit(".*")), F.lit(r"\^"), F.lit(r"(?:[^A-Za-z0-9_.%-]|\z)"))
    head = F.when(rule.startswith("||"), r"^[^/?#]*://(?:[^/?#]*\.)?").when(rule.startswith("|"), "^").otherwise("")
    tail = F.when((F.length(rule) > 1) & rule.endswith("|"), r"\z").otherwise("")
    return F.when(kind == "site", site).otherwise(F.concat(F.lit("(?is)"), head, body, tail))


def _filed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with its regular expression and the token it is filed under (null: none)."""
    real = rules.where("coalesce(rule, '') <> '' and (kind = 'site' or rule rlike '[^|]')")
    once = real.groupBy("kind", "rule").agg(F.min("action").alias("action"))
    plain = once.select("*", rule_regex(F.col("rule"), F.col("kind")).alias("regex"), rule_tokens(F.col("rule"), F.col("kind")).alias("tokens"))
    each = plain.select("kind", "rule", F.explode("tokens").alias("token"))
    # urls count once for a token; only tokens of rules are counted
    used = tokens.join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rare = each.join(used, "token", "left").groupBy("kind", "rule").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), (-F.length("token")).alias("size"), "token"))["token"].alias("token"))
    return plain.drop("tokens").join(rare, ["kind", "rule"], "left")


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, pattern``: the site that decided, the verdict, and the pattern that decided."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", "url", host.alias("host"), path.alias("path"))
    index = materialize(_filed(rules, urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))), "url-rules")
    size = index.agg(F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("regex") + 32), F.lit(0))).head()[0]
    small = F.broadcast if size <= INDEX_BYTES else lambda d: d

    # "" fetches the rules that have no token; it is on every url
    fetched = F.concat(F.array(F.lit("")), F.coalesce(url_tokens(F.col("url")), F.array()))
    each = urls.select(F.monotonically_increasing_id().alias("row"), "*").select("row", "key", "url", "host", "path", F.explode(fetched).alias("token"))
    held = index.select(F.coalesce("token", F.lit("")).alias("token"), "kind", "rule", "action", "regex")
    tried = each.join(small(held), "token", "left")
    fits = F.when(F.col("kind") == "site", F.rlike(F.concat("host", "path"), F.col("regex"))).otherwise(F.rlike(F.coalesce("url", F.lit("")), F.col("regex")))
    host_size = F.when(F.col("kind") == "site", F.length(F.regexp_extract("rule", "^[^/]*", 0))).otherwise(0)
    order = F.struct(
        (F.col("kind") == "site").alias("site"),
        F.when(F.col("kind") == "site", 0).otherwise((F.col("action") == "allow").cast("int")).alias("allow"),
        F.length("rule").alias("size"), host_size.alias("host_size"), F.col("rule"), F.col("action"),
    )
    best = tried.groupBy("row").agg(*[F.first(c).alias(c) for c in ("key", "host", "path")], F.max(F.when(F.col("rule").isNotNull() & fits, order)).alias("best"))
    return best.select(
        F.col("key").alias(key), "host", "path",
        F.when(F.col("best.site"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.site"), F.col("best.rule")).alias("pattern"),
    )


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [("site", rule, action) for action, rule in SITES] + [("pattern", rule, action) for action, rule in PATTERNS]
    return spark.createDataFrame(rows, "kind string, rule string, action string")


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def _oracle() -> str:
    """Every rule on every URL, by conditions of DuckDB."""
    sites = " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{action}' AS action" for action, rule in SITES)
    # the patterns above, written out
    regexes = {
        "||spam-farm.": r"^[^/?#]*://([^/?#]*\.)?spam-farm\.", "||cheap-pills.": r"^[^/?#]*://([^/?#]*\.)?cheap-pills\.", "-casino.": r"-casino\.",
        "/adserver/*/click^": r"/adserver/.*/click([^A-Za-z0-9_.%-]|\z)", "?utm_source=feed|": r"\?utm_source=feed\z", "||blog.*/print^": r"^[^/?#]*://([^/?#]*\.)?blog\..*/print([^A-Za-z0-9_.%-]|\z)",
        "||m.*.org/en/": r"^[^/?#]*://([^/?#]*\.)?m\..*\.org/en/", "^sessionid=": r"([^A-Za-z0-9_.%-]|\z)sessionid=",
    }
    patterns = " UNION ALL ".join(f"SELECT '{rule}' AS pattern, '{action}' AS action, '(?is)' || '{regexes[rule]}' AS regex" for action, rule in PATTERNS)
    return rf"""WITH u AS (SELECT row_number() OVER () AS k, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
site AS ({sites}), pat AS ({patterns}),
s AS (SELECT k, arg_max(rule, len(rule)) AS rule, arg_max(action, len(rule)) AS action FROM p JOIN site ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[len(split_part(rule, '/', 1)) + 1:]) GROUP BY k),
m AS (SELECT k, arg_max(pattern, ((action = 'allow')::INT, len(pattern), pattern)) AS pattern, max(action = 'allow') AS fine FROM p JOIN pat ON regexp_matches(coalesce(url, ''), regex) GROUP BY k)
SELECT page_id, host, path, s.rule, CASE WHEN s.rule IS NOT NULL THEN s.action WHEN NOT fine THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN s.rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN s USING (k) LEFT JOIN m USING (k)"""


ORACLE_SQL = _oracle()
