"""URL filter (operator 8): rules indexed by their rarest literal token.

A rule has literal tokens: runs of ASCII letters and digits that stand whole in every URL that the rule fits.
How often the rules' tokens occur is counted over all URLs, and each rule is filed below its rarest one.  A URL's
tokens fetch the rules filed below them, and only those run their regular expression.  Rules without a literal token
run on every URL.  All is joins and aggregates over different URLs; a token with a third of all
URLs is a hot join key that adaptive execution splits.

Two kinds of rules.  ``site``: ``host/path`` fits the host and its subdomains where the path starts with the rule's; the
longest that fits decides, then the greater text.  ``pattern``: looked for in the URL with A-Z in lower case; ``*`` is any run, ``^`` a character
that is no ASCII letter or digit, or either end.  Where no site rule fits, a URL is allowed if an allowing
pattern fits, else blocked if a blocking one does, else allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path (a pattern may still fit it);
repeated pages are returned each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from sylva.llm.common import fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    text: str
    action: str  # allow or block
    kind: str = "site"


def _quoted(text: str) -> str:
    """A regular expression for a literal text, the same for Java and RE2."""
    return re.sub(r"([^A-Za-z0-9_\u0080-\U0010ffff])", r"\\\1", text)


def expression(rule: Rule) -> str:
    if rule.kind == "site":
        return r"^(?:[^/]*\.)?" + _quoted(rule.text)
    parts = {"*": "(?s:.*)", "^": "(?:^|[^a-z0-9]|$)"}
    return "".join(parts.get(p, _quoted(p)) for p in re.split(r"([*^])", rule.text))


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that stand whole in the URL: a site rule's begin at a label's or path part's begin; none may touch
    an open end or a ``*``."""
    text = rule.text.lower() if rule.kind == "site" else rule.text
    out = []
    for m in re.finditer("[a-z0-9]+", text):
        left = text[m.start() - 1] if m.start() else ("/" if rule.kind == "site" else "*")
        right = text[m.end()] if m.end() < len(text) else "*"
        if "*" not in (left, right):
            out.append(m[0])
    return sorted(set(out))


def parts(url) -> tuple:
    """Host and path columns of a URL column."""
    split = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, split, 1), _UPPER, _LOWER), F.regexp_extract(text, split, 2)


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", out_col: str = "judged") -> DataFrame:
    """The rows of ``pages`` with a struct column: host, path, rule (the site rule that decides, or null), verdict."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    urls = (pages.select(F.col(url_col).cast("string").alias("url")).where("url is not null").distinct()
            .select("url", F.translate("url", _UPPER, _LOWER).alias("low"), F.concat(*parts(F.col("url"))).alias("place")))
    tokens = F.array_distinct(F.regexp_extract_all("low", F.lit("([a-z0-9]+)"), F.lit(1)))
    listed = [(i, r.text, r.action, r.kind, expression(r), literal_tokens(r)) for i, r in enumerate(rules)]
    table = spark.createDataFrame(listed, "rule int, text string, action string, kind string, regex string, tokens array<string>")

    told = urls.select("url", "low", "place", F.explode(tokens).alias("token"))
    ruled = table.select("rule", F.explode("tokens").alias("token"))
    often = told.join(ruled.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = (ruled.join(often, "token", "left").groupBy("rule")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("t")).select("rule", F.col("t.token").alias("token")))
    fetched = told.join(rarest.join(table.drop("tokens"), "rule"), "token")
    free = [x for x in listed if not x[5]]
    if free:
        every = F.array(*[F.struct(F.lit(x[0]).alias("rule"), *[F.lit(v).alias(n) for v, n in zip(x[1:5], ("text", "action", "kind", "regex"), strict=True)]) for x in free])
        fetched = fetched.select("url", "low", "place", "rule", "text", "action", "kind", "regex").unionByName(
            urls.select("url", "low", "place", F.explode(every).alias("r")).select("url", "low", "place", "r.*"))
    is_site = F.col("kind") == "site"
    fits = fetched.where(F.rlike(F.when(is_site, F.col("place")).otherwise(F.col("low")), F.col("regex")))
    best = fits.groupBy("url").agg(
        F.max(F.when(is_site, F.struct(F.length("text").alias("n"), "text", "action"))).alias("site"),
        F.min(F.when(~is_site, F.col("action"))).alias("pattern"))  # allow before block
    key = fresh(pages, "url_key")
    found = best.select(F.col("url").alias(key), F.struct("site", "pattern").alias(out_col))
    verdict = F.coalesce(F.col(f"{out_col}.site.action"), F.col(f"{out_col}.pattern"), F.lit("allow"))
    return (pages.join(found, F.col(url_col).cast("string") == F.col(key), "left").drop(key)
            .withColumn(out_col, F.struct(host.alias("host"), path.alias("path"), F.col(f"{out_col}.site.text").alias("rule"), verdict.alias("verdict"))))
