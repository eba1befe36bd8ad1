"""URL verdicts: host and path rules, and for the rest trust and distrust spread over host links.

Every host with pages that a rule allows is a trusted seed, weighted by the share of its pages
that are allowed, and every host with pages that a rule blocks likewise a blocked seed; a host may
be both. Trust is the personalised PageRank from the trusted seeds along the
links, distrust the one from the blocked seeds along the reversed links: who links to blocked
hosts is distrusted. Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.session import cut

DAMPING = 0.85
#: Rounds end when ranks move by less than this in total (a seed set has rank 1).
TOLERANCE = 1e-4
ROUNDS_PER_STEP = 5
#: A host without a rule is blocked when its distrust is above its trust and above this multiple of the mean rank 1 / hosts.
DISTRUST_FACTOR = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or protocol-relative link; relative ones stay on their host.
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s<>]++)"""


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains), a path prefix, and what happens to the urls under them."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """`df` with _host and _path. Host: after the first :// up to /, ?, # or the end; path: from there up to ?, # or the end; '' without ://."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns({"_host": ascii_lower(F.regexp_extract(rest, r"^([^/?#]*+)", 1)), "_path": F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)})


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null where none does; of equal lengths a block goes first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts; a page counts once for each host that it links to."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)), ascii_lower)
    return (
        pages.where("_host <> ''").select(F.col("_host").alias("src"), F.explode(F.array_distinct(found)).alias("dst")).where("src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind, rank) for kind 'trust' along the links and 'distrust' against them, from seeds (host, kind, weight).

    The weights of a kind are scaled to 1. A host without links in a kind's direction passes nothing
    on. Rounds go on until the ranks move by less than `tolerance`; they shrink by `damping` at least.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("_sum")).where("_sum > 0")
    seeds = cut(seeds.join(total, "kind").select("host", "kind", (F.col("weight") / F.col("_sum")).alias("base")))
    steps = links.select(
        F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b")))).alias("s"), "n"
    ).select("s.*", "n")
    out = steps.groupBy("kind", "a").agg(F.sum("n").alias("_out"))
    steps = cut(steps.join(out, ["kind", "a"]).select("kind", F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("_out") * damping).alias("p")))
    start = seeds.select("host", "kind", (F.col("base") * (1 - damping)).alias("rank"))
    if steps.isEmpty() or seeds.isEmpty():
        return start
    ranks = start
    while True:
        now = ranks
        for _ in range(ROUNDS_PER_STEP):
            moved = now.join(steps, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("rank") * F.col("p")).alias("rank"))
            now = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
        now = cut(now)
        change = now.unionByName(ranks.withColumn("rank", -F.col("rank"))).groupBy("host", "kind").agg(F.abs(F.sum("rank")).alias("d")).agg(F.sum("d").alias("d")).first().d or 0.0
        ranks = now
        if change <= tolerance:
            return ranks


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row per row of `pages`.

    A url that a rule fits has the rule's verdict. Others are blocked if their host's distrust is
    above its trust and above the threshold, else allowed; hosts that nothing reaches have 0 of both.
    Null urls and urls without :// have an empty host and path, no rule, and are allowed. Null html
    has no links. Repeated rows count and come back as often as they are there. An empty table gives
    an empty result; other columns are not read.
    """
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), "_url")
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    judged = rows.withColumns({"_rule": name, "_verdict": verdict})
    hosts = cut(
        judged.where("_host <> ''").groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_verdict") == "allow").alias("allow"), F.count_if(F.col("_verdict") == "block").alias("block"))
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("weight")) for k, c in (("trust", "allow"), ("distrust", "block"))])
    seeds = hosts.select(F.col("_host").alias("host"), "n", F.explode(kinds).alias("s")).where("s.weight > 0").select("host", "s.kind", (F.col("s.weight") / F.col("n")).alias("weight"))
    ranks = spread(host_links(rows, "_html"), seeds)
    scores = ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    mean = 1.0 / max(1, hosts.count())
    found = judged.select("page_id", "_host", "_path", "_rule", "_verdict").join(scores, F.col("_host") == F.col("host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    blocked = (distrust > trust) & (distrust > DISTRUST_FACTOR * mean)
    return found.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"),
    )
