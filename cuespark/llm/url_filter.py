"""URL filter: written rules first, then trust and distrust spread over the host graph.

Native: DataFrame functions only. Hosts that hold allowed pages are trusted seeds, hosts that
hold blocked pages are distrusted seeds, each with the share of its pages that a rule allows or
blocks. Personalised PageRank carries trust along links and distrust against them; a page that
no rule fits is blocked if its host has at least the threshold of distrust and more distrust
than trust.

Links are summed by host pair before anything else, so a host that holds a third of all pages
is one row of the graph per partner. Defined cases: a null url, or one without ``://``, has an
empty host and path, fits no rule and is allowed; null html has no links; links of a host to
itself carry nothing; repeated pages count as often as they stand; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import ascii_lower, free_name, stored

# The rules of the query, as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another host."""
    targets = F.regexp_extract_all(
        F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), 1
    )
    return (
        pages.select(host_of(F.col(url)).alias("src"), F.explode(targets).alias("dst"))
        .select("src", ascii_lower(F.col("dst")).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(
    seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 120, every: int = 6, tolerance: float = 1e-4
) -> DataFrame:
    """(host, trust, distrust) from ``seeds(host, trust, distrust)`` over ``links(src, dst, n)``.

    Both spread in one pass: each link stands once as it is, for trust, and once turned round,
    for distrust. Lineage is cut every few rounds; it stops when no score moves by more than
    ``tolerance`` in a round, which ``damping`` brings about whatever the graph (60 rounds leave
    0.0001 of a score); not to have settled after ``rounds`` is an error.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    into = links.groupBy("dst").agg(F.sum("n").alias("all"))
    ways = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    back = links.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("all")).alias("d"))
    ways = stored(ways.unionByName(back), "ways")
    everyone = seeds.select("host").unionByName(ways.select("host")).unionByName(ways.select(F.col("to").alias("host"))).distinct()
    seeds = stored(everyone.join(seeds, "host", "left").na.fill(0.0, ["trust", "distrust"]), "seeds")
    start = seeds.select("host", (F.col("trust") * (1 - damping)).alias("t0"), (F.col("distrust") * (1 - damping)).alias("d0"))
    rank = seeds.select("host", F.col("trust") * (1 - damping), F.col("distrust") * (1 - damping)).toDF("host", "trust", "distrust")
    for k in range(1, rounds + 1):
        came = (
            ways.join(rank, "host")
            .groupBy("to")
            .agg(F.sum(F.col("trust") * F.col("t")).alias("t"), F.sum(F.col("distrust") * F.col("d")).alias("d"))
            .withColumnRenamed("to", "host")
        )
        grown = lambda base, c: F.col(base) + damping * F.coalesce(F.col(c), F.lit(0.0))
        new = start.join(came, "host", "left").select("host", grown("t0", "t").alias("trust"), grown("d0", "d").alias("distrust"))
        if k % every:
            rank = new
            continue
        moved = rank.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        both = stored(new.join(moved, "host"), "rank")
        most = both.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d"))))).first()[0]
        rank = both.select("host", "trust", "distrust")
        if (most or 0.0) <= tolerance:
            return rank
    raise RuntimeError("scores did not settle")


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.075, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust; ``threshold`` is in units of a score.

    An unlinked host whose every page is blocked has distrust 0.15, the share that doesn't travel.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    # columns of the input whose names are taken by the result keep them with a leading underscore
    own = ("host", "path", "rule", "verdict", "trust", "distrust", "__verdict")
    clash = {c: free_name(pages, "_" + c) for c in pages.columns if c.lower() in own}
    kept = [clash.get(c, c) for c in pages.columns if c.lower() != html.lower()]
    pages = pages.withColumnsRenamed(clash)
    judged = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("__verdict"))
    seeds = (
        judged.where("host <> ''").groupBy("host")
        .agg(F.avg(F.when(F.col("__verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("__verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    )
    scores = propagate(seeds, host_links(pages, url, html))
    spread = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("__verdict", spread).alias("verdict"), "trust", "distrust"
    )
