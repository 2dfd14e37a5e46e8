r"""URL filters: longest-match rules, and for the rest trust propagated over host links.

Hosts get two scores by personalised PageRank over host edges (counted links between
hosts, each edge once with its weight): trust flows from hosts that allow rules cover
along links, distrust from blocked hosts against links, so that a host linking to blocked
ones is distrusted. A host is blocked where distrust exceeds its trust. Both are shares of
the whole table, so only their relation counts: no bound that a larger table would move.
Rounds go on until no score moves by more than a part of itself, however far it came, and
no host's verdict lies within what later rounds may still add (each adds at most 0.85 of the
last one's step). Scores that stay within a billionth of each other are a tie: allowed.

Only DataFrame functions. Links are summed to edges before they meet the scores, scores
are one row a host, and every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

#: (rule, verdict); a rule is a host and a path prefix that starts with "/".
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Rounds end at the earliest when one moves every score by at most this part of it.
TOLERANCE = 1e-3
#: Scores this near are equal: sums in another order differ by less.
EQUAL = 1e-9
#: Host of an absolute or scheme-relative link in an html attribute.
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits (of equal ones the first by text), or null."""
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links from pages to other hosts, as shares of src's links."""
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    rows = pages.where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), link.alias("to")).select("src", F.translate("to", _UP, _LOW).alias("dst"))
    return rows.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _shares(edges: DataFrame, giver: str, taker: str, verdict: str) -> DataFrame:
    total = edges.groupBy(F.col(giver).alias("_g")).agg(F.sum("n").alias("_all"))
    return edges.join(total, F.col(giver) == F.col("_g")).select(F.lit(verdict).alias("kind"), F.col(giver).alias("giver"), F.col(taker).alias("taker"), (F.col("n") / F.col("_all")).alias("share"))


def _rank(seeds: DataFrame, shares: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(kind, host, linked), stored: seeds (kind, host, seed) spread over the shares of each
    kind; what hosts without links hold is lost.

    ``linked`` is what links bring; a host's own seed stays out, since a rule for one path
    says nothing about the host's other pages. Scores grow from the seeds alone, so a host
    that is first reached in some round keeps the rounds going.
    """
    start = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("got"), F.lit(0.0).alias("linked"), F.lit(0.0).alias("was"))
    now = stored(start.select("kind", "host", F.col("got").alias("score"), "linked"), "rank")
    while True:
        held = now.select(F.col("kind").alias("_k"), F.col("host").alias("_h"), "score")
        gained = shares.join(held, (F.col("kind") == F.col("_k")) & (F.col("giver") == F.col("_h"))).groupBy("kind", F.col("taker").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("got"))
        gained = gained.select("kind", "host", "got", F.col("got").alias("linked"), F.lit(0.0).alias("was"))
        before = now.select("kind", "host", F.lit(0.0).alias("got"), F.lit(0.0).alias("linked"), F.col("linked").alias("was"))
        sums = gained.unionByName(start).unionByName(before).groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in ("got", "linked", "was")])
        after = stored(sums.select("kind", "host", F.col("got").alias("score"), "linked", F.abs(F.col("linked") - F.col("was")).alias("step")), "rank")
        drop_stored(now)
        now = after
        if now.where(F.col("step") > tolerance * F.col("linked")).isEmpty() and _open(now, damping).isEmpty():
            return now.select("kind", "host", "linked")


def _open(ranks: DataFrame, damping: float) -> DataFrame:
    """Hosts whose two scores are nearer than what later rounds may add to either."""
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("linked"))), F.lit(0.0))
    both = ranks.groupBy("host").agg(of("allow").alias("t"), of("block").alias("d"), F.sum("step").alias("step"))
    rest = F.col("step") * (damping / (1 - damping))
    return both.where((F.col("t") > 0) & (F.col("d") > 0) & (F.abs(F.col("t") - F.col("d")) <= rest) & (rest > EQUAL * F.greatest("t", "d")))


def host_scores(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of hosts that either reaches.

    A host's seed is its share of all pages that an allow (or a block) rule covers.
    """
    edges = stored(host_edges(pages), "host-edges")
    judged = pages.select(host_of(F.col("url")).alias("host"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("kind"))
    counts = stored(judged.where("host <> '' AND kind IS NOT NULL").groupBy("host", "kind").agg(F.count("*").alias("n")), "host-seeds")
    total = counts.groupBy(F.col("kind").alias("_k")).agg(F.sum("n").alias("_all"))  # two rows
    seeds = counts.join(F.broadcast(total), F.col("kind") == F.col("_k")).select("kind", "host", (F.col("n") / F.col("_all")).alias("seed"))
    shares = stored(_shares(edges, "src", "dst", "allow").unionByName(_shares(edges, "dst", "src", "block")), "host-shares")
    ranks = _rank(seeds, shares, damping, tolerance)
    for done in (edges, counts, shares):
        drop_stored(done)
    score = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("linked"))), F.lit(0.0))
    return ranks.groupBy("host").agg(score("allow").alias("trust"), score("block").alias("distrust"))


def judged_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, no rule and the verdict
    allow; null html gives no links; repeated rows are judged alike and count in the graph
    as often as they are there; a host of equal trust and distrust is allowed; very long html
    is read whole; other columns are ignored; an empty table gives no rows.
    """
    scores = host_scores(pages, rules).withColumnRenamed("host", "_h")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.coalesce("distrust", F.lit(0.0)) > (1 + EQUAL) * F.coalesce("trust", F.lit(0.0))
    # scores have a row a host: a host with a third of the pages is a skew that the join may split
    return rows.join(scores, F.col("host") == F.col("_h"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("_r.rule").alias("rule"),
        F.coalesce("_r.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def query(spark, sf_dir):
    # the digest leaves the scores out: their last digits depend on the order of sums
    return judged_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
