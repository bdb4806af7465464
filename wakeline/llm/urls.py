"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled page outcomes are summed per host, registered domain and suffix. Each level's bad rate is
shrunk toward the level above through a beta-binomial prior whose strength is estimated from how
much that level's groups differ beyond chance. A host is blocked where even the lower bound of its
posterior bad rate is high. The bound's variance is the host's own plus what the prior's share of the
estimate carries down: a host without labels inherits the domain's posterior and all of its
uncertainty, which in turn holds the suffix's. Built-in operations only: outcomes collapse to sums before the shuffle, so a host with
a third of all pages is one row, and pages meet the host table by an equality join that is
broadcast where the table is counted to be small and split by adaptive execution otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import UPPER
from wakeline.session import checkpoint

#: (host, path, verdict); a rule's name is host followed by path.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Suffixes of several labels that are known where no table of suffixes is given; any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: Block where the posterior bad rate exceeds BLOCK_ABOVE by BOUND_Z standard deviations.
BLOCK_ABOVE = 0.5
BOUND_Z = 1.645
#: Prior strengths, in pages, are kept within these bounds.
WEAKEST, STRONGEST = 1.0, 1000.0
BROADCAST_HOSTS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


#: Labels that a suffix of a table has at most.
_LABELS = 5


def registered(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row a host) plus domain and suffix: the longest suffix of the table that the host ends with, else its last label.

    ``suffixes`` has a column ``suffix``, such as a public suffix list; rules without wildcards, of five labels at
    most. User names and ports take no part. A host that is a suffix itself is its own domain.
    """
    spark = hosts.sparkSession
    known = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string") if suffixes is None else suffixes.select("suffix").filter("suffix is not null").distinct()
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    x = hosts.withColumn("_name", name)
    ends = F.transform(F.sequence(F.lit(1), F.lit(_LABELS)), lambda n: F.struct(n.alias("n"), F.call_function("substring_index", F.col("_name"), F.lit("."), -n).alias("suffix")))
    each = x.select("host", F.explode(ends).alias("e")).select("host", "e.n", "e.suffix")
    best = each.join(F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known, "suffix").groupBy("host").agg(F.max("n").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    part = lambda k: F.call_function("substring_index", F.col("_name"), F.lit("."), -k)
    return x.join(best, "host", "left").withColumns({"domain": part(n + 1), "suffix": part(n)}).drop("_name", "_n")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; equal lengths go to the first name.

    ``rules`` is configuration, a few hundred entries at most: it becomes part of the expression.
    """
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(-len(h + p)).alias("o"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_min(F.array_compact(F.array(*fits)))


def prior_strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the prior strength of a level from its groups (n, k), by the method of moments."""
    s = groups.filter("n > 0").agg(
        F.count(F.lit(1)).cast("double").alias("g"),
        F.sum("n").cast("double").alias("n"),
        F.sum("k").cast("double").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("k2"),
    )
    p = F.col("k") / F.col("n")
    spread = (F.col("k2") - F.col("n") * p * p) / (p * (1 - p))
    rho = (spread - (F.col("g") - 1)) / (F.col("n") - F.col("n2") / F.col("n") - (F.col("g") - 1))
    rho = F.greatest(F.lit(1 / (STRONGEST + 1)), F.least(F.lit(1 / (WEAKEST + 1)), rho))
    usable = (F.col("g") >= 2) & (F.col("k") > 0) & (F.col("k") < F.col("n")) & (F.col("n") - F.col("n2") / F.col("n") > F.col("g") - 1)
    return s.select(F.when(usable, 1 / rho - 1).otherwise(F.lit(STRONGEST)).alias(name))


def shrunk(prior: str, strength: str) -> Column:
    return (F.col("k") + F.col(strength) * F.col(prior)) / (F.col("n") + F.col(strength))


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, domain, suffix, n, k, bad_rate, bound for (host, n, k) sums of labelled pages, n may be 0."""
    hosts = checkpoint(registered(outcomes.select("host", "n", "k"), suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    strengths = prior_strength(ends, "ms").crossJoin(prior_strength(domains, "md")).crossJoin(prior_strength(hosts, "mh"))
    n0, k0 = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))
    everything = ends.agg(((k0 + 0.5) / (n0 + 1)).alias("p0"), ((k0 + 0.5) / (n0 + 1) * (1 - (k0 + 0.5) / (n0 + 1)) / (n0 + 2)).alias("v0"))
    # One row of five numbers.
    given = F.broadcast(checkpoint(strengths.crossJoin(everything)))

    def posterior(level: DataFrame, prior: str, strength: str, variance: str) -> DataFrame:
        x = level.withColumn("_p", shrunk(prior, strength))
        own = F.col("_p") * (1 - F.col("_p")) / (F.col("n") + F.col(strength) + 1)
        lent = F.col(strength) / (F.col("n") + F.col(strength))
        return x.withColumn("_v", own + lent * lent * F.col(variance))

    ends = posterior(ends.crossJoin(given), "p0", "ms", "v0").select("suffix", F.col("_p").alias("ps"), F.col("_v").alias("vs"))
    domains = posterior(domains.join(ends, "suffix").crossJoin(given), "ps", "md", "vs").select("domain", "suffix", F.col("_p").alias("pd"), F.col("_v").alias("vd"))
    rated = posterior(hosts.join(domains, ["domain", "suffix"]).crossJoin(given), "pd", "mh", "vd").withColumnRenamed("_p", "bad_rate")
    return rated.select("host", "domain", "suffix", "n", "k", "bad_rate", (F.col("bad_rate") - BOUND_Z * F.sqrt("_v")).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules=RULES, suffixes: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, bad_rate and bound for every row of ``pages``.

    A page's outcome is the label row of its id: bad if quality is 0 or toxic is 1; several rows of an
    id are bad if one is; rows whose quality and toxic are both null say nothing. Null ids have no
    outcome. Repeated pages each get their verdict and each count as a labelled page. Urls without a
    host form the host "". ``suffixes`` is as in ``registered``. Other columns take no part; empty tables give an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    said = labels.select(F.col(label_id).alias("_id"), bad.alias("bad")).filter("bad is not null").groupBy("_id").agg(F.max("bad").alias("bad"))
    outcomes = rows.select("_id", "host").join(said, "_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    rated = checkpoint(reputations(outcomes, suffixes).select("host", "bad_rate", "bound"))
    if rated.count() <= BROADCAST_HOSTS:
        rated = F.broadcast(rated)
    out = rows.join(rated, "host").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") > BLOCK_ABOVE, "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "bad_rate", "bound")
