"""Quality classifier: hierarchical empirical Bayes over sites, combined with each document's evidence.

Evidence is the log-likelihood ratio of a document's binned measurements under good and bad labelled
documents (naive Bayes, add-one smoothing): one grouped aggregation over all labelled rows into at
most features x bins counts. Site quality is shrunk from path to host to the whole corpus through
beta-binomial priors of estimated strength, so a site with few labels stays near its host. The
score is the posterior probability of good quality: the path's prior odds times the evidence.

Only built-in operations: measurements are taken once per document and written to the shared
folder as small arrays; labels meet them by id; sites collapse to sums before the shuffle, so a
host with a third of all rows is one row. The model (at most 147 numbers) is one broadcast row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.quality_rules import measure
from wakeline.llm.urls import prior_strength, shrunk
from wakeline.session import checkpoint

TOP = 20
#: Feature -> bin of 0..TOP, integers only.
FEATURES = {
    "symbols": f"if(n_words > 0, least({TOP}, {TOP} * n_symbols div n_words), 0)",
    "upper": f"if(n_letters > 0, least({TOP}, {TOP} * n_upper div n_letters), 0)",
    "repeats": f"if(n_words > 0, least({TOP}, {TOP} * n_repeat_words div n_words), 0)",
    "dup_lines": f"if(n_lines > 0, least({TOP}, {TOP} * n_dup_lines div n_lines), 0)",
    "word_length": f"if(n_words > 0, least({TOP}, 2 * word_chars div n_words), 0)",
    "letters": f"if(word_chars > 0, least({TOP}, {TOP} * n_letters div word_chars), 0)",
    "size": f"least({TOP}, length(bin(n_words)))",
}
KEEP_FROM = 0.5
#: Sites up to which their table is broadcast (about 100 bytes each); beyond, a shuffled join.
BROADCAST_SITES = 100_000


def features(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """_id, host, path and bins (array<int>, in the order of FEATURES) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_path"), F.col(text_col).alias("_text"))
    m = measure(rows, "_text", ("_id", "_host", "_path"))
    return m.select("_id", "_host", "_path", F.array(*[F.expr(e).cast("int") for e in FEATURES.values()]).alias("bins"))


def evidence_table(labelled: DataFrame) -> DataFrame:
    """One row, ``llr`` (map of feature * (TOP + 1) + bin to log-likelihood ratio), from bins and good (0 or 1)."""
    keys = F.transform("bins", lambda b, i: i * (TOP + 1) + b)
    counts = labelled.select("good", F.explode(keys).alias("key")).groupBy("key").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    all_ = F.broadcast(labelled.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("all_good"), F.coalesce(F.sum(1 - F.col("good")), F.lit(0)).alias("all_bad")))
    ratio = F.log((F.col("g") + 1) / (F.col("all_good") + TOP + 1)) - F.log((F.col("b") + 1) / (F.col("all_bad") + TOP + 1))
    return counts.crossJoin(all_).agg(F.map_from_entries(F.collect_list(F.struct("key", ratio.alias("llr")))).alias("llr"))


def site_rates(outcomes: DataFrame) -> DataFrame:
    """_host, _path, site_rate for (_host, _path, n, k) sums, k of n good; n may be 0."""
    sums = checkpoint(outcomes.groupBy("_host", "_path").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    hosts = sums.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    base = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("p0"))
    given = F.broadcast(checkpoint(prior_strength(hosts, "mh").crossJoin(prior_strength(sums, "mp")).crossJoin(base)))
    hosts = hosts.crossJoin(given).select("_host", shrunk("p0", "mh").alias("ph"))
    return sums.join(hosts, "_host").crossJoin(given).select("_host", "_path", shrunk("ph", "mp").alias("site_rate"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, quality_col: str = "quality", fit_on: Column | None = None) -> DataFrame:
    """id, host, path, evidence, site_rate, score and kept for every row of ``docs``.

    Hosts and paths default to ``source`` and ``lang``. An id's label is its lowest non-null quality
    (1 good, else bad); labels of null ids or without a document say nothing. ``fit_on`` (a condition
    on ``_id``) restricts the labelled rows that are learned from, for held-out tests; None uses all.
    Without labels every score is 1/2 and every row kept. Null texts are empty, null hosts and paths
    the empty string; repeated rows are scored each; other columns take no part.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = checkpoint(features(docs, id_col, text_col, host, path))
    said = labels.select(F.col(id_col).alias("_id"), F.col(quality_col).alias("q")).filter("q is not null").groupBy("_id").agg(F.when(F.min("q") == 1, 1).otherwise(0).alias("good"))
    if fit_on is not None:
        said = said.filter(fit_on)
    labelled = checkpoint(rows.join(said, "_id").select("_id", "_host", "_path", "bins", "good"))
    known = rows.select("_host", "_path", F.lit(0).alias("n"), F.lit(0).alias("k")).distinct()
    outcomes = known.unionByName(labelled.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")))
    sites = checkpoint(site_rates(outcomes))
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    out = rows.join(sites, ["_host", "_path"]).crossJoin(F.broadcast(checkpoint(evidence_table(labelled))))
    terms = F.transform("bins", lambda b, i: F.coalesce(F.try_element_at(F.col("llr"), i * (TOP + 1) + b), F.lit(0.0)))
    out = out.withColumn("evidence", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
    odds = F.log(F.col("site_rate") / (1 - F.col("site_rate"))) + F.col("evidence")
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "evidence", "site_rate", "score", (F.col("score") >= KEEP_FROM).alias("kept"))
