"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its failure bits and the
measurements behind them. A policy is a version name and a mask of the rules it applies:
changing the policy, comparing policies, or asking what one rule costs reads the ledger only.

Everything is built-in expressions on one row at a time, so the ledger needs no shuffle; a long
document costs its own task in proportion to its length (n log n for repeated windows).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import WORD, whole, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Rule name -> condition under which a document fails, over MEASURES. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "n_letters >= 20 and 2 * n_upper > n_letters",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "long_words": "n_words > 0 and word_chars > 25 * n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "few_letters": "word_chars > 0 and 4 * n_letters < word_chars",
}
BASE = ("few_words", "repeated_windows")
#: Version -> rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting"),
    "v2": (*BASE, "symbols", "shouting", "short_words", "few_letters"),
    "strict": tuple(RULES),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...] | list[str], order: Mapping[str, object] = RULES) -> int:
    """The bits of the named rules."""
    names = list(order)
    return sum(1 << names.index(r) for r in rules)


def _sorted_pairs(keys: Column) -> Column:
    """(key, start) of every window in order of key, or null where no key occurs twice."""
    n = F.size(keys)
    pairs = F.sort_array(F.arrays_zip(keys.alias("k"), F.sequence(F.lit(1), n).alias("p")))
    return F.when((n >= 2) & (F.size(F.array_distinct(keys)) < n), pairs)


def _covered(pairs: Column) -> Column:
    """Words covered by windows whose key occurs twice or more: keep both of every equal neighbouring
    pair, then add up what each kept start covers beyond the one before it."""
    twice = F.zip_with(
        F.slice(pairs, F.lit(1), F.size(pairs) - 1),
        F.slice(pairs, F.lit(2), F.size(pairs) - 1),
        lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(twice)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["end"])).cast("int").alias("n"), (p + WINDOW).alias("end")),
        lambda s: s["n"],
    )


def _matching(runs: str) -> Column:
    """Characters in runs of a class: what is missing once they are taken out."""
    return F.length("_t") - F.length(F.regexp_replace("_t", runs, ""))


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus MEASURES of every row's whole text.

    Null text counts as empty (all zero); repeated rows are measured each for itself; other
    columns of ``docs``, whatever their names, take no part. Window keys are 64-bit hashes within one document.
    """
    row = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], whole(F.col(text_col)).alias("_t"))
    row = row.withColumns({"_w": words(F.col("_t")), "_l": F.split("_t", "\n", -1)})
    row = row.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    at = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + c) for c in range(WINDOW)])
    row = row.withColumn("_g", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), at)))
    row = row.withColumns({"_s": F.filter("_l", lambda x: x.rlike(WORD)), "_p": _sorted_pairs(F.col("_g"))})
    measured = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _matching("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_s") - F.size(F.array_distinct("_s"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_p").isNull(), 0).otherwise(_covered(F.col("_p"))).cast("long").alias("n_repeat_words"),
        F.size("_s").cast("long").alias("n_lines"),
        _matching(r"\p{Lu}+").cast("long").alias("n_upper"),
        _matching(r"\p{L}+").cast("long").alias("n_letters"),
    )
    # Generated rows stop filters: one moved below would evaluate each measurement once per mention in a rule.
    return row.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.inline(F.array(measured)))


def ledger(measured: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Adds ``fail_bits`` (long): bit i is set if rule i fails. A condition that is null does not fail."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def verdict(bits: Column, policy_mask: int) -> Column:
    """Kept under the policy: none of its rules failed."""
    return bits.bitwiseAND(F.lit(policy_mask).cast("long")) == 0


def ablation(ledger_rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Per policy and rule: documents kept by the policy, kept if the rule were left out, and failing that rule alone.

    First the ledger shrinks to one count per distinct bitmask (at most 2^rules rows, combined
    before the shuffle); policies then apply to those counts. Empty ledgers give no rows.
    """
    counts = ledger_rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    names = list(rules)
    plans = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(tuple(used), rules)).cast("long").alias("m"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for p, used in policies.items()
        for r in used
    ]
    x = counts.withColumn("p", F.explode(F.array(*plans)))
    hit = F.col("fail_bits").bitwiseAND(F.col("p.m"))
    return x.groupBy("p.policy", "p.rule").agg(
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("p.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.sum(F.when(hit == F.col("p.bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.expr("bit_or(case when fail_bits & p.m = 0 then 0 else fail_bits end)").alias("bits_seen"),
    )


def write_ledger(docs: DataFrame, folder: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measure every row of ``docs`` once and store ``keep``, MEASURES and ``fail_bits`` in ``folder``; the stored ledger.

    Policies and ablations read it from there: no text is measured again when they change.
    """
    ledger(measure(docs, text_col, keep)).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def apply_policies(ledger_rows: DataFrame, policy: str = CURRENT, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Adds base_failed, kept (under ``policy`` and the base rules), and one ``kept_<version>`` for every policy."""
    bits = F.col("fail_bits")
    own = {f"kept_{p}": verdict(bits, mask(used)) for p, used in policies.items()}
    return ledger_rows.withColumns({"base_failed": ~verdict(bits, mask(BASE)), "kept": verdict(bits, mask(tuple({*BASE, *policies[policy]}))), **own})


def judge(docs: DataFrame, folder: str, text_col: str = "text", id_col: str = "doc_id", policy: str = CURRENT) -> DataFrame:
    """The id, measurements, fail_bits and verdicts of every row of ``docs``, through a ledger stored in ``folder``."""
    return apply_policies(write_ledger(docs, folder, text_col, (id_col,)), policy)


def keep_rows(docs: DataFrame, text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns as they were."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    rows = ledger(measure(packed, "_text", ("_row",)))
    return rows.filter(verdict(F.col("fail_bits"), mask(POLICIES[policy]))).select("_row.*")
