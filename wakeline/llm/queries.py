"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import ann, bpe, byte_bpe, classifier, line_dedup, manifest, mixing, oracles, quality_rules, secrets, simhash, slots, urls, whitening
from wakeline.session import ensure_checkpoint_dir, table


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.pmod("_id", F.lit(20)) == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return rows.select("row.doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("cell_weight"), F.round("probability", 9).alias("probability"), "kept")


def mixing_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the raked weights are from every margin's target."""
    cells = mixing.cells(table(spark, sf_dir, "documents"))
    out = mixing.margins(mixing.rake(cells))
    return out.select("dimension", "value", F.round("target", 6).alias("target"), F.round("share", 6).alias("share"), (F.col("error") < 1e-6).alias("met"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "host", "path", F.round("evidence", 8).alias("evidence"), F.round("site_rate", 9).alias("site_rate"), F.round("score", 8).alias("score"), "kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return rows.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 9).alias("bad_rate"), F.round("bound", 9).alias("bound"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


MANIFEST = ("shard", "first_slot", "n_sequences", "n_docs", "n_ids", "stride", "sha256")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.materialise(table(spark, sf_dir, "documents"), _folder(spark, "slots")).select(*MANIFEST)


def training_order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over the token ids of operator 10: encoded once, written, and put in training order at two bytes an id."""
    ids = _folder(spark, "ids")
    bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary(), {"doc_id": F.col("doc_id")}, F.col("text"), decoded=False, keep=False).write.parquet(ids)
    return slots.materialise(spark.read.parquet(ids), _folder(spark, "slots"), ids_col="ids", vocabulary=bpe.vocabulary_size(vocabulary())).select(*MANIFEST)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules once per document into a stored ledger, and the verdicts of every policy version read from it."""
    rows = quality_rules.judge(table(spark, sf_dir, "documents"), _folder(spark, "quality"))
    return rows.select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept", "fail_bits", *[f"kept_{p}" for p in quality_rules.POLICIES])


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule costs under each policy version, from the stored ledger."""
    rows = quality_rules.write_ledger(table(spark, sf_dir, "documents"), _folder(spark, "quality"))
    return quality_rules.ablation(rows)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a history, one after the other, through one ledger; the findings of all rows of both."""
    docs = table(spark, sf_dir, "documents")
    folder = _folder(spark, "secrets")
    later = F.xxhash64("doc_id") % 2 == 0  # the rows that the second version brings; both versions are scanned whole
    secrets.update(docs.filter(~later), folder)
    rows = secrets.findings(docs, secrets.update(docs.filter(later), folder))
    base = F.filter("findings", lambda f: f["kind"].isin(*secrets.BASE))
    text = lambda found: F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
    )


def vocabulary() -> str:
    """The tokenizer file of the encoding queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary(), {"doc_id": F.col("doc_id")}, F.col("text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, {"doc_id": F.col("doc_id")}, F.col("text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_training_order": op7_training_order,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_bpe": op10_bpe,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
    "mixing_margins": mixing_margins,
    "quality_ablation": quality_ablation,
    "training_order_tokens": training_order_tokens,
}

ORACLE: dict[str, str] = {
    "op2_mixing": oracles.mixing(),
    "op3_line_dedup": oracles.LINE_DEDUP,
    "op4_quality_classifier": oracles.quality_classifier(),
    "op5_url_filter": oracles.URL_FILTER,
    "op8_quality_rules": oracles.quality_rules(),
    "op9_secret_scan": oracles.secret_scan(),
    "op13_merkle_manifest": oracles.merkle_manifest(),
    "mixing_margins": oracles.mixing_margins(),
    "quality_ablation": oracles.quality_ablation(),
}
