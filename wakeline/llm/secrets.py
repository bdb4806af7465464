"""Secret scans over a history of texts, as an incremental blob ledger.

Every version of every path is content-addressed by SHA-256. The ledger, a folder of Parquet files,
holds the findings of the one scan of each (blob, rule version); a run scans only pairs the ledger
lacks, appends them, and joins findings back to all paths that ever held the blob. Copies, however many, are scanned once: they
collapse by digest, partly before the shuffle, so a text that a third of all rows share is one blob.

Rule versions: "base" (assign, access, hex) and "v1" (base and four more kinds). Spans are
code-point offsets, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.skew import join_one
from wakeline.llm.text import whole
from wakeline.session import checkpoint

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "private_key", "github", "slack", "jwt")
VERSIONS = {"base": BASE, "v1": KINDS}
CURRENT = "v1"

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal: the shorter ones are those that fail
_MORE = {
    "private_key": ("-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")),
    "github": ("gh", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
}
#: One of these stands, in lower case, in every text with an assignment.
_HINTS = ("passw", "secret", "token", "key")


def spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of every finding, by start, then kind; per kind leftmost, not overlapping."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    if any(h in low for h in _HINTS):
        found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    for kind, (hint, pattern) in _MORE.items():
        if kind in kinds and hint in text:
            found += [(KINDS.index(kind), m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


_LOWER = {c: c + 32 for c in range(65, 91)}
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_version string, findings {FINDINGS}"


def blob_id(text):
    """The content address of a text column; null is the empty text."""
    return F.unhex(F.sha2(whole(text), 256))


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(blob, rule_version, findings) of the ledger in ``folder``, which is begun if it is not there."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def unseen(versions: DataFrame, text_col: str, ledger: DataFrame, rule_version: str) -> DataFrame:
    """(blob, text): one row for every blob in ``versions`` that the ledger has no scan of under the rule version.

    Blobs collapse first, in part before the shuffle; the ledger is met under the same partitioning.
    """
    rows = versions.select(blob_id(F.col(text_col)).alias("blob"), whole(F.col(text_col)).alias("text"))
    known = ledger.filter(F.col("rule_version") == rule_version).select("blob")
    return rows.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")


def scan(blobs: DataFrame, rule_version: str = CURRENT) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for (blob, text)."""
    kinds = VERSIONS[rule_version]
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans(t, kinds)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rule_version] * len(found), pa.string()), pa.array(found, kind_type)], names=["blob", "rule_version", "findings"])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def update(versions: DataFrame, folder: str, text_col: str = "text", rule_version: str = CURRENT) -> DataFrame:
    """The ledger in ``folder`` after every blob of ``versions`` that it lacked was scanned under the rule version.

    What it had stays untouched. New rows are appended in one commit: a run that fails leaves the ledger as it was,
    and one that is repeated scans nothing twice. One writer at a time.
    """
    spark: SparkSession = versions.sparkSession
    known = open_ledger(spark, folder)
    scan(unseen(versions, text_col, known, rule_version), rule_version).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def findings(versions: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", rule_version: str = CURRENT) -> DataFrame:
    """The key columns and ``findings`` of every row of ``versions``: all paths, all versions.

    Null text is the empty blob, which has no findings; repeated rows each get their findings; rows
    whose blob the ledger lacks are left out, which ``update`` rules out. Other columns take no part.
    """
    rows = checkpoint(versions.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], blob_id(F.col(text_col)).alias("blob")))
    known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "findings")
    return join_one(rows, known, ["blob"]).select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "findings")
