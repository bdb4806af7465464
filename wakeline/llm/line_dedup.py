"""Line dedup across documents, with built-in operations only.

Lines are exploded with their position, keyed by a 128-bit hash of their normal form, and the
distinct documents of every key are counted. Keys over the threshold lose their lines except in
the document with the largest id; documents are reassembled from the positions that stay.

Only (hash, document, position) rows move through the counting shuffles, never text. Counting
distinct documents aggregates before and after a shuffle on (key, document), so a key that stands
in a third of all rows is spread over all tasks; the join of lines with frequent keys is a plain
equality join of two exchanged sides, which adaptive execution splits where one key is hot.
Text moves once, by document, to meet the positions its document loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.skew import join_one
from wakeline.llm.text import SPACE, ascii_lower, whole
from wakeline.session import checkpoint

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _v, pos, h1, h2) of every line whose key has at least min_chars code points."""
    x = rows.select("_id", "_v", F.posexplode(F.split("_t", "\n", -1)).alias("pos", "line"))
    x = x.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.char_length("line") >= min_chars)
    x = x.withColumn("line", ascii_lower(F.col("line")))
    return x.select("_id", "_v", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line", F.lit(2)).alias("h2"))


def dropped_positions(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_id, _v, _drop array<int>): line positions each document loses; documents that lose none are absent.

    ``rows`` has _id, _v (tells texts under one id apart) and _t.
    """
    lines = checkpoint(_lines(rows, min_chars))
    # Null ids count as one document; max() takes them as the smallest.
    nulls = F.max(F.col("_id").isNull().cast("int"))
    frequent = lines.groupBy("h1", "h2").agg((F.count_distinct("_id") + nulls).alias("n"), F.max("_id").alias("keeper"), F.count(F.lit(1)).alias("_rows"))
    frequent = checkpoint(frequent.filter(F.col("n") >= min_docs).select("h1", "h2", "keeper", "_rows"))
    met = frequent.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    hit = join_one(lines, frequent, ["h1", "h2"], total=met).filter(~F.col("_id").eqNullSafe(F.col("keeper")))
    return hit.groupBy("_id", "_v").agg(F.collect_set("pos").alias("_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, plus ``kept_text``, ``n_lines`` and ``n_dropped`` (long).

    Lines end at \\n only. Null or empty text is one empty line. Keys shorter than ``min_chars`` code
    points are never dropped. Repeated rows of one id count as one document and are treated alike; of
    a key's documents the largest id keeps all its lines, null ids being smallest. Other columns of
    any name pass through inside ``row``. Empty tables give empty results.
    """
    text = whole(F.col(text_col))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_v"))
    drop = dropped_positions(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_v"), text.alias("_t")), min_chars, min_docs)
    drop = drop.select(F.col("_id").alias("_id2"), F.col("_v").alias("_v2"), "_drop")
    both = row.join(drop, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_v") == F.col("_v2")), "left")
    both = both.withColumn("_t", whole(F.col("row")[text_col])).withColumn("_lines", F.split("_t", "\n", -1))
    n, lost = F.size("_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return both.select("row", kept.alias("kept_text"), n.cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped"))


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its text replaced by the kept text and ``chars_col`` by its length; a null text stays null."""
    out = dedup_lines(docs, id_col, text_col)
    new = F.when(F.col(f"row.{text_col}").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept_text"))
    cols = []
    for c in docs.columns:
        value = new if c == text_col else F.char_length(new).cast("long") if c == chars_col else F.col("row")[c]
        cols.append(value.alias(c))
    return out.select(*cols)
