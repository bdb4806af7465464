"""Mixing sources to target weights by iterative proportional fitting, with built-in operations only.

Documents shrink to one row per (source, language, topic) cell, summed before the shuffle, so a hot
source is one cell row like any other. Raking scales the cells' factors in turn until their token
weights meet the source, language and topic shares; a document is then kept with its cell's
calibrated probability, decided by a hash of its id, so that reruns and retries agree.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.text import WORD, whole
from wakeline.session import checkpoint

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
#: How far a margin may stay from its target.
TOLERANCE = 1e-3
#: A margin's target is its token share to this power, normalised: 1 keeps the corpus, 0 is uniform.
TEMPERATURE = 0.7
SEED = 17
#: Cells up to which they are broadcast to the documents (about 100 bytes each); beyond, a shuffled join.
BROADCAST_CELLS = 100_000
#: Rounds between written states.
_STEP = 4


def tokens(text: Column) -> Column:
    """Words of the whole text."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def topic_of(n: Column) -> Column:
    """The stand-in where a table has no topic: the form its length suggests."""
    return F.when(n < 100, "brief").when(n < 1000, "article").otherwise("long")


def unit_hash(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from 52 bits of MD5, the same on every engine; null keys share one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _same(keys: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in keys.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def tempered_targets(cells: DataFrame, dim: str, temperature: float = TEMPERATURE) -> DataFrame:
    """(value, share) of one margin: token shares to the power of ``temperature``, normalised."""
    margin = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("n_tokens").alias("t")).filter("t > 0")
    raised = margin.select("value", F.pow(F.col("t").cast("double"), F.lit(temperature)).alias("p"))
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("p").alias("all")))).select("value", (F.col("p") / F.col("all")).alias("share"))


def _placed(docs: DataFrame, keep: dict[str, Column], text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """``keep`` plus source, lang, topic and n_tokens of every row."""
    own = [topic.cast("string").alias("topic")] if topic is not None else []
    x = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), tokens(F.col(text_col)).alias("n_tokens"), *own)
    return x if own else x.withColumn("topic", topic_of(F.col("n_tokens")))


def _summed(placed: DataFrame) -> DataFrame:
    return placed.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))


def cells(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """(source, lang, topic, n_tokens, n_docs) of every cell that ``docs`` has rows in."""
    return checkpoint(_summed(_placed(docs, {}, text_col, source_col, lang_col, topic)))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE) -> DataFrame:
    """cells (source, lang, topic, n_tokens, n_docs) plus ``factor``, ``weight`` and ``probability``.

    ``targets``: per dimension (value, share); a value that its target table does not name gets
    weight 0, a dimension without a table its tempered shares. Null is a value like any other.
    ``weight`` is the fitted share of all tokens; ``probability`` is the factor over the largest
    factor, the highest rate at which no document is needed twice. Cells without tokens have weight 0 and
    probability 1, as they change no share. No cells give no rows.
    """
    now = cells
    for dim in DIMENSIONS:
        want = (targets or {}).get(dim)
        want = tempered_targets(cells, dim, temperature) if want is None else want
        want = want.select(F.col("value").alias("_value"), F.col("share").cast("double").alias(f"_t_{dim}"))
        now = now.join(want, _same({dim: "_value"}), "left").drop("_value").fillna(0.0, [f"_t_{dim}"])
    now = checkpoint(now.withColumn("factor", F.lit(1.0)))
    for r in range(rounds):
        for dim in DIMENSIONS:
            held = F.sum(F.col("n_tokens") * F.col("factor")).over(Window.partitionBy(dim))
            now = now.withColumn("_held", held)
            now = now.withColumn("factor", F.when(F.col("_held") > 0, F.col("factor") * F.col(f"_t_{dim}") / F.col("_held")).otherwise(F.col("factor"))).drop("_held")
        if (r + 1) % _STEP == 0 or r + 1 == rounds:
            now = checkpoint(now)
    top = now.filter("n_tokens > 0").agg(F.max("factor").alias("_top"), F.sum(F.col("n_tokens") * F.col("factor")).alias("_all"))
    out = now.crossJoin(F.broadcast(top))
    weight = F.when(F.col("_all") > 0, F.col("n_tokens") * F.col("factor") / F.col("_all")).otherwise(0.0)
    probability = F.when((F.col("n_tokens") > 0) & (F.col("_top") > 0), F.col("factor") / F.col("_top")).otherwise(1.0)
    return out.select(*cells.columns, "factor", weight.alias("weight"), probability.alias("probability"))


def margins(fitted: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """dimension, value, target, share, error: how far the fitted weights of raked cells are from each margin's target.

    Targets that no set of weights can meet (a wanted value without tokens, margins that contradict each other) show as
    errors that more rounds do not lower.
    """
    out = None
    for dim in DIMENSIONS:
        want = (targets or {}).get(dim)
        want = tempered_targets(fitted, dim, temperature) if want is None else want
        want = want.select(F.col("value").alias("_value"), F.col("share").cast("double").alias("target"))
        have = fitted.groupBy(F.col(dim).alias("value")).agg(F.sum("weight").alias("share"))
        both = have.join(want, _same({"value": "_value"}), "full").select(F.lit(dim).alias("dimension"), F.coalesce("value", "_value").alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("share", F.lit(0.0)).alias("share"))
        out = both if out is None else out.unionByName(both)
    return out.withColumn("error", F.abs(F.col("share") - F.col("target")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    seed: int = SEED,
    strict: bool = False,
) -> DataFrame:
    """``row`` (all columns of ``docs``), source, lang, topic, n_tokens, weight, probability, kept.

    Every row is judged; null ids share one draw, repeated rows of an id are kept or left together. A margin that
    is farther than TOLERANCE from its target after the last round is warned of, or raises if ``strict``: the nearest fit
    is used, and ``margins`` tells how near it is.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    known = _placed(docs, {"_id": F.col(id_col), "row": row}, text_col, source_col, lang_col, topic)
    raked = checkpoint(rake(checkpoint(_summed(known)), targets))
    worst = margins(raked, targets).agg(F.max("error")).first()[0]
    if worst is not None and worst > TOLERANCE:
        said = f"a margin is {worst:.3g} from its target after {ROUNDS} rounds, more than {TOLERANCE:.3g}: the targets contradict each other or the table"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    fitted = raked.select(*[F.col(c).alias(f"_{c}") for c in DIMENSIONS], "weight", "probability")
    if fitted.count() <= BROADCAST_CELLS:
        fitted = F.broadcast(fitted)
    out = known.join(fitted, _same({c: f"_{c}" for c in DIMENSIONS}))
    kept = unit_hash(F.col("_id"), seed) < F.col("probability")
    return out.select("row", *DIMENSIONS, "n_tokens", "weight", "probability", kept.alias("kept"))


def sample_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps, with their columns as they were."""
    return mix(docs, **options).filter("kept").select("row.*")
