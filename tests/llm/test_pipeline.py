"""The pipeline against a plain version of every stage but the last two's arithmetic."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_llm import plain_groups, plain_lines, plain_print
from wakeline.llm import mixing, quality_rules


def test_stages(spark, sf_dir, tmp_path):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = []
    for name, stage in cp.STAGES:
        out = stage(spark, d, sf_dir).cache()
        held.append(out)
        if name != "encode":
            assert out.columns == d.columns
        d = out
    kept = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{tmp_path}/ledger").filter("kept").collect()}
    first = {r.doc_id: r.text for r in held[0].collect()}
    assert set(first) == kept
    lines = {r.doc_id: (r.text, r.n_chars) for r in held[1].collect()}
    assert lines == {i: (t, len(t)) for i, _, t in plain_lines(sorted(first.items()))}
    ids = sorted(lines)
    groups = plain_groups([plain_print(lines[i][0]) for i in ids])
    assert {r.doc_id for r in held[2].collect()} == {ids[g] for g in set(groups)}
    chosen = {r.doc_id for r in mixing.mix(held[2]).filter("kept").select("row.doc_id").collect()}
    assert {r.doc_id for r in held[3].collect()} == chosen
    assert held[4].filter(F.size("ids") != F.col("n_tokens")).count() == 0 and held[4].count() == len(chosen)
    assert {(r.doc_id, tuple(r.ids)) for r in cp.run(spark, sf_dir).collect()} == {(r.doc_id, tuple(r.ids)) for r in held[4].collect()}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, fp long, h1 long, _id string, row string, factor double"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, other scripts, names that the operators use themselves."""
    clean = " ".join(f"word{i}" for i in range(60))
    shared = "a line of more than forty code points that many documents share"
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    texts = [None, "", " \n\t ", clean, clean, clean + " end", long, "日本語 É " + clean, "x " * 200, *[f"{shared}\n{clean} {i} {i * 31} {i * 57} {i * 91}" for i in range(9)]]
    rows = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None, len(t) if t else None, "a", "b", i, i, "c", "d", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, clean + " other words", None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 10)]
    return spark.createDataFrame(rows, CLASHING)


def test_every_stage_takes_odd_rows(spark, sf_dir):
    """Each stage on the odd table for itself, and all in turn: columns stay, counts and rows are as the plain rules say."""
    d = odd_documents(spark)
    rows = d.collect()
    for name, stage in cp.STAGES:
        out = stage(spark, d, sf_dir)
        got = out.collect()
        if name == "encode":
            assert len(got) == len(rows) and all(r.ids == [] for r in got if r.n_chars in (0, None) and r.doc_id in (0, 1))
            continue
        assert out.columns == d.columns
        # Every row that comes out went in, with no column changed but the text of line dedup.
        plain = lambda r: tuple(v for c, v in r.asDict().items() if name != "line dedup" or c not in ("text", "n_chars"))  # noqa: B023, E731
        left = [plain(r) for r in rows]
        for r in got:
            left.remove(plain(r))
        if name == "line dedup":
            assert len(got) == len(rows) and {r.doc_id for r in got if r.text is None} == {0, None}
            assert sum("many documents share" in (r.text or "") for r in got) == 1
        if name == "near copies":
            prints = [plain_print(r.text) for r in rows]
            assert len(got) == len(set(plain_groups(prints)))
    for _, stage in cp.STAGES:
        d = stage(spark, d, sf_dir)
    assert 0 < d.count() < len(rows)


def test_every_stage_takes_an_empty_table(spark, sf_dir):
    d = odd_documents(spark).limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, d, sf_dir)
        assert out.count() == 0 and (name == "encode" or out.columns == d.columns)
