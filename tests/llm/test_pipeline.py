"""The pipeline's stages, each held against a plain version on its own input."""

import re

import pytest

import corpus_pipeline as pipeline

from .test_operators import DOCS, ODD, groups, targets, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "decontamination", "mix_sources"]
    before = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        kept = stage(spark, kept, SF)
        rows = {r.doc_id: r for r in kept.collect()}
        assert set(rows) <= set(before)
        if k < 4:
            assert kept.columns == docs.columns and all(tuple(rows[i]) == tuple(before[i]) for i in rows)
            kept = spark.createDataFrame(list(rows.values()), docs.schema)
        if k == 0:
            assert 0 < len(rows) < len(before) and all(len(words(r.text)) >= 50 for r in rows.values())
        elif k == 1:
            assert len(rows) >= 0.99 * len(before)
        elif k == 2:
            want = groups([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(rows) == {i for i, (_, smallest) in want.items() if i == smallest}
        elif k == 3:
            split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            windows = {tuple(w[j : j + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [split(r.text)] for j in range(len(w) - 9)}
            clean = {i for i, r in before.items() for w in [split(r.text)] if not any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))}
            assert set(rows) == clean
        else:
            sizes, taken = {}, {}
            for i, r in rows.items():
                source = before[i].source
                sizes[source] = sizes.get(source, 0) + len(words(before[i].text))
                taken[source] = taken.get(source, 0) + r.taken
            want = targets(sizes)
            assert set(rows) == set(before) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        before = rows


def test_run_gives_the_last_stage(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "size", "source_size", "target", "taken"} <= set(rows[0].asDict())


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_odd_and_empty_tables(spark, tmp_path, empty):
    """Nulls, empty and repeated rows and columns of the stages' own names: no crash, each stage keeps the columns, and nothing comes of nothing."""
    long = " ".join(f"word{k}" for k in range(60))
    rows = [] if empty else [(*r, 0, "x") for r in ODD] + [(i, long, lang, source, 1, 0, "x") for i, lang, source in [(20, "en", "a"), (20, "en", "a"), (None, "en", "b"), (21, None, None), (22, "en", "b")]]
    docs = spark.createDataFrame(rows, DOCS + ", size int, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns if k < 4 else {"doc_id", "taken"} <= set(out.columns)
        assert out.count() <= len(rows) and (k != 2 or len(out.filter("doc_id = 20").collect()) <= 1)
    assert pipeline.run(spark, str(tmp_path)).count() <= len(rows)
