"""The pipeline's stages against plain readings of what each decides."""


import pytest

import corpus_pipeline
from codestrata.llm import common, quality
from tests.llm import util
from tests.llm.test_filters import plain_spans
from tests.llm.test_near_dup import brute
from tests.llm.test_quality import plain_kept


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = common.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, sf))
        out.append((name, before, docs))
    return out


def test_stages_return_the_columns_of_documents(spark, sf, stages):
    assert [n for n, *_ in stages] == ["quality classifier", "quality rules", "near-duplicates", "secret scans", "packing"]
    wanted = common.table(spark, sf, "documents").schema
    for _, _, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in wanted]


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_stage(spark, sf, stages):
    _, before, after = stages[0]
    model = quality.learn(before, common.table(spark, sf, "labels"))
    rows = by_id(before)
    assert set(by_id(after)) == {i for i, t in rows.items() if model.score(quality.features([t or ""]))[0] >= 0.5}
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    kept = set(by_id(after))
    assert sum(i in kept for i, q in labels.items() if q == 1) > 0.95 * sum(q == 1 for q in labels.values())


def test_rules_stage(stages):
    _, before, after = stages[1]
    assert set(by_id(after)) == {i for i, t in by_id(before).items() if plain_kept(t)[1]}


def test_near_duplicates_stage(stages):
    _, before, after = stages[2]
    rows = list(by_id(before).items())
    assert by_id(after) == {i: dict(rows)[i] for i, _, _, kept in brute(rows, n=5) if kept}


def test_secrets_stage(stages):
    _, before, after = stages[3]
    old, new = by_id(before), by_id(after)
    assert set(old) == set(new)
    for i, text in old.items():
        assert (new[i] == text) == (not plain_spans(text))
        for _, s, e in plain_spans(text):
            assert text[s:e] not in new[i]
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_packing_stage(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(by_id(before))
    lengths = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        lengths.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= 2048 for x in lengths.values())


def test_run_is_the_stages_in_turn(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] == stages[-1][2].agg({"length": "sum"}).first()[0]


def test_awkward_rows(spark, sf):
    rows = spark.createDataFrame([(r[0], r[1], r[2], "s", 1, *"xyz") for r in util.AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, score string, rule string, key string")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, rows, sf).collect()
        stage(spark, rows.limit(0), sf).collect()
    kept = corpus_pipeline.keep_one(spark, rows, sf).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(4) == 1 and 8 not in ids and ids.count(None) == 1


def test_near_duplicates_by_id_and_text(spark, sf):
    base = " ".join(f"w{k}" for k in range(200))
    near, other = base + " end", " ".join(f"v{k}" for k in range(200))
    rows = [(1, base), (1, other), (1, other), (2, near), (None, near + " more"), (None, other + " more"), (None, "all alone " + "x " * 30), (None, "all alone " + "x " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.keep_one(spark, docs, sf).collect()))
    assert kept == sorted([(1, base), (1, other), (0, "all alone " + "x " * 30)])
