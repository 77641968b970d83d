import corpus_pipeline as c
import pytest
from fieldwire.llm import decontaminate, exact_dedup, quality, simhash
from fieldwire.llm.common import table
from odd import docs, empty

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What went into each stage and what came out."""
    at, out = table(spark, FOLDER, "documents"), {}
    for name, stage in c.STAGES:
        before, at = at, c.written(stage(spark, at, FOLDER), f"test-{name}")
        out[name] = before, at
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    score = quality.scores(before, quality.fit(before, table(spark, FOLDER, "labels")))
    assert ids(after) == ids(score.filter("score >= 0.5")) and after.columns == before.columns
    labels = table(spark, FOLDER, "labels")
    assert after.join(labels, "doc_id").filter("quality = 1").count() >= 0.98 * before.join(labels, "doc_id").filter("quality = 1").count()


def test_exact_stage(stages):
    before, after = stages["exact"]
    best = {}
    for r in before.select("doc_id", "text").collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert ids(after) == sorted(best.values())


def test_near_stage(stages):
    before, after = stages["near"]
    fate = simhash.near_duplicates(before).collect()
    assert ids(after) == sorted({r.component_id for r in fate})


def test_decontaminate_stage(spark, stages):
    before, after = stages["decontaminate"]
    found = {r.doc_id for r in decontaminate.contaminated(before, table(spark, FOLDER, "benchmark")).collect()}
    assert found and ids(after) == sorted(set(ids(before)) - found)


def test_mix_stage_and_run(spark, stages):
    before, after = stages["mix"]
    assert set(ids(after)) <= set(ids(before)) and after.columns == [*before.columns, "copy_no", "mix_key"]
    assert abs(after.count() - before.count()) < 6 * before.count() ** 0.5
    assert sorted(map(str, c.run(spark, FOLDER).collect())) == sorted(map(str, after.collect()))


def test_odd_and_empty_tables(spark):
    for frame, some in ((docs(spark), True), (empty(spark), False)):
        at = frame
        for name, stage in c.STAGES:
            at = c.written(stage(spark, at, FOLDER), f"odd-{name}")
        assert (at.count() > 0) == some and at.columns == [*[x for x in frame.columns if x not in ("copy_no", "mix_key")], "copy_no", "mix_key"]


def test_index_of_the_exact_stage_is_its_own(spark):
    assert isinstance(c.fresh_index(spark), exact_dedup.DigestIndex)
