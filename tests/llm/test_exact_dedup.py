import hashlib
import random

import pytest

from fieldwire.llm import exact_dedup
from odd import docs, empty, rows


@pytest.fixture
def index(spark, tmp_path):
    return exact_dedup.DigestIndex(spark, f"{tmp_path}/index", 4)


def test_each_row_has_its_group(spark, index):
    got = exact_dedup.exact_duplicates(docs(spark), index).collect()
    assert len(got) == len(rows())
    groups = {}
    for i, text, *_ in rows():
        groups.setdefault(text or "", []).append(i)
    want = sorted((i is None, i or 0, max([x for x in groups[t or ""] if x is not None], default=None), len(groups[t or ""]),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_one_row_a_text_stays_with_all_columns(spark, index):
    got = exact_dedup.drop_duplicates(docs(spark), index)
    assert got.columns == docs(spark).columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 6, 7, 8, 9, 10]


def test_empty(spark, index):
    assert exact_dedup.exact_duplicates(empty(spark), index).count() == 0
    assert exact_dedup.drop_duplicates(empty(spark), index).count() == 0


def test_later_batches_meet_the_index_and_it_outlives_the_session_name(spark, index):
    seen, rng = set(), random.Random(3)
    for b in range(3):
        batch = [(b * 1000 + k, f"text {rng.randint(0, 60)}") for k in range(50)]
        got = exact_dedup.drop_duplicates(spark.createDataFrame(batch, "doc_id long, text string"), index)
        new = {t for _, t in batch} - seen
        assert sorted(r.text for r in got.collect()) == sorted(new)
        seen |= new
        index.close()
        index = exact_dedup.DigestIndex(spark, index.path, 99)
        assert index.buckets == 4 and index.rows().count() == len(seen)


def test_known_side_of_the_anti_join_is_not_shuffled(spark, index):
    exact_dedup.exact_duplicates(docs(spark), index).collect()
    seen = spark.createDataFrame([(b"x",)], "digest binary").repartition(4, "digest")
    plan = seen.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1


def test_hot_keys_are_split_off(spark):
    from fieldwire.llm.common import join_counted
    many = spark.createDataFrame([("hot", k) for k in range(3000)] + [(f"k{k}", k) for k in range(1000)], "key string, v long")
    counted = many.groupBy("key").count().withColumnRenamed("count", "n")
    got = join_counted(many, counted, "key", "n")
    assert got.count() == 4000 and got.filter("key = 'hot' and n = 3000").count() == 3000
