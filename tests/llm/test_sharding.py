import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldwire.llm import sharding as s
from odd import docs, empty, rows


def test_one_row_each_with_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 3)
    many = [(99, "again", "en", "a", 1)] * 20
    df = docs(spark).unionByName(spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = s.manifest(df, [1.0] * 3, 1.0).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows() + many)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.law for r in got} == {"key"}
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in {r.doc_id for r in got})


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    few = {r.doc_id: r for r in s.manifest(keys, [1.0] * 9, 1.0).collect()}
    more = {r.doc_id: r.shard for r in s.with_shard(keys, [1.0] * 10).collect()}
    assert all(r.grown_shard == more[i] and r.grown_shard in (r.shard, 9) for i, r in few.items())
    assert sum(x == 9 for x in more.values()) == pytest.approx(2000, rel=0.1)


def test_rows_follow_the_weights(spark):
    keys = spark.range(30_000).select(F.col("id").alias("doc_id"))
    got = Counter(r.shard for r in s.with_shard(keys, [1.0, 2.0, 0.0, 3.0]).collect())
    assert got[2] == 0 and [got[j] for j in (0, 1, 3)] == pytest.approx([5000, 10_000, 15_000], rel=0.06)
    # more weight for a shard moves rows only into it
    more = s.with_shard(keys, [1.0, 4.0, 0.0, 3.0]).collect()
    before = {r.doc_id: r.shard for r in s.with_shard(keys, [1.0, 2.0, 0.0, 3.0]).collect()}
    assert all(r.shard in (before[r.doc_id], 1) for r in more)


def test_no_weights(spark):
    for bad in ([], [0.0], [1.0] * 5000):
        with pytest.raises(ValueError):
            s.manifest(docs(spark), bad)


def test_empty_and_without_growth(spark):
    assert s.manifest(empty(spark), [1.0] * 4, 1.0).count() == 0
    assert {r.grown_shard for r in s.manifest(docs(spark), [1.0] * 4).collect()} == {None}


def test_files_hold_each_row_in_its_shard(spark, tmp_path):
    plain = docs(spark).select("doc_id", "text")
    s.write_shards(plain, [1.0] * 3, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    want = s.with_shard(plain, [1.0] * 3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.shard)
    assert sorted(map(key, back)) == sorted(map(key, want))
