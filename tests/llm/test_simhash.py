import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from fieldwire.llm import graph, simhash
from odd import docs, empty, rows


def plain(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, radius):
    """Least id reachable for each (id, fingerprint)."""
    group = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a][1] ^ fps[b][1]).count("1") <= radius:
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    least = {}
    for g, (i, _) in zip(group, fps):
        least[g] = min(least.get(g, i), i)
    return [least[g] for g in group]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C d E é", "x " * 700] + [r[1] for r in rows()])
def test_fingerprint(text):
    assert simhash.fingerprint_of((text or "").encode()) == plain(text)


def test_odd_rows(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    assert len(got) == len(rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].component_id == 1 and by_id[10].component_id == 1 and by_id[3].fp == 0
    assert by_id[4].component_id == by_id[8].component_id == 3 and by_id[6].component_id == 5
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_drop_keeps_one_of_each_class(spark):
    got = simhash.drop_near_duplicates(docs(spark))
    assert got.columns == docs(spark).columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7, 9] and ids.count(None) == 2


@pytest.mark.parametrize("seed,parts", [(0, 2), (1, 3), (2, 4), (3, 1)])
def test_every_link_is_found_whatever_the_plan(spark, seed, parts):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)})
    values = np.array(fps, np.uint64)
    plan, _ = simhash.allocate(values, 3, 1000, most_parts=parts)
    assert sum(p.threshold + 1 for p in plan) == 4 and sorted(b for p in plan for b in p.bits) == list(range(64))
    if parts == 1:
        plan = [simhash.Part(tuple(range(40)), 1), simhash.Part(tuple(range(40, 64)), 1)]
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, plan, 3).collect()}
    signed = values.view(np.int64).tolist()
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_query_against_brute_force(spark):
    from fieldwire.llm.queries import op2_simhash
    got = op2_simhash(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = sorted((i, plain(t)) for i, t in texts.items())
    want = {i: (f"{fp:016x}", c) for (i, fp), c in zip(fps, brute(fps, 3))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(40)] + [(5, 5), (1, 2), (2, 1)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {k: got.get(k, k) for k in least} == least


def test_a_unique_text_stays_where_a_near_copy_shares_its_id(spark):
    long = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"other{i}" for i in range(300))
    df = spark.createDataFrame([(1, long), (7, long.upper()), (7, other)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()} == {(1, long), (7, other)}
