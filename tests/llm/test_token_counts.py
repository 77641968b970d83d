import random

import pytest

from fieldwire.llm import token_counts as t
from odd import docs, empty, rows

COUNT = t.counter("tests", t.load_ranks())


def document(text, least):
    slots = t.leaves_of(text, least)
    return t.Document(COUNT, slots, t.SumTree.of([len(x) for x in slots]), t.SumTree.of([COUNT(x) for x in slots]))


@pytest.mark.parametrize("seed", range(4))
def test_counts_after_edits_are_those_of_the_text(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice("ab cé1.\n\t'  sé \x1c\u00a0") for _ in range(rng.randint(0, 200)))
        d = document(text, 16)
        assert d.tokens.total == COUNT(text)
        for _ in range(rng.randint(0, 8)):
            p, k = rng.randint(0, len(text)), rng.choice((0, 0, rng.randint(0, 60)))
            new = "".join(rng.choice("ab c1.\n ") for _ in range(rng.randint(0, 12)))
            text = text[:p] + new + text[p + k:]
            d.edit(p, k, new)
            assert d.text == text and d.tokens.total == COUNT(text)
            assert sum(d.leaf_sums()[0]) == len(text)


def test_an_edit_encodes_little_of_a_long_text():
    text = " ".join(f"word{k}" for k in range(20_000))
    d = t.Document.build(text, COUNT)
    d.edit(60_000, 5, "other")
    assert 0 < d.encoded <= 4 * t.LEAF
    d.edit(0, 0, "x" * (100 * t.LEAF) + " y" * 50)
    assert max(map(len, d.slots)) <= 101 * t.LEAF and d.tokens.total == COUNT(d.text)


def test_sum_tree():
    tree = t.SumTree.of([3, 0, 5, 1, 0, 2])
    assert tree.total == 11 and [tree.find(p) for p in (0, 2, 3, 7, 8, 9, 10, 11)] == [(0, 0), (0, 0), (2, 3), (2, 3), (3, 8), (5, 9), (5, 9), (5, 9)]
    tree.set(1, 4)
    assert tree.total == 15 and tree.find(3) == (1, 3)


def test_edit_table(spark):
    kept = t.trees(docs(spark))
    edits = spark.createDataFrame([(9, 1, 0, 2, "X"), (9, 0, 3, 0, "yy "), (4, 0, 5, 5, "new text"), (5, 0, None, None, "a"), (None, 0, 0, 1, "z"), (999, 0, 0, 0, "q"), (7, 0, 0, 1, None)],
                                  "doc_id long, seq int, place int, taken int, new string")
    got = t.edited(docs(spark), kept, edits).collect()
    assert len(got) == len(rows())
    for r in got:
        text = next(x or "" for i, x, *_ in rows() if i == r.doc_id and (i is not None or (x or "")[:5] == r.text[:5]))
        if r.doc_id == 9:
            text = text[:3] + "yy " + text[3:]
            text = "X" + text[2:]
        text = {4: "new text", 5: "a" + text, 7: ""}.get(r.doc_id, text)
        assert r.text == text and r.n_tokens == COUNT(text) and sum(r.leaf_tokens) == r.n_tokens
    assert t.edited(empty(spark), kept, edits).count() == 0 and t.trees(empty(spark)).count() == 0


def test_query(spark):
    from fieldwire.llm.queries import op9_token_counts
    data = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op9_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(data) and sum(r.n_edits for r in got) > 0
    for r in got:
        assert r.n_tokens == COUNT(data[r.doc_id]) and r.n_tokens_after == COUNT(t._NUMBER.sub("0", data[r.doc_id]))
