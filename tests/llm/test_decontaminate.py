import random

import numpy as np
import pytest

from fieldwire.llm import decontaminate as d
from odd import LONG, docs, empty, rows


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, above[j] + (1 if x == y else -1), above[j + 1] - 1, now[j] - 1))
        above, best = now, max(best, *now)
    return best


def test_alignment_against_the_plain_one():
    rng = random.Random(0)
    pairs = [([rng.randint(2, 6) for _ in range(rng.randint(1, 12))], [rng.randint(2, 6) for _ in range(rng.randint(1, 20))]) for _ in range(200)]
    q, p = np.zeros((200, 12), np.uint64), np.ones((200, 20), np.uint64)
    for k, (a, b) in enumerate(pairs):
        q[k, :len(a)], p[k, :len(b)] = a, b
    assert d.align(q, p).tolist() == [smith_waterman(a, b) for a, b in pairs]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(12, 60)) for _ in range(20)]
    documents, truth = [], set()
    for k in range(120):
        words = text(rng.randint(30, 400))
        if k % 3 == 0:
            i = rng.randrange(20)
            copy = list(items[i])
            for j in rng.sample(range(len(copy)), len(copy) // 10):  # a tenth of the words edited
                copy[j] = rng.choice(vocabulary) if rng.random() < 0.7 else copy[j] + " " + rng.choice(vocabulary)
            at = rng.randrange(len(words))
            words[at:at] = copy
            truth.add((k, i))
        documents.append((k, " ".join(words).capitalize()))
    return documents, [(i, " ".join(x) + ".") for i, x in enumerate(items)], truth


def test_edited_copies_are_found_and_others_are_not(spark, planted):
    documents, items, truth = planted
    docs_, bench = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(docs_, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    text = dict(documents)
    assert all(0 <= r.start_byte < r.end_byte <= len(text[r.doc_id].encode()) and r.share <= 1 for r in got)
    assert {r.doc_id for r in d.decontaminate(docs_, bench).collect()} == {k for k, _ in documents} - {k for k, _ in truth}
    blocks = d.contaminated(docs_, bench, d.Rules(block_bytes=500)).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == truth


def test_an_item_in_every_document_still_has_seeds(spark):
    item = "one rather long test item about seven old wizards and a potion that nobody would drink twice"
    many = spark.createDataFrame([(k, f"start {k} {item} end {k}") for k in range(200)], "doc_id long, text string")
    assert d.contaminated(many, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 200


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, rows()[0][1]), (1, rows()[0][1]), (None, "x"), (2, None), (3, ""), (4, "one"), (5, LONG[1000:2000])], "item_id long, text string")
    got = d.contaminated(docs(spark), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (10, 1), (None, 1), (5, 5), (6, 5)}
    left = d.decontaminate(docs(spark), bench)
    assert left.columns == docs(spark).columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "7", "8", "9", "None"]
    assert d.contaminated(empty(spark), bench).count() == 0 and d.contaminated(docs(spark), bench.limit(0)).count() == 0
    assert d.decontaminate(docs(spark), bench.limit(0)).count() == len(rows())


def test_query_finds_every_verbatim_item(spark):
    from fieldwire.llm.queries import op10_decontamination
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op10_decontamination(spark, folder).collect()}
    assert {(k, i) for k, t in texts.items() for i, x in items.items() if x in t} <= got


def test_a_single_edited_copy_is_found_as_brute_force_finds_it(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items, documents = [], []
    for k in range(150):
        item = text(rng.randint(14, 20))
        copy = list(item)
        for j in sorted(rng.sample(range(len(copy)), round(len(copy) * rng.uniform(0.1, 0.2))), reverse=True):
            copy[j:j + rng.choice([0, 1, 1])] = text(rng.choice([0, 1, 1]))
        items.append(item)
        documents.append(text(30) + copy + text(30))
        if k % 2:  # an exact copy elsewhere does not hide the edited one
            documents.append(item)
    truth = {(k, i) for k, w in enumerate(documents) for i, x in enumerate(items) if len(set(x) & set(w)) > 5
             and smith_waterman(x, w) >= 0.5 * len(x)}
    got = d.contaminated(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(documents)], "doc_id long, text string"),
                         spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    assert len(truth) >= 225 and {(r.doc_id, r.item_id) for r in got} == truth


def test_every_text_of_an_item_id_is_searched(spark):
    rng = random.Random(12)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for n in (20, 30, 25))
    bench = spark.createDataFrame([(1, a), (1, b), (None, c)], "item_id long, text string")
    corpus = spark.createDataFrame([(10, f"so {a} on"), (11, f"so {b} on"), (12, f"so {c} on"), (13, f"{a} and {b}"), (14, "clean")],
                                   "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.share, r.passages) for r in d.contaminated(corpus, bench).collect()}
    assert got == {(10, 1): (20, 1.0, 1), (11, 1): (30, 1.0, 1), (13, 1): (30, 1.0, 2)}
    assert [r.doc_id for r in d.decontaminate(corpus, bench).collect()] == [14]
