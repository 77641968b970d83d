import hashlib
import random

import numpy as np
import pytest

from fieldwire.llm import suffix_array as s
from odd import docs, empty, rows


def brute(texts):
    """Per text: bytes removed, runs, hash of the rest, by a dictionary of all windows."""
    where = {}
    for t in texts:
        for p in range(len(t) - s.LENGTH + 1):
            w = t[p:p + s.LENGTH]
            where[w] = where.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - s.LENGTH + 1):
            if where[t[p:p + s.LENGTH]] > 1:
                gone[p] += 1
                gone[min(len(t), p + s.LENGTH)] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((len(t), int(cut.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cut])).hexdigest()))
    return out


def made(rng, n):
    """Texts of shared and own stretches around the limit of 400 bytes, periodic ones, and copies."""
    def own(k):
        return "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared = [own(rng.choice((150, 250, 380, 399, 400, 401, 450, 700, 1500))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else own(rng.randint(0, 500)) for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts))
    return [*texts, texts[0], "ab " * 400, "a" * 1000, "", "x" * 399, "x" * 400]


@pytest.mark.parametrize("seed,most", [(0, 20_000), (1, 20_000), (2, 1)])
def test_against_all_windows(spark, seed, most):
    texts = made(random.Random(seed), 40)
    got = s.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most).collect()
    want = brute([t.encode() for t in texts])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == dict(enumerate(want))


def test_odd_rows(spark):
    got = s.without_repeats(docs(spark)).collect()
    want = brute([(t or "").encode()[:5000] for _, t, *_ in rows()])
    assert len(got) == len(rows()) and len(want) == len(got)
    for r in got:
        text = next((t or "").encode() for i, t, *_ in rows() if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        assert r.n_removed == (len(text) if r.doc_id in (5, 6) else 0) and len(r.kept) == r.n_bytes - r.n_removed
    assert s.without_repeats(empty(spark)).count() == 0


def test_query_against_all_windows(spark):
    from fieldwire.llm.queries import op6_suffix_array
    data = sorted((r.doc_id, r.text.encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want = dict(zip((i for i, _ in data), brute([t for _, t in data])))
    got = op6_suffix_array(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("seed", range(5))
def test_loser_tree_merges_and_knows_prefixes(seed):
    rng = random.Random(seed)
    runs = []
    for _ in range(rng.choice((1, 2, 3, 5, 8, 13))):
        run = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30)))
        runs.append((run, [s.common(a, b, 0) for a, b in zip([b"", *run], run)]))
    out = list(s.LoserTree(runs))
    strings = [runs[r][0][k] for r, k, _ in out]
    assert strings == sorted(x for run, _ in runs for x in run)
    assert [h for *_, h in out] == [s.common(a, b, 0) for a, b in zip([b"", *strings], strings)]


def test_known_prefixes_are_not_compared(monkeypatch):
    base = b"p" * 300
    runs = [([base + bytes([65 + k, 65 + j]) for j in range(20)], [0] + [301] * 19) for k in range(4)]
    seen = []
    real = s.common
    monkeypatch.setattr(s, "common", lambda a, b, known: seen.append(known) or real(a, b, known))
    assert len(list(s.LoserTree(runs))) == 80
    assert sum(k < 300 for k in seen) <= 3  # only to start the tree


def test_runs_round_trip():
    rng = random.Random(2)
    rights, lefts = ([bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(50)] for _ in range(2))
    ids = np.array([(k, -k, 0, 9, k % 2) for k in range(50)], s._IDS)
    run = s.coded(3, rights, lefts, ids)
    a, shared, b, c = s.decoded(run)
    order = sorted(range(50), key=rights.__getitem__)
    assert a == sorted(rights) and [x.tolist() for x in c] == [ids[k].tolist() for k in order] and b == [lefts[k] for k in order]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 4, 900).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(0, 4, k).astype(np.uint8), shared, rng.integers(0, 4, 300).astype(np.uint8)]) for k in (77, 512))
    def by_window(x, start):
        _, anchor, first, last, *_ = s.anchors(x, np.array([0, len(x)]))
        return {p - start: q - start for q, f, t in zip(anchor, first, last) for p in range(f, t + 1) if start <= p <= start + 500}
    assert by_window(a, 77) == by_window(b, 512) and len(by_window(a, 77)) == 501


def test_long_row_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    whole = {(int(x) + o, int(f) + o, int(t) + o) for _, at, o, part in s.rounds(data, np.array([0, 9000])) for x, f, t in zip(*s.anchors(part, at)[1:4])}
    monkeypatch.setattr(s, "ROUND_BYTES", 1000)
    parts = {(int(x) + o, p + o) for _, at, o, part in s.rounds(data, np.array([0, 9000])) for x, f, t in zip(*s.anchors(part, at)[1:4]) for p in range(f, t + 1)}
    assert parts == {(x, p) for x, f, t in whole for p in range(f, t + 1)}


def test_shared_passages_of_words(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    long, short, upper = fresh(51), fresh(39), fresh(60)
    table = [(1, fresh(80) + " " + long + " " + fresh(9)), (2, long + "\n" + fresh(70)), (3, fresh(60) + " " + short + " " + fresh(60)),
             (4, short + " " + fresh(80)), (5, upper), (6, upper.upper()), (7, fresh(200)), (8, fresh(10)), (9, None), (9, None), (10, "")]
    once = fresh(55)
    table += [(11, once + " " + once)]  # twice in one document only
    got = {r.doc_id: r.n_passages for r in s.without_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    assert {i for i, n in got.items() if n} == {1, 2, 5, 6} and len(got) == 11
