import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldwire.llm import collocations as c
from odd import docs, empty, rows

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(table, most=3, least=10, covered=50, top=2000):
    f, n = {}, Counter()
    for _, text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if 2 <= len(p) <= most and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        rows = []
        for p, a in cand.items():
            if 100 * inside[p] >= covered * a and inside[p]:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for r, (s, a, p, l, rr) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, r, p.decode(), -a, l, rr, n[lang], -s))
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r)[:8] for r in c.collocations(df, **kw).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["new", "york", "New", "élan", "of", "the", "a b", "x" * 40, "ran", "\x00z", "ç"] + [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(["new york city", "of the", "the  of\tthe", rng.choice(words), rng.choice(words)]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!?"]))
        out.append((i if i % 9 else None, "".join(parts) if i % 17 else None, rng.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("kw", [{}, {"least": 3}, {"least": 2, "covered": 90, "top": 7}, {"most": 4, "least": 3}, {"most": 2, "least": 4}])
def test_like_counting_all_phrases(spark, seed, kw):
    table = corpus(seed)
    assert got(spark.createDataFrame(table, SCHEMA).repartition(3), **kw) == brute(table, **kw)


def test_odd_rows(spark):
    table = [(i, t, lang) for i, t, lang, *_ in rows()]
    assert got(docs(spark), least=2) == brute(table, least=2)
    assert got(empty(spark)) == []


def test_small_rounds_change_nothing(monkeypatch):
    data, at = _flat(corpus(3) + [(1000, "long " * 900 + "y" * 3000 + " tail word" * 20, "en")])
    start, end, row, _ = c.words(data, at)
    whole = c.word_fingerprints(data, start, end)
    longer = c.phrase_fingerprints(whole, 3, row.astype(np.uint64))
    monkeypatch.setattr(c, "HASH_BYTES", 64)
    monkeypatch.setattr(c, "HASH_WORDS", 7)
    assert (c.word_fingerprints(data, start, end) == whole).all()
    assert (c.phrase_fingerprints(whole, 3, row.astype(np.uint64))[:-3] == longer[:-3]).all()
    assert len(set(c.exact_numbers(data, start, end, whole))) == len({bytes(data[a:b]) for a, b in zip(start, end)})


def _flat(table):
    texts = [(t or "").translate(LOWER).encode() for _, t, _ in table]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_words_of_one_fingerprint_are_told_apart_by_their_bytes(spark, monkeypatch):
    """With a fingerprint of 3 bits nearly all words and phrases collide; counts stay right."""
    data, at = _flat([(1, "aa bb aa cc bb aa dd", None)])
    start, end, row, on = c.words(data, at)
    numbers = c.exact_numbers(data, start, end, np.zeros(len(start), np.uint64))
    text = [bytes(data[a:b]) for a, b in zip(start, end)]
    assert all(text[i] == text[j] for i in range(len(text)) for j in range(len(text)) if numbers[i] == numbers[j])
    table = corpus(5, 60)
    df = spark.createDataFrame(table, SCHEMA).coalesce(1)
    frequent = c.Filter(b"\xff" * 8)
    full = {(r.lang, r.phrase): r.c for r in _texts(spark, df, frequent)}
    real = c.mixed
    monkeypatch.setattr(c, "mixed", lambda h: real(h) & np.uint64(7))
    batches = df.selectExpr("doc_id", "coalesce(lang, 'und') lang", "xxhash64(coalesce(lang, 'und')) lang_hash", "coalesce(text, '') text").toArrow().combine_chunks().to_batches()
    crushed = Counter()
    for b in _run(batches, frequent):
        for r in b.to_pylist():
            crushed[(r["lang"], r["phrase"])] += r["c"]
    assert dict(crushed) == full


def _rows(df):
    return df.selectExpr("doc_id", "coalesce(lang, 'und') lang", "xxhash64(coalesce(lang, 'und')) lang_hash", "coalesce(text, '') text")


def _texts(spark, df, frequent):
    return c.frequent_texts(_rows(df), 3, frequent).collect()


def _run(batches, frequent):
    """The task function of ``frequent_texts``, called here so that it sees the patched hash."""
    held = []

    class Rows:
        def mapInArrow(self, run, _):
            held.append(run)
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self

    c.frequent_texts(Rows(), 3, frequent)
    return held[0](iter(batches))


def test_where_a_phrase_occurs(spark):
    table = [(7, "x y. a b", "en"), (5, "q, a b", "en"), (9, "a b", "en")]
    at = {r.phrase: r["at"] for r in c.phrase_counts(spark.createDataFrame(table, SCHEMA), 2, 3).filter("words = 2").collect()}
    assert at["a b"] == 5
