"""Collocation mining by Rabin-Karp fingerprints of word n-grams.

Prefix polynomials over bytes give each word's fingerprint, prefix polynomials over these each n-gram's. Only
fingerprints with counts are shuffled while it is open which phrases are frequent: first of words and pairs,
then of longer phrases whose two shorter parts are frequent. A last pass over the texts compares the words
behind equal fingerprints byte by byte, and sends the text of frequent phrases, with their counts and where one
occurs, to be added up by text: a phrase is counted by what it says, whatever shares its fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import _LOWER, mixed, pieces, powers, prefix_hashes, utf8, written

#: Text bytes taken at a time, bytes and words in one round of hashing, and counts that a task adds up before it sends them.
TASK_BYTES, HASH_BYTES, HASH_WORDS, MOST_COUNTS = 2 << 20, 1 << 20, 1 << 18, 1 << 21
#: A filter of frequent fingerprints has 16 bits for each up to this size in bits (32 MB); beyond, it lets more through.
MOST_BITS, CHUNK_BITS = 1 << 28, 1 << 19

_KIND = np.zeros(256, np.int8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


# --- words and fingerprints of a piece ------------------------------------------------------------

def words(data: np.ndarray, at: np.ndarray):
    """Start, end and row of each word, and whether the next word goes on in the same piece of the row."""
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(at, start, "right") - 1
    cuts = np.cumsum(kind == 2, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    on = np.zeros(len(start), bool)
    on[:-1] = (row[1:] == row[:-1]) & (cuts[start[1:]] == cuts[end[:-1] - 1])
    return start, end, row, on


def word_fingerprints(lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word's bytes, in rounds of bounded size; a word may be of any length."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_BYTES, "right")))
        s = start[i]
        if end[j - 1] - s <= HASH_BYTES:
            prefix = prefix_hashes(lower[s:end[j - 1]])
            _, down = powers(HASH_BYTES)
            out[i:j] = (prefix[end[i:j] - s] - prefix[start[i:j] - s]) * down[start[i:j] - s]
        else:  # one very long word: its parts' hashes, each raised by what precedes it
            up, _ = powers(HASH_BYTES)
            total, power = 0, 1
            for p in range(s, end[i], HASH_BYTES):
                part = lower[p:min(p + HASH_BYTES, end[i])]
                total = (total + int(prefix_hashes(part)[-1]) * power) % (1 << 64)
                power = power * int(up[HASH_BYTES - 1]) * int(up[1]) % (1 << 64)
            out[i] = total
        i = j
    return mixed(out + (end - start).astype(np.uint64) * _LENGTH)


def phrase_fingerprints(word: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
    """Of the ``n`` words from each place on (those near the end are short and of no use), told apart by language."""
    out = np.zeros(len(word), np.uint64)
    _, down = powers(HASH_WORDS + n)
    up, _ = powers(HASH_WORDS + n)
    for s in range(0, len(word), HASH_WORDS):
        part = word[s:s + HASH_WORDS + n - 1]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=prefix[1:])
        m = min(HASH_WORDS, len(part))
        end = np.minimum(np.arange(m) + n, len(part))
        out[s:s + m] = (prefix[end] - prefix[:m]) * down[:m]
    return mixed(out ^ lang + np.full(1, n, np.uint64) * _LENGTH)


def whole(on: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` words from each place on lie in one piece."""
    ok = np.ones(len(on), bool)
    for k in range(n - 1):
        ok[:len(on) - k] &= on[k:]
        ok[len(on) - k:] = False
    return ok


class Filter:
    """A set of fingerprints that also says yes to some others."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = np.uint64(len(bits) * 8 - 1)

    def has(self, fp: np.ndarray) -> np.ndarray:
        place = (fp & self.mask).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def filter_of(frequent: DataFrame) -> Filter:
    """Of the column ``fp`` of a written table. The driver gets at most MOST_BITS bits."""
    size = CHUNK_BITS
    rows = frequent.count()
    while size < 16 * rows and size < MOST_BITS:
        size *= 2
    place = F.col("fp").bitwiseAND(F.lit(size - 1))
    places = frequent.select(place.alias("place")).distinct()
    chunk = (F.col("place") / CHUNK_BITS).cast("int")

    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK_BITS, np.uint8)
        bits[table.column("place").to_numpy() % CHUNK_BITS] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    got = places.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(packed, "chunk int, bits binary").collect()
    held = {r["chunk"]: bytes(r["bits"]) for r in got}
    return Filter(b"".join(held.get(c, bytes(CHUNK_BITS // 8)) for c in range(size // CHUNK_BITS)))


# --- passes over the texts ------------------------------------------------------------------------

def rounds(batches: Iterator[pa.RecordBatch]):
    """Whole rows of about TASK_BYTES: row ids, languages, hashes of these, lower-cased bytes and row bounds."""
    held, size = [], 0
    for b in batches:
        text = b.column("text")
        if not b.num_rows:
            continue
        _, at = utf8(text)
        for i, j in pieces(at, TASK_BYTES):
            held.append(b.slice(i, j - i))
            size += int(at[j] - at[i])
            if size >= TASK_BYTES:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]):
    t = pa.Table.from_batches(held)
    parts = [utf8(c) for c in t.column("text").chunks]
    data = np.concatenate([p[0] for p in parts])
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    at = np.concatenate([np.zeros(1, np.int64), *(p[1][1:] + s for p, s in zip(parts, base))])
    return t.column("doc_id").combine_chunks(), t.column("lang").combine_chunks(), t.column("lang_hash").to_numpy().view(np.uint64), _LOWER[data], at


def fingerprint_counts(rows: DataFrame, sizes: tuple[int, ...], within: Filter | None = None) -> DataFrame:
    """``fp``, ``c``: how often each n-gram of the given sizes occurs. ``within``: only those whose two parts one word
    shorter pass the filter."""
    def sums(held: list) -> Iterator[pa.RecordBatch]:
        fp, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(fp)
        fp, c = fp[order], c[order]
        first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
        fp, c = fp[first].view(np.int64), np.add.reduceat(c, first)
        for s in range(0, len(fp), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(fp[s:s + (1 << 16)]), pa.array(c[s:s + (1 << 16)])], ["fp", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, salt, lower, at in rounds(batches):
            start, end, row, on = words(lower, at)
            if not len(start):
                continue
            word = word_fingerprints(lower, start, end)
            lang = salt[row]
            for n in sizes:
                ok = whole(on, n)
                if within is not None:
                    part = within.has(phrase_fingerprints(word, n - 1, lang))
                    ok &= part
                    ok[:-1] &= part[1:]
                held.append(np.unique(phrase_fingerprints(word, n, lang)[ok], return_counts=True))
                size += len(held[-1][0])
            if size > MOST_COUNTS:
                yield from sums(held)
                held, size = [], 0
        if size:
            yield from sums(held)

    found = rows.mapInArrow(run, "fp long, c long")
    return found.groupBy("fp").agg(F.sum("c").alias("c"))


def exact_numbers(lower: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A number for each word: words of one number have the same bytes. Words of one fingerprint are compared byte
    by byte with the one before; where a collision tears them apart, one word may get several numbers."""
    order = np.argsort(word, kind="stable")
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    size = end - start
    same = (word[a] == word[b]) & (size[a] == size[b])
    for s in range(0, len(a), HASH_WORDS):
        k = np.flatnonzero(same[s:s + HASH_WORDS]) + s
        i = 0
        while i < len(k):  # bounded bytes a round
            total = np.cumsum(size[a[k[i:]]])
            j = i + max(1, int(np.searchsorted(total, 4 * HASH_BYTES, "right")))
            part = k[i:j]
            n = size[a[part]]
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = lower[np.repeat(start[a[part]], n) + off] != lower[np.repeat(start[b[part]], n) + off]
            bad = np.add.reduceat(differ, np.cumsum(n) - n) > 0 if len(n) else np.zeros(0, bool)
            same[part[bad]] = False
            i = j
    new[1:] = ~same
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


_FOUND = pa.schema([("fp", pa.int64()), ("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("c", pa.int64()), ("at", pa.int64())])


def frequent_texts(rows: DataFrame, most: int, frequent: Filter) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``c`` and ``at`` (the least id of a document that it occurs in) of the n-grams up to ``most`` words that pass the filter. Rows of 0 words count the words of a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, langs, salt, lower, at in rounds(batches):
            start, end, row, on = words(lower, at)
            if not len(start):
                continue
            word = word_fingerprints(lower, start, end)
            lang, same = salt[row], exact_numbers(lower, start, end, word)
            raw = lower.tobytes()
            for n in range(1, most + 1):
                fp = phrase_fingerprints(word, n, lang)
                k = np.flatnonzero(whole(on, n) & frequent.has(fp))
                k = k[np.argsort(fp[k], kind="stable")]
                if not len(k):
                    continue
                new = np.ones(len(k), bool)
                new[1:] = (fp[k][1:] != fp[k][:-1]) | (row[k][1:] != row[k][:-1]) & (lang[k][1:] != lang[k][:-1])
                for w in range(n):
                    new[1:] |= same[k[1:] + w] != same[k[:-1] + w]
                one, c = k[new], np.diff(np.append(np.flatnonzero(new), len(k)))
                for s in range(0, len(one), 1 << 14):
                    i = one[s:s + (1 << 14)]
                    spans = [list(zip(start[i + w].tolist(), end[i + w].tolist())) for w in range(n)]
                    text = [b" ".join([raw[a:b] for a, b in p]).decode() for p in zip(*spans)]
                    own = pa.array(row[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[i].view(np.int64)), langs.take(own), pa.array(np.full(len(i), n, np.int32)), pa.array(text), pa.array(c[s:s + (1 << 14)]),
                         ids.take(own)], schema=_FOUND)
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            counts = np.diff(np.append(heads, len(row)))
            total = pa.table({"lang": langs.take(pa.array(row[heads])), "c": counts}).group_by("lang").aggregate([("c", "sum")])
            m = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * m, pa.int64()), total.column("lang").combine_chunks(), pa.array([0] * m, pa.int32()), pa.array([""] * m), total.column("c_sum").combine_chunks(),
                 pa.nulls(m, pa.int64())], schema=_FOUND)

    found = rows.mapInArrow(run, "fp long, lang string, words int, phrase string, c long, at long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("c").alias("c"), F.min("at").alias("at"))


def phrase_counts(docs: DataFrame, most: int = 3, least: int = 10) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``c``, ``at`` of all phrases of up to ``most`` (at least 2) words that occur ``least``
    times; rows of 0 words hold the number of words of a language.

    A-Z count as a-z. Texts are cut at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words. Null
    texts are empty, a null language is ``und``, null ids stay null. Repeated rows count each; an empty table gives no
    rows."""
    lang = F.coalesce(docs["lang"], F.lit("und"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    often = lambda df, name: written(df.filter(F.col("c") >= least).select("fp"), name)
    known = often(fingerprint_counts(rows, (1, 2)), "frequent-pairs")
    for n in range(3, most + 1):
        known = written(known.union(often(fingerprint_counts(rows, (n,), filter_of(known)), "frequent-longer")), "frequent-all")
    texts = frequent_texts(rows, most, filter_of(known))
    return written(texts.filter((F.col("words") == 0) | (F.col("c") >= least)), "phrases")


# --- scores ---------------------------------------------------------------------------------------

def collocations(docs: DataFrame, most: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and text: ``lang``, ``rank``, ``phrase``, ``a`` (its
    count), ``l`` and ``r`` (those of its parts), ``n`` (words of the language), ``score``, and ``at``.

    A phrase of 2 to ``most`` words that occurs ``least`` times scores floor(1000000 a a / (l r)) at the cut of its words at
    which that is least, at ties the first one. A phrase goes that lies in a longer one of at least ``covered`` percent
    of its count. Whole numbers throughout."""
    counts = phrase_counts(docs, most, least)
    phrases = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("c").alias("a"), "at", F.split("phrase", " ").alias("w"))
    part = lambda s, n: F.array_join(F.slice("w", s, n), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", "w", "words", cut)
    cuts = written(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")), "phrase-cuts")
    of = counts.filter(F.col("words") > 0)
    lefts = of.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l"))
    rights = of.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r"))
    # each join stands on bare shuffles, so that a word that begins very many phrases is split
    cuts = written(cuts.join(lefts, ["lang", "left"]).select("lang", "phrase", "a", "k", "l", "right"), "phrase-lefts")
    cuts = written(cuts.join(rights, ["lang", "right"]).select("lang", "phrase", "a", "k", "l", "r"), "phrase-rights")
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("best"))
    # the longest phrases that hold a shorter one: parts of 2 words and more
    lengths = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m")
    inner = phrases.filter("words > 2").select("lang", "a", "w", "words", lengths)
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s"))
    inner = inner.groupBy("lang", part(F.col("s"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.expr("longer is null or 100 * cast(longer as decimal(19,0)) < cast(%d * best.a as decimal(25,0))" % covered))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("deal"))
    # first of 64 parts of a language, so that the last ranking sees few rows
    some = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.drop("deal").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    size = counts.filter("words = 0").select("lang", F.col("c").alias("n"))
    where = counts.filter("words >= 2").select("lang", "phrase", "at")
    return best.join(size, "lang").join(where, ["lang", "phrase"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "at")
