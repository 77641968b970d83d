"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Test items are taken in blocks of bounded size. A first scan counts their n-grams in all documents; of those that
occur at all the rarest of each short stretch of an item are its seeds, several a stretch, so that edits of a copy
leave some whole. N-grams of short items are pairs of words, all that occur being seeds. A second scan joins
passages to items where a seed meets; a passage with several on neighbouring diagonals, or with enough words of the
item to reach the score, is aligned with the whole item, in whole batches of arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import mixed, pieces, texts, tokens, utf8, written


@dataclass(frozen=True)
class Rules:
    """``seed_words`` in an n-gram, two in items under ``short_item`` words; of each ``stretch`` of n-grams of an item the
    ``seeds`` rarest ones that occur are looked for; a passage with ``least_seeds`` is aligned without counting its
    words first; a match scores 1, another word or a gap -1; an item is found at ``least_share`` of its own score."""
    seed_words: int = 3
    short_item: int = 10
    stretch: int = 4
    seeds: int = 3
    least_seeds: int = 2
    least_share: float = 0.5
    block_bytes: int = 8_000_000


@dataclass
class Block:
    """Words of a block's items end to end, with the n-gram at each position."""
    ids: np.ndarray
    words: np.ndarray
    at: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words inside a row and the index of its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:len(h) - n + 1].copy()
    for k in range(1, n):
        g = mixed(g * np.uint64(3) + h[k:len(h) - n + 1 + k])
    inside = np.flatnonzero(row[:len(h) - n + 1] == row[n - 1:])
    return g[inside], inside


def all_grams(h: np.ndarray, row: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of both sizes, and where they start."""
    (g, s), (g2, s2) = ngrams(h, row, rules.seed_words), ngrams(h, row, 2)
    return np.concatenate((g, g2)), np.concatenate((s, s2))


def block_of(ids: list[int], items: list[str], rules: Rules) -> Block:
    """A block with all n-grams of its items, by item and place."""
    data, at = utf8(pa.array(items, pa.large_string()))
    h, row, _, _ = tokens(data, at, split_signs=True)
    first = np.searchsorted(row, np.arange(len(items) + 1))
    length = np.diff(first)
    g, start = all_grams(h, row, rules)
    pair = np.arange(len(g)) >= len(ngrams(h, row, rules.seed_words)[0])
    # pairs for short items of seed_words and more; longer n-grams for others
    short = (length < rules.short_item)[row[start]] if len(g) else pair
    fit = (pair == short) & ((length >= rules.seed_words)[row[start]] if len(g) else pair)
    g, start = g[fit], start[fit]
    order = np.lexsort((start,))
    g, start = g[order], start[order]
    return Block(np.array(ids, np.int64), h, first, g, row[start], start - first[row[start]])


def chosen(block: Block, counts: np.ndarray, rules: Rules) -> Block:
    """The block with its seeds alone; ``counts`` tells how often each of its n-grams occurs in the documents."""
    group = block.item.astype(np.int64) * (1 << 32) + block.place // rules.stretch
    there = np.flatnonzero(counts > 0)
    order = there[np.lexsort((block.place[there], counts[there], group[there]))]
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    short = np.diff(block.at)[block.item[order]] < rules.short_item
    keep = np.sort(order[(rank < rules.seeds) | short])
    return Block(block.ids, block.words, block.at, block.grams[keep], block.item[keep], block.place[keep])


def counted(rows: DataFrame, shared, n: int, column: int, rules: Rules) -> np.ndarray:
    """How often each n-gram of a block occurs in the texts: a number each goes to the driver, bounded by the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = Lookup(shared.value.grams), np.zeros(n, np.int64)
        for b in batches:
            data, at = utf8(b.column(column))
            for i, j in pieces(at):
                h, row, _, _ = tokens(data[at[i]:at[j]], at[i:j + 1] - at[i], split_signs=True)
                total += np.bincount(find.find(all_grams(h, row, rules)[0])[1], minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "c"])

    found = rows.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(n, np.int64)
    out[found["k"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    return out


class Lookup:
    """Positions of the sorted keys that equal given hashes, behind a bit table that settles most of them."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.shift = np.uint64(64 - 20)
        self.there = np.zeros(1 << 20, bool)
        self.there[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``h``, index into the keys as given) of equal values."""
        maybe = np.flatnonzero(self.there[(h >> self.shift).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, h[maybe], "left"), np.searchsorted(self.keys, h[maybe], "right")
        times = hi - lo
        hit = np.repeat(maybe, times)
        at = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return hit, self.order[at]


def align(item: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Best local alignment score of each row of ``item`` with the same row of ``passage``.

    Words are unsigned hashes; padding (0 in items, 1 in passages) meets nothing. Gaps cost 1 a word, so
    the best gap along a row is a running maximum."""
    rows, width = passage.shape
    slope = np.arange(width, dtype=np.int32)
    above, best = np.zeros((rows, width + 1), np.int32), np.zeros(rows, np.int32)
    for i in range(item.shape[1]):
        same = np.where(item[:, i:i + 1] == passage, 1, -1).astype(np.int32)
        cell = np.maximum(np.maximum(above[:, :-1] + same, above[:, 1:] - 1), 0)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        above[:, 1:] = cell
        best = np.maximum(best, cell.max(1))
    return best


def word_keys(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(words + mixed(item.astype(np.uint64)))


def enough_words(find: Lookup, h, item, low, high, least) -> np.ndarray:
    """Whether each candidate holds ``least`` words of its item, counted as often as the item has them:
    each match of an alignment needs one."""
    out = np.zeros(len(item), bool)
    size = high - low
    ends = np.cumsum(size)
    i = 0
    while i < len(item):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + (1 << 18), "right")))
        n = size[i:j]
        who = np.repeat(np.arange(j - i), n)
        at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n - low[i:j], n)
        # an item's k-th word of one kind meets a passage that has k of them or more
        hit, key = find.find(word_keys(item[i:j][who], h[at]))
        pair, times = np.unique(who[hit] * np.int64(len(find.keys) + 1) + key, return_counts=True)
        most = find.nth[pair % (len(find.keys) + 1)]
        out[i:j] = np.bincount(pair // (len(find.keys) + 1), np.minimum(times, most), j - i) >= least[i:j]
        i = j
    return out


def word_lookup(block: Block) -> Lookup:
    """The distinct words of each item, and in ``nth`` how often the item has them."""
    keys, times = np.unique(word_keys(np.repeat(np.arange(len(block.ids)), np.diff(block.at)), block.words), return_counts=True)
    find = Lookup(keys)
    find.nth = times
    return find


def passages(block: Block, find: Lookup, words: Lookup, h, row, rules: Rules):
    """Candidates of a chunk of documents: row, item, first and last word of the passage."""
    g, start = all_grams(h, row, rules)
    hit, key = find.find(g)
    if not len(hit):
        return hit, hit, hit, hit
    where, item, place = start[hit], block.item[key], block.place[key]
    length = np.diff(block.at)
    diagonal = where - place
    slack = np.maximum(8, length[item] // 4)
    order = np.lexsort((diagonal, item, row[where]))
    where, item, place, diagonal, slack = (x[order] for x in (where, item, place, diagonal, slack))
    doc = row[where]
    new = np.ones(len(where), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # distinct seeds of a group
    pair = np.unique(group.astype(np.int64) * (int(length.max(initial=0)) + 1) + place) // (int(length.max(initial=0)) + 1)
    distinct = np.bincount(pair, minlength=len(first))
    last = np.append(first[1:], len(where)) - 1
    doc, item = doc[first], item[first]
    # an item found at its least share has no more gaps than the words it may lose
    far = np.maximum(slack[first], np.floor((1 - rules.least_share) * length[item]).astype(np.int64))
    # stay inside the document
    low = np.maximum(diagonal[first] - far, np.searchsorted(row, doc, "left"))
    high = np.minimum(diagonal[last] + length[item] + far, np.searchsorted(row, doc, "right"))
    good = distinct >= rules.least_seeds
    few = np.flatnonzero(~good)
    good[few] = enough_words(words, h, item[few], low[few], high[few], rules.least_share * length[item[few]])
    return doc[good], item[good], low[good], high[good]


def scored(block: Block, h, item, low, high, cells: int = 1 << 20) -> np.ndarray:
    """Alignment score of each candidate, in slices of bounded size, shapes alike together."""
    length = np.diff(block.at)
    out = np.zeros(len(item), np.int64)
    order = np.lexsort((high - low, length[item]))
    i = 0
    while i < len(order):
        j = i
        wide = tall = 0
        while j < len(order):
            w, t = max(wide, high[order[j]] - low[order[j]]), max(tall, length[item[order[j]]])
            if j > i and (j - i + 1) * (w + t) > cells // 16:
                break
            wide, tall, j = w, t, j + 1
        some = order[i:j]
        p, q = np.ones((j - i, wide), np.uint64), np.zeros((j - i, tall), np.uint64)
        for k, c in enumerate(some):
            p[k, :high[c] - low[c]] = h[low[c]:high[c]]
            q[k, :length[item[c]]] = block.words[block.at[item[c]]:block.at[item[c] + 1]]
        out[some] = align(q, p)
        i = j
    return out


def found_in(block: Block, find: Lookup, words: Lookup, column: pa.Array, rules: Rules):
    """Items found in a batch of texts, chunk by chunk: row, item, score, first and end byte."""
    length = np.diff(block.at)
    data, at = utf8(column)
    for i, j in pieces(at):
        h, row, begin, end = tokens(data[at[i]:at[j]], at[i:j + 1] - at[i], split_signs=True)
        doc, item, low, high = passages(block, find, words, h, row, rules)
        score = scored(block, h, item, low, high)
        ok = np.flatnonzero(score >= rules.least_share * length[item])
        if len(ok):
            base = at[i:j][doc[ok]] - at[i]
            yield doc[ok] + i, item[ok], score[ok], begin[low[ok]] - base, end[high[ok] - 1] - base


def prepared(docs: DataFrame, column: int, benchmark: DataFrame, rules: Rules) -> Iterator:
    """Blocks of test items with their seeds, each different text of an id on its own, shared with the tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = written(items, "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // rules.block_bytes))
    context = docs.sparkSession.sparkContext
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = block_of([r["item_id"] or 0 for r in some], [r["text"] for r in some], rules)
        counts = counted(docs, context.broadcast(block), len(block.grams), column, rules)
        yield context.broadcast(chosen(block, counts, rules))


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document and test item found in it: ``doc_id``, ``item_id``, ``score`` and ``share`` of the
    best alignment, ``start_byte`` and ``end_byte`` of the passage searched, ``passages`` found.

    Words are compared without case, signs apart from letters. Items with a null id or fewer words than a
    seed, and null or empty texts, match nothing. Different texts of one id are items of their own, of
    which the one with the best share is reported. Repeated rows count once per document id and item.
    The driver holds one block of items at a time; documents are scanned twice per block. A copy in which edits leave
    no seed of the item whole is not aligned (README has measured shares)."""
    rows, found = texts(docs), None
    for shared in prepared(rows, rows.columns.index("text"), benchmark.filter("item_id is not null"), rules):
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            find, words = Lookup(block.grams), word_lookup(block)
            length = np.diff(block.at)
            for b in batches:
                for row, item, score, start, end in found_in(block, find, words, b.column("text"), rules):
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(row)), pa.array(block.ids[item]), pa.array(score),
                         pa.array(length[item]), pa.array(start), pa.array(end)],
                        ["doc_id", "item_id", "score", "item_words", "start_byte", "end_byte"])

        one = rows.mapInArrow(run, "doc_id long, item_id long, score long, item_words long, start_byte long, end_byte long")
        found = one if found is None else found.union(one)
    share = F.col("score") / F.col("item_words")
    return found.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("score", share.alias("share"), "start_byte", "end_byte"),
                 F.struct(share, F.col("score"), -F.col("start_byte"))).alias("best"),
        F.count("*").alias("passages")).select("doc_id", "item_id", "best.*", "passages")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs``, all columns, without the rows in whose text a test item is found; each row is judged
    where it is read, whatever its id, and items count whatever theirs."""
    place = docs.columns.index("text")
    source = docs
    for shared in prepared(source, place, benchmark, rules):
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            find, words = Lookup(block.grams), word_lookup(block)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, *_ in found_in(block, find, words, b.column(place), rules):
                    keep[row] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
