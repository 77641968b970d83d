"""Suffix-array dedup: distributed merge sort of text suffixes that never compares a known prefix again.

A byte goes when a string of ``LENGTH`` bytes that starts in two places covers it. Sorting the suffix at
every byte would move each byte hundreds of times, so suffixes start at anchors: of the ``GRAM``-byte
strings inside a window of LENGTH bytes the one with the least hash is the window's anchor. Equal windows
have equal anchors at equal places, so each window is decided at its anchor, among the windows that share
the anchor's bytes. An anchor stands for a run of windows; their bytes are its context, which reaches at
most LENGTH bytes to the right and LENGTH - GRAM to the left.

1. Anchors whose bytes occur once in the corpus cannot repeat and are left out (the distinguishing-prefix
   rule of distributed string sorting). Equal contexts are folded into one with its count.
2. Each task sorts the suffixes at its anchors, front-codes them into one run per key range, and ranges
   are exchanged.
3. A range's runs are merged by a loser tree that carries common-prefix lengths: two suffixes are compared
   from the prefix they are known to share. Its output has the common prefix of neighbours, from which the
   windows that repeat follow, the bytes left of the anchors being sorted once as well.
4. Windows that repeat come back to all documents that hold their context, and their bytes are cut out.

Contexts of one anchor must meet in one task. Where over ``most_contexts`` different ones share an anchor
(a passage in very many documents, longer than GRAM), their windows are counted by hash instead, spread
over all tasks: the exact way for such groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mixed, pieces, powers, prefix_hashes, texts, tokens, utf8, written

LENGTH, GRAM = 400, 200
SPAN = LENGTH - GRAM
#: Bytes of text handled by one round of array operations, and of contexts in a range.
ROUND_BYTES, RANGE_BYTES = 256 << 10, 16 << 20
_PLACE = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, at: np.ndarray):
    """Anchors of the windows inside the rows of ``at``: row, anchor, first and last window that it decides,
    hash of its gram, hash of its context, and its first eight bytes as a number that sorts alike."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, none, none
    prefix = prefix_hashes(data)
    _, down = powers(n)
    gram = mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[:n - GRAM + 1])
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    least = sliding_least(key, SPAN + 1)[:n - LENGTH + 1]
    inside = np.ones(len(least), bool)
    for edge in at[1:-1]:  # windows across rows
        inside[max(0, edge - LENGTH + 1):edge] = False
    window = np.flatnonzero(inside)
    if not len(window):
        return none, none, none, none, none, none, none
    anchor = (least[window] & _PLACE).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = window[new]
    last = window[np.append(np.flatnonzero(new)[1:], len(window)) - 1]
    anchor = anchor[new]
    row = np.searchsorted(at, first, "right") - 1
    # the context's hash also takes in where the anchor lies in it
    context = mixed(mixed((prefix[last + LENGTH] - prefix[first]) * down[first]) + (anchor - first).astype(np.uint64))
    head = np.zeros(len(anchor), np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | data[anchor + k].astype(np.uint64)
    return row, anchor, first, last, gram[anchor].view(np.int64), context.view(np.int64), (head ^ np.uint64(1 << 63)).view(np.int64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def rounds(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Pieces to look for anchors in: first row, its row bounds from 0, byte offset in that row, bytes.

    A long row comes in pieces that overlap by one window less a byte, so each window is in one piece."""
    for i, j in pieces(at, ROUND_BYTES):
        size = at[j] - at[i]
        if j == i + 1 and size > 2 * ROUND_BYTES:
            for s in range(0, size - LENGTH + 1, ROUND_BYTES):
                part = data[at[i] + s:min(at[i] + s + ROUND_BYTES + LENGTH - 1, at[j])]
                yield i, np.array([0, len(part)]), s, part
        else:
            yield i, at[i:j + 1] - at[i], 0, data[at[i]:at[j]]


def all_anchors(rows: DataFrame) -> DataFrame:
    """Anchors of ``rows`` (``doc_id``, ``th``, ``text``) with places in bytes; ``low`` and ``high`` are how far the
    last and the first window that an anchor decides start before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, bounds, offset, part in rounds(data, at):
                row, anchor, first, last, gram, context, head = anchors(part, bounds)
                if len(row):
                    own = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(own), b.column("th").take(own), pa.array(anchor - bounds[row] + offset),
                         pa.array((anchor - last).astype(np.int16)), pa.array((anchor - first).astype(np.int16)), pa.array(gram), pa.array(context), pa.array(head)],
                        ["doc_id", "th", "place", "low", "high", "gram", "context", "head"])

    return rows.mapInArrow(run, "doc_id long, th long, place long, low short, high short, gram long, context long, head long")


# --- runs -----------------------------------------------------------------------------------------

RUN = "target int, shared binary, tails binary, tail_sizes binary, lefts binary, left_sizes binary, ids binary"
_IDS = np.dtype([("gram", "<i8"), ("context", "<i8"), ("low", "<i2"), ("high", "<i2"), ("many", "?")])


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def coded(target: int, rights: list[bytes], lefts: list[bytes], ids: np.ndarray) -> dict:
    """A run: suffixes in order, each as how much it shares with the one before, and the rest."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    shared, before, tails = [], b"", []
    for k in order:
        h = common(before, rights[k], 0)
        before = rights[k]
        shared.append(h)
        tails.append(before[h:])
    lefts = [lefts[k] for k in order]
    return {"target": target, "shared": np.array(shared, "<u2").tobytes(), "tails": b"".join(tails), "tail_sizes": np.array([len(t) for t in tails], "<u2").tobytes(),
            "lefts": b"".join(lefts), "left_sizes": np.array([len(x) for x in lefts], "<u2").tobytes(), "ids": ids[order].tobytes()}


def decoded(run: dict) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    shared = np.frombuffer(run["shared"], "<u2").tolist()
    ends, left_ends = np.cumsum(np.frombuffer(run["tail_sizes"], "<u2"), dtype=np.int64).tolist(), np.cumsum(np.frombuffer(run["left_sizes"], "<u2"), dtype=np.int64).tolist()
    rights, before, s = [], b"", 0
    for h, e in zip(shared, ends):
        before = before[:h] + run["tails"][s:e]
        rights.append(before)
        s = e
    lefts = [run["lefts"][s:e] for s, e in zip([0, *left_ends], left_ends)]
    return rights, shared, lefts, np.frombuffer(run["ids"], _IDS)


class LoserTree:
    """Merges sorted runs of byte strings, each with the prefixes its strings share with the one before.

    A loser keeps how much it shares with the winner it lost to. Whatever is on the path of the last
    output lost to it, so the candidates on a path all know what they share with the last output: the one
    that shares more is the smaller, and only where both share the same do bytes beyond that decide."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.loser = [-1] * self.size
        self.shares = [0] * len(runs)  # with the last output, for the winner; with its winner, for a loser
        self.winner = self._first(1)

    def _first(self, node: int) -> int:
        if node >= self.size:
            run = node - self.size
            return run if run < len(self.runs) and self.runs[run][0] else -1
        a, b = self._first(2 * node), self._first(2 * node + 1)
        won, self.loser[node] = self._play(a, b)
        return won

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; a run that is used up (-1) loses to all."""
        if a < 0:
            return b, a
        if b < 0:
            return a, b
        x, y = self.shares[a], self.shares[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        s, t = self.runs[a][0][self.at[a]], self.runs[b][0][self.at[b]]
        h = common(s, t, x)
        won, lost = (a, b) if s[h:h + 1] < t[h:h + 1] or s[h:h + 1] == t[h:h + 1] and a < b else (b, a)
        self.shares[lost] = h
        return won, lost

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """Run, index in it, and bytes shared with the string before, in order of all strings."""
        while (run := self.winner) >= 0:
            index = self.at[run]
            yield run, index, self.shares[run]
            self.at[run] = index + 1
            strings, shared = self.runs[run]
            now = run if index + 1 < len(strings) else -1
            if now >= 0:
                self.shares[run] = shared[index + 1]
            node = (self.size + run) // 2
            while node:
                now, self.loser[node] = self._play(now, self.loser[node])
                node //= 2
            self.winner = now


def merged(runs: list[dict]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Bytes shared with the suffix before, bytes left of the anchor and ids of a range's suffixes in order."""
    parts = [decoded(r) for r in runs]
    shared, lefts, ids = [], [], []
    for run, k, h in LoserTree([(p[0], p[1]) for p in parts]):
        shared.append(h)
        lefts.append(parts[run][2][k])
        ids.append(parts[run][3][k])
    return np.array(shared, np.int64), lefts, np.array(ids, _IDS)


def repeating(shared: np.ndarray, lefts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and the greatest distance before its anchor at which a repeated window
    starts, -1 where none does.

    At distance d two windows are equal when the suffixes share LENGTH - d bytes, so lie in one stretch of
    the order, and the d bytes left of the anchors are equal, so they lie in one stretch of the order of
    these. Suffixes that are alone at the loosest of both leave early."""
    n = len(ids)
    least, most = np.full(n, -1), np.full(n, -1)
    many = ids["many"]
    least[many], most[many] = ids["low"][many], ids["high"][many]
    if n < 2:
        return least, most
    back = [x[::-1] for x in lefts]
    order = np.array(sorted(range(n), key=back.__getitem__))
    left_shared = np.array([0] + [common(back[a], back[b], 0) for a, b in zip(order[:-1], order[1:])])
    active = np.arange(n)
    loose = np.cumsum(shared < GRAM)
    for d in range(SPAN + 1):
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(left_shared < d)
        active = active[ids["high"][active] >= d]
        _, where, times = np.unique(loose[active] * (n + 1) + rank[active], return_inverse=True, return_counts=True)
        active = active[times[where] > 1]
        if not len(active):
            break
        now = active[ids["low"][active] <= d]
        block = np.cumsum(shared < LENGTH - d)
        _, where, times = np.unique(block[now] * (n + 1) + rank[now], return_inverse=True, return_counts=True)
        hit = now[(times[where] > 1) & ~many[now]]
        least[hit] = np.where(least[hit] < 0, d, least[hit])
        most[hit] = d
    return least, most


# --- the whole ------------------------------------------------------------------------------------

def decided(docs: DataFrame, contexts: DataFrame, ranges: int, splitters: list[int]) -> DataFrame:
    """``gram``, ``context``, ``least``, ``most``: where repeated windows start in each context that has any."""
    places = contexts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("place", "low", "high", "gram", "context", "many", "head")).alias("places"))
    cuts = np.array(splitters, np.int64)

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        schema = pa.schema([("target", pa.int32()), *[(c, pa.binary()) for c in ("shared", "tails", "tail_sizes", "lefts", "left_sizes", "ids")]])

        def flush():
            rows = [coded(t, [x[0] for x in v], [x[1] for x in v], np.array([x[2] for x in v], _IDS)) for t, v in sorted(held.items())]
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            for text, found in zip(b.column("text"), b.column("places")):
                raw = text.as_buffer().to_pybytes()
                for p in found.as_py():
                    a = p["place"]
                    right, left = raw[a:a - p["low"] + LENGTH], raw[a - p["high"]:a]
                    t = int(np.searchsorted(cuts, p["head"], "right"))
                    held.setdefault(t, []).append((right, left, (p["gram"], p["context"], p["low"], p["high"], p["many"])))
                    size += len(right) + len(left)
                if size > 2 * RANGE_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                runs.setdefault(r["target"], []).append(r)
        for t in sorted(runs):
            shared, lefts, ids = merged(runs.pop(t))
            least, most = repeating(shared, lefts, ids)
            some = np.flatnonzero(least >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids["gram"][some]), pa.array(ids["context"][some]), pa.array(least[some].astype(np.int16)), pa.array(most[some].astype(np.int16))],
                                             ["gram", "context", "least", "most"])

    runs = docs.join(places, ["doc_id", "th"]).select("text", "places").mapInArrow(sorted_runs, RUN)
    return runs.repartitionByRange(ranges, "target").mapInArrow(merge, "gram long, context long, least short, most short")


def counted_windows(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The same for contexts too many for one task: their windows are counted by a 128-bit hash."""
    places = contexts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("place", "low", "high", "gram", "context")).alias("places"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, found in zip(b.column("text"), b.column("places")):
                raw = text.as_buffer().to_pybytes()
                rows = [(p["gram"], p["context"], d, hashlib.blake2b(raw[p["place"] - d:p["place"] - d + LENGTH], digest_size=16).digest())
                        for p in found.as_py() for d in range(p["low"], p["high"] + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int16(), pa.binary()))], ["gram", "context", "d", "window"])

    rows = written(docs.join(places, ["doc_id", "th"]).mapInArrow(windows, "gram long, context long, d short, window binary"), "windows")
    twice = written(rows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "repeated-windows")
    return rows.join(twice, "window").groupBy("gram", "context").agg(F.min("d").alias("least"), F.max("d").alias("most"))


def repeated_spans(rows: DataFrame, most_contexts: int = 20_000) -> DataFrame:
    """``doc_id``, ``th``, ``start``, ``end``: stretches of bytes covered by repeated windows, in any order."""
    found = written(all_anchors(rows), "anchors")
    # written, so that both sides of the join are bare shuffles and a passage found everywhere is split
    again = written(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated-grams")
    kept = written(found.join(again, "gram"), "repeated-anchors")
    folded = kept.groupBy("gram", "context").agg(
        F.min(F.struct("doc_id", "th", "place", "low", "high", "head")).alias("one"), (F.count("*") > 1).alias("many"))
    folded = written(folded.select("gram", "context", "one.*", "many"), "contexts")
    size = folded.groupBy("gram").agg(F.count("*").alias("n"))
    heavy = written(size.filter(F.col("n") > most_contexts).select("gram"), "heavy-grams")
    # a heavy gram has over most_contexts contexts, so these are few beside the contexts
    crowded = not heavy.isEmpty()
    light = folded.join(heavy, "gram", "left_anti") if crowded else folded
    ranges = max(1, -(-light.count() * (LENGTH + SPAN // 2) // RANGE_BYTES))
    cuts = light.agg(F.percentile_approx("head", [k / ranges for k in range(1, ranges)], 10_000).alias("c")).first()["c"] if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    fate = decided(rows, light, len(cuts) + 1, cuts)
    if crowded:
        many = folded.filter("many").join(heavy, "gram", "left_semi").select("gram", "context", F.col("low").alias("least"), F.col("high").alias("most"))
        counted = counted_windows(rows, folded.join(heavy, "gram", "left_semi"))
        both = counted.unionByName(many).groupBy("gram", "context").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        fate = fate.unionByName(both)
    fate = written(fate, "repeated-contexts")
    return kept.join(fate, ["gram", "context"]).select(
        "doc_id", "th", (F.col("place") - F.col("most")).alias("start"), (F.col("place") - F.col("least") + LENGTH).alias("end"))


def without_repeats(docs: DataFrame, most_contexts: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``kept`` (the bytes left, as binary), ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``spans`` (their starts and ends in bytes) and ``n_passages`` (``shared_passages``, 0 where
    there are none: it tells documents whose passages of over 50 words repeat, be they shorter than LENGTH bytes).

    Texts are UTF-8 bytes, a null one is empty; texts under LENGTH bytes stay whole. Repeated rows repeat each
    other's strings, whatever their ids. All is judged on the input, both places of a repeat lose it."""
    # a null id joins as the number 0 with a text hash of its own kind
    void = F.col("doc_id").isNull()
    keyed = texts(docs).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text", void).alias("th"), "text", void.alias("void"))
    rows = keyed.drop("void")
    spans = repeated_spans(rows, most_contexts).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, found, passages in zip(b.column("doc_id"), b.column("text"), b.column("spans"), b.column("n_passages")):
                raw, joined = text.as_buffer().to_pybytes(), []
                for s in sorted((s["start"], s["end"]) for s in found.as_py() or ()):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append([*s])
                ends = [0, *(x for s in joined for x in s), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(ends[::2], ends[1::2]))
                out.append({"doc_id": i.as_py(), "kept": kept, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(joined), "spans": joined, "n_passages": passages.as_py() or 0})
            yield pa.RecordBatch.from_pylist(out, KEPT)

    # both are few beside the texts, which are moved once
    about = spans.join(shared_passages(rows), ["doc_id", "th"], "full")
    return keyed.join(about, ["doc_id", "th"], "left").select(F.when(~F.col("void"), F.col("doc_id")).alias("doc_id"), "text", "spans", "n_passages").mapInArrow(
        run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, n_passages long")


def shared_passages(rows: DataFrame, words: int = 51, gram: int = 40) -> DataFrame:
    """``doc_id``, ``th``, ``n_passages``: of documents that share a run of ``gram`` words with another one, how many such
    runs were looked at. Any run of ``words`` words that two documents share is seen.

    Of the ``gram``-word runs inside each ``words``-word window the one with the least hash is looked at, so equal windows
    look at the same one. Words are parted by white space, A-Z count as a-z, runs are compared by 64-bit fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in pieces(at, ROUND_BYTES):
                word, row, _, _ = tokens(data[at[i]:at[j]], at[i:j + 1] - at[i], split_signs=False)
                n = len(word)
                if n < words:
                    continue
                up, down = powers(n)
                prefix = np.zeros(n + 1, np.uint64)
                np.cumsum(word * up[:n], out=prefix[1:])
                fp = mixed((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1])
                least = sliding_least((fp & ~_PLACE) | np.arange(len(fp), dtype=np.uint64), words - gram + 1)[:n - words + 1]
                seen = np.unique(least[row[:n - words + 1] == row[words - 1:]] & _PLACE).astype(np.int64)
                own = pa.array(row[seen] + i)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("th").take(own), pa.array(fp[seen].view(np.int64))], ["doc_id", "th", "fp"])

    seen = written(rows.mapInArrow(run, "doc_id long, th long, fp long"), "passages")
    shared = seen.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("th").alias("c"), F.max("th").alias("d"))
    shared = written(shared.filter("a <> b or c <> d").select("fp"), "shared-passages")
    found = written(seen.join(shared, "fp").select("doc_id", "th"), "passages-found")
    return found.groupBy("doc_id", "th").agg(F.count("*").alias("n_passages"))


KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("n_passages", pa.int64())])
