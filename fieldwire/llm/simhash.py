"""SimHash near-dedup: fingerprints linked by a generalised pigeonhole search.

Bits are put into parts that hold correlated bits, each part gets a threshold of its own, and two
fingerprints within ``radius`` must agree to within the threshold in at least one part as long as
the thresholds plus one sum to ``radius`` plus one. Dynamic programming picks the thresholds with
the least estimated work. The search probes each part's index with the values within its threshold
and verifies the whole fingerprint inside the join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_counted, texts, without, written
from .graph import components

BITS = 64
SEED = 42


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Bit b is set when over half of the hashes of the text's shingles have it; no word gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    last = ends[min(shingle, len(words)) - 1:][:n]
    one = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):
        h = np.array([one(joined[s:e], SEED) for s, e in zip(starts[k:k + 65536].tolist(), last[k:k + 65536].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS)
        for i in range(0, len(bits), 255):  # a byte holds the sum of 255 rows
            counts += np.add.reduce(bits[i:i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (64 bits in a long), ``text_hash`` of every row; null text is empty, no words give 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            fp = np.fromiter((fingerprint_of(t.as_buffer().to_pybytes(), shingle) for t in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), b.column("text_hash")],
                                             ["doc_id", "fp", "text_hash"])
    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


@dataclass(frozen=True)
class Part:
    """Bits of one part as a mask, and how many of them may differ; -1 means the part is not probed."""
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """What a part's value is probed with: the value itself and all within the threshold of it."""
        return [sum(1 << b for b in chosen) for t in range(self.threshold + 1) for chosen in combinations(self.bits, t)]


def grouped_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in ``parts`` groups of like size: each group starts from the bit least explained so far
    and takes the bits that correlate most with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(0)
    scale = np.sqrt((bits ** 2).sum(0))
    scale[scale == 0] = 1
    tie = np.abs((bits / scale).T @ (bits / scale))
    free, groups = list(range(BITS)), []
    for g in range(parts):
        size = (BITS * (g + 1)) // parts - (BITS * g) // parts
        first = max(free, key=lambda b: (tie[b, free].sum(), -b))
        group = [first]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: (tie[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        groups.append(tuple(sorted(group)))
    return groups


def allocate(sample: np.ndarray, radius: int, rows: int, most_parts: int = 4, pair_cost: float = 0.02) -> tuple[list[Part], float]:
    """Parts and thresholds of the least estimated cost for an index of ``rows`` fingerprints.

    Cost of a part at threshold t: rows times the probes, which are shuffled and sorted, plus ``pair_cost``
    times the candidate pairs, which only meet a condition inside the join. Their number is estimated from
    the share of sampled pairs that agree to within t there, at least the share that even bits would give.
    Pairs that differ in under a quarter of all bits are left out of it: they are copies of each other,
    candidates under any plan, and grow with their groups, not with the corpus squared. The dynamic program spends radius + 1 units of threshold + 1 on the parts."""
    values = np.unique(sample)
    best: tuple[list[Part], float] = ([Part(tuple(range(BITS)), radius)], float("inf"))
    for m in range(1, most_parts + 1):
        if m > radius + 1:
            break
        groups = grouped_bits(values, m) if len(values) > 1 else [tuple(range(BITS * g // m, BITS * (g + 1) // m)) for g in range(m)]
        cost = np.zeros((m, radius + 2))
        for i, group in enumerate(groups):
            mask = np.uint64(sum(1 << b for b in group))
            part = values & mask
            far = np.zeros(radius + 1)
            for v in values:  # one sampled row against all: a bounded block
                apart = np.bitwise_count(part ^ (v & mask))[np.bitwise_count(values ^ v) >= BITS // 4]
                far += np.bincount(np.minimum(apart, radius + 1), minlength=radius + 2)[:radius + 1]
            near = np.cumsum(far)
            pairs = max(1, len(part) * (len(part) - 1))
            for t in range(radius + 1):
                probes = sum(comb(len(group), j) for j in range(t + 1))
                share = max(near[t] / pairs, probes / 2.0 ** len(group))
                cost[i, t + 1] = rows * probes + pair_cost * share * rows * rows / 2
        spend = radius + 1
        table = np.full((m + 1, spend + 1), np.inf)
        pick = np.zeros((m + 1, spend + 1), int)
        table[0, 0] = 0
        for i in range(m):
            for used in range(spend + 1):
                for units in range(spend - used + 1):
                    c = table[i, used] + cost[i, units]
                    if c < table[i + 1, used + units]:
                        table[i + 1, used + units], pick[i + 1, used + units] = c, units
        if table[m, spend] < best[1]:
            left, chosen = spend, []
            for i in range(m, 0, -1):
                chosen.append(pick[i, left])
                left -= pick[i, left]
            best = [Part(g, int(u) - 1) for g, u in zip(groups, reversed(chosen))], float(table[m, spend])
    return best


def links(fps: DataFrame, plan: list[Part], radius: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints within ``radius``; a pair may come once per part.

    ``fps`` has distinct ``fp``. Candidates never leave the join: the whole distance is part of its
    condition. A fingerprint has few neighbours, as copies were folded into one before."""
    def masked(c: str, part: Part) -> Column:
        return F.col(c).bitwiseAND(F.lit(np.uint64(part.mask).astype(np.int64).item()))

    probes, index = [], []
    for i, part in enumerate(plan):
        if part.threshold < 0:
            continue
        flips = F.array(*[F.lit(np.uint64(x).astype(np.int64).item()) for x in part.flips()])
        probes.append(fps.select(F.lit(i).cast("byte").alias("part"), "fp", F.explode(flips).alias("flip"))
                      .select("part", F.col("fp").alias("a"), masked("fp", part).bitwiseXOR(F.col("flip")).alias("value")))
        index.append(fps.select(F.lit(i).cast("byte").alias("part"), F.col("fp").alias("b"), masked("fp", part).alias("value")))
    probe, base = probes[0], index[0]
    for p, x in zip(probes[1:], index[1:]):
        probe, base = probe.union(p), base.union(x)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probe.join(base, (probe["part"] == base["part"]) & (probe["value"] == base["value"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, sample_rows: int = 4096,
                    planned_rows: int = 100_000_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp``, ``component_id`` (least id of its class), ``n_links``
    (other fingerprints within ``radius``), ``class_rows`` of its fingerprint, ``text_hash``.

    The plan is fitted on at most ``sample_rows`` fingerprints, those least by hash, for an index of
    ``planned_rows``, so that it does not change while a corpus grows; any plan finds every link.
    Rows with a null id take part in linking but are never a class id, unless a class has no other."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    counted = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    sample = counted.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan, _ = allocate(sample, radius, planned_rows)
    found = written(links(counted.select("fp"), plan, radius).distinct(), "links")
    both = found.union(found.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "fp")
    group = components(found).withColumnRenamed("node", "fp")
    classes = counted.join(group, "fp", "left").join(degree, "fp", "left").select(
        "fp", "n", "least", F.coalesce("component", "fp").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = written(join_counted(classes.withColumnRenamed("n", "class_rows"), least, "class", "n").select(
        "fp", "component_id", "n_links", "class_rows"), "classes")
    return join_counted(rows, classes.withColumnRenamed("class_rows", "n"), "fp", "n").withColumnRenamed("n", "class_rows")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, all columns kept: the one with the least id.

    Rows are named by id and text hash together: a row whose text is unlike stays, whatever shares its
    id. Rows with a null id cannot be told apart and stay, as do near-copies that share the least id."""
    gone = near_duplicates(docs, **parameters).filter("doc_id > component_id").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    gone = written(gone, "near-copies")
    return without(docs, gone, (F.col("doc_id").cast("long") == F.col("__id"))
                   & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__hash")))
