"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Sources whose rates are sent to every task; more are joined by shuffle.
MOST_SOURCES = 10_000


def temperature_weights(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """``source``, ``weight``: rows of the source to the ``power``; below 1 it evens sources out."""
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) drawn by hash from the parts: 13 hexadecimal digits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16 ** 13)


def cumulative(rate: Column) -> Column:
    """P(X <= k) of a Poisson X for k from 0 to where the rest is far below what a draw can resolve."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    # one pass: the logarithm of the term and the sum so far are carried from k to k + 1
    start = F.struct((-rate).alias("log_term"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("sums"))

    def step(s: Column, k: Column) -> Column:
        log_term = s["log_term"] + F.log(rate) - F.log(k.cast("double"))
        total = s["sum"] + F.exp(log_term)
        return F.struct(log_term.alias("log_term"), total.alias("sum"), F.array_append(s["sums"], total).alias("sums"))

    sums = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["sums"])
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: DataFrame, rows: int | None = None) -> DataFrame:
    """``source``, ``cdf``: the distribution of a row's copies, its mean being the target repetition rate
    ``rows * weight / sum of weights / rows of the source``. ``rows`` is as many as ``docs`` has by default.

    A null source is the empty one. Sources without a weight, or with a null or negative one, get none."""
    have = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    want = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"))
    both = written(have.join(want, "source"), "source-weights")
    total = both.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    size = float(total["n"] or 0) if rows is None else float(rows)
    each = F.col("weight") / F.lit(float(total["w"] or 0) or 1.0) * F.lit(size) / F.col("n")
    return both.select("source", each.alias("rate")).select("source", cumulative(F.col("rate")).alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame, rows: int | None = None, seed: str = "mix") -> DataFrame:
    """``docs``, each row repeated by its draw, in a global random order: columns ``copy_no`` (from 1) and
    ``mix_key`` come on top (in place of columns
    of these names), rows of a partition are sorted by ``mix_key``.

    A row's draw depends on the seed and its id alone (rows with the same id get the same number, null ids
    count as empty), so a task that is run again repeats it. The copies of a hot source are spread by
    their keys, not by source."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rate = written(rates(docs, weights, rows), "rates").select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf"))
    few = rate.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    drawn = docs.join(F.broadcast(rate) if few else rate, F.coalesce(docs["source"], F.lit("")) == F.col("__source"))
    draw = uniform(F.lit(seed), F.lit("count"), id_text)
    copies = F.size(F.filter("__cdf", lambda c: c <= draw))
    out = drawn.withColumn("__copies", copies).filter("__copies > 0").select(
        *[docs[c] for c in docs.columns if c not in ("copy_no", "mix_key")], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy_no"))
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), id_text, F.col("copy_no").cast("string"))))
    return out.repartition("mix_key").sortWithinPartitions("mix_key")
