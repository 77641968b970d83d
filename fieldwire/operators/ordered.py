"""Ordered, per-key computation that holds up when one key owns a third of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here every key
is cut into time cells (``chunk``). The window runs per (key, cell), one summary row
per cell is carried across the cells of a key, and the carried value joins back on
(key, cell). Only the summary, one row per cell, is ever ordered by key alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage

MINUTE_US = 60_000_000


def cell(ts: str | Column, width_us: int) -> Column:
    """Time cell of a LONG microsecond column (exact for negative values too)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return ((c - F.pmod(c, F.lit(width_us))) / F.lit(width_us)).cast("long")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the right keys are dropped.

    Structs compare their null fields as equal, so one plain equality does it.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.struct(*[F.col(k).alias(k) for k in keys]) == F.struct(
        *[F.col(f"__r_{k}").alias(k) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_cells(df: DataFrame, keys: list[str], chunk: Column, parts: int | None = None) -> DataFrame:
    """``df`` parted by ``__k``, the (key, cell) of each row as one non-null struct.

    Windows, the carry join and further :func:`running` passes all partition by this very
    column, so a chain of passes reads its source and shuffles the rows once. The rows travel
    packed: the passes read different columns, and pruning would give each its own shuffle.
    All columns of ``df`` are shuffled, so drop beforehand what is not needed. ``parts``: tasks of the passes; without, adaptive
    execution joins partitions up to its advisory size, and a task holds a sorted copy of its rows for each pass.
    """
    packed = df.select(
        F.struct(*keys, chunk.alias("__cell")).alias("__k"), F.array(F.struct(*df.columns)).alias("__rows"))
    row = F.element_at("__rows", 1)
    dealt = packed.repartition(parts, "__k") if parts else packed.repartition("__k")
    return dealt.select(*[row.getField(c).alias(c) for c in df.columns], "__k")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None = None,
    last: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running values per key.

    ``last``: name -> expression; the latest non-null value strictly before the row.
    ``sums``: name -> expression; the sum up to and including the row.
    ``order`` must be total within a key and ``chunk`` non-decreasing along it. Without
    ``chunk`` the rows carry the cells of :func:`with_cells`, which then stay.
    """
    last, sums = last or {}, sums or {}
    names = list(last) + list(sums)
    celled = df if chunk is None else with_cells(df, keys, chunk)
    base = celled.withColumns({f"__v_{n}": e for n, e in {**last, **sums}.items()})
    before = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns(
        {f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(before) for n in last}
        | {f"__l_{n}": F.sum(f"__v_{n}").over(upto) for n in sums}
    )
    pos = F.struct(*[F.col(o) for o in order])
    summary = base.groupBy("__k").agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), pos)).alias(f"__s_{n}")
          for n in last],
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums],
    )
    carried = _carried(summary, [f"__k.{k}" for k in keys], list(last), list(sums)).select(
        F.col("__k").alias("__r_k"), *[f"__c_{n}" for n in names])
    zero = F.lit(0)
    return local.join(carried, F.col("__k") == F.col("__r_k"), "left").select(
        *[c for c in celled.columns if c not in names and (c != "__k" or chunk is None)],
        *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in last],
        *[(F.coalesce(f"__l_{n}", zero) + F.coalesce(f"__c_{n}", zero)).alias(n) for n in sums],
    )


#: Cells that one task orders where there is no key.
BLOCK_CELLS = 4096


def _carried(summary: DataFrame, keys: list[str], last: list[str], sums: list[str]) -> DataFrame:
    """``summary`` (``__k``, ``__s_...``) with what the cells before a cell hand on, ``__c_...``.

    With keys, a key's cells are ordered. Without, cells are ordered inside blocks of them, and blocks like cells."""
    def handed(by: Window) -> dict:
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        return ({f"__c_{n}": F.last(f"__s_{n}", ignorenulls=True).over(before) for n in last}
                | {f"__c_{n}": F.sum(f"__s_{n}").over(before) for n in sums})

    if keys:
        return summary.withColumns(handed(Window.partitionBy(*keys).orderBy("__k.__cell")))
    blocked = summary.withColumn("__block", cell(F.col("__k.__cell").cast("long"), BLOCK_CELLS))
    pos = F.col("__k.__cell")
    blocks = blocked.groupBy("__block").agg(
        *[F.max_by(f"__s_{n}", F.when(F.col(f"__s_{n}").isNotNull(), pos)).alias(f"__s_{n}") for n in last],
        *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums])
    blocks = blocks.withColumns(handed(Window.orderBy("__block"))).select(
        F.col("__block").alias("__b"), *[F.col(f"__c_{n}").alias(f"__o_{n}") for n in [*last, *sums]])
    inside = blocked.withColumns(handed(Window.partitionBy("__block").orderBy("__k.__cell")))
    both = inside.join(blocks, F.col("__block").eqNullSafe(F.col("__b")))
    return both.withColumns(
        {f"__c_{n}": F.coalesce(f"__c_{n}", f"__o_{n}") for n in last}
        | {f"__c_{n}": F.coalesce(f"__c_{n}", F.lit(0)) + F.coalesce(f"__o_{n}", F.lit(0)) for n in sums})


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    value: Column,
    out: str,
    chunk_us: int = MINUTE_US,
    forward: bool = False,
    right_tie: Column | None = None,
) -> DataFrame:
    """Nearest earlier (or later, ``forward``) right row per left row, same time included.

    Both sides are merged in time order and the value is carried, so the work is linear
    and no pair of rows of a key is built. ``value`` is an expression over ``right``;
    ``right_tie`` orders right rows of one instant, the greatest being the nearest.
    """
    sign = -1 if forward else 1
    vtype = right.select(value.alias("v")).schema["v"].dataType
    rtype = left.select(F.struct("*").alias("r")).schema["r"].dataType
    lrows = left.select(
        *keys, (F.lit(sign) * F.col(left_ts)).alias("__ts"), F.lit(1).alias("__side"),
        F.lit(0).cast("long").alias("__tie"),
        F.struct(*left.columns).alias("__row"), F.lit(None).cast(vtype).alias("__val"),
    )
    tie = F.lit(0) if right_tie is None else right_tie
    rrows = right.select(
        *keys, (F.lit(sign) * F.col(right_ts)).alias("__ts"), F.lit(0).alias("__side"),
        tie.cast("long").alias("__tie"),
        F.lit(None).cast(rtype).alias("__row"), value.alias("__val"),
    )
    merged = running(
        lrows.unionByName(rrows), keys, ["__ts", "__side", "__tie"],
        cell("__ts", chunk_us), last={out: F.col("__val")},
    )
    return merged.where("__side = 1").select("__row.*", out)


def row_numbers(df: DataFrame, order: list[str], chunk: Column, out: str = "rn") -> DataFrame:
    """Exact global 1-based position without sending all rows to one task."""
    return running(df, [], order, chunk, sums={out: F.lit(1)})


def cut_at_rank(
    df: DataFrame, order: list[str], chunk: Column, keep: Column, out: str = "kept"
) -> DataFrame:
    """Flag the first ``keep`` rows in ``order``; ``keep`` may use ``__total``.

    Rows of cells wholly before or after the cut are decided by their cell alone. Only
    the one cell that holds the cut is ranked.
    """
    base = df.withColumn("__cell", chunk)
    w = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        base.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
        .withColumns({
            "__before": F.coalesce(F.sum("__n").over(w), F.lit(0)),
            "__total": F.sum("__n").over(Window.partitionBy()),
        })
        .withColumn("__keep", keep.cast("long"))
        .drop("__total")
    )
    tagged = _null_safe(base, counts, ["__cell"], "inner")
    whole = (F.col("__before") + F.col("__n") <= F.col("__keep")) | (
        F.col("__before") >= F.col("__keep")
    )
    decided = tagged.where(whole).withColumn(out, F.col("__before") < F.col("__keep"))
    split = tagged.where(~whole).withColumn(
        out,
        F.row_number().over(Window.partitionBy("__cell").orderBy(*order)) + F.col("__before")
        <= F.col("__keep"),
    )
    return decided.unionByName(split).drop("__cell", "__n", "__before", "__keep")


# ---- alert, then silence --------------------------------------------------------

def _changes(table: pa.Table, fields: int) -> np.ndarray:
    """True where one of the first ``fields`` fields of ``__k`` differs from the row before; nulls are equal."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    k = table.column("__k").combine_chunks()
    for i in range(fields):
        codes = pc.dictionary_encode(k.field(i), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _whole_cells(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``__k`` as tables that hold each cell whole, and where each cell starts."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        starts = np.flatnonzero(_changes(table, fields))
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _jumps(group: np.ndarray, offset: np.ndarray, width: int, gap: int) -> np.ndarray:
    """The next row of the group that is at least ``gap`` later, or the number of rows. Offsets are below ``width``."""
    at = group * (2 * width) + offset
    to = np.searchsorted(at, at + gap)
    return np.where((to < len(at)) & (group[np.minimum(to, len(at) - 1)] == group), to, len(at))


def _last_reached(jump: np.ndarray) -> np.ndarray:
    """Where the chain of jumps from each row ends, by doubling."""
    end = np.where(jump < len(jump), jump, np.arange(len(jump)))
    while ((further := end[end]) != end).any():
        end = further
    return end


def _followed(starts: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """All rows on the chains from ``starts``."""
    out = []
    while len(starts := starts[starts < len(jump)]):
        out.append(starts)
        starts = jump[starts]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def cooldown(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    cooldown_us: int,
    chunk_us: int = MINUTE_US,
) -> DataFrame:
    """Rows that fire when each firing silences its key for ``cooldown_us``.

    A row fires if the last firing of its key is at least ``cooldown_us`` old. Of rows at one instant the first in
    ``order`` fires; rows without a time never do.

    A time cell, at least 16 silences long, is a step function from the time up to which the key is silent when the
    cell begins to the cell's last firing. Cells are reduced to their steps on their own; the steps of a key, in
    order of cells, give the silence at the start of each; and each cell then fires on its own. Only steps are
    ordered by key alone.
    """
    if cooldown_us <= 0:
        return df
    width = max(chunk_us, 16 * cooldown_us)
    rest = [c for c in df.columns if c not in keys and c != ts]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    celled = with_cells(df.where(F.col(ts).isNotNull()), keys, cell(ts, width))
    fields = len(keys) + 1
    of_k = celled.schema["__k"]

    def placed(table: pa.Table, starts: np.ndarray):
        """Number of its cell, time, and time since the cell began of each row."""
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        stamp = table.column(ts).to_numpy().astype(np.int64)
        return number, stamp, stamp - table.column("__k").combine_chunks().field(fields - 1).to_numpy() * width

    def rows_of(table: pa.Table, at, **more) -> list[pa.RecordBatch]:
        out = table.select(["__k"]).take(pa.array(at, pa.int64()))
        for name, values in more.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out.combine_chunks().to_batches()

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_cells(batches, fields):
            number, stamp, offset = placed(table, starts)
            leave = stamp[_last_reached(_jumps(number, offset, width, cooldown_us))]
            # silences end within the first ``cooldown_us`` of a cell: what comes later is entered through its first row
            entry = offset < cooldown_us
            entry |= np.append(True, entry[:-1] | (number[1:] != number[:-1]))
            at = np.flatnonzero(entry)
            at = at[np.append((leave[at][1:] != leave[at][:-1]) | (number[at][1:] != number[at][:-1]), True)]
            yield from rows_of(table, at, upto=stamp[at], leave=leave[at])

    def silences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, until, enter, done = None, None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            first = 0 if before is None else 1  # the row before only tells whether key and cell go on
            table = table if before is None else pa.concat_tables([before, table]).combine_chunks()
            new_key, new_cell = _changes(table, fields - 1), _changes(table, fields)
            upto, leave = table.column("upto").to_numpy().tolist(), table.column("leave").to_numpy().tolist()
            rows, found = [], []
            for i in range(first, len(table)):
                if new_cell[i]:
                    enter = None if i == 0 or new_key[i] else until
                    until, done = None, False
                    rows.append(i)
                    found.append(enter)
                if not done and (enter is None or upto[i] >= enter):
                    until, done = leave[i] + cooldown_us, True
            before = table.slice(len(table) - 1)
            yield from rows_of(table, rows, until=found)

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_cells(batches, fields):
            number, stamp, offset = placed(table, starts)
            until = pc.fill_null(table.column("__until"), np.iinfo(np.int64).min).to_numpy()[starts]
            begin = stamp[starts] - offset[starts]
            wait = np.where(until > begin, until - begin, 0)
            first = np.searchsorted(number * (2 * width) + offset, np.arange(len(starts)) * (2 * width) + wait)
            first = first[(first < len(table)) & (number[np.minimum(first, len(table) - 1)] == np.arange(len(starts)))]
            hit = _followed(first, _jumps(number, offset, width, cooldown_us))
            yield from table.drop_columns(["__until"]).take(pa.array(hit)).combine_chunks().to_batches()

    long = lambda *names: T.StructType([of_k, *[T.StructField(n, T.LongType()) for n in names]])
    instants = celled.select("__k", ts).distinct().sortWithinPartitions("__k", ts)
    of_cells = instants.mapInArrow(steps, long("upto", "leave"))
    by_key = of_cells.repartition(*[F.col(f"__k.{k}") for k in keys]) if keys else of_cells.repartition(1)
    entered = by_key.sortWithinPartitions("__k", "upto").mapInArrow(silences, long("until"))
    rows = celled.groupBy("__k", ts).agg(F.min(ranked).alias("__row"))
    rows = rows.join(entered.select(F.col("__k").alias("__e"), F.col("until").alias("__until")), F.col("__k") == F.col("__e")).drop("__e")
    out = rows.sortWithinPartitions("__k", ts)
    out = out.mapInArrow(fired, out.drop("__until").schema)
    return out.select(*[F.col(f"__k.{k}").alias(k) for k in keys], ts, "__row.*").select(*df.columns)


def sliding_count(
    df: DataFrame, keys: list[str], ts: str, order: list[str], window_us: int,
    out: str = "in_window", chunk_us: int | None = None,
) -> DataFrame:
    """Rows of the key in ``[t - window_us, t]``, the row itself included, in row order.

    Cells are at least one window long, so a row needs its own cell and the tail of the
    one before; that tail is copied forward and the frame stays inside one (key, cell).
    """
    width = max(chunk_us or 0, 8 * window_us)
    home = df.withColumns({"__cell": cell(ts, width), "__ghost": F.lit(False)})
    tail = home.where(
        F.col(ts) >= (F.col("__cell") + 1) * F.lit(width) - F.lit(window_us)
    ).withColumns({"__cell": F.col("__cell") + 1, "__ghost": F.lit(True)})
    w = Window.partitionBy(*keys, "__cell")
    expired = w.orderBy(ts).rangeBetween(Window.unboundedPreceding, -(window_us + 1))
    return (
        home.unionByName(tail)
        .withColumn(
            out,
            F.row_number().over(w.orderBy(ts, *order)) - F.count(F.lit(1)).over(expired),
        )
        .where(~F.col("__ghost")).drop("__cell", "__ghost")
    )


def windows_opened(
    df: DataFrame, keys: list[str], ts: str, order: list[str], window_us: int,
    chunk_us: int = MINUTE_US,
) -> DataFrame:
    """Assign rows to windows that the first row after the last window opens.

    Adds ``window_open`` and ``window_pos`` (1-based position inside the window). The rows
    should be narrow: they are written once, as every step reads them again.
    """
    df = cut_lineage(df)
    opens = cooldown(
        df.select(*keys, ts, *order), keys, ts, order, window_us, chunk_us
    )
    placed = asof(df, opens, keys, ts, ts, F.col(ts), "window_open", chunk_us)
    # a flood is one window: its rows are counted over cells like any other key's
    return running(
        placed, [*keys, "window_open"], [ts, *order], cell(ts, min(chunk_us, max(1, window_us // 64))),
        sums={"window_pos": F.lit(1).cast("long")},
    )


def value_cell(value: Column, cells: int = 4096) -> Column:
    """Cell of a number by its signed logarithm: it keeps the order, infinities have the end cells."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(cells))


def even_cells(values: DataFrame, key: str, value: str, parts: int = 32, fine: int = 128) -> DataFrame:
    """``values`` with ``__cell``: cells of each key that keep the order of its values and hold like numbers of them.

    Cut at quantiles of a bounded sketch, and between two of them evenly. Only the size of cells depends on the cuts.
    There are few keys: their cuts go to every task."""
    v = F.col(value)
    cuts = values.groupBy(key).agg(F.percentile_approx(v, [k / parts for k in range(1, parts)], 1_000).alias("__cuts"))
    part = F.size(F.filter("__cuts", lambda c: c < v))
    low, high = F.get("__cuts", part - 1), F.get("__cuts", part)
    share = F.when((low > float("-inf")) & (high < float("inf")) & (low < high), (v - low) / (high - low))
    inner = F.coalesce(F.least(F.lit(fine - 1), F.floor(share * fine)), F.lit(0))
    return values.join(F.broadcast(cuts), key).withColumn("__cell", (part * fine + inner).cast("long")).drop("__cuts")


def matrix(columns: list[pa.Array]) -> np.ndarray:
    """Numeric columns of a batch as one matrix of doubles, null as NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in columns])


def _value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each value of each column occurs in a batch."""
    for b in batches:
        found = [np.unique(x[~np.isnan(x)], return_counts=True) for x in matrix(b.columns).T]
        pos = np.repeat(np.arange(len(found), dtype=np.int32), [len(v) for v, _ in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(pos), *(pa.array(np.concatenate(x)) for x in zip(*found))], ["pos", "v", "n"])


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float]
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles; null for a column without values.

    Nulls and NaN are no values; infinities are values like others. Every column's values are counted, the counts are
    carried over cells of like numbers of values, and the values that hold the asked ranks are picked: at most two
    per column and probability reach the driver.
    """
    if not columns:
        return {}
    plain = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # counted in array batches first: to make a row of every value of many columns costs many times as much
    counts = cut_lineage(
        plain.mapInArrow(_value_counts, "pos int, v double, n long").groupBy("pos", "v").agg(F.sum("n").alias("n"))
    )
    celled = even_cells(counts, "pos", "v")
    upto = cut_lineage(running(celled, ["pos"], ["v"], F.col("__cell"), sums={"upto": F.col("n")}))
    sizes = {r["pos"]: r["n"] for r in upto.groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    asked = {
        (pos, k) for pos, n in sizes.items() for p in probs
        for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))
    }
    ranks = df.sparkSession.createDataFrame(sorted(asked), "pos INT, k LONG")
    found = upto.join(F.broadcast(ranks), "pos").where(
        (F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n"))
    )
    value = {(r["pos"], r["k"]): r["v"] for r in found.select("pos", "k", "v").collect()}

    def quantile(pos: int, p: float) -> float | None:
        if pos not in sizes:
            return None
        r = p * (sizes[pos] - 1)
        low, high = value[pos, int(r)], value[pos, min(int(r) + 1, sizes[pos] - 1)]
        return low if low == high or r == int(r) else low + (high - low) * (r - int(r))

    return {c: [quantile(i, p) for p in probs] for i, c in enumerate(columns)}
