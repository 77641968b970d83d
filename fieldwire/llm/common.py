"""Shared parts: table access, whole-batch text buffers and word hashes, hot keys, written steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldwire.session import checkpoint_folder

#: Text bytes handled by one round of array operations in a task; they then fit a core's cache.
CHUNK_BYTES = 256 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text being the empty one: other columns cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: later steps do not run its plan once more."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of keys that are sent to every task; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def without(docs: DataFrame, gone: DataFrame, on) -> DataFrame:
    """``docs`` without the rows that meet ``on`` for a row of ``gone``, a written table of short keys.

    Up to a million keys go to every task, so that texts stay where they are; beyond, both are shuffled."""
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, on, "left_anti")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and where each row starts and ends; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is alone in its range."""
    i, rows = 0, len(at) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a fixed public function) over unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n + 1`` powers of the base of polynomial hashes and of its inverse."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[key] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] the polynomial hash of data[s:e] times the s-th power of the base."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def tokens(data: np.ndarray, at: np.ndarray, split_signs: bool, with_text: bool = False):
    """Hash, row, start and end byte of each word of the rows; A-Z count as a-z.

    A word is a run of bytes that are not white space; with ``split_signs`` letters and digits on one
    side and signs on the other are words of their own. No word crosses rows. ``with_text``: the
    lower-cased bytes come first."""
    if not len(data):
        none = np.zeros(0, np.int64)
        found = none.astype(np.uint64), none, none, none
        return (data, *found) if with_text else found
    kind = np.where(_SPACE[data], 0, np.where(_LETTER[data], 1, 2 if split_signs else 1)).astype(np.int8)
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    edges = at[1:-1]
    new[edges[edges < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    full = kind[start] > 0
    start, end = start[full], end[full]
    row = np.searchsorted(at, start, "right") - 1
    lower = _LOWER[data]
    found = span_hashes(prefix_hashes(lower), start, end), row, start, end
    return (lower, *found) if with_text else found


def hot_keys(counted: DataFrame, key: str, n: str, share: int = 256) -> DataFrame:
    """Keys that hold more than one part in ``share`` of all counted rows: fewer than ``share`` of them."""
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    return counted.filter(F.col(n) * share > total)


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """Each row with its key's row of ``counted`` (one row a key, ``n`` rows of ``rows`` each).

    Hot keys, fewer than 256 by definition, are broadcast, so no task gets a hot key's rows; the
    rest is joined by shuffle."""
    hot = hot_keys(counted, key, n)
    tagged = rows.join(F.broadcast(hot.select(F.col(key), F.struct(*[c for c in hot.columns if c != key]).alias("__hot"))), key, "left")
    rest = counted.join(F.broadcast(hot.select(key)), key, "left_anti")
    cold = tagged.filter("__hot is null").drop("__hot").join(rest, key)
    warm = tagged.filter("__hot is not null").select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in counted.columns if c != key])
    return cold.select(warm.columns).unionByName(warm)
