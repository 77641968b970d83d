"""Capture files as a table.

Files are listed by Spark and cut into byte ranges (``SPLIT_BYTES``), each read by a task of its own. Records are
chained, so a range first guesses where its first record begins, by a chain of headers that look right, and counts
its records from there. A pass over the ranges of each file in order then takes a guess only where the range before
ends at just that place, and walks the range anew where it does not: rows and numbers are those of one walk through
the whole file. Link, IP and TCP headers are decoded by column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dnp3 import be16, byte_at, latin1
from ..schemas import RAW_PACKETS
from ..session import cut_lineage

# Capture magic numbers (microsecond format) and link types.
PCAP_MAGIC = 0xA1B2C3D4
LINK_NULL, LINK_ETHERNET, LINK_RAW_A, LINK_RAW_B, LINK_COOKED = 0, 1, 12, 101, 113

FILE_HEADER, RECORD_HEADER = 24, 16
SPLIT_BYTES = 128 << 20
READ_BYTES = 1 << 20
BATCH_RECORDS, BATCH_BYTES = 4096, 8 << 20
#: Headers in a row that must look right, and the longest record of captures that name none.
LIKELY_HEADERS, LONGEST_RECORD = 8, 262_144


def open_path(path: str):
    """(filesystem, path) of a plain path or a URI as Spark writes it, its special characters unquoted."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/@"))
    return pafs.LocalFileSystem(), path


def open_file(path: str) -> pa.NativeFile:
    filesystem, inner = open_path(path)
    return filesystem.open_input_file(inner)


def file_header(f: pa.NativeFile, length: int) -> tuple[str, int, int] | None:
    """(byte order, link type, longest record), null for any other format."""
    head = f.read_at(FILE_HEADER, 0) if length >= FILE_HEADER else b""
    order = next((o for o in "<>" if head and struct.unpack(o + "I", head[:4])[0] == PCAP_MAGIC), None)
    if order is None:
        return None
    longest, link = struct.unpack(order + "II", head[16:])
    return order, link, longest or LONGEST_RECORD


def records(
    f: pa.NativeFile, order: str, at: int, stop: int, length: int, data: bool = True
) -> Iterator[tuple[int, int, bytes | None]]:
    """(end, time, data) of each whole record that starts in [at, stop)."""
    header, buf, base = struct.Struct(order + "IIII"), b"", at
    while at < stop and at + RECORD_HEADER <= length:
        if at + RECORD_HEADER > base + len(buf):
            buf, base = f.read_at(READ_BYTES, at), at
        sec, usec, size, _ = header.unpack_from(buf, at - base)
        end = at + RECORD_HEADER + size
        if end > length:
            return
        if data and end > base + len(buf):
            buf, base = f.read_at(max(READ_BYTES, end - at), at), at
        yield end, sec * 1_000_000 + usec, buf[at - base + RECORD_HEADER:end - base] if data else None
        at = end


def counted(f: pa.NativeFile, order: str, at: int, stop: int, length: int) -> tuple[int, int]:
    """Records that start in [at, stop), and where the last of them ends."""
    n = 0
    for at, _, _ in records(f, order, at, stop, length, data=False):
        n += 1
    return n, at


def likely_start(f: pa.NativeFile, order: str, longest: int, start: int, stop: int, length: int) -> int | None:
    """First place in [start, stop) from which headers follow that look right, up to eight or the end of the file."""
    header = struct.Struct(order + "IIII")

    def goes_on(at: int) -> bool:
        for _ in range(LIKELY_HEADERS):
            if at == length:
                return True
            if at + RECORD_HEADER > length:
                return False
            _, usec, size, whole = header.unpack(f.read_at(RECORD_HEADER, at))
            if usec >= 1_000_000 or not 0 < size <= min(longest, whole):
                return False
            at += RECORD_HEADER + size
        return at <= length

    for base in range(start, stop, READ_BYTES):
        buf = np.frombuffer(f.read_at(min(READ_BYTES, stop - base) + RECORD_HEADER - 1, base), np.uint8)
        n = len(buf) - RECORD_HEADER + 1
        if n <= 0:
            return None

        def number(k: int) -> np.ndarray:
            shifts = (0, 8, 16, 24) if order == "<" else (24, 16, 8, 0)
            return sum(buf[k + i:k + i + n].astype(np.uint32) << np.uint32(s) for i, s in enumerate(shifts))

        size = number(8)
        likely = (number(4) < 1_000_000) & (size > 0) & (size <= longest) & (size <= number(12))
        for at in np.flatnonzero(likely).tolist():
            if goes_on(base + at):
                return base + at
    return None


_RANGE = "path STRING, length LONG, no LONG, start LONG, stop LONG"
_GUESSED = _RANGE + ", byte_order STRING, link INT, first LONG, n LONG, upto LONG"
_INDEX = "path STRING, length LONG, no LONG, entry LONG, stop LONG, byte_order STRING, link INT, first_no LONG, n LONG, cut_bytes LONG"


def _table(rows: list[tuple], like: str) -> pa.RecordBatch:
    kinds = {"STRING": pa.string(), "LONG": pa.int64(), "INT": pa.int32()}
    fields = [c.split() for c in like.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _guess_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            path, length, no, start, stop = r.values()
            with open_file(path) as f:
                head = file_header(f, length)
                order, link, longest = head or (None, None, None)
                first, n, upto = None, 0, None
                if head:
                    first = FILE_HEADER if no == 0 else likely_start(f, order, longest, start, stop, length)
                if first is not None:
                    n, upto = counted(f, order, first, stop, length)
            yield _table([(path, length, no, start, stop, order, link, first, n, upto)], _GUESSED)


def _settle_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges sorted by file and number, each entered where the one before ends."""
    path, at, number = None, 0, 0
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["path"] != path:
                path, number = r["path"], 0
                at = FILE_HEADER if r["link"] is not None else r["length"]
            entry, stop, n, cut = at, r["stop"], 0, 0
            if at < stop:
                if r["first"] == at:
                    n, at = r["n"], r["upto"]
                else:
                    with open_file(path) as f:
                        n, at = counted(f, r["byte_order"], at, stop, r["length"])
                if at < stop:  # no whole record follows: the file ends here
                    cut, at = r["length"] - at, r["length"]
            out.append((path, r["length"], r["no"], entry, stop, r["byte_order"], r["link"], number, n, cut))
            number += n
        yield _table(out, _INDEX)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RAW_PACKETS.names)

    for b in batches:
        for r in b.to_pylist():
            rows, held = [], 0
            with open_file(r["path"]) as f:
                found = records(f, r["byte_order"], r["entry"], r["stop"], r["length"])
                for number, (_, ts_us, data) in enumerate(found, r["first_no"]):
                    rows.append((r["path"], number, ts_us, r["link"], data))
                    held += len(data)
                    if len(rows) == BATCH_RECORDS or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def capture_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per byte range of a file, or of the ``.pcap`` files right under a folder.

    ``entry`` is where the range's first record begins, ``first_no`` its number in the file, ``n`` the records that
    start in the range, ``cut_bytes`` what follows the last whole record of the file. Files of another format have no
    ``link``. It is written once, as every reader of the packets needs it.
    """
    itself = "/" + path.rpartition(":")[2].strip("/")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(
        F.col("path").endswith(".pcap") | F.col("path").endswith(itself))
    last = F.greatest(F.lit(0), F.ceil(F.col("length") / split_bytes) - 1)
    ranges = files.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).select(
        "path", "length", "no", (F.col("no") * split_bytes).alias("start"),
        F.least("length", (F.col("no") + 1) * split_bytes).alias("stop"))
    ranges = cut_lineage(ranges)
    tasks = max(1, ranges.count())
    guessed = ranges.repartition(tasks, "path", "no").mapInArrow(_guess_starts, _GUESSED)
    by_file = guessed.repartition("path").sortWithinPartitions("path", "no")
    return cut_lineage(by_file.mapInArrow(_settle_starts, _INDEX))


def capture_report(index: DataFrame) -> DataFrame:
    """Per file its length, link type, records and ``cut_bytes``; ``is_capture`` is false for files that are skipped."""
    return index.groupBy(F.col("path").alias("file"), "length", "link").agg(
        F.sum("n").alias("records"), F.sum("cut_bytes").alias("cut_bytes")
    ).withColumn("is_capture", F.col("link").isNotNull())


def read_records(index: DataFrame) -> DataFrame:
    """Records of captures, a task per range."""
    full = index.where("n > 0")
    return full.repartition(max(1, full.count()), "path", "no").mapInArrow(_read_ranges, RAW_PACKETS)


def ip_offset(text: Column, link_type: Column) -> Column:
    """0-based offset of the IPv4 header in a Latin-1 view, null for any other content."""
    n = F.length(text)
    eth = be16(text, 13)
    tagged = be16(text, 17)
    af = byte_at(text, 1)
    rest = byte_at(text, 2) + byte_at(text, 3) + byte_at(text, 4)
    return (
        F.when((link_type == LINK_NULL) & (n >= 4) & (af == 2) & (rest == 0), 4)
        .when((link_type == LINK_ETHERNET) & (n >= 14) & (eth == 0x0800), 14)
        .when((link_type == LINK_ETHERNET) & (n >= 18) & (eth == 0x8100) & (tagged == 0x0800), 18)
        .when(link_type.isin(LINK_RAW_A, LINK_RAW_B), 0)
        .when((link_type == LINK_COOKED) & (n >= 16) & (be16(text, 15) == 0x0800), 16)
    )


def decode_packets(raw: DataFrame, trim: bool = True, keep_empty: bool = True) -> DataFrame:
    """TCP packets from capture records.

    ``trim`` ends the payload at the IP total length, which drops link padding;
    ``trim=False`` keeps every captured byte. ``keep_empty=False`` drops packets
    without payload.
    """
    t = F.col("__t")
    ip = F.col("__ip")
    dotted = lambda p: F.concat_ws(
        ".", *[byte_at(t, p + i).cast("string") for i in range(4)]
    )
    n = F.length(t)
    tcp = F.col("__tcp")
    start = tcp + F.shiftright(byte_at(t, tcp + 13), 4) * 4
    end = F.least(ip + F.col("ip_len"), n) if trim else n
    out = (
        raw.withColumn("__t", latin1(F.col("data")))
        .withColumn("__ip", ip_offset(t, F.col("link_type")))
        .where(ip.isNotNull() & (n >= ip + 20) & (byte_at(t, ip + 10) == 6))
        .withColumn("__tcp", ip + byte_at(t, ip + 1).bitwiseAND(F.lit(15)) * 4)
        .where(n >= tcp + 20)
        .withColumn("ip_len", be16(t, ip + 3))
        .withColumn("__from", start)
        .select(
            "file", "pkt_no", "ts_us", dotted(ip + 13).alias("src_ip"),
            be16(t, tcp + 1).alias("src_port"), dotted(ip + 17).alias("dst_ip"),
            be16(t, tcp + 3).alias("dst_port"), F.lit(6).alias("proto"), "ip_len",
            (F.col("__from") - ip).alias("hdr_len"), byte_at(t, tcp + 14).alias("tcp_flags"),
            be16(t, tcp + 15).alias("win"),
            F.greatest(end - F.col("__from"), F.lit(0)).alias("payload_len"),
            F.substring(F.col("data"), F.col("__from") + 1, F.greatest(end - F.col("__from"), F.lit(0)))
            .alias("payload"),
        )
    )
    return out if keep_empty else out.where("payload_len > 0")


def read_pcap(
    spark: SparkSession, path: str, trim: bool = True, keep_empty: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """TCP packets of a capture file or of every ``.pcap`` file in a folder.

    ``file`` is the full address of the file, ``pkt_no`` the number of the record in it. Files of another format are
    skipped; :func:`capture_report` names them.
    """
    return decode_packets(read_records(capture_index(spark, path, split_bytes)), trim, keep_empty)


def read_labelled_pcaps(spark: SparkSession, path: str, label: str | None = None, **opt) -> DataFrame:
    """Packets with ``Label``: the given one, or each file's name without its ending."""
    stem = F.regexp_extract("file", r"([^/]+)\.pcap$", 1)
    return read_pcap(spark, path, **opt).withColumn("Label", F.lit(label) if label else stem)
