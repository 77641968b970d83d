"""DNP3 decoding as column expressions.

Bytes are read through a Latin-1 view of the binary column: one character per byte, so
``ascii(substring(...))`` is the byte value and ``locate`` jumps to the start bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..constants import ATTACK_CLASSES, FC_NAMES, LINK_STATUS_CTRL

FRAME_TYPE = (
    "STRUCT<pos: INT, ctrl: INT, src: INT, dst: INT, fc: INT, "
    "user_data_len: INT, wire_size: INT>"
)


def latin1(data: Column) -> Column:
    """Binary as text, one character per byte."""
    return F.call_function("decode", data, F.lit("ISO-8859-1"))


def byte_at(text: Column, pos: Column | int) -> Column:
    """Byte value at the 1-based position of a Latin-1 view."""
    return F.ascii(F.substring(text, F.lit(pos) if isinstance(pos, int) else pos, F.lit(1)))


def le16(text: Column, pos: Column) -> Column:
    return byte_at(text, pos) + byte_at(text, pos + 1) * 256


def be16(text: Column, pos: Column | int) -> Column:
    p = F.lit(pos) if isinstance(pos, int) else pos
    return byte_at(text, p) * 256 + byte_at(text, p + 1)


def wire_size(user_data_len: Column) -> Column:
    """Bytes on the wire of the user data: 16-byte blocks, each with a 2-byte CRC."""
    rest = user_data_len % 16
    blocks = ((user_data_len - rest) / 16).cast("int")
    return blocks * 18 + F.when(rest > 0, rest + 2).otherwise(0)


def _locate(needle: Column, text: Column, pos: Column) -> Column:
    return F.call_function("locate", needle, text, pos)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def parse_frames(payload: Column) -> Column:
    """All frames of a payload as an array of structs; ``pos`` is the 0-based offset.

    The scan looks for the start bytes, skips noise, and ends for good at the first
    frame that is cut short. The fold runs once per start-byte pair in the payload, not
    once per byte.
    """
    mark = F.lit("\x05d")
    none = F.array().cast(f"ARRAY<{FRAME_TYPE}>")

    def scan(text):
        n = F.length(text)
        starts = ((n - F.length(F.replace(text, mark, F.lit("")))) / 2).cast("int")

        def step(acc, _):
            def at(p):
                return _bind(F.greatest(byte_at(text, p + 2) - 5, F.lit(0)), lambda u: take(p, u))

            def take(p, udata):
                size = wire_size(udata) + 10
                frame = F.struct(
                    (p - 1).alias("pos"),
                    byte_at(text, p + 3).alias("ctrl"),
                    le16(text, p + 6).alias("src"),
                    le16(text, p + 4).alias("dst"),
                    F.when(udata >= 3, byte_at(text, p + 12)).alias("fc"),
                    udata.alias("user_data_len"),
                    size.alias("wire_size"),
                )
                whole = (p > 0) & (p + 9 <= n) & (p - 1 + size <= n)
                return F.when(whole, F.struct(
                    (p + size).alias("next"), F.concat(acc["out"], F.array(frame)).alias("out"),
                )).otherwise(F.struct(F.lit(0).alias("next"), acc["out"].alias("out")))

            return F.when(acc["next"] <= 0, acc).otherwise(
                _bind(_locate(mark, text, acc["next"]), at)
            )

        return F.aggregate(
            F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(F.array().cast("array<int>")),
            F.struct(F.lit(1).alias("next"), none.alias("out")),
            step, lambda acc: acc["out"],
        )

    return _bind(latin1(payload), scan)


def fc_name(fc: Column) -> Column:
    """Name of a function code; LINK_ONLY without one, FC_0xNN for an unknown one."""
    names = F.create_map(*[F.lit(v) for kv in FC_NAMES.items() for v in kv])
    return F.when(fc.isNull(), F.lit("LINK_ONLY")).otherwise(
        F.coalesce(F.try_element_at(names, fc), F.format_string("FC_0x%02X", fc))
    )


def attack_class(fc: Column) -> Column:
    """Attack class of a function code, null when it is none."""
    classes = F.create_map(*[F.lit(v) for kv in ATTACK_CLASSES.items() for v in kv])
    return F.when(fc.isNotNull(), F.try_element_at(classes, fc))


def is_attack(fc: Column) -> Column:
    return F.coalesce(fc.isin(list(ATTACK_CLASSES)), F.lit(False))


def is_link_status(ctrl: Column) -> Column:
    return ctrl == F.lit(LINK_STATUS_CTRL)


def starts_frame(payload: Column) -> Column:
    """True when the first two bytes are the start bytes."""
    return F.coalesce(F.startswith(payload, F.lit(bytes([5, 100]))), F.lit(False))


def crc_table() -> list[int]:
    """Byte table of CRC-16 with the reflected polynomial 0xA6BC."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xA6BC if value & 1 else 0)
        table.append(value)
    return table


@F.pandas_udf(T.BooleanType())
def frame_crc_ok(payload: pd.Series, pos: pd.Series, user_data_len: pd.Series) -> pd.Series:
    """True when the header CRC and the CRC of every user data block match.

    One numpy pass per byte position covers all blocks of the Arrow batch.
    """
    table = np.array(crc_table(), dtype=np.int32)
    sizes = payload.map(len).to_numpy(np.int64)
    data = np.frombuffer(b"".join(payload) + b"\0" * 32, dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) + pos.to_numpy(np.int64)
    udata = user_data_len.to_numpy(np.int64)
    per_frame = (udata + 15) // 16
    frame = np.repeat(np.arange(len(sizes)), per_frame)
    nth = np.arange(len(frame)) - np.repeat(np.cumsum(per_frame) - per_frame, per_frame)
    start = np.concatenate((first, first[frame] + 10 + nth * 18))
    length = np.concatenate((np.full(len(first), 8), np.minimum(16, udata[frame] - nth * 16)))
    crc = np.zeros(len(start), dtype=np.int32)
    for i in range(16):
        value = crc >> 8 ^ table[(crc ^ data[np.minimum(start + i, len(data) - 1)]) & 255]
        crc = np.where(i < length, value, crc)
    stored = data[start + length].astype(np.int32) | data[start + length + 1].astype(np.int32) << 8
    wrong = (crc ^ 0xFFFF) != stored
    bad = np.bincount(
        np.concatenate((np.arange(len(first)), frame)), weights=wrong, minlength=len(first)
    )
    return pd.Series(bad == 0)


def poll_class(payload: Column, pos: Column, fc: Column, user_data_len: Column) -> Column:
    """What a READ asks for, by its first object header; null for anything else."""
    text = latin1(payload)
    group, variation = byte_at(text, pos + 14), byte_at(text, pos + 15)
    readable = (fc == 1) & (user_data_len >= 5)
    return (
        F.when(readable & (group == 60) & (variation == 1), F.lit("CLASS_0"))
        .when(readable & (group == 60) & variation.between(2, 4),
              F.concat(F.lit("CLASS_"), (variation - 1).cast("string")))
        .when(readable & (group == 0) & (variation == 240), F.lit("DEVICE_ATTRIBUTES"))
    )
