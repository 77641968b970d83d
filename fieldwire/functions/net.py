"""Address and port predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_H16 = r"[0-9A-Fa-f]{1,4}"
# Address with eight groups, or one '::' gap and at most seven groups around it.
_IPV6 = rf"^(?:{_H16}:){{7}}{_H16}$"
_IPV6_GAP = (
    rf"^(?!(?:(?:^|:+){_H16}(?=:|$)){{8}})"
    rf"(?:{_H16}(?::{_H16})*)?::(?:{_H16}(?::{_H16})*)?$"
)


def routable(ip: Column) -> Column:
    """False for loopback addresses and for text that is no address."""
    v4 = ip.rlike(_IPV4) & ~ip.startswith("127.")
    v6 = (ip.rlike(_IPV6) | ip.rlike(_IPV6_GAP)) & ~ip.rlike(
        r"^(?:0{1,4}:){7}0{0,3}1$|^[0:]*::[0:]*0{0,3}1$"
    )
    return F.coalesce(v4 | v6, F.lit(False))


def _whole(port: Column) -> Column:
    """Whole number from an INT, DOUBLE or text column, else null."""
    number = F.trim(port.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def port_of(port: Column) -> Column:
    """Port as INT; text that is no whole number counts as 0."""
    return F.coalesce(_whole(port), F.lit(0))


def touches_port(src_port: Column, dst_port: Column, port: int) -> Column:
    """Either end uses ``port``; 0 accepts every row. If either port is no number,
    both count as 0."""
    if not port:
        return F.lit(True)
    s, d = _whole(src_port), _whole(dst_port)
    return F.coalesce((s == port) | (d == port), F.lit(False)) & s.isNotNull() & d.isNotNull()


def canonical_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port"):
    """Columns of the direction-free flow key; ``is_ab`` tells the row's own direction."""
    a = F.struct(F.col(src_ip).alias("ip"), F.col(src_port).cast("int").alias("port"))
    b = F.struct(F.col(dst_ip).alias("ip"), F.col(dst_port).cast("int").alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return {
        "a_ip": lo["ip"], "a_port": lo["port"], "b_ip": hi["ip"], "b_port": hi["port"],
        "is_ab": a <= b,
    }


FLOW_KEY = ["a_ip", "a_port", "b_ip", "b_port"]
