"""Table schemas shared by sources, operators and streams."""

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BinaryType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW_PACKETS = _schema(file=_S, pkt_no=_L, ts_us=_L, link_type=_I, data=_B)

PACKETS = _schema(
    file=_S, pkt_no=_L, ts_us=_L, src_ip=_S, src_port=_I, dst_ip=_S, dst_port=_I, proto=_I,
    ip_len=_I, hdr_len=_I, tcp_flags=_I, win=_I, payload_len=_I, payload=_B,
)

ALERT_EVENT = _schema(
    event_type=_S, src_ip=_S, src_port=_I, dest_ip=_S, dest_port=_I,
    alert=_schema(signature_id=_L, signature=_S), ts_us=_L,
)

# Numbers arrive as text and are cast, so that one bad field does not lose its row.
CONTROL_FRAME = _schema(
    type=_S, point_id=_S, value=_S, seq=_S, timestamp=_S, outstation_time=_S, status=_S, code=_S,
)
