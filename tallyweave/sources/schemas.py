"""Schemas of the tables that go in and come out."""

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("cpu", T.IntegerType()),
        T.StructField("frame", T.BinaryType()),
        T.StructField("wire_len", T.IntegerType()),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("layer", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("value", T.LongType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

#: Verdicts of a packet.
PASS, ERROR_DROP, COUNTED = "PASS", "ERROR_DROP", "COUNTED"

ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_VLANS = (0x8100, 0x88A8)
PROTO_TCP, PROTO_UDP = 6, 17
