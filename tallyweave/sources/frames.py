"""Ethernet frames: bytes to flow columns and back, as JVM-side projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.net import fixed_hex
from tallyweave.sources import schemas as S

# Header lengths in bytes. The transport header is always looked for right after
# 20 bytes of IPv4 header; IP options are not skipped.
ETHERNET, VLAN_TAG, IPV4, TCP, UDP = 14, 4, 20, 20, 8


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PACKET).parquet(path)


def stream_packets(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A folder of packet tables as a stream of at most so many files a micro-batch."""
    return spark.readStream.schema(S.PACKET).option("maxFilesPerTrigger", files).parquet(path)


def _bytes_at(frame: Column, offset: Column | int, size: int) -> Column:
    """Bytes from an offset, fewer where the frame ends."""
    return F.substr(frame, (F.lit(offset) if isinstance(offset, int) else offset) + 1, F.lit(size))


def _binary(number: int, size: int) -> Column:
    return F.lit(number.to_bytes(size, "big"))


def _number(hex_digits: Column) -> Column:
    """Unsigned number of up to 15 hex digits."""
    return F.conv(hex_digits, 16, 10).cast("bigint")


def decode_frames(packets: DataFrame, frame: str = "frame") -> DataFrame:
    """Replace a ``frame`` column by the flow columns and a verdict.

    Up to two VLAN tags are stripped. A frame that is not IPv4 passes; one that
    is too short or carries neither TCP nor UDP is an error. Lengths decide which headers
    a frame really has; bytes that an EtherType lacks count as zero.

    Spark moves a filter on the verdict below all projections, where whatever it is made of stands once per use. So
    it only measures and compares bytes, and is short enough to be compiled; numbers are read apart from it.
    """
    data, size = F.col(frame), F.length(F.col(frame))
    vlans = [_binary(t, 2) for t in S.ETHERTYPE_VLANS]
    first, second = (_bytes_at(data, ETHERNET - 2 + VLAN_TAG * k, 2).isin(*vlans) for k in (0, 1))
    staged = packets.withColumn("vlan_depth", F.when(first, F.when(second, 2).otherwise(1)).otherwise(0))
    staged = staged.withColumn("_ip", ETHERNET + VLAN_TAG * F.col("vlan_depth"))

    ip = F.col("_ip")
    type_bytes, proto_byte = _bytes_at(data, ip - 2, 2), _bytes_at(data, ip + 9, 1)
    tcp, udp = (proto_byte == _binary(p, 1) for p in (S.PROTO_TCP, S.PROTO_UDP))
    is_ipv4 = type_bytes == _binary(S.ETHERTYPE_IPV4, 2)
    # Bytes that are not there equal nothing, so a cut header fails too; without TCP or UDP there is no length to reach.
    whole = size - F.when(tcp, TCP).when(udp, UDP) >= ip + IPV4
    verdict = F.when(is_ipv4 & whole, S.COUNTED).when((size >= ip) & ~is_ipv4, S.PASS).otherwise(S.ERROR_DROP)
    proto = F.when(tcp, S.PROTO_TCP).when(udp, S.PROTO_UDP)
    ether_type = _number(F.rpad(F.hex(type_bytes), 4, "0")).cast("int")
    staged = staged.withColumns({"ether_type": ether_type, "proto": proto, "verdict": verdict})

    ok = F.col("verdict") == S.COUNTED
    # Both addresses and both ports as two numbers of six bytes.
    staged = staged.withColumn("_hex", F.when(ok, F.hex(_bytes_at(data, ip + 12, 12))))
    staged = staged.withColumns({"_w0": _number(F.substring("_hex", 1, 12)), "_w1": _number(F.substring("_hex", 13, 12))})
    w0, w1 = F.col("_w0"), F.col("_w1")
    staged = staged.withColumns(
        {
            "src_ip": F.shiftright(w0, 16),
            "dst_ip": F.shiftleft(w0.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftright(w1, 32)),
            "src_port": F.shiftright(w1, 16).bitwiseAND(F.lit(0xFFFF)).cast("int"),
            "dst_port": w1.bitwiseAND(F.lit(0xFFFF)).cast("int"),
            "proto": F.when(ok, F.col("proto")),
        }
    )
    if "wire_len" not in packets.columns:
        staged = staged.withColumn("wire_len", size)
    return staged.withColumns(
        {
            "dst_mac": F.substring(data, 1, 6),
            "src_mac": F.substring(data, 7, 6),
        }
    ).drop(frame, "_hex", "_ip", "_w0", "_w1")


def encode_frames(
    flows: DataFrame,
    *,
    vlan_depth: Column | None = None,
    ether_type: Column | None = None,
    cut: Column | None = None,
) -> DataFrame:
    """Build a ``frame`` column from flow columns; the inverse of decoding.

    ``vlan_depth`` tags (the outer ones 802.1ad) precede ``ether_type``; ``cut``
    removes that many bytes from the end.
    """
    depth = F.lit(0) if vlan_depth is None else vlan_depth
    ether = F.lit(S.ETHERTYPE_IPV4) if ether_type is None else ether_type
    proto = F.col("proto")
    tail = F.when(proto == S.PROTO_TCP, TCP).when(proto == S.PROTO_UDP, UDP).otherwise(8)
    total = IPV4 + tail
    outer = F.repeat(F.lit("88A80001"), F.greatest(depth - 1, F.lit(0)))
    inner = F.when(depth > 0, F.lit("81000002")).otherwise(F.lit(""))
    hex_frame = F.concat(
        F.lit("020000000001" + "020000000002"),
        outer,
        inner,
        fixed_hex(ether, 4),
        F.lit("4500"),
        fixed_hex(total, 4),
        F.lit("0000" + "4000" + "40"),
        fixed_hex(proto, 2),
        F.lit("0000"),
        fixed_hex(F.col("src_ip"), 8),
        fixed_hex(F.col("dst_ip"), 8),
        fixed_hex(F.col("src_port"), 4),
        fixed_hex(F.col("dst_port"), 4),
        F.repeat(F.lit("00"), tail - 4),
    )
    frame = F.unhex(hex_frame)
    if cut is not None:
        frame = F.substr(frame, F.lit(1), F.length(frame) - cut)
    return flows.withColumn("frame", frame)
