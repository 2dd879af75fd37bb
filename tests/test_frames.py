import pytest
from pyspark.sql import functions as F

from tallyweave.sources import frames

ETH = bytes.fromhex("020000000001020000000002")
SRC, DST = bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])


def ip(proto):
    return bytes.fromhex("450000280000400040") + bytes([proto]) + b"\0\0" + SRC + DST


TCP = (443).to_bytes(2, "big") + (50000).to_bytes(2, "big") + bytes(16)
UDP = (53).to_bytes(2, "big") + (1024).to_bytes(2, "big") + bytes(4)
V4, V6, ARP = b"\x08\x00", b"\x86\xdd", b"\x08\x06"
Q, AD = b"\x81\x00\x00\x05", b"\x88\xa8\x00\x06"

LAYOUTS = {
    "tcp": (ETH + V4 + ip(6) + TCP, 0, "COUNTED", 443),
    "udp": (ETH + V4 + ip(17) + UDP, 0, "COUNTED", 53),
    "one_tag": (ETH + Q + V4 + ip(17) + UDP, 1, "COUNTED", 53),
    "two_tags": (ETH + AD + Q + V4 + ip(6) + TCP, 2, "COUNTED", 443),
    "three_tags": (ETH + AD + Q + Q + V4 + ip(6) + TCP, 2, "PASS", None),
    "arp": (ETH + ARP + bytes(28), 0, "PASS", None),
    "ipv6": (ETH + V6 + bytes(48), 0, "PASS", None),
    "icmp": (ETH + V4 + ip(1) + bytes(8), 0, "ERROR_DROP", None),
    "short_tcp": ((ETH + V4 + ip(6) + TCP)[:-1], 0, "ERROR_DROP", None),
    "short_udp": ((ETH + V4 + ip(17) + UDP)[:-1], 0, "ERROR_DROP", None),
    "short_two_tags": ((ETH + AD + Q + V4 + ip(6) + TCP)[:-1], 2, "ERROR_DROP", None),
    "short_ip": ((ETH + V4 + ip(6))[:-1], 0, "ERROR_DROP", None),
    "short_tag": (ETH + Q, 1, "ERROR_DROP", None),
    "short_ethernet": (ETH + b"\x08", 0, "ERROR_DROP", None),
    "empty": (b"", 0, "ERROR_DROP", None),
    "longer_udp": (ETH + V4 + ip(17) + UDP + bytes(1500), 0, "COUNTED", 53),
}


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(name, bytearray(f[0])) for name, f in LAYOUTS.items()]
    df = spark.createDataFrame(rows, "name string, frame binary")
    return {r["name"]: r for r in frames.decode_frames(df).collect()}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(decoded, name):
    frame, depth, verdict, port = LAYOUTS[name]
    r = decoded[name]
    assert (r.vlan_depth, r.verdict, r.wire_len) == (depth, verdict, len(frame))
    assert r.src_port == port
    if verdict == "COUNTED":
        assert (r.src_ip, r.dst_ip) == (0x0A000001, 0x0A000002)
        assert r.proto in (6, 17)
    else:
        assert (r.src_ip, r.dst_ip, r.dst_port, r.proto) == (None, None, None, None)


def test_encode_then_decode(spark, skewed):
    back = frames.decode_frames(
        frames.encode_frames(skewed.limit(500), vlan_depth=(F.col("packet_id") % 3).cast("int")).drop(
            "src_ip", "dst_ip", "src_port", "dst_port", "proto", "verdict"
        )
    )
    keys = ["packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "verdict"]
    assert back.select(keys).exceptAll(skewed.limit(500).select(keys)).count() == 0
    assert back.count() == 500


def test_decoding_needs_no_python(spark):
    df = spark.createDataFrame([("x", bytearray(LAYOUTS["tcp"][0]))], "name string, frame binary")
    assert "Python" not in frames.decode_frames(df)._jdf.queryExecution().executedPlan().toString()


def test_a_filter_on_the_verdict_stays_short(spark):
    """Spark moves it below the projections; there it reads no numbers and compares few bytes."""
    df = spark.createDataFrame([("x", bytearray(LAYOUTS["tcp"][0])), ("none", None)], "name string, frame binary")
    counted = frames.decode_frames(df).filter(F.col("verdict") == "COUNTED")
    plan = counted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [line for line in plan if "Filter" in line]
    assert len(filters) == 1
    assert "conv(" not in filters[0] and filters[0].count("substr") <= 24
    assert [r["name"] for r in counted.collect()] == ["x"]


def test_every_cut_of_a_frame(spark):
    """All lengths of all layouts: a verdict as of the headers that are there, an EtherType with zeros for what is not."""
    whole = {name: f[0] for name, f in LAYOUTS.items() if len(f[0]) < 100}
    rows = [(name, n, bytearray(f[:n])) for name, f in whole.items() for n in range(len(f) + 1)]
    found = frames.decode_frames(spark.createDataFrame(rows, "name string, n int, frame binary")).collect()
    assert len(found) == len(rows)
    for r in found:
        frame, ip = whole[r.name][: r.n], 14
        while ip < 22 and frame[ip - 2 : ip] in (b"\x81\x00", b"\x88\xa8"):
            ip += 4
        ether_type = int.from_bytes(frame[ip - 2 : ip].ljust(2, b"\0"), "big")
        proto = frame[ip + 9] if len(frame) > ip + 9 else None
        if len(frame) >= ip and ether_type != 0x0800:
            verdict = "PASS"
        else:
            verdict = "COUNTED" if proto in (6, 17) and len(frame) >= ip + 20 + {6: 20, 17: 8}[proto] else "ERROR_DROP"
        counted = verdict == "COUNTED"
        assert (r.vlan_depth, r.ether_type, r.verdict) == ((ip - 14) // 4, ether_type, verdict)
        assert (r.proto, r.src_ip) == ((proto, 0x0A000001) if counted else (None, None))
