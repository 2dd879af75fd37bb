"""IPv4 addresses and packed flow keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Four decimal numbers without leading zeros; their range is checked separately.
_DOTTED = r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"


def ip_to_long(text: Column) -> Column:
    """Dotted IPv4 text as a bigint; null when it is not an address."""

    def append(ip: Column, part: Column) -> Column:
        octet = part.try_cast("bigint")
        return ip * 256 + F.when(octet <= 255, octet)

    value = F.aggregate(F.split(text, r"\."), F.lit(0).cast("bigint"), append)
    return F.when(text.rlike(_DOTTED), value)


def long_to_ip(ip: Column) -> Column:
    """A bigint address as dotted text."""
    return F.concat_ws(
        ".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def in_range_int(text: Column, top: int) -> Column:
    """Decimal text as an int in ``0..top``; null otherwise."""
    value = F.trim(text).try_cast("int")
    return F.when(value.between(0, top), value)


def fixed_hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def key_hex(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, proto: Column) -> Column:
    """The 13-byte big-endian flow key as 26 hex digits."""
    return F.concat(
        fixed_hex(src_ip, 8),
        fixed_hex(dst_ip, 8),
        fixed_hex(src_port, 4),
        fixed_hex(dst_port, 4),
        fixed_hex(proto, 2),
    )


def key_bytes(*fields: Column) -> Column:
    """The flow key as 13 bytes."""
    return F.unhex(key_hex(*fields))


def key_text(*fields: Column) -> Column:
    """Portable text of a key: its fields joined by ``|``."""
    return F.concat_ws("|", *[f.cast("string") for f in fields])
