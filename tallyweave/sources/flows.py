"""Keyed flow rows from ordinary tables, and the generated traffic pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.sources import schemas as S


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stream_table(spark: SparkSession, directory: str, name: str, schema: StructType, files: int) -> DataFrame:
    """A table as a stream of at most ``files`` files a micro-batch: those of its folder, or the table's one file.

    A file can be streamed by a pattern only; the one made here matches no other name.
    """
    path = f"{directory}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def l4_verdict(proto: Column) -> Column:
    """Verdict of an IPv4 packet by its protocol: only TCP and UDP are counted."""
    return F.when(proto.isin(S.PROTO_TCP, S.PROTO_UDP), F.lit(S.COUNTED)).otherwise(F.lit(S.ERROR_DROP))


def counted(flows: DataFrame) -> DataFrame:
    """Rows that enter summaries and counters."""
    return flows.filter(F.col("verdict") == S.COUNTED)


def final_action(verdict: Column, action: str = "DROP") -> Column:
    """What finally happens to a packet: counted ones are dropped or redirected."""
    if action not in ("DROP", "REDIRECT"):
        raise ValueError("action must be DROP or REDIRECT")
    return (
        F.when(verdict == S.PASS, F.lit("PASS"))
        .when(verdict == S.ERROR_DROP, F.lit("DROP"))
        .otherwise(F.lit(action))
    )


def flows_from_events(events: DataFrame) -> DataFrame:
    """Few heavy flows: one packet per event."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("packet_id"),
        F.col("ts"),
        (F.col("event_id") % 4).cast("int").alias("cpu"),
        (F.lit(3232235520).cast("bigint") + F.col("user_id")).alias("src_ip"),
        (F.lit(3232301056).cast("bigint") + F.length(kind)).alias("dst_ip"),
        (1024 + F.col("user_id") % 1000).cast("int").alias("src_port"),
        F.lit(5678).alias("dst_port"),
        F.when(kind == "error", F.lit(1)).when(kind.isin("purchase", "signup"), F.lit(6)).otherwise(F.lit(17)).alias("proto"),
        (64 + F.floor("value").cast("int") % 1400).cast("int").alias("wire_len"),
    ).withColumn("verdict", l4_verdict(F.col("proto")))


def flows_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Very many light flows: one packet per order line. Rows have no unique id."""
    flag = F.col("l_returnflag")
    return lineitem.select(
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") % 4).cast("int").alias("cpu"),
        (F.lit(167772160).cast("bigint") + F.col("l_suppkey")).alias("src_ip"),
        (F.lit(184549376).cast("bigint") + F.col("l_partkey")).alias("dst_ip"),
        (1024 + F.col("l_linenumber")).cast("int").alias("src_port"),
        F.when(flag == "A", F.lit(443)).when(flag == "N", F.lit(80)).otherwise(F.lit(53)).alias("dst_port"),
        F.when(F.col("l_linestatus") == "F", F.lit(6)).otherwise(F.lit(17)).alias("proto"),
        (64 + F.col("l_quantity").cast("int") * 28).cast("int").alias("wire_len"),
    ).withColumn("verdict", l4_verdict(F.col("proto")))


def synthetic_packets(ordinals: DataFrame, ordinal: str = "id") -> DataFrame:
    """Range traffic over a table of ordinals.

    One source address, destinations and destination ports that step through
    their ranges with the ordinal, 64-byte UDP packets.
    """
    # Fixed values of the traffic pattern: 192.168.0.1 -> 192.168.1.1-254,
    # ports 1234 -> 5678-10100.
    i = F.col(ordinal).cast("bigint")
    return ordinals.select(
        i.alias("packet_id"),
        F.lit(3232235521).cast("bigint").alias("src_ip"),
        (F.lit(3232235777).cast("bigint") + F.pmod(i, F.lit(254))).alias("dst_ip"),
        F.lit(1234).alias("src_port"),
        (5678 + F.pmod(i, F.lit(4423))).cast("int").alias("dst_port"),
        F.lit(S.PROTO_UDP).alias("proto"),
        F.lit(64).alias("wire_len"),
        F.lit(S.COUNTED).alias("verdict"),
    )
