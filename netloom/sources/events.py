"""Packet events of a live capture agent, as files, a stream or any table: normalised to packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import has_flag
from netloom.schema import MASKS, packets_of

_COMMON = "timestamp_ns long, port_destination int, port_source int, data_length int, length int, window_size int, combined_flags short, protocol short, header_length short, sequence_number long, sequence_number_ack long, icmp_type short, icmp_code short, direction string"
EVENT_V4 = f"event_id long, ipv4_source long, ipv4_destination long, {_COMMON}"
EVENT_V6 = f"event_id long, ipv6_source binary, ipv6_destination binary, {_COMMON}"


def ipv4_text(n: Column) -> Column:
    octet = lambda s: F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def ipv6_text(b: Column) -> Column:
    """Eight groups without leading zeros; the first longest run of two or more zero groups becomes ::."""
    h = F.lower(F.hex(b))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(h.substr(i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    runs = [":".join(["0"] * n) for n in range(8, 1, -1)]
    out = text
    for r in reversed(runs):
        pattern = rf"^(.*?)(?:^|(?<=:)){r}(?=:|$)"
        found = F.rlike(text, F.lit(rf"(^|:){r}(:|$)"))
        first = F.concat(F.regexp_extract(text, pattern, 1), F.lit("~"), F.regexp_replace(text, pattern, ""))
        out = F.when(found, F.regexp_replace(first, r":?~:?", "::")).otherwise(out)
    return out


def normalised(events: DataFrame, realtime_offset_us: int = 0, ingress_only: bool = False) -> DataFrame:
    """Packets of events of either address family. realtime_offset_us aligns the agent's monotonic clock."""
    if ingress_only:
        events = events.filter(F.col("direction") == "ingress")
    v4 = "ipv4_source" in events.columns
    text, family = (ipv4_text, "ipv4") if v4 else (ipv6_text, "ipv6")
    icmp = F.col("protocol") == (1 if v4 else 58)
    x = events.select(
        F.col("event_id").alias("packet_id"), (F.lit(realtime_offset_us) + F.expr("timestamp_ns div 1000")).alias("timestamp_us"),
        text(F.col(f"{family}_source")).alias("source_ip"), text(F.col(f"{family}_destination")).alias("destination_ip"), F.col("port_source").alias("source_port"), F.col("port_destination").alias("destination_port"), "protocol",
        *[has_flag(F.col("combined_flags").cast("long"), m).alias(f"{f}_flag") for f, m in MASKS.items()], F.col("combined_flags").alias("flags"),
        "data_length", "header_length", "length", "window_size", "sequence_number", "sequence_number_ack", F.when(icmp, F.col("icmp_type")).alias("icmp_type"), F.when(icmp, F.col("icmp_code")).alias("icmp_code"),
    )
    return packets_of(x)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All packets of several sources: address families, directions, queues."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out
