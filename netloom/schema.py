"""The packet table: one row for each decoded packet, in order of packet_id (arrival)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece")
#: Bits of the flag byte.
MASKS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
FIELDS = (
    "packet_id", "timestamp_us", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", *(f"{f}_flag" for f in FLAGS), "flags",
    "data_length", "header_length", "length", "window_size", "sequence_number", "sequence_number_ack", "icmp_type", "icmp_code",
)
TEXT = ("source_ip", "destination_ip")
DDL = ", ".join(f"{f} {'string' if f in TEXT else 'long'}" for f in FIELDS)


def packets_of(df: DataFrame) -> DataFrame:
    """df as a packet table: missing fields are 0 (addresses 0.0.0.0, ICMP fields null), integers are 64 bits wide."""
    have = set(df.columns)

    def one(f: str):
        if f in have:
            x = F.col(f).cast("string" if f in TEXT else "long")
        elif f.startswith("icmp"):
            x = F.lit(None).cast("long")
        else:
            x = F.lit("0.0.0.0") if f in TEXT else F.lit(0).cast("long")
        return x.alias(f)

    return df.select(*[one(f) for f in FIELDS])
