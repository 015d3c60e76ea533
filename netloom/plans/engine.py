"""From packets to rows of a feature set."""

from __future__ import annotations

from collections.abc import Container

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import Config
from netloom.operators import features
from netloom.operators.segment import segmented
from netloom.plans.featuresets import FeatureSet, feature_set


def flows(packets: DataFrame, config: Config, names: Container[str] | None = None) -> DataFrame:
    """Aggregates of all flows, all or those in `names`, and of early snapshots if configured."""
    seg = segmented(packets, config, again=True)
    out = features.flows(seg, names)
    if config.early_export is not None:
        early = features.snapshots(seg, config.early_export, names)
        out = early.unionByName(out.withColumn("snapshot_packet_id", F.lit(None).cast("long")), allowMissingColumns=True)
    return out


def rows_of(packets: DataFrame, config: Config, fs: FeatureSet, clean: bool = False) -> DataFrame:
    """Rows of a feature set, from the aggregates that it names."""
    return fs.of(flows(packets, config, fs.reads(packets.sparkSession, clean)), clean)


def extract(packets: DataFrame, config: Config) -> DataFrame:
    """Rows of the configured feature set."""
    return rows_of(packets, config, feature_set(config.features), config.drop_contaminant_features)


def packet_rate(packets: DataFrame, width: str = "100 milliseconds") -> DataFrame:
    """Packets in each tumbling window of time."""
    at = F.timestamp_micros("timestamp_us")
    return packets.groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("packets")).select(F.unix_micros("w.start").alias("bucket_us"), "packets")


def last_buckets(rates: DataFrame, n: int = 100) -> DataFrame:
    """The n latest windows, oldest first: a top-n report."""
    return rates.orderBy(F.desc("bucket_us")).limit(n).orderBy("bucket_us")


def ordered_export(rows: DataFrame) -> DataFrame:
    """Flows by their first packet's time."""
    return rows.orderBy("first_ts", "first_packet_id")
