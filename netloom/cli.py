"""python -m netloom.cli -f wide -o csv --export-path out pcap capture.pcap"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from netloom import sinks
from netloom.config import from_args, parser, to_toml
from netloom.plans import engine
from netloom.sources import events, pcap


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    config = from_args(args)
    if args.save_config:
        to_toml(config, args.save_config)
    spark = SparkSession.builder.appName("netloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    packets = pcap.packets(spark, args.path) if args.command == "pcap" else events.normalised(spark.read.parquet(args.path), ingress_only=args.ingress_only)
    rows = engine.extract(packets, config)
    if config.output == "csv":
        sinks.write_csv(rows, config.export_path, config.header)
    else:
        sinks.show(rows, config.header)
    if config.packet_graph:
        engine.last_buckets(engine.packet_rate(packets)).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
