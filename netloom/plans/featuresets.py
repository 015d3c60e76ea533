"""Output schemas: named lists of expressions over a flow's aggregates, full and without identifying columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import net
from netloom.operators import features
from netloom.operators.features import PARTS
from netloom.schema import FLAGS


@dataclass(frozen=True)
class FeatureSet:
    """A schema of flow rows. Register one's own to add a feature set; its expressions read the aggregates of features.py.
    steps are columns that several expressions share, each step made from those before it."""

    name: str
    full: dict[str, Column]
    clean: dict[str, Column]
    steps: tuple[dict[str, Column], ...] = ()

    def of(self, flows: DataFrame, clean: bool = False) -> DataFrame:
        for step in self.steps:
            flows = flows.withColumns(step)
        return flows.select(*[c.alias(n) for n, c in (self.clean if clean else self.full).items()])

    def reads(self, spark: SparkSession, clean: bool = False) -> frozenset[str]:
        """Names of the aggregates that the schema is made of."""
        kind = lambda n: "string" if n in _TEXT else "double" if n.endswith(tuple(f"_{k}" for k in PARTS)) else "long"
        names = features.known()
        empty = spark.createDataFrame([], ", ".join(f"`{n}` {kind(n)}" for n in dict.fromkeys([*names, "key_a", "key_b", "protocol", "flow_seq"])))
        plan = self.of(empty, clean)._jdf.queryExecution().analyzed()
        found: set[str] = set()
        todo = [plan]
        while todo:
            node = todo.pop()
            found |= {a.name() for a in _each(node.references())}
            todo += list(_each(node.children()))
        return frozenset(found & set(names))


_TEXT = ("source_ip", "destination_ip", "close_cause", "close_style", "key_a", "key_b")


def _each(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _c(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _stats(*prefixes: str, parts: tuple[str, ...] = PARTS) -> dict[str, Column]:
    return _c(*(f"{p}_{k}" for p in prefixes for k in parts))


def _drop(d: dict[str, Column], *names: str) -> dict[str, Column]:
    return {k: v for k, v in d.items() if k not in names}


def _duration() -> Column:
    return F.col("last_ts") - F.col("first_ts")


def _ms(name: str) -> Column:
    return F.coalesce(F.col(name) / 1000.0, F.lit(0.0))


def _ports(source: str, destination: str) -> dict[str, Column]:
    return {source: net.iana_port(F.col("source_port")), destination: net.iana_port(F.col("destination_port"))}


def flow_id() -> Column:
    return net.flow_id(F.col("source_ip"), F.col("source_port"), F.col("destination_ip"), F.col("destination_port"), F.col("protocol"))


def total_flag(f: str) -> Column:
    return F.col(f"fwd_{f}_flag_count") + F.col(f"bwd_{f}_flag_count")


def flag_text() -> Column:
    letters = (("urg", "U"), ("ack", "A"), ("psh", "P"), ("rst", "R"), ("syn", "S"), ("fin", "F"))
    return F.concat(*[F.when(total_flag(f) > 0, x).otherwise(".") for f, x in letters])


def _rate(side: str) -> Column:
    return net.bulk_rate(F.col(f"{side}_bulk_bytes_total"), F.col(f"{side}_bulk_duration_total"), F.col(f"{side}_bulk_packets_count"))


def _basic() -> FeatureSet:
    full = {
        "flow_id": flow_id(), **_c("source_ip", "source_port", "destination_ip", "destination_port", "protocol"),
        "first_timestamp": net.utc_text(F.col("first_ts")), "last_timestamp": net.utc_text(F.col("last_ts")), "duration": _duration(), "flow_expire_cause": F.col("close_cause"),
    }
    clean = {**_ports("src_port_iana", "dst_port_iana"), **{k: full[k] for k in ("protocol", "duration", "flow_expire_cause")}}
    return FeatureSet("basic", full, clean)


def _cidds() -> FeatureSet:
    full = {
        "Src IP": F.col("source_ip"), "Src Port": F.col("source_port"), "Dst IP": F.col("destination_ip"), "Dst Port": F.col("destination_port"), "Proto": net.protocol_name(F.col("protocol")),
        "Date first seen": net.utc_text(F.col("first_ts")), "Duration": F.expr("(last_ts - first_ts) div 1000"), "Bytes": F.col("packet_len_total"), "Packets": F.col("packet_len_count"), "Flags": flag_text(),
    }
    clean = {**_ports("Src Port", "Dst Port"), **{k: full[k] for k in ("Proto", "Duration", "Bytes", "Packets", "Flags")}}
    return FeatureSet("cidds", full, clean)


ICMP_COUNTS = ("icmp_echo_request_count", "icmp_echo_reply_count", "icmp_error_count", "icmp_destination_unreachable_count")


def _custom() -> FeatureSet:
    full = {"flow_id": flow_id(), **_c("icmp_type", "icmp_code", *ICMP_COUNTS)}
    return FeatureSet("custom", full, _drop(full, "flow_id"))


def _wide() -> FeatureSet:
    scope = {s: F.col(f"__{s}_scope") for s in ("source", "destination")}
    address = {f"__{s}_{k}": f(F.col(f"{s}_ip")) for s in scope for k, f in (("v4", net.ipv4_number), ("v6", net.ipv6_bytes))}
    scopes = {f"__{s}_scope": net.scope_of(F.col(f"__{s}_v4"), F.col(f"__{s}_v6")) for s in scope}
    us = _duration()
    ids = {"flow_id": flow_id(), **_c("source_ip", "source_port", "destination_ip", "destination_port", "protocol")}
    head = {
        "ip_version": net.ip_version(F.col("source_ip")), "source_ip_scope": scope["source"], "destination_ip_scope": scope["destination"], "path_locality": net.path_locality(scope["source"], scope["destination"]),
        "timestamp_first": net.utc_text(F.col("first_ts")), "timestamp_last": net.utc_text(F.col("last_ts")), "flow_duration_us": us, "flow_expire_cause": F.col("close_cause"),
        "tcp_handshake_completed": F.col("handshake"), "tcp_reset_before_handshake": F.col("reset_before"), "tcp_reset_after_handshake": F.col("reset_after"), "tcp_close_style": F.col("close_style"),
    }
    timing = {
        "first_timestamp_fwd": _ms("fwd_first_ts"), "first_timestamp_bwd": _ms("bwd_first_ts"), "last_timestamp_fwd": _ms("fwd_last_ts"), "last_timestamp_bwd": _ms("bwd_last_ts"),
        "fwd_duration_ms": F.coalesce((F.col("fwd_last_ts") - F.col("fwd_first_ts")) / 1000.0, F.lit(0.0)), "bwd_duration_ms": F.coalesce((F.col("bwd_last_ts") - F.col("bwd_first_ts")) / 1000.0, F.lit(0.0)),
    }
    body = {
        **_stats("iat", "fwd_iat", "bwd_iat"),
        "packet_count": F.col("packet_len_count"), **_c(*(f"packet_len_{k}" for k in ("total", "mean", "max", "min", "std"))), "fwd_packet_count": F.col("fwd_packet_len_count"), "bwd_packet_count": F.col("bwd_packet_len_count"),
        **_stats("fwd_packet_len", "bwd_packet_len", "header_len", "fwd_header_len", "bwd_header_len", "payload_len"),
        "payload_len_variance": F.col("payload_len_std") * F.col("payload_len_std"), **_stats("fwd_payload_len", "bwd_payload_len"), **_c("fwd_non_zero_payload_packets", "bwd_non_zero_payload_packets"),
        "fwd_bulk_rate_s": _rate("fwd"), "bwd_bulk_rate_s": _rate("bwd"), "fwd_bulk_count": F.col("fwd_bulk_packets_count"), "bwd_bulk_count": F.col("bwd_bulk_packets_count"),
        **_stats("fwd_bulk_packets", "bwd_bulk_packets", "fwd_bulk_bytes", "bwd_bulk_bytes", "fwd_bulk_duration", "bwd_bulk_duration"),
        **_c("subflow_count"), **_stats("active", "idle"), **_c("icmp_type", "icmp_code", *ICMP_COUNTS),
    }
    for n in ("retransmission", "duplicate_ack", "zero_window"):
        body |= {f"flow_{n}_count": F.col(f"fwd_{n}_count") + F.col(f"bwd_{n}_count"), **_c(f"fwd_{n}_count", f"bwd_{n}_count")}
    body |= {**_c("fwd_init_window_size", "bwd_init_window_size"), **_stats("window_size", "fwd_window_size", "bwd_window_size")}
    body |= {**_c(*(f"{s}_{f}_flag_count" for s in ("fwd", "bwd") for f in FLAGS)), **{f"total_{f}_flag_count": total_flag(f) for f in FLAGS}, "flags": flag_text()}
    for name, p in (("flow", "payload_len"), ("fwd", "fwd_payload_len"), ("bwd", "bwd_payload_len")):
        body |= {f"{name}_bytes_s": net.per_second(F.col(f"{p}_total"), us), f"{name}_packets_s": net.per_second(F.col(f"{p}_count"), us)}
    for s in ("fwd", "bwd"):
        body |= {f"{s}_subflow_packets_mean": net.safe_div(F.col(f"{s}_payload_len_count"), F.col("subflow_count")), f"{s}_subflow_bytes_mean": net.safe_div(F.col(f"{s}_payload_len_total"), F.col("subflow_count"))}
    body["up_down_ratio"] = net.safe_div(F.col("bwd_payload_len_count"), F.col("fwd_payload_len_count"))
    clean_head = {**_ports("source_port_iana", "destination_port_iana"), **_c("protocol"), **_drop(head, "timestamp_first", "timestamp_last"), **{k: timing[k] for k in ("fwd_duration_ms", "bwd_duration_ms")}}
    return FeatureSet("wide", {**ids, **head, **timing, **body}, {**clean_head, **body}, (address, scopes))


def _cic() -> FeatureSet:
    us = _duration()
    label = {"max": "Max", "min": "Min", "mean": "Mean", "std": "Std", "total": "Total"}
    ids = {"Flow ID": flow_id(), "Src IP": F.col("source_ip"), "Src Port": F.col("source_port"), "Dst IP": F.col("destination_ip"), "Dst Port": F.col("destination_port"), "Protocol": F.col("protocol"), "Timestamp": net.utc_text(F.col("first_ts"))}
    d = {"Flow Duration": us, "TCP Handshake Completed": F.col("handshake"), "TCP Reset Before Handshake": F.col("reset_before"), "TCP Reset After Handshake": F.col("reset_after")}
    d |= {"Total Fwd Packet": F.col("fwd_payload_len_count"), "Total Bwd packets": F.col("bwd_payload_len_count"), "Total Length of Fwd Packet": F.col("fwd_payload_len_total"), "Total Length of Bwd Packet": F.col("bwd_payload_len_total")}
    for s in ("Fwd", "Bwd"):
        d |= {f"{s} Packet Length {label[k]}": F.col(f"{s.lower()}_payload_len_{k}") for k in ("max", "min", "mean", "std")}
    d |= {"Flow Bytes/s": net.per_second(F.col("payload_len_total"), us), "Flow Packets/s": net.per_second(F.col("payload_len_count"), us)}
    d |= {f"Flow IAT {label[k]}": F.col(f"iat_{k}") * 1000.0 for k in ("mean", "std", "max", "min")}
    for s in ("Fwd", "Bwd"):
        d |= {f"{s} IAT {label[k]}": F.col(f"{s.lower()}_iat_{k}") * 1000.0 for k in ("total", "mean", "std", "max", "min")}
    for f in ("psh", "urg", "rst"):
        d |= {f"{s} {f.upper()} Flags": F.col(f"{s.lower()}_{f}_flag_count") for s in ("Fwd", "Bwd")}
    d |= {f"{s} Header Length": F.col(f"{s.lower()}_header_len_total") for s in ("Fwd", "Bwd")}
    d |= {f"{s} Packets/s": net.per_second(F.col(f"{s.lower()}_payload_len_count"), us) for s in ("Fwd", "Bwd")}
    d |= {f"Packet Length {label[k]}": F.col(f"payload_len_{k}") for k in ("min", "max", "mean", "std")}
    d["Packet Length Variance"] = F.col("payload_len_std") * F.col("payload_len_std")
    d |= {f"{f.upper()} Flag Count": total_flag(f) for f in FLAGS}
    d |= {"Down/Up Ratio": net.safe_div(F.col("bwd_payload_len_count"), F.col("fwd_payload_len_count")), "Average Packet Size": F.col("payload_len_mean")}
    d |= {f"{s} Segment Size Avg": F.col(f"{s.lower()}_payload_len_mean") for s in ("Fwd", "Bwd")}
    for s in ("Fwd", "Bwd"):
        d |= {f"{s} Bytes/Bulk Avg": F.col(f"{s.lower()}_bulk_bytes_mean"), f"{s} Packet/Bulk Avg": F.col(f"{s.lower()}_bulk_packets_mean"), f"{s} Bulk Rate Avg": _rate(s.lower())}
    for s in ("Fwd", "Bwd"):
        d |= {f"Subflow {s} Packets": net.safe_div(F.col(f"{s.lower()}_payload_len_count"), F.col("subflow_count")), f"Subflow {s} Bytes": net.safe_div(F.col(f"{s.lower()}_payload_len_total"), F.col("subflow_count"))}
    d |= {"FWD Init Win Bytes": F.col("fwd_init_window_size"), "Bwd Init Win Bytes": F.col("bwd_init_window_size")}
    d |= {f"{s} Act Data Pkts": F.col(f"{s.lower()}_non_zero_payload_packets") for s in ("Fwd", "Bwd")}
    d |= {f"{s} Seg Size Min": F.col(f"{s.lower()}_header_len_min") for s in ("Fwd", "Bwd")}
    d |= {f"{n} {label[k]}": F.col(f"{n.lower()}_{k}") for n in ("Active", "Idle") for k in ("mean", "std", "max", "min")}
    d |= {"ICMP Code": F.col("icmp_code"), "ICMP Type": F.col("icmp_type")}
    d |= dict(zip(("ICMP Echo Request Count", "ICMP Echo Reply Count", "ICMP Error Count", "ICMP Destination Unreachable Count"), map(F.col, ICMP_COUNTS), strict=True))
    d |= {f"{s} TCP Retrans. Count": F.col(f"{s.lower()}_retransmission_count") for s in ("Fwd", "Bwd")}
    d |= {"Total TCP Retrans. Count": F.col("fwd_retransmission_count") + F.col("bwd_retransmission_count"), "Total Connection Flow Time": us}
    return FeatureSet("cic", {**ids, **d}, {**_ports("Src Port", "Dst Port"), "Protocol": F.col("protocol"), **d})


def _nfstream() -> FeatureSet:
    sides = (("bidirectional", ""), ("src2dst", "fwd_"), ("dst2src", "bwd_"))
    d = {"id": flow_id(), "expiration_id": net.expiration_id(F.col("close_cause")), "src_ip": F.col("source_ip"), "src_port": F.col("source_port"), "dst_ip": F.col("destination_ip"), "dst_port": F.col("destination_port"), "protocol": F.col("protocol"), "ip_version": net.ip_version(F.col("source_ip"))}
    d |= {"bidirectional_first_seen_ms": F.expr("first_ts div 1000"), "bidirectional_last_seen_ms": F.expr("last_ts div 1000"), "bidirectional_duration_ms": F.expr("(last_ts - first_ts) div 1000"), "bidirectional_packets": F.col("packet_len_count"), "bidirectional_bytes": F.col("packet_len_total")}
    for n, p in sides[1:]:
        d |= {f"{n}_first_seen_ms": _ms(f"{p}first_ts"), f"{n}_last_seen_ms": _ms(f"{p}last_ts"), f"{n}_duration_ms": F.coalesce((F.col(f"{p}last_ts") - F.col(f"{p}first_ts")) / 1000.0, F.lit(0.0)), f"{n}_packets": F.col(f"{p}packet_len_count"), f"{n}_bytes": F.col(f"{p}packet_len_total")}
    kinds = (("min", "min"), ("mean", "mean"), ("stddev", "std"), ("max", "max"))
    d |= {f"{n}_{a}_ps": F.col(f"{p}packet_len_{b}") for n, p in sides for a, b in kinds}
    d |= {f"{n}_{a}_piat_ms": F.col(f"{p}iat_{b}") for n, p in sides for a, b in kinds}
    d |= {f"{n}_{f}_packets": total_flag(f) if not p else F.col(f"{p}{f}_flag_count") for n, p in sides for f in ("syn", "cwr", "ece", "urg", "ack", "psh", "rst", "fin")}
    gone = ("id", "expiration_id", "src_ip", "dst_ip", "src_port", "dst_port", *(k for k in d if k.endswith("_seen_ms")))
    return FeatureSet("nfstream", d, {**_ports("src_port_iana", "dst_port_iana"), **_drop(d, *gone)})


_makers = {"basic": _basic, "cic": _cic, "cidds": _cidds, "nfstream": _nfstream, "wide": _wide, "custom": _custom}
_made: dict[str, FeatureSet] = {}


def feature_set(name: str) -> FeatureSet:
    if name not in _made:
        if name not in _makers:
            raise ValueError(f"features must be one of {', '.join([*_makers, *_made])}")
        _made[name] = _makers[name]()
    return _made[name]


def register(fs: FeatureSet) -> None:
    """Makes a feature set known by its name, for options and the command line, too."""
    _made[fs.name] = fs
