"""Feature families as Column expressions over segmented packets.

Window columns first (previous packet, islands), then plain aggregates. Everything is an expression, and only those that a
schema names are built, so a schema of few features has a small plan. The same aggregates serve whole flows (grouped) and snapshots (running windows).
"""

from __future__ import annotations

from collections.abc import Callable, Container

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.segment import ACTIVE, IDLE, SHUTDOWN
from netloom.schema import FLAGS

FLOW = ("key_a", "key_b", "protocol", "flow_seq")
SUBFLOW_US, ACTIVE_US, BULK_MS, BULK_PACKETS = 1_000_000, 5_000_000, 1000, 4
#: Packet types and codes of ICMP: requests, replies, errors, unreachable, for IPv4 and IPv6.
ICMP = {"echo_request": ((8,), (128,)), "echo_reply": ((0,), (129,)), "error": ((3, 4, 5, 11, 12), (1, 2, 3, 4)), "destination_unreachable": ((3,), (1,))}
#: What is known of a flow only from how it ends.
LIFECYCLE = ("close_cause", "close_ts", "handshake", "reset_before", "reset_after", "close_style")
PARTS = ("total", "mean", "std", "max", "min")


def prepared(seg: DataFrame, snapshots: bool = False, names: Container[str] | None = None) -> DataFrame:
    """Segmented packets with the columns that need neighbours, those only that the aggregates `names` read (all by default).

    An island's value (a bulk, an active period) stands on its last packet, if it was recorded: another island follows, or the
    flow was closed (by a timeout or at the end, not by FIN or RST). For snapshots, it stands on the packet that ended it.
    """
    flow = Window.partitionBy(*FLOW).orderBy("packet_id")
    side = Window.partitionBy(*FLOW, "is_fwd").orderBy("packet_id")
    before, upto = flow.rowsBetween(Window.unboundedPreceding, -1), flow.rowsBetween(Window.unboundedPreceding, 0)
    after, whole = flow.rowsBetween(1, Window.unboundedFollowing), flow.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ts, full, ms = F.col("timestamp_us"), F.col("length") > 0, F.expr("timestamp_us div 1000")
    reads = lambda *prefixes: names is None or any(n.startswith(prefixes) for n in names)
    active, bulk, quality = reads("active_", "idle_"), reads("fwd_bulk_", "bwd_bulk_"), reads("fwd_duplicate_", "bwd_duplicate_")

    one: dict[str, Column] = {}  # each step reads the columns of those before it
    if reads("iat_"):
        one["iat"] = (ts - F.lag(ts).over(flow)) / 1000.0
    if reads("fwd_iat_", "bwd_iat_"):
        one["side_iat"] = (ts - F.lag(ts).over(side)) / 1000.0
    if active or reads("subflow_"):
        one["gap_us"] = ts - F.lag(ts).over(flow)
    if active or bulk:
        one["closed"] = F.max("close_cause").over(whole).isin(ACTIVE, IDLE, SHUTDOWN)
    if quality:
        pure = (F.col("flags") == 16) & (F.col("data_length") == 0)
        same = F.lag(F.struct(pure.alias("pure"), "sequence_number_ack", "window_size")).over(side)
        one["dup_ack"] = (F.col("protocol") == 6) & pure & same["pure"] & (same["sequence_number_ack"] == F.col("sequence_number_ack")) & (same["window_size"] == F.col("window_size"))
    if bulk:
        one["bulk_at"] = F.when(full, F.struct(ms.alias("ms"), F.col("is_fwd").alias("fwd")))
    two, three, four, five = {}, {}, {}, {}
    if active:
        two["active_break"] = F.coalesce(F.col("gap_us") > ACTIVE_US, F.lit(False))
        three["active_no"] = F.sum(F.col("active_break").cast("long")).over(upto)
        island = Window.partitionBy(*FLOW, "active_no").orderBy("packet_id")
        four["active_us"] = ts - F.first("timestamp_us").over(island.rowsBetween(Window.unboundedPreceding, 0))
        if snapshots:
            five["idle_ms"] = F.when(F.col("active_break"), F.col("gap_us") / 1000.0)
            done = F.lag("active_us").over(flow)
            five["active_ms"] = F.when(F.col("active_break") & (done > 0), done / 1000.0)
        else:
            next_gap = F.lead("gap_us").over(flow)
            closing = F.when(F.col("close_cause") == IDLE, (F.col("close_ts") - ts) / 1000.0)
            five["idle_ms"] = F.when(next_gap.isNull(), closing).when(next_gap > ACTIVE_US, next_gap / 1000.0)
            ends = F.when(next_gap.isNull(), F.col("closed")).otherwise(next_gap > ACTIVE_US)
            five["active_ms"] = F.when(ends & (F.col("active_us") > 0), F.col("active_us") / 1000.0)
    if bulk:
        last = F.last("bulk_at", ignorenulls=True).over(before)
        two["bulk_break"] = full & (last.isNull() | (last["fwd"] != F.col("is_fwd")) | (ms - last["ms"] > BULK_MS))
        three["bulk_no"] = F.sum(F.col("bulk_break").cast("long")).over(upto)
        run = Window.partitionBy(*FLOW, "bulk_no").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
        four["bulk"] = F.when(full, F.struct(F.col("is_fwd").alias("fwd"), F.count(F.when(full, 1)).over(run).alias("packets"), F.sum(F.when(full, F.col("length"))).over(run).alias("bytes"), (ms - F.min(F.when(F.col("bulk_break"), ms)).over(run)).alias("ms")))
        if snapshots:
            ended = F.when(F.col("bulk_break"), F.last("bulk", ignorenulls=True).over(before))
        else:
            follows = F.first(F.when(full, F.col("bulk_break")), ignorenulls=True).over(after)
            ended = F.when(full & F.coalesce(follows, F.col("closed")), F.col("bulk"))
        five["bulk_done"] = F.when(ended["packets"] >= BULK_PACKETS, ended)
    for step in (one, two, three, four, five):
        if step:
            seg = seg.withColumns(step)
    return seg


On = Callable[[Column], Column]


def _plain(c: Column) -> Column:
    return c


Made = dict[str, Callable[[], Column]]
_STATS = {"total": F.sum, "mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min}


def stats(prefix: str, value: Callable[[], Column], on: On = _plain) -> Made:
    """Total, mean, population deviation, maximum, minimum and count; zeros where there is no value."""
    one = lambda f: lambda: F.coalesce(on(f(value().cast("double"))), F.lit(0.0))
    return {**{f"{prefix}_{k}": one(f) for k, f in _STATS.items()}, f"{prefix}_count": lambda: on(F.count(value()))}


def _makers(on: On) -> Made:
    """How every aggregate of a flow is made, by its internal name."""
    fwd = F.col("is_fwd")
    sides: dict[str, Callable[[], Column]] = {"fwd_": lambda: fwd, "bwd_": lambda: ~fwd}
    of = lambda f, *a: lambda: on(f(*a))
    zero = lambda f, missing=0: lambda: F.coalesce(on(f()), F.lit(missing))
    out: Made = {n: of(F.min_by, n, "packet_id") for n in ("source_ip", "source_port", "destination_ip", "destination_port")}
    out |= {"first_ts": of(F.min_by, "timestamp_us", "packet_id"), "last_ts": of(F.max_by, "timestamp_us", "packet_id"), "first_packet_id": of(F.min, "packet_id")}
    out |= {n: of(F.max, n) for n in LIFECYCLE}
    for name, column in (("packet_len", "length"), ("header_len", "header_length"), ("payload_len", "data_length"), ("window_size", "window_size")):
        out |= stats(name, lambda column=column: F.col(column), on)
        for p, mine in sides.items():
            out |= stats(f"{p}{name}", lambda column=column, mine=mine: F.when(mine(), F.col(column)), on)
    out |= stats("iat", lambda: F.col("iat"), on) | stats("active", lambda: F.col("active_ms"), on) | stats("idle", lambda: F.col("idle_ms"), on)
    for p, mine in sides.items():
        out |= stats(f"{p}iat", lambda mine=mine: F.when(mine(), F.col("side_iat")), on)
        for name, part in (("bulk_packets", "packets"), ("bulk_bytes", "bytes"), ("bulk_duration", "ms")):
            out |= stats(f"{p}{name}", lambda p=p, part=part: F.when(F.col("bulk_done.fwd") == (p == "fwd_"), F.col(f"bulk_done.{part}")), on)
        at = lambda mine=mine: F.when(mine(), F.col("packet_id"))
        counted = lambda c, mine=mine: lambda: on(F.count_if(mine() & c()))
        out[f"{p}first_ts"] = lambda at=at: on(F.min_by("timestamp_us", at()))
        out[f"{p}last_ts"] = lambda at=at: on(F.max_by("timestamp_us", at()))
        out[f"{p}init_window_size"] = zero(lambda at=at: F.min_by("window_size", at()))
        out[f"{p}non_zero_payload_packets"] = counted(lambda: F.col("data_length") > 0)
        out[f"{p}duplicate_ack_count"] = counted(lambda: F.col("dup_ack"))
        out[f"{p}zero_window_count"] = counted(lambda: (F.col("protocol") == 6) & (F.col("window_size") == 0))
        out[f"{p}retransmission_count"] = zero(lambda mine=mine: F.sum(F.when(mine(), F.col("retransmitted"))))
        for f in FLAGS:
            out[f"{p}{f}_flag_count"] = zero(lambda f=f, mine=mine: F.sum(F.when(mine(), F.col(f"{f}_flag"))))
    out["subflow_count"] = lambda: 1 + on(F.count_if(F.col("gap_us") > SUBFLOW_US))
    for n in ("icmp_type", "icmp_code"):
        out[n] = zero(lambda n=n: F.min_by(n, F.when(F.col("icmp_type").isNotNull(), F.col("packet_id"))), -1)
    for name, (v4, v6) in ICMP.items():
        out[f"icmp_{name}_count"] = lambda v4=v4, v6=v6: on(F.count_if(((F.col("protocol") == 1) & F.col("icmp_type").isin(*v4)) | ((F.col("protocol") == 58) & F.col("icmp_type").isin(*v6))))
    return out


#: Aggregates that a user adds to those of a flow, by name: expressions over a flow's segmented packets.
_added: dict[str, Callable[[], Column]] = {}


def add_aggregate(name: str, make: Callable[[], Column]) -> None:
    """Adds a feature to flows: make() gives an aggregate over the columns of segmented packets (schema.py, is_fwd, ...)."""
    _added[name] = make


def aggregates(on: On = _plain, names: Container[str] | None = None) -> dict[str, Column]:
    """The aggregates of a flow by internal name, those in `names` only if given; `on` is applied to each aggregate function (a window, or nothing)."""
    made = _makers(on) | {n: (lambda m=m: on(m())) for n, m in _added.items()}
    return {n: m() for n, m in made.items() if names is None or n in names}


def known() -> list[str]:
    """Names of all aggregates."""
    return [*_makers(_plain), *_added]


def flows(seg: DataFrame, names: Container[str] | None = None) -> DataFrame:
    """One row for each flow with its aggregates, those in `names` only if given."""
    return prepared(seg, names=names).groupBy(*FLOW).agg(*[c.alias(n) for n, c in (aggregates(names=names) or {"first_packet_id": F.min("packet_id")}).items()])


def _handshakes(x: DataFrame) -> DataFrame:
    """x with hand_so_far: 1 from the packet on that completes the TCP handshake, the forward ACK that answers the SYN+ACK that
    answered the last forward SYN."""
    upto = Window.partitionBy(*FLOW).orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    fwd = F.col("is_fwd")
    opening = F.when(fwd & (F.col("syn_flag") > 0) & (F.col("ack_flag") == 0), F.col("packet_id"))
    answer = F.when(~fwd & (F.col("syn_flag") > 0) & (F.col("ack_flag") > 0), F.struct("packet_id", ((F.col("sequence_number") + 1) % (1 << 32)).alias("want")))
    opened, answered = F.last(opening, ignorenulls=True).over(upto), F.last(answer, ignorenulls=True).over(upto)
    done = fwd & (F.col("ack_flag") > 0) & (F.col("syn_flag") == 0) & (answered["packet_id"] > opened) & (F.col("sequence_number_ack") == answered["want"]) & (F.col("protocol") == 6)
    return x.withColumn("hand_now", F.coalesce(done, F.lit(False)).cast("long")).withColumn("hand_so_far", F.max("hand_now").over(upto))


def snapshots(seg: DataFrame, early_export: int, names: Container[str] | None = None) -> DataFrame:
    """A row like those of flows() for every packet that finds its flow older than early_export whole seconds, as the flow
    stood then: cause None, close style none. Packets that end a flow by FIN or RST give none."""
    upto = Window.partitionBy(*FLOW).orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    x = _handshakes(prepared(seg, snapshots=True, names=names))
    own = {n: c for n, c in aggregates(lambda c: c.over(upto), names).items() if n not in LIFECYCLE}
    finished = F.coalesce(F.col("close_cause").startswith("TCP"), F.lit(False))
    begun = F.first("timestamp_us").over(upto)
    age = F.col("timestamp_us") - begun
    old = F.when(age >= 0, F.floor(age / 1_000_000) > early_export).otherwise(age <= -1_000_000)
    x = x.withColumn("shows", old & ~finished)
    zero = F.lit(0).cast("long")
    life = [F.lit("None").alias("close_cause"), F.lit(None).cast("long").alias("close_ts"), F.col("hand_so_far").alias("handshake"), zero.alias("reset_before"), zero.alias("reset_after"), F.lit("none").alias("close_style")]
    life = [c for c, n in zip(life, LIFECYCLE, strict=True) if names is None or n in names]
    rows = x.select(*FLOW, "shows", *[c.alias(n) for n, c in own.items()], *life, F.col("packet_id").alias("snapshot_packet_id"))
    return rows.filter("shows").drop("shows")
