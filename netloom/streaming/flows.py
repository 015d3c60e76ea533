"""Flows of a packet stream, with the batch operator's definitions.

State holds the packets of open flows, keyed by conversation; each micro-batch segments what is held and what has come, emits
the packets of flows that have ended, and keeps the rest. An event-time timer ends flows that fall silent. A flow's features
are then the same expressions as in batch, over the emitted packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.config import Config
from netloom.operators.segment import EXTRA, IDLE, KEY, SECOND, _Flow, keyed
from netloom.schema import DDL, FIELDS

OUT = f"{DDL}, key_a string, key_b string, {EXTRA}"
_INTS = ("timestamp_us", "packet_id")


def segmented_stream(packets: DataFrame, config: Config, delay: str = "0 seconds") -> DataFrame:
    """Packets of ended flows, marked as segmented() marks them. Late packets, behind the watermark, are dropped by Spark. A
    flow that falls silent ends at the time its timeout passed. flow_seq is the id of the flow's first packet. Snapshots of open
    flows (early_export) aren't built for streams."""
    if config.early_export is not None:
        raise ValueError("early_export isn't built for streams: packets come out when their flow has ended")
    active, idle = config.active_timeout, config.idle_timeout
    marks = [x.split()[0] for x in EXTRA.split(", ")]
    columns = [*FIELDS, "key_a", "key_b"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b[columns].itertuples(index=False, name=None)]
        held = list(state.get[0]) if state.exists else []
        held = [tuple(r) for r in held]
        merged = sorted({*held, *((*(None if v is None or v != v else v for v in r),) for r in rows)}, key=lambda r: r[0])
        out, open_rows = [], []
        flow: _Flow | None = None
        at = {c: i for i, c in enumerate(columns)}
        live: list[list] = []

        def end(cause: str, ts: int) -> None:
            live[-1][len(columns) + 3 :] = [cause, ts, flow.handshake, flow.before, flow.after, flow.style(cause)]
            out.extend(live)
            live.clear()

        for r in merged:
            ts = int(r[at["timestamp_us"]])
            if flow is not None and (cause := flow.expired(ts, active, idle)) is not None:
                end(cause, min(ts, _due(flow, active, idle)))
                flow = None
            source = (r[at["source_ip"]], r[at["source_port"]])
            if flow is None:
                flow, first_id = _Flow(ts, source, int(r[at["protocol"]])), int(r[0])
            fwd = source == flow.source
            v = lambda c: int(r[at[c]])  # noqa: B023, E731
            again = flow.packet(ts, v("packet_id"), fwd, v("fin_flag"), v("syn_flag"), v("rst_flag"), v("ack_flag"), v("flags"), v("data_length"), v("sequence_number"), v("sequence_number_ack"))
            live.append([*r, first_id, fwd, again, None, None, None, None, None, None])
            if flow.cause:
                end(flow.cause, ts)
                flow = None
        if flow is not None:
            due = _due(flow, active, idle)
            if state.hasTimedOut or state.getCurrentWatermarkMs() * 1000 >= due:
                end(flow.expired(due, active, idle) or IDLE, due)
                flow = None
        open_rows = [tuple(x[: len(columns)]) for x in live]
        if open_rows:
            state.update((open_rows,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, -(-_due(flow, active, idle) // 1000)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*columns, *marks])

    x = keyed(packets).withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", delay)
    state = "rows array<struct<" + ",".join(f"{f}:{'string' if f in ('source_ip', 'destination_ip') else 'bigint'}" for f in FIELDS) + ",key_a:string,key_b:string>>"
    return x.groupBy(*KEY).applyInPandasWithState(step, OUT, state, "append", GroupStateTimeout.EventTimeTimeout)


def _due(flow: _Flow, active: int, idle: int) -> int:
    """When the flow's first timeout passes."""
    return min(flow.first + (active + 1) * SECOND, flow.last + (idle + 1) * SECOND)


def packet_rate_stream(packets: DataFrame, width: str = "100 milliseconds", delay: str = "1 second") -> DataFrame:
    """Packets in each tumbling window of event time, as a stream."""
    x = packets.withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", delay)
    return x.groupBy(F.window("event_time", width).alias("w")).agg(F.count(F.lit(1)).alias("packets")).select(F.unix_micros("w.start").alias("bucket_us"), "packets")
