"""The same queries in SQL for DuckDB: a recursive walk over each conversation's packets, then windows and aggregates."""

from __future__ import annotations

from netloom.operators.features import ICMP, PARTS
from netloom.schema import FLAGS
from netloom.sources.derived import DUCKDB


def walk(active: int, idle: int, interval: int | None = None) -> str:
    """CTEs p (packets), s (packets with flow_seq, is_fwd and, on a flow's last packet, why and when it ended). With an interval,
    the clock's ticks (the first packet, then each that is at least so many seconds later) look for expired flows, too."""
    due = "least(first0 + {a}, last0 + {i})".format(a=(active + 1) * 1_000_000, i=(idle + 1) * 1_000_000)
    ticks = f"""tk AS (SELECT min(packet_id) AS id, arg_min(timestamp_us, packet_id) AS ts FROM p UNION ALL
  SELECT n.packet_id, n.timestamp_us FROM tk JOIN p n ON n.packet_id = (SELECT min(o.packet_id) FROM p o WHERE o.packet_id > tk.id AND o.timestamp_us >= tk.ts + {(interval or 0) * 1_000_000})),
ticks AS MATERIALIZED (SELECT list({{'id': id, 'ts': ts}} ORDER BY id) AS all_ticks FROM tk),""" if interval is not None else "ticks AS (SELECT CAST([] AS STRUCT(id BIGINT, ts BIGINT)[]) AS all_ticks),"
    first_due = lambda d: f"list_filter(all_ticks, lambda x: x.ts >= {d})[1]"
    return f"""
WITH RECURSIVE p AS MATERIALIZED ({DUCKDB}),
{ticks}
k AS MATERIALIZED (SELECT *, source_ip || '|' || source_port AS src, least(source_ip || '|' || source_port, destination_ip || '|' || destination_port) AS a, greatest(source_ip || '|' || source_port, destination_ip || '|' || destination_port) AS b,
  row_number() OVER (PARTITION BY least(source_ip || '|' || source_port, destination_ip || '|' || destination_port), greatest(source_ip || '|' || source_port, destination_ip || '|' || destination_port), protocol ORDER BY packet_id) AS rn FROM p),
r AS (
  SELECT DISTINCT a, b, protocol, 0::BIGINT AS rn, -1::BIGINT AS seq, 0::BIGINT AS first_ts, 0::BIGINT AS last_ts, '' AS fsrc, 'none' AS term, NULL::VARCHAR AS ex, NULL::BIGINT AS ex_ts, true AS is_fwd, 0 AS hs, 0 AS syn, 0 AS sa, NULL::BIGINT AS hand,
    0 AS ff, 0 AS fb, NULL::BIGINT AS askf, NULL::BIGINT AS askb, 0 AS sf, 0 AS sb, 0 AS crossed, 0 AS rb, 0 AS ra FROM k
  UNION ALL
  SELECT a, b, protocol, rn, seq, first_ts, ts, fsrc, term5, ex, ex_ts, fwd, hs2, syn2, sa2, hand2, ff4, fb4, askf3, askb3, sf3, sb3, crossed3, rb5, ra5 FROM (
  SELECT *, CASE WHEN term4 <> '' THEN term4 WHEN tcp AND rst = 1 THEN 'TCP Reset' ELSE '' END AS term5,
    CASE WHEN term4 = '' AND tcp AND rst = 1 AND hs2 = 0 THEN 1 ELSE 0 END AS rb5, CASE WHEN term4 = '' AND tcp AND rst = 1 AND hs2 = 1 THEN 1 ELSE 0 END AS ra5 FROM (
  SELECT *, CASE WHEN ff4 = 2 AND fb4 = 2 THEN 'TCP Normal Termination' ELSE '' END AS term4 FROM (
  SELECT *, CASE WHEN fb3 = 1 AND fwd AND acked = askf3 THEN 2 ELSE fb3 END AS fb4, CASE WHEN NOT (fb3 = 1 AND fwd AND coalesce(acked = askf3, false)) AND ff3 = 1 AND NOT fwd AND acked = askb3 THEN 2 ELSE ff3 END AS ff4 FROM (
  SELECT *, CASE WHEN fin = 1 AND ((fwd AND fb1 = 1) OR (NOT fwd AND ff1 = 1)) THEN 1 ELSE crossed1 END AS crossed3,
    CASE WHEN fin = 1 AND fwd THEN 1 ELSE sf1 END AS sf3, CASE WHEN fin = 1 AND NOT fwd THEN 1 ELSE sb1 END AS sb3, CASE WHEN fin = 1 AND fwd THEN 1 ELSE ff1 END AS ff3, CASE WHEN fin = 1 AND NOT fwd THEN 1 ELSE fb1 END AS fb3,
    CASE WHEN fin = 1 AND fwd THEN (sq + len + 1) % 4294967296 ELSE askb1 END AS askb3, CASE WHEN fin = 1 AND NOT fwd THEN (sq + len + 1) % 4294967296 ELSE askf1 END AS askf3 FROM (
  SELECT *, CASE WHEN opens THEN 1 ELSE syn1 END AS syn2, CASE WHEN opens THEN 0 WHEN answers THEN 1 ELSE sa1 END AS sa2, CASE WHEN opens THEN NULL WHEN answers THEN (sq + 1) % 4294967296 ELSE hand1 END AS hand2,
    CASE WHEN NOT opens AND NOT answers AND tcp AND hs1 = 0 AND fwd AND syn1 = 1 AND sa1 = 1 AND ack = 1 AND sy = 0 AND acked = hand1 THEN 1 ELSE hs1 END AS hs2 FROM (
  SELECT *, tcp AND hs1 = 0 AND fwd AND sy = 1 AND ack = 0 AS opens, tcp AND hs1 = 0 AND NOT fwd AND syn1 = 1 AND sy = 1 AND ack = 1 AS answers FROM (
  SELECT a, b, protocol, rn, ts, ex, ex_ts, fin, sy, rst, ack, sq, acked, len, protocol = 6 AS tcp, seq0 + CASE WHEN fresh THEN 1 ELSE 0 END AS seq, CASE WHEN fresh THEN ts ELSE first0 END AS first_ts, CASE WHEN fresh THEN src ELSE fsrc0 END AS fsrc, fresh OR src = fsrc0 AS fwd,
    CASE WHEN fresh THEN 0 ELSE hs0 END AS hs1, CASE WHEN fresh THEN 0 ELSE syn0 END AS syn1, CASE WHEN fresh THEN 0 ELSE sa0 END AS sa1, CASE WHEN fresh THEN NULL ELSE hand0 END AS hand1, CASE WHEN fresh THEN 0 ELSE ff0 END AS ff1, CASE WHEN fresh THEN 0 ELSE fb0 END AS fb1,
    CASE WHEN fresh THEN NULL ELSE askf0 END AS askf1, CASE WHEN fresh THEN NULL ELSE askb0 END AS askb1, CASE WHEN fresh THEN 0 ELSE sf0 END AS sf1, CASE WHEN fresh THEN 0 ELSE sb0 END AS sb1, CASE WHEN fresh THEN 0 ELSE crossed0 END AS crossed1 FROM (
  SELECT *, dead OR ex IS NOT NULL AS fresh FROM (
  SELECT *, CASE WHEN dead THEN NULL WHEN (seen - first0) // 1000000 > {active} THEN 'Active Timeout' WHEN (seen - last0) // 1000000 > {idle} THEN 'Idle Timeout' END AS ex, seen AS ex_ts FROM (
  SELECT *, CASE WHEN tick.id <= number THEN tick.ts ELSE ts END AS seen FROM (SELECT *, {first_due(due)} AS tick FROM (
  SELECT ticks.all_ticks, k.packet_id AS number, k.a, k.b, k.protocol, k.rn, k.src, k.timestamp_us AS ts, k.fin_flag AS fin, k.syn_flag AS sy, k.rst_flag AS rst, k.ack_flag AS ack, k.sequence_number AS sq, k.sequence_number_ack AS acked, k.data_length AS len, r.term <> '' AS dead,
    r.seq AS seq0, r.first_ts AS first0, r.last_ts AS last0, r.fsrc AS fsrc0, r.hs AS hs0, r.syn AS syn0, r.sa AS sa0, r.hand AS hand0, r.ff AS ff0, r.fb AS fb0, r.askf AS askf0, r.askb AS askb0, r.sf AS sf0, r.sb AS sb0, r.crossed AS crossed0
  FROM r JOIN k ON k.a = r.a AND k.b = r.b AND k.protocol = r.protocol AND k.rn = r.rn + 1 CROSS JOIN ticks))))))))))))
),
m AS MATERIALIZED (SELECT k.*, {first_due(due.replace('first0', 'r.first_ts').replace('last0', 'r.last_ts'))} AS end_tick, r.first_ts AS begun, r.seq AS flow_seq, r.is_fwd, r.term, r.hs, r.rb, r.ra, r.ff, r.fb, r.sf, r.sb, r.crossed,
  lead(r.seq) OVER q IS DISTINCT FROM r.seq AS is_last, lead(r.ex) OVER q AS next_ex, lead(r.ex_ts) OVER q AS next_ts, lead(r.seq) OVER q IS NULL AS is_end
  FROM r JOIN k ON k.a = r.a AND k.b = r.b AND k.protocol = r.protocol AND k.rn = r.rn CROSS JOIN ticks WINDOW q AS (PARTITION BY r.a, r.b, r.protocol ORDER BY r.rn)),
c AS (SELECT *, CASE WHEN NOT is_last THEN NULL WHEN term <> '' THEN term WHEN is_end AND end_tick IS NULL THEN 'Exporter Shutdown' WHEN is_end THEN CASE WHEN (end_tick.ts - begun) // 1000000 > {active} THEN 'Active Timeout' ELSE 'Idle Timeout' END ELSE next_ex END AS close_cause,
  CASE WHEN NOT is_last THEN NULL WHEN term <> '' THEN timestamp_us WHEN is_end THEN coalesce(end_tick.ts, (SELECT arg_max(timestamp_us, packet_id) FROM p)) ELSE next_ts END AS close_ts FROM m),
s AS MATERIALIZED (SELECT *, CASE WHEN close_cause IS NULL THEN NULL WHEN protocol <> 6 THEN 'not_applicable' WHEN close_cause = 'TCP Reset' THEN 'reset' WHEN sf = 1 AND sb = 1 THEN CASE WHEN ff = 2 AND fb = 2 THEN CASE WHEN crossed = 1 THEN 'simultaneous_fin' ELSE 'four_way_fin' END ELSE 'bidirectional_fin' END
    WHEN sf = 1 OR sb = 1 THEN 'half_close' WHEN close_cause IS NOT NULL THEN 'none' END AS close_style,
  max(close_cause) OVER (PARTITION BY a, b, protocol, flow_seq) IN ('Active Timeout', 'Idle Timeout', 'Exporter Shutdown') AS closed FROM c)
"""


PREPARED = """,
w1 AS (SELECT *, timestamp_us // 1000 AS ms, timestamp_us - lag(timestamp_us) OVER f AS gap_us, (timestamp_us - lag(timestamp_us) OVER d) / 1000.0::DOUBLE AS side_iat,
  protocol = 6 AND flags = 16 AND data_length = 0 AND coalesce(lag(CASE WHEN flags = 16 AND data_length = 0 THEN sequence_number_ack END) OVER d = sequence_number_ack, false) AND coalesce(lag(window_size) OVER d = window_size, false) AS dup_ack,
  lag(is_fwd) OVER f AS prev_fwd, lead(timestamp_us) OVER f - timestamp_us AS next_gap,
  CASE WHEN protocol = 6 AND NOT (flags = 16 AND data_length = 0) THEN data_length + flags // 2 % 2 + flags % 2 ELSE 0 END AS seg
  FROM s WINDOW f AS (PARTITION BY a, b, protocol, flow_seq ORDER BY packet_id), d AS (PARTITION BY a, b, protocol, flow_seq, is_fwd ORDER BY packet_id)),
w2 AS (SELECT *, sum(CASE WHEN gap_us > 5000000 THEN 1 ELSE 0 END) OVER f AS active_no, sum(CASE WHEN prev_fwd IS NULL OR prev_fwd <> is_fwd OR ms - lag_ms > 1000 THEN 1 ELSE 0 END) OVER f AS bulk_no
  FROM (SELECT *, lag(ms) OVER (PARTITION BY a, b, protocol, flow_seq ORDER BY packet_id) AS lag_ms FROM w1) WINDOW f AS (PARTITION BY a, b, protocol, flow_seq ORDER BY packet_id)),
w3 AS (SELECT *, min(timestamp_us) OVER i AS active_from, lead(bulk_no) OVER f AS next_bulk, count(*) OVER bk AS bulk_n, sum(length) OVER bk AS bulk_b, ms - min(ms) OVER bk AS bulk_ms,
  (seg > 0 AND EXISTS (SELECT 1 FROM w1 o WHERE o.a = w2.a AND o.b = w2.b AND o.protocol = w2.protocol AND o.flow_seq = w2.flow_seq AND o.is_fwd = w2.is_fwd AND o.packet_id < w2.packet_id AND o.seg > 0
    AND o.sequence_number < w2.sequence_number + w2.seg AND w2.sequence_number < o.sequence_number + o.seg)) AS retransmitted
  FROM w2 WINDOW f AS (PARTITION BY a, b, protocol, flow_seq ORDER BY packet_id), i AS (PARTITION BY a, b, protocol, flow_seq, active_no ORDER BY packet_id), bk AS (PARTITION BY a, b, protocol, flow_seq, bulk_no ORDER BY packet_id)),
x AS (SELECT *, gap_us / 1000.0::DOUBLE AS iat, CASE WHEN next_gap IS NULL THEN CASE WHEN close_cause = 'Idle Timeout' THEN (close_ts - timestamp_us) / 1000.0::DOUBLE END WHEN next_gap > 5000000 THEN next_gap / 1000.0::DOUBLE END AS idle_ms,
  CASE WHEN (next_gap > 5000000 OR (next_gap IS NULL AND closed)) AND timestamp_us > active_from THEN (timestamp_us - active_from) / 1000.0::DOUBLE END AS active_ms,
  bulk_n >= 4 AND (next_bulk <> bulk_no OR (next_bulk IS NULL AND closed)) AS bulk_done FROM w3)
"""


def _stats(name: str, value: str) -> list[str]:
    fs = {"total": "sum", "mean": "avg", "std": "stddev_pop", "max": "max", "min": "min"}
    return [f"coalesce({fs[k]}(CAST({value} AS DOUBLE)), 0.0::DOUBLE) AS {name}_{k}" for k in PARTS] + [f"count({value}) AS {name}_count"]


def _flows() -> str:
    out = ["arg_min(source_ip, packet_id) AS source_ip", "arg_min(destination_ip, packet_id) AS destination_ip", "arg_min(source_port, packet_id) AS source_port", "arg_min(destination_port, packet_id) AS destination_port"]
    out += ["arg_min(timestamp_us, packet_id) AS first_ts", "arg_max(timestamp_us, packet_id) AS last_ts", "min(packet_id) AS first_packet_id", "max(close_cause) AS close_cause", "max(close_ts) AS close_ts", "max(close_style) AS close_style"]
    out += [f"CAST(max(CASE WHEN is_last THEN {c} END) AS BIGINT) AS {n}" for n, c in (("handshake", "hs"), ("reset_before", "rb"), ("reset_after", "ra"))]
    sides = (("fwd_", "is_fwd"), ("bwd_", "NOT is_fwd"))
    for name, column in (("packet_len", "length"), ("header_len", "header_length"), ("payload_len", "data_length"), ("window_size", "window_size")):
        out += _stats(name, column)
        for p, cond in sides:
            out += _stats(f"{p}{name}", f"CASE WHEN {cond} THEN {column} END")
    out += _stats("iat", "iat") + _stats("active", "active_ms") + _stats("idle", "idle_ms")
    for p, cond in sides:
        out += _stats(f"{p}iat", f"CASE WHEN {cond} THEN side_iat END")
        for name, column in (("bulk_packets", "bulk_n"), ("bulk_bytes", "bulk_b"), ("bulk_duration", "bulk_ms")):
            out += _stats(f"{p}{name}", f"CASE WHEN bulk_done AND {cond} THEN {column} END")
        out += [f"arg_min(timestamp_us, packet_id) FILTER ({cond}) AS {p}first_ts", f"arg_max(timestamp_us, packet_id) FILTER ({cond}) AS {p}last_ts", f"coalesce(arg_min(window_size, packet_id) FILTER ({cond}), 0) AS {p}init_window_size"]
        out += [f"count(*) FILTER ({cond} AND data_length > 0) AS {p}non_zero_payload_packets", f"count(*) FILTER ({cond} AND dup_ack) AS {p}duplicate_ack_count", f"count(*) FILTER ({cond} AND protocol = 6 AND window_size = 0) AS {p}zero_window_count", f"count(*) FILTER ({cond} AND retransmitted) AS {p}retransmission_count"]
        out += [f"count(*) FILTER ({cond} AND {f}_flag = 1) AS {p}{f}_flag_count" for f in FLAGS]
    out += ["1 + count(*) FILTER (gap_us > 1000000) AS subflow_count", *(f"coalesce(arg_min(icmp_{k}, packet_id) FILTER (icmp_type IS NOT NULL), -1) AS icmp_{k}" for k in ("type", "code"))]
    for name, (v4, v6) in ICMP.items():
        out.append(f"count(*) FILTER ((protocol = 1 AND icmp_type IN ({', '.join(map(str, v4))})) OR (protocol = 58 AND icmp_type IN ({', '.join(map(str, v6))}))) AS icmp_{name}_count")
    return ",\nf AS (SELECT a, b, protocol, flow_seq, " + ", ".join(out) + " FROM x GROUP BY a, b, protocol, flow_seq)\n"


FLOWS = PREPARED + _flows()

ID = "source_ip || ':' || source_port || '-' || destination_ip || ':' || destination_port || '-' || protocol"
US = "(last_ts - first_ts)"


def utc(us: str) -> str:
    return f"(strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' WHEN {us} % 1000 = 0 THEN '.' || lpad(CAST({us} % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END || ' UTC')"


def iana(port: str) -> str:
    return f"CAST(CASE WHEN {port} <= 1023 THEN 1 WHEN {port} <= 49151 THEN 2 ELSE 3 END AS BIGINT)"


def scope(ip: str) -> str:
    """Of an IPv4 address."""
    n = " + ".join(f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    spans = ((0x7F000000, 0x7FFFFFFF, "loopback"), (0xA9FE0000, 0xA9FEFFFF, "link_local"), (0x0A000000, 0x0AFFFFFF, "private"), (0xAC100000, 0xAC1FFFFF, "private"), (0xC0A80000, 0xC0A8FFFF, "private"), (0x64400000, 0x647FFFFF, "shared"), (0xE0000000, 0xEFFFFFFF, "multicast"))
    return f"(CASE WHEN {n} = 4294967295 THEN 'broadcast' WHEN {n} = 0 THEN 'unspecified' " + " ".join(f"WHEN {n} BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in spans) + " ELSE 'global' END)"


def locality(a: str, b: str) -> str:
    near = "('loopback', 'link_local', 'private', 'shared')"
    return f"(CASE WHEN {a} = 'multicast' OR {b} = 'multicast' THEN 'multicast' WHEN {a} = 'loopback' AND {b} = 'loopback' THEN 'loopback' WHEN {a} = 'link_local' AND {b} = 'link_local' THEN 'link_local' WHEN {a} IN {near} AND {b} IN {near} THEN 'private' WHEN ({a} IN {near}) <> ({b} IN {near}) THEN 'mixed' WHEN {a} = 'global' AND {b} = 'global' THEN 'public' ELSE 'other' END)"


def protocol_name(p: str) -> str:
    return f"(CASE {p} WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 58 THEN 'ICMP' ELSE 'OTHER' END)"


def per_second(v: str) -> str:
    return f"(CASE WHEN {US} = 0 THEN 0.0::DOUBLE ELSE {v} / ({US} / 1e6::DOUBLE) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / {b} END)"


def bulk_rate(side: str) -> str:
    d = f"{side}_bulk_duration_total"
    return f"(CASE WHEN {side}_bulk_packets_count = 0 THEN 0.0::DOUBLE WHEN {d} = 0 THEN 'inf'::DOUBLE ELSE {side}_bulk_bytes_total / ({d} / 1e6::DOUBLE) END)"


def flag(f: str) -> str:
    return f"(fwd_{f}_flag_count + bwd_{f}_flag_count)"


FLAG_TEXT = "(" + " || ".join(f"CASE WHEN {flag(f)} > 0 THEN '{x}' ELSE '.' END" for f, x in (("urg", "U"), ("ack", "A"), ("psh", "P"), ("rst", "R"), ("syn", "S"), ("fin", "F"))) + ")"


def ms(c: str) -> str:
    return f"coalesce({c} / 1000.0::DOUBLE, 0.0::DOUBLE)"


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _all(*prefixes: str) -> dict[str, str]:
    return _same(*(f"{p}_{k}" for p in prefixes for k in PARTS))


def sets() -> dict[str, dict[str, str]]:
    """Full schemas, in SQL over f."""
    ids = _same("source_ip", "source_port", "destination_ip", "destination_port", "protocol")
    icmp = _same("icmp_type", "icmp_code", *(f"icmp_{n}_count" for n in ICMP))
    out = {
        "basic": {"flow_id": ID, **ids, "first_timestamp": utc("first_ts"), "last_timestamp": utc("last_ts"), "duration": US, "flow_expire_cause": "close_cause"},
        "cidds": {"Src IP": "source_ip", "Src Port": "source_port", "Dst IP": "destination_ip", "Dst Port": "destination_port", "Proto": protocol_name("protocol"), "Date first seen": utc("first_ts"), "Duration": f"{US} // 1000", "Bytes": "packet_len_total", "Packets": "packet_len_count", "Flags": FLAG_TEXT},
        "custom": {"flow_id": ID, **icmp},
    }
    sides = (("bidirectional", ""), ("src2dst", "fwd_"), ("dst2src", "bwd_"))
    nf = {"id": ID, "expiration_id": "CAST(CASE WHEN close_cause = 'Active Timeout' THEN 1 WHEN close_cause IN ('Idle Timeout', 'TCP Normal Termination') THEN 0 ELSE -1 END AS BIGINT)", "src_ip": "source_ip", "src_port": "source_port", "dst_ip": "destination_ip", "dst_port": "destination_port", "protocol": "protocol", "ip_version": "4::BIGINT",
          "bidirectional_first_seen_ms": "first_ts // 1000", "bidirectional_last_seen_ms": "last_ts // 1000", "bidirectional_duration_ms": f"{US} // 1000", "bidirectional_packets": "packet_len_count", "bidirectional_bytes": "packet_len_total"}
    for n, p in sides[1:]:
        nf |= {f"{n}_first_seen_ms": ms(f"{p}first_ts"), f"{n}_last_seen_ms": ms(f"{p}last_ts"), f"{n}_duration_ms": ms(f"({p}last_ts - {p}first_ts)"), f"{n}_packets": f"{p}packet_len_count", f"{n}_bytes": f"{p}packet_len_total"}
    for unit, value in (("ps", "packet_len"), ("piat_ms", "iat")):
        nf |= {f"{n}_{a}_{unit}": f"{p}{value}_{b}" for n, p in sides for a, b in (("min", "min"), ("mean", "mean"), ("stddev", "std"), ("max", "max"))}
    nf |= {f"{n}_{f}_packets": flag(f) if not p else f"{p}{f}_flag_count" for n, p in sides for f in ("syn", "cwr", "ece", "urg", "ack", "psh", "rst", "fin")}
    out["nfstream"] = nf
    wide = {"flow_id": ID, **ids, "ip_version": "4::BIGINT", "source_ip_scope": scope("source_ip"), "destination_ip_scope": scope("destination_ip"), "path_locality": locality(scope("source_ip"), scope("destination_ip")), "timestamp_first": utc("first_ts"), "timestamp_last": utc("last_ts"),
            "flow_duration_us": US, "flow_expire_cause": "close_cause", "tcp_handshake_completed": "handshake", "tcp_reset_before_handshake": "reset_before", "tcp_reset_after_handshake": "reset_after", "tcp_close_style": "close_style",
            **{f"{e}_timestamp_{s}": ms(f"{s}_{e}_ts") for e in ("first", "last") for s in ("fwd", "bwd")}, **{f"{s}_duration_ms": ms(f"({s}_last_ts - {s}_first_ts)") for s in ("fwd", "bwd")},
            **_all("iat", "fwd_iat", "bwd_iat"), "packet_count": "packet_len_count", **_same(*(f"packet_len_{k}" for k in ("total", "mean", "max", "min", "std"))), "fwd_packet_count": "fwd_packet_len_count", "bwd_packet_count": "bwd_packet_len_count",
            **_all("fwd_packet_len", "bwd_packet_len", "header_len", "fwd_header_len", "bwd_header_len", "payload_len"), "payload_len_variance": "payload_len_std * payload_len_std", **_all("fwd_payload_len", "bwd_payload_len"), **_same("fwd_non_zero_payload_packets", "bwd_non_zero_payload_packets"),
            "fwd_bulk_rate_s": bulk_rate("fwd"), "bwd_bulk_rate_s": bulk_rate("bwd"), "fwd_bulk_count": "fwd_bulk_packets_count", "bwd_bulk_count": "bwd_bulk_packets_count", **_all(*(f"{s}_bulk_{k}" for k in ("packets", "bytes", "duration") for s in ("fwd", "bwd"))),
            **_same("subflow_count"), **_all("active", "idle"), **icmp}
    for n in ("retransmission", "duplicate_ack", "zero_window"):
        wide |= {f"flow_{n}_count": f"fwd_{n}_count + bwd_{n}_count", **_same(f"fwd_{n}_count", f"bwd_{n}_count")}
    wide |= {**_same("fwd_init_window_size", "bwd_init_window_size"), **_all("window_size", "fwd_window_size", "bwd_window_size"), **_same(*(f"{s}_{f}_flag_count" for s in ("fwd", "bwd") for f in FLAGS)), **{f"total_{f}_flag_count": flag(f) for f in FLAGS}, "flags": FLAG_TEXT}
    for n, p in (("flow", "payload_len"), ("fwd", "fwd_payload_len"), ("bwd", "bwd_payload_len")):
        wide |= {f"{n}_bytes_s": per_second(f"{p}_total"), f"{n}_packets_s": per_second(f"{p}_count")}
    for s in ("fwd", "bwd"):
        wide |= {f"{s}_subflow_packets_mean": ratio(f"{s}_payload_len_count", "subflow_count"), f"{s}_subflow_bytes_mean": ratio(f"{s}_payload_len_total", "subflow_count")}
    wide["up_down_ratio"] = ratio("bwd_payload_len_count", "fwd_payload_len_count")
    out["wide"] = wide
    out["cic"] = _cic()
    return out


def _cic() -> dict[str, str]:
    kinds = {"Max": "max", "Min": "min", "Mean": "mean", "Std": "std", "Total": "total"}
    both = (("Fwd", "fwd"), ("Bwd", "bwd"))
    d = {"Flow ID": ID, "Src IP": "source_ip", "Src Port": "source_port", "Dst IP": "destination_ip", "Dst Port": "destination_port", "Protocol": "protocol", "Timestamp": utc("first_ts"), "Flow Duration": US,
         "TCP Handshake Completed": "handshake", "TCP Reset Before Handshake": "reset_before", "TCP Reset After Handshake": "reset_after", "Total Fwd Packet": "fwd_payload_len_count", "Total Bwd packets": "bwd_payload_len_count",
         "Total Length of Fwd Packet": "fwd_payload_len_total", "Total Length of Bwd Packet": "bwd_payload_len_total"}
    for n, p in both:
        d |= {f"{n} Packet Length {k}": f"{p}_payload_len_{kinds[k]}" for k in ("Max", "Min", "Mean", "Std")}
    d |= {"Flow Bytes/s": per_second("payload_len_total"), "Flow Packets/s": per_second("payload_len_count")}
    d |= {f"Flow IAT {k}": f"iat_{kinds[k]} * 1000.0::DOUBLE" for k in ("Mean", "Std", "Max", "Min")}
    for n, p in both:
        d |= {f"{n} IAT {k}": f"{p}_iat_{kinds[k]} * 1000.0::DOUBLE" for k in ("Total", "Mean", "Std", "Max", "Min")}
    d |= {f"{n} {f.upper()} Flags": f"{p}_{f}_flag_count" for f in ("psh", "urg", "rst") for n, p in both}
    d |= {f"{n} Header Length": f"{p}_header_len_total" for n, p in both} | {f"{n} Packets/s": per_second(f"{p}_payload_len_count") for n, p in both}
    d |= {f"Packet Length {k}": f"payload_len_{kinds[k]}" for k in ("Min", "Max", "Mean", "Std")} | {"Packet Length Variance": "payload_len_std * payload_len_std"}
    d |= {f"{f.upper()} Flag Count": flag(f) for f in FLAGS}
    d |= {"Down/Up Ratio": ratio("bwd_payload_len_count", "fwd_payload_len_count"), "Average Packet Size": "payload_len_mean"}
    d |= {f"{n} Segment Size Avg": f"{p}_payload_len_mean" for n, p in both}
    for n, p in both:
        d |= {f"{n} Bytes/Bulk Avg": f"{p}_bulk_bytes_mean", f"{n} Packet/Bulk Avg": f"{p}_bulk_packets_mean", f"{n} Bulk Rate Avg": bulk_rate(p)}
        d |= {f"Subflow {n} Packets": ratio(f"{p}_payload_len_count", "subflow_count"), f"Subflow {n} Bytes": ratio(f"{p}_payload_len_total", "subflow_count")}
    d |= {"FWD Init Win Bytes": "fwd_init_window_size", "Bwd Init Win Bytes": "bwd_init_window_size"}
    d |= {f"{n} Act Data Pkts": f"{p}_non_zero_payload_packets" for n, p in both} | {f"{n} Seg Size Min": f"{p}_header_len_min" for n, p in both}
    d |= {f"{n} {k}": f"{n.lower()}_{kinds[k]}" for n in ("Active", "Idle") for k in ("Mean", "Std", "Max", "Min")}
    d |= {"ICMP Code": "icmp_code", "ICMP Type": "icmp_type"}
    d |= {f"ICMP {n} Count": f"icmp_{n.lower().replace(' ', '_')}_count" for n in ("Echo Request", "Echo Reply", "Error", "Destination Unreachable")}
    d |= {f"{n} TCP Retrans. Count": f"{p}_retransmission_count" for n, p in both}
    return d | {"Total TCP Retrans. Count": "fwd_retransmission_count + bwd_retransmission_count", "Total Connection Flow Time": US}
