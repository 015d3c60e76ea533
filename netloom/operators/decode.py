"""Frames to packets: Ethernet, one VLAN tag, Linux cooked captures, IPv4, IPv6 with extension headers, TCP, UDP, ICMP."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from struct import unpack_from

import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.schema import DDL, FIELDS, FLAGS, MASKS, TEXT

# Ethertypes, protocol numbers and the extension headers whose length is in units of eight bytes.
IPV4, IPV6, VLAN = 0x0800, 0x86DD, 0x8100
TCP, UDP, ICMP, ICMPV6 = 6, 17, 1, 58
BY_EIGHT, FRAGMENT, AUTHENTICATION, ENCRYPTED = frozenset((0, 43, 60, 135, 139, 140)), 44, 51, 50
MOST_EXTENSIONS = 8


def network(frame: bytes) -> tuple[int, bytes] | None:
    """Ethertype and network packet of a frame. An unknown ethertype is read as a Linux cooked header."""
    if len(frame) < 14:
        return None
    kind, body = unpack_from(">H", frame, 12)[0], frame[14:]
    if kind in (IPV4, IPV6):
        return kind, body
    if kind == VLAN:
        if len(body) < 4:
            return None
        inner = unpack_from(">H", body, 2)[0]
        return (inner, body[4:]) if inner in (IPV4, IPV6) else None
    if len(frame) < 16:
        return None
    kind, body = unpack_from(">H", frame, 14)[0], frame[16:]
    if kind == VLAN:
        if len(frame) < 20:
            return None
        kind, body = unpack_from(">H", frame, 18)[0], frame[20:]
    return (kind, body) if kind in (IPV4, IPV6) else None


def _ipv6_payload(p: bytes) -> tuple[int, bytes] | None:
    """Protocol and payload after the extension headers; None for later fragments, encrypted and cut packets."""
    kind, at = p[6], 40
    for _ in range(MOST_EXTENSIONS):
        if kind == ENCRYPTED:
            return None
        if kind not in BY_EIGHT and kind not in (FRAGMENT, AUTHENTICATION):
            return kind, p[at:]
        if len(p) < at + 8 if kind == FRAGMENT else len(p) < at + 2:
            return None
        if kind == FRAGMENT:
            if unpack_from(">H", p, at + 2)[0] >> 3:
                return None
            size = 8
        else:
            size = (p[at + 1] + 2) * 4 if kind == AUTHENTICATION else (p[at + 1] + 1) * 8
        if len(p) < at + size:
            return None
        kind, at = p[at], at + size
    return None


def decoded(frame: bytes) -> dict | None:
    """Packet fields of a frame (without packet_id and time); None if it isn't a packet that flows are made of."""
    found = network(frame)
    if found is None:
        return None
    kind, p = found
    if kind == IPV4:
        if len(p) < 20:
            return None
        head, total = (p[0] & 15) * 4, unpack_from(">H", p, 2)[0]
        if unpack_from(">H", p, 6)[0] & 0x1FFF or head < 20:
            return None
        proto, body, length = p[9], p[head : max(head, min(total, len(p)))], total
        source, destination = (str(ipaddress.IPv4Address(p[i : i + 4])) for i in (12, 16))
    else:
        if len(p) < 40 or (inner := _ipv6_payload(p)) is None:
            return None
        (proto, body), length = inner, len(p) & 0xFFFF
        source, destination = (str(ipaddress.IPv6Address(p[i : i + 16])) for i in (8, 24))
    out = {"source_ip": source, "destination_ip": destination, "protocol": proto, "length": length}
    if proto == TCP:
        if len(body) < 20:
            return None
        sport, dport, seq, ack = unpack_from(">HHII", body)
        size, flags = (body[12] >> 4) * 4, body[13]
        bits = {f"{f}_flag": int(flags & m != 0) for f, m in MASKS.items()}
        return out | bits | {"source_port": sport, "destination_port": dport, "sequence_number": seq, "sequence_number_ack": ack, "header_length": size, "flags": flags, "window_size": unpack_from(">H", body, 14)[0], "data_length": max(0, len(body) - size)}
    if proto == UDP:
        if len(body) < 8:
            return None
        sport, dport, size = unpack_from(">HHH", body)
        return out | {"source_port": sport, "destination_port": dport, "header_length": 8, "data_length": max(0, min(size, len(body)) - 8)}
    if proto in (ICMP, ICMPV6):
        if len(body) < 4:
            return None
        return out | {"header_length": 8, "data_length": len(body) - 4, "icmp_type": body[0], "icmp_code": body[1]}
    return None


def packets_of_frames(frames: DataFrame) -> DataFrame:
    """Packets of frames (idx, ts_us, data), in their order; what can't be decoded is dropped. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, data in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("idx", "ts_us", "data")), strict=True):
                if data is not None and (row := decoded(data)) is not None:
                    rows.append(row | {"packet_id": i, "timestamp_us": t})
            columns = [pa.array([r.get(f) if f.startswith("icmp") else r.get(f, 0) for r in rows], pa.string() if f in TEXT else pa.int64()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays(columns, names=list(FIELDS))

    assert set(FLAGS) == set(MASKS)
    return frames.select("idx", "ts_us", "data").mapInArrow(run, DDL)
