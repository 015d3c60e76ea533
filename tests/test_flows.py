"""Scenarios of sessions and features, a second model for segmentation, decoding, sources, streams and sinks."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from netloom import sinks
from netloom.config import Config, from_args, from_toml, parser
from netloom.functions import net
from netloom.operators import features
from netloom.operators.decode import decoded, network
from netloom.operators.segment import segmented
from netloom.plans import engine
from netloom.plans.featuresets import feature_set
from netloom.schema import DDL, FIELDS, MASKS, packets_of
from netloom.sources import events, pcap

A, B = ("10.0.0.1", 1000), ("10.0.0.2", 80)


def packet(i, ts, fwd=True, flags="", proto=6, size=0, seq=0, ack=0, win=1000, length=None, a=A, b=B, icmp=(None, None)):
    (s, sp), (d, dp) = (a, b) if fwd else (b, a)
    on = flags.split()
    row = dict.fromkeys(FIELDS, 0) | {f"{f}_flag": int(f in on) for f in MASKS}
    row |= {"packet_id": i, "timestamp_us": round(ts * 1e6), "source_ip": s, "source_port": sp, "destination_ip": d, "destination_port": dp, "protocol": proto, "flags": sum(MASKS[f] for f in on), "data_length": size, "header_length": 20, "length": size + 40 if length is None else length}
    row |= {"window_size": win, "sequence_number": seq, "sequence_number_ack": ack, "icmp_type": icmp[0], "icmp_code": icmp[1]}
    return tuple(row[f] for f in FIELDS)


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def flows(spark, rows, **options):
    c = Config(**({"sweep": "none"} | options))
    return sorted(engine.flows(table(spark, rows), c).collect(), key=lambda r: r.first_packet_id)


def test_closing_styles(spark):
    fin = [packet(0, 1, True, "fin", seq=100), packet(1, 1.1, False, "ack", ack=101), packet(2, 1.2, False, "fin", seq=200), packet(3, 1.3, True, "ack", ack=201)]
    (r,) = flows(spark, fin)
    assert (r.close_cause, r.close_style) == ("TCP Normal Termination", "four_way_fin")
    crossed = [packet(0, 1, True, "fin", seq=100), packet(1, 1.1, False, "fin ack", seq=200, ack=101), packet(2, 1.2, True, "ack", ack=201)]
    assert flows(spark, crossed)[0].close_style == "simultaneous_fin"
    assert flows(spark, [packet(0, 1, True, "fin", seq=100, size=20), packet(1, 1.1, False, "ack", ack=101)])[0].close_style == "half_close"
    assert [r.close_style for r in flows(spark, [packet(0, 1, True, "rst", proto=17)])] == ["not_applicable"]
    hand = [packet(0, 1, True, "syn"), packet(1, 1.1, False, "syn ack", seq=700), packet(2, 1.2, True, "ack", ack=701)]
    (r,) = flows(spark, [*hand, packet(3, 1.3, False, "rst")])
    assert (r.handshake, r.reset_before, r.reset_after, r.close_cause, r.close_style) == (1, 0, 1, "TCP Reset", "reset")
    a, b = flows(spark, [packet(0, 1, True, "syn"), packet(1, 1.1, False, "rst"), packet(2, 1.2, False, "ack")])
    assert (a.reset_before, a.handshake, b.source_ip, b.close_cause) == (1, 0, B[0], "Exporter Shutdown")


def test_timeouts_are_whole_seconds(spark):
    at = lambda gap, **o: [r.close_cause for r in flows(spark, [packet(0, 1, proto=17), packet(1, 1 + gap, proto=17)], **o)]
    assert at(10.999999, idle_timeout=10) == ["Exporter Shutdown"]
    assert at(11, idle_timeout=10) == ["Idle Timeout", "Exporter Shutdown"]
    assert at(11, idle_timeout=20, active_timeout=10) == ["Active Timeout", "Exporter Shutdown"]
    assert at(-0.5) == ["Exporter Shutdown"] and len(at(-1.0)) == 2
    (r,) = flows(spark, [packet(0, 1, proto=17), packet(1, 1.2, proto=17, a=A, b=A)][:1])
    assert r.packet_len_count == 1
    (r, s) = flows(spark, [packet(0, 1, proto=17), packet(1, 3, proto=17, a=("10.9.9.9", 1))], idle_timeout=1, sweep="exact", expiration_check_interval=1)
    assert (r.close_cause, r.close_ts, r.idle_total) == ("Idle Timeout", 3_000_000, 2000.0)


def test_feature_scenarios(spark):
    seg = [packet(0, 1, True, "ack", seq=100, size=100), packet(1, 1.1, True, "ack", seq=200, size=100), packet(2, 1.2, True, "ack", seq=150, size=100)]
    assert flows(spark, seg)[0].fwd_retransmission_count == 1
    q = [packet(0, 1, True, "ack", ack=500, win=4096), packet(1, 1.1, True, "ack", ack=500, win=4096), packet(2, 1.2, True, "ack", ack=500, win=2048), packet(3, 1.3, False, "ack", ack=800, win=0), packet(4, 1.4, False, "ack", ack=800, win=0), packet(5, 1.5, True, "ack", ack=500, size=32)]
    (r,) = flows(spark, q)
    assert (r.fwd_duplicate_ack_count, r.bwd_duplicate_ack_count, r.fwd_zero_window_count, r.bwd_zero_window_count, r.fwd_init_window_size) == (1, 1, 0, 2, 4096)
    (r,) = flows(spark, [packet(i, t, proto=17) for i, t in enumerate((1.0, 2.0, 3.000001))])
    assert r.subflow_count == 2
    (r,) = flows(spark, [packet(0, 0.001, proto=17), packet(1, 1.001, proto=17), packet(2, 7.001, proto=17), packet(3, 400, proto=17, a=("10.9.9.9", 1))][:3])
    assert (r.active_total, r.active_count, r.idle_total, r.idle_count) == (1000.0, 1, 6000.0, 1)
    four = [packet(i, 1 + i, True, "ack", size=10) for i in range(4)]
    (r,) = flows(spark, four)
    assert (r.fwd_bulk_packets_count, r.fwd_bulk_bytes_total, r.fwd_bulk_duration_total) == (1, 200.0, 3000.0)
    assert flows(spark, four[:3])[0].fwd_bulk_packets_count == 0
    assert flows(spark, [*four[:3], packet(3, 4.002, True, "ack", size=10)])[0].fwd_bulk_packets_count == 0
    assert flows(spark, [*four, packet(4, 4.5, False, "rst")])[0].fwd_bulk_packets_count == 1
    assert flows(spark, [*four[:3], packet(3, 3.5, True, "rst")])[0].fwd_bulk_packets_count == 0
    icmp = [packet(i, 1 + i / 10, i < 2, "", proto=1, icmp=x, a=("10.0.0.1", 0), b=("10.0.0.2", 0)) for i, x in enumerate([(8, 0), (3, 1), (0, 0)])]
    (r,) = flows(spark, icmp)
    assert (r.icmp_type, r.icmp_code, r.icmp_echo_request_count, r.icmp_echo_reply_count, r.icmp_error_count, r.icmp_destination_unreachable_count) == (8, 0, 1, 1, 1, 1)


def model(rows, active, idle, interval):
    """One table of flows, packet by packet, with sweeps: (first packet, packets, cause, close time)."""
    at = {f: i for i, f in enumerate(FIELDS)}
    open_, out, due = {}, [], None
    whole = lambda now, since: (now - since) // 10**6 if now >= since else (10**18 if since - now >= 10**6 else 0)

    def gone(f, now):
        return "Active Timeout" if whole(now, f["first"]) > active else "Idle Timeout" if whole(now, f["last"]) > idle else None

    def end(key, cause, ts):
        f = open_.pop(key)
        out.append((f["id"], f["n"], cause, ts))

    for r in rows:
        ts = r[at["timestamp_us"]]
        if due is None or ts >= due:
            for key in [k for k, f in open_.items() if gone(f, ts)]:
                end(key, gone(open_[key], ts), ts)
            due = ts + interval * 10**6
        key = (r[at["protocol"]], *sorted(((r[at["source_ip"]], r[at["source_port"]]), (r[at["destination_ip"]], r[at["destination_port"]]))))
        if key in open_ and (cause := gone(open_[key], ts)):
            end(key, cause, ts)
        f = open_.setdefault(key, {"id": r[0], "n": 0, "first": ts})
        f["n"], f["last"] = f["n"] + 1, ts
        if r[at["protocol"]] == 6 and r[at["rst_flag"]]:
            end(key, "TCP Reset", ts)
    for key in list(open_):
        end(key, "Exporter Shutdown", rows[-1][at["timestamp_us"]])
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_segments_and_sweeps_against_a_model(spark, seed):
    r = random.Random(seed)
    t, rows = 0.0, []
    for i in range(600):
        t += r.choice([0, 0.1, 0.5, 2.0]) if seed < 3 else r.choice([0.1, 1.5, -0.4, -1.2, 1.0])
        rows.append(packet(i, max(0, round(t + 50, 3)), r.random() < 0.5, "rst" if r.random() < 0.03 else "ack", proto=r.choice([6, 17]), a=(f"10.0.0.{r.randrange(6)}", 5), b=("10.1.0.1", 80)))
    interval = r.choice([0, 3, 9])
    got = flows(spark, rows, active_timeout=20, idle_timeout=4, expiration_check_interval=interval, sweep="exact")
    assert sorted((x.first_packet_id, x.packet_len_count, x.close_cause, x.close_ts) for x in got) == model(rows, 20, 4, interval)


def test_snapshots(spark):
    rows = [packet(0, 1, proto=17), packet(1, 3.000001, proto=17), packet(2, 3.1, False, proto=17)]
    got = engine.flows(table(spark, rows), Config(early_export=1, sweep="none")).collect()
    early = sorted((r.snapshot_packet_id, r.packet_len_count, r.bwd_packet_len_count, r.close_cause, r.close_style) for r in got if r.snapshot_packet_id is not None)
    assert early == [(1, 2, 0, "None", "none"), (2, 3, 1, "None", "none")] and len(got) == 3


def test_schema_widths():
    want = {"basic": (10, 5), "cic": (100, 96), "cidds": (10, 7), "nfstream": (71, 61), "wide": (203, 194), "custom": (7, 6)}
    assert {n: (len(feature_set(n).full), len(feature_set(n).clean)) for n in want} == want


def test_plan_has_one_exchange_after_segmentation(spark):
    plan = features.flows(segmented(table(spark, [packet(0, 1)]), Config(sweep="none"))).select("first_ts", "iat_mean", "fwd_bulk_packets_count")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2, plan


def test_addresses(spark):
    ips = ["255.255.255.255", "0.0.0.0", "127.9.9.9", "169.254.0.1", "172.31.255.255", "172.32.0.0", "100.127.0.1", "224.0.0.1", "8.8.8.8", "::", "::1", "fe80::1", "febf::1", "fd00::1", "ff02::fb", "2001:db8::1", "::ffff:10.0.0.1", "1:2:3:4:5:6:7:8"]
    want = ["broadcast", "unspecified", "loopback", "link_local", "private", "global", "shared", "multicast", "global", "unspecified", "loopback", "link_local", "link_local", "private", "multicast", "global", "global", "global"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", net.ip_scope(F.col("ip")).alias("s"), net.ipv6_bytes(F.col("ip")).alias("h"), net.ip_version(F.col("ip")).alias("v")).collect()
    assert [r.s for r in rows] == want
    for r in rows:
        x = ipaddress.ip_address(r.ip)
        assert r.v == x.version and (x.version == 4 or r.h == x.packed.hex())
    some = [ipaddress.IPv6Address(random.Random(i).choice([0, 1, 0x20010DB8]) << 96 | random.Random(i + 9).choice([0, 5, 0xFF00000000])) for i in range(40)]
    got = spark.createDataFrame([(x.packed,) for x in some], "b binary").select(events.ipv6_text(F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == [str(x) for x in some]


def test_number_and_time_text(spark):
    xs = [0.0, 1.0, 0.5, float("inf"), 1e-7, 12345678901234.0, -2.25]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(net.rust_double(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["0", "1", "0.5", "inf", "0.0000001", "12345678901234", "-2.25"]
    got = spark.createDataFrame([(1_000_000,), (1_500_000,), (1_000_001,)], "x long").select(net.utc_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["1970-01-01 00:00:01 UTC", "1970-01-01 00:00:01.500 UTC", "1970-01-01 00:00:01.000001 UTC"]


TCP = struct.pack(">HHIIBBHHH", 1234, 80, 7, 9, 0x50, 0x12, 512, 0, 0)
UDP = struct.pack(">HHHH", 53, 5353, 12, 0) + b"abcd"


def v4(proto, body, frag=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, frag, 64, proto, 0, bytes([192, 0, 2, 1]), bytes([192, 0, 2, 2])) + body


def v6(first, body):
    a = ipaddress.IPv6Address("2001:db8::1").packed
    return struct.pack(">IHBB", 0x60000000, len(body), first, 64) + a + a[:-1] + b"\x02" + body


def ether(kind, body):
    return b"\0" * 12 + struct.pack(">H", kind) + body


def test_decoder():
    d = decoded(ether(0x0800, v4(6, TCP + b"xyz")))
    assert (d["source_ip"], d["source_port"], d["syn_flag"], d["ack_flag"], d["fin_flag"], d["data_length"], d["length"], d["window_size"], d["sequence_number_ack"]) == ("192.0.2.1", 1234, 1, 1, 0, 3, 43, 512, 9)
    assert decoded(ether(0x0800, v4(17, UDP)))["data_length"] == 4
    assert decoded(ether(0x0800, v4(17, UDP, frag=5))) is None and decoded(ether(0x0800, v4(47, UDP))) is None
    assert decoded(ether(0x0800, v4(1, b"\x08\x00\0\0\0\0\0\0")))["icmp_type"] == 8
    assert decoded(ether(0x8100, b"\0\1" + struct.pack(">H", 0x0800) + v4(17, UDP)))["source_port"] == 53
    cooked = b"\0" * 14 + struct.pack(">H", 0x86DD)
    assert decoded(cooked + v6(17, UDP))["destination_ip"] == "2001:db8::2"
    assert decoded(b"\0" * 14 + struct.pack(">HHH", 0x8100, 1, 0x0800) + v4(17, UDP))["source_port"] == 53
    assert decoded(ether(0x86DD, v6(0, bytes([6, 0]) + b"\0" * 6 + TCP)))["protocol"] == 6
    assert decoded(ether(0x86DD, v6(44, bytes([17, 0, 0, 0, 0, 0, 0, 0]) + UDP)))["protocol"] == 17
    assert decoded(ether(0x86DD, v6(44, bytes([17, 0, 0, 8, 0, 0, 0, 0]) + UDP))) is None
    assert decoded(ether(0x86DD, v6(51, bytes([6, 1]) + b"\0" * 10 + TCP)))["protocol"] == 6
    assert decoded(ether(0x86DD, v6(50, b"\0" * 16))) is None and decoded(ether(0x86DD, v6(0, b"\x06"))) is None
    assert network(b"\0" * 12 + b"\x12\x34\0") is None and decoded(b"") is None


def test_capture_files_to_text(spark, tmp_path):
    def capture(frames):
        body = b"".join(struct.pack("<IIII", int(t), round(t % 1 * 1e6), len(f), len(f)) + f for t, f in frames)
        return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body

    (tmp_path / "a.pcap").write_bytes(capture([(1.5, ether(0x0800, v4(17, UDP))), (2.0, b"\0" * 15), (2.25, ether(0x86DD, v6(17, UDP)))]) + b"\1\2\3")
    p = pcap.packets(spark, str(tmp_path / "a.pcap"))
    assert [(r.packet_id, r.timestamp_us, r.source_ip) for r in p.orderBy("packet_id").collect()] == [(0, 1_500_000, "192.0.2.1"), (2, 2_250_000, "2001:db8::1")]
    spark.dataSource.register(pcap.PcapDataSource)
    assert spark.read.format("pcap").load(path=str(tmp_path / "*.pcap")).count() == 3
    rows = engine.extract(p, Config(features="cidds"))
    sinks.write_csv(rows, str(tmp_path / "out"), header=True)
    text = [x.read_text().splitlines() for x in sorted((tmp_path / "out").glob("part-*")) if x.stat().st_size]
    assert {t[0] for t in text} == {"Src IP,Src Port,Dst IP,Dst Port,Proto,Date first seen,Duration,Bytes,Packets,Flags"}
    assert "192.0.2.1,53,192.0.2.2,5353,UDP,1970-01-01 00:00:01.500 UTC,0,32,1,......" in {x for t in text for x in t[1:]}


@pytest.mark.parametrize("order", "<>")
def test_pcapng(spark, tmp_path, order):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack(f"{order}I", len(body) + 12)
        return struct.pack(f"{order}I", kind) + size + body + size

    def face(most, options=b""):
        return block(1, struct.pack(f"{order}HHI", 1, 0, most) + options)

    def packet(i, ticks, data):
        return block(6, struct.pack(f"{order}IIIII", i, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)

    section = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1))
    a, b = ether(0x0800, v4(17, UDP)), ether(0x86DD, v6(17, UDP)) + b"x"
    fine = struct.pack(f"{order}HHB3xHHqHH", 9, 1, 9, 14, 8, 100, 0, 0)
    halves = struct.pack(f"{order}HHB3x", 9, 1, 0x81)
    old = struct.pack(f"{order}HHIIII", 1, 0, 1, 705_034_703, len(a), len(a))
    simple = struct.pack(f"{order}I", len(b)) + b
    first = section + face(20) + face(0, fine) + block(5, b"1234") + packet(0, 1_700_000_000_000_001, a) + packet(1, 2_000_001_999, b) + block(2, old + a) + block(3, simple)
    second = section + face(0, halves) + packet(0, 7, a)
    want = [(1_700_000_000_000_001, a), (102_000_001, b), (105_000_001, a), (0, b[:20]), (3_500_000, a)]
    for i, (end, n) in enumerate([(b"", 5), (packet(0, 9, a)[:-5], 5), (packet(3, 9, a) + packet(0, 9, a), 5), (b"\6", 5)]):
        (tmp_path / f"{i}.pcapng").write_bytes(first + second + end)
        with open(tmp_path / f"{i}.pcapng", "rb") as f:
            assert list(pcap.frames_of(f)) == [(k, *x) for k, x in enumerate(want)][:n]
    rows = pcap.frames(spark, str(tmp_path / "0.pcapng")).collect()
    assert [(r.idx, r.ts_us, bytes(r.data)) for r in rows] == [(k, *x) for k, x in enumerate(want)]
    spark.dataSource.register(pcap.PcapDataSource)
    assert spark.read.format("pcap").load(path=str(tmp_path / "*.pcapng")).count() == 20
    assert pcap.packets(spark, str(tmp_path / "0.pcapng")).count() == 4


def test_events_are_normalised(spark):
    row = (1, 0x0A000001, 0x0A000002, 5_000_999, 80, 1000, 3, 43, 100, 18, 6, 20, 7, 9, 0, 0, "ingress")
    names = "event_id long, ipv4_source long, ipv4_destination long, timestamp_ns long, port_destination int, port_source int, data_length int, length int, window_size int, combined_flags short, protocol short, header_length short, sequence_number long, sequence_number_ack long, icmp_type short, icmp_code short, direction string"
    (r,) = events.normalised(spark.createDataFrame([row], names), 10, ingress_only=True).collect()
    assert (r.timestamp_us, r.source_ip, r.source_port, r.syn_flag, r.ack_flag, r.fin_flag, r.icmp_type) == (5010, "10.0.0.1", 1000, 1, 1, 0, None)


def test_stream_gives_the_flows_of_the_batch(spark, tmp_path):
    from netloom.streaming.flows import packet_rate_stream, segmented_stream

    r = random.Random(4)
    rows, t = [], 0.0
    for i in range(200):
        t += r.choice([0.1, 0.4, 1.5])
        rows.append(packet(i, round(t + 10, 3), r.random() < 0.5, "rst" if r.random() < 0.05 else "ack", a=(f"10.0.0.{r.randrange(4)}", 5)))
    rows += [packet(1000 + k, 10_000 + k, a=("10.9.9.9", 9), proto=17) for k in range(2)]
    for k in range(4):
        table(spark, rows[k * 51 : (k + 1) * 51]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    c = Config(active_timeout=20, idle_timeout=4, sweep="none")
    stream = spark.readStream.schema(packets_of(table(spark, rows[:1])).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = segmented_stream(stream, c).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = features.flows(spark.table("ended")).select("first_packet_id", "packet_len_count", "close_cause", "handshake").collect()
    want = [x for x in flows(spark, rows, active_timeout=20, idle_timeout=4) if x.first_packet_id < 1000]
    assert sorted((x.first_packet_id, x.packet_len_count) for x in got if x.first_packet_id < 1000) == sorted((x.first_packet_id, x.packet_len_count) for x in want)
    q = packet_rate_stream(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert spark.table("rates").agg(F.sum("packets")).first()[0] == len(rows)


def test_a_stream_refuses_snapshots(spark):
    from netloom.streaming.flows import segmented_stream

    with pytest.raises(ValueError, match="early_export"):
        segmented_stream(packets_of(table(spark, [packet(0, 1)])), Config(early_export=1))


def test_options(tmp_path):
    (tmp_path / "c.toml").write_text('[config]\nfeatures = "cic"\nidle_timeout = 9\n[output]\noutput = "csv"\nexport_path = "x"\n')
    assert from_toml(str(tmp_path / "c.toml")).idle_timeout == 9
    c = from_args(parser().parse_args(["--config-file", str(tmp_path / "c.toml"), "-f", "wide", "--header", "pcap", "f"]))
    assert (c.features, c.idle_timeout, c.header, c.active_timeout, c.output) == ("wide", 9, True, 3600, "csv")
    with pytest.raises(ValueError):
        Config(output="csv")


def test_a_feature_set_of_ones_own(spark, tmp_path):
    """A registered set and an added aggregate, through options; and options written and read again."""
    from netloom.config import to_toml
    from netloom.plans.featuresets import FeatureSet, register

    features.add_aggregate("largest_ack", lambda: F.max("sequence_number_ack"))
    own = {"packets": F.col("packet_len_count"), "ack": F.col("largest_ack"), "mean_gap": F.col("iat_mean")}
    register(FeatureSet("own", own, {"packets": own["packets"]}))
    c = from_args(parser().parse_args(["-f", "own", "--sweep", "none", "pcap", "x"]))
    to_toml(c, str(tmp_path / "saved.toml"))
    assert from_toml(str(tmp_path / "saved.toml")) == c
    p = table(spark, [packet(0, 1, ack=5), packet(1, 2, ack=9), packet(2, 4, False, ack=7)])
    assert [tuple(r) for r in engine.extract(p, c).collect()] == [(3, 9, 1500.0)]
    assert feature_set("own").reads(spark) == {"packet_len_count", "largest_ack", "iat_mean"} and feature_set("own").reads(spark, True) == {"packet_len_count"}
    with pytest.raises(ValueError, match="one of"):
        engine.extract(p, Config(features="nobody's"))
    features._added.pop("largest_ack")
