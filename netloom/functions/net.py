"""Addresses, ports, flags and guarded arithmetic as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCALISH = ("loopback", "link_local", "private", "shared")


def cases(*pairs: tuple[Column, str], otherwise: Column | str) -> Column:
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def is_ipv4(ip: Column) -> Column:
    return ~F.contains(ip, F.lit(":"))


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for others."""
    parts = F.split(ip, r"\.")
    return F.when(is_ipv4(ip), reduce(lambda a, i: a * 256 + F.try_element_at(parts, F.lit(i)).try_cast("long"), (2, 3, 4), F.try_element_at(parts, F.lit(1)).try_cast("long")))


def ipv6_bytes(ip: Column) -> Column:
    """32 lower-case hex digits of an IPv6 address, :: and an embedded IPv4 part written out; null for IPv4."""
    tail = F.regexp_extract(ip, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    n = ipv4_number(tail)
    plain = F.when(tail != "", F.concat(F.regexp_replace(ip, r"\d+\.\d+\.\d+\.\d+$", ""), F.lower(F.hex(F.floor(n / 65536).cast("long"))), F.lit(":"), F.lower(F.hex(n % 65536)))).otherwise(F.lower(ip))
    pad = lambda x: F.lpad(x, 4, "0")
    groups = lambda s: F.transform(F.filter(F.split(s, ":"), lambda x: x != ""), pad)
    at = F.instr(plain, "::")
    head, rest = groups(F.substring_index(plain, "::", 1)), groups(F.when(at > 0, F.substring_index(plain, "::", -1)).otherwise(F.lit("")))
    middle = F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(rest)))
    return F.when(~is_ipv4(ip), F.array_join(F.concat(head, middle, rest), ""))


def address_key(ip: Column) -> Column:
    """Sorts as addresses do: IPv4 before IPv6, each by its bytes. A part of an IPv4 text over 255 doesn't carry into the one before it."""
    parts = [F.lpad(F.split_part(ip, F.lit("."), F.lit(i)), 3, "0") for i in (1, 2, 3, 4)]
    return F.when(is_ipv4(ip), F.concat(F.lit("4"), *parts)).otherwise(F.concat(F.lit("6"), ipv6_bytes(ip)))


def endpoint(ip: Column, port: Column) -> Column:
    return F.struct(address_key(ip).alias("address"), port.cast("long").alias("port"))


def reversed_key(source_ip: Column, source_port: Column, destination_ip: Column, destination_port: Column, protocol: Column) -> Column:
    return F.struct(destination_ip.alias("source_ip"), destination_port.alias("source_port"), source_ip.alias("destination_ip"), source_port.alias("destination_port"), protocol.alias("protocol"))


def source_first(source_ip: Column, source_port: Column, destination_ip: Column, destination_port: Column) -> Column:
    """Whether the canonical key of a packet starts with its source: the smaller endpoint stands first."""
    return endpoint(source_ip, source_port) <= endpoint(destination_ip, destination_port)


def flow_id(source_ip: Column, source_port: Column, destination_ip: Column, destination_port: Column, protocol: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.concat(source_ip, F.lit(":"), text(source_port), F.lit("-"), destination_ip, F.lit(":"), text(destination_port), F.lit("-"), text(protocol))


def ip_version(ip: Column) -> Column:
    return F.when(is_ipv4(ip), 4).otherwise(6).cast("long")


def iana_port(port: Column) -> Column:
    """1 well known, 2 registered, 3 dynamic."""
    return F.when(port <= 1023, 1).when(port <= 49151, 2).otherwise(3).cast("long")


def ip_scope(ip: Column) -> Column:
    return scope_of(ipv4_number(ip), ipv6_bytes(ip))


def scope_of(n: Column, h: Column) -> Column:
    """Of an IPv4 address as a number or, where that is null, an IPv6 address as hex digits."""
    within = lambda low, high: n.between(low, high)
    v4 = cases(
        (n == 0xFFFFFFFF, "broadcast"), (n == 0, "unspecified"), (within(0x7F000000, 0x7FFFFFFF), "loopback"), (within(0xA9FE0000, 0xA9FEFFFF), "link_local"),
        (within(0x0A000000, 0x0AFFFFFF) | within(0xAC100000, 0xAC1FFFFF) | within(0xC0A80000, 0xC0A8FFFF), "private"), (within(0x64400000, 0x647FFFFF), "shared"), (within(0xE0000000, 0xEFFFFFFF), "multicast"),
        otherwise="global",
    )
    start = lambda *p: F.substring(h, 1, len(p[0])).isin(*p)
    v6 = cases(
        (h == "0" * 32, "unspecified"), (h == "0" * 31 + "1", "loopback"), (start("fe8", "fe9", "fea", "feb"), "link_local"), (start("fc", "fd"), "private"), (start("ff"), "multicast"),
        otherwise="global",
    )
    return F.when(n.isNotNull(), v4).otherwise(v6)


def path_locality(source: Column, destination: Column) -> Column:
    """Of two scopes."""
    both = lambda s: (source == s) & (destination == s)
    near, far = source.isin(*LOCALISH), destination.isin(*LOCALISH)
    return cases(
        ((source == "multicast") | (destination == "multicast"), "multicast"), (both("loopback"), "loopback"), (both("link_local"), "link_local"), (near & far, "private"), (near != far, "mixed"), (both("global"), "public"),
        otherwise="other",
    )


def protocol_name(protocol: Column) -> Column:
    return cases((protocol == 6, "TCP"), (protocol == 17, "UDP"), (protocol.isin(1, 58), "ICMP"), otherwise="OTHER")


def has_flag(flags: Column, mask: int) -> Column:
    return (flags.bitwiseAND(F.lit(mask)) != 0).cast("long")


def expiration_id(cause: Column) -> Column:
    """0 idle or finished, 1 active timeout, -1 else."""
    return F.when(cause == "Active Timeout", 1).when(cause.isin("Idle Timeout", "TCP Normal Termination"), 0).otherwise(-1).cast("long")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b != 0, b))


def per_second(value: Column, duration_us: Column) -> Column:
    return safe_div(value, duration_us / F.lit(1e6))


def bulk_rate(total: Column, duration_ms: Column, count: Column) -> Column:
    """Bytes by a duration in milliseconds taken as microseconds: 0 without bulks, infinite for bulks of no duration."""
    return F.when(count == 0, F.lit(0.0)).when(duration_ms == 0, F.lit(float("inf"))).otherwise(total / F.when(duration_ms != 0, duration_ms / F.lit(1e6)))


def rust_double(x: Column) -> Column:
    """The shortest text of a double without an exponent or a trailing .0; inf for infinity."""
    text = x.cast("string")
    plain = F.regexp_replace(F.when(F.contains(text, F.lit("E")), F.rtrim(F.format_string("%.17f", x), F.lit("0"))).otherwise(text), r"\.0*$", "")
    return cases((x == float("inf"), "inf"), (x == -float("inf"), "-inf"), (F.isnan(x), "NaN"), otherwise=plain)


def utc_text(us: Column) -> Column:
    """A time in microseconds as text, with 3 or 6 digits of a fraction only where it needs them."""
    t = F.timestamp_micros(us)
    rest = F.pmod(us, F.lit(1_000_000))
    fraction = F.when(rest == 0, "").when(rest % 1000 == 0, F.format_string(".%03d", (rest / 1000).cast("long"))).otherwise(F.format_string(".%06d", rest))
    return F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), fraction, F.lit(" UTC"))
