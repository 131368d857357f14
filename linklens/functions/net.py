"""URL and address rules as Catalyst expressions: authority split, WHATWG-style IPv4,
host blocking, normalisation, CIDR membership."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference) ---
MAX_URL_LENGTH = 2048
ALLOWED_SCHEMES = ["http", "https"]
BLOCKED_HOSTNAMES = [
    "localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata",
    "metadata.google.internal", "instance-data",
]
BLOCKED_SUFFIXES = [".localhost", ".local", ".internal"]
DEFAULT_TRUSTED_PROXIES = ["127.0.0.1/32", "::1/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]
# -----------------------------------------------

SPECIAL_SCHEMES = ["http", "https", "ws", "wss", "ftp", "file"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_trim(col) -> Column:
    """String.prototype.trim: strip whitespace and line terminators at both ends."""
    return F.regexp_replace(_c(col), r"^[\s ﻿  ]+|[\s ﻿  ]+$", "")


def ipv4_strict(col) -> Column:
    """Dotted quad, 1-3 digits per octet, each <= 255 -> long; otherwise null."""
    s = _c(col)
    parts = F.split(s, r"\.", -1)
    ok = s.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    val = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.try_cast("long"))
    in_range = F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(ok & in_range, val)


def octets(ip_long) -> Column:
    v = _c(ip_long)
    return F.array(*[F.shiftright(v, sh).bitwiseAND(F.lit(255)) for sh in (24, 16, 8, 0)])


def _label_value(p: Column) -> Column:
    """A WHATWG IPv4 label: 0x-hex, 0-octal or decimal; null when not a number."""
    hexd = F.when(p.rlike("^0[xX][0-9A-Fa-f]{0,16}$"),
                  F.coalesce(F.conv(F.substring(p, 3, 100), 16, 10).try_cast("decimal(38,0)"), F.lit(0)))
    octd = F.when(p.rlike("^0[0-7]{1,22}$"), F.conv(p, 8, 10).try_cast("decimal(38,0)"))
    decd = F.when(p.rlike("^(0|[1-9][0-9]{0,20})$"), p.try_cast("decimal(38,0)"))
    return F.coalesce(hexd, octd, decd)


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it inside ``fn`` (keeps large subexpressions from being copied)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _ipv4_parts(labels: Column) -> Column:
    """WHATWG IPv4 from labels -> struct(ok, host)."""
    def body(vals: Column) -> Column:
        n = F.size(vals)
        all_num = F.forall(vals, lambda v: v.isNotNull())
        head = F.slice(vals, 1, F.greatest(n - 1, F.lit(1)))
        head_ok = (n == 1) | F.forall(head, lambda v: v <= 255)
        last_v = F.element_at(vals, -1)
        limit = F.pow(F.lit(256), F.lit(5) - n).cast("decimal(38,0)")
        valid = F.coalesce(all_num & (n <= 4) & head_ok & (last_v < limit), F.lit(False))
        total = F.aggregate(vals, F.struct(F.lit(0).cast("decimal(38,0)").alias("t"), F.lit(1).alias("i")),
                            lambda a, v: F.struct(
                                F.when(a["i"] < n, a["t"] + v * F.pow(F.lit(256), F.lit(4) - a["i"]).cast("decimal(38,0)"))
                                .otherwise(a["t"] + v).alias("t"),
                                (a["i"] + 1).alias("i")))["t"]
        dotted = let(total, lambda t: F.concat_ws(".", *[
            (F.call_function("div", t, F.lit(256 ** k)).cast("long") % 256).cast("string") for k in (3, 2, 1, 0)]))
        return F.struct(valid.alias("ok"), F.when(valid, dotted).alias("host"))

    return let(F.transform(labels, _label_value), body)


def whatwg_host(host_col) -> Column:
    """Host as a browser serialises it: lower-cased; numeric IPv4 forms become dotted quads.

    Returns a struct(host string, ok boolean). ``ok`` is false when the host
    ends in a number but is not a valid IPv4 address (the URL is invalid).
    """
    def with_labels(h: Column, labels: Column) -> Column:
        last = F.element_at(labels, -1)
        numeric_tail = last.rlike("^[0-9]+$") | last.rlike("^0[xX][0-9A-Fa-f]*$")
        plain = F.struct(h.alias("host"), F.lit(True).alias("ok"))
        v4 = let(_ipv4_parts(labels), lambda r: F.struct(r["host"].alias("host"), r["ok"].alias("ok")))
        v6 = let(ipv6_groups(F.regexp_replace(h, r"^\[|\]$", "")), lambda g: F.struct(
            F.concat(F.lit("["), ipv6_text(g), F.lit("]")).alias("host"), g.isNotNull().alias("ok")))
        return F.when(h.startswith("["), v6).when(numeric_tail, v4).otherwise(plain)

    def with_host(h: Column) -> Column:
        raw = F.split(h, r"\.", -1)
        labels = let(raw, lambda r: F.when((F.size(r) > 1) & (F.element_at(r, -1) == ""),
                                           F.slice(r, 1, F.size(r) - 1)).otherwise(r))
        return let(labels, lambda lb: with_labels(h, lb))

    return let(F.lower(_c(host_col)), with_host)


# --- fixed values: IPv4 ranges that no link may lead to ---
PRIVATE_V4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.255.255"), ("192.168.0.0", "192.168.255.255"), ("224.0.0.0", "255.255.255.255"),
]
# -----------------------------------------------------------


def private_v4(ip: Column) -> Column:
    """Whether an IPv4 address (as a long) lies in one of the ranges of ``PRIVATE_V4``; false for null."""
    within = F.lit(False)
    for lo, hi in PRIVATE_V4:
        within = within | ip.between(int(ipaddress.IPv4Address(lo)), int(ipaddress.IPv4Address(hi)))
    return F.coalesce(within, F.lit(False))


def ipv6_groups(text: Column) -> Column:
    """The eight 16-bit groups of an IPv6 literal (without brackets) as array<long>; null if it is none.

    ``::`` may stand once for one group of zeros or more, and the last two
    groups may be written as a dotted IPv4 address.
    """
    def expand(t: Column) -> Column:
        tail = F.regexp_extract(t, r"^(.*:)([0-9.]+\.[0-9.]+)$", 2)
        v4 = ipv4_strict(tail)
        hexed = F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]+\.[0-9.]+$", 1),
                         F.conv(F.shiftright(v4, 16).cast("string"), 10, 16), F.lit(":"),
                         F.conv(v4.bitwiseAND(F.lit(0xFFFF)).cast("string"), 10, 16))
        return F.when(tail == "", t).otherwise(hexed)  # null if the dotted part is no address

    def groups(t: Column) -> Column:
        halves = F.split(t, "::", -1)

        def side(i: int) -> Column:
            h = F.get(halves, F.lit(i))
            return F.when(h.isNull() | (h == ""), F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))

        left, right = side(0), side(1)
        zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
        whole = F.when(F.size(halves) == 1, left).when(
            (F.size(halves) == 2) & (F.size(left) + F.size(right) <= 7), F.concat(left, zeros, right))
        return let(whole, lambda w: F.when(
            (F.size(w) == 8) & F.forall(w, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")),
            F.transform(w, lambda g: F.conv(g, 16, 10).cast("long"))))

    return let(let(F.lower(text), expand), groups)


def ipv6_text(groups: Column) -> Column:
    """Groups as a browser writes them: no leading zeros, the first of the longest runs of zeros as ``::``."""
    def shorten(t: Column) -> Column:
        out = t
        for n in range(2, 9):  # the longest run ends up outermost
            run = f"(^|:)0(?::0){{{n - 1}}}(:|$)"
            out = F.when(t.rlike(run), F.regexp_replace(F.regexp_replace(t, f"^((?:(?!{run}).)*){run}", "$1::"), "^:::", "::")
                         ).otherwise(out)
        return out

    return let(F.array_join(F.transform(groups, lambda g: F.lower(F.conv(g.cast("string"), 10, 16))), ":"), shorten)


def private_v6(groups: Column) -> Column:
    """Unspecified, loopback, unique local (fc00::/7), link local (fe80::/16) and v4-mapped private addresses."""
    def body(g: Column) -> Column:
        zeros = F.forall(F.slice(g, 1, 5), lambda x: x == 0)
        last = F.get(g, F.lit(6)) * 65536 + F.get(g, F.lit(7))
        sixth = F.get(g, F.lit(5))
        first = F.get(g, F.lit(0))
        return F.coalesce((zeros & (sixth == 0) & (last <= 1)) | F.shiftright(first, 9).eqNullSafe(F.lit(0xFC00 >> 9))
                          | (first == 0xFE80) | (zeros & (sixth == 0xFFFF) & private_v4(last)), F.lit(False))

    return let(groups, body)


def blocked_reason(host_col) -> Column:
    """Why a host is blocked (name / suffix / private_ipv6 / private_ipv4), or null."""
    def body(h: Column) -> Column:
        v6_private = private_v6(ipv6_groups(F.regexp_replace(h, r"^\[|\]$", "")))
        suffix = F.lit(False)
        for s in BLOCKED_SUFFIXES:
            suffix = suffix | h.endswith(s)
        return (F.when(h.isin(BLOCKED_HOSTNAMES), "blocked_name")
                .when(suffix, "blocked_suffix")
                .when(h.contains(":") | h.startswith("["), F.when(v6_private, "private_ipv6"))
                .when(private_v4(ipv4_strict(h)), "private_ipv4"))

    return let(F.lower(_c(host_col)), body)


def remove_dot_segments(path_col) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path; ``..`` at the root stays at the root."""
    p = _c(path_col)
    segs = F.split(F.substring(p, 2, 1 << 30), "/", -1)
    dots = F.transform(segs, lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit(".")))
    stack = F.aggregate(
        F.arrays_zip(segs.alias("s"), dots.alias("d")), F.array().cast("array<string>"),
        lambda acc, x: F.when(x["d"] == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(x["d"] == ".", acc).otherwise(F.array_append(acc, x["s"])))
    trailing = F.when(F.element_at(dots, -1).isin(".", "..") & (F.size(stack) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(stack, "/"), trailing)


def parse_url(col) -> Column:
    """Split a URL the way a WHATWG parser does for http(s)-like schemes.

    struct(scheme, userinfo, host, port, path, query, fragment, special, ok).
    """
    raw = _c(col)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*:(.*)$", 1)
    special = scheme.isin(SPECIAL_SCHEMES)
    after = F.regexp_replace(rest, r"^[/\\]*", "")
    authority = F.regexp_extract(after, r"^([^/?#\\]*)", 1)
    remainder = F.substring(after, F.length(authority) + 1, 1 << 30)
    has_at = authority.contains("@")
    userinfo = F.when(has_at, F.regexp_extract(authority, r"^(.*)@[^@]*$", 1)).otherwise(F.lit(""))
    hostport = F.when(has_at, F.regexp_extract(authority, r"@([^@]*)$", 1)).otherwise(authority)
    host = F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1)
    # the bracketed form first: inside it a colon starts no port
    port = F.when(hostport.startswith("["), F.regexp_extract(hostport, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(
        F.regexp_extract(hostport, r"^[^:]*:(.*)$", 1))
    shape_ok = ~hostport.startswith("[") | hostport.rlike(r"^\[[^\]]*\](:.*)?$")
    path = F.regexp_replace(F.regexp_extract(remainder, r"^([^?#]*)", 1), r"\\", "/")
    query = F.regexp_extract(remainder, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(remainder, r"(#.*)$", 1)
    port_ok = (port == "") | (port.rlike("^[0-9]{1,5}$") & (port.try_cast("int") <= 65535))
    bad_host_chars = host.rlike(r"[\s#%/:<>?@\\^|\[\]]") & ~host.startswith("[")
    ok = (scheme != "") & (~special | ((host != "") & port_ok & shape_ok & ~bad_host_chars))
    return F.struct(scheme.alias("scheme"), userinfo.alias("userinfo"), host.alias("host"), port.alias("port"),
                    path.alias("path"), query.alias("query"), fragment.alias("fragment"), special.alias("special"),
                    ok.alias("ok"))


def normalise_url(parts: Column, host: Column) -> Column:
    """scheme://host[:port]path?query#fragment with default ports dropped and dot segments resolved."""
    scheme = parts["scheme"]
    port = parts["port"]
    default = F.create_map(*[x for kv in DEFAULT_PORTS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])[scheme]
    port_txt = F.when((port == "") | (port.try_cast("int").cast("string") == default), F.lit("")).otherwise(
        F.concat(F.lit(":"), port.try_cast("int").cast("string")))
    path = F.when(parts["path"] == "", F.lit("/")).otherwise(remove_dot_segments(parts["path"]))
    return F.concat(scheme, F.lit("://"), host, port_txt, path, parts["query"], parts["fragment"])


def cidr_bounds(cidr_col) -> Column:
    """IPv4 CIDR text -> struct(lo, hi) as longs; null for v6 or malformed entries."""
    c = _c(cidr_col)
    addr = F.substring_index(c, "/", 1)
    bits_txt = F.when(c.contains("/"), F.substring_index(c, "/", -1)).otherwise(F.lit("32"))
    bits = F.when(bits_txt.rlike("^[0-9]{1,2}$"), bits_txt.cast("int"))
    ip = F.when(addr.rlike(r"^\d+\.\d+\.\d+\.\d+$") & F.forall(F.split(addr, r"\."), lambda p: p.try_cast("long") <= 255),
                F.aggregate(F.split(addr, r"\."), F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long")))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - bits).cast("int"))
    lo = ip - F.pmod(ip, size)
    return F.when(ip.isNotNull() & bits.between(0, 32) & ~addr.contains(":"),
                  F.struct(lo.alias("lo"), (lo + size - 1).alias("hi")))


def ipv4_loose(col) -> Column:
    """Client address as a long: v4-mapped v6 prefix removed; 4 integer parts; null otherwise."""
    s = F.regexp_replace(_c(col), r"(?i)^::ffff:", "")
    parts = F.split(s, r"\.")
    ok = s.rlike(r"^\d{1,18}\.\d{1,18}\.\d{1,18}\.\d{1,18}$")
    val = F.aggregate(parts, F.lit(0).cast("long"),
                      lambda a, p: a * 256 + p.try_cast("long").bitwiseAND(F.lit(255)))
    return F.when(ok, val)
