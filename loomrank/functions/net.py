"""Addresses as numbers and the check of urls that may be fetched; Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrank.functions.text import once

# Address blocks that are not public, as first address and prefix length.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("100.64.0.0", 10), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("192.88.99.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)
PRIVATE_V6 = (("00000000000000000000000000000000", 128), ("00000000000000000000000000000001", 128), ("fc", 7), ("fe80", 10), ("ff", 8), ("20010db8", 32))

_MAPPED = "00000000000000000000ffff"


def _span4(first: str, bits: int) -> tuple[int, int]:
    start = reduce(lambda n, o: n * 256 + int(o), first.split("."), 0)
    return start, start + (1 << (32 - bits)) - 1


def _span6(first: str, bits: int) -> tuple[str, str]:
    start = int(first.ljust(32, "0"), 16)
    return f"{start:032x}", f"{start + (1 << (128 - bits)) - 1:032x}"


def ipv4_number(host: Column) -> Column:
    """The number of an IPv4 address, also in the short, octal and hexadecimal spellings that clients accept; null if it isn't one."""
    value = lambda p: (F.when(p.rlike("^0[xX][0-9a-fA-F]{0,12}$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 12)), 16, 10))
                       .when(p.rlike("^0[0-7]{1,14}$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]{0,14})$"), p)).try_cast("long")

    def number(parts: Column) -> Column:
        front, last, n = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1), F.least(F.size(parts), F.lit(4))
        scale = F.element_at(F.array(*[F.lit(256 ** (5 - k)) for k in range(1, 5)]), n)
        fits = (F.size(parts) <= 4) & F.forall(parts, lambda x: x.isNotNull()) & F.forall(front, lambda x: x <= 255) & (last < scale)
        return F.when(fits, F.aggregate(front, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * scale + last)

    return once(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), value), number)


def ipv6_hex(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, with or without brackets; null if it isn't one."""
    none = F.array().cast("array<string>")
    tail = r"(?:^|(?<=:))\d{1,3}(?:\.\d{1,3}){3}$"
    groups = lambda s: F.when(F.coalesce(s, F.lit("")) == "", none).otherwise(F.split(s, ":", -1))

    def joined(bare: Column, number: Column) -> Column:
        digits = F.lower(F.lpad(F.hex(number), 8, "0"))
        return F.when(number.isNotNull(), F.concat(F.regexp_replace(bare, tail, ""), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))).otherwise(bare)

    def filled(halves: Column) -> Column:
        left, right = groups(F.get(halves, 0)), groups(F.get(halves, 1))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        return F.when(F.size(halves) <= 2, F.concat(left, F.when(F.size(halves) == 2, zeros).otherwise(none), right))

    whole = once(F.lower(F.regexp_replace(host, r"^\[|\]$", "")), lambda bare: once(
        F.struct(ipv4_number(F.regexp_extract(bare, tail, 0)).alias("n"), bare.alias("b")), lambda x: once(F.split(joined(x["b"], x["n"]), "::", -1), filled)))
    return once(whole, lambda w: F.when((F.size(w) == 8) & F.forall(w, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(w, lambda g: F.lpad(g, 4, "0")), "")))


def is_public(address: Column) -> Column:
    """True for an address outside all reserved blocks; false for one inside, and for what is no address. IPv4 inside IPv6 goes by the IPv4 blocks."""
    within = lambda x, spans: reduce(lambda a, b: a | b, [x.between(F.lit(lo), F.lit(hi)) for lo, hi in spans])
    spans4, spans6 = [_span4(*b) for b in PRIVATE_V4], [_span6(*b) for b in PRIVATE_V6]
    # an IPv4 address, or one inside an IPv6 address, is a number; other IPv6 addresses stay digits
    known = once(F.when(F.contains(address, F.lit(":")), ipv6_hex(address)), lambda v6: F.struct(
        v6.alias("v6"), F.when(v6.startswith(_MAPPED), F.conv(F.substring(v6, 25, 8), 16, 10).cast("long")).otherwise(ipv4_number(address)).alias("v4")))
    return once(known, lambda k: F.coalesce(F.when(k["v4"].isNotNull(), ~within(k["v4"], spans4)).when(k["v6"].isNotNull(), ~within(k["v6"], spans6)), F.lit(False)))


def outbound_verdict(url: Column, resolved: Column, allow_private: bool = False) -> Column:
    """Why a url may not be fetched, or `ok`. resolved: the addresses that the host's name has (array of strings), from a lookup table; literal addresses need none."""
    get = lambda k: F.regexp_extract(F.trim(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*):(?://)?((?:[^/?#]*@)?)(\[[^\]/?#]*\]|[^/?#:@]*)(:\d*)?([/?#].*)?$", k)
    parts = F.struct(F.lower(get(1)).alias("scheme"), get(2).alias("credentials"), F.lower(get(3)).alias("host"), F.regexp_replace(get(4), ":", "").try_cast("int").alias("port"),
                     F.lower(F.regexp_replace(get(3), r"^\[|\]$", "")).alias("name"))

    def judged(p: Column) -> Column:
        bracket = p["host"].startswith("[")
        # a name that ends in a number but is no address is broken, too
        literal = once(F.when(bracket, ipv6_hex(p["name"]).isNotNull()).when(p["host"].rlike(r"(^|\.)(0[xX][0-9a-fA-F]*|[0-9]+)\.?$"), ipv4_number(p["host"]).isNotNull()), lambda is_address: F.struct(
            F.coalesce(is_address, F.lit(True)).alias("sound"), F.when(is_address, F.array(p["name"])).otherwise(F.coalesce(resolved, F.array().cast("array<string>"))).alias("addresses")))

        def verdict(a: Column) -> Column:
            v = (F.when(url.isNull() | (p["scheme"] == "") | (p["port"] > 65535) | ~a["sound"], "invalid URL")
                 .when(~p["scheme"].isin("http", "https"), F.concat(F.lit("blocked URL protocol: "), p["scheme"], F.lit(":")))
                 .when(F.length(p["credentials"]) > 1, "blocked URL containing credentials").when(p["host"] == "", "blocked URL without a hostname"))
            if allow_private:
                return v.otherwise("ok")
            v = v.when(F.size(a["addresses"]) == 0, F.concat(F.lit("hostname did not resolve: "), p["name"]))
            return once(F.get(F.filter(a["addresses"], lambda x: ~is_public(x)), 0), lambda bad: v.when(
                bad.isNotNull(), F.concat(F.lit("blocked non-public address for "), p["name"], F.lit(": "), bad)).otherwise("ok"))

        return once(literal, verdict)

    return once(parts, judged)
