"""IP addresses as fixed-width text, so that ranges and prefixes compare as plain strings.

An address becomes its family and its hex digits: ``4:0a000001`` or ``6:20010db8...``; text that is no address is
null.  Everything is built from Spark functions, so no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

QUAD = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
GROUPS = r"([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)"
V6_FORM = rf"^({GROUPS}|{GROUPS}?::{GROUPS}?)$"


def _quad_hex(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0"))
    return F.lower(F.array_join(parts, ""))


def _v6_hex(text: Column) -> Column:
    tail = F.substring_index(text, ":", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    quad = _quad_hex(tail)
    plain = F.when(tail.rlike(f"^{QUAD}$"), F.concat(head, F.substring(quad, 1, 4), F.lit(":"), F.substring(quad, 5, 4))
                   ).otherwise(text)

    def expand(p: Column) -> Column:
        halves = F.split(p, "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"),
                                    lambda x: x != "")
        left, right = groups(0), groups(1)
        missing = F.lit(8) - F.size(left) - F.size(right)
        full = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        ok = p.rlike(V6_FORM) & F.when(p.contains("::"), missing >= 1).otherwise(missing == 0)
        return F.when(ok, F.lower(F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), "")))

    return F.transform(F.array(plain), expand)[0]


def ip_hex(ip: Column) -> Column:
    """Family and hex digits of an IPv4 or IPv6 address, or null."""
    return (F.when(ip.rlike(f"^{QUAD}$"), F.concat(F.lit("4:"), _quad_hex(ip)))
            .when(ip.contains(":"), F.concat(F.lit("6:"), _v6_hex(ip))))


def _nibble_mask(address: Column, bits: Column, low: bool) -> Column:
    """Keep ``bits`` leading bits of the hex digits; the rest becomes 0 (low) or f (high)."""
    whole = F.floor(bits / 4).cast("int")
    used = (bits % 4).cast("int")
    digit = F.conv(F.substring(address, whole + 3, F.lit(1)), 16, 10).cast("int")
    rest = F.pow(F.lit(2), 4 - used).cast("int")  # values the free bits of the digit can take
    base = F.floor(digit / rest).cast("int") * rest
    edge = F.lower(F.hex(base if low else base + rest - 1))
    kept = F.concat(F.substring(address, F.lit(1), whole + 2), edge)
    total = (F.length(address) - 2) * 4
    return F.when(bits == total, address).when(bits.between(0, total - 1),
                                               F.rpad(kept, F.length(address), "0" if low else "f"))


def network(address: Column, bits: Column) -> Column:
    """First address of the network that holds ``address``; null when the prefix does not fit the family."""
    return _nibble_mask(address, bits, low=True)


def cidr_range(cidr: Column) -> Column:
    """Struct (lo, hi, bits) of a CIDR text; host bits are ignored; null bounds when the text is invalid."""
    address = ip_hex(F.substring_index(cidr, "/", 1))
    bits = F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(
        (F.length(address) - 2) * 4)
    return F.struct(_nibble_mask(address, bits, True).alias("lo"), _nibble_mask(address, bits, False).alias("hi"),
                    bits.alias("bits"))


def register(spark: SparkSession) -> None:
    """IPv4 helpers as temporary SQL functions: ``ip_to_long``, ``cidr_lo``, ``cidr_hi``; bad text gives null."""
    octet = "IF(try_cast(x AS INT) BETWEEN 0 AND 255, try_cast(x AS INT), NULL)"
    free = "shiftleft(1L, 32 - coalesce(try_cast(get(split(cidr, '/'), 1) AS INT), 32))"
    low = f"ip_to_long(split(cidr, '/')[0]) DIV {free} * {free}"
    for name, arg, body in (
            ("ip_to_long", "ip", f"IF(size(split(ip, '[.]')) = 4, aggregate(split(ip, '[.]'), 0L, (a, x) -> a * 256L + {octet}), NULL)"),
            ("cidr_lo", "cidr", low), ("cidr_hi", "cidr", f"{low} + {free} - 1")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg} STRING) RETURNS BIGINT RETURN {body}")
