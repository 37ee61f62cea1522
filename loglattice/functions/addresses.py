"""IP addresses of both versions as numbers, and what ranges they lie in.

An address is parsed by expressions to 32 hexadecimal digits, and from these to two unsigned
64-bit numbers; text of that length orders like the numbers, so ranges are tested on the digits.
An IPv4 address, also one that is mapped into IPv6, is treated as IPv4.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_TAIL = rf"^(.*:)({_OCTET}(?:\.{_OCTET}){{3}})$"

# Networks of the registries of special addresses.  Every border at which an
# address's treatment may change is the border of one of them.
SPECIAL_4 = """0.0.0.0/32 0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.0/29
192.0.0.8/32 192.0.0.9/32 192.0.0.10/32 192.0.0.170/31 192.0.2.0/24 192.31.196.0/24 192.52.193.0/24 192.88.99.0/24
192.168.0.0/16 192.175.48.0/24 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 255.255.255.255/32""".split()
SPECIAL_6 = """::/128 ::1/128 ::/8 ::ffff:0:0/96 64:ff9b::/96 64:ff9b:1::/48 100::/8 100::/64 100:0:0:1::/64 200::/7 400::/6 800::/5
1000::/4 2000::/3 2001::/23 2001::/32 2001:1::1/128 2001:1::2/128 2001:1::3/128 2001:2::/48 2001:3::/32 2001:4:112::/48
2001:10::/28 2001:20::/28 2001:30::/28 2001:db8::/32 2002::/16 2620:4f:8000::/48 3fff::/20 4000::/3 5f00::/16 6000::/3
8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 fec0::/10 ff00::/8""".split()


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def digits_v4(c: Column) -> Column:
    """An IPv4 address as 8 hexadecimal digits; null for anything else."""
    pair = lambda octets, k: F.lpad(F.hex(octets[k].try_cast("int")), 2, "0")
    return F.when(c.rlike(IPV4), _bound(F.split(c, r"\."), lambda octets: F.concat(*[pair(octets, k) for k in range(4)])))


def _tail_as_groups(s: Column) -> Column:
    """IPv6 text with an IPv4 address at its end as two groups."""
    groups = lambda d: F.concat(F.regexp_extract(s, _TAIL, 1), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4))
    return F.when(s.contains("."), F.coalesce(_bound(digits_v4(F.regexp_extract(s, _TAIL, 2)), groups), s)).otherwise(s)


def _eight_groups(left: Column, right: Column, short: Column) -> Column:
    """The digits of the groups before and after ``::``; all groups are before it if there is none."""
    n = F.size(left) + F.size(right)
    good = F.when(short, n <= 7).otherwise(n == 8) & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), right)
    return F.when(good, F.upper(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))


def _halves(half: Column) -> Column:
    """The digits of what ``::`` splits, which it may do once."""
    short = F.size(half) == 2
    right = F.when(short, _groups(F.try_element_at(half, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    sides = F.struct(_groups(half[0]).alias("left"), right.alias("right"), short.alias("short"))
    return F.when(F.size(half) <= 2, _bound(sides, lambda x: _eight_groups(x["left"], x["right"], x["short"])))


def digits_v6(c: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits in upper case; null for anything else.  A zone is taken off.

    Each step is bound, as the next one uses it more than once and whatever is not bound is computed anew at every use.
    """
    s = F.regexp_replace(F.lower(F.trim(c)), "%[^%/]+$", "")
    return F.when(c.contains(":"), _bound(_bound(_bound(s, _tail_as_groups), lambda x: F.when(x.contains(":"), F.split(x, "::", -1))), _halves))


MAPPED = "00000000000000000000FFFF"


def digits(c: Column) -> Column:
    """The 32 digits of an address of either version, IPv4 as mapped; null for anything else."""
    s = F.trim(c)
    return F.when(s.rlike(IPV4), F.concat(F.lit(MAPPED), digits_v4(s))).when(s.contains(":"), digits_v6(s))


def number(c: Column) -> Column:
    """(hi, lo): the halves of an address as unsigned numbers, in structs that order like addresses."""
    half = lambda d, at: F.conv(F.substring(d, at, 16), 16, 10).cast("decimal(20,0)")
    return _bound(digits(c), lambda d: F.when(d.isNotNull(), F.struct(half(d, 1).alias("hi"), half(d, 17).alias("lo"))))


def is_generic(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Whether an address points to no one machine."""
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_loopback or ip.is_unspecified or ip.is_link_local or ip.is_multicast or ip.is_reserved


def is_public(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Whether an address may be looked up outside; site-local ones may not, although they count as global."""
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not (ip.is_private or is_generic(ip) or (ip.version == 6 and ip in ipaddress.ip_network("fec0::/10")))


@cache
def ranges(test: Callable, version: int) -> tuple[tuple[str, str], ...]:
    """The (first, last) digits of the ranges whose addresses pass a test, between the borders of the special networks."""
    bits = 32 if version == 4 else 128
    nets = [ipaddress.ip_network(n) for n in (SPECIAL_4 if version == 4 else SPECIAL_6)]
    borders = sorted({0, 1 << bits, *(int(n.network_address) for n in nets), *(int(n.broadcast_address) + 1 for n in nets)})
    make = ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address
    out: list[list[int]] = []
    for a, b in zip(borders, borders[1:]):
        if (version == 4 or make(a).ipv4_mapped is None) and test(make(a)):
            if out and out[-1][1] == a - 1:
                out[-1][1] = b - 1
            else:
                out.append([a, b - 1])
    return tuple((f"{a:0{bits // 4}X}", f"{b:0{bits // 4}X}") for a, b in out)


def _inside(c: Column, found: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, y: x | y, [c.between(a, b) for a, b in found])


def _six(s: Column, test: Callable) -> Column:
    pick = lambda d: F.when(d.startswith(MAPPED), _inside(F.substring(d, 25, 8), ranges(test, 4))).otherwise(_inside(d, ranges(test, 6)))
    return _bound(digits_v6(s), pick)


#: Digits of IPv6 addresses that are generic: mapped ones that are so as IPv4, and all but global unicast, unique local and site-local ones.
_GENERIC_6 = f"^(?:{MAPPED}(?:00000000|7F|A9FE|[EF])|(?!{MAPPED})(?![23]|F[CD]|FE[C-F]))"


def generic(c: Column) -> Column:
    """Whether text is no address or one that points to no one machine.

    Every event asks this, so the ranges are told by the first octets or digits and not looked up.
    """
    s = F.trim(c)
    first = F.substring_index(s, ".", 1).try_cast("int")
    four = (s == "0.0.0.0") | (first == 127) | (first >= 224) | s.startswith("169.254.")
    return F.coalesce(F.when(s.rlike(IPV4), four).when(s.contains(":"), digits_v6(s).rlike(_GENERIC_6)), F.lit(True))


def public(c: Column) -> Column:
    """Whether text is an address that may be looked up outside."""
    s = F.trim(c)
    four = _bound(digits_v4(s), lambda d: _inside(d, ranges(is_public, 4)))
    return F.coalesce(F.when(s.rlike(IPV4), four).when(s.contains(":"), _six(s, is_public)), F.lit(False))
