"""URL safety as a Column expression. Literal addresses only: names are not resolved here.

A URL is taken apart once; each part, and the address read from the host, is bound to a variable of a one-element array, so that the range tests
don't repeat the parsing.
"""

from __future__ import annotations

from collections.abc import Callable
from ipaddress import ip_network

from pyspark.sql import Column, functions as F

# Networks no fetch may reach.
BLOCKED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.168.0.0/16 198.18.0.0/15 224.0.0.0/4 240.0.0.0/4".split()
# The same for IPv6, and the networks that stand for IPv4 addresses.
BLOCKED6 = "::/128 ::1/128 fc00::/7 fe80::/10 ff00::/8".split()
MAPPED = "::ffff:0:0/96 64:ff9b::/96".split()
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?.*$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hex_pattern(network: str) -> str:
    """What the 32 hex digits of a network's addresses begin with."""
    n = ip_network(network)
    digits, rest = divmod(n.prefixlen, 4)
    whole = f"{int(n.network_address):032x}"
    if not rest:
        return f"^{whole[:digits]}"
    low = int(whole[digits], 16)
    return f"^{whole[:digits]}[{''.join(f'{d:x}' for d in range(low, low + (1 << 4 - rest)))}]"


def address(host: Column) -> Column:
    """A dotted IPv4 address as a number, else null."""
    number = lambda p: sum((F.get(p, F.lit(i)).cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(host.rlike(f"^{_QUAD}$"), let(F.split(host, r"\."), number))


def address6(text: Column) -> Column:
    """An IPv6 address without brackets as 32 hex digits, else null. A dotted tail counts as two groups."""
    dotted = let(F.regexp_extract(text, rf":({_QUAD})$", 1), lambda q: F.when(q == "", text).otherwise(F.concat(F.regexp_replace(text, rf"{_QUAD}$", ""), let(F.format_string("%08x", address(q)), lambda h: F.concat(F.left(h, F.lit(4)), F.lit(":"), F.right(h, F.lit(4)))))))
    groups = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def filled(sides: Column) -> Column:
        head, tail = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        gap = F.lit(8) - F.size(head) - F.size(tail)
        short = F.size(sides) == 2
        return F.when(short & (gap >= 1) | (F.size(sides) == 1) & (gap == 0), F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), tail))

    whole = let(F.split(F.lower(dotted), "::"), filled)
    return let(whole, lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))


def _inside(ip: Column) -> Column:
    found = F.lit(False)
    for n in map(ip_network, BLOCKED):
        found = found | ip.between(int(n[0]), int(n[-1]))
    return found


def _inside6(hex_: Column) -> Column:
    mapped = F.when(hex_.rlike("|".join(map(_hex_pattern, MAPPED))), let(F.conv(F.right(hex_, F.lit(8)), 16, 10).cast("bigint"), _inside)).otherwise(False)
    return hex_.isNull() | hex_.rlike("|".join(map(_hex_pattern, BLOCKED6))) | mapped


def refused(url: Column) -> Column:
    """Why a URL may not be fetched, or null: scheme, host, port, address."""
    parts = F.when(url.rlike(_PARTS), F.split(F.regexp_replace(url, _PARTS, "$1\n$2\n$3"), "\n"))

    def judge(p: Column) -> Column:
        scheme, host, port = (F.lower(F.get(p, F.lit(i))) for i in range(3))
        literal6 = host.startswith("[")
        bad = F.when(literal6, let(address6(F.regexp_replace(host, r"^\[|\]$", "")), _inside6)).otherwise(let(address(host), lambda a: F.coalesce(_inside(a), F.lit(False))))
        return F.when(~F.coalesce(scheme, F.lit("")).isin("http", "https"), "scheme").when(host == "", "host").when(host == "localhost", "address").when((port != "") & ~port.isin("80", "443"), "port").when(bad, "address")

    return let(parts, judge)
