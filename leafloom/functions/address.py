"""Whether a link points to the open network: addresses as 32 hex digits, looked up in a sorted table of ranges inside the expression."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ordered import places_below

# Networks of the registries of special-purpose addresses that are not reachable from everywhere, and those within them that are.
CLOSED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
OPEN_WITHIN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: Addresses of version 4 lie here among those of version 6, which is where mapped ones are too.
_MAPPED = 0xFFFF << 32


def _ends(network: str) -> tuple[int, int]:
    n = ipaddress.ip_network(network)
    base = _MAPPED if n.version == 4 else 0
    return base + int(n[0]), base + int(n[-1]) + 1


def ranges() -> list[tuple[str, bool]]:
    """(first address, whether what begins there is open), sorted; each range goes on to the next."""
    closed, open_ = [_ends(n) for n in CLOSED], [_ends(n) for n in OPEN_WITHIN]
    held = lambda spans, x: any(a <= x < b for a, b in spans)
    cuts = sorted({0, *(x for span in (*closed, *open_) for x in span if x < 1 << 128)})
    out: list[tuple[str, bool]] = []
    for x in cuts:
        flag = not held(closed, x) or held(open_, x)
        if not out or out[-1][1] != flag:
            out.append((f"{x:032x}", flag))
    return out


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _octets(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "[.]"), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0")), "")


def address_digits(c: Column) -> Column:
    """32 hex digits of a literal address of either version, in brackets or not; null if it is none."""
    a = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^\[(.*)\]$", "$1"), "%[^%]+$", "")
    four = F.when(a.rlike(f"^{_V4}$"), F.lower(F.concat(F.lit("0" * 20 + "ffff"), _octets(a))))
    tail = F.regexp_extract(a, f"^[0-9a-f:]*:({_V4})$", 1)
    digits = F.lower(_octets(tail))
    six = F.when(tail == "", a).otherwise(F.concat(F.substring(a, F.lit(1), F.length(a) - F.length(tail)), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4)))
    halves = F.split(six, "::", -1)
    groups = lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))
    left, right = groups(halves[0]), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    fits = F.when(F.size(halves) == 1, n == 8).otherwise((F.size(halves) == 2) & (n <= 7)) & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    wide = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    whole = F.concat(wide(left), F.repeat(F.lit("0000"), 8 - n), wide(right))
    return F.coalesce(four, F.when(a.contains(":") & fits, whole))


def is_public_address(c: Column) -> Column:
    """Whether a literal address is reachable from everywhere; null if it is no address. Mapped addresses count as those they map."""
    table = ranges()
    starts, flags = F.array(*[F.lit(a) for a, _ in table]), F.array(*[F.lit(f) for _, f in table])
    digits = address_digits(c)
    return F.when(digits.isNotNull(), F.get(flags, places_below(starts, digits, len(table), or_equal=True) - 1))


def host_of(url: Column) -> Column:
    """The host of a link in lower case, without user and port; '' without one."""
    place = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(place, "^.*@", "")
    return F.lower(F.regexp_replace(bare, r"^(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$", "$1"))


def link_problem(url: Column, addresses: Column) -> Column:
    """Why a link is not fetched, else null. addresses: all that its host's name stands for (a literal address stands for itself).

    Only http and https are taken, and only where every address of the host is public.
    """
    host = host_of(url)
    found = F.when(address_digits(host).isNotNull(), F.array(host)).otherwise(addresses)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    public = F.forall(found, lambda a: F.coalesce(is_public_address(a), F.lit(False)))
    return F.when(~F.coalesce(scheme, F.lit("")).isin("http", "https"), "scheme").when(host == "", "host").when(F.coalesce(F.size(found), F.lit(0)) < 1, "unknown").when(~public, "private")
