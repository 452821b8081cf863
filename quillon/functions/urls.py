"""URL and address rules as expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 ranges that are not public.
BLOCKED_RANGES = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]

IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
LOCAL_NAMES = r"(?i)^(localhost|.*\.localhost|.*\.local|.*\.internal)$"


def span(address: str, prefix: int) -> tuple[int, int]:
    """First and last number of a range."""
    first = reduce(lambda n, part: n * 256 + int(part), address.split("."), 0)
    first -= first % (1 << (32 - prefix))
    return first, first + (1 << (32 - prefix)) - 1


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; keeps generated code small where the body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return reduce(lambda n, i: n * 256 + F.try_element_at(parts, F.lit(i)).try_cast("long"), range(2, 5), F.try_element_at(parts, F.lit(1)).try_cast("long"))


def blocked_ipv4(ip: Column) -> Column:
    """A handful of comparisons in the projection; no join with a table of ranges."""
    return given(ipv4_number(ip), lambda n: reduce(lambda a, b: a | b, [n.between(*span(*r)) for r in BLOCKED_RANGES]))


def blocked_ip(ip: Column) -> Column:
    """Not public: IPv4 ranges; of IPv6 loopback, unspecified, link-local, unique local, and mapped IPv4."""

    def judge(low: Column) -> Column:
        mapped = F.regexp_replace(low, r"^::ffff:(?=\d+\.\d+\.\d+\.\d+$)", "")
        six = low.isin("::1", "::") | low.rlike("^fe[89ab]") | low.rlike("^f[cd][0-9a-f]{2}:")
        return F.when(mapped.rlike(IPV4), blocked_ipv4(mapped)).otherwise(F.coalesce(six, F.lit(False)))

    return given(F.lower(ip), judge)


def refusal(url: Column) -> Column:
    """Why an address may not be fetched, null if it may. Names are judged as they stand, without looking them up."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)

    def judge(p: Column) -> Column:
        host = F.regexp_extract(F.regexp_replace(p["authority"], "^.*@", ""), r"^(?:\[([^\]]*)\]|([^:]*))", 0)
        bad = given(F.regexp_replace(host, r"^\[|\]$", ""), lambda h: h.rlike(LOCAL_NAMES) | blocked_ip(h))
        web = p["scheme"].isin("http", "https")
        return (
            F.when((p["scheme"] == "") | ((p["authority"] == "") & web), "invalid").when(~web, "scheme")
            .when(p["authority"].contains("@"), "credentials").when(bad, "address")
        )

    found = given(F.struct(scheme.alias("scheme"), authority.alias("authority")), judge)
    return F.when(url.isNull(), "invalid").otherwise(found)


def is_url(text: Column) -> Column:
    """A scheme and a host without white space, or a scheme and something after it."""
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^\s/?#]+[^\s]*|[^\s/][^\s]*)$")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9_'+\-]+(\.[A-Za-z0-9_'+\-]+)*@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$")
