"""Addresses as column expressions: one canonical spelling, keys, hosts and what may be dialled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltline.functions.text import let

#: RFC 3986, appendix B: scheme, authority, path, query.
RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query keys that name a campaign, not a page.
TRACKING_KEYS = ("cmpid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "msclkid", "ref", "referrer", "s", "src")
TRACKING_PREFIX = "utm_"
#: Names and endings that resolve inward.
LOOPBACK_NAMES = ("localhost", "ip6-localhost", "ip6-loopback")
INTERNAL_SUFFIXES = (".localhost", ".local", ".internal", ".localdomain")
#: Statuses that ask to come back.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, RFC, group)


def _authority(url: Column) -> Column:
    return F.regexp_replace(_part(url, 2), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host without user, port or brackets; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(_authority(url), r"^(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", ""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def canonicalise(url: Column) -> Column:
    """One address per story: case, default port, www, tracking keys, query order, fragment and trailing slashes do not count."""
    url = F.trim(url)
    scheme = F.lower(_part(url, 1))
    port = F.regexp_replace(F.regexp_extract(_authority(url), r":([0-9]+)$", 1), "^0+", "")
    usual = F.when(scheme == "http", "80").when(scheme == "https", "443").otherwise("")
    place = F.when((port == "") | (port == usual), domain_of(url)).otherwise(F.concat(domain_of(url), F.lit(":"), port))
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    pairs = F.transform(
        F.filter(F.split(_part(url, 4), "&"), lambda x: x != ""),
        lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.lower(p["k"]).startswith(TRACKING_PREFIX)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(scheme, F.lit("://"), place, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def url_key(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def robots_url(url: Column) -> Column:
    return F.concat(_part(url, 1), F.lit("://"), _part(url, 2), F.lit("/robots.txt"))


def _ipv4_is_global(h: Column) -> Column:
    """Dotted quads outside the private, loopback, link-local, shared, documentation, multicast and reserved ranges."""
    a, b, c = (F.regexp_extract(h, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).cast("int") for i in (1, 2, 3))
    inward = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return ~inward


def _ipv6_groups(h: Column) -> Column:
    """The eight groups of an address as numbers; null if it is none."""

    def parted(bare: Column) -> Column:
        quad = [F.regexp_extract(bare, r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).cast("int") for i in (1, 2, 3, 4)]
        tail = F.concat(F.hex(quad[0] * 256 + quad[1]), F.lit(":"), F.hex(quad[2] * 256 + quad[3]))
        return F.split(F.when(bare.contains("."), F.concat(F.regexp_replace(bare, r"[\d.]+$", ""), tail)).otherwise(bare), "::")

    def filled(sides: Column) -> Column:
        left, right = (F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "") for i in (0, 1))
        missing = F.when(F.size(sides) == 2, F.greatest(8 - F.size(left) - F.size(right), F.lit(0))).otherwise(0)
        return F.when(F.size(sides) <= 2, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def numbered(whole: Column) -> Column:
        sound = (F.size(whole) == 8) & F.forall(whole, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(sound, F.transform(whole, lambda x: F.conv(x, 16, 10).cast("int")))

    return let(let(let(F.substring_index(h, "%", 1), parted), filled), numbered)


def _ipv6_is_global(h: Column) -> Column:
    """By the registry of special addresses; null if it is no address."""

    def told(groups: Column) -> Column:
        g = [F.get(groups, F.lit(i)) for i in range(8)]
        zero = lambda upto: F.forall(F.slice(groups, 1, upto), lambda x: x == 0)
        quad = F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(g[6], 8), g[6] % 256, F.shiftright(g[7], 8), g[7] % 256)])
        special = (
            (zero(7) & (g[7] <= 1)) | ((g[0] == 0x64) & (g[1] == 0xFF9B) & (g[2] == 1)) | ((g[0] == 0x100) & (g[1] == 0) & (g[2] == 0) & (g[3] == 0)) | ((g[0] == 0x2001) & (g[1] == 0xDB8)) | (g[0] == 0x2002)
            | g[0].between(0xFC00, 0xFDFF) | g[0].between(0xFE80, 0xFEBF)
        )
        # 2001::/23 is for protocols, but for a few of these that are global
        anycast = (g[1] == 1) & F.forall(F.slice(groups, 3, 5), lambda x: x == 0) & g[7].between(1, 2)
        exempt = anycast | (g[1] == 3) | ((g[1] == 4) & (g[2] == 0x112)) | g[1].between(0x20, 0x3F)
        protocol = (g[0] == 0x2001) & (g[1] < 0x200) & ~exempt
        return F.when(zero(5) & (g[5] == 0xFFFF), let(quad, _ipv4_is_global)).otherwise(~(special | protocol))

    return let(_ipv6_groups(h), lambda groups: F.when(groups.isNotNull(), told(groups)))


def why_not_dialable(url: Column) -> Column:
    """Null if the address may be dialled, else the reason. Names are not resolved here."""

    def reason(own: Column) -> Column:
        h, scheme = own["host"], own["scheme"]
        quad = h.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
        inward = h.isin(*LOOPBACK_NAMES)
        for ending in INTERNAL_SUFFIXES:
            inward = inward | h.endswith(ending)
        return (
            F.when(~scheme.isin("http", "https"), F.concat(F.lit("scheme '"), scheme, F.lit("' is not fetchable")))
            .when(h == "", "no host in address")
            .when(inward, "address resolves inward")
            .when(quad & ~_ipv4_is_global(h), "address is not on the public internet")
            .when(h.contains(":") & ~F.coalesce(_ipv6_is_global(h), F.lit(True)), "address is not on the public internet")
        )

    return let(F.struct(host(url).alias("host"), F.lower(_part(url, 1)).alias("scheme")), reason)


def classify_status(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status.isin(*RETRYABLE), "transient").otherwise("permanent")


def article_status(outcome: Column) -> Column:
    """Fetch outcome to article status."""
    return F.when(outcome == "ok", "ok").when(outcome.isin("robots_denied", "blocked"), "robots_denied").otherwise("fetch_failed")


def backoff_delays(initial: float, multiplier: float, retries: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(retries - 1)), lambda i: F.lit(initial) * F.pow(F.lit(multiplier), i)) if retries > 0 else F.array().cast("array<double>")
