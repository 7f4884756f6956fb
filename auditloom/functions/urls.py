"""Url identities as column expressions. Three normal forms coexist and are not interchangeable.

A url is split with one regular expression, so a malformed one gives empty parts instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, host with port, path, query, fragment (RFC 3986, appendix B)
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

#: Query parameters that only track visits.
TRACKING = r"^(utm_[a-z_]+|fbclid|gclid|dclid|gbraid|wbraid|msclkid|mc_cid|mc_eid|_ga|_gl|igshid|ref_src|_rsc)$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def raw_path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def bare_host(url: Column) -> Column:
    """The host without a leading `www.`."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """The path without trailing slashes and without the query; the root is `/`."""
    cut = F.regexp_replace(raw_path(url), "/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def norm(url: Column) -> Column:
    """Equality form: host lower-cased, trailing slash and fragment dropped, query kept."""
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), host(url), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def path_key(url: Column) -> Column:
    """Path and query: the key that pairs pages of two servers."""
    q = query(url)
    return F.concat(path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def clean(url: Column) -> Column:
    """Crawl identity: no fragment, no tracking parameters, host lower-cased, path as it is."""
    kept = F.filter(F.split(query(url), "&"), lambda kv: (kv != "") & ~F.lower(F.substring_index(kv, "=", 1)).rlike(TRACKING))
    q = F.array_join(kept, "&")
    p = F.when(raw_path(url) == "", F.lit("/")).otherwise(raw_path(url))
    return F.concat(scheme(url), F.lit("://"), host(url), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def segments(url: Column) -> Column:
    return F.filter(F.split(raw_path(url), "/"), lambda s: s != "")


def _without_dots(url: Column) -> Column:
    """The url with `.` segments of its path dropped and `..` segments taken with the one before them."""
    p = raw_path(url)
    parts = F.split(p, "/")
    none = F.array().cast("array<string>")
    step = lambda have, s: F.when(s == ".", have).when(s == "..", F.when(F.size(have) > 1, F.slice(have, 1, F.size(have) - 1)).otherwise(have)).otherwise(F.array_append(have, s))
    kept = F.array_join(F.aggregate(parts, none, step), "/")
    folder = F.element_at(parts, -1).isin(".", "..") & ~kept.endswith("/")
    clean = F.concat(kept, F.when(folder, F.lit("/")).otherwise(F.lit("")))
    head = F.concat(scheme(url), F.lit("://"), part(url, 2))
    tail = F.concat(F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""), F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise(""))
    return F.when(scheme(url).isin("http", "https") & p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, clean, tail)).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """An href against its page, for absolute, `//host`, `/rooted`, `?query`, `#fragment` and relative forms.

    Relative paths are joined to the page's folder, and the segments `.` and `..` of the joined path are resolved.
    """
    origin = F.concat(scheme(base), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.concat(origin, raw_path(base)), r"(://[^/]*)?[^/]*$", "$1")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    here = F.concat(origin, raw_path(base))
    asked = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(here, href))
        .when(href.startswith("#") | (href == ""), F.concat(here, asked, href))
        .otherwise(_without_dots(F.when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))))
    )
