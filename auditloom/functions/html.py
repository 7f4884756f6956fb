"""Parts of stored HTML as column expressions.

Scripts, styles and comments are removed before any tag is looked for, because pages are malformed and carry
tags inside script strings. These expressions stay in the JVM; nesting-dependent rules use the element table
of auditloom.sources.elements instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def unescape(text: Column) -> Column:
    """The entities that occur in stored pages; `&amp;` last, so that nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def text_of(fragment: Column) -> Column:
    """Text without tags, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(fragment, "<[^>]*>", " ")), r"[ \t\n\r]+", " "))


def element(html: Column, tag: str) -> Column:
    """Inner HTML of the first such element, empty if there is none."""
    return F.regexp_extract(stripped(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def count_elements(html: Column, tag: str) -> Column:
    return F.regexp_count(stripped(html), F.lit(rf"(?i)<{tag}[\s>]")).cast("long")


#: The value of an attribute: in double quotes, in single quotes, or without. Three groups, of which one is filled.
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: From a tag's name to an attribute: other attributes end with white space or a quotation mark.
BEFORE = r"""(?:[^>]*?[\s"'])??"""


def _value(tag: Column, pattern: str) -> Column:
    return unescape(F.concat(*[F.regexp_extract(tag, pattern, n) for n in (1, 2, 3)]))


def anchors(html: Column) -> Column:
    """Array of struct(href, label) of links with an href, whatever its quotation marks, in document order."""
    href = rf"(?is)<a\s{BEFORE}href{VALUE}"
    found = F.regexp_extract_all(stripped(html), F.lit(href + "[^>]*>.*?</a>"), F.lit(0))
    return F.transform(found, lambda a: F.struct(_value(a, href).alias("href"), text_of(a).alias("label")))


def attribute(html: Column, tag: str, name: str) -> Column:
    """The attribute of the first such element that has it; empty if there is none."""
    return _value(stripped(html), rf"(?is)<{tag}\s{BEFORE}{name}{VALUE}")