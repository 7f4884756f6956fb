"""Ordered classifications as CASE expressions: hosts, paths, statuses, headers, dates, byte signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that a crawl leaves out.
SKIP_EXT = (
    r"\.(pdf|jpe?g|png|gif|webp|avif|svg|ico|bmp|tiff?|heic|mp4|webm|mov|m4v|avi|mp3|wav|ogg|zip|rar|gz|tgz|tar|7z|exe|dmg|apk|css|js|mjs|map|json|xml|txt|rss|atom|"
    r"woff2?|ttf|otf|eot|csv|xlsx?|docx?|pptx?)$"
)
#: Paths that a crawl leaves out.
SKIP_PATH = r"^/(_next|api|cdn-cgi|__nextjs[^/]*|_vercel|\.netlify)(/|$)"
#: Hosts that are not public.
PRIVATE_HOST = r"^(localhost|127\.|0\.0\.0\.0|10\.|192\.168\.)|\.local$"
#: Whole segments and endings of the paths of test pages, in any letter case.
TEST_PAGE = (
    r"(?i)/(test|test-?page|demo|demo-?page|sample|sample-?page|lorem(-ipsum)?|untitled(-[0-9]+)?|draft|tmp|temp|backup|hello-world|new-page)(/|$)|-(copy|old|backup|draft|tmp)(/|$)"
)
#: What debugging leaves in texts, and urls of development servers.
DEBUG_TEXT = r"\b(undefined|nan|\[object object\]|todo|fixme|lorem ipsum|console\.log)\b"
DEV_URL = r"https?://(localhost|127\.0\.0\.1|0\.0\.0\.0|192\.168\.[0-9]+\.[0-9]+|[A-Za-z0-9_-]+\.local|staging\.[A-Za-z0-9_.-]+|dev\.[A-Za-z0-9_.-]+|[A-Za-z0-9_-]+\.vercel\.app)(:[0-9]+)?"
#: Files that hold secrets, and files that are built, in any letter case.
SECRET_FILES = r"(?i)(^|/)(\.env(\.[A-Za-z0-9_.-]+)?|id_rsa|id_ed25519|.*\.pem|.*\.p12|.*\.pfx|.*\.key|credentials\.json|service-account.*\.json)$"
#: Legal forms in names of firms.
LEGAL_FORM = r"(?i)[,.]?\s*\b(pvt\.?|private|ltd\.?|limited|llc|l\.l\.c\.|inc\.?|pllc|llp|plc|gmbh|corp\.?|co\.?)(?=\s|$)"
ARTEFACTS = r"(?i)(^|/)(\.next|node_modules|__pycache__|\.turbo|out|dist|coverage)/|(^|/)\.DS_Store$|\.tsbuildinfo$|\.pyc$"


def crawlable(host: Column, path: Column, site: Column) -> Column:
    own = (host == site) | (host == "")
    return own & ~F.lower(path).rlike(SKIP_PATH) & ~F.lower(path).rlike(SKIP_EXT)


def is_public(host: Column) -> Column:
    return ~host.rlike(PRIVATE_HOST)


def registered_domain(host: Column) -> Column:
    """The label before the last one."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(host)


def external_status(status: Column) -> tuple[Column, Column]:
    """(severity, result) of an external link's status; statuses that turn bots away prove nothing."""
    unverified = status.isin(401, 403, 429, 999)
    broken = (status == 0) | (status >= 400)
    return F.when(unverified, "Info").when(broken, "Important"), F.when(unverified, "unverified").when(broken, "broken").when(status >= 300, "redirect").otherwise("ok")


def internal_result(is_loop: Column, status: Column, hops: Column) -> Column:
    return F.when(is_loop, "loop").when((status == 0) | (status >= 400), "broken").when(hops > 1, "chain").when(hops == 1, "redirect").otherwise("OK")


def w3c_date(value: Column) -> Column:
    """A year, month, day or full timestamp; null for anything else; times without a zone are UTC."""
    v = F.trim(value)
    return F.coalesce(*[F.when(v.rlike(shape), F.try_to_timestamp(F.concat(v, F.lit(rest)), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))) for shape, rest in (
        (r"^\d{4}$", "-01-01T00:00:00Z"), (r"^\d{4}-\d{2}$", "-01T00:00:00Z"), (r"^\d{4}-\d{2}-\d{2}$", "T00:00:00Z"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "Z"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", ""),
    )])


def image_format(hex_bytes: Column) -> Column:
    """The format that the first bytes, in upper-case hex, announce."""
    signatures = (("FFD8FF", "jpeg"), ("89504E47", "png"), ("47494638", "gif"), ("00000100", "ico"), ("424D", "bmp"))
    out = F.when(hex_bytes.startswith("52494646") & (F.substring(hex_bytes, 17, 8) == "57454250"), "webp").when(F.substring(hex_bytes, 9, 16).isin("6674797061766966", "6674797061766973"), "avif")
    for start, name in signatures:
        out = out.when(hex_bytes.startswith(start), name)
    return out.otherwise("unknown")


def cookies(header: Column) -> Column:
    """Set-Cookie values that share one header."""
    return F.split(header, r",\s*(?=[^;,=\s]+=)")


def hsts_seconds(header: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(header), r"max-age=([0-9]+)", 1), F.lit("")).cast("long")


def plain_markdown(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"), F.lit("`"), F.lit(""))


def first_link(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\]\((https?://[^)]+)\)", 1), F.lit(""))


def lighthouse_severity(score: Column, mode: Column) -> Column:
    return F.when(mode.isin("informative", "notApplicable", "manual"), "Info").when(score.isNull(), "Info").when(score >= 0.9, None).when(score < 0.5, "Important").otherwise("Optimization")


def vitals_severity(metric: Column, rating: Column) -> Column:
    core = metric.isin("LCP", "CLS", "INP")
    return F.when(rating == "Poor", F.when(core, "Critical").otherwise("Important")).when(rating == "Needs improvement", F.when(core, "Important").otherwise("Optimization"))


def field_purpose(kind: Column, name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when((kind == "email") | n.rlike("e-?mail"), "email").when((kind == "tel") | n.rlike("phone|tel|mobile"), "phone").when(n.rlike("name"), "name")
        .when(n.rlike("message|comment|enquiry|inquiry"), "message").when(n.rlike("company|organi[sz]ation"), "company").when(kind.isin("checkbox") | n.rlike("consent|agree|privacy"), "consent").otherwise("other")
    )


def noindex(content: Column) -> Column:
    """Whether a robots meta keeps a page out: `noindex` anywhere, or `none` as a token."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return low.contains("noindex") | F.array_contains(F.transform(F.split(low, ","), lambda t: F.trim(t)), "none")


def grouped_message(message: Column) -> Column:
    """A validator message without what it quotes, so that like messages are one."""
    return F.regexp_replace(message, "“[^”]*”", "…")


def british_variant(word: Column, suggestion: Column) -> Column:
    """Whether a suggestion is only the American form of the word."""
    forms = [(r"is(e|ed|es|ing|ation)$", "iz$1"), ("tre$", "ter"), (r"ys(e|ed|es|ing)$", "yz$1"), ("ogue$", "og"), (r"ll(ed|ing|er)$", "l$1"), ("ence$", "ense"), ("grey", "gray")]
    american = [F.regexp_replace(word, a, b) for a, b in forms] + [F.regexp_replace(word, r"^(.*?)our", "$1or")]
    return suggestion.isin(*american) & (word != suggestion)


def image_file(src: Column) -> Column:
    """The file name behind an image's address, also behind an image optimiser's."""
    real = F.when(src.contains("/_next/image?"), F.url_decode(F.regexp_extract(src, r"[?&]url=([^&]*)", 1))).otherwise(src)
    return F.element_at(F.split(F.regexp_replace(real, r"[?#].*$", ""), "/"), -1)


def oversized(natural: Column, shown: Column) -> Column:
    return F.coalesce(natural > shown * 2.5, F.lit(False))


def resource_kind(kind: Column, url: Column) -> Column:
    """js, css, img, font or other: what a page loads, by how it was asked for and by the end of its address."""
    at = F.lower(F.substring_index(url, "?", 1))
    js = (kind == "script") | at.endswith(".js")
    css = (kind == "css") | at.endswith(".css") | ((kind == "link") & at.contains(".css"))
    img = (kind == "img") | at.contains("/_next/image") | at.rlike(r"\.(png|jpe?g|webp|avif|gif|svg)$")
    return F.when(js, "js").when(css, "css").when(img, "img").when(at.rlike(r"\.(woff2?|[to]tf)$"), "font").otherwise("other")


def vitals_shown(metric: Column, value: Column) -> Column:
    """A measurement as text: layout shift with three digits, seconds from 1,000 ms on, else milliseconds."""
    large = F.when(value >= 1000, F.format_string("%.2f s", value / 1000)).when(value.isNotNull(), F.format_string("%.0f ms", value))
    return F.when((metric == "cls") & value.isNotNull(), F.format_string("%.3f", value)).otherwise(large)


def off_ratio(width: Column, height: Column) -> Column:
    """Whether a share image is too small or far from the shape of 1200 by 630."""
    return (width < 600) | (height == 0) | (F.abs(width / F.nullif(height, F.lit(0)) - 1200 / 630) > 0.15)


def business_name(value: Column) -> Column:
    """A name without the legal form at its end, in lower case, for comparison."""
    bare = F.regexp_replace(F.replace(value, F.lit("&amp;"), F.lit("&")), LEGAL_FORM, "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[ ,.|-]+|[ ,.|-]+$", ""), r"\s+", " ")))
