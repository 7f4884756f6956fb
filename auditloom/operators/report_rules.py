"""Rule packs of the page reports, over the element table and the pages it was parsed from.

A pack starts from one row of facts for each page (a single grouped aggregation of the elements: first and
number of each kind of tag, partial before the shuffle) and from the elements that have rules of their own. Every
function gives issue columns url, severity, category, issue, current_value, element, as `element_rules` does.

Defined cases: a page without an element has facts of zero and nulls, so rules on what is missing fire. Rows that
could not be parsed are left out. Null urls are a page of their own.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import text as T
from auditloom.functions import urls as U

from .element_rules import COLUMNS, _attr, _page, _union
from .graph import cut_lineage
from .rules import Rule, evaluate

#: Lengths that titles and descriptions should have.
TITLE_MIN, TITLE_MAX, DESC_MIN, DESC_MAX = 30, 60, 70, 160
#: Tags that HTML has given up.
DEPRECATED = "center font marquee blink frame frameset big strike tt acronym applet".split()
#: Attributes of component code that HTML does not have, and those that hold code if they start with a brace.
JSX, JSX_CODE = ("classname", "htmlfor"), ("onclick", "tabindex")
#: Social tags of a page with the severity of their absence.
OPEN_GRAPH = {
    "title": "Important", "description": "Important", "image": "Important", "url": "Important", "type": "Optimization",
    "site_name": "Optimization", "locale": "Optimization", "image:alt": "Optimization", "image:width": "Optimization", "image:height": "Optimization",
}
TWITTER = {"card": "Important", "title": "Optimization", "description": "Optimization", "image": "Optimization"}
#: Alternative texts that say nothing.
GENERIC_ALT = "image img photo picture pic logo banner icon graphic thumbnail untitled placeholder default hero background".split()
#: Link texts that say nothing about the target; bounds of links on a page.
GENERIC_LINKS = ("click here", "here", "read more", "more", "learn more", "link", "this", "view", "details", "go", "view more", "see more", "continue", "click")
MAX_LINKS, MIN_INTERNAL = 150, 3
#: ARIA attributes, after `aria-`.
ARIA = (
    "activedescendant atomic autocomplete braillelabel brailleroledescription busy checked colcount colindex colindextext colspan controls current describedby "
    "description details disabled dropeffect errormessage expanded flowto grabbed haspopup hidden invalid keyshortcuts label labelledby level live modal multiline "
    "multiselectable orientation owns placeholder posinset pressed readonly relevant required roledescription rowcount rowindex rowindextext rowspan selected "
    "setsize sort valuemax valuemin valuenow valuetext"
).split()
#: ARIA roles.
ROLES = (
    "alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox complementary contentinfo definition deletion "
    "dialog directory document emphasis feed figure form generic grid gridcell group heading img insertion link list listbox listitem log main mark marquee math menu "
    "menubar menuitem menuitemcheckbox menuitemradio meter navigation none note option paragraph presentation progressbar radio radiogroup region row rowgroup "
    "rowheader scrollbar search searchbox separator slider spinbutton status strong subscript superscript switch tab table tablist tabpanel term textbox time timer "
    "toolbar tooltip tree treegrid treeitem"
).split()
#: ISO 639-1 language codes.
LANGUAGES = (
    "aa ab af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my "
    "na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts "
    "tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
#: Structured data that pages of a path should have: pattern, accepted types, name; the first match counts.
EXPECTED = (
    (r"^/$", "Organization WebSite", "Organization/WebSite"),
    (r"^/about-us$", "Organization AboutPage", "Organization/AboutPage"),
    (r"^/contact-us$", "ContactPage", "ContactPage"),
    (r"^/blog$", "CollectionPage Blog", "CollectionPage/Blog"),
    (r"^/blog/[^/]+$", "Article BlogPosting NewsArticle TechArticle", "BlogPosting/Article"),
    (r"^/portfolio$", "CollectionPage ItemList", "CollectionPage"),
    (r"^/portfolio/[^/]+$", "CreativeWork SoftwareApplication WebApplication MobileApplication WebSite", "CreativeWork"),
    (r"^/(software-services|digital-services|intelligent-data-services|technologies|tools)/[^/]+$", "Service SoftwareApplication", "Service"),
    (r"^/(services|software-services|digital-services|intelligent-data-services|technologies|industries|tools)$", "Service CollectionPage ItemList OfferCatalog", "Service/CollectionPage"),
    (r"^/industries/[^/]+$", "Service WebPage", "Service/WebPage"),
    (r"^/careers$", "JobPosting CollectionPage WebPage Organization", "JobPosting/WebPage"),
)
#: Structured data by type: properties that are required, and that are recommended.
PROPERTIES = {
    "Organization": ("name url", "logo sameAs contactPoint address"),
    "WebSite": ("name url", "potentialAction publisher"),
    "WebPage": ("name", "url description breadcrumb"),
    "Service": ("name", "description provider areaServed serviceType url"),
    "Article": ("headline", "author datePublished dateModified image publisher mainEntityOfPage"),
    "BlogPosting": ("headline", "author datePublished dateModified image publisher mainEntityOfPage"),
    "BreadcrumbList": ("itemListElement", ""),
    "FAQPage": ("mainEntity", ""),
    "LocalBusiness": ("name address", "telephone openingHours geo url image"),
    "ContactPage": ("name", "url mainEntity"),
    "CollectionPage": ("name", "url mainEntity description"),
    "JobPosting": ("title description datePosted hiringOrganization", "employmentType jobLocation validThrough"),
    "CreativeWork": ("name", "description image author creator"),
}

def _text(name: str) -> Column:
    return F.trim(F.coalesce(_attr(name), F.lit("")))


def _rel(word: str) -> Column:
    return F.array_contains(F.split(F.lower(_text("rel")), r"\s+"), word)


def _first(cond: Column, value: Column) -> Column:
    """The value of a page's first element that meets the condition; null without one."""
    return F.min(F.when(cond, F.struct("ord", value.alias("v"))))["v"]


def main_text(html: Column) -> Column:
    """Text of `<main>`, or of the body, or of the whole page, without scripts, drawings, navigation and footer."""
    page = H.stripped(html)
    for tag in ("noscript", "svg", "template", "nav", "footer", "head"):
        page = F.regexp_replace(page, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    parts = [F.nullif(F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit("")) for tag in ("main", "body")]
    return H.text_of(F.coalesce(*parts, page))


def content_rules(facts: DataFrame, placeholder: str, filler: tuple[str, ...]) -> DataFrame:
    """Length, placeholder and filler texts, articles without author or dates, and reading ease of the main text.

    Of the facts only url, path and html are read.
    """
    article = F.col("path").rlike("^/blog/[^/]+$")
    has = lambda pattern: F.coalesce("html", F.lit("")).rlike(pattern)
    said = lambda name: rf"""(?is)<meta\b[^>]*(?:name|property)=["']?{name}["'\s][^>]*content=["'][^"']|<meta\b[^>]*content=["'][^"']+["'][^>]*(?:name|property)=["']?{name}["'\s/>]"""
    lacks = {
        "no_author": article & ~has(said("(?:article:)?author")) & ~has('"author"') & ~has(r"(?is)\brel=[\"']?author\b"),
        "no_date": article & ~has(said("article:published_time")) & ~has('"datePublished"') & ~has(r"(?is)<time\b[^>]*\bdatetime="),
        "no_update": article & ~has(said("article:modified_time")) & ~has('"dateModified"'),
    }
    low, letters = F.lower("text"), T.letters_words(F.col("text"))
    rows = facts.select("url", *[c.alias(k) for k, c in lacks.items()], main_text(F.col("html")).alias("text"))
    rows = rows.select("url", *lacks, T.word_count(F.col("text")).alias("words"), T.sentences(F.col("text")).alias("sentences"), letters.alias("w"), "text", low.alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(p), F.lit(p)) for p in filler]))
    hits = F.array_distinct(F.transform(F.regexp_extract_all("low", F.lit(placeholder), F.lit(0)), lambda x: F.trim(x)))
    syllables = F.aggregate("w", F.lit(0), lambda a, x: a + T.syllables(x))
    # written once: Spark would put the text's expression in the place of each value in each rule
    rows = cut_lineage(rows.select("url", *lacks, "words", "sentences", F.size("w").cast("double").alias("n"), syllables.alias("syllables"), found.alias("found"), hits.alias("hits")))
    n = F.col("n")
    rows = rows.withColumn("per_sentence", F.when(n >= 50, F.round(n / F.col("sentences"), 1)))
    rows = rows.withColumn("ease", F.when(n >= 50, F.round(206.835 - 1.015 * (n / F.col("sentences")) - 84.6 * (F.col("syllables") / n), 1)))
    length = [
        Rule("Critical", "Length", "Empty page (almost no text)", F.col("words") < 50, F.col("words")),
        Rule("Important", "Length", "Very short page", F.col("words").between(50, 149), F.col("words")),
        Rule("Optimization", "Length", "Thin content", F.col("words").between(150, 299), F.col("words")),
    ]
    whole = evaluate(rows, [
        *length,
        Rule("Important", "Article", "Article without author", F.col("no_author"), F.lit("(none found)")),
        Rule("Important", "Article", "Article without publication date", F.col("no_date"), F.lit("(none found)")),
        Rule("Optimization", "Article", "Article without updated date (dateModified)", F.col("no_update"), F.lit("(none found)")),
        Rule("Optimization", "Readability", "Very difficult to read", F.col("ease") < 30, F.col("ease")),
        Rule("Optimization", "Readability", "Long sentences", (F.coalesce("ease", F.lit(0.0)) >= 30) & (F.col("per_sentence") > 28), F.col("per_sentence")),
    ])
    hits = evaluate(rows.select("url", F.explode("hits").alias("hit")), [Rule("Important", "Placeholder", "Placeholder / test text on page", F.lit(True), F.col("hit"))])
    style = rows.where(F.size("found") >= 3).select("url", F.explode("found").alias("phrase"))
    return _union(whole, hits, evaluate(style, [Rule("Optimization", "Style", "Generic AI/filler phrasing", F.lit(True), F.col("phrase"))]))


def page_facts(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """One row for each page: numbers, first texts and attributes of what the packs ask about."""
    body = F.array_contains("path", "body")
    meta = lambda name: (F.col("tag") == "meta") & ~body & (F.lower(_text("name")) == name)
    canonical = (F.col("tag") == "link") & _rel("canonical")
    heading = lambda n: F.col("tag") == f"h{n}"
    columns = {
        "n_titles": F.count_if(F.col("tag") == "title"), "n_head_titles": F.count_if((F.col("tag") == "title") & ~body), "title": _first((F.col("tag") == "title") & ~body, F.col("text")), "body_title": _first((F.col("tag") == "title") & body, F.col("text")),
        "n_descriptions": F.count_if(meta("description")), "description": _first(meta("description"), _text("content")), "n_all_descriptions": F.count_if((F.col("tag") == "meta") & (_attr("name") == "description")),
        "keywords": _first(meta("keywords"), _text("content")), "robots": _first(meta("robots"), F.lower(_text("content"))), "googlebot": _first(meta("googlebot"), F.lower(_text("content"))),
        "n_viewport": F.count_if(meta("viewport") & (_text("content") != "")), "n_charset": F.count_if((F.col("tag") == "meta") & ~body & (_attr("charset").isNotNull() | F.lower(_text("http-equiv")).contains("content-type"))),
        "n_h1": F.count_if(heading(1)), "n_h2": F.count_if(heading(2)), "h1": _first(heading(1), F.col("text")),
        "n_canonicals": F.count_if(canonical & ~body), "canonical": _first(canonical & ~body, _text("href")), "n_body_canonicals": F.count_if(canonical & body),
        "lang": _first(F.col("tag") == "html", F.lower(_text("lang"))), "n_main": F.count_if((F.col("tag") == "main") | (_text("role") == "main")),
        "n_header": F.count_if((F.col("tag") == "header") | (_text("role") == "banner")), "n_nav": F.count_if((F.col("tag") == "nav") | (_text("role") == "navigation")), "n_footer": F.count_if((F.col("tag") == "footer") | (_text("role") == "contentinfo")),
        "n_forms": F.count_if(F.col("tag") == "form"), "n_live": F.count_if(_attr("aria-live").isNotNull() | _text("role").rlike("alert|status")),
        "n_breadcrumbs": F.count_if(F.lower(_text("aria-label")).contains("breadcrumb") | F.lower(_text("class")).contains("breadcrumb")),
    }
    for kind, source, wanted in (("og", "property", OPEN_GRAPH), ("twitter", "name", TWITTER)):
        for k in wanted:
            at = (F.col("tag") == "meta") & ~body & ((F.lower(_text(source)) == f"{kind}:{k}") | (F.lower(_text("property" if source == "name" else "name")) == f"{kind}:{k}"))
            columns[f"{kind}:{k}"] = _first(at, _text("content"))
    facts = _page(elements).groupBy("url").agg(*[c.alias(name) for name, c in columns.items()])
    facts = pages.select("url", "html").join(facts.withColumnRenamed("url", "of"), F.col("url").eqNullSafe(F.col("of")), "left").drop("of")
    counts = [c for c in columns if c.startswith("n_")]
    return facts.fillna(0, counts).withColumn("path", U.path(F.col("url")))


def _had(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def page_seo_rules(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """Title, description, keywords, headings, topic and url of each page."""
    title, desc, h1, path = _had("title"), _had("description"), _had("h1"), F.col("path")
    chars = lambda c: F.concat(F.length(c).cast("string"), F.lit(" chars: "), c)
    brand = T.topic_words(_had("og:site_name"))
    words = lambda c: F.array_except(T.topic_words(c), brand)
    topic = F.when(path != "/", T.slug_words(F.substring_index(path, "/", -1))).otherwise(F.array().cast("array<string>"))
    rows = facts.withColumns({"topic": topic, "title_words": words(title), "h1_words": words(h1), "desc_words": words(desc)})
    missing = lambda a, b: (F.size(a) > 0) & ~F.arrays_overlap(a, b)
    problems = {
        "uppercase": path != F.lower(path), "underscores": path.contains("_"), "encoded characters": path.rlike(r"(?i)%[0-9a-f]{2}|\s"), "long": F.length(path) > 75, "deep": F.regexp_count(path, F.lit("/")) > 3,
        "IDs/hashes instead of words": path.rlike("[0-9]{5,}|[a-f0-9]{12,}"), "query parameters": F.col("url").contains("?"),
    }
    whole = evaluate(rows, [
        Rule("Critical", "Title", "Title missing", title == ""),
        Rule("Important", "Title", "Title too short", (title != "") & (F.length(title) < TITLE_MIN), chars(title)),
        Rule("Important", "Title", "Title too long", F.length(title) > TITLE_MAX, chars(title)),
        Rule("Important", "Title", "Multiple <title> tags", F.col("n_head_titles") > 1, F.col("n_head_titles")),
        Rule("Critical", "Description", "Meta description missing", desc == ""),
        Rule("Important", "Description", "Description too short", (desc != "") & (F.length(desc) < DESC_MIN), chars(desc)),
        Rule("Important", "Description", "Description too long", F.length(desc) > DESC_MAX, chars(desc)),
        Rule("Important", "Description", "Multiple meta descriptions", F.col("n_descriptions") > 1, F.col("n_descriptions")),
        Rule("Optimization", "Meta keywords", "Meta keywords present (ignored by Google)", _had("keywords") != "", F.left(_had("keywords"), F.lit(200))),
        Rule("Critical", "H1", "Missing H1", F.col("n_h1") == 0),
        Rule("Critical", "H1", "Empty H1", (F.col("n_h1") > 0) & (h1 == "")),
        Rule("Important", "H1", "H1 too short to be meaningful", (h1 != "") & (F.length(h1) < 10), h1),
        Rule("Optimization", "H1", "H1 identical to title", (h1 != "") & (title != "") & (F.lower(F.trim(h1)) == F.lower(F.trim(title))), h1),
        Rule("Optimization", "H2", "No H2 sub-headings", F.col("n_h2") == 0),
        Rule("Optimization", "Topic", "Page topic not in title", (title != "") & missing("topic", "title_words"), title),
        Rule("Optimization", "Topic", "Page topic not in H1", (h1 != "") & missing("topic", "h1_words"), h1),
        Rule("Optimization", "Topic", "Description doesn't mention the title topic", (desc != "") & missing("title_words", "desc_words"), desc),
        *[Rule("Optimization", "URL", "URL not SEO-friendly", c, F.concat(F.lit(f"{p}: "), path)) for p, c in problems.items()],
    ])
    nth = F.row_number().over(Window.partitionBy("url").orderBy("ord"))
    extra = _page(elements).where("tag = 'h1'").withColumn("nth", nth).where("nth > 1")
    return _union(whole, evaluate(extra, [Rule("Important", "H1", "Multiple H1", F.lit(True), F.col("nth"), F.concat(F.lit("<h1> "), F.left("text", F.lit(100))))]))


def duplicate_rules(facts: DataFrame) -> DataFrame:
    """Titles, descriptions and og:titles that several pages share, whatever their case."""
    kinds = {"title": ("Critical", "Title", "Duplicate title"), "description": ("Critical", "Description", "Duplicate description"), "og:title": ("Important", "Open Graph", "Duplicate og:title")}
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(_had(k)).alias("value")) for k in kinds])
    rows = facts.select("url", F.explode(values).alias("v")).select("url", "v.kind", "v.value", F.lower("v.value").alias("key")).where("key <> ''")
    shared = rows.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, ["kind", "key"])
    return evaluate(rows, [Rule(*names, F.col("kind") == k, F.left("value", F.lit(150)), F.concat(F.lit("shared by "), "n", F.lit(" pages"))) for k, names in kinds.items()]).select(*COLUMNS)


def technical_rules(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """Canonical, indexing, url structure and health of the HTML."""
    page, url, path, canon = _page(with_images(elements)), F.col("url"), F.col("path"), _had("canonical")
    absolute = U.resolve(url, canon)
    raw = F.coalesce("html", F.lit(""))
    rows = facts.withColumns({"absolute": absolute, "raw": raw})
    tokens = lambda c: F.transform(F.split(c, ","), lambda t: F.trim(t))
    indexing = [
        rule
        for source, value in (("meta robots", _had("robots")), ("meta googlebot", _had("googlebot")))
        for rule in (
            Rule("Critical", "Indexing", f"noindex via {source}", value.contains("noindex"), value),
            Rule("Important", "Indexing", f"nofollow via {source}", value.contains("nofollow"), value),
            Rule("Critical", "Indexing", f"'none' (noindex, nofollow) via {source}", F.array_contains(tokens(value), "none"), value),
        )
    ]
    whole = evaluate(rows, [
        Rule("Critical", "Canonical", "Missing canonical", canon == "", F.lit("(none)")),
        Rule("Critical", "Canonical", "Duplicate canonical tags", (canon != "") & (F.col("n_canonicals") > 1), F.col("n_canonicals")),
        Rule("Important", "Canonical", "Relative canonical URL", (canon != "") & ~canon.startswith("http"), canon),
        Rule("Critical", "Canonical", "Canonical is not self-referencing", (canon != "") & (U.norm(F.col("absolute")) != U.norm(url)) & (U.path(F.col("absolute")) != path), canon),
        Rule("Important", "Canonical", "Canonical tag inside <body> (ignored)", F.col("n_body_canonicals") > 0, F.lit("<link rel=canonical> in <body>")),
        *indexing,
        Rule("Important", "URLs", "Uppercase letters in URL", path != F.lower(path), path),
        Rule("Optimization", "URLs", "Underscores/spaces in URL (use hyphens)", path.rlike("[_ ]"), path),
        Rule("Optimization", "URLs", "Sitemap URL has parameters", url.contains("?"), url),
        Rule("Optimization", "URLs", "Trailing slash in sitemap URL (inconsistent with others)", url.endswith("/") & (path != "/"), url),
        Rule("Important", "HTML", "Missing <!DOCTYPE html>", ~F.lower(F.left("raw", F.lit(5000))).contains("<!doctype html"), F.lit("(none)")),
        *[Rule("Important", "HTML", f"Missing <{t}>", ~F.col("raw").rlike(rf"(?i)<{t}[\s>]"), F.lit("(none)")) for t in ("html", "head", "body")],
        Rule("Important", "HTML", "Missing <meta charset>", F.col("n_charset") == 0, F.lit("(none)")),
        Rule("Important", "HTML", "Missing viewport meta", F.col("n_viewport") == 0, F.lit("(none)")),
        Rule("Important", "HTML", "Multiple <title> tags", F.col("n_titles") > 1, F.col("n_titles")),
        Rule("Important", "HTML", "Multiple meta descriptions", F.col("n_all_descriptions") > 1, F.col("n_all_descriptions")),
        Rule("Important", "HTML", "<title> inside <body>", F.col("body_title").isNotNull(), F.left("body_title", F.lit(100))),
    ])
    ids = page.where(_text("id") != "").groupBy("url", _attr("id").alias("id")).agg(F.count("*").alias("n"))
    named = (F.col("text") != "") | (_text("aria-label") != "") | (_text("title") != "")
    leaked = F.transform(F.filter(F.map_entries("attrs"), lambda e: e["key"].isin(*JSX) | (e["key"].isin(*JSX_CODE) & e["value"].startswith("{"))), lambda e: e["key"])
    inside = lambda *tags: F.exists("path", lambda t: t.isin(*tags))
    each = evaluate(page.withColumn("leaked", F.get(leaked, 0)), [
        Rule("Important", "HTML", "Empty links (no text / name)", (F.col("tag") == "a") & _attr("href").isNotNull() & ~named & F.col("images").isNull(), _attr("href")),
        Rule("Important", "HTML", "Empty buttons (no text / name)", (F.col("tag") == "button") & ~named & (_text("aria-labelledby") == "")),
        Rule("Important", "HTML", "Link nested inside a link (invalid)", (F.col("tag") == "a") & inside("a"), _attr("href")),
        Rule("Important", "HTML", "Interactive element nested inside <button> (invalid)", F.col("tag").isin("a", "button") & inside("button"), F.col("tag")),
        Rule("Optimization", "HTML", "Block element inside <p> (browser rewrites the DOM)", F.col("tag").isin("div", "section", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table") & inside("p"), F.col("tag")),
        Rule("Important", "HTML", "Invalid attribute in HTML (JSX attribute leaked)", F.col("leaked").isNotNull(), F.col("leaked")),
    ])
    old = page.where(F.col("tag").isin(DEPRECATED)).groupBy("url", "tag").agg(F.count("*").alias("n"))
    worn = evaluate(old, [Rule("Optimization", "HTML", f"Deprecated <{t}> tag", F.col("tag") == t, F.col("n")) for t in DEPRECATED])
    repeated = evaluate(ids, [Rule("Important", "HTML", "Duplicate IDs", F.col("n") > 1, F.concat(F.lit('id="'), "id", F.lit('" used '), "n", F.lit(" times")))])
    return _union(whole, each, worn, repeated)


def with_images(elements: DataFrame) -> DataFrame:
    """The elements, links with `images`: the first alternative text of an image inside (null without such an image)."""
    order = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    # an image in a link lies in the last one opened before it
    images = elements.where("tag IN ('a', 'img')").withColumn("link", F.last(F.when(F.col("tag") == "a", F.col("ord")), ignorenulls=True).over(order))
    images = images.where((F.col("tag") == "img") & F.array_contains("path", "a") & _attr("alt").isNotNull())
    first = images.groupBy(F.col("url").alias("i_url"), F.col("link").alias("i_ord")).agg(F.min_by(_text("alt"), "ord").alias("images"))
    return elements.join(first, F.col("url").eqNullSafe(F.col("i_url")) & (F.col("ord") == F.col("i_ord")), "left").drop("i_url", "i_ord")


def labelled_links(elements: DataFrame) -> DataFrame:
    """(url, ord, href, label, rel, target, role, kind, target_url) of every link; kind says what its href is.

    The label is the text, else aria-label, title, or the alternative text of an image inside.
    """
    links = _page(with_images(elements)).where("tag = 'a'")
    links = links.where(~(_attr("href").isNull() & ((_text("name") != "") | (_text("id") != "")) & (F.col("text") == "")))
    label = F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.col("text"), _text("aria-label"), _text("title"), F.col("images"))], F.lit(""))
    href = _text("href")
    scheme = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9_+.-]*):", 1))
    target = F.substring_index(U.resolve(F.col("url"), href), "#", 1)
    kind = (
        F.when(href == "", "empty").when(scheme == "javascript", "javascript").when((scheme != "") & ~scheme.isin("http", "https"), "other")
        .when(href.startswith("#"), "fragment").when(U.bare_host(target) == U.bare_host(F.col("url")), "internal").otherwise("external")
    )
    return links.select("url", "ord", href.alias("href"), label.alias("label"), F.lower(_text("rel")).alias("rel"), _text("target").alias("target"), _text("role").alias("role"), kind.alias("kind"), target.alias("target_url"))


def link_rules(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """Links that lead nowhere or say nothing, their rel, and their number."""
    links = labelled_links(elements)
    refs = _page(elements).select(F.col("url").alias("r_url"), F.explode(F.array(_attr("id"), _attr("name"))).alias("ref")).where("ref <> ''").distinct()
    links = links.join(refs, F.col("url").eqNullSafe(F.col("r_url")) & (F.col("kind") == "fragment") & (F.col("ref") == F.substring("href", 2, 10_000)), "left")
    kind, href, label = F.col("kind"), F.col("href"), F.concat(F.lit("<a> '"), F.left("label", F.lit(60)), F.lit("'"))
    web = kind.isin("internal", "external")
    generic = F.regexp_replace(F.lower("label"), r"^[ .→›»>]+|[ .→›»>]+$", "").isin(*GENERIC_LINKS)
    each = evaluate(links, [
        Rule("Important", "Links", "Empty link (no href)", kind == "empty", F.lit('href=""'), label),
        Rule("Important", "Links", "javascript: link", kind == "javascript", F.left(href, F.lit(100)), label),
        Rule("Important", "Links", 'Placeholder link (href="#")', href.isin("#", "#!") & (F.col("role") != "button"), href, label),
        Rule("Optimization", "Links", "In-page anchor points to a missing id", (kind == "fragment") & ~href.isin("#", "#!") & F.col("ref").isNull(), href, label),
        Rule("Important", "Anchor text", "Link without text or accessible name", web & (F.col("label") == ""), F.lit("(no text)"), href),
        Rule("Optimization", "Anchor text", "Non-descriptive anchor text", web & generic, F.col("label"), href),
        Rule("Important", "rel", "nofollow on an internal link", (kind == "internal") & F.col("rel").contains("nofollow"), F.col("rel"), href),
        Rule("Optimization", "rel", "target=_blank without rel=noopener", (kind == "external") & (F.col("target") == "_blank") & ~F.col("rel").rlike("noopener|noreferrer"), F.col("rel"), href),
    ])
    own = (kind == "internal") & (U.path(F.col("target_url")) != U.path(F.col("url")))
    counts = links.groupBy(F.col("url").alias("of")).agg(F.count_if(web).alias("links"), F.count_distinct(F.when(own, U.path(F.col("target_url")))).alias("targets"))
    pages = facts.join(counts, F.col("url").eqNullSafe(F.col("of")), "left").fillna(0, ["links", "targets"])
    whole = evaluate(pages, [
        Rule("Optimization", "Links", "Excessive links on page", F.col("links") > MAX_LINKS, F.col("links")),
        Rule("Important", "Links", "No internal links on page", F.col("targets") == 0, F.lit("0 internal links")),
        Rule("Optimization", "Links", "Very few internal links", F.col("targets").between(1, MIN_INTERNAL - 1), F.col("targets")),
        Rule("Optimization", "Architecture", "Nested page without breadcrumbs", (F.regexp_count("path", F.lit("/")) >= 2) & (F.col("n_breadcrumbs") == 0), F.lit("no breadcrumb found")),
    ])
    return _union(each, whole)


def social_meta_rules(facts: DataFrame) -> DataFrame:
    """Missing and odd Open Graph and Twitter tags."""
    canonical = F.when(_had("canonical") != "", U.resolve(F.col("url"), _had("canonical"))).otherwise("")
    og_url, og_title, title, card = _had("og:url"), _had("og:title"), F.trim(_had("title")), _had("twitter:card")
    absolute = og_url.startswith("http")
    return evaluate(facts, [
        *[Rule(s, "Open Graph", f"Missing og:{k}", _had(f"og:{k}") == "", F.lit("(missing)")) for k, s in OPEN_GRAPH.items()],
        *[Rule(s, "Twitter/X", f"Missing twitter:{k}", _had(f"twitter:{k}") == "", F.lit("(missing)")) for k, s in TWITTER.items()],
        Rule("Optimization", "Twitter/X", "twitter:card is not summary_large_image", (card != "") & (card != "summary_large_image"), card),
        Rule("Important", "Open Graph", "og:url is not absolute", (og_url != "") & ~absolute, og_url),
        Rule("Important", "Open Graph", "og:url differs from canonical", (og_url != "") & absolute & (canonical != "") & (U.norm(og_url) != U.norm(canonical)), og_url),
        Rule("Optimization", "Open Graph", "og:title much shorter than page title", (og_title != "") & (title != "") & (og_title != title) & (F.length(og_title) < 15), og_title),
    ]).select(*COLUMNS)


def hreflang_alternates(elements: DataFrame) -> DataFrame:
    """(url, code, href, raw) of the alternates in other languages that each page names."""
    links = _page(elements).where((F.col("tag") == "link") & _rel("alternate") & (_text("hreflang") != "") & ~F.array_contains("path", "body"))
    return links.select("url", _text("hreflang").alias("code"), U.resolve(F.col("url"), _text("href")).alias("href"), F.coalesce(_attr("href"), F.lit("")).alias("raw"))


def hreflang_rules(facts: DataFrame, alternates: DataFrame, languages: tuple[str, ...] = ("en", "it", "de", "fr", "es")) -> DataFrame:
    """Language of the page and of its alternates; alternates must link back, which is asked of the pages at hand."""
    lang, code = _had("lang"), F.lower("code")
    main = languages[0].split("-")[0]
    short, country = F.regexp_extract(code, "^([a-z]{2})(?:-([a-z]{2}))?$", 1), F.regexp_extract(code, "^([a-z]{2})(?:-([a-z]{2}))?$", 2)
    known = (code == "x-default") | short.isin(LANGUAGES)
    here, there = U.norm(F.col("url")), U.norm(F.col("href"))
    stored = facts.select(U.norm(F.col("url")).alias("s_norm")).distinct().withColumn("stored", F.lit(True))
    back = alternates.select(there.alias("b_to"), here.alias("b_from")).distinct().withColumn("back", F.lit(True))
    met = alternates.withColumns({"here": here, "there": there}).join(stored, F.col("there") == F.col("s_norm"), "left")
    met = met.join(back, (F.col("b_to") == F.col("here")) & (F.col("b_from") == F.col("there")), "left")
    other = (code != "x-default") & (F.col("here") != F.col("there"))
    each = evaluate(met, [
        Rule("Important", "hreflang", "Invalid hreflang language code", ~known, F.col("code"), F.col("href")),
        Rule("Important", "hreflang", "Invalid hreflang country code", known & country.isin("uk", "en", "eu"), F.col("code"), F.col("href")),
        Rule("Important", "hreflang", "hreflang URL is not absolute", ~F.col("raw").startswith("http"), F.col("raw"), F.col("href")),
        Rule("Important", "hreflang", "Missing return link", other & F.col("stored").isNotNull() & F.col("back").isNull(), F.col("href"), F.col("code")),
    ])
    codes = met.groupBy(F.col("url").alias("of")).agg(F.collect_set(code).alias("codes"), F.bool_or(F.col("here") == F.col("there")).alias("self"))
    pages = facts.join(codes, F.col("url").eqNullSafe(F.col("of")), "left")
    some = F.col("codes").isNotNull()
    covered = lambda x: F.exists("codes", lambda c: (c == x) | (F.substring_index(c, "-", 1) == x))
    whole = evaluate(pages, [
        Rule("Important", "Language", "Missing <html lang>", lang == "", F.lit("(none)")),
        Rule("Important", "Language", "Default-language page has a different <html lang>", (lang != "") & (F.substring_index(lang, "-", 1) != main), lang),
        Rule("Important", "hreflang", "No hreflang tags", ~some, F.lit("0 hreflang links")),
        *[Rule("Optimization", "hreflang", "Language missing from hreflang", some & ~covered(x), F.lit(f"no '{x}'")) for x in languages],
        Rule("Optimization", "hreflang", "Missing x-default", some & ~F.array_contains("codes", "x-default"), F.lit("no x-default")),
        Rule("Important", "hreflang", "No self-referencing hreflang", some & ~F.col("self"), F.lit("page not in its own hreflang set")),
    ])
    twice = met.groupBy("url", code.alias("key")).agg(F.count("*").alias("n")).withColumn("rule", F.lit("Duplicate hreflang code"))
    same = met.where(code != "x-default").groupBy("url", F.col("there").alias("key")).agg(F.count("*").alias("n")).withColumn("rule", F.lit("Same URL used for several languages"))
    names = ("Duplicate hreflang code", "Same URL used for several languages")
    repeated = evaluate(twice.unionByName(same).where("n > 1"), [Rule("Important", "hreflang", x, F.col("rule") == x, F.concat("key", F.lit(" x"), "n")) for x in names])
    return _union(each, whole, repeated)


def image_report_rules(elements: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Alternative texts, sizes, loading and names of images; with probes (src, status, bytes, format, width) also the files."""
    images = _page(elements).where((F.col("tag") == "img") & (_text("src") != "") & ~_text("src").startswith("data:"))
    images = images.withColumns({"src": U.resolve(F.col("url"), _text("src")), "nth": F.row_number().over(Window.partitionBy("url").orderBy("ord"))})
    low = F.lower(F.trim(_attr("alt")))
    images = images.withColumns({"alt": _attr("alt"), "low": low, "same": F.count("*").over(Window.partitionBy("url", low)), "decorative": (_text("aria-hidden") == "true") | _text("role").isin("presentation", "none")})
    if probes is None:
        probes = elements.sparkSession.createDataFrame([], "src string, status int, bytes long, format string, width int")
    images = images.join(probes.select(F.col("src").alias("p_src"), "status", "bytes", "format", F.col("width").alias("natural")), F.col("src") == F.col("p_src"), "left")
    low, alt = F.col("low"), F.col("alt")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9.]+"), F.lit(0))
    stuffed = (F.size(words) >= 4) & F.exists(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)) >= 3)
    generic = low.isin(GENERIC_ALT) | low.rlike(r"^(img|image|photo|dsc|screenshot|pic)[-_ ]?[0-9]*(\.[a-z0-9_]+)?$")
    fill = _text("data-nimg") == "fill"
    loading = F.when(_text("loading") != "", _text("loading")).when(_text("fetchpriority") == "high", "eager").otherwise("")
    real = F.when(F.col("src").contains("/_next/image?"), F.url_decode(F.regexp_extract("src", r"[?&]url=([^&]*)", 1))).otherwise(F.col("src"))
    name = F.substring_index(F.regexp_replace(real, r"[?#].*$", ""), "/", -1)
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9_]+$", "")
    odd = F.lower(stem).rlike(r"^((img|image|dsc|photo|screenshot|untitled|pxl)?[-_ ]?[0-9]+|[a-f0-9-]{16,})$")
    shown = F.expr("try_cast(attrs['width'] AS double)")
    ok, probed = F.coalesce(F.col("status") == 200, F.lit(False)), F.col("status").isNotNull()
    given = alt.isNotNull() & (low != "")
    return evaluate(images, [
        Rule("Important", "Images", "Missing alt attribute", alt.isNull(), F.lit("(no alt attribute)"), F.col("src")),
        Rule("Optimization", "Images", "Empty alt (only correct for decorative images)", alt.isNotNull() & (low == "") & ~F.col("decorative"), F.lit('alt=""'), F.col("src")),
        Rule("Important", "Images", "Generic alt text", given & generic, alt, F.col("src")),
        Rule("Optimization", "Images", "Very short alt text", given & ~generic & (F.length(low) < 5), alt, F.col("src")),
        Rule("Important", "Images", "Alt text is a file name", given & low.rlike(r"\.(jpe?g|png|webp|gif|svg|avif)$"), alt, F.col("src")),
        Rule("Optimization", "Images", "Duplicate alt text on page", given & (F.col("same") > 1), alt, F.col("src")),
        Rule("Optimization", "Images", "Keyword-stuffed alt text", given & stuffed, alt, F.col("src")),
        Rule("Optimization", "Images", "Alt text longer than 125 chars", F.length(alt) > 125, F.length(alt), F.col("src")),
        Rule("Important", "Images", "Broken image", probed & ~ok, F.concat(F.lit("HTTP "), "status"), F.col("src")),
        Rule("Optimization", "Images", "Oversized image file", ok & (F.col("bytes") > 300 * 1024), F.col("bytes"), F.col("src")),
        *[Rule("Optimization", "Images", f"Served as {f} - use WebP/AVIF", ok & (F.col("format") == f) & (F.col("bytes") > 50 * 1024), F.col("bytes"), F.col("src")) for f in ("JPEG", "PNG", "GIF")],
        Rule("Optimization", "Images", "Missing width/height (causes layout shift)", ~fill & ((_text("width") == "") | (_text("height") == "")), F.lit(""), F.col("src")),
        Rule("Optimization", "Images", "Image pixels much larger than displayed", (F.floor(shown) > 0) & (F.col("natural") > F.floor(shown) * 2.5) & (_text("srcset") == ""), F.col("natural"), F.col("src")),
        Rule("Optimization", "Images", "Below-the-fold image not lazy-loaded", (F.col("nth") > 2) & (loading != "lazy"), loading, F.col("src")),
        Rule("Optimization", "Images", "First (likely LCP) image is lazy-loaded", (F.col("nth") == 1) & (loading == "lazy") & ~fill, loading, F.col("src")),
        Rule("Optimization", "Images", "No srcset (not responsive)", (_text("srcset") == "") & (F.coalesce("format", F.lit("")) != "SVG") & (F.col("bytes") > 30 * 1024), F.lit("no srcset"), F.col("src")),
        Rule("Optimization", "Images", "Non-descriptive file name", odd, name, F.col("src")),
        Rule("Optimization", "Images", "File name not lowercase-hyphenated", ~odd & stem.rlike("[A-Z _]"), name, F.col("src")),
    ]).select(*COLUMNS)


def accessibility_report_rules(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """Landmarks, ARIA, focus order, captions and live regions, beside `element_rules.accessibility_rules`."""
    page = _page(elements)
    links = F.array_sort(F.collect_list(F.when((F.col("tag") == "a") & _attr("href").isNotNull(), F.struct("ord", _attr("href").alias("href"), F.col("text")))))
    skip = F.exists(F.slice(links, 1, 3), lambda x: x["href"].startswith("#") & F.lower(F.concat(x["href"], x["text"])).rlike("skip|main|content"))
    tracks = F.count_if((F.col("tag") == "track") & _text("kind").rlike("captions|subtitles"))
    more = page.groupBy(F.col("url").alias("of")).agg(skip.alias("skip"), tracks.alias("tracks"))
    pages = facts.join(more, F.col("url").eqNullSafe(F.col("of")), "left").withColumn("skip", F.coalesce("skip", F.lit(False)))
    landmarks = [Rule("Optimization", "Static", f"No <{t}> landmark", F.col(f"n_{t}") == 0, F.lit("(none)")) for t in ("header", "nav", "footer")]
    whole = evaluate(pages, [
        Rule("Important", "Static", "Missing <html lang>", _had("lang") == "", F.lit("(none)")),
        Rule("Important", "Static", "No <main> landmark", F.col("n_main") == 0, F.lit("(none)")),
        Rule("Optimization", "Static", "More than one main landmark", F.col("n_main") > 1, F.col("n_main")),
        *landmarks,
        Rule("Optimization", "Static", "No skip-navigation link", ~F.col("skip"), F.lit("(none among the first links)")),
        Rule("Optimization", "Static", "Form without aria-live / role=alert region for error messages", (F.col("n_forms") > 0) & (F.col("n_live") == 0), F.lit("(none)")),
    ])
    unknown = F.get(F.filter(F.map_keys("attrs"), lambda k: k.startswith("aria-") & ~F.substring(k, 6, 99).isin(ARIA)), 0)
    roles = F.filter(F.split(_text("role"), r"\s+"), lambda r: (r != "") & ~r.isin(ROLES))
    focusable = F.col("tag").isin("a", "button", "input", "select", "textarea")
    each = evaluate(page.withColumns({"unknown": unknown, "roles": roles}), [
        Rule("Important", "Static", "Image without alt", (F.col("tag") == "img") & _attr("alt").isNull(), F.lit("(no alt attribute)"), _attr("src")),
        Rule("Important", "Static", "svg role=img without a name", (F.col("tag") == "svg") & (_text("role") == "img") & (_text("aria-hidden") != "true") & (_text("aria-label") == "") & (_text("aria-labelledby") == "") & (F.col("text") == "")),
        Rule("Important", "Static", "Invalid ARIA attribute", F.col("unknown").isNotNull(), F.col("unknown"), F.col("tag")),
        Rule("Important", "Static", "Invalid ARIA role", F.size("roles") > 0, _attr("role"), F.col("tag")),
        Rule("Important", "Static", "aria-hidden on a focusable element", (_text("aria-hidden") == "true") & focusable & (_text("tabindex") != "-1"), F.lit('aria-hidden="true"'), F.col("tag")),
        Rule("Optimization", "Static", "Positive tabindex (breaks natural focus order)", F.expr("try_cast(attrs['tabindex'] AS int)") > 0, _attr("tabindex"), F.col("tag")),
        Rule("Important", "Static", "iframe without title", (F.col("tag") == "iframe") & (_text("title") == ""), F.lit("(no title)"), _attr("src")),
    ])
    videos = page.where("tag = 'video'").join(more.select("of", "tracks"), F.col("url").eqNullSafe(F.col("of")))
    silent = evaluate(videos, [Rule("Important", "Static", "Video without captions track", (F.col("tracks") == 0) & _attr("muted").isNull(), F.lit("(no <track kind=captions>)"), _attr("src"))])
    return _union(whole, each, silent)


def jsonld_entities(elements: DataFrame) -> DataFrame:
    """(url, block, top, context, types, id, label, size, props, raw, error) of the objects of each JSON-LD block.

    `top` marks the block's own objects and members of their `@graph`; the former have a context as text; props are the properties that are not empty. A
    block that is not JSON, or is nested beyond the parser's depth, is one row with `error`; blocks are parsed by the standard parser, a batch at a time.
    """
    blocks = _page(elements).where((F.col("tag") == "script") & (F.lower(_text("type")) == "application/ld+json")).select("url", "ord", "text")
    schema = "url string, block int, top boolean, context string, types array<string>, id string, label string, size int, props array<string>, raw string, error string"

    def objects(node, top, own):
        """(object, whether it is a top one, whether it stands for itself, so that it needs a context)."""
        if isinstance(node, list):
            for x in node:
                yield from objects(x, top, own)
        elif isinstance(node, dict):
            graph = node.get("@graph")
            if isinstance(graph, list):
                yield from objects(graph, top, False)
            else:
                yield node, top, own
            for key, x in node.items():
                if key != "@graph":
                    yield from objects(x, False, False)

    def run(batches):
        for batch in batches:
            rows = []
            for url, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = list(objects(json.loads(raw), True, True))
                except (ValueError, RecursionError) as failure:
                    rows.append((url, at, True, None, [], None, None, 0, [], raw, str(failure)))
                    continue
                for node, top, own in found:
                    kinds = node.get("@type", [])
                    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
                    name = node.get("name") or node.get("headline") or node.get("@id") or ""
                    known = node.get("@id") if isinstance(node.get("@id"), str) else None
                    rows.append((url, at, top, str(node.get("@context")) if own else None, kinds, known, str(name)[:120], len(node), [k for k, v in node.items() if v], raw, None))
            columns = list(zip(*rows, strict=True)) or [()] * 11
            types = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return blocks.mapInArrow(run, schema)


def expected_types(path: Column, expected=EXPECTED) -> Column:
    """struct(label, accepted types) that a page of the path should have; null if nothing is expected."""
    out = F.lit(None).cast("struct<label:string,accepted:array<string>>")
    for pattern, types, label in reversed(expected):
        out = F.when(path.rlike(pattern), F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, types.split())).alias("accepted"))).otherwise(out)
    return out


def structured_data_rules(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """JSON-LD: syntax, repeated blocks and ids, breadcrumbs, and the properties that each type needs."""
    found = jsonld_entities(elements)
    good = found.where("error IS NULL")
    blocks = found.select("url", "block", "raw", "error").distinct()
    syntax = evaluate(blocks, [Rule("Critical", "Syntax", "JSON-LD parse error", F.col("error").isNotNull(), F.col("error"), F.left("raw", F.lit(150)))])
    repeated = blocks.groupBy("url", "raw").agg(F.count("*").alias("n"))
    ids = good.where("id <> '' AND size > 2").groupBy("url", "id").agg(F.count("*").alias("n"))
    kinds = good.select("url", F.explode("types").alias("type")).groupBy("url", "type").agg(F.count("*").alias("n"))
    once = ("WebSite", "BreadcrumbList", "FAQPage")
    many = _union(
        evaluate(repeated, [Rule("Important", "Duplicates", "Identical JSON-LD block repeated", F.col("n") > 1, F.col("n"), F.left("raw", F.lit(150)))]),
        evaluate(ids, [Rule("Optimization", "Duplicates", "Same @id defined more than once", F.col("n") > 1, F.concat("id", F.lit(" defined "), "n", F.lit(" times")))]),
        evaluate(kinds, [Rule("Important", "Duplicates", f"{t} schema appears more than once", (F.col("type") == t) & (F.col("n") > 1), F.col("n")) for t in once]),
        evaluate(good.where("top AND context IS NOT NULL"), [Rule("Important", "Syntax", "Missing or wrong @context", ~F.col("context").contains("schema.org"), F.left("context", F.lit(60)))]),
    )
    counts = found.groupBy(F.col("url").alias("of")).agg(F.count_distinct("block").alias("n_blocks"), F.bool_or(F.array_contains("types", "BreadcrumbList")).alias("crumbs"), F.bool_or(F.array_contains("types", "FAQPage")).alias("faq"), F.array_distinct(F.flatten(F.collect_set("types"))).alias("found"))
    asked = _page(elements).where(F.col("tag").isin("h2", "h3")).groupBy(F.col("url").alias("h_url")).agg(F.bool_or(F.lower("text").rlike(r"\bfaq|frequently asked")).alias("asked"))
    pages = facts.join(counts, F.col("url").eqNullSafe(F.col("of")), "left").join(asked, F.col("url").eqNullSafe(F.col("h_url")), "left")
    none = F.array().cast("array<string>")
    pages = pages.withColumns({"expected": expected_types(F.col("path")), "found": F.coalesce("found", none)})
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    labels = dict.fromkeys(label for *_, label in EXPECTED)
    whole = evaluate(pages, [
        Rule("Important", "Presence", "No JSON-LD on page", F.coalesce("n_blocks", F.lit(0)) == 0, F.lit("0 JSON-LD blocks")),
        *[Rule("Important", "Page type", f"Missing {x} schema", (F.col("expected.label") == x) & ~F.arrays_overlap("expected.accepted", "found"), F.array_join(F.array_sort("found"), ", ")) for x in labels],
        Rule("Optimization", "Page type", "Missing BreadcrumbList on nested page", (F.regexp_count("path", F.lit("/")) >= 2) & no("crumbs"), F.lit("no BreadcrumbList")),
        Rule("Optimization", "Page type", "FAQ section without FAQPage schema", F.coalesce("asked", F.lit(False)) & no("faq")),
    ])
    tops = good.where(F.col("top") & ~((F.col("size") <= 2) & F.col("id").isNotNull())).select("url", "label", "props", F.explode("types").alias("type"))
    needs = [(t, k, kind) for t, lists in PROPERTIES.items() for kind, names in zip(("required", "recommended"), lists, strict=True) for k in names.split()]
    severity = {"required": "Important", "recommended": "Optimization"}
    lacking = evaluate(tops, [Rule(severity[kind], "Completeness", f"{t} missing {kind} properties", (F.col("type") == t) & ~F.array_contains("props", k), F.lit(f"no '{k}'"), F.concat("type", F.lit(" '"), "label", F.lit("'"))) for t, k, kind in needs])
    return _union(syntax, many, whole, lacking)
