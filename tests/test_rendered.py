"""Shown texts and labels of elements, against a plain walk over well-formed pages."""

import random
import xml.etree.ElementTree as ET

from auditloom.sources.rendered import HIDDEN, shown_elements

PAGES = {
    "a": '<body><p id="x" class="one two  three four">Semicolon<span>.</span> And<br/>so <b>o</b>n</p><pre>a  b</pre></body>',
    "b": '<div><a href="/u" role="button" class="">  go \n to  it </a><code>x<b>y</b></code>tail<script>var a = 1;</script></div>',
    "c": "<ul><li>one</li><li>two<ul><li>three</li></ul></li><svg><title>t</title></svg></ul>",
    "d": f'<p name="{"n" * 90}">{"long " * 40}</p>',
    "e": "<p></p>",
}


def plain(node, tags=(), out=None):
    """Rows (tag, shown, all texts, attributes) in document order; each node's pieces as (text, shown)."""
    out = [] if out is None else out
    row = {"tag": node.tag, "attrs": node.attrib, "pieces": []}
    out.append(row)
    tags = (*tags, node.tag)
    silent, hidden = bool({"script", "style", "template"} & set(tags)), bool(HIDDEN & set(tags))
    if node.text and not silent:
        row["pieces"].append((node.text, not hidden))
    for child in node:
        if child.tag == "br":
            row["pieces"].append((" ", True))
        row["pieces"] += plain(child, tags, out)
        if child.tail:
            row["pieces"].append((child.tail, not hidden))
    return row["pieces"] if len(tags) > 1 else out


def label(row):
    a, text = row["attrs"], " ".join(" ".join(t for t, _ in row["pieces"]).split())
    out = row["tag"] + (f"#{a['id']}" if a.get("id") else "") + "".join(f".{c}" for c in a.get("class", "").split()[:3])
    named = next((f" [{k}={a[k][:60]}]" for k in ("href", "src", "name", "type", "role", "aria-label") if a.get(k)), "")
    return (out + named + (f" '{text[:40]}'" if text else ""))[:120]


def random_page(rng, depth=0):
    tag = rng.choice(["div", "span", "b", "em", "code", "section", "i"])
    inner = "".join(rng.choice([" ", "w", "x y", "\n", "é", "<br/>"]) if depth > 3 or rng.random() < 0.5 else random_page(rng, depth + 1) for _ in range(rng.randrange(5)))
    return f'<{tag} class="{rng.choice(["", "k", "k l m n"])}" id="{rng.choice(["", "i"])}">{inner}</{tag}>'


def test_shown_texts_and_labels(spark):
    rng = random.Random(5)
    pages = {**PAGES, **{f"r{i}": f"<main>{random_page(rng)}</main>" for i in range(60)}}
    rows = shown_elements(spark.createDataFrame(list(pages.items()), "url string, html string")).collect()
    for url, html in pages.items():
        mine = [(r.tag, r.shown, r.label) for r in sorted((r for r in rows if r.url == url), key=lambda r: r.ord)]
        want = [(e["tag"], " ".join("".join(t for t, s in e["pieces"] if s).split()), label(e)) for e in plain(ET.fromstring(html))]
        assert mine == want, url


def test_shown_elements_of_odd_pages(spark):
    pages = spark.createDataFrame([("n", None, 1), ("e", "", 1), ("u", "<p>a<p>b <!-- c -->d</q><td>&amp;x", 1), ("u", "text only", 1)], "url string, html string, label int")
    assert sorted((r.tag, r.shown) for r in shown_elements(pages).collect()) == [("p", "a"), ("p", "b d&x"), ("td", "&x")]
    assert [r.tag for r in shown_elements(pages, ["td"]).collect()] == ["td"] and shown_elements(pages.limit(0)).count() == 0
