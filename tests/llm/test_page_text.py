"""Main text of pages: the parser on literal pages, alignment against the plain table, the operator against a plain version."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import page_text as P

PAGES = "page_id long, url string, html string, host string, path string, key string, lines string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "h", "p", "k", "l") for r in rows], PAGES).repartition(parts)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def lines(html):
    return [t for _, _, t in P.page_lines(html)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []),
        ("", []),
        ("  \n ", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>one<p>two <b>bold</b>er<br>three</p>tail", ["one", "two bolder three", "tail"]),
        ("<title>t</title><body><script>if (a < b) '<p>no</p>'</script><style>p{}</style><p>x &lt;b&gt; &eacute;&#233;&#xe9; &nbsp; y</p>", ["x <b> ééé y"]),
        ("<nav><a>Home</a></nav><header>Site</header><p>text</p><aside>side</aside><footer>foot</footer>", ["text"]),
        ("<body><div>elsewhere</div><article><header><h1>Title</h1><p>by me</p></header><p>body</p><footer>tags</footer></article><div>after</div>", ["Title", "body"]),
        ("<main><h2>T</h2><div class='comments'><p>nice</p></div><div id=cookie-notice>We use cookies</div><p>kept", ["T", "kept"]),
        ("<div class=no-sidebar><div class='content-sidebar-wrap'><p>kept</p></div></div>", ["kept"]),
        ("<form><p>Search</p><article><p>all pages are one form</p></article></form>", ["all pages are one form"]),
        ("<ul><li><a href=/>Home</a><li><a href=/a>About us</a><li><a href=/b>Contact</a></ul><p>Text with <a href=/c>a link</a>.</p>", ["Text with a link."]),
        ("<div><a>Home</a> | <a>About</a> | <a>More</a></div><p><a href=x>One linked line</a></p>", ["One linked line"]),
        ("<p>a<!-- no <p>x</p> -->b</p><!-- never ended <p>gone</p>", ["ab"]),
        ("<p title='a > b' data-class=\"ad\">kept</p>", ["kept"]),
        ("<p title=\"never ended>one</p><p>two</p>", ["one", "two"]),
        ("a < b and b <3 <p>c", ["a < b and b <3", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<b><p>x</b>y</p>z", ["xy", "z"]),
        ("<svg><title>no</title><svg></svg><text>no</text></svg><p>yes</p><template><p>no</p></template>", ["yes"]),
        ("<div hidden>no</div><div role=navigation>no</div><span class=ad>no</span> yes", ["yes"]),
        ("</p></div></article>x<p>y</span></p>", ["x", "y"]),
        ("<section class=commentList><article><p>a comment</p></article></section><p>text</p>", ["text"]),
    ],
)
def test_lines_of_a_page(html, want):
    assert lines(html) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-\"'= \npabdivxtelh&;#3")), st.integers(0, 3))
def test_any_string_is_read_to_the_end(text, kind):
    P.page_lines(text)
    P.page_lines(f"<article><p>first</p>{'<p ' * kind}{text}")


def test_hostile_pages_take_linear_time():
    for piece in ('<a "', "<div>", "<p><b>", "<!--", "<svg>", "<a '>", "&lt", "<li><a>x", "</p>"):
        P.page_lines(piece * 60_000)


def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 22, 40, 4])
def test_alignment(monkeypatch, bits):
    monkeypatch.setattr(P, "_TABLE", bits)
    rnd = random.Random(bits)
    for n in range(400):
        a, b = ([rnd.randrange(n % 6 + 1) for _ in range(rnd.randrange(25))] for _ in "ab")
        places = P.common(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and all(a[i] in rest for i in places)
        assert len(places) == plain_common(a, b)


def plain_main_text(rows):
    """The same by lists: all pages of a host in memory."""
    parsed, hosts = {}, defaultdict(dict)
    for page_id, url, html in rows:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        query = re.match(r"(?s)[^?#]*(.*)", url)[1] if url else ""
        here = P.page_lines(html)
        content = tuple((t, z, h) for z, h, t in here)
        parsed[page_id] = host, content
        at = (path, query)
        hosts[host][content] = min(hosts[host].get(content, at), at)
    gone = {}
    for host, pages in hosts.items():
        order = sorted(pages.items(), key=lambda p: (p[1][0].replace("/", "\x01").encode(), p[1][1].encode(), P._hashed([(z, h, t) for t, z, h in p[0]])[2]))
        for i, (content, (path, _)) in enumerate(order):
            near = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order)]

            def alike(other, path=path):
                n = 0
                for x, y in zip(path.split("/"), other[1][0].split("/"), strict=False):
                    if x != y:
                        return n
                    n += 1
                return n

            prose = [len(t) if len(t.split()) >= P.PROSE or t.endswith(P._STOPS) else 0 for t, _, _ in content]
            for other in sorted(near, key=alike, reverse=True):
                shared = P.common([t for t, _, _ in content], [t for t, _, _ in other[0]])
                if not sum(prose) or sum(prose[k] for k in shared) < P.VERSION * sum(prose):
                    gone[host, content] = {k for k in shared if not (content[k][1] == P.ARTICLE and (prose[k] or content[k][2]))}
                    break
    return {i: "\n\n".join(t for k, (t, _, _) in enumerate(content) if k not in gone.get((host, content), ())) for i, (host, content) in parsed.items()}


def site(rnd, count):
    """Pages of a few hosts whose frames only differencing can tell, with copies and versions."""
    word = lambda n: " ".join(rnd.choice("alpha beta gamma delta omega sigma kappa lambda".split()) + str(rnd.randrange(90)) for _ in range(n))
    frames = {h: ([word(3) for _ in range(4)], [word(8), word(2)]) for h in ("a.example", "b.example", "c.example")}
    rows, truth = [], {}
    for i in range(count):
        host = rnd.choice(list(frames))
        top, end = frames[host]
        body = [word(rnd.randrange(6, 40)) for _ in range(rnd.randrange(2, 6))]
        url = f"https://{host.upper() if i % 5 == 0 else host}/{rnd.choice(['x', 'y/z'])}/{i}?q={i % 3}"
        rows.append((i, url, "<body>" + "".join(f"<div>{t}</div>" for t in top) + "".join(f"<p>{t}</p>" for t in body) + "".join(f"<div>{t}</div>" for t in end)))
        truth[i] = "\n\n".join(body)
    return rows, truth


def test_frames_that_only_differencing_tells(spark):
    rows, truth = site(random.Random(5), 90)
    assert texts(P.main_text(table(spark, rows))) == truth == plain_main_text(rows)


def test_versions_and_copies_do_not_delete_each_other(spark):
    frame, body = "<div>Menu one</div>", "<p>The whole article stands here, twice, with one word more or less.</p><p>And it goes on for a while.</p>"
    rows = [
        (1, "http://h.example/a/1", f"{frame}{body}"), (2, "http://h.example/a/2", f"{frame}{body}<p>seen again</p>"), (3, "http://h.example/a/3", f"{frame}{body}"),
        (4, "http://other.example/", f"{frame}{body}"), (5, None, body), (5, None, body), (6, "no scheme", "<p>x</p>"), (7, "http://h.example/z", f"{frame}<p>Quite another text, of another page.</p>"),
    ]
    got = texts(P.main_text(table(spark, rows)))
    assert got == plain_main_text(rows)
    assert all("The whole article" in got[i] and "goes on" in got[i] for i in (1, 2, 3, 4, 5)) and got[7].startswith("Quite") and "Menu" not in got[7]


@pytest.mark.parametrize("small", [0, 50_000])
def test_against_the_plain_version(spark, monkeypatch, small):
    monkeypatch.setattr(P, "SMALL_ROWS", max(small, 1))
    rnd = random.Random(9)
    rows, _ = site(rnd, 60)
    rows += [(100 + i, rows[i][1] + "x", rows[rnd.randrange(60)][2]) for i in range(25)]
    rows += [(200 + i, f"https://a.example/m/{i}", f"<main><h1>Same</h1><p>Share</p><p>Sentence {i % 2}.</p><p>{'w ' * 6}</p></main>") for i in range(6)]
    assert texts(P.main_text(table(spark, rows))) == plain_main_text(rows)


def test_odd_pages(spark):
    long = "<p>" + "</p><p>".join(f"line {i % 50} of a very long page" for i in range(60_000)) + "</p>"
    rows = [(1, None, None), (None, "http://h.example", ""), (2, "http://h.example/l", long), (3, "http://h.example/m", long.replace("line 7 ", "row 7 ")), (4, "", "<p>x</p>"), (4, "", "<p>x</p>")]
    got = P.main_text(table(spark, rows)).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[None].text == "" and by_id[4].text == "x"
    assert by_id[2].text.count("\n\n") == 59_999  # another version of page 3
    assert P.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_articles_of_the_table(spark, sf):
    import html as entities

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = texts(P.main_text(pages))
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1|br)>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
