"""HTML extraction: wrappers with layout classes, main text beside teasers."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuscope.llm import wrappers

MAIN = "The whole story is told here in many words. " * 8


@pytest.mark.parametrize("label", ["home right-sidebar", "comments-open", "nav-fixed", "search-results page", "sidebar"])
def test_body_classes_lose_nothing(label):
    assert wrappers.extract(f'<body class="{label}"><article><p>{MAIN}</p></article><div class="sidebar">side</div></body>', None, []) == MAIN.strip()


def test_page_wide_wrappers_stay():
    for start, end in (('<div class="content-sidebar-wrap">', "</div>"), ('<div class="search">', "</div>"), ("<form>", "</form>")):
        assert wrappers.extract(f"<body>{start}<div><p>{MAIN}</p></div>{end}</body>", None, []) == MAIN.strip()
        assert wrappers.extract(f"<body>{start}<article><p>{MAIN}</p></article>{end}</body>", None, []) == MAIN.strip()
    assert wrappers.extract(f'<body><article>{MAIN}</article><div class="comment-list"><article>{MAIN}</article></div></body>', None, []) == MAIN.strip()


def test_main_text_beside_a_teaser():
    got = wrappers.extract(f"<body><div><p>{MAIN}</p></div><article><p>Teaser</p></article></body>", None, [])
    assert MAIN.strip() in got


def test_copies_make_no_template(spark):
    nav = "<div><p>Same line on all pages</p></div>"
    copied = f"<body>{nav}<article><h1>Title</h1><p>{MAIN}</p><ul><li>a list of the copies</li></ul></article></body>"
    others = [f"<body>{nav}<article><h2>Other {k}</h2><p>story {k}</p></article></body>" for k in range(6)]
    pages = [(k, "http://h/", html) for k, html in enumerate([copied] * 9 + others)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == f"Title {MAIN.strip()} a list of the copies"
    assert got[9] == "Other 0 story 0"


def test_text_of_a_small_share_of_pages_stays(spark):
    few = [f"<body><article><p>story {k}</p><blockquote>said five times</blockquote></article></body>" for k in range(6)]
    many = [f"<body><article><p>story {k}</p></article></body>" for k in range(6, 11)] + [f"<body><article><p>story {k}</p><ul><li>item {k}</li></ul></article></body>" for k in range(11, 16)]
    pages = [(k, "http://h/", html) for k, html in enumerate(few + many)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "story 0 said five times" and got[11] == "story 11 item 11"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<script>for(i=0;i<n;i++){x()}</script><p>hello world</p>", "hello world"),
        ("<script>var a='<p>';</script ><p>hello</p><!-- <p>no --><p>world</p>", "hello world"),
        ("<div><button>Click<p>the text</p></div><p>more</p>", "the text more"),
        ("<div><button><div>Menu</div></button><p>text</p></div>", "text"),
        ("<p>one <select><option>x</select> two</p><object>Your browser</object><canvas><p>three</p>", "one two three"),
        ("<p>so <math><mi>x</mi>=<mn>2</mn></math> holds</p><svg><title>t</title><text>drawn</text></svg><p>end</p>", "so x=2 holds end"),
        ("<p>before <svg><path d='M0'><p>after</p>", "before after"),
        ('<section class="notice-of-law share-prices"><p>the law</p></section>', "the law"),
        ('<div class="post">teaser</div><div class="text">the long text</div>', "teaser the long text"),
        ("<article><p>As said in</p><ul><li><a href='/1'>first source</a></li><li><a href='/2'>second</a></li></ul></article>", "As said in first source second"),
        ("<article class='comments sidebar'><p>text</p></article>", "text"),
        ("<main id='search'><p>text</p></main>", "text"),
        ("<p>a < b and <b>c</b> > d</p><p title=it's>e &lt; f", "a < b and c > d e < f"),
        ("<div><table><tr><td>x</div><td>y</table><p>z</div>", "x y z"),
        ("<p>one<textarea>typed</textarea><title>late</title> two<p>three<textarea>", "one two three"),
        ("<style>p{}", ""),
    ],
)
def test_markup(html, want):
    assert wrappers.extract(html, None, []) == want
    assert wrappers.extract(f'<html><body class="layout sidebar-right single no-comments">{html}</body></html>', None, []) == want


def brute_score(a, b):
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_score(x, y))
    return 1 + best[-1][-1]


def flat(tree, depth=0):
    return [(depth, tree[0], "")] + [y for x in tree[1] for y in flat(x, depth + 1)]


def test_alignment_is_a_largest_match():
    r = random.Random(5)

    def grown(depth):
        return (r.choice("ab"), [grown(depth - 1) for _ in range(r.randrange(0, 5))] if depth else [])

    for _ in range(300):
        a, b = grown(3), grown(3)
        x, y = flat(a), flat(b)
        found = sorted(wrappers.aligned(wrappers._as_json(x), wrappers._as_json(y)).items())
        assert len(found) == brute_score(a, b)
        assert [j for _, j in found] == sorted({j for _, j in found})
        parent = lambda t, i: next(k for k in reversed(range(i)) if t[k][0] < t[i][0]) if i else -1
        assert all(x[i] == y[j] and (i == 0 or (parent(x, i), parent(y, j)) in found) for i, j in found)


def test_pairs_beyond_the_bound_are_all_compared(monkeypatch):
    r = random.Random(8)

    def grown(depth, most=4):
        return (r.choice("ab"), [grown(depth - 1) for _ in range(r.randrange(0, most + 1))] if depth else [])

    for bound in (0, 4, 20):
        monkeypatch.setattr(wrappers, "_PAIRS", bound)
        for _ in range(60):
            a, b = grown(3, 7), grown(3, 7)
            x, y = flat(a), flat(b)
            found = sorted(wrappers.aligned.__wrapped__(wrappers._as_json(x), wrappers._as_json(y)).items())
            assert len(found) == brute_score(a, b)
            parent = lambda t, i: next(k for k in reversed(range(i)) if t[k][0] < t[i][0]) if i else -1
            assert all(x[i] == y[j] and (i == 0 or (parent(x, i), parent(y, j)) in found) for i, j in found)


def test_siblings_far_from_their_place_are_matched():
    def sibling(k, kinds, last):  # the same but for its last child
        return ("div", [(kinds[k >> i & 1], []) for i in range(9)] + [(last, [])])

    ours = [sibling(k, ("p", "ul"), "h2") for k in range(500)]
    a, b = ("body", ours), ("body", [sibling(k, ("dl", "ol"), "h4") for k in range(500)] + [sibling(k, ("p", "ul"), "h3") for k in range(500)])
    assert len(wrappers.aligned(wrappers._as_json(flat(a)), wrappers._as_json(flat(b)))) == 1 + 10 * 500


def test_halved_rows_match_as_well(monkeypatch):
    r = random.Random(6)
    for _ in range(20):
        a, b = (("r", [(r.choice("abc"), []) for _ in range(r.randrange(3000, 3200))]) for _ in range(2))
        found = wrappers.aligned(wrappers._as_json(flat(a)), wrappers._as_json(flat(b)))
        row = np.zeros(len(b[1]) + 1, int)
        kinds = np.array([k for k, _ in b[1]])
        for k, _ in a[1]:
            row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (kinds == k)))])
        assert len(found) == 1 + row[-1]
        break


def test_long_and_deep_pages_are_quick():
    deep = "<div>" * 10_000 + "deep"
    wide = "".join(f"<{t}>{k}</{t}>" for k in range(1000) for t in ("p", "h2"))
    other = wide + "<h2>one more</h2>" + "<p>x</p><h2>y</h2>" * 3
    began = time.process_time()
    assert wrappers.extract(deep, wrappers._as_json(wrappers.fold(wrappers.parse("<div>" * 9_000 + "x"))[0]), [3]) == "deep"
    assert time.process_time() - began < 2
    began = time.process_time()
    assert wrappers.extract(wide, wrappers._as_json(wrappers.fold(wrappers.parse("<ul><li>a</ul>" + other))[0]), [1]).startswith("0 0 1 1 2")
    assert time.process_time() - began < 2
    many = "<p title='a>b \"" * 3000 + "<div>" * 3000 + "</section>" * 3000 + "<button>" * 3000
    began = time.process_time()
    wrappers.extract(many, None, [])
    assert time.process_time() - began < 5


def test_edge_tables(spark):
    long = "word " * 300_000
    pages = [(1, "http://h/1", f"<nav>x</nav><p>{long}</p>", "t"), (1, "http://h/1", f"<nav>x</nav><p>{long}</p>", "t"), (2, None, "<div>" * 1100 + "deep", "t"), (None, "http://h/2", "<p>no id</p>", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    for hosts in (0, 20_000):
        got = sorted(((r["page_id"], r["n_chars"]) for r in wrappers.extract_main_text(df, broadcast_hosts=hosts).collect()), key=str)
        assert got == [(1, 1_499_999), (1, 1_499_999), (2, 4), (None, 5)]


def rotating_pages(hosts=4, pages=12):
    """Pages whose adverts, menus and notices rotate over pages and hosts, with no class or element that says so."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    adverts, menus = [said(6) for _ in range(7)], [said(3) for _ in range(5)]
    rows, texts = [], {}
    for h in range(hosts):
        for k in range(pages):
            story, heading = said(60), said(4)
            extra = f"<blockquote>{said(9)}</blockquote>" if k % 4 == 0 else ""
            body = f"<div class='x'><div>{r.choice(menus)}</div><section>{r.choice(adverts)}</section><div><h2>{heading}</h2><p>{story}</p>{extra}</div><section>host {h} says so</section></div>"
            rows.append((100 * h + k, f"http://h{h}/", f"<html><body>{body}</body></html>"))
            texts[100 * h + k] = " ".join(x for x in (heading, story, extra[12:-13]) if x)
    return rows, texts


def test_the_wrapper_alone_finds_what_rotates(spark):
    rows, want = rotating_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for hosts in (20_000, 0):  # template places broadcast, and joined
        got = {r.page_id: r.text for r in wrappers.extract_main_text(df, by_class=False, broadcast_hosts=hosts).collect()}
        assert got == want
    plain = {i: wrappers._content(page := wrappers.parse(html), [False] * len(page.tag), False) for i, _, html in rows}
    assert all(plain[i] != want[i] for i in want)  # each page is changed by its wrapper
    few = df.filter("page_id % 100 < 4")  # too few pages of a host to say anything
    assert {r.page_id: r.text for r in wrappers.extract_main_text(few, by_class=False).collect()} == {i: x for i, x in plain.items() if i % 100 < 4}


def brute_templates(rows):
    """Each host's template places, judged text by text over all its different pages."""
    pages = {}
    for _, url, html in rows:
        tree, _, texts = wrappers.fold(wrappers.parse(html))
        pages.setdefault(url, {})[wrappers._as_json(tree), tuple(texts)] = tree
    met = {}
    for url, own in pages.items():
        for tree, texts in own:
            for x in texts:
                met.setdefault(x, set()).add(url)
    out = {}
    for url, own in pages.items():
        trees = [t for t, _ in own]
        pivot = max(set(trees), key=lambda t: (trees.count(t), t))
        at = {}  # pivot place -> (tree, place there, text) of each page
        for tree, texts in own:
            for x, y in wrappers.aligned(tree, pivot).items():
                if texts[x]:
                    at.setdefault(y, []).append((tree, x, texts[x]))
        whole = sum(len(x) for _, texts in own for x in texts)
        template = []
        for y, found in at.items():
            shared = sum(found.count(f) > 1 or len(met[f[2]]) > 1 for f in found)
            same = len({x for _, _, x in found}) == 1
            short = sum(len(x) for _, _, x in found) * len(own) <= wrappers.SHORT * whole * len(found)
            if len(found) >= wrappers.LEAST_PAGES and len(found) >= wrappers.LEAST_SHARE * len(own) and (same or wrappers._outside(pivot)[y] and shared >= wrappers.SHARED * len(found) and short):
                template.append(y)
        out[url[7:-1]] = (pivot, sorted(template))
    return out


def test_induction_is_that_of_a_plain_one(spark, monkeypatch):
    rows, _ = rotating_pages(5, 9)
    rows += [(900 + k, "http://h0/", rows[0][2]) for k in range(20)]  # copies of a page count once
    rows += [(950 + k, "http://art/", f"<body><article><h1>{'ab'[k % 2]}</h1><p>story {k} of its own</p></article><div>{'cd'[k % 2]}</div></body>") for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select(wrappers.host_of(F.col("url")).alias("host"), "html")
    for most in (1 << 20, 0):  # pivots and fingerprints broadcast, and joined
        monkeypatch.setattr(wrappers._judged, "__defaults__", (32, most))
        got = {r.host: (r.pivot, r.template) for r in wrappers.induce_wrappers(df, most_bytes=most).collect()}
        assert got == brute_templates(rows)
    assert len(got["art"][1]) == 1  # what rotates within an article stays


def test_many_differently_shaped_siblings_are_quick():
    def page(seed, n):
        r = random.Random(seed)
        return "".join(f"<div>{'<p>x</p>' * r.randrange(1, 3)}{'<ul><li>a</ul>' * (k % 7)}{'<h2>t</h2>' * (k % 11)}{'<dl><dt>d</dl><h3>y</h3>' * (k // 77)}</div>" for k in range(n))

    a, b = (wrappers._as_json(wrappers.fold(wrappers.parse(page(s, 2000)))[0]) for s in (1, 2))
    began = time.process_time()
    found = wrappers.aligned(a, b)
    assert time.process_time() - began < 2 and len(found) > 4000
    assert sorted(found.values()) == [y for _, y in sorted(found.items())]


def test_a_long_footer_is_no_page():
    html = f"<body><nav>menu</nav><article><h1>Short.</h1></article><footer>{MAIN}</footer></body>"
    page = wrappers.parse(html)
    fixed = [tag == "nav" for tag in page.tag]
    assert wrappers._content(page, fixed) == "Short."
    assert wrappers.extract(f"<body><footer><article>{MAIN}</article></footer></body>", None, []) == MAIN.strip()
