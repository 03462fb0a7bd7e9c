"""Main text by site style trees: given pages, sites without marked articles, and importance against the recursive definition."""

import html as entities
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL

from veritab.llm import pagetree, sitetree


def given_article(page):
    found = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", found))
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    pages = pd.read_parquet(SMALL.replace("sf0.001", sf) + "/pages.parquet").set_index("page_id")
    got = sitetree.op11_site_style_tree(spark, SMALL.replace("sf0.001", sf)).toPandas()
    assert len(got) == len(pages) and got.page_id.is_unique
    for r in got.itertuples():
        assert r.text == given_article(pages.html[r.page_id]) and r.n_chars == len(r.text) and r.url == pages.url[r.page_id]
    assert sf == "sf0.001" or got.by_tree.sum() > 0


def text(page, low=(), high=()):
    return pagetree.main_text(pagetree.parse(page)[0], set(low), set(high))[0]


CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("a<b>b</b>c <i>d</i>", "abc d"), ("<p>a<br>b<p>c&amp;d&nbsp; &#8364;&lt;", "a b\nc&d €<"), ("<ul><li>x<li>y</ul>z", "x\ny\nz"),
    ("<title>t</title><h1>h</h1><p>p", "h\np"), ("<head><title>t<body><p>p", "p"), ("<p>a<script>var x='</p>'</script>b<style>p{}</style>", "ab"), ("<p>a<!-- c --><noscript>n</noscript>b", "ab"),
    ("<nav><a>m</a></nav><article><h1>h</h1><nav>in</nav><p>p</p><footer>f</footer></article><footer>f</footer>", "h\np"), ("<nav>m<article><p>p</p></article>", "p"), ("<nav><article>teaser</article></nav><p>p", "p"),
    ("<article><p>p</p></article><article class='comment'>c</article>", "p"), ("<article>p<section id=comments><p>c</section></article>", "p"), ("<div class='has-sidebar'><article><p>p</p></article><div class=sidebar>s</div></div>", "p"),
    ("<main><div>x</div><article>a</article></main>", "a"), ("<main><p>a</p><aside>s</aside></main><div>x</div>", "a"), ("<form><h1>t</h1><p>all of the page stands in a form</form>", "t\nall of the page stands in a form"), ("<form><p>q<input></form><p>p", "p"),
    ("<article><header><h1>h</h1></header>p</article>", "h\np"), ("<header><h1>site</h1></header><p>p", "p"), ("<div role=banner>b</div><p>p", "p"), ("<p>a <span class=ad>x <span>y</span></span> b", "a b"), ("<div class=article-header><h1>h</h1></div><p>p", "h\np"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\nb\nc\nd"), ("<div><p>a</div>b</div>c", "a\nbc"), ("<h2>a<h3>b</h2>c", "a\nb\nc"), ("<button>x</button><p>p<select><option>o</select>q", "pq"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
    ("<" + "div><" * 300 + "article>deep</article>", "deep"), ("<div>" * 3000 + "deep", "deep"), ("</p></div></b>x", "x"), ("<p/>a<div/>b", "a\nb"), ("<article></article><p>p", "p"), ("1 < 2 & 3<p>&unknown; &amp", "1 < 2 & 3\n&unknown; &"), ("<h1>out</h1><article>a</article><div>x</div>", "out\na"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_markup(page, want):
    assert text(page) == want


def site(n, wrap="div", same_title=False):
    """n pages without landmarks; the last part of their bottom line varies."""
    rows = []
    for k in range(n):
        body = f"<p>Story {k} begins</p>" + "".join(f"<p>line {k} {j}</p>" for j in range(k % 3 + 1))
        rows.append((k, f"http://s.example/{k}", f"<title>{'same' if same_title else k}</title><{wrap} class=top>Home <b>News</b></{wrap}><{wrap}>{body}</{wrap}><{wrap}><p>All rights kept</p><p>Imprint</p></{wrap}>"))
    return rows


def stories(rows):
    return {r[0]: "\n".join(re.findall(r"<p>((?:Story|line)[^<]*)</p>", r[2])) for r in rows}


def extracted(spark, rows, **more):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in sitetree.main_texts(frame, **more).collect()}


def test_layout_goes_without_markup(spark):
    rows = site(30)
    assert extracted(spark, rows) == stories(rows)
    few = site(4)
    assert extracted(spark, few) == {k: f"Home News\n{t}\nAll rights kept\nImprint" for k, t in stories(few).items()}
    # copies of one page, under one title, are no layout
    copies = [(k, f"http://c.example/{k}", site(1)[0][2]) for k in range(40)]
    assert set(extracted(spark, copies).values()) == {"Home News\nStory 0 begins\nline 0 0\nAll rights kept\nImprint"}
    both = rows + [(100 + k, f"http://s.example/c{k}", rows[3][2]) for k in range(60)]
    got = extracted(spark, both)
    assert {k: got[k] for k in range(30)} == stories(rows) and {got[100 + k] for k in range(60)} == {stories(rows)[3]}


def test_pages_of_one_title_all_count(spark):
    rows = site(30, same_title=True)
    assert extracted(spark, rows) == stories(rows)
    # stories that are a small part of their page
    menu = "".join(f"<div>Section {j} of this site</div>" for j in range(40))
    short = [(k, f"http://m.example/{k}", f"<title>same</title><div>{menu}</div><p>Story {k}</p>") for k in range(30)]
    assert extracted(spark, short) == stories(short)
    # copies whose menus, which markup names, differ still count as one, beside which ten other pages show the layout
    copies = [(100 + k, f"http://s.example/c{k}", rows[3][2] + f"<nav>menu {k}</nav>") for k in range(60)]
    others = [(k, url, page + f"<nav>list {k}</nav>") for k, url, page in rows[:10]]
    got = extracted(spark, others + copies)
    assert got == stories(rows[:10]) | dict.fromkeys(range(100, 160), stories(rows)[3])
    alone = extracted(spark, copies)
    assert set(alone.values()) == {f"Home News\n{stories(rows)[3]}\nAll rights kept\nImprint"}


def test_what_varies_stays_beside_an_article(spark):
    rows = [(k, f"http://a.example/{k}", f"<title>{k}</title><div>By author {k}</div><div>Our site</div><article>text {k}</article>") for k in range(12)]
    assert extracted(spark, rows) == {k: f"By author {k}\ntext {k}" for k in range(12)}
    assert extracted(spark, rows[:1]) == {0: "text 0"}


def large_site():
    """Two sections of a few pages, one without articles, on a host of which they are less than a part of 500."""
    others = [(1000 + k, f"http://s.example/o{k}", f"<title>o{k}</title><p>Other {k}</p>") for k in range(4500)]
    bylines = [(100 + k, f"http://s.example/a{k}", f"<title>a{k}</title><div>By author {k}</div><div>Our site</div><article>text {k}</article>") for k in range(8)]
    want = stories(site(8)) | {100 + k: f"By author {k}\ntext {k}" for k in range(8)} | {1000 + k: f"Other {k}" for k in range(4500)}
    return site(8) + bylines + others, want


def test_small_sections_of_a_large_host(spark):
    rows, want = large_site()
    few = {r[0] for r in rows[:16]}
    alone = extracted(spark, rows[:16])
    assert alone == {k: t for k, t in want.items() if k in few}
    assert extracted(spark, rows) == want


def test_rules_by_host_or_by_page(spark, monkeypatch):
    given = pd.read_parquet(f"{SMALL}/pages.parquet")
    rows = [(10_000 + k, u, h) for k, (u, h) in enumerate(zip(given.url, given.html))] + large_site()[0][:200] + [(20_000, None, None), (20_001, "http://s.example/", None), (20_001, "http://s.example/", None)]
    rows += [(30_000 + k, f"http://s.example/c{k}", rows[3][2]) for k in range(50)]  # copies
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for share in (0, 0.05, 2):
        monkeypatch.setattr(sitetree, "SHARE", share)
        found.append(sorted(map(repr, sitetree.main_texts(frame).collect())))
        by_host, by_page = sitetree.site_rules(frame)
        assert (by_host.count() > 0) == (share < 2) and (by_page.count() > 0) == (share > 0)
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]


def recursive(pages):
    """Composite importance by host and node as it is defined, with all nodes at hand."""
    chosen = {}
    for host, page in pages:
        root, title = pagetree.parse(page)
        found = pagetree.site_branches(root)
        own = pagetree.digest(*((b.path[-1], b.style) for b in found))
        key = host, pagetree.digest("title", title) if title else own
        if key not in chosen or own < chosen[key][0]:
            chosen[key] = own, found
    styles, branches = defaultdict(Counter), {}
    for (host, _), (_, found) in chosen.items():
        for b in found:
            styles[host, b.path[-1]][b.style, b.size] += 1
            branches[host, b.path[-1], b.style] = [x.path[-1] for x in b.branches]

    def value(host, node):
        seen = styles[host, node]
        m = sum(seen.values())
        if m == 1:
            return 1.0
        own = -sum(n / m * math.log(n / m, m) for n in seen.values())
        if not any(size for _, size in seen):
            return own
        fading = sitetree.FADING ** min(len(seen), sitetree.STYLES_MOST)
        below = sum(n / m * np.mean([value(host, x) for x in branches[host, node, style]]) for (style, size), n in seen.items() if size)
        return (1 - fading) * own + fading * below

    return {(host, node): value(host, node) for (host, node), seen in styles.items() if sum(seen.values()) > 1}


def test_importance_is_the_recursive_one(spark):
    given = pd.read_parquet(f"{SMALL}/pages.parquet")
    rng = np.random.default_rng(4)
    rows = [(u, h) for u, h in zip(given.url, given.html)] + [(u, h) for _, u, h in site(20)]
    tags = ["<div>", "</div>", "<p>", "<ul><li>", "</ul>", "x", "y", "<section class=a>", "</section>", "<h2>", "<br>"]
    rows += [("http://r.example/", "".join(rng.choice(tags, int(n)))) for n in rng.integers(0, 12, 300)]
    frame = spark.createDataFrame(rows, "url string, html string")
    nodes = sitetree.composite(sitetree.stored(sitetree.site_trees(frame), "tree")).collect()
    want = recursive([(re.sub(r"^.*?://([^/?#]*).*", r"\1", u).lower(), h) for u, h in rows])
    assert {(r.host, r.node): round(r.importance, 9) for r in nodes} == {k: round(v, 9) for k, v in want.items()}


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "<p>a"), (1, None, "<p>a"), (2, "no host", ""), (3, "http://", "<p>b"), (4, "http://one.example", None), (5, "http://one.example", "<p>" + "long words " * 200_000), (6, "http://one.example", "<p>\x00<p> ")]
    frame = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], "page_id long, url string, html string, host long, low long, text long, _h long")
    got = sitetree.main_texts(frame).collect()
    want = [(None, None, ""), (1, None, "a"), (1, None, "a"), (2, "no host", ""), (3, "http://", "b"), (4, "http://one.example", ""), (5, "http://one.example", ("long words " * 200_000).strip()), (6, "http://one.example", "\x00")]
    assert sorted(map(repr, ((r.page_id, r.url, r.text) for r in got))) == sorted(map(repr, want)) and all(r.n_chars == len(r.text) for r in got)
    assert sitetree.main_texts(frame.where("false")).count() == 0
