"""Site style trees: parsing, importance against a brute-force version, and what is left of pages."""

import html
import math
import random
import re
from collections import Counter

import pytest

from folioquery.llm import html_extraction as he


def text(markup, low=()):
    return he.Page(markup, {}, {}).text(set(low))


def frame(spark, rows):
    wide = [(i, u, h, "x", 1, 2) for i, u, h in rows]
    return spark.createDataFrame(wide, "page_id long, url string, html string, text string, n_chars int, key int")


def ran(spark, rows, labels=True):
    got = he.extract(frame(spark, rows), labels).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.url, r.text) for r in got), key=repr)


@pytest.mark.parametrize(
    "markup, want",
    [
        ("", ""),
        ("plain  text\n", "plain text"),
        ("<article>a<b>b</b>c<br>d<p>e<p>f &amp; g&nbsp;h &#x41;</article>x", "abc d e f & g h A"),
        ("<p>1 < 2 and 3<4</p>", "1 < 2 and 3<4"),
        ("<p>a</p><script>var t='</p><p>no';</script><style>p{}</style><p>b", "a b"),
        ("<!-- no --><p>a<!-- > --><i>b</i><!x><?y?></>c", "abc"),
        ("<p title='a>b' data-x=\"</p>\">t</p>", "t"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b 1 2 3"),
        ("<p>a<p hidden>b<p style='display: none'>c<p aria-hidden=true>d<p>e", "a e"),
        ("<header>top</header><main><h1>T</h1><p>t</p></main><footer>f</footer>", "T t"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>t</p><footer>tags</footer><aside>s</aside></article>", "T t"),
        ("<div class='has-sidebar'><article><p>t</p><div class='ad-box'>buy</div></article><div class=sidebar>s</div></div>", "t"),
        ("<div class='social-page'><article><p>t</p></article></div><article class=comment><p>no</p></article>", "t"),
        ("<section id='comments'><p>I disagree</p></section><div><p>t</p></div>", "t"),
        ("<p>t</p><div class=cookieConsent>ok?</div><form><label>name</label><input></form><div role=alert>!</div>", "t"),
        ("<div><ul><li><a href=/a>A</a><li><a href=/b>B</a><li><a href=/c>C</a></ul></div><p>t <a href=/>l</a></p>", "t l"),
        ("<article><p>t</p><ul><li><a>1</a><li><a>2</a><li><a>3</a></ul></article>", "t 1 2 3"),
        ("<article><p>t <a href='x", "t"),
        ("<article><textarea>no</textarea><select><option>no</select><p>t</p></article></div></p></span>", "t"),
        ("<b><p>te</b>xt</p>", "text"),
        ("<svg><title>no</title><text>no</text></svg><noscript>no</noscript><template><p>no</p></template><p>t", "t"),
    ],
)
def test_pages(markup, want):
    assert text(markup) == want


def test_long_and_deep_pages_are_linear():
    assert text("<div>" * 50_000 + "t" + "</i>" * 50_000) == "t"
    assert len(text("<p>word</p>" * 100_000).split()) == 100_000
    assert text("<p>a</p>" + "<!-- " * 50_000) == "a"
    assert text("<article><p>" + "<i>x" * 50_000 + "</article>") == "x" * 50_000


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "nohost", "<p>a"), (3, "nohost", "<p>a"), (None, "http://x", "<article>b</article>"), (4, "http://u@X:80/p?q", "<p>" + "w " * 300_000)]
    want = [(1, None, ""), (2, "", ""), (3, "nohost", "a"), (3, "nohost", "a"), (None, "http://x", "b"), (4, "http://u@X:80/p?q", ("w " * 300_000).strip())]
    assert ran(spark, rows) == sorted(want, key=repr)
    assert ran(spark, []) == [] and he.host_of("http://u@X:80/p?q") == "x" and he.host_of("https://y.org#a") == "y.org"


def site(n, seed):
    """Pages without any telling name: blocks of one host's template beside texts of their own."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    said = lambda k: " ".join(rng.choices(words, k=k))
    notes = ["Read our terms", "All rights reserved by us", "Call us now"]
    rows, want = [], []
    for i in range(n):
        parts = [said(30), said(40), said(20)]
        body = "".join(f"<div class=x{k}>{p}</div>" for k, p in enumerate(parts))
        rows.append((i, "http://site.example", f"<body><div class=q>Home of things</div><div class=r>{body}</div><div class=s>{notes[i % 3]}</div></body>"))
        want.append((i, "http://site.example", " ".join(parts)))
    return rows, want


def test_tree_finds_a_sites_template(spark):
    rows, want = site(120, 1)
    assert ran(spark, rows) == sorted(want, key=repr)
    assert ran(spark, rows, labels=False) == sorted(want, key=repr)


def test_few_pages_go_by_the_web(spark):
    """Two pages of a host say nothing; what their style is worth elsewhere does."""
    rows, want = site(120, 2)
    two = [(900 + i, "http://small.example", h) for i, (_, _, h) in enumerate(rows[:2])]
    assert [r[2] for r in ran(spark, rows + two) if r[1] == "http://small.example"] == [w[2] for w in want[:2]]
    assert all("Home of things" in r[2] for r in ran(spark, two))


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://a.example", f"<nav>m</nav><article><h1>T</h1><p>same text</p><div class=box>same box</div></article><footer>{i}</footer>") for i in range(80)]
    assert {r[2] for r in ran(spark, rows)} == {"T same text"}


def test_importance_against_brute_force(spark):
    rows, _ = site(30, 3)
    rows += [(100 + i, f"http://h{i % 3}.example", h.replace("class=q", "class=z")) for i, (_, _, h) in enumerate(site(9, 4)[0])]
    seen = {}
    for _, url, markup in rows:
        page = he.Page(markup, {}, {})
        content, shape, any_ = page.branches()
        for i, own in enumerate(page.own_presentation()):
            if own and any_[i]:
                seen.setdefault((he.host_of(url), page.path[i]), []).append((shape[i], content[i]))

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n) if n > 1 else 1.0

    def own(pairs):
        return 0.1 * entropy([a for a, _ in pairs]) + 0.9 * entropy([b for _, b in pairs])

    web = {}
    for (_, path), pairs in seen.items():
        web.setdefault(path, []).extend(pairs)
    want = []
    for (_, path), pairs in seen.items():
        w = ((len(web[path]) - 1) * own(web[path]) + 5) / (len(web[path]) + 4)
        want.append(round(((len(pairs) - 1) * own(pairs) + 5 * w) / (len(pairs) + 4), 9))
    got = [round(r.importance, 9) for r in he.importance(he.style_counts(frame(spark, rows))).collect()]
    assert sorted(got) == sorted(want)


def test_keys_in_several_shards(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(he, "SHARD_KEYS", 100)
    keys = [(k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for k in range(1000)]
    shards = he.Shards.write(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert len(shards.found) == 16
    asked = np.array(keys + [k + 1 for k in keys], np.int64).view(np.uint64)
    assert shards.have(asked).tolist() == [True] * 1000 + [False] * 1000


def test_given_pages_against_their_articles(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()

    def article(markup):
        inner = re.sub(r"</?(?:b|i|em|strong|a)(?: [^>]*)?>", "", markup[markup.index("<article>") : markup.index("</article>")])
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())

    assert ran(spark, rows) == sorted(((i, u, article(h)) for i, u, h in rows), key=repr)
