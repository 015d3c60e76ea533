import random
import re
import time

import numpy as np
import pytest

from netloom.llm import html_text, jaccard_join, queries
from netloom.llm.common import Scratch
from tests.llm.sqlcheck import SF, duck
from tests.llm.test_native_ops import ODD, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, words, num, den):
    lower = {chr(c): chr(c + 32) for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(lower.get(c, c) for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted([(rows[i][0], len(sets[i]), ids.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))], key=repr)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return words


def corpus(seed):
    """Chains of edits, groups of near copies around the threshold, short texts, shared passages, repeated and null rows."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([3, 8, 14, 30, 60, 200, 500]))]
        texts.append(base)
        for _ in range(r.choice([1, 4, 30])):
            source = r.choice([base, texts[-1]])
            texts.append(edited(r, source, r.randint(0, max(1, len(source) // r.choice([20, 40, 80])))))
    texts += [passage + [f"w{r.randrange(5000)}" for _ in range(r.choice([1, 5, 40, 300]))] for _ in range(30)]
    texts += [[], ["a"], ["A"], ["a", "b"], ["a", "b"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (None, rows[0][1]), rows[1], (10**6, None), (10**6 + 1, "")]


def test_components_against_brute_force(spark):
    for seed, (words, num, den) in enumerate([(3, 90, 100), (5, 80, 100)]):
        rows = corpus(seed)
        d = docs(spark, [(i, t, "s") for i, t in rows])
        got = jaccard_join.jaccard_components(d, words, num, den).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_components(rows, words, num, den)
        stay = jaccard_join.jaccard_dedup(d, words, num, den)
        heads = {(c if n else f"own{i}") for i, n, c in brute_components(rows, words, num, den)}
        assert stay.columns == d.columns and stay.count() == len(heads)


def test_linked_sets_share_enough_tiles():
    r = random.Random(5)
    for num, den in ((90, 100), (80, 100)):
        for _ in range(300):
            n = r.choice([5, 9, 12, 17, 40, 100, 700])
            a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
            b = list(a)
            for _ in range(r.randint(0, n // 4 + 1)):
                if r.random() < 0.5 and len(b) > 1:
                    b.pop(r.randrange(len(b)))
                else:
                    b.append(np.uint64(r.getrandbits(64)))
            b = np.unique(np.array(b, np.uint64))
            k = len(np.intersect1d(a, b))
            if jaccard_join.links(k, len(a), len(b), num, den) and not np.array_equal(a, b):
                (x, left_x), (y, left_y) = jaccard_join.tile_keys(a, num, den), jaccard_join.tile_keys(b, num, den)
                both = np.intersect1d(x, y)
                leaves = [{int(k) & 127: f for k, f in zip(keys, left, strict=True)} for keys, left in ((x, left_x), (y, left_y))]
                assert any((both & 127 == band).sum() > max(z.get(band, 10**9) for z in leaves) for band in set(leaves[0]) & set(leaves[1]))
                bits = sum((x ^ y).bit_count() for x, y in zip(jaccard_join.signature(a), jaccard_join.signature(b), strict=True))
                assert k <= (len(a) + len(b) - bits) // 2


def test_small_sets_with_many_empty_segments_meet(spark):
    """Linked sets of 4 to 9 elements, one of which may have more empty segments than slack and the other one not."""
    r = random.Random(6)
    for n in (4, 5, 6, 8):
        for _ in range(600):
            a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
            b = np.unique(np.append(a, np.uint64(r.getrandbits(64))))
            (x, left_x), (y, left_y) = jaccard_join.tile_keys(a, 80, 100), jaccard_join.tile_keys(b, 80, 100)
            both = np.intersect1d(x, y)
            leaves = [{int(k) & 127: f for k, f in zip(keys, left, strict=True)} for keys, left in ((x, left_x), (y, left_y))]
            assert any((both & 127 == band).sum() > max(z.get(band, 10**9) for z in leaves) for band in set(leaves[0]) & set(leaves[1]))

    k, slack = jaccard_join.band_plan(jaccard_join.bisect_right(jaccard_join.BANDS, 4) - 1, 80, 100)
    full = lambda text: len(set((jaccard_join.shingles(text.encode(), 5) >> np.uint64(7)) % np.uint64(k)))
    while True:
        words = [f"w{r.randrange(10**6)}" for _ in range(9)]
        if k - full(" ".join(words[:8])) > slack >= k - full(" ".join(words)):
            break
    rows = [(0, " ".join(words[:8])), (1, " ".join(words))]
    got = jaccard_join.jaccard_components(docs(spark, [(i, t, "s") for i, t in rows]), 5, 80, 100).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == [(0, 4, 0), (1, 5, 0)]


def test_groups_of_edited_copies_without_their_base(spark):
    """Copies of one text, most of them linked only through some of the others."""
    for seed, (words, num, den) in enumerate([(3, 90, 100), (5, 80, 100), (3, 90, 100)]):
        r = random.Random(100 + seed)
        rows = []
        for base in ([f"w{r.randrange(900)}" for _ in range(n)] for n in (40, 90, 250)):
            edits = [(r.randrange(len(base)), f"e{i}") for i in range(25)]
            for _ in range(90):
                t = list(base)
                for i, w in r.sample(edits, r.randint(1, max(2, len(base) // 18))):
                    t[i] = w
                rows.append((len(rows) * 7 % 1009, " ".join(t)))
        got = jaccard_join.jaccard_components(docs(spark, [(i, t, "s") for i, t in rows]), words, num, den).collect()
        want = brute_components(rows, words, num, den)
        assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=repr) == want
        print(len(rows), len({c for _, _, c in want}))


def test_components_of_graphs(spark):
    """Paths, stars, cycles and a graph without edges."""
    r = random.Random(8)
    for edges in ([], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (52, 51)], [(r.randrange(200), 200 + r.randrange(200)) for _ in range(180)]):
        root = {x: x for e in edges for x in e}

        def find(x):
            return x if root[x] == x else find(root[x])  # noqa: B023

        for a, b in edges:
            low, high = sorted((find(a), find(b)))
            root[high] = low
        with Scratch(spark) as scratch:
            got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
        assert {x.node: x.comp for x in got} == {x: find(x) for x in root}


def test_join_edges(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0
    got = jaccard_join.jaccard_components(docs(spark, ODD)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_components([r[:2] for r in ODD], 3, 90, 100)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu<li>More</ul></nav><!-- <p>no</p> --><div class="top-ad">Buy</div>
<article><h1>Ti&amp;tle</h1><p><b>Lead&nbsp;in.<br><p>a <i>b</i>c  d\n e</p><aside>Side</aside><form><p>Mail</p></form><ul><li>one<li>two</ul>
<div class="comments"><p>First!</p></div><table><tr><td>x<td>y</table></article><footer>&copy; Foot</footer></body></html>"""


def test_markup_and_lines():
    assert html_text.main_text(html_text.lines_of(PAGE), None) == "Ti&tle Lead in. a bc d e one two x y"
    for html in ("", "<", "<p", "<p class='x>y", "a<b>c", "&lt;b&gt;", "<script>", "<!-- x", "<![CDATA[a]]>", "</p></div>z", "<article>q</article></article>r"):
        html_text.lines_of(html)
    assert html_text.main_text(html_text.lines_of("a<b>c &lt;b&gt;"), None) == "ac <b>"


def test_names_do_not_drop_the_article():
    text = lambda html: html_text.main_text(html_text.lines_of(f"<body><div>Out</div>{html}</body>"), None)
    for tag in ("article class='post comments-open'", "main class='no-sidebar'", "article id='comment'", "div role='main' class='widget'"):
        assert text(f"<{tag}><p>Story</p></{tag.split()[0]}>") == "Story"
    for name in ("content has-sidebar", "elementor-widget-text-editor", "elementor-widget", "content-sidebar-wrap", "comments-open"):
        assert text(f"<div class='{name}'><p>Story</p></div>") == "Out Story"
        assert text(f"<article><div class='{name}'><p>Story</p></div></article>") == "Story"
    for name in ("sidebar", "widget"):
        assert text(f"<div class='{name}'><article><p>Story</p></article></div>") == "Story"
        assert text(f"<div class='{name}'>Aside<main><p>Story</p></main></div><article>Card</article>") == "Story Card"
    # What the names are for goes as ever.
    for name in ("top-ad", "ad", "site-footer", "comment-list", "related_posts", "widget_text", "main-nav open-menu nav"):
        assert text(f"<div class='{name}'><p>Menu</p></div>") == "Out"
        assert text(f"<article>Story<div class='{name}'><article class='x'>Menu</article></div></article>") == "Story"
        assert text(f"<main>Story<div class='{name}'><article>Menu</article></div></main>") == "Story"
        assert text(f"<article>Story</article><div class='{name}'><article>Menu</article></div>") == "Story"


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("matches", [1 << 21, 0])
def test_alignment_is_a_longest_common_subsequence(matches, monkeypatch):
    """Lines that repeat and lines that don't, by either way of finding it."""
    monkeypatch.setattr(html_text, "MATCHES", matches)
    r = random.Random(3)
    for _ in range(600):
        kinds = r.choice([2, 3, 8, 40])
        a, b = ([r.randrange(kinds) for _ in range(r.randint(0, 20))] for _ in range(2))
        got = sorted(html_text.shared(list(map(str, a)), list(map(str, b))))
        assert len(got) == brute_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)
    assert len(html_text.shared(["x", "y", "x"], ["y", "x"])) == 2
    a, b = ([str(r.randrange(40)) for _ in range(6000)] for _ in range(2))
    began = time.time()
    assert len(html_text.shared(a, b)) > 1200 and time.time() - began < 20


def test_hostile_pages_take_a_time_in_proportion_to_their_length():
    n = 1 << 20
    for html in ("<div>" * (n // 10) + "</b>" * (n // 8), "<a x'" * (n // 6), '<a b="' * (n // 6), "<!a" * (n // 3), "<" * n, "<b hidden><article>" + "<div>" * (n // 10) + "</b>" * (n // 8), "<ul><li>" * (n // 8), "<a '\"" * (n // 6) + ">"):
        began = time.time()
        html_text.lines_of(html)
        assert time.time() - began < 15, html[:20]
    assert html_text.lines_of("<a x='<p>One</p><i b=\"1\">Two</i><p>Three") == [("One", "other"), ("Two", "other"), ("Three", "other")]


def test_differencing_of_pages_without_an_article(spark):
    page = lambda body: f"<body><div>Home</div><div>About us</div>{body}<div>All rights reserved</div></body>"
    rows = [(1, "http://h/x/1", page("<p>first story</p>")), (2, "http://h/x/2", page("<p>second <b>story</b></p><p>ends</p>")), (3, "http://other/", page("<p>alone</p>")), (4, None, None), (5, "http://h/x/2", None)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int"), 1).collect()}
    assert got[1] == "first story" and got[2] in ("second story ends", page("") and got[2]) and got[4] == "" and got[5] == ""
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


FRAME = "<body><div>Home</div><div>About us</div>{}<div>All rights reserved</div></body>"
DDL = "page_id long, url string, html string"


def texts(spark, rows, n=1):
    return {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, DDL), n).collect()}


def test_copies_and_empty_pages_are_looked_past(spark, monkeypatch):
    """Without article elements: copies keep their text and lose the menus; an empty nearest page hides no other one."""
    one, two = (FRAME.format(f"<p>{x} story</p>") for x in ("first", "second"))
    advert = one.replace("<body>", "<body><nav>Today</nav>")
    rows = [(1, "http://h/x/1", one), (2, "https://h/x/1", one), (3, "http://h/x/1?page=2", one), (4, "http://h/x/1#top", advert), (5, "http://h/x/1", None), (6, "http://h/x/2", two), (7, "http://h/x/2", ""), (8, "http://h/x/2", two), (8, "http://h/x/2", two)]
    for held in (html_text.HELD, 100):
        monkeypatch.setattr(html_text, "HELD", held)
        assert texts(spark, rows) == {1: "first story", 2: "first story", 3: "first story", 4: "first story", 5: "", 6: "second story", 7: "", 8: "second story"}
    page = lambda body: FRAME.format(body)
    got = texts(spark, [(1, "http://h/x/1", page("<p>first story</p>")), (2, "http://h/x/2", page("<p>second <b>story</b></p><p>ends</p>")), (5, "http://h/x/2", None), (6, "http://g/", one), (7, "http://g/", one)])
    assert got == {1: "first story", 2: "second story ends", 5: "", **dict.fromkeys((6, 7), "Home About us first story All rights reserved")}


def test_texts_do_not_depend_on_ranges(spark):
    """Hosts cut by many ranges, with copies, empty pages, repeated rows and null ids at the cuts, against one range."""
    r = random.Random(4)
    rows = []
    for i in range(240):
        host = r.choice(["a", "a", "b", f"c{r.randrange(20)}"])
        story = r.choice(["<p>copied</p>", f"<p>story {i}</p><p>{r.choice('xy')}</p>", f"<p>s{r.randrange(4)}</p>"])
        body = r.choice([FRAME, FRAME, f"<div>menu of {host}</div>{{}}"]).format(story)
        rows.append((r.choice([i, i, None]), f"http://{host}/{r.randrange(3)}/{r.randrange(30)}", r.choice([body, body, body, None])))
    rows += [(1000 + i, "http://d/x", FRAME.format("<p>all alike</p>")) for i in range(60)] + [(2000, "http://d/y", FRAME.format("<p>other</p>"))] + rows[:20]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = [sorted(map(repr, html_text.extracted(df, n).collect())) for n in (1, 7, 200)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    alike = {x.text for x in html_text.extracted(df, 200).filter("page_id >= 1000").collect()}
    assert alike == {"all alike", "other"}


def test_pages_query(spark):
    """The pages' articles, read by a plain search of the one template they have."""
    got = {r.page_id: r for r in queries.op2_html_extraction(spark, SF).collect()}
    from html import unescape

    for r in duck("SELECT * FROM pages").itertuples():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
