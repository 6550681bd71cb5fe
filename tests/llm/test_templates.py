import html
import re
from collections import Counter

import pytest

from tidemark.llm import html_text, templates

CHROME = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="post"><h1>Head</h1><p>One <a href=x>link</a> &amp;amp; <span class="ad">buy</span> two<br>three
<ul><li>a<li>b</ul><form>f<input></form><p>End<div class="comments"><h3>Comments</h3><p>nice</div></div><div class="sidebar">side</div></div>
<footer>f</footer><script>if(a<b)"</p>"</script></body></html>"""

CASES = [
    (CHROME, "Head\n\nOne link &amp; two three\n\na\n\nb\n\nEnd"),
    ("", ""),
    ("plain &lt;text&gt; only", "plain <text> only"),
    ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside><nav>no</nav></article><article class='comment'>no</article>", "T\n\nx"),
    ("<main><p>a</p><section id='comments'><article>reader</article></section></main>", "a"),
    ("<p>a<p>b<div>c</p>d</div>", "a\n\nb\n\nc\n\nd"),
    ("<article><p>x<!-- <p>no</p> -->y</p><p hidden>no</p><p style='display: none'>no</p><div role=alert>no</div></article>", "xy"),
    ("<article><p title='a>b'>q</p>&nbsp;&#233;  z<textarea></p></textarea></article>", "q\n\né z"),
    ("<article><p>broken <b>tags</i></article></div><p", "broken tags"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("<div class=noadvert><p>kept</p></div>", "kept"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_one_page(page, want):
    assert templates.text_of(page, None) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *((f"<body><p>menu</p><article><div class='{c}'><h1>Title</h1></div><p>x</p></article></body>", "Title\n\nx") for c in ("article-header", "entry-header", "header", "post-footer", "related-work", "form-factor", "post has-comments")),
        *((f"<body><p>menu</p><div {c}><article>Story of many words</article></div></body>", "Story of many words") for c in ("id=reader", "class=reader-content", "class=feedback")),
        ("<body><p>menu</p><article class='feedback'>Story of many words</article></body>", "Story of many words"),
        ("<body><div class=post-header><h1>Title</h1></div><p>x</p><div class=site-header>no</div><div class=related-posts>no</div></body>", "Title\n\nx"),
        ("<body><article>Story of words</article><div class=ad><article>no</article></div></body>", "Story of words"),
        ("<body><p>Story</p><div class=comment-list><article>a long answer of a reader to it</article></div></body>", "Story"),
        ("<body><article>x<div class='wp-sidebar-2'>no</div><div class=feedback>no, although it is most of the page</div></article></body>", "x"),
    ],
)
def test_names_drop_no_article(page, want):
    assert templates.text_of(page, None) == want


@pytest.fixture(scope="module")
def site(spark):
    """A host whose article lies in an unnamed div between unnamed chrome; the chrome is told by the template alone."""
    page = "<body><div class=x1><ul>{menu}</ul></div><div class=x2><h2>Title {k}</h2>{ps}</div><div class=x3><p>Impressum</p></div></body>"
    rows = [(k, f"http://H.example/{k}", page.format(k=k, menu="<li>Home<li>News", ps="".join(f"<p>Story {k} part {j} has words enough to stand out</p>" for j in range(3 + k % 4)))) for k in range(12)]
    rows += [(100, "http://single.example/", CHROME), (101, None, "<p>no host</p>"), (102, "http://n.example/", None), (None, "http://n.example/x", ""), (103, "http://H.example/odd", "<article>other layout</article>")]
    rows += [(104, "http://s.example/", "<p>" + "long words " * 100_000 + "</p>")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")


def test_template_finds_the_slot(site):
    got = {r.page_id: r for r in templates.extract(site).collect()}
    for k in range(12):
        want = "\n\n".join([f"Title {k}"] + [f"Story {k} part {j} has words enough to stand out" for j in range(3 + k % 4)])
        assert got[k].text == want and got[k].n_chars == len(want)
    assert got[100].text == CASES[0][1] and got[101].text == "no host" and got[102].text == got[None].text == "" and got[103].text == "other layout"
    assert got[104].n_chars == 11 * 100_000 - 1
    assert templates.extract(site.limit(0)).count() == 0


def test_classes_equal_brute_force(site):
    own = templates.hosted(site)
    pages = [(r.host, Counter(html_text.tokens(html_text.parse(r.html)))) for r in own.collect()]
    want = Counter()
    for host in {h for h, _ in pages}:
        counts = [c for h, c in pages if h == host]
        vectors = {}
        for t in set().union(*counts):
            v = tuple(c[t] for c in counts)
            if sum(map(bool, v)) >= max(3, 0.5 * len(counts)) and len(counts) >= 3:
                vectors.setdefault(v, []).append(t)
        want.update((host, tuple(sorted(ts))) for ts in vectors.values() if len(ts) >= 2)
    assert Counter((r.host, tuple(r.tokens)) for r in templates.classes(own).collect()) == want


def brute_template(pages):
    """A host's template from its pages' trees: valid classes as token -> (class, parent class), the static tokens, and the main element's token."""
    roots = [html_text.parse(p) for p in pages]
    sequences = [html_text.tokens(r) for r in roots]
    counts, vectors = [Counter(s) for s in sequences], {}
    for t in sorted(set().union(*counts)):
        v = tuple(c[t] for c in counts)
        if sum(map(bool, v)) >= max(3, len(pages) / 2):
            vectors.setdefault(v, []).append(t)
    classes = {v: set(ts) for v, ts in vectors.items() if len(ts) >= 2}
    of = {t: v for v, ts in classes.items() for t in ts}
    parents = {v: set() for v in classes}
    for root in roots:
        for e in html_text.elements(root):
            up = e.parent
            while up is not None and of.get(up.token, of.get(e.token)) == of.get(e.token):
                up = up.parent
            if e.token in of:
                parents[of[e.token]].add(of[up.token] if up is not None else None)
    valid = {}
    for v, ts in classes.items():
        runs = {tuple(t for t in s if t in ts) for s in sequences if any(t in ts for t in s)}
        short = min(runs, key=len)[: len(ts)]
        above = {min(parents[v], key=lambda p: (p is not None, p)) if parents[v] else None}
        if set(short) == ts and all(r == short * (len(r) // len(ts)) for r in runs) and len(parents[v]) <= 1:
            valid[v] = above.pop()
    while lost := [v for v, p in valid.items() if p is not None and p not in valid]:
        for v in lost:
            del valid[v]
    static = {t for v in classes for t in classes[v] if t & 1 and sum(map(bool, v)) >= 0.9 * len(pages) and len(pages) >= 5}
    chars = Counter()
    for root in roots:
        for e, depth, n, _ in html_text.slot_chars(root, static):
            if of.get(e.token) in valid and set(of[e.token]) <= {0, 1}:
                chars[e.token, e.tag, depth] += n
    most = max(chars.values(), default=0)
    half = [(k, n) for k, n in chars.items() if n > most / 2]
    picks = [min((k[2], k[0]) for k, _ in half if k[1] == tag)[1] for tag in ("article", "main") if any(k[1] == tag for k, _ in half)]
    picks += [max((k[2], k[0]) for k, n in half if n >= 0.95 * most)[1]] if half else []
    return {t: (of[t], valid[of[t]]) for t in of if of[t] in valid}, {t for t in static if of[t] in valid}, picks[0] if picks else None


@pytest.fixture(scope="module")
def lists(spark):
    """A host with a list of varying length nested in its frame, static notices in and around the text, and a class whose parent isn't valid."""
    page = "<body><div class=top>{ad}</div><div class=text><h2>About {k}</h2><p>{words}</p><p>Read our terms</p></div><ul class=more>{items}</ul>{odd}<div class=end>All rights</div></body>"
    rows = []
    for k in range(9):
        items = "".join(f"<li><p class=a>name {k} {j}</p><p class=b>note {k} {j}</p>" for j in range(1 + k % 3))
        odd = ["<div class=u><div class=v><p class=w>x</p></div></div>", "<div class=v><div class=u><p class=w>x</p></div></div>"][k % 2]
        rows.append((k, f"http://lists.example/{k}", page.format(k=k, ad=f"advert number {k}", words=" ".join(f"word{k}{j}" for j in range(900)), items=items, odd=odd)))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_templates_equal_brute_force(site, lists):
    nested = 0
    for pages in (site, lists):
        own = templates.hosted(pages)
        found = templates.templates_of(own)
        slots = {r.host: r for r in templates.main_slots(found).collect()}
        by_host = {}
        for r in own.collect():
            by_host.setdefault(r.host, []).append(r.html)
        for host, htmls in by_host.items():
            rows = [r for r in found.collect() if r.host == host]
            if len(htmls) < 3:
                assert not rows
                continue
            template, static, main = brute_template(htmls)
            number = {r.class_no: frozenset(r.tokens) for r in rows}
            assert Counter(map(frozenset, number.values())) == Counter(frozenset(t for t in template if template[t][0] == v) for v in {v for v, _ in template.values()})
            for r in rows:
                (_, above), = {template[t] for t in r.tokens}
                assert (r.parent is None) == (above is None) and (above is None or {template[t][0] for t in number[r.parent]} == {above})
                nested += r.parent is not None
            assert slots[host].main == main and set(slots[host].tokens) == static
    assert nested > 0


def test_static_text_goes_and_slots_are_told(lists):
    got = {r.page_id: r.text for r in templates.extract(lists).collect()}
    for k, text in got.items():
        assert text == f"About {k}\n\n" + " ".join(f"word{k}{j}" for j in range(900))
    slots = templates.slots(lists).where("page_id = 2").orderBy("place").collect()
    texts = [r.text for r in slots]
    assert texts[0] == "advert number 2" and "name 2 1" in texts and "Read our terms" not in texts and "All rights" not in texts
    assert len({r.slot for r in slots if r.text.startswith("name")}) == 1


def test_many_tokens_are_joined_by_host(site, monkeypatch):
    want = Counter(map(tuple, templates.extract(site).collect()))
    monkeypatch.setattr(templates, "BROADCAST_TOKENS", -1)
    assert Counter(map(tuple, templates.extract(site).collect())) == want


def test_small_tables_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in templates.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert got[r.page_id] == "\n\n".join(filter(None, parts))


DEEP = 100_000


@pytest.mark.parametrize("page", ["<div class=sidebar>" + "<div>" * DEEP + "x", "<p>x</p>" + "<b class=nav>" * DEEP, "<div>" * DEEP + "x" + "</span>" * DEEP, "<div class=feedback>" * DEEP + "x", "<ul><li>" * DEEP + "x", "<article>" * DEEP + "x"])
def test_deep_pages(page):
    """Depth neither ends the task nor costs its square."""
    assert templates.text_of(page, None) in ("", "x")
    assert len(html_text.tokens(html_text.parse(page))) > DEEP


def test_deep_page_among_others(spark):
    page = "<body><ul><li><a href=/>Home</a></ul><div><h1>T{k}</h1><p>Story {k} has words enough to stand out</p></div></body>"
    rows = [(k, "http://d.example/", page.format(k=k)) for k in range(6)] + [(9, "http://d.example/", "<div>" * DEEP + "<p>deep</p>")]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"T{k}\n\nStory {k} has words enough to stand out" for k in range(6)} | {9: "deep"}


@pytest.mark.parametrize("n", [4, 6, 60])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_headings_that_all_pages_have_stay(spark, n, tag):
    page = "<body><nav>menu</nav><{t}><h1>Cake {k}</h1><h2>Ingredients</h2><p>{k} eggs and {k} spoons of flour</p><h2>Method</h2><p>Stir it {k} times and bake it for long</p></{t}></body>"
    rows = [(k, "http://r.example/", page.format(k=k, t=tag)) for k in range(n)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Cake {k}\n\nIngredients\n\n{k} eggs and {k} spoons of flour\n\nMethod\n\nStir it {k} times and bake it for long" for k in range(n)}


def test_pages_without_names_go_by_their_template(spark):
    """With classes, ids, roles and telling tags taken away, what is left of a page's own tree finds no article; the template finds those of all hosts that have one."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = lambda r: re.sub(r"\w+://([^/]*).*", r"\1", r.url)

    def bare(page):
        return re.sub(r"<(/?)(article|main|nav|aside|header|footer|section)\b", r"<\1div", re.sub(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page))

    want = {r.page_id: templates.text_of(r.html, None) for r in rows}
    often = Counter(map(host, rows))
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in rows], "page_id long, url string, html string")).collect()}
    held = [r for r in rows if often[host(r)] >= templates.MIN_PAGES]
    assert not any(templates.text_of(bare(r.html), None) == want[r.page_id] for r in rows)
    assert len(held) >= 200 and sum(got[r.page_id] == want[r.page_id] for r in held) >= 0.95 * len(held)
