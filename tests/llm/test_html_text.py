import random
import time
from collections import Counter, defaultdict

from parchment.llm import html_text as ht


def page(body, nav="<nav><a href=/>Home</a></nav>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{nav}{body}<footer>&copy; f</footer></body></html>"


def test_blocks_and_repairs():
    html = page("<article><h1>A &amp; B</h1><p><b>One <i>two</i>.<br>three<p>four\n  five</p><ul><li>x<li>y</ul><div class='comments'><p>me too</div><form><input>Find</form>tail</article>")
    assert ht.main_text(html) == "A & B\n\nOne two. three\n\nfour five\n\nx\n\ny\n\ntail"
    assert ht.main_text(None) == ht.main_text("") == ""
    assert ht.main_text(page("<div class='page has-sidebar'><article class=post><p>Real</p></article><section id=comments><article class=comment><p>No</p></article></section></div>")) == "Real"
    assert ht.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert ht.main_text(page("<aside>side</aside><div class=cookie-notice>c</div><div id=content><p>Real</p></div>")) == "Real"


def test_a_page_in_one_form():
    body = "<form id=aspnetForm><div class=menu><a href=/>m</a></div><input><label>L</label>{}<button>Go</button></form>"
    assert ht.main_text(page(body.format("<article><p>Real text</p></article>"))) == "Real text"
    assert ht.main_text(page(body.format("<div><p>Real text of the page</p><p>More of it</p></div>"))) == "Real text of the page\n\nMore of it"
    small = "<form action=/s><p>Find something</p><div class=x>here</div></form>"
    assert ht.main_text(page(f"<div id=content><p>Real text that is longer than the form</p>{small}</div>")) == "Real text that is longer than the form"
    assert ht.main_text(page(f"<article><p>Real</p>{small}</article>")) != ""
    assert len(ht.Page(page(f"<div id=content><p>Real text that is longer than the form</p>{small}</div>")).nodes) == len(ht.Page(page("<div id=content><p>x</p></div>")).nodes)


def test_comments_adverts_and_notices_in_compound_classes():
    for left_out in (
        "<div class='user-comments'><p>me too</p></div>", "<ol class=commentlist><li>me too</li></ol>", "<div id=google_ads_1>buy</div>", "<ins class=adsbygoogle>buy</ins>",
        "<p class=notice>We use cookies.</p>", "<div class=articleComments>no</div>", "<div class='js-cookie-bar-v2'>c</div>", "<section id='post-comments'><p>no</p></section>",
    ):
        assert ht.main_text(page(f"<div id=content><p>Real</p>{left_out}<p>Text</p></div>")) == "Real\n\nText", left_out
    for kept in ("no-comments", "has-ads", "comments-closed", "ads-disabled", "commentary", "adequate", "loads", "with-notice", "roadside"):
        assert ht.main_text(page(f"<div class='{kept}'><p>Real</p></div>")) == "Real", kept
    assert ht.main_text(page("<article class='post comments-open has-comments'><p>Real</p></article>")) == "Real"


def nested(rng, n, names):
    """Mark-up of n elements at random depths, with classes that no other page has."""
    out, open_ = [], 0
    for k in range(n):
        out.append(f"<div class='{rng.choice(names)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'><p>t{k}</p>")
        open_ += 1
        while open_ and rng.random() < 0.55:
            out.append("</div>")
            open_ -= 1
    return "".join(out)


def test_a_wide_unlike_page_is_matched_in_bounded_time():
    rng = random.Random(9)
    first, second = (ht.Page(nested(rng, 4000, [a, a + "x"])) for a in ("q", "z"))
    wrapper = ht.Wrapper("\n".join(f"{i}\t{p}\t{s}" for i, (p, s) in first.nodes.items()))
    began = time.perf_counter()
    slots = wrapper.align(second)
    assert time.perf_counter() - began < 2 and set(slots) >= set(second.nodes)


def tree(shape, at=0, nodes=None):
    """Tree of nested (kind, children)."""
    nodes = {} if nodes is None else nodes
    for sig, below in shape:
        id_ = len(nodes) + 1
        nodes[id_] = (at, sig)
        tree(below, id_, nodes)
    return nodes


def plain_match(a, b):
    """Most nodes that two lists of (kind, children) can pair in order, by trying everything."""
    if not a or not b:
        return 0
    best = max(plain_match(a[1:], b), plain_match(a, b[1:]))
    return max(best, 1 + plain_match(a[0][1], b[0][1]) + plain_match(a[1:], b[1:])) if a[0][0] == b[0][0] else best


def test_tree_matching_against_brute_force():
    rng = random.Random(3)

    def shape(depth):
        return [(rng.choice("pqd"), shape(depth - 1)) for _ in range(rng.randint(0, 4 if depth == 3 else 2))] if depth else []

    for _ in range(200):
        a, b = shape(3), shape(3)
        assert ht.tree_match(ht.Tree(tree(a)), ht.Tree(tree(b)), 0, 0, {}) == plain_match(a, b)
    assert ht.by_tag(list("abab"), list("bbba")) == [(1, 0), (3, 1), (0, 3)]


def test_alignment():
    nodes = {1: (0, "div.head"), 2: (0, "div.story"), 3: (2, "h1"), 4: (2, "p"), 5: (0, "div.foot"), 6: (0, "ul.*")}
    wrapper = ht.Wrapper("\n".join(f"{i}\t{p}\t{s}" for i, (p, s) in nodes.items()))
    page = ht.Page("<div class=foot>f</div><div class=long><h1>t</h1><p>x</p><p>y</p></div><ul class=a><li>l</ul><ul class=b><li>m</ul><table class=n><td>n</table>")
    slots = wrapper.align(page)
    by = {page.nodes[i][1]: s for i, s in slots.items() if i}
    assert by["div.foot"] == 5 and by["div.long"] == 2  # by kind, whatever the order; by shape and place, whatever the kind
    assert (by["h1"], by["p"], by["ul.a"], by["ul.b"]) == (3, 4, 6, 6)
    assert by["li"] == ht.hashed("li", 6) and by["table.n"] == ht.hashed("table.n", 0) and by["td"] == ht.hashed("td", by["table.n"])
    assert ht.kind("post-12a3_x") == "post-#_x" and ht.kind("col-md-6") == "col-md-#" and ht.kind("main") == "main"


def test_what_mark_up_drops():
    text = ht.main_text
    assert text("<article><p>Text <button>Share</button> more</p></article>") == "Text more"
    assert text('<p>Buy <span class="advert">AD</span> now <select><option>1<option>2</select> or <label>x</label>then</p>') == "Buy now or then"
    assert text('<div class="content no-sidebar"><p>a</p></div><div class="post menu-open"><p>b</p></div>') == "a\n\nb"
    assert text('<article><h2 class="social">Social</h2><p class="reply">r</p></article><article class="related-study">S</article>') == "Social\n\nr\n\nS"
    assert text('<div class="left-sidebar"><p>x</p></div><div id="shareButtons">s</div><div class="ad-300x250">z</div><p>y</p>') == "y"
    story = "story " * 30
    assert text(f"<main><p>teaser</p></main><div><p>{story}</p></div>") == f"teaser\n\n{story.strip()}"
    assert text(f"<main><p>{story}</p></main><div><p>teaser</p></div>") == story.strip()


def test_broken_pages_take_linear_time():
    began = time.perf_counter()
    for h in (
        "<div>" * 5000, "<div><b>" * 20_000, "<a " * 350_000, '<a x="' * 200_000, '<a ">"' * 100_000, "<a b='c\">x" * 50_000, "<" * 10**6, "<a " + "a" * 10**6 + ">", "<p>" + "&" * 10**6,
        "<div>" * 5000 + "</b>" * 10**5 + "</p>" * 10**5, "<li><b>x" * 50_000, "<b>x" * 100_000, '<div class="' + "ab-" * 300_000 + '">', "<!--" * 300_000, "<script>" * 100_000, "<p><span>" * 50_000 + "<div>" * 1000,
    ):
        ht.main_text(h + "end")
        page = ht.Page(h[:100_000] + "end")
        ht.Wrapper("1\t0\tdiv\n2\t1\tp.x\n3\t1\tdiv.*").align(page)
    assert ht.main_text("<div>" * 5000 + "end") == "end"
    assert time.perf_counter() - began < 60


def test_induction_over_a_host(spark):
    def one(i):
        links = "".join(f"<a href=/{i}{k}>topic {i * 7 + k}</a> " for k in range(4))
        return page(f"<div class=x1>{links}</div><div class=x2><p>Subscribe to our fine paper today</p></div><div class=x3><p>Story {i} begins here.</p><p>Common middle.</p></div>", "")

    rows = [(i, f"http://h.example.com/{i}", one(i)) for i in range(30)] + [(99, "http://other.example.com/", one(5))]
    rows += [(100, "http://h.example.com/again", one(3))] * 2 + [(None, None, None), (101, "http://h.example.com/e", "")]
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, html string, host string, text string, slot string")
    got = ht.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[7] == "Story 7 begins here." and by[100] == "Story 3 begins here."  # what all pages share is template
    assert by[99] == "Subscribe to our fine paper today\n\nStory 5 begins here.\n\nCommon middle."  # one page has no template
    assert by[None] == by[101] == "" and {r.n_chars for r in got if r.page_id == 101} == {0}
    assert sorted(map(str, ht.extract(pages, 0).collect())) == sorted(map(str, got))  # wrappers too large to broadcast
    assert ht.extract(pages.limit(0)).collect() == []


def test_blocks_that_change_order_are_one_slot(spark):
    def one(i):
        box, story = "<div class=shop><p>Our paper has a shop.</p></div>", f"<div class=story><p>Story {i} begins here.</p></div>"
        return page(box + story if i % 2 else story + box, "")

    rows = [(i, f"http://h.example.com/{i}", one(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for dealt in (pages.coalesce(1), pages.repartition(3)):
        assert {r.page_id: r.text for r in ht.extract(dealt).collect()} == {i: f"Story {i} begins here." for i in range(40)}


def plain_texts(rows):
    """main_text() by wrappers that are counted in plain loops over all pages of a host."""
    out = {}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        pages = [ht.Page(h) for _, u, h in rows if u.split("/")[2] == host]
        count, places = Counter(), Counter()
        known = {}
        for p in pages:
            at = Counter()
            for i, (parent, sig) in p.nodes.items():
                known[i] = (parent, sig)
                count[i] += 1
                places[i] += at[parent]
                at[parent] += 1
        enough = max(2, ht.SUPPORT * len(pages))
        shared = {i for i in known if count[i] >= enough}
        odd = defaultdict(lambda: [0, 0])
        for i in known.keys() - shared:
            parent, sig = known[i]
            if parent == 0 or parent in shared:
                key = (parent, sig.split(".")[0] + ".*")
                odd[key] = [odd[key][0] + count[i], odd[key][1] + places[i]]
        nodes = [(places[i] / count[i], known[i][1], i, known[i][0]) for i in shared]
        nodes += [(pos / n, sig, 10**6 + k, parent) for k, ((parent, sig), (n, pos)) in enumerate(odd.items()) if n >= enough]
        w = ht.Wrapper("\n".join(f"{i}\t{parent}\t{sig}" for _, sig, i, parent in sorted(nodes)) if len(pages) > 1 else None)
        seen, chars, linked = {}, Counter(), Counter()
        for p in pages:
            slots = w.align(p)
            for n, t, l, _ in p.blocks:
                seen.setdefault((slots[n], t), set()).add(ht.identity(p))
            if ht.identity(p) not in {q for q, _ in out.get(host, [])}:
                out.setdefault(host, []).append((ht.identity(p), p))
                for n, t, l, _ in p.blocks:
                    chars[slots[n]] += len(t)
                    linked[slots[n]] += l
        different = len({ht.identity(p) for p in pages})
        if different >= ht.PAGES_LEAST:
            w.constants = {ht.hashed(t, slot) for (slot, t), who in seen.items() if len(who) >= max(ht.PAGES_LEAST, ht.CONSTANT * different)}
        w.menus = {s for s in chars if s in w.nodes and linked[s] >= ht.LINKED * chars[s]}
        out[host] = w
    return {i: ht.main_text(h, out[u.split("/")[2]] if out[u.split("/")[2]].nodes else None) for i, u, h in rows}


def random_pages(rng, n):
    def one(host, i):
        bits = [
            f"<div class='post-{i} entry'><h1>Title {i}</h1>" + "".join(f"<p>Paragraph {rng.randint(0, 10**6)} of it.</p>" for _ in range(rng.randint(1, 4))) + "</div>",
            "<div class=shop><p>Our paper has a shop.</p></div>", "<ul class=list>" + "".join(f"<li><a href=/{k}>topic {rng.randint(0, 99)}</a>" for k in range(3)) + "</ul>",
            f"<section class={''.join(rng.choice('abcdefgh') for _ in range(4))}><p>Printed on fine paper.</p></section>", f"<p>{host} {rng.choice('xyz')}</p>",
        ]
        kept = [b for k, b in enumerate(bits) if k in (0, 3) or rng.random() < 0.7]
        rng.shuffle(kept)
        return page("".join(kept), "")

    rows = [(i, f"http://h{h}.example.com/{i}", one(h, i)) for i in range(n) for h in [rng.choice([0, 0, 0, 1, 2, 3, 3])]]
    return rows + [(n + k, r[1], r[2]) for k, r in enumerate(rows[:5])]  # copies


def test_against_plain_counts_in_any_order(spark):
    rng = random.Random(1)
    rows = random_pages(rng, 120)
    want = plain_texts(rows)
    assert sum("Printed" in t for t in want.values()) < 20 and sum("Paragraph" in t for t in want.values()) == sum("Paragraph" in h for *_, h in rows)
    for dealt in (rows, rows[::-1], rng.sample(rows, len(rows))):
        pages = spark.createDataFrame(dealt, "page_id long, url string, html string").repartition(rng.randint(1, 5))
        assert {r.page_id: r.text for r in ht.extract(pages).collect()} == want
    assert {r.page_id: r.text for r in ht.extract(pages, 0).collect()} == want  # dealt by host
    found = ht.wrappers(pages.withColumn("host", ht.host_of(pages.url)))
    salted, shipped = ht.with_wrappers(pages.withColumn("host", ht.host_of(pages.url)), found, ["tree"], 0, 10)
    assert shipped is None
    assert salted.count() == len(rows) and salted.where("tree is null and host <> 'h2.example.com'").count() == 0


def test_odd_pages(spark):
    rows = [(1, "http://a/", "<div>" * 1500 + "deep"), (2, "http://a/", "<a " * 20_000), (3, None, "x"), (3, None, "x"), (None, "nothing", None), (4, "http://a/", "<p>x" * 3), (5, "http://a/", "word " * 200_000)]
    pages = spark.createDataFrame([(*r, "t", "t", 1, 1) for r in rows], "page_id long, url string, html string, tree string, host string, salt int, n_pages int")
    got = sorted(((r.page_id or 0, r.text[:20], r.n_chars) for r in ht.extract(pages).collect()))
    assert got == [(0, "", 0), (1, "deep", 4), (2, "", 0), (3, "x", 1), (3, "x", 1), (4, "x\n\nx\n\nx", 7), (5, "word word word word ", 999_999)]
