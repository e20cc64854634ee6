import random
import time

import pytest

from draftloom.llm import pages as P

SCHEMA = "page_id long, url string, html string"


def page(article, n=0, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style></head><body class='has-sidebar'><nav><ul><li><a href='/'>Home {n}</a></ul></nav>"
            f"<div class='ad'>Buy {n}</div>{extra}<article>{article}</article><footer>&copy; {n}</footer></body></html>")


def texts(spark, rows):
    out = P.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r.text for r in out}


def test_article_without_its_surroundings(spark):
    article = ("<h1>Title &amp; more</h1><p>First\n  line <b>bold <i>both</b></i><br>next&nbsp;x<p>Second &lt;p&gt; &#233;<ul><li>one<li>two</ul><script>var t='</p>';</script>"
               "<aside>side</aside><div class='comments'><p>me too</p></div><form><input value='x'>send</form><!-- no --><div id=cookie-notice>cookies</div><table><tr><td>a<td>b</table>")
    got = texts(spark, [(i, f"https://h.example/{i}", page(article, i)) for i in range(3)])
    assert set(got.values()) == {"Title & more\n\nFirst line bold both next x\n\nSecond <p> é\n\none\n\ntwo\n\na\n\nb"}


def test_content_without_article_element(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(60))
        rows.append((i, "http://h.example/x", f"<body><div id=top><p>Welcome to our site</p></div><div class=box><p>{i} {words}</p><p>Standard words under every text</p></div>"
                                              f"<ul class=menu><li><a>m{i}</a></ul></body>"))
    got = texts(spark, rows)
    assert all(t.startswith(f"{i} ") for i, t in got.items()) and not any("Welcome" in t or "m1" in t.split() for t in got.values())


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a/", None), (2, None, ""), (3, "no host", "plain text only"), (4, "http://a/", page("<p>x</p>")), (4, "http://a/", page("<p>x</p>")), (5, "http://a/", "<p>" + "y " * 200_000), (6, "http://b/", deep),
            (None, "http://b/", "<article>a < b & c > d <p>open"), (7, "http://c/", "<script>only</script"), (8, "http://c/", "</div></p><b>stray</i>")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", host string, text string")
    out = P.extract(df)
    assert out.columns == ["page_id", "url", "html", "host", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows) and got[1] == got[2] == got[7] == "" and got[3] == "plain text only" and got[4] == "x" and got[6] == "deep" and got[8] == "stray"
    assert got[5] == ("y " * 200_000).strip() and got[None] == "a < b & c > d\n\nopen"
    assert P.extract(df.limit(0)).count() == 0


def test_tree_match_is_maximal():
    def slot(label, *children):
        return P.Slot(label, 1, 0, 0, 0, list(children))

    def best(a, b):
        if not a or not b:
            return 0
        here = 1 + best(a[0].children, b[0].children) + best(a[1:], b[1:]) if a[0].label == b[0].label else 0
        return max(here, best(a[1:], b), best(a, b[1:]))

    rng = random.Random(4)

    def tree(depth):
        return [slot(rng.choice("abc"), *(tree(depth - 1) if depth else [])) for _ in range(rng.randint(0, 4))]

    for _ in range(60):
        a, b = tree(2), tree(2)
        pairs = P.tree_match(a, b)
        if [x.label for x in a] != [x.label for x in b]:
            assert P.matched(a, b) <= best(a, b)
        assert all(a[i].label == b[j].label for i, j in pairs) and pairs == sorted(pairs)
    assert P.matched([slot("a"), slot("b"), slot("c")], [slot("b"), slot("a"), slot("c")]) == 2


def plain_matched(a, b, memo):
    """Size of the largest matching by the plain recursion over pairs of nodes, each pair worked out once."""
    def node(x, y):
        if (id(x), id(y)) not in memo:
            memo[id(x), id(y)] = 1 + lists(x.children, y.children) if x.label == y.label else 0
        return memo[id(x), id(y)]

    def lists(p, q):
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(q):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + node(x, y))
        return best[-1][-1]

    return lists(a, b)


def test_tree_match_equals_the_plain_recursion_and_is_quick_on_deep_pages():
    rng = random.Random(5)

    def tree(depth):
        return [P.Slot(rng.choice("abc"), 1, rng.choice([0, 1, None]), 0, 0, tree(depth - 1) if depth else []) for _ in range(rng.randint(0, 4))]

    unlike = 0
    while unlike < 80:
        a, b = tree(3), tree(3)
        if not all_like(a, b):
            unlike += 1
            assert P.matched(a, b) <= plain_matched(a, b, {}) and P.matched(a, b) == sum(1 + P.matched(a[i].children, b[j].children) for i, j in P.tree_match(a, b))
            if no_equal_lists(a, b):
                assert P.matched(a, b) == plain_matched(a, b, {})

    def deep(side):
        node = P.Slot("p", 1, 0, 1, 0, [])
        for level in range(200):
            node = P.Slot("div", 1, None, 1, 0, [node, P.Slot(f"{side}{level % 3}", 1, 0, 1, 0, []), P.Slot("div", 1, 0, 1, 0, [])][:: 1 if side == "x" else -1])
        return node

    start = time.perf_counter()
    assert P.merge(deep("x"), deep("y")).label == "div" and time.perf_counter() - start < 1


def all_like(a, b):
    return [x.label for x in a] == [x.label for x in b]


def no_equal_lists(a, b):
    """No two lists of children that could be aligned have equal labels: equal lists are aligned one to one, which a larger matching may beat."""
    return not all_like(a, b) and all(no_equal_lists(x.children, y.children) or not x.children for x in a for y in b if x.label == y.label)


@pytest.mark.parametrize("opening, kept", [
    ('<p title="The hidden truth">', True), ('<p data-hidden="false">', True), ('<p data-id="comments" data-role="banner">', True), ("<p title='class=ad id=nav'>", True), ('<div class="legal-history">', True),
    ('<div class="side-effects">', True), ("<p id=search-party>", True), ("<p hidden>", False), ("<p aria-hidden=true>", False), ("<p aria-hidden='false'>", True), ('<div class="x ad">', False), ("<div class='comments-list'>", False),
    ("<div role=navigation>", False), ('<div CLASS="Cookie-Notice">', False), ("<div data-x=1 class=related>", False)])
def test_attributes_are_read_one_after_the_other(opening, kept):
    name = opening[1:].split(" ")[0]
    node = P.parse(f"<article>{opening}Keep me</{name}></article>").items[0].items[0]
    assert node.items == ["Keep me"] and node.outside != kept


@pytest.mark.parametrize("n", [2, 10, 25])
def test_headings_over_text_that_varies_stay(spark, n):
    rows = [(i, "http://h.example/x", f"<body><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>{i} eggs and {'salt ' * (i + 3)}</p><h2>Method</h2><p>Cook {i} times {'stir ' * (i + 3)}</p><h2>About us</h2><p>We cook.</p></article></body>")
            for i in range(n)]
    for i, text in texts(spark, rows).items():
        assert text.split("\n\n")[:2] == [f"Dish {i}", "Ingredients"] and "\n\nMethod\n\nCook" in text
        assert n < 10 or "About us" not in text


def test_wrapper_keeps_no_text_and_merges_in_any_order():
    made = [P.Wrapper(P.skeleton(P.parse(page(f"<p>text {i}</p>" * (i + 1), i))), {i}) for i in range(6)]
    one = made[0]
    for w in made[1:]:
        one = one.merge(w)
    left, right = made[0].merge(made[1]).merge(made[2]), made[3].merge(made[4]).merge(made[5])
    two = left.merge(right)
    assert one.dump() == two.dump() and "text 3" not in one.dump()
    assert P.Wrapper.load(one.dump()).dump() == one.dump()


def test_constant_slot_takes_no_text_of_its_siblings(spark):
    rows = [(i, "http://h.example/x", f"<body><article><p>Text {i}</p><ul><li>item {i}</ul><p>Thanks for reading</p></article></body>") for i in range(30)]
    assert texts(spark, rows) == {i: f"Text {i}\n\nitem {i}" for i in range(30)}


def test_copies_of_a_page_make_no_template(spark):
    rows = [(i, "http://h.example/x", f"<body><nav>{i}</nav><article><p>Text {i}</p></article></body>") for i in range(30)]
    rows += [(100 + i, "http://h.example/x", f"<body><nav>{i}</nav><article><p>Copied</p><blockquote>Only here</blockquote></article></body>") for i in range(40)]
    got = texts(spark, rows)
    assert all(got[i] == (f"Text {i}" if i < 100 else "Copied\n\nOnly here") for i in got)


def test_constant_text_goes_without_its_varying_descendants_and_ids_mark_as_a_whole(spark):
    rows = [(i, "http://h.example/x", f"<body><article><h2 id=search>Search {i}</h2><section>Standing words<p>Text {i}</p></section><div id=legal-history>Law {i}</div><div id=comments>c {i}</div></article></body>")
            for i in range(30)]
    assert texts(spark, rows) == {i: f"Search {i}\n\nText {i}\n\nLaw {i}" for i in range(30)}


def test_wrapper_chooses_the_region_though_teasers_are_articles(spark):
    rows = [(i, "http://h.example/x", f"<body class=page-{i}><div class=text><p>Text {i} {'long words ' * 30}</p><p>More {i} {'and more ' * 20}</p></div><div class=cards>"
                                      + "".join(f"<article><p>Teaser {i} {j} {'short ' * 5}</p></article>" for j in range(6)) + "</div></body>") for i in range(5)]
    assert all(t.startswith(f"Text {i} ") and f"More {i} " in t and "Teaser" not in t for i, t in texts(spark, rows).items())


def test_template_of_hosts_with_few_pages(spark):
    few = [(i, "http://few.example/x", f"<body><article><p>Text {i} {'abc' * (20 + i)}</p><div>Thanks for reading</div></article></body>") for i in range(3)]
    near = [(10 + i, "http://near.example/x", f"<body><article><h1>Copy</h1><p>Only number {i}</p><ul><li>{'same content ' * 20}</ul></article></body>") for i in range(2)]
    got = texts(spark, few + near)
    assert all(got[i].startswith(f"Text {i}") and "Thanks" not in got[i] for i in range(3)) and all("Copy" in got[10 + i] and "same content" in got[10 + i] for i in range(2))


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_all_given_pages(spark, scale):
    df = spark.read.parquet(f"/root/testdata/{scale}/pages.parquet")
    rows = P.extract(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        inside = r.html.split("<article>")[1].split("</article>")[0]
        assert r.text and len(r.text.split("\n\n")) == inside.count("<p>") + 1
        assert "&copy;" not in r.text and "track(" not in r.text
