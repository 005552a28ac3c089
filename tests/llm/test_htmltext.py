import pytest

from mapsmith.llm import htmltext

LONG = "Word text here. " * 30
CASES = {
    "": "",
    "no tags": "no tags",
    "<p>Just one para.</p>": "Just one para.",
    f'<body><div id="page"><header><h1>Site</h1></header><div class="sidebar"><ul><li><a href=x>one</a><li><a>two</a></ul></div><div class="content"><h2>Title</h2><p>{LONG}<p>Second <a href=q>link</a> para &amp; more.</p><ul><li>item one<li>item two</ul></div><div class="comments"><p>{"I like it. " * 30}</div><form><input><label>Mail</label></form></div><footer>c</footer>': f"Title\n{LONG.strip()}\nSecond link para & more.\nitem one\nitem two",
    f"<html><script>var t='</p>';</script><style>p{{}}</style><nav><a>x</a></nav><article><h1>H&eacute;</h1><p><b>{LONG}<br><p>more\n\t text</article><footer>&copy;": f"Hé\n{LONG.strip()}\nmore text",
    "<article><p>cut off &am": "cut off &am",
    "<p>a<!-- c --> b</p><": "a b\n<",
}


@pytest.mark.parametrize("page", CASES)
def test_extract(page):
    assert htmltext.extract(page) == CASES[page]


def test_null_and_deep():
    assert htmltext.extract(None) == ""
    assert htmltext.extract("<div>" * 5000 + "deep text" + "</div>" * 10) == "deep text"
    assert htmltext.extract("<" * 2000 + "x") is not None


def test_rows(spark):
    rows = [(1, "u", "<p>x y</p>", "k"), (1, "u", "<p>x y</p>", "k"), (None, None, None, None), (2, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract_pages(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, "x y"), (1, "x y"), (2, "")]
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("attributes", ['style="overflow:hidden" class="story"', 'title="The hidden cost"', 'data-class="sidebar"', "data-id=related title='a class=\"comments\" b'"])
def test_attributes_count_by_name(attributes):
    assert htmltext.extract(f"<body><div {attributes}><p>{LONG}</p></div>") == LONG.strip()
    assert htmltext.extract(f'<body><div><p>{LONG} <a href="/hidden/x" {attributes}>word</a></p></div>') == f"{LONG.strip()} word"


def test_class_words_do_not_drop_most_of_the_page():
    page = f'<body><div class="content has-sidebar" id="related-work"><p>{LONG}</p></div><div class="sidebar"><p>aside</p></div>'
    assert htmltext.extract(page) == LONG.strip()
    for hidden in ("hidden", 'aria-hidden="true"', 'role="navigation"'):
        assert htmltext.extract(f"<body><div {hidden}><p>{LONG}</p></div><p>rest</p>") == "rest"


def paragraphs(name, n=10):
    return [f"{name}{i} " + "word text here. " * 31 for i in range(n)]


def html_of(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


def lines_of(*parts):
    return "\n".join(t.strip() for p in parts for t in ([p] if isinstance(p, str) else p))


@pytest.mark.parametrize("around", ["article", "div", "main"])
def test_an_article_in_sections_is_whole(around):
    a, b = paragraphs("a"), paragraphs("b")
    page = f"<body><nav><a>x</a></nav><{around}><h1>Title</h1><section>{html_of(a)}</section><section>{html_of(b)}</section></{around}><footer>c</footer>"
    assert htmltext.extract(page) == lines_of("Title", a, b)


def test_a_heading_outside_the_body_div():
    a = paragraphs("a", 5)
    assert htmltext.extract(f"<body><article><h1>Title</h1><div class=body>{html_of(a)}</div></article>") == lines_of("Title", a)
    assert htmltext.extract(f"<body><div><h1>Title</h1><div class=body>{html_of(a)}</div></div><div><a>more</a></div>") == lines_of("Title", a)


@pytest.mark.parametrize("rows", [30, 200])
def test_long_lists_and_tables(rows):
    a, items = paragraphs("a", 4), [f"item number {i} with some words of its own" for i in range(rows)]
    page = "<body><article><h1>Title</h1>{}<{}>{}</{}></article><div><ul><li><a href=x>one link of many</a><li><a href=y>another link</a></ul></div>"
    assert htmltext.extract(page.format(html_of(a), "ul", html_of(items, "li"), "ul")) == lines_of("Title", a, items)
    table = "".join(f"<tr><td>{t}</td></tr>" for t in items)
    assert htmltext.extract(page.format(html_of(a), "table", table, "table")) == lines_of("Title", a, items)


def counted(node, link=False):
    """(characters, tags, link characters, link tags) below a node, the plain way."""
    link = link or node.tag == "a"
    out = [0, 0, 0, 0]
    for p in node.parts:
        if isinstance(p, str):
            n = len("".join(p.split()))
            out[0] += n
            out[2] += n * link
        elif not p.skip:
            below = counted(p, link)
            out = [a + b for a, b in zip(out, below, strict=True)]
            out[1] += p.tag not in htmltext.WITHIN
            out[3] += p.tag == "a"
    return out


def test_density_of_every_node_by_recursion():
    import math
    import random

    rng = random.Random(4)

    def tree(depth):
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.7 else "word " * rng.randrange(9) for _ in range(rng.randrange(4)))
        tag = rng.choice(["div", "p", "ul", "li", "a", "section", "span"])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        root = htmltext.parse("<body>" + tree(4) + tree(3) + "</body>")
        nodes = htmltext.score(root)
        whole = counted(root)
        for node, _, _ in nodes:
            # whether a node is itself in a link is told by its own count
            c, t, lc, lt = node.chars, node.tags, node.link_chars, node.link_tags
            plain = counted(node, any(id(node) == id(n) and link for n, _, link in nodes))
            assert [c, t, lc, lt] == plain
            if c:
                ratio = whole[2] / max(1, whole[0])
                base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
                want = c / max(1, t) * math.log(max(1 + 1e-9, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(max(base, math.e))
                assert node.density == pytest.approx(want)
        for node, _, _ in nodes:
            def children(n):
                for p in n.parts:
                    if not isinstance(p, str) and not p.skip:
                        yield from children(p) if p.tag in htmltext.WITHIN else [p]

            total = sum(p.density for p in children(node))
            assert node.total == pytest.approx(total or node.density)


def test_long_pages_and_clashing_names(spark):
    paragraph = "<p>" + "some words of an article, " * 20 + "</p>"
    long = "<nav><a href='/'>home</a></nav><article>" + paragraph * 4000 + "</article><footer>foot</footer>"
    deep = "<div>" * 5000 + paragraph + "</div>" * 5000
    rows = [(1, "u", long, "x", 1), (2, "u", deep, "x", 1), (2, "u", deep, "x", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in htmltext.extract_pages(df).collect())
    one = len("some words of an article, " * 20) - 1
    assert got == [(0, 0), (1, 4000 * one + 3999), (2, one), (2, one)]
    assert htmltext.extract_pages(df.limit(0)).count() == 0
