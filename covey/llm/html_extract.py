"""HTML extraction with a tree-structured graphical model over the DOM.

Each layout element is a node that is main text or not.  Features of the element (name, words of its class, id and
role, whether it is in, beside or around an article, shares of link text of its own, below it and around it, length,
ends of sentences, the part of the page's plain text below it) score the node, and potentials join it with its parent by
the kind of the child.  Sum-product messages, upward then downward, give every node's exact marginal; the text of nodes with a
marginal of at least 0.5 is the page's text.  The weights are trained by exact likelihood on labelled pages, which
``labelled_pages`` lays out from a list of page designs with known content: with and without elements or names that
help, with link lists and links alone in a paragraph as content and as menus, short and long.

Blocks: text between borders of block elements is a block; character references are decoded, white space becomes one
space, blocks are joined by an empty line.  Scripts, styles, markup and comments never are text.

Scale: pages are read in place, batch by batch; messages of all pages of a batch run level by level in arrays.  The
model is a few kilobytes.  Edge cases: a null, empty or textless page gives the empty text; broken markup is closed
like browsers do; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from covey.llm.dom import Tree, block_texts, parse
from covey.llm.treemodel import Forest, TreeModel

# fixed values: words that designers use in class, id and role attributes, by what they mark
CUES = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc tabs pagination pager skip sitemap",
    "head": "header masthead banner topbar branding logo hero",
    "foot": "footer copyright legal colophon contentinfo bottom",
    "side": "sidebar aside widget rail complementary related recommended recommendations trending popular more teaser",
    "advert": "ad ads advert advertisement advertisements adsense banner promo promotion sponsor sponsored sponsors dfp gpt outbrain taboola affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall disclaimer warning toast",
    "reply": "comment comments reply replies respond disqus discussion feedback reactions commentlist",
    "form": "form login signin signup search register poll survey contact",
    "share": "share sharing social follow tags meta byline author avatar toolbar print rating",
    "text": "content article post entry main body story text prose page articlebody maincontent",
}
_CUE = {w: k for k, names in enumerate(CUES.values()) for w in names.split()}
_TAGS = "#page html head body main article section div nav header footer aside form fieldset button select option p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote pre figure figcaption address details summary menu dialog a span label".split()
_TAG = {t: i for i, t in enumerate(_TAGS)}
_LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th blockquote pre dd dt figcaption".split())
_HOLDERS = frozenset("ul ol dl table thead tbody tr figure".split())
_JUNK = frozenset("nav header footer aside form fieldset button select dialog menu address".split())
KINDS = 6
# groups of features, by their number of values
_GROUPS = {
    "tag": len(_TAGS) + 1, "cue": len(CUES), "hidden": 1, "above": len(CUES) + 1,  # above: the parent's cues
    "place": 4,  # no article or main on the page; in one; beside one; around one
    "links": 5 * 4,  # share of link text of all text below, by place
    "around": 5 * 4,  # the same of the parent
    "own_links": 3, "own": 4, "ends": 2, "many_ends": 2,  # own text: links in it, length, ends of sentences
    "part": 5,  # share of the page's plain text that stands below
    "below": 4,  # ends of sentences below
    "told": 3 * 3,  # children of the parent that hold sentences outside links, for parts of lists and tables, boxes and others
    "title": 1, "top": 2,  # a level one heading below; a child of body or page, with much plain text or not
}
_AT: dict[str, int] = {}
FEATURES = 1  # feature 0 is always on
for _name, _values in _GROUPS.items():
    _AT[_name], FEATURES = FEATURES, FEATURES + _values
_END = re.compile(r"[.!?\u2026](?:[\"'\u201d\u00bb)\]]*)(?=\s|$)|[\u3002\uff01\uff1f\u0964\u061f]")


def _kind(tag: str, cue: frozenset, hidden: bool) -> int:
    if cue or hidden:
        return 0
    return 1 if tag in _JUNK else 2 if tag in _LEAVES else 3 if tag in _HOLDERS else 4 if tag in ("article", "main") else 5


def _step(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def features(trees: list[Tree]) -> Forest:
    """Nodes of all trees with the features that are on."""
    parent, kind, node, feature = [], [], [], []
    at = _AT
    for tree in trees:
        base, n, up = len(parent), len(tree.tag), tree.parent
        size, linked, ends = [0] * n, [0] * n, [0] * n
        for _, e, text, link in tree.pieces:
            k = len(text.strip())
            if k:
                size[e] += k
                if link:
                    linked[e] += k
                else:
                    ends[e] += len(_END.findall(text))
        all_size, all_link, all_ends, title, told = size[:], linked[:], ends[:], [t == "h1" for t in tree.tag], [0] * n
        cues = [frozenset(_CUE[w] for w in words if w in _CUE) for words in tree.words]
        home = [tree.tag[e] in ("article", "main") and not cues[e] - {_CUE["text"]} for e in range(n)]
        holds = home[:]
        for e in range(n - 1, 0, -1):
            u = up[e]
            all_size[u] += all_size[e]
            all_link[u] += all_link[e]
            all_ends[u] += all_ends[e]
            title[u] |= title[e]
            holds[u] |= holds[e]
            told[u] += all_ends[e] > 0
        page_plain = max(1, all_size[0] - all_link[0])
        share = [0 if not all_size[e] else 1 + _step(all_link[e] / all_size[e], 0.1, 0.4, 0.8) for e in range(n)]
        place = [0] * n
        for e in range(n):
            u, cue = up[e], cues[e]
            inside = home[e] or (e > 0 and place[u] == 1)
            place[e] = 0 if not holds[0] else 1 if inside else 3 if holds[e] else 2
            on = [0, at["tag"] + _TAG.get(tree.tag[e], len(_TAGS)), at["place"] + place[e], at["links"] + 5 * place[e] + share[e]]
            on += [at["cue"] + c for c in cue]
            if tree.hidden[e]:
                on.append(at["hidden"])
            on += [at["above"] + c for c in (cues[u] if e else ())] or [at["above"] + len(CUES)]
            on.append(at["around"] + 5 * place[e] + (share[u] if e else 0))
            on.append(at["own_links"] + (0 if not size[e] else 1 if linked[e] < 0.5 * size[e] else 2))
            on.append(at["own"] + (0 if not size[e] else 1 + _step(size[e], 40, 160)))
            on.append(at["ends"] + (ends[e] > 0))
            on.append(at["many_ends"] + (ends[e] > 2))
            on.append(at["part"] + _step((all_size[e] - all_link[e]) / page_plain, 0.02, 0.15, 0.5, 0.8))
            on.append(at["below"] + _step(all_ends[e], 1, 3, 8))
            sort = 0 if tree.tag[e] in ("li", "dt", "dd", "tr") else 1 if tree.tag[e] in ("td", "th", "div", "section", "ul", "ol") else 2
            on.append(at["told"] + 3 * sort + (_step(told[u], 1, 2) if e else 0))
            if title[e]:
                on.append(at["title"])
            if e and tree.tag[u] in ("body", "html", "#page"):
                on.append(at["top"] + (2 * (all_size[e] - all_link[e]) > all_size[e]))
            parent.append(base + u if e else -1)
            kind.append(_kind(tree.tag[e], cue, tree.hidden[e]))
            node += [base + e] * len(on)
            feature += on
    as_int = lambda x: np.array(x, np.int64)
    return Forest(as_int(parent), as_int(kind), as_int(node), as_int(feature))


# --- labelled pages -----------------------------------------------------------------------------------------------


class _Page:
    """Builds markup and, in step, whether the text of each element is content."""

    def __init__(self, rng: random.Random):
        self.rng, self.out = rng, []
        self.word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 16).capitalize() + "." for _ in range(self.rng.randint(a, b)))

    def tag(self, name: str, inner, label: int, attributes: str = "", close: bool = True) -> None:
        self.out.append(f'<{name}{attributes and " " + attributes} data-y="{label}">')
        if callable(inner):
            inner()
        else:
            self.out.append(inner)
        if close:
            self.out.append(f"</{name}>")


def _cue_name(rng: random.Random, group: str) -> str:
    name = rng.choice(CUES[group].split())
    return f'{rng.choice(["class", "class", "id"])}="{rng.choice([name, name, name + "-box", "site-" + name])}"'


def labelled_pages(number: int = 500, seed: int = 3) -> list[tuple[str, None]]:
    """Pages of many designs in which data-y on an element says whether its own text is content."""
    rng = random.Random(seed)
    pages = []
    for _ in range(number):
        p = _Page(rng)
        some = lambda q: rng.random() < q

        def menu(label=0, name=None):
            name = name or rng.choice(["nav", "div", "ul"])
            inner = lambda: [p.tag("li", f'<a href="/{p.word()}">{p.words(1, 3)}</a>', 0) for _ in range(rng.randint(2, 9))]
            attributes = "" if name == "nav" and some(0.6) else _cue_name(rng, "menu")
            p.tag(name, inner if name == "ul" else lambda: p.tag("ul", inner, 0), 0, attributes)

        def junk():
            what = rng.choice(["advert", "notice", "side", "share", "form", "reply", "aside", "form_tag", "hidden", "footer_in"])
            if what == "aside":
                p.tag("aside", lambda: [p.tag("p", p.sentences(1, 3), 0) for _ in range(rng.randint(1, 3))], 0)
            elif what == "form_tag":
                p.tag("form", lambda: (p.tag("label", p.words(1, 4), 0), p.tag("button", p.words(1, 2), 0)), 0)
            elif what == "hidden":
                p.tag("div", p.sentences(1, 4), 0, rng.choice(['style="display:none"', "hidden", 'aria-hidden="true"']))
            elif what == "footer_in":
                p.tag("footer", p.words(2, 8), 0)
            elif what == "reply":
                def replies():
                    if some(0.6):
                        p.tag(rng.choice(["h2", "h3"]), p.words(1, 3), 0)
                    for _ in range(rng.randint(1, 4)):
                        p.tag(rng.choice(["div", "li", "article"]), lambda: p.tag("p", p.sentences(1, 5), 0), 0, _cue_name(rng, "reply"))
                p.tag(rng.choice(["div", "section", "ol"]), replies, 0, _cue_name(rng, "reply"))
            else:
                kind = rng.choice(["text", "ps", "links"])
                inner = p.sentences(1, 3) if kind == "text" else (lambda: [p.tag("p", p.sentences(1, 3), 0) for _ in range(rng.randint(1, 3))]) if kind == "ps" else (lambda: p.tag("ul", lambda: [p.tag("li", f'<a href="#">{p.words(1, 6)}</a>', 0) for _ in range(rng.randint(2, 5))], 0))
                p.tag(rng.choice(["div", "div", "section"]), inner, 0, _cue_name(rng, what))

        def link(a=1, b=4):
            return f'<a href="/{p.word()}">{p.words(a, b)}</a>'

        def links_in_text():
            """What an author links to: a list, a paragraph that is a link, a line of links."""
            what = rng.random()
            if what < 0.45:
                if some(0.3):
                    p.tag(rng.choice(["h2", "h3", "p"]), p.words(1, 5) + ":", 1)
                p.tag(rng.choice(["ul", "ol"]), lambda: [p.tag("li", link(1, 6) + (f" {p.words(1, 6)}" if some(0.25) else ""), 1) for _ in range(rng.randint(1, 6))], 1)
            elif what < 0.75:
                p.tag("p", link(1, 9) + ("." if some(0.3) else ""), 1)
            else:
                p.tag("p", f"{p.words(1, 5)} {link(2, 8)}, {link(1, 6)} {p.words(1, 3)}.", 1)

        def body_text(most=12):
            for k in range(rng.randint(1, most)):
                what = rng.random()
                if k and what < 0.1:
                    links_in_text()
                elif what < 0.7:
                    text = p.sentences(1, 6) if some(0.85) else p.words(1, 4) + "."
                    if some(0.2):
                        text = f"<b>{p.words(1, 4)}</b> {text} <a href='#'>{p.words(1, 2)}</a>"
                    p.tag("p", text + ("<br>" if some(0.1) else ""), 1, close=some(0.85))
                elif what < 0.78:
                    p.tag(rng.choice(["h2", "h3"]), p.words(1, 6), 1)
                elif what < 0.86:
                    p.tag(rng.choice(["ul", "ol"]), lambda: [p.tag("li", p.sentences(1, 1) if some(0.6) else p.words(1, 5), 1) for _ in range(rng.randint(2, 5))], 1)
                elif what < 0.9:
                    p.tag("blockquote", lambda: p.tag("p", p.sentences(1, 2), 1), 1)
                elif what < 0.93:
                    p.tag("table", lambda: [p.tag("tr", lambda: [p.tag("td", p.words(1, 3), 1) for _ in range(3)], 1) for _ in range(rng.randint(1, 3))], 1)
                elif what < 0.95:
                    p.tag("pre", p.words(3, 20), 1)
                elif what < 0.97:
                    p.tag("figure", lambda: p.tag("figcaption", p.words(2, 9), 1), 1)
                elif some(0.6):
                    junk()

        def sections():
            for _ in range(rng.randint(1, 5)):
                def part():
                    if some(0.85):
                        p.tag(rng.choice(["h2", "h2", "h3"]), p.words(1, 7), 1)
                    body_text(4)
                p.tag(rng.choice(["section", "section", "div"]), part, 1, some(0.2) * f'class="{p.word()}{rng.randint(1, 99)}"')

        def short():
            if some(0.6):
                p.tag("h1", p.words(1, 6), 1)
            if some(0.85):
                p.tag("p", p.sentences(1, 2) if some(0.7) else p.words(2, 8) + ".", 1)
                for _ in range(rng.randint(0, 2)):
                    links_in_text()
            else:  # a page that is a list of links
                p.tag(rng.choice(["h1", "h2"]), p.words(1, 4), 1)
                p.tag(rng.choice(["ul", "ol"]), lambda: [p.tag("li", link(1, 6), 1) for _ in range(rng.randint(2, 8))], 1)

        def article():
            if some(0.12):  # a header of the article's own: its title is text, what stands beside it isn't
                p.tag("header", lambda: (p.tag(rng.choice(["h1", "h1", "h2"]), p.words(1, 9), 1), p.tag(rng.choice(["div", "p", "span"]), p.words(1, 5), 0, _cue_name(rng, "share")) if some(0.5) else None), 1, _cue_name(rng, "head") if some(0.4) else "")
            elif some(0.8):
                p.tag("h1", p.words(1, 9), 1)
            what = rng.random()
            if what < 0.04:  # a list of links, long at times
                name, many = rng.choice(["p", "p", "li"]), rng.choice([5, 12, 40])
                every = lambda: [p.tag(name, link(1, 6), 1) for _ in range(rng.randint(2, many))]
                return p.tag(rng.choice(["ul", "ol"]), every, 1) if name == "li" else every()
            if what < 0.12:
                return sections()
            if what < 0.2:
                return short()
            if some(0.15):
                p.tag("div", p.words(2, 5), 0, _cue_name(rng, "share"))
            if some(0.2):
                p.tag("div", body_text, 1, _cue_name(rng, "text"))
            else:
                body_text()
            if some(0.25):
                junk()

        def columns():
            """A table, or boxes without names, of a column of links and one of text."""
            table = some(0.6)
            cell = "td" if table else "div"
            listed = lambda: (p.tag(rng.choice(["h3", "h4", "p"]), p.words(1, 2), 0), p.tag("ul", lambda: [p.tag("li", link(1, 3), 0) for _ in range(rng.randint(2, 8))], 0))
            side = lambda: p.tag(cell, listed, 0) if some(0.4) else p.tag(cell, lambda: [p.tag(rng.choice(["p", "p", "div", "li"]), link(1, 3), 0) for _ in range(rng.randint(2, 8))], 0)
            both = lambda: (side() if some(0.8) else None, p.tag(cell, article, 1), side() if some(0.3) else None)
            p.tag("table", lambda: p.tag("tr", both, 1), 1) if table else p.tag("div", both, 1)

        direct = some(0.2)  # the text stands in the body itself

        def page():
            if some(0.3):
                junk()
            if some(0.45):
                p.tag("header", lambda: (p.tag(rng.choice(["div", "h2", "p"]), p.words(1, 4), 0), menu() if some(0.6) else None), 0, _cue_name(rng, "head") if some(0.4) else "")
            elif some(0.3):
                p.tag("div", p.words(1, 5), 0, _cue_name(rng, "head"))
            if some(0.7):
                menu()
            elif some(0.4):  # a menu without a name
                p.tag(rng.choice(["ul", "div", "p"]), " | ".join(link(1, 2) for _ in range(rng.randint(3, 8))) if some(0.4) else lambda: [p.tag("li", link(1, 2), 0) for _ in range(rng.randint(3, 8))], 0)
            for _ in range(rng.randint(0, 2)):
                junk()
            how = rng.random()
            if some(0.08):
                columns()
            elif direct:
                sections() if some(0.3) else article()
            elif some(0.2):  # a site without any name that helps
                what = rng.random()
                name = some(0.3) * f'class="{p.word()}"'
                if what < 0.3:
                    p.tag("div", sections, 1, name)
                elif what < 0.55:
                    p.tag("div", short if some(0.5) else body_text, 1, name)
                elif what < 0.75:
                    p.tag("main", short, 1, name)
                else:
                    p.tag("div", lambda: p.tag("div", lambda: p.tag("div", article, 1, name), 1), 1)
            elif how < 0.55:
                p.tag("article", article, 1, _cue_name(rng, "text") if some(0.3) else "")
            elif how < 0.7:
                p.tag("main", article if some(0.5) else lambda: p.tag("article", article, 1), 1)
            else:
                p.tag("div", lambda: p.tag("div", article, 1, _cue_name(rng, "text")), rng.choice([0, 1]), _cue_name(rng, "text") if some(0.5) else "")
            for _ in range(rng.randint(0, 3)):
                junk()
            if some(0.8):
                inner = f"&copy; {p.words(1, 3)} &middot; {p.sentences(1, 3) if some(0.6) else p.words(1, 6)}"
                p.tag("footer", inner if some(0.6) else lambda: p.tag("p", inner, 0), 0) if some(0.7) else p.tag("div", inner, 0, _cue_name(rng, "foot"))

        def bare():
            """Nothing but text: no article, no menu."""
            if some(0.5):
                p.out.append(p.sentences(1, 3))
            if some(0.3):
                p.tag("h1", p.words(1, 6), 1)
            for _ in range(rng.randint(1, 3)):
                p.tag("p", p.sentences(1, 3) if some(0.7) else p.words(1, 5) + ".", 1)

        what = rng.random()
        if what < 0.06:
            p.tag(rng.choice(["div", "section", "article", "main"]), short, 1)
        elif what < 0.16:
            p.tag("html", lambda: p.tag("body", bare, 1), 1) if some(0.5) else bare()
        else:
            p.tag("html", lambda: p.tag("body", page, int(direct)), int(direct))
        pages.append("<!DOCTYPE html>" + "".join(p.out))
    return pages


def _labels(page: str) -> tuple[Tree, np.ndarray]:
    """The page's tree and its elements' labels; elements that the reader skips carry their label with them."""
    plain = re.sub(r' data-y="([01])"', "", page)
    tree = parse(plain)
    marked = parse(re.sub(r' data-y="([01])"', r' aria-label="labelled\1"', page).replace("labelled0", "isjunk").replace("labelled1", "istext"))
    keep = [e for e in range(len(marked.tag))]
    if len(tree.tag) != len(marked.tag):  # inline elements become nodes once they carry a mark
        keep = [e for e in keep if marked.tag[e] not in ("label", "a", "span", "b") or (marked.words[e] - {"istext", "isjunk"}) or marked.hidden[e]]
    marks = [int("istext" in marked.words[e]) for e in keep]
    marks[0] = int(any(y for e, y in enumerate(marks) if tree.parent[e] == 0))  # the page is text where its children are
    return tree, np.array(marks, np.int64)


@cache
def trained(number: int = 500, seed: int = 3) -> TreeModel:
    pairs = [_labels(page) for page in labelled_pages(number, seed)]
    return TreeModel(FEATURES, KINDS).fit(features([t for t, _ in pairs]), np.concatenate([y for _, y in pairs]))


def main_texts(pages: list[str], model: TreeModel) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    marginal = model.messages(features(trees))[0] >= 0.5
    out, at = [], 0
    for tree in trees:
        out.append("\n\n".join(block_texts(tree, marginal[at : at + len(tree.tag)])))
        at += len(tree.tag)
    return out


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, StructType([rows.schema["page_id"], rows.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())]))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
