"""Main text of HTML pages by composite text density.

A tolerant scanner builds the tree of elements. Each node's density is its characters per tag, adjusted for links
(a node of mostly link text scores low); the densities of a node's children are summed. The threshold is the least
density on the path from the node with the largest sum up to body. From body on, through nodes whose density
reaches it, the subtree with the largest sum within each is chosen; the article is what lies between all of these
under the element that holds them, with its heading, but for unchosen boxes and lists of links. Elements that never hold article text (navigation, footers, forms, scripts and the like, or
marked so by class, id or role) are left out of both the scores and the text.

Results in special cases: null, empty or tag-only html gives an empty text; unclosed and unbalanced tags, truncated
markup and text outside any element are borne; rows that repeat an id are extracted each for itself; a null id is
carried; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
#: Elements that never hold article text.
SKIP = frozenset("head script style noscript template iframe nav footer aside form button select option textarea input label dialog menu svg canvas object video audio title header".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
SKIP_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|footer|header|masthead|side-?bar|aside|cookie\w*|consent|notice|gdpr|newsletter|subscri\w*|popup|modal|overlay|comments?|comment-?list|disqus\w*|respond|repl(?:y|ies)|related|recommend\w*|share|sharing|social|widget|pagination|pager|login|signup|search|toolbar|skip-?link)(?=$|[\s_-])", re.I)
#: An element of one of these names with a SKIP_NAME class is the article all the same.
KEEP = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address center details summary fieldset hr br header footer nav aside form".split())
#: A start tag of the first closes an open element of the others, up to a boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table select body article section div".split())
ENDS_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre div article section aside header footer nav form main hr figure address fieldset".split())
INLINE = frozenset("b i em strong span a u s small big font code sub sup mark q cite abbr label".split())

HEADINGS = frozenset("h1 h2 h3".split())
#: Beside the chosen subtrees, one of these is left out if it is mostly links; one that is not FLOW only belongs to
#: them within an article.
FLOW = frozenset("ul ol dl table blockquote pre figure".split())
BOXES = FLOW | frozenset("div section".split())

#: Elements that are part of their block: neither counted as tags nor candidates.
WITHIN = INLINE | {"br", "wbr"}


class Node:
    __slots__ = ("tag", "parts", "skip", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, skip: bool, named: bool = False):
        self.tag, self.parts, self.skip, self.named = tag, [], skip, named
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def skipped(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether for words of its class or id alone."""
    if tag in SKIP:
        return True, False
    if not attributes or tag in KEEP and tag not in ("p",):
        return False, False
    named = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value in SKIP_ROLE:
                return True, False
        elif name in ("hidden", "aria-hidden"):
            if value != "false":
                return True, False
        elif name in ("class", "id") and SKIP_NAME.search(value):
            named = True
    return named, named


def unskip(root: Node) -> None:
    """An element that is left out for its class or id, but holds most of the page's unlinked text, stays."""
    nodes, todo = [], [(root, None, False)]
    while todo:
        node, parent, link = todo.pop()
        link = link or node.tag == "a"
        nodes.append((node, parent, link))
        todo += [(p, node, link) for p in node.parts if isinstance(p, Node) and (p.named or not p.skip)]
    if not any(n.named for n, _, _ in nodes):
        return
    plain = dict.fromkeys((id(n) for n, _, _ in nodes), 0)
    for node, parent, link in reversed(nodes):
        if not link:
            plain[id(node)] += sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        if parent:
            plain[id(parent)] += plain[id(node)]
    for node, _, _ in nodes:
        if node.named and 2 * plain[id(node)] > plain[id(root)]:
            node.skip = False


def parse(page: str) -> Node:
    root = Node("html", False)
    stack, at, n = [root], 0, len(page)
    for m in iter_tokens(page):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if end := m[1]:
            end = end.lower()
            if end in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == end:
                    del stack[k:]
                    break
                if end in INLINE and stack[k].tag in ENDS_P:  # a stray inline end tag closes no block
                    break
        elif start := m[2]:
            tag = start.lower()
            if tag in ("html", "body"):
                continue
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag not in INLINE:
                        break
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSES[tag]:
                        del stack[k:]
                        if tag != "tr":
                            break
                    elif stack[k].tag in BOUNDARY:
                        break
            node = Node(tag, *skipped(tag, m[3]))
            stack[-1].parts.append(node)
            if tag not in VOID and not m[0].endswith("/>"):
                stack.append(node)
            if tag in RAW and len(stack) > 1 and stack[-1] is node:
                stack.pop()
    if at < n:
        stack[-1].parts.append(page[at:])
    unskip(root)
    return root


def iter_tokens(page: str) -> Iterator:
    """Tokens in turn; after a start tag whose content is raw, on from its end tag."""
    at = 0
    while m := TOKEN.search(page, at):
        yield m
        at = m.end()
        if m[2] and (raw := RAW.get(m[2].lower())):
            close = raw.search(page, at)
            end = close.end() if close else len(page)
            if end > at:
                yield _Gap(at, end)
            at = end


class _Gap:
    """Stands for a stretch of raw text that is passed over."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def start(self) -> int:
        return self.a

    def end(self) -> int:
        return self.b

    def __getitem__(self, k: int) -> None:
        return None


def preorder(root: Node) -> list[tuple[Node, Node | None, bool]]:
    """(node, parent, within a link), without what is skipped."""
    out, todo = [], [(root, None, False)]
    while todo:
        node, parent, link = todo.pop()
        link = link or node.tag == "a"
        out.append((node, parent, link))
        todo += [(p, node, link) for p in reversed(node.parts) if isinstance(p, Node) and not p.skip]
    return out


def score(root: Node) -> list[tuple[Node, Node | None, bool]]:
    """Fills in the counts from the leaves up, then density and total of each node."""
    nodes = preorder(root)
    for node, parent, link in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars += own
        if link:
            node.link_chars += own
        if parent:
            parent.chars += node.chars
            parent.tags += node.tags + (node.tag not in WITHIN)
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags + (node.tag == "a")
    ratio = root.link_chars / max(1, root.chars)
    for node, _, _ in nodes:
        node.density = 0.0 if node.tag in WITHIN else density(node, ratio)
    for node, parent, _ in reversed(nodes):
        if parent:
            parent.total += node.total if node.tag in WITHIN else node.density
    for node, _, _ in nodes:
        if node.tag not in WITHIN:
            node.total = node.total or node.density
    return [x for x in nodes if x[0].tag not in WITHIN]


def density(node: Node, body_ratio: float) -> float:
    c, t = node.chars, max(1, node.tags)
    if not c:
        return 0.0
    lc, lt = max(1, node.link_chars), max(1, node.link_tags)
    plain = max(1, c - node.link_chars)
    base = math.log(c / plain * node.link_chars + body_ratio * c + math.e)
    return c / t * math.log(max(1.0 + 1e-9, c / lc * t / lt)) / math.log(max(base, math.e))


def chosen(root: Node, nodes: list) -> tuple[dict[int, Node], dict[int, Node | None]]:
    """The subtrees with the largest density sum within each node that the body-path threshold lets through, and
    each node's parent."""
    every = preorder(root)
    parents = {id(n): p for n, p, _ in every}
    within = {id(n): n for n, _, _ in every}  # node -> the subtree of the largest sum in it
    for node, parent, _ in reversed(every):
        if parent:
            mine, there = within[id(node)], within[id(parent)]
            if mine.tag not in WITHIN and (there.tag in WITHIN or mine.total > there.total or mine.total == there.total and there is not parent):
                within[id(parent)] = mine
    best = max((n for n, _, _ in nodes), key=lambda n: n.total)
    least, up = best.density, best
    while up := parents[id(up)]:
        if up.tag not in WITHIN:
            least = min(least, up.density)
    found, through = {id(best): best}, {id(root)}
    for node, parent, _ in every:
        if parent and id(parent) not in through or node.tag not in WITHIN and node.density < least:
            continue
        through.add(id(node))
        top = within[id(node)]
        if top.tag not in WITHIN and 2 * top.link_chars <= top.chars:
            found[id(top)] = top
    return found, parents


def path_up(node: Node, parents: dict[int, Node | None]) -> list[Node]:
    out = [node]
    while up := parents[id(out[-1])]:
        out.append(up)
    return out


def main_node(root: Node) -> Node:
    """The element that holds all chosen subtrees; what it leaves out is marked to be skipped."""
    nodes = score(root)
    if not root.chars:
        return root
    found, parents = chosen(root, nodes)
    top, path = None, set()
    for node in found.values():
        if id(node) in path:
            continue
        way = path_up(node, parents)
        if top is None:
            top = way
        else:
            own = {id(n) for n in way}
            top = top[next(k for k, n in enumerate(top) if id(n) in own) :]
        path |= {id(n) for n in way}
    # up to the article around it, or to the element that has its heading
    k = next((k for k, n in enumerate(top) if n.tag in ("article", "main")), 0)
    for above in range(k + 1, len(top)):
        before = []
        for p in top[above].parts:
            if p is top[above - 1]:
                break
            before.append(p)
        if any(isinstance(p, Node) and p.tag in HEADINGS and not p.skip for p in before):
            k = above
            break
    node = top[k]
    todo = [] if id(node) in found else [node]
    while todo:
        for p in todo.pop().parts:
            if not isinstance(p, Node) or p.skip or id(p) in found:
                continue
            if id(p) in path:
                todo.append(p)
            elif p.tag in BOXES and (2 * p.link_chars > p.chars or p.tag not in FLOW and not any(n.tag in ("article", "main") for n in top[k:])):
                p.skip = True
    return node


def text_of(node: Node) -> str:
    """Blocks in page order, joined by a line feed."""
    blocks, line, todo = [], [], [node]

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif not part.skip:
            block = part.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo += reversed(part.parts)
    flush()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return text_of(main_node(root))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: its id, its url and text."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([extract(x.as_py()) for x in part.column(2)], pa.string())], names=schema.names)

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)
