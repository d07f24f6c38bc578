"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements. Each block element gets features of its subtree's density, its
tag and attribute tokens, its depth and its siblings; boosted trees give the probability that it
holds main text. Decoding picks the most probable labels among those in which no kept node has a
dropped ancestor, by one pass up the tree and one down.

Training needs no labels by hand: in pages of a bounded sample whose markup names the main part
(one ``article`` or ``main``), that part is set into page frames of many kinds, built by ``framed``
with navigation, adverts, notices, sidebars, forms and comments around and inside it.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import arrow_map, batch_of, bounded_sample, slices, stored

#: Bound on the pages that train the trees, and frames built from each.
SAMPLE = 400
FRAMES = 4

# No part gives characters back once taken, and only quotes reach beyond the next "<", so the work stays linear.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*+(?:\Z|(?<=/)>|>.*?(?:</\1\s*+>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:\s(?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+)?+)/?>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul""".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div dl fieldset footer form header html main nav ol section table td th tr ul".split())

# Words in tags and attributes that speak for main text or against it.
MAIN_WORDS = frozenset("article main content post entry body story text prose blog page hentry single".split())
OTHER_WORDS = frozenset("""ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs
header masthead footer sidebar aside widget related recommended share social cookie cookies consent notice alert popup modal
newsletter subscribe signup login search form copyright legal disclaimer pagination pager tags skip toolbar complementary
contentinfo rail outbrain taboola""".split())
TALK_WORDS = frozenset("comment comments reply replies discussion disqus respond thread responses".split())
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "select", "button"))
CONTROLS = frozenset("input button select textarea label option".split())
NAMES = (
    "depth", "text", "density", "links", "share", "children", "place", "like", "ratio", "paragraphs", "items", "main_tag", "other_tag",
    "main_words", "other_words", "talk_words", "above_other", "above_main", "controls", "headings", "paragraph", "stops", "start", "header_tag", "list_tag",
)


class Node:
    __slots__ = ("tag", "words", "parent", "children", "index", "text", "links", "stops", "tags", "paragraphs", "items", "controls", "headings", "start", "decides", "mark", "owner")

    def __init__(self, tag: str, words: list[str], parent: Node | None, start: int, mark: str = "") -> None:
        self.tag, self.words, self.parent, self.start, self.mark = tag, words, parent, start, mark
        self.children: list[Node] = []
        self.index = -1
        self.text = self.links = self.stops = self.tags = self.paragraphs = self.items = self.controls = self.headings = 0
        self.decides = tag not in INLINE or bool(words)
        #: The node itself or the nearest ancestor that decides.
        self.owner: Node | None = self if self.decides or parent is None else parent.owner


def parsed(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The root and, in page order, the text pieces with their nodes; a piece '' ends a line of text."""
    root = Node("html", [], None, 0)
    pieces: list[tuple[Node, str]] = []
    stack = [root]
    at = chars = 0

    def put(text: str) -> None:
        nonlocal chars
        if text:
            text = entities.unescape(text)
            pieces.append((stack[-1], text))
            n = len(text) - text.count(" ") - text.count("\n")
            chars += n
            top = stack[-1]
            top.text += n
            top.stops += text.count(".") + text.count(",")
            if any(x.tag == "a" for x in stack[-3:]):
                top.links += n

    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag

    def close(names: set[str] | frozenset[str], limit: frozenset[str]) -> None:
        """Close down to the innermost open element of ``names``, unless one of ``limit`` lies within it."""
        innermost = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)
        to = innermost(names)
        if to and to >= innermost(limit):
            while len(stack) > to:
                places[stack.pop().tag].pop()

    for m in MARKUP.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        block = tag not in INLINE
        if block:
            pieces.append((stack[-1], ""))
        if m[2]:
            if tag in ("html", "body"):
                continue
            close({tag}, frozenset() if tag in SCOPES else SCOPES)
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES)
        if tag in CLOSES_ITSELF:
            close(CLOSES_ITSELF[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        words, mark = [], ""
        if m[4]:
            for name, a, b, c in ATTRIBUTE.findall(m[4]):
                name = name.lower()
                if name in ("class", "id", "role", "itemprop"):
                    words += [w.lower() for w in TOKENS.findall(a or b or c)]
                elif name == "data-frame":
                    mark = a
        node = Node(tag, words, stack[-1], chars, mark)
        stack[-1].children.append(node)
        if tag not in VOID and not m[0].endswith("/>"):
            places[tag].append(len(stack))
            stack.append(node)
    put(page[at:])
    return root, pieces


def summed(root: Node) -> list[Node]:
    """The deciding nodes in page order, parents first, with the sums of their subtrees."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.children)
    for node in reversed(order):
        node.tags += 1
        node.paragraphs += node.tag == "p"
        node.items += node.tag == "li"
        node.controls += node.tag in CONTROLS
        node.headings += node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if node.parent is not None:
            up = node.parent
            up.text += node.text
            up.links += node.text if node.tag == "a" else node.links
            up.stops += node.stops
            up.tags += node.tags
            up.paragraphs += node.paragraphs
            up.items += node.items
            up.controls += node.controls
            up.headings += node.headings
    deciding = [n for n in order if n.decides]
    for i, node in enumerate(deciding):
        node.index = i
    return deciding


def above(node: Node) -> Node | None:
    """The nearest deciding ancestor."""
    return node.parent.owner if node.parent is not None else None


LOGS = [NAMES.index(n) for n in ("text", "children", "like", "paragraphs", "controls", "headings")]


def features(nodes: list[Node]) -> np.ndarray:
    """A row of ``NAMES`` for each deciding node."""
    rows = []
    total = max(1, nodes[0].text)
    depth = [0] * len(nodes)
    hints = [(False, False)] * len(nodes)
    families: dict[int, tuple[dict[str, tuple[int, int]], dict[int, int], int]] = {}
    for i, node in enumerate(nodes):
        up, tag, text = above(node), node.tag, node.text
        main = other = talk = 0
        if node.words:
            words = set(node.words)
            main, other, talk = len(words & MAIN_WORDS), len(words & OTHER_WORDS), len(words & TALK_WORDS)
        is_main, is_other = tag in MAIN_TAGS, tag in OTHER_TAGS
        against = favour = False
        place, like, sum_ = 0.0, 1, text
        if up is not None:
            depth[i] = depth[up.index] + 1
            against, favour = hints[up.index]
            if up.index not in families:
                by_tag: dict[str, tuple[int, int]] = {}
                for s in up.children:
                    n, t = by_tag.get(s.tag, (0, 0))
                    by_tag[s.tag] = n + 1, t + s.text
                families[up.index] = by_tag, {id(s): k for k, s in enumerate(up.children)}, len(up.children)
            by_tag, places, n = families[up.index]
            # a node below an inline element is no child of the deciding one above it
            place = places.get(id(node), n // 2) / max(1, n)
            like, sum_ = by_tag.get(tag, (1, text))
        hints[i] = against or is_other or other > 0 or talk > 0, favour or is_main or main > 0
        rows.append((
            depth[i], text, text / node.tags, node.links / (text or 1), text / total, len(node.children), place,
            like, text * like / (sum_ or 1), node.paragraphs, node.items / node.tags, is_main, is_other,
            main, other, talk, against, favour, node.controls, node.headings, tag == "p",
            node.stops / (text or 1), node.start / total, tag == "header", tag in ("ul", "ol", "li"),
        ))
    table = np.array(rows, dtype=np.float64)
    table[:, LOGS] = np.log1p(table[:, LOGS])
    return table


def decoded(nodes: list[Node], probability: np.ndarray) -> np.ndarray:
    """The most probable labels in which no kept node has a dropped ancestor."""
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log1p(-p)
    parents = [a.index if (a := above(n)) is not None else -1 for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        keep[parents[i]] += max(keep[i], drop[i])
        drop[parents[i]] += drop[i]
    kept = np.zeros(len(nodes), bool)
    for i in range(len(nodes)):
        kept[i] = keep[i] > drop[i] and (i == 0 or kept[parents[i]])
    return kept


def text_of(pieces: list[tuple[Node, str]], kept: np.ndarray) -> str:
    """The text of the kept nodes; white space runs become one space, and so do block boundaries."""
    parts = []
    for node, text in pieces:
        if not text:
            parts.append(" ")
            continue
        if kept[node.owner.index]:
            parts.append(text)
    return " ".join("".join(parts).split())


def framed(main: str, filler: list[str], draw: np.random.Generator) -> str:
    """A page around ``main`` (inner markup), marked for training in data-frame attributes."""
    pick = lambda *options: options[draw.integers(len(options))]
    maybe = lambda chance, text: text if draw.random() < chance else ""
    some = lambda: filler[draw.integers(len(filler))] if filler else "text"
    words = lambda k: " ".join(some().split()[:k]) or "text"

    def wrapped(tags: tuple[str, ...], names: tuple[str, ...], inner: str, mark: str = "") -> str:
        tag, name = pick(*tags), pick(*names)
        where = pick("class", "id") if name else ""
        attribute = (f' {where}="{name}"' if name else "") + (f' data-frame="{mark}"' if mark else "")
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(2)}</a></li>' for i in range(draw.integers(3, 9))) + "</ul>"

    def paragraphs(most: int) -> str:
        return "".join(f"<p>{some()}</p>" for _ in range(draw.integers(1, most + 1)))

    advert = lambda: wrapped(("div", "aside", "section", "p"), ("ad", "advert", "ads banner", "sponsored", "promo", "advertisement"), pick(words(12), paragraphs(1)))
    notice = lambda: wrapped(("div", "section", "aside", "p"), ("cookie-notice", "notice", "alert", "consent", "cookie-banner", "popup"), pick(words(15), paragraphs(2)))
    share = lambda: wrapped(("div", "ul"), ("share", "social", "related", "tags"), menu())
    form = lambda: f'<form{pick("", " class=\"newsletter\"", " id=\"search\"")}>{pick("", f"<p>{words(14)}</p>")}<label>{words(3)}</label><input type="text"><button>{words(1)}</button></form>'
    remark = lambda: wrapped(("div", "li", "article", "section"), ("comment", "comment-body", "reply", ""), f"{pick('', f'<b>{words(2)}</b>', f'<h4>{words(3)}</h4>')}{paragraphs(2)}")
    talk = lambda: wrapped(("section", "div", "ul", "aside"), ("comments", "comment-list", "discussion", "responses", "reader-comments"), f"<h2>{words(2)}</h2>" + "".join(remark() for _ in range(draw.integers(1, 6))) + maybe(0.3, form()))
    sidebar = lambda: wrapped(("aside", "div"), ("sidebar", "side", "widget", "related", "rail", ""), f"<h3>{words(3)}</h3>" + pick(menu(), paragraphs(3))) if draw.random() < 0.8 else f"<aside>{paragraphs(2)}</aside>"
    hidden = lambda text: text.replace(">", ' data-frame="other">', 1)

    inside = "".join(maybe(0.12, hidden(x())) for x in (advert, share, form, notice))
    end = maybe(0.12, hidden(talk()))
    at = main.find("</p>") + 4
    body = main[:at] + inside + main[at:] if at > 3 else inside + main
    if draw.random() < 0.25:
        body = re.sub(r"(<h1\b.*?</h1>)", r"<header>\1</header>", body, count=1, flags=re.S)
    center = wrapped(("article", "main", "div", "section", "div", "div"), ("", "content", "post", "entry-content", "story", "article-body", "main", "post-text"), body + end, "main")
    if draw.random() < 0.4:
        center = wrapped(("div", "main", "section"), ("", "content", "container", "main"), center + maybe(0.3, sidebar()) + maybe(0.3, talk()))
    top = wrapped(("header", "div"), ("", "header", "masthead", "site-header", "top"), maybe(0.6, f"<h1>{words(3)}</h1>") + maybe(0.5, f"<p>{words(8)}</p>") + maybe(0.4, menu()))
    navigation = wrapped(("nav", "div", "ul"), ("", "menu", "nav", "navbar", "navigation"), menu()) if draw.random() < 0.9 else f"<nav>{menu()}</nav>"
    bottom = wrapped(("footer", "div"), ("", "footer", "site-footer", "copyright"), pick(f"&copy; {words(10)}", paragraphs(2), menu()))
    page = (
        maybe(0.3, notice()) + maybe(0.5, top) + maybe(0.8, navigation) + maybe(0.6, advert()) + maybe(0.25, sidebar()) + center
        + maybe(0.4, sidebar()) + maybe(0.3, advert()) + maybe(0.45, talk()) + maybe(0.3, form()) + maybe(0.2, notice()) + maybe(0.8, bottom)
    )
    if draw.random() < 0.3:
        page = wrapped(("div",), ("", "wrapper", "page", "container"), page)
    return f"<html><body>{page}</body></html>"


def marked(nodes: list[Node]) -> np.ndarray | None:
    """Training labels of a framed page: 1 in the main part and above it, 0 elsewhere."""
    label = np.zeros(len(nodes), int)
    inside = np.zeros(len(nodes), int)
    root = None
    for i, node in enumerate(nodes):
        up = above(node)
        state = inside[up.index] if up is not None else 0
        inside[i] = 1 if node.mark == "main" else 2 if node.mark == "other" else state
        label[i] = inside[i] == 1
        root = node if node.mark == "main" else root
    while root is not None:
        label[root.index] = 1
        root = above(root)
    return label


MAIN_PART = re.compile(r"<(article|main)\b[^>]*+>(.*?)</\1\s*+>", re.S | re.I)
OPENING = re.compile(r"<(?:article|main)\b", re.I)
#: A page that opens more parts than this names no single one; looking for their ends would take too long.
MOST_OPENINGS = 8


def training_rows(pages: DataFrame, sample: int = SAMPLE, frames: int = FRAMES) -> DataFrame:
    """(label, x) of the nodes of framed pages; pages without one named main part give none."""
    chosen = bounded_sample(pages.where("html is not null").select("page_id", "html"), ["page_id", "html"], sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            labels, rows = [], []
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = MAIN_PART.findall(page) if len(OPENING.findall(page)) <= MOST_OPENINGS else []
                if len(found) != 1:
                    continue
                plain = re.sub(r"<[^<>]*+>", " ", found[0][1]).split(".")
                filler = [entities.escape(s.strip()) for s in plain if len(s.split()) > 2]
                draw = np.random.default_rng([7, abs(page_id or 0), zlib.crc32(page.encode("utf-8", "surrogatepass"))])
                for _ in range(frames):
                    nodes = summed(parsed(framed(found[0][1], filler, draw))[0])
                    labels.append(marked(nodes))
                    rows.append(features(nodes))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(labels), pa.int32()), pa.array(list(np.concatenate(rows)), pa.list_(pa.float64()))], names=["label", "x"]
                )

    return arrow_map(chosen, run, "label int, x array<double>")


def exported(model: GBTClassificationModel) -> list[tuple[np.ndarray, ...]]:
    """Each tree as arrays (feature or -1, threshold, left, right, weighted value)."""
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list[float]] = []

        def walk(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, 0.0])
            if node.getClass().getSimpleName() == "LeafNode":
                rows[at][4] = weight * node.prediction()
            else:
                split = node.split()
                rows[at][:2] = split.featureIndex(), split.threshold()
                rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        a = np.array(rows)
        trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return trees


def probabilities(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    margin = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), int)
        while (feature[at] >= 0).any():
            inner = feature[at] >= 0
            goes_left = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        margin += value[at]
    return 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))


def fit(pages: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, ...]]:
    """Boosted trees from a bounded sample of ``pages``; none where no page names its main part."""
    rows = stored(training_rows(pages, sample))
    if rows.select("label").distinct().count() < 2:
        return []
    learner = GBTClassifier(labelCol="label", featuresCol="features", maxIter=24, maxDepth=5, stepSize=0.25, seed=3)
    return exported(learner.fit(rows.select("label", array_to_vector("x").alias("features"))))


def extracted(pages: DataFrame, trees: list[tuple[np.ndarray, ...]]) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    White space is what Python's ``split`` takes for it, no-break spaces and line separators included.
    Pages of any length and nesting are read whole, in time linear in their length; an element that is
    never closed ends with the page. NULL and empty pages, and pages of which no node is kept, give an empty text. Without trees every
    node counts as undecided and nothing is kept. Repeated rows come back repeated; other columns are
    not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            trees_pages = [parsed(p or "") for p in batch.column(2).to_pylist()]
            nodes = [summed(root) for root, _ in trees_pages]
            p = probabilities(shared.value, np.concatenate([features(n) for n in nodes]))
            texts, at = [], 0
            for (_, pieces), own in zip(trees_pages, nodes):
                texts.append(text_of(pieces, decoded(own, p[at : at + len(own)])))
                at += len(own)
            yield batch_of(schema, page_id=batch.column(0), url=batch.column(1).cast(pa.string()), text=texts, n_chars=[len(t) for t in texts])

    return arrow_map(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return extracted(pages, fit(pages, sample))
