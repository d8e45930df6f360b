"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page becomes a row of text blocks and the tree of elements that hold them; both
are nodes of a flow network.  A linear classifier gives a block a cost for either
label from its text alone, and an element one from its tag and its names; the
costs are the terminal capacities.  Smoothness edges join each block to its
element, each element to its parent, and successive blocks, the weaker the
farther they are apart in the tree.  The minimum cut, found by maximum flow, is
the cheapest labelling into content and boilerplate: a short paragraph is carried
by the article around it, and prose in a sidebar falls with the sidebar.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .storage import ship

# Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page: scripts, styles, what only shows without them, form controls, metadata.
RAW_TAGS = frozenset("script style noscript template textarea title iframe select button head".split())
#: Elements that are a block rather than hold some; they are no nodes unless something speaks for or against them.
LEAF_TAGS = frozenset("p li dt dd td th tr tbody thead tfoot caption figcaption summary legend option h1 h2 h3 h4 h5 h6".split())
#: Elements that by their meaning hold no main text.
OUTER_TAGS = frozenset("nav aside footer form menu dialog search".split())
# Words in class, id and role that name menus, sidebars, footers, adverts, comments and the like.
_STRONG = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|aside|foot(?:er)?\w*|masthead|page-?head(?:er)?|site-?head(?:er)?|topbar|toolbar|"
    r"cookie\w*|consent|popup|modal|newsletter|subscri\w*|comments?|replies|disqus|social\w*|shar(?:e|ing)\w*|related\w*|recommend\w*|pagination|pager|login|signup)(?=$|[\s_-])"
)
#: Words that name such things at times.
_WEAK = re.compile(r"(?i)(?:^|[\s_-])(?:banner|notice\w*|alert|respond|discussion|widget\w*|tags?|search\w*|copyright|legal|disclaimer|teaser\w*)(?=$|[\s_-])")
#: Headers count as boilerplate outside articles; articles and main parts only if they are comments, adverts or teasers themselves.
_HEADER = re.compile(r"(?i)(?:^|[\s_-])header(?=$|[\s_-])")
_INSERT = re.compile(r"(?i)(?:^|\s)(?:comments|replies|ads|(?:comment|reply|ad|advert\w*|sponsored|promo|related|teaser)(?:[_-]\w+)?)(?=$|\s)")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_GOOD = re.compile(r"(?i)(?:^|[\s_-])(?:article|content|main|post|story|entry|body|text)(?=$|[\s_-])")
#: An unquoted < ends a tag that was never closed, so a page of such tags is scanned once.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+>", re.S)
#: Ends of raw elements; ASCII letters of either case only, as in the tags.
_RAW_END = {tag: re.compile(f"(?ai)</{tag}") for tag in RAW_TAGS}
_BODY = re.compile("(?ai)<body")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"(?:\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")

#: The classifier of blocks, in log-odds of content: its text, and whether it lies outside the articles of a page that has some.
BLOCK_WEIGHTS = {"bias": -0.5, "length": 2.0, "sentence": 0.6, "paragraph": 0.4, "heading": 0.3, "links": -2.5}
BLOCK_RANGE = (-1.5, 2.0)
OUTSIDE = -3.0
#: The classifier of elements, in log-odds for each block inside.
ARTICLE, GOOD, STRONG, WEAK, WEAK_INSIDE = 4.0, 1.0, -6.0, -2.5, -1.0
#: Smoothness: a block and its element; an element and its parent for each block inside, where the parent's kind is told by it or its ancestors, and elsewhere; successive blocks that are siblings.
HELD, KNOWN, PLAIN, NEXT = 2.5, 2.5, 0.5, 0.8
#: Elements nested deeper are no nodes of their own, as browsers flatten them; their text stays.
DEEPEST = 200


class Block:
    __slots__ = ("element", "linked", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, element: int) -> None:
        self.text, self.linked, self.tag, self.element = text, linked, tag, element


class Element:
    """An element that holds blocks: its parent (always an earlier one), depth, own evidence, and whether it lies in an article and in one of a known kind."""

    __slots__ = ("depth", "inside", "known", "odds", "parent")

    def __init__(self, parent: int, depth: int, odds: float, inside: bool, known: bool) -> None:
        self.parent, self.depth, self.odds, self.inside, self.known = parent, depth, odds, inside, known


def _evidence(tag: str, token: str, inside: bool) -> tuple[float, bool]:
    """What an element's tag and attributes say of its blocks, and whether it opens an article."""
    article = tag in ("article", "main")
    odds = ARTICLE if article else STRONG if tag in OUTER_TAGS or (tag == "header" and not inside) else 0.0
    if " " not in token and "\n" not in token and "\t" not in token:
        return odds, article
    for name, value in _ATTRIBUTE.findall(token):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden"):
            odds = STRONG if name == "hidden" or value.lower() == "true" else odds
        elif name == "style":
            odds = STRONG if _HIDDEN.search(value) else odds
        elif article:
            odds = STRONG if _INSERT.search(value) else odds
        elif tag not in ("body", "html") and odds != STRONG:
            if _STRONG.search(value) or (_HEADER.search(value) and not inside):
                odds = STRONG
            elif _WEAK.search(value):
                odds = WEAK_INSIDE if inside else WEAK
            elif _GOOD.search(value) and not odds:
                odds = GOOD
    return odds, article and odds > 0


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page, in page order (white space is one space, references are decoded), and the elements that hold them."""
    out: list[Block] = []
    tree = [Element(0, 0, 0.0, False, False)]
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    at, parts, linked, in_link = 0, [], 0, 0
    last_close = page.rfind(">")

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, min(linked, len(text)), *stack[-1]))
        parts, linked = [], 0

    def end_of(tag: str, start: int) -> int:
        """Where a raw element ends; -1 if nowhere, which is then known for all later ones."""
        if tag in unclosed:
            return -1
        m = (_BODY if tag == "<body" else _RAW_END[tag]).search(page, start)
        if m is None:
            unclosed.add(tag)
        return m.start() if m else -1

    while True:
        m = _TOKEN.search(page, at) if at <= last_close or page.find("<!--", at) >= 0 else None
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            parts.append(chunk)
            if in_link:
                linked += len(chunk)
        if not m:
            break
        token, at = m[0], m.end()
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag == "a":
                in_link = 0
            if tag in BLOCK_TAGS:
                flush()
                while opened[tag]:  # up to the element itself, if it is open at all
                    opened[gone := stack.pop()[0]] -= 1
                    if gone == tag:
                        break
            continue
        if tag in RAW_TAGS:
            if not token.endswith("/>"):
                end = end_of(tag, at)
                if tag == "head":  # an unclosed head ends with the body
                    body = end_of("<body", at)
                    end = min((e for e in (end, body) if e >= 0), default=-1)
                if tag in ("title", "head") or end >= 0:
                    stop = page.find(">", end) if end >= 0 and page.startswith("</", end) else end - 1
                    at = (stop + 1 if stop >= 0 else len(page)) if end >= 0 else (at if tag == "head" else len(page))
                elif tag in ("script", "style"):
                    at = len(page)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 1
        if tag not in BLOCK_TAGS:
            continue
        flush()
        in_link = 0
        if tag in VOID_TAGS:
            continue
        if stack[-1][0] == "p" or stack[-1][0] == tag == "li":
            opened[stack.pop()[0]] -= 1
        here = stack[-1][1]
        up = tree[here]
        odds, article = _evidence(tag, token, up.inside)
        if odds or (tag not in LEAF_TAGS and up.depth < DEEPEST):
            tree.append(Element(here, up.depth + 1, odds, up.inside or article, up.known or abs(odds) >= ARTICLE))
            here = len(tree) - 1
        stack.append((tag, here))
        opened[tag] += 1
    flush()
    return out, tree


def log_odds(block: Block) -> float:
    """The classifier of blocks: log-odds of content by the text alone."""
    w, size = BLOCK_WEIGHTS, len(block.text)
    score = w["bias"] + w["length"] * min(size / 160, 1.0) + w["sentence"] * (block.text[-1:] in ".!?…\"”»") + w["links"] * block.linked / size
    score += w["paragraph"] * (block.tag == "p") + w["heading"] * (block.tag[:1] == "h" and block.tag[1:].isdigit())
    return min(max(score, BLOCK_RANGE[0]), BLOCK_RANGE[1])


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: ``odds`` lost where a label goes against them, and an edge's weight where its ends differ.

    A node whose terminal capacity is no less than all its edges together stays with its terminal in
    some minimum cut, so it is merged into it, and its edges add to its neighbours' terminal capacities; this
    goes on until no such node is left.  Each connected rest is cut by maximum flow.
    """
    n = len(odds)
    odds = list(odds)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    load = [0.0] * n
    for a, b, c in edges:
        if a != b and c > 0:
            near[a].append((b, c))
            near[b].append((a, c))
            load[a] += c
            load[b] += c
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(odds[i]) >= load[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = odds[i] >= 0
        for j, c in near[i]:
            if label[j] is None:
                odds[j] += c if label[i] else -c
                load[j] -= c
                if abs(odds[j]) >= load[j]:
                    todo.append(j)
    for i in range(n):
        if label[i] is not None:
            continue
        label[i] = True
        part, at = [i], {i: 0}
        for a in part:
            for b, _ in near[a]:
                if label[b] is None:
                    label[b] = True
                    at[b] = len(part)
                    part.append(b)
        inner = [(at[a], at[b], c) for a in part for b, c in near[a] if b in at and a < b]
        for a, side in zip(part, max_flow([odds[a] for a in part], inner), strict=True):
            label[a] = side
    return label


def max_flow(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The sides of a minimum cut by Dinic's maximum flow; ties fall to True for nodes that the sink side does not need."""
    n = len(odds)
    if all(o >= 0 for o in odds) or all(o < 0 for o in odds):
        return [o >= 0 for o in odds]
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, o in enumerate(odds):
        if o >= 0:
            add(source, i, o, 0.0)
        else:
            add(i, sink, -o, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                cut = 0
                for k in range(len(path) - 1, -1, -1):
                    e = path[k]
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= tiny:
                        cut = k
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break
    # the sink side is what still reaches the sink; the rest is content
    need = [False] * (n + 2)
    need[sink] = True
    queue = deque([sink])
    while queue:
        b = queue.popleft()
        for e in out[b]:
            if room[e ^ 1] > tiny and not need[to[e]]:
                need[to[e]] = True
                queue.append(to[e])
    return [not need[i] for i in range(n)]


def network(blocks: list[Block], tree: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities (as log-odds) of the blocks and then of the elements, and the smoothness edges."""
    size = [0] * len(tree)
    for b in blocks:
        size[b.element] += 1
    for k in range(len(tree) - 1, 0, -1):
        size[tree[k].parent] += size[k]
    told = any(e.inside for e in tree)
    odds = [log_odds(b) + (OUTSIDE if told and not tree[b.element].inside else 0.0) for b in blocks]
    odds += [e.odds * s for e, s in zip(tree, size, strict=True)]
    n = len(blocks)
    edges = [(i, n + b.element, HELD) for i, b in enumerate(blocks)]
    edges += [(n + k, n + e.parent, (KNOWN if tree[e.parent].known else PLAIN) * size[k]) for k, e in enumerate(tree) if k and size[k]]
    for i in range(1, n):
        x, y, steps = blocks[i - 1].element, blocks[i].element, 1
        while x != y:  # as many steps as elements begin or end between the two
            if tree[x].depth >= tree[y].depth:
                x = tree[x].parent
            else:
                y = tree[y].parent
            steps += 1
        edges.append((i - 1, i, NEXT / steps**2))
    return odds, edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, two newlines between them; '' if there are none."""
    blocks, tree = blocks_of(page or "")
    keep = min_cut(*network(blocks, tree)) if blocks else []
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=False) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages(page_id, url, html)``.

    A null or empty page gives the empty text and 0.  Repeated rows give equal
    rows.  Pages of any length are read once, in time in proportion to them, but for the flow, which
    only meets the blocks that nothing decides by itself.  Of labellings of equal cost one is
    taken by rule, so reruns agree.  Other columns are ignored; an empty table gives an empty result.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textbuf.slices(whole, "html"):
                texts = [main_text(p) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
