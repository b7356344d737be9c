"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. A linear classifier over words, links, tags and the hints of the
enclosing elements (names, classes, ids) gives every block an evidence for or against content; it becomes the
capacity to the content or the boilerplate terminal. Neighbouring blocks, and more so neighbouring children of one
element, are tied by smoothness edges. The minimum cut, by maximum flow, is the labelling of least total cost. A
block whose own capacity outweighs all its edges is labelled at once and its edges are folded into its neighbours,
which does not change the cut; the flow runs on what is left.

Cases: a null page is an empty one and gives an empty text; an unclosed comment or script swallows the rest; a tag
that the page's end cuts off is dropped; unknown and unbalanced tags are tolerated; equal blocks are all kept;
repeated rows are read each for itself; an empty table gives an empty table; other columns are carried through.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROWS = 256
# Tags that end a block, elements that are never text, and what element names and classes suggest.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
                   "tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template svg math iframe object select textarea button canvas head title audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS, GOOD_TAGS = frozenset("nav footer aside form header menu dialog fieldset".split()), frozenset("article main".split())
BAD_WORDS = frozenset("nav navbar navigation menu menubar footer foot header masthead topbar sidebar aside rail ad ads adv advert advertisement "
                      "advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
                      "popup modal overlay share sharing social related recommended recommendations comment comments commentlist "
                      "disqus reply replies respond discussion subscribe subscription newsletter signup login search breadcrumb "
                      "breadcrumbs pager pagination widget copyright disclaimer legal toolbar tags byline skip".split())
GOOD_WORDS = frozenset("article post entry story main content body text".split())
HARD, NEAR, SIBLING, APART = 50.0, 0.6, 0.8, 0.25

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]{0,8192}"|'[^']{0,8192}')*+)>"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


def _hint(tag: str, attrs: str) -> float:
    """What one element suggests of the text in it: negative for boilerplate."""
    if tag in BAD_TAGS:
        return -1.0
    good = 1.0 if tag in GOOD_TAGS else 0.0
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name = name.lower()
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return -1.0
            words = {w.lower() for w in _WORD.findall(value)} if name in ("class", "id", "role") else set()
            if words & BAD_WORDS:
                return -1.0
            if words & GOOD_WORDS and not good:
                good = 0.5
    return good


class Block:
    __slots__ = ("text", "tag", "parent", "hint", "linked")

    def __init__(self, text: str, tag: str, parent: int, hint: float, linked: int):
        self.text, self.tag, self.parent, self.hint, self.linked = text, tag, parent, hint, linked


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with their element, its parent and the innermost hint."""
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # open block elements: name, number, hint
    parts: list[str] = []
    number = links = linked = at = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            top = stack[-1]
            parent = stack[-2][1] if len(stack) > 1 else 0
            out.append(Block(text, top[0], parent if top[0] not in ("div", "section", "body", "article", "main") else top[1], top[2], linked))
        linked = 0

    while True:
        m = _TAG.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        end, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name in DROPPED and not end:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name == "a":
            links = 0 if end else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()
            if name in VOID:
                continue
            if end:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if depth:
                    del stack[depth:]
            else:
                if stack[-1][0] == "p" or stack[-1][0] == name == "li" or name[0] == stack[-1][0][:1] == "h" and len(name) == 2:
                    stack.pop()  # a paragraph, item or heading ends where the next block begins
                if name in GOOD_TAGS:
                    while stack[-1][2] < 0 and stack[-1][0] in ("nav", "header", "footer", "menu", "ul", "ol", "li"):
                        stack.pop()  # the article is not part of a menu that was left open
                number += 1
                own = _hint(name, attrs)
                stack.append((name, number, own if own else stack[-1][2]))
            links = 0
    close()
    return out


# ---- labelling -----------------------------------------------------------------------------------

def evidence(block: Block) -> float:
    """Positive for content."""
    if abs(block.hint) >= 1:
        return HARD * block.hint
    words = block.text.count(" ") + 1
    score = min(0.1 * words, 4.0) - 1.4 - 5.0 * max(0.0, min(1.0, block.linked / len(block.text)) - 0.25) + 5.0 * block.hint
    score += {"p": 0.8, "h1": 1.0, "h2": 0.6, "h3": 0.4, "pre": 0.8, "blockquote": 0.8, "li": -0.4, "td": -0.2}.get(block.tag, 0.0)
    return score + (0.4 if block.text[-1] in ".!?…»”\"" else 0.0)


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in page order, and between neighbouring children of one element.

    Blocks whose elements suggest different things are further apart: an advert amid an article says little of it.
    """
    out, last = [], {}
    tie = lambda i, j, w: (i, j, w if found[i].hint == found[j].hint else w * APART)
    for i, b in enumerate(found):
        if i:
            out.append(tie(i - 1, i, NEAR))
        if b.parent in last:
            out.append(tie(last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def min_cut(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: -unary of content blocks, unary of others, and the cut edges' weights."""
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    value, label = list(unary), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(value[i]) > sum(near[i].values()):
            label[i] = value[i] > 0
            for j, w in near[i].items():
                value[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        inside = _source_side(rest, value, near)
        for i in rest:
            label[i] = i in inside
    return label


def _source_side(rest: list[int], value: list[float], near: list[dict[int, float]]) -> set[int]:
    """Maximum flow by blocking flows on levels; nodes that the source still reaches."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        a, b = (source, i) if value[i] > 0 else (i, sink)
        cap[a][b] = abs(value[i])
        cap[b].setdefault(a, 0.0)
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level) - {source}
        arcs = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= tiny)
                del path[cut + 1:]
                continue
            v = next((v for v in arcs[u] if cap[u].get(v, 0) > tiny and level.get(v) == level[u] + 1), None)
            if v is None:
                path.pop()
                level.pop(u)
            else:
                path.append(v)
                if v != sink:
                    continue


def main_text(page: str) -> str:
    found = blocks(page)
    keep = min_cut([evidence(b) for b in found], edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(df: DataFrame, page: str, out: str = "text") -> DataFrame:
    """``df`` with the main text of the column ``page``, which is dropped."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                made = pa.array([main_text(v or "") for v in batch.column(page).to_pylist()], type=pa.string())
                names = [n for n in batch.schema.names if n not in (page, out)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, out])

    fields = [f for f in df.schema.fields if f.name not in (page, out)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))
