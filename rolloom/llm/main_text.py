"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from rolloom.llm.texts import with_text_columns

# Elements of the page language by what they mean here.
#: Their content is no text of the page, and no markup in it counts.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: They don't end a block.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big blink cite code data del dfn em font i img ins kbd label map mark nobr output picture q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var video wbr html body head".split()
)
#: Never part of an article.
OUTSIDE = frozenset("nav footer aside noscript template svg math select button dialog menu object datalist".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An open element of the first kind ends where one of the second begins, up to the nearest of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: End tags don't reach beyond these.
SCOPE = frozenset("table td th caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td center table tbody tr form fieldset".split())
#: Words in a class or id that name what surrounds articles.
SURROUNDINGS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar aside rail footer comment comments disqus reply replies respond discussion share sharing social related"
    " recommended recommendations trending popular cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login search pagination pager widget skip copyright legal disclaimer outbrain taboola".split()
)
#: The same for the head of a page; inside an article they name the article's own head.
HEADS = frozenset("header masthead topbar".split())
PUNCTUATION = re.compile(r"[.,;:!?、。，；：！？]")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements nested deeper than this count as children of the one at this depth.
DEEPEST = 512
#: Weights by which the values of the blocks around smooth a block's.
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
#: A container of this share of the selected text is the article, or holds it.
SHARE = 0.8


class Element(NamedTuple):
    tag: str
    parent: int
    #: Numbers the path of names from the root; equal paths have equal numbers.
    path: int
    #: Never text of an article.
    outside: bool
    #: The nearest element, this one included, whose name tells of the surroundings; -1: none.
    named: int
    #: Whether it is, or lies in, an article or the main part.
    article: bool


class Block(NamedTuple):
    element: int
    text: str
    linked: int


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _element(tag: str, source: str, number: int, parent: int, above: Element, paths: dict[tuple[int, str], int]) -> Element:
    given = _attributes(source) if source.strip(" /") else {}
    role, names = given.get("role", "").lower(), f"{given.get('class', '')} {given.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(names)}
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    body = tag in ("article", "main") or role in ("article", "main")
    head = not above.article and (tag == "header" or not words.isdisjoint(HEADS))
    outside = above.outside or tag in OUTSIDE or role in OUTSIDE_ROLES or hidden
    named = number if tag == "form" or head or not words.isdisjoint(SURROUNDINGS) else above.named
    label = ".".join([tag, *sorted(words)[:3]])
    path = paths.setdefault((above.path, label), len(paths) + 1)
    return Element(tag, parent, path, outside, named, above.article or body)


def parse(source: str) -> tuple[list[Element], list[Block]]:
    """Block elements in page order, and the blocks of text directly in them. Element 0 is the page."""
    elements = [Element("html", -1, 0, False, -1, False)]
    stack, blocks = [0], []
    paths: dict[tuple[int, str], int] = {}
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked, link_at, at = 0, -1, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(stack[-1], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if link_at >= 0:
                linked += len(text.strip())

    def close(depth: int) -> None:
        nonlocal link_at
        flush()
        open_tags.subtract(elements[number].tag for number in stack[depth:])
        del stack[depth:]
        if link_at >= len(stack):
            link_at = -1

    def opened(tags: frozenset[str] | set[str], until: frozenset[str]) -> int:
        """Depth of the innermost open element of ``tags``, not beyond one of ``until``; 0: none."""
        if not any(open_tags[tag] for tag in tags):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in tags:
                return depth
            if tag in until:
                return 0
        return 0

    while True:
        found = _TAG.search(source, at)
        add(source[at : found.start()] if found else source[at:])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag in RAW:
            if not found[1]:
                end = re.compile(f"</{tag}", re.I).search(source, at)
                at = end.start() if end else len(source)
            continue
        if tag == "a":
            link_at = len(stack) - 1 if not found[1] else -1
        if tag in INLINE or tag in VOID or ":" in tag:
            if tag in ("br", "hr"):
                pieces.append(" ") if tag == "br" else flush()
            continue
        if found[1]:
            depth = opened({tag}, frozenset() if tag in SCOPE or tag == "tr" else SCOPE)
            if depth:
                close(depth)
            continue
        flush()
        kinds, until = IMPLIED.get(tag, (None, None))
        if kinds and (depth := opened(kinds, until)):
            # a new row ends the open cell and the open row
            close(depth)
            if tag == "tr" and (depth := opened(kinds, until)):
                close(depth)
        elif depth := opened({"p"} | HEADINGS if tag in HEADINGS else {"p"}, SCOPE | {"button", "object"}):
            close(depth)
        if found[3].endswith("/") and tag in ("svg", "math"):
            continue
        parent = stack[min(len(stack), DEEPEST) - 1]
        elements.append(_element(tag, found[3], len(elements), parent, elements[parent], paths))
        stack.append(len(elements) - 1)
        open_tags[tag] += 1
    flush()
    return elements, blocks


def _within(elements: list[Element], number: int) -> list[int]:
    out = []
    while number >= 0:
        out.append(number)
        number = elements[number].parent
    return out


def _wrappers(elements: list[Element], blocks: list[Block]) -> set[int]:
    """Named elements that hold a title and half of the text: the page's frame, whatever its name."""
    size, titled, total = defaultdict(int), set(), 0
    for block in blocks:
        if elements[block.element].outside:
            continue
        total += len(block.text)
        if elements[block.element].named >= 0:
            for number in _within(elements, block.element):
                size[number] += len(block.text)
                if elements[block.element].tag == "h1":
                    titled.add(number)
    titled |= {n for number, e in enumerate(elements) if e.tag == "main" for n in _within(elements, number)}
    return {number for number in titled if elements[number].named == number and 2 * size[number] >= total}


def _surrounding(elements: list[Element], number: int, wrappers: set[int]) -> bool:
    if elements[number].outside:
        return True
    while (named := elements[number].named) >= 0:
        if named not in wrappers:
            return True
        number = elements[named].parent
    return False


def path_values(paths: list[int], blocks: list[Block]) -> dict[int, float]:
    """The smoothed ratio of each path.

    Text length and punctuation are summed per path and divided by its number of blocks, and
    multiplied; text in links does not count. The values in page order are smoothed by the blocks around, and a path
    takes the mean over its blocks.
    """
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, block in zip(paths, blocks):
        length[path] += len(block.text) - block.linked
        marks[path] += len(PUNCTUATION.findall(block.text))
        count[path] += 1
    values = np.array([length[p] / count[p] * (1 + marks[p] / count[p]) for p in paths])
    padded = np.convolve(values, KERNEL)[2 : 2 + len(values)]
    smooth = padded / np.convolve(np.ones(len(values)), KERNEL)[2 : 2 + len(values)]
    sums = defaultdict(float)
    for path, value in zip(paths, smooth.tolist()):
        sums[path] += value
    return {p: sums[p] / count[p] for p in count}


def main_blocks(source: str) -> list[str]:
    """The blocks of a page's main text, in page order."""
    elements, every = parse(source)
    wrappers = _wrappers(elements, every)
    around = {b.element for b in every if _surrounding(elements, b.element, wrappers)}
    blocks = [b for b in every if b.element not in around]
    if not blocks:
        return []
    paths = [elements[b.element].path for b in blocks]
    values = path_values(paths, blocks)
    spread = float(np.std([values[p] for p in paths]))
    chosen = {p for p, v in values.items() if v >= min(spread, max(values.values()))}

    # the innermost container that holds nearly all of the selected text, or the outermost article on the way
    weight, total = defaultdict(int), 0
    for path, block in zip(paths, blocks):
        if path in chosen:
            total += len(block.text)
            for number in _within(elements, block.element):
                weight[number] += len(block.text)
    container = 0
    inner = True
    while inner and elements[container].tag != "article":
        held = [n for n in weight if elements[n].parent == container and weight[n] >= SHARE * total and elements[n].tag in CONTAINERS]
        inner = bool(held)
        container = held[0] if held else container
    inside = [container in _within(elements, b.element) for b in blocks]
    own = [i for i, held in enumerate(inside) if held]
    if not elements[container].article:
        # without a declared article, what lies before the first and behind the last selected block is left out
        content = [i for i in own if paths[i] in chosen]
        while content and content[0] > own[0] and elements[blocks[content[0] - 1].element].tag in HEADINGS:
            content.insert(0, content[0] - 1)
        own = [i for i in own if content and content[0] <= i <= content[-1]]
    links = lambda i: 2 * blocks[i].linked > len(blocks[i].text) and paths[i] not in chosen
    own = [i for i in own if not links(i)]
    if own and not any(elements[blocks[i].element].tag == "h1" for i in own):
        title = [i for i in range(own[0]) if elements[blocks[i].element].tag == "h1"][-1:]
        own = title + own
    return [blocks[i].text for i in own]


def extract(pages: DataFrame, source: str, keep: list[str]) -> DataFrame:
    """``keep`` of each page, ``text`` (its main text, blocks joined by a line end) and ``n_chars``.

    Text is cut into blocks at block elements; a block belongs to the path of tags (with the words of their classes and ids) from the root to it.
    Length and punctuation per path give ratios, smoothed along the page; paths at or above the standard deviation of all blocks' values are selected. Menus, headers,
    footers, sidebars, forms, hidden parts and whatever a class, id or role names as surroundings take no part. The result is the
    innermost container of at least 80 % of the selected text (or the article on the way to it): all of its blocks but lists of links, headings and short lines
    included; an h1 before it counts as its title.

    Null or empty html, or no text: an empty string. Broken markup is read as far as it goes. A page
    is one record and read whole, whatever its length; repeated rows give the same text. Empty table: empty result. Only the named columns are read. No shuffle.
    """

    def judge(value: str | None) -> tuple[str, int]:
        text = "\n".join(main_blocks(value)) if value else ""
        return text, len(text)

    return with_text_columns(pages, source, [("text", "string"), ("n_chars", "long")], judge, keep)
