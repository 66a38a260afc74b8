"""Block structure of an HTML page: a forgiving tokenizer, a tree of block elements with their text, and node features."""

from __future__ import annotations

import html as html_module
import re
import zlib
from dataclasses import dataclass, field

import numpy as np

BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary"
    " nav header footer aside form fieldset legend center hgroup menu dialog search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("head script style template noscript iframe object svg math canvas audio video select option button textarea input datalist title".split())
RAW = frozenset("script style textarea title iframe xmp noembed".split())
#: A start tag of the key ends an open element among the values, unless a scope element lies between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"), "option": ("option",),
}
SCOPES = frozenset("html body table ul ol dl td th article section div main aside nav header footer form blockquote figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: Comments and sections that run to the page's end, where no ">" follows.
_UNENDED = re.compile(r"<!--.*\Z|<!\[CDATA\[.*\Z|<(?!)()()()", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = frozenset(("class", "id", "role", "itemprop", "aria-label", "hidden", "style", "aria-hidden"))
#: The attribute by which composed training pages mark their article; on other pages it is an attribute like any.
GOLD = "data-gold"
#: Characters that stand for about three letters each, and marks that end or divide a sentence, in any script.
_FAR, _WIDE, _STOPS = re.compile("[\u0589-\U0010ffff]"), re.compile("[\u1100-\u11ff\u2e80-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]"), re.compile("[.,\u3002\u3001\uff0c\uff0e\uff01\uff1f\u060c\u061b\u061f\u06d4\u0964\u0589]")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

#: Attribute tokens that describe the role of an element, by group.
TOKENS = {
    "good": "article articlebody body content contents copy entry main maincontent page post prose richtext story text",
    "menu": "breadcrumb breadcrumbs crumbs links menu nav navbar navigation pager pagination tabs toc toolbar topbar",
    "side": "aside box complementary extra latest more popular rail readmore recommended related sidebar sidenav teaser teasers trending widget widgets",
    "advert": "ad ads adv advert advertisement adsbox banner dfp outbrain partner promo promoted promotion sponsor sponsored taboola",
    "notice": "alert alertdialog announcement banner cc consent cookie cookies dialog disclaimer gdpr legal message modal notice notification overlay popup privacy toast warning",
    "comment": "comment comments commentlist discussion disqus feedback replies reply respond responses reviews thread",
    "social": "bio byline facebook follow like meta share sharing social tags tweet twitter whatsapp author",
    "edge": "bottom brand contentinfo copyright footer foot head header logo masthead site top",
    "form": "form input login newsletter optin register search searchbox signin signup subscribe subscription",
}
GROUPS = tuple(TOKENS)
_GROUP_OF: dict[str, int] = {}
for _k, _names in enumerate(TOKENS.values()):
    for _t in _names.split():
        _GROUP_OF[_t] = _GROUP_OF.get(_t, 0) | 1 << _k
HIDDEN = 1 << len(GROUPS)
KINDS = ("article", "main section", "div center", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li dt dd", "table thead tbody tfoot tr td th caption", "nav", "header", "footer", "aside", "form fieldset legend search dialog", "blockquote pre figure figcaption")
_KIND_OF = {t: k for k, names in enumerate(KINDS) for t in names.split()}
#: Attribute tokens outside the groups are told apart by so many hashes.
HASHES = 24


def measured(text: str) -> tuple[int, int]:
    """(length in letters, stops) of a stretch of text."""
    if text.isascii() or not _FAR.search(text):
        return len(text), text.count(".") + text.count(",")
    return len(text) + 2 * len(_WIDE.findall(text)), len(_STOPS.findall(text))


@dataclass
class Blocks:
    """Block elements of pages in document order; end is one past the last descendant."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    #: groups and kinds of all elements above
    above: list[int] = field(default_factory=list)
    kinds_above: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    gold: list[int] = field(default_factory=list)
    #: (element, text) of each stretch of text between two block boundaries, by page
    runs: list[list[tuple[int, str]]] = field(default_factory=list)

    def open(self, page: int, parent: int, tag: str, groups: int, gold: int) -> int:
        self.page.append(page), self.parent.append(parent), self.end.append(0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(_KIND_OF.get(tag, len(KINDS))), self.groups.append(groups)
        self.above.append(self.above[parent] | self.groups[parent] if parent >= 0 else 0)
        self.kinds_above.append(self.kinds_above[parent] | 1 << self.kind[parent] if parent >= 0 else 0)
        self.chars.append(0), self.link_chars.append(0), self.stops.append(0), self.gold.append(gold)
        return len(self.page) - 1


def _attributes(text: str, training: bool) -> tuple[int, int]:
    """(token groups, then hashes of other tokens, as bits; gold label of a training page or -1)."""
    groups, gold = 0, -1
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in _NAMES:
            value = a or b or c
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "none" in value and "display" in value):
                groups |= HIDDEN
            elif name != "style":
                for t in _SPLIT.split(value):
                    t = t.lower()
                    known = _GROUP_OF.get(t, 0) or (_GROUP_OF.get(t[:-1], 0) if t.endswith("s") else 0)
                    groups |= known or (HIDDEN << 1 + zlib.crc32(t.encode()) % HASHES if len(t) > 1 else 0)
        elif training and name == GOLD:
            gold = int(a or b or c)
    return groups, gold


class _Stack:
    """Open elements, with the places of each tag and of those that bound a search, so that no search walks the stack."""

    def __init__(self, root: int):
        self.items: list[tuple[str, int]] = [("#root", root)]  # tag ("#" before it inside silent elements), its block
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.silents: list[int] = []
        self.scopes: list[int] = []

    def push(self, tag: str, block: int) -> None:
        k = len(self.items)
        self.places.setdefault(tag, []).append(k)
        if tag in BLOCKS:
            self.blocks.append(k)
        if tag in SILENT:
            self.silents.append(k)
        if tag in SCOPES:
            self.scopes.append(k)
        self.items.append((tag, block))

    def pop(self) -> tuple[str, int]:
        tag, block = self.items.pop()
        self.places[tag].pop()
        for kind, places in ((BLOCKS, self.blocks), (SILENT, self.silents), (SCOPES, self.scopes)):
            if tag in kind:
                places.pop()
        return tag, block

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of the tags, 0 where none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def ended_by(self, tag: str) -> int:
        """Place of the element that an end tag ends, 0 for none: an inline one does not close a block, and none ends an element whose content is no text."""
        k = self.last(tag, f"#{tag}")
        bound = max(self.silents[-1] if self.silents else 0, self.blocks[-1] if self.blocks and tag not in BLOCKS else 0)
        return k if k >= bound else 0

    def closed_by(self, *tags: str) -> int:
        """Place of the innermost element of the tags that no scope hides, else 0."""
        k = self.last(*tags)
        return k if k > (self.scopes[-1] if self.scopes else 0) or k and k == self.scopes[-1] else 0


def add_page(blocks: Blocks, page: int, source: str, training: bool = False, gold: int = 0) -> None:
    """Parse one page into ``blocks``; ``training`` reads the marks of composed pages, ``gold`` is the mark of text outside all elements.

    Never fails: what is no tag is text, unclosed elements end with their parent.
    """
    root = blocks.open(page, -1, "html", 0, gold)
    stack = _Stack(root)
    current, silent, links = root, 0, 0
    run: list[str] = []
    runs: list[tuple[int, str]] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                runs.append((current, text))
                length, stops = measured(text)
                blocks.chars[current] += length
                blocks.stops[current] += stops

    def close_to(depth: int) -> None:
        nonlocal current, silent, links
        while len(stack.items) > depth:
            tag, block = stack.pop()
            if tag in SILENT:
                silent -= 1
            elif tag == "a":
                links -= 1
            if tag in BLOCKS:
                flush()
                blocks.end[block] = len(blocks.page)
                current = stack.items[-1][1]

    at, size, last_end = 0, len(source), source.rfind(">")
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            if not silent:
                text = source[at:lt]
                text = html_module.unescape(text) if "&" in text else text
                run.append(text)
                if links:
                    blocks.link_chars[current] += measured(text.strip())[0]
            at = lt
            continue
        m = _TOKEN.match(source, at) or _LOOSE.match(source, at) if at < last_end else _UNENDED.match(source, at)
        if m is None:
            if not silent:
                run.append("<")
            at += 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not silent:
                run.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            k = stack.ended_by(tag)
            if k:
                close_to(k)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img", "input"):
                run.append(" " if tag != "wbr" else "")
            continue
        if tag in ("html", "body") and stack.last(tag):
            continue
        if tag in BLOCKS:
            if tag != "body" and (k := stack.closed_by("p")):
                close_to(k)
            if tag in CLOSES:
                while k := stack.closed_by(*CLOSES[tag]):
                    close_to(k)
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
            flush()
            if not silent:
                groups, gold = _attributes(m[3], training) if m[3] else (0, -1)
                current = blocks.open(page, current, tag, groups, gold if gold >= 0 else blocks.gold[current])
                stack.push(tag, current)
            else:
                stack.push(f"#{tag}", current)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(source, at)
            if tag not in SILENT and not silent:
                run.append(source[at : stop.start() if stop else size])
            at = source.find(">", stop.start()) + 1 if stop and source.find(">", stop.start()) >= 0 else size
            continue
        if m[3].rstrip().endswith("/") and tag in SILENT:
            continue
        if tag == "a":
            links += 1
        elif tag in SILENT:
            silent += 1
        stack.push(tag, current)
    close_to(1)
    flush()
    blocks.end[root] = len(blocks.page)
    blocks.runs.append(runs)


def features(blocks: Blocks) -> np.ndarray:
    """(elements, features) float64: kind, attribute tokens here and above, text and link density, depth, place, siblings."""
    page, parent, end, depth, kind, groups, above, kinds_above, chars, links, stops = (
        np.array(v, np.int64) for v in (blocks.page, blocks.parent, blocks.end, blocks.depth, blocks.kind, blocks.groups, blocks.above, blocks.kinds_above, blocks.chars, blocks.link_chars, blocks.stops)
    )
    n = len(page)
    index = np.arange(n)
    end = np.maximum(end, index + 1)
    sums = lambda v: (lambda c: c[end] - c[index])(np.concatenate(([0], np.cumsum(v))))
    text, linked, marks, size = sums(chars), np.minimum(sums(links), sums(chars)), sums(stops), end - index
    before = np.concatenate(([0], np.cumsum(chars)))[index]
    root = np.flatnonzero(parent < 0)
    of = root[np.searchsorted(root, index, "right") - 1]
    whole = np.maximum(text[of], 1)
    in_p = sums(np.where(kind == 3, chars, 0))
    in_lists = sums(np.where(kind == 6, 1, 0))
    # siblings: order within the parent, by sorting on the parent
    order = np.lexsort((index, parent))
    p = parent[order]
    first = np.concatenate(([True], p[1:] != p[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - start
    count = np.bincount(parent + 1, minlength=n + 1)
    siblings = count[parent + 1]
    alike = np.unique(parent * 16 + kind, return_inverse=True, return_counts=True)
    same = alike[2][alike[1]]
    sibling_text = np.bincount(parent + 1, text, n + 1)[parent + 1]
    density = linked / np.maximum(text, 1)
    previous, following = np.zeros(n), np.zeros(n)
    previous[order[1:]] = np.where(first[1:], 0, np.log1p(text[order[:-1]]) * (1 - density[order[:-1]]))
    following[order[:-1]] = np.where(first[1:], 0, np.log1p(text[order[1:]]) * (1 - density[order[1:]]))
    up = np.maximum(parent, 0)
    columns = [(kind == k).astype(float) for k in range(len(KINDS))]
    columns += [(groups >> k & 1).astype(float) for k in range(len(GROUPS) + 1 + HASHES)]
    columns += [(above >> k & 1).astype(float) for k in range(len(GROUPS) + 1)]
    columns += [(kinds_above >> k & 1).astype(float) for k in (0, 1, 6, 8, 9, 10, 11, 12)]
    columns += [
        depth, np.log1p(text), np.log1p(chars), density, text / size, np.log1p(size), marks / np.maximum(text, 1) * 100, text / whole, before / 1.0 / whole - before[of] / whole,
        place, siblings, same / siblings, text / np.maximum(sibling_text, 1), previous, following, in_p / np.maximum(text, 1), np.log1p(in_p), in_lists / size, density[up], np.log1p(text[up]), np.log1p(whole),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


#: Price, in log-odds, of main text beginning at an element and of cutting an element out of main text.
ENTER, CUT = 0.5, 2.0


def decode(blocks: Blocks, margin: np.ndarray) -> np.ndarray:
    """The likeliest consistent labelling: True for elements whose own text is main text.

    From the root down an element is outside, main or cut; outside may turn main, main may be cut, and what is cut
    stays cut. Each element adds its log-odds, each change its price; the best labelling of each subtree is found bottom-up.
    """
    n = len(margin)
    gain = margin.tolist()
    weight = [1.0 if c else 0.35 for c in blocks.chars]
    parent = blocks.parent
    out_best, main_best, cut_best = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        g = weight[i] * max(-6.0, min(6.0, gain[i])) / 2
        out_best[i] -= g
        main_best[i] += g
        cut_best[i] -= g
        p = parent[i]
        if p >= 0:
            out_best[p] += max(out_best[i], main_best[i] - ENTER)
            main_best[p] += max(main_best[i], cut_best[i] - CUT)
            cut_best[p] += cut_best[i]
    state = [0] * n
    for i in range(n):
        p = parent[i]
        above = state[p] if p >= 0 else 0
        if above == 0:
            state[i] = 1 if main_best[i] - ENTER > out_best[i] else 0
        elif above == 1:
            state[i] = 1 if main_best[i] >= cut_best[i] - CUT else 2
        else:
            state[i] = 2
    return np.array(state) == 1
