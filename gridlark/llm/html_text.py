"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes a row of leaf blocks: runs of text that no block element interrupts. A block's
features are the tags, classes and ids around it and the look of its text. The field weighs these
features and the change from one block to the next, and Viterbi's algorithm finds the best labelling
of the whole page into text and surroundings. Only what stands in an element of ``HIDDEN`` is left out
before; that an element bears ``hidden``, ``display:none`` or ``aria-hidden="true"`` is a feature like others.

It is trained on the driver on labelled pages of two kinds: pages built from layouts whose parts have
known labels (``layout_pages``), and at most ``MOST_PAGES`` of the given pages, those that mark their
article with an ``article`` or ``main`` element, labelled by it. All pages are then decoded in full.

Defined results: a null or empty page, and one without text blocks, has the empty text; character
references are decoded; white space within a block, line breaks by tags included, is one space; every
row gets one row; an empty table gives none; other columns of the input do not matter.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAGES = 300
LONGEST_PAGE = 200_000
DEEPEST = 200
BUILT_PAGES = 500
BATCH_PAGES = 64

# Elements that do not interrupt a run of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr"
    # Formulas stand in the line.
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms"
    " mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is not text of the page.
HIDDEN = frozenset("head script style noscript template svg iframe object textarea select title".split())
# Elements that a head may hold; any other one, and text, ends it.
METADATA = frozenset("head title base basefont bgsound link meta script style noscript noframes template".split())
RAW = frozenset("script style textarea title".split())
# Elements that end when one of the same group starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tr select body html article section div main aside nav".split())

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z]))")
NAME_END = re.compile(r"[\s/>]")
CLOSER = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
# Stands among the name parts of an element that is not shown; no class or id gives it.
UNSEEN = "!unseen"
NAME = re.compile(r"[a-z]+")


class Around:
    """An open element; with its ``parent`` and so on up it is the chain of a block's ancestors.

    Blocks of one element share it, so deep pages need no copy of their ancestors for each block.
    """

    __slots__ = ("parent", "tag", "parts", "depth", "told")

    def __init__(self, parent: Around | None, tag: str, parts: tuple[str, ...]):
        self.parent, self.tag, self.parts, self.told = parent, tag, parts, None
        self.depth = 1 + (parent.depth if parent else 0)


def chain(around: Around | None) -> list[Around]:
    """Ancestors, outermost first."""
    found = []
    while around:
        found.append(around)
        around = around.parent
    return found[::-1]


@dataclass(slots=True)
class Block:
    text: str
    around: Around | None
    linked: int  # characters inside links


class Scanner:
    """Finds markup from any place of a page; every character is looked at a bounded number of times.

    A tag ends at the first ``>`` outside quotes. Where it ends, seen from a quote or ``>``, is worked out
    once for all of them, from the last to the first.
    """

    def __init__(self, page: str):
        self.page = page
        self.closers = [m.start() for m in CLOSER.finditer(page)]
        self.ends = [-1] * (len(self.closers) + 1)
        later = {'"': len(self.closers), "'": len(self.closers)}
        for i in range(len(self.closers) - 1, -1, -1):
            sign = page[self.closers[i]]
            if sign == ">":
                self.ends[i] = self.closers[i] + 1
            else:
                # Behind the quote that closes this one.
                self.ends[i] = self.ends[min(later[sign] + 1, len(self.closers))]
                later[sign] = i
        self.last_close = page.rfind(">")
        self.breaks = [m.start() for m in NAME_END.finditer(page)]

    def _tag_end(self, at: int) -> int:
        return self.ends[bisect_left(self.closers, at)]

    def markup(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Next markup from ``at``: start, end, slash, name and attributes; no name for comments and such."""
        page = self.page
        while m := OPENING.search(page, at):
            start = m.start()
            if not m[2]:
                if m[0] == "<!--":
                    end = page.find("-->", start + 4)
                    return start, len(page) if end < 0 else end + 3, "", "", ""
                end = page.find(">", start) if self.last_close > start else -1
                if end >= 0:
                    return start, end + 1, "", "", ""
            else:
                name = m.end() - 1
                after = bisect_left(self.breaks, name)
                stop = self.breaks[after] if after < len(self.breaks) else len(page)
                end = self._tag_end(stop)
                if end < 0:
                    # A quote within the name may begin an attribute.
                    quote = bisect_left(self.closers, name)
                    if quote < len(self.closers) and self.closers[quote] < stop:
                        stop, end = self.closers[quote], self.ends[quote]
                if end >= 0:
                    return start, end, m[1], page[name:stop].lower(), page[stop : end - 1]
            at = start + 1
        return None


def names_of(attributes: str) -> tuple[str, ...]:
    """Parts of class, id and role, and ``UNSEEN`` for an element that its attributes hide."""
    names, unseen = [], False
    for a in ATTRIBUTE.finditer(attributes):
        key, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
        if key in ("class", "id", "role"):
            names += NAME.findall(value)
        elif key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and NO_DISPLAY.search(value)):
            unseen = True
    return (*names, UNSEEN) if unseen else tuple(names)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    found: list[Block] = []
    stack: list[Around] = []
    # Places in the stack of each tag's open elements.
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = links = hidden = at = 0
    scanner = Scanner(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, stack[-1] if stack else None, linked))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if stack and stack[-1].tag == "head" and not piece.isspace() and piece:
            close(len(stack) - 1)
        if piece and not hidden:
            piece = html.unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece)

    def close(upto: int) -> None:
        nonlocal hidden
        while len(stack) > upto:
            tag = stack.pop().tag
            places[tag].pop()
            hidden -= tag in HIDDEN

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while m := scanner.markup(at):
        start, end, slash, tag, attributes = m
        text(page[at:start])
        at = end
        if not tag:
            continue
        if not slash and stack and stack[-1].tag == "head" and tag not in METADATA:
            close(len(stack) - 1)
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                links = max(0, links + (-1 if slash else 1))
            continue
        flush()
        links = 0
        if slash:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if stack and stack[-1].tag == "p":
            close(len(stack) - 1)
        if group := CLOSES.get(tag):
            inner = innermost(group)
            if inner > innermost(SCOPE - group):
                close(inner)
        if tag in RAW:
            ending = re.compile(rf"</{tag}\b", re.I).search(page, at)
            close_at = page.find(">", ending.end()) if ending else -1
            at = close_at + 1 if close_at >= 0 else len(page)
            continue
        if tag in VOID:
            continue
        if tag == "body":
            close(0)
        places.setdefault(tag, []).append(len(stack))
        stack.append(Around(stack[-1] if stack else None, tag, names_of(attributes)))
        hidden += tag in HIDDEN
    text(page[at:])
    flush()
    return found


# Tags and parts of class names that say what a part of a page is; fixed values.
KINDS = {
    "text": "article main content post entry story body text prose",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager",
    "header": "header masthead topbar banner logo brand hero",
    "footer": "footer bottom copyright legal colophon imprint",
    "side": "aside sidebar side widget related recommended rail more teaser popular trending",
    "notice": "cookie cookies consent notice alert gdpr modal popup overlay newsletter subscribe paywall warning",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion dfp",
    "form": "form search login signup register button input label fieldset",
    "comment": "comment comments discussion replies reply respond disqus feedback review reviews thread",
    "share": "share social sharing follow tags meta byline author date timestamp caption",
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in names.split()}


def kinds_of(element: Around) -> list[str]:
    return [KIND_OF[n] for n in (element.tag, *element.parts) if n in KIND_OF]


def own_features(block: Block, place: int, count: int) -> list[str]:
    """Features of the block itself and of its innermost element's tag."""
    names = ["any", f"tag={block.around.tag if block.around else ''}"]
    words = block.text.split()
    dense = block.linked / max(1, len(block.text))
    names.append(f"words={min(6, len(words).bit_length())}")
    names.append(f"links={'all' if dense > 0.8 else 'many' if dense > 0.3 else 'few' if dense else 'no'}")
    names.append(f"stop={block.text[-1] in '.!?:;\"”’)'}")
    if "©" in block.text or "copyright" in block.text.lower():
        names.append("mark=copyright")
    names.append(f"place={min(3, place)}")
    names.append(f"left={min(3, count - 1 - place)}")
    return names


def last_features(nearest: Iterable[str], bad: bool) -> list[str]:
    """Features of all ancestors together: the nearest page part, and whether any is no part of a text."""
    near = [f"near={k}" for k in dict.fromkeys(nearest)] or ["near=none"]
    # A page part inside the article, or the article inside such a part.
    return [*near, "bad=" + ("yes" if bad else "no")]


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    rows = []
    for i, block in enumerate(blocks):
        elements = chain(block.around)
        kinds = [kinds_of(e) for e in elements]
        flat = [k for ks in kinds for k in ks]
        names = own_features(block, i, len(blocks))
        names += {f"in={e.tag}" for e in elements} | {f"kind={k}" for k in flat}
        names += [f"name={n}" for e in elements for n in e.parts]
        names += last_features(next((ks for ks in reversed(kinds) if ks), ()), any(k != "text" for k in flat))
        rows.append(names)
    return rows


@dataclass
class Field:
    """Weights of the field: per feature and label, and for each change of label."""

    index: dict[str, int]
    weights: np.ndarray  # [features, 2]
    change: np.ndarray  # [2, 2]
    begin: np.ndarray  # [2]

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[j for j in map(get, r) if j is not None]].sum(axis=0) for r in rows])

    def _told(self, around: Around | None) -> tuple[float, float, frozenset[str], tuple[str, ...], bool]:
        """What a chain of ancestors adds up to: both sums, features that count once, nearest kinds, bad.

        Worked out once for each element, from its parent's; the features are those of the field.
        """
        todo = []
        while around and around.told is None:
            todo.append(around)
            around = around.parent
        told = around.told if around else (0.0, 0.0, frozenset(), (), False)
        for element in reversed(todo):
            zero, one, once, nearest, bad = told
            kinds = kinds_of(element)
            fresh = {f for f in (f"in={element.tag}", *(f"kind={k}" for k in kinds)) if f in self.index} - once
            for name in (*fresh, *(f"name={n}" for n in element.parts)):
                if (j := self.index.get(name)) is not None:
                    zero, one = zero + self.both[j][0], one + self.both[j][1]
            bad = bad or any(k != "text" for k in kinds)
            told = element.told = (zero, one, once | fresh if fresh else once, tuple(kinds) or nearest, bad)
        return told

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        """The blocks' ``emissions``, at a cost that does not grow with their depth."""
        found = []
        for i, block in enumerate(blocks):
            zero, one, _, nearest, bad = self._told(block.around)
            for name in (*own_features(block, i, len(blocks)), *last_features(nearest, bad)):
                if (j := self.index.get(name)) is not None:
                    zero, one = zero + self.both[j][0], one + self.both[j][1]
            found.append((zero, one))
        return found

    @cached_property
    def both(self) -> list[list[float]]:
        return self.weights.tolist()

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The labels of a page's blocks."""
        return self.best(self.scores(blocks))

    def best(self, scores: list[tuple[float, float]]) -> list[bool]:
        """Viterbi: the labelling of the page with the highest score."""
        if not scores:
            return []
        (stay0, to1), (to0, stay1) = self.change.tolist()
        zero, one = scores[0][0] + self.begin[0], scores[0][1] + self.begin[1]
        came = []
        for e0, e1 in scores[1:]:
            a, b = zero + stay0, one + to0
            c, d = zero + to1, one + stay1
            came.append((b > a, d > c))
            zero, one = max(a, b) + e0, max(c, d) + e1
        labels = [one > zero]
        for from0, from1 in reversed(came):
            labels.append(from1 if labels[-1] else from0)
        return labels[::-1]

    def text(self, page: str) -> str:
        blocks = blocks_of(page)
        return "\n".join(b.text for b, keep in zip(blocks, self.decode(blocks)) if keep)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.1, ridge: float = 2e-3) -> Field:
    """Maximum conditional likelihood by gradient steps; pages are handled side by side."""
    pages = [p for p in pages if p[1]]
    index = {name: i for i, name in enumerate(sorted({n for rows, _ in pages for r in rows for n in r}))}
    count, longest = len(pages), max(len(y) for _, y in pages)
    lengths = np.array([len(y) for _, y in pages])
    gold = np.zeros((count, longest), int)
    for i, (_, y) in enumerate(pages):
        gold[i, : len(y)] = y
    slot = np.concatenate([i * longest + np.repeat(np.arange(len(r)), [len(x) for x in r]) for i, (r, _) in enumerate(pages)])
    feature = np.array([index[n] for rows, _ in pages for r in rows for n in r])
    valid = np.arange(longest) < lengths[:, None]
    p = {"w": np.zeros((len(index), 2)), "c": np.zeros((2, 2)), "b": np.zeros(2)}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    hot = np.eye(2)[gold] * valid[:, :, None]
    both = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum(axis=(0, 1))
    for step in range(1, rounds + 1):
        e = np.stack([np.bincount(slot, p["w"][feature, k], count * longest) for k in range(2)], axis=1).reshape(count, longest, 2)
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + p["b"]
        for t in range(1, longest):
            new = _log_sum(ahead[:, t - 1, :, None] + p["c"], 1) + e[:, t]
            ahead[:, t] = np.where(valid[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _log_sum(p["c"] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(valid[:, t + 1, None], new, 0.0)
        total = _log_sum(ahead[:, -1], 1)
        likely = np.exp(ahead + back - total[:, None, None]) * valid[:, :, None]
        pair = ahead[:, :-1, :, None] + p["c"] + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pairs = (np.exp(np.minimum(pair, 0)) * valid[:, 1:, None, None]).sum(axis=(0, 1))
        miss = (likely - hot).reshape(-1, 2)
        grad = {
            "w": np.stack([np.bincount(feature, miss[slot, k], len(index)) for k in range(2)], axis=1),
            "c": pairs - both,
            "b": (likely - hot)[:, 0].sum(axis=0),
        }
        for k, g in grad.items():
            g = g / count + ridge * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(index, p["w"], p["c"], p["b"])


# Layouts: parts that surround an article, by kind; {} takes words.
SURROUNDINGS = {
    "menu": ["<nav><ul>{li}</ul></nav>", '<div class="{c}"><a href="/">{s}</a> <a href="/x">{s}</a></div>', '<ul class="{c}">{li}</ul>'],
    "header": ["<header><p>{s}</p></header>", '<div class="{c}"><span>{s}</span></div>', '<header class="{c}"><h2>{s}</h2>{s}</header>'],
    "footer": ["<footer>&copy; {s} &middot; {m}</footer>", '<div class="{c}"><p>{m}</p><p>{s}</p></div>', "<footer><ul>{li}</ul><p>{s}</p></footer>"],
    "side": ["<aside><h3>{s}</h3><ul>{li}</ul></aside>", '<div class="{c}"><h4>{s}</h4><p>{m}</p></div>', "<aside><p>{m}</p></aside>"],
    "notice": ['<div class="{c}"><p>{m}</p><button>{s}</button></div>', '<div id="{c}">{m}</div>', '<section class="{c}">{m}</section>'],
    "advert": ['<div class="{c}">{m}</div>', '<div class="{c}"><p>{m}</p></div>', '<section id="{c}"><a href="/b">{m}</a></section>'],
    "form": ["<form><label>{s}</label><input><button>{s}</button></form>", '<form class="{c}"><p>{m}</p></form>'],
    "comment": ['<section class="{c}"><h3>{s}</h3><p>{m}</p><p>{l}</p></section>', '<div id="{c}"><div class="comment"><p>{l}</p></div></div>', '<ol class="{c}"><li><p>{l}</p></li></ol>'],
    "share": ['<div class="{c}">{s}</div>', '<p class="{c}">{s}</p>'],
    "unseen": ["<div hidden><p>{m}</p></div>", '<p hidden="">{l}</p>', '<div style="display:none"><p>{l}</p></div>', '<section style="margin:0; display: none">{m}</section>', '<div aria-hidden="true">{s}</div>'],
}
ARTICLES = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="{c}">{}</div>', '<div id="{c}"><section>{}</section></div>', '<section class="{c}">{}</section>', "<div>{}</div>"]
PARAGRAPHS = ["<p>{l}</p>", "<p>{m}</p>", "<p>{s}</p>", "<h2>{s}</h2>", "<ul><li>{m}</li><li>{s}</li></ul>", "<blockquote><p>{l}</p></blockquote>", "<p><b>{l}<br><p>{m}</p>", "<div>{l}</div>", '<p>{m} <a href="/y">{s}</a> {m}</p>', "<pre>{m}</pre>", "<table><tr><td>{s}</td><td>{m}</td></tr></table>"]


def layout_pages(number: int, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Pages put together from layouts, as features and labels; blocks of the article carry a mark."""
    rng = random.Random(seed)

    def words(low: int, high: int, end: str) -> str:
        return " ".join("".join(rng.choice("aeinorstlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))).capitalize() + end

    def filled(part: str, kind: str) -> str:
        part = part.replace("{li}", "".join(f'<li><a href="/z">{words(1, 3, "")}</a></li>' for _ in range(rng.randint(2, 7))))
        if "{c}" in part:
            part = part.replace("{c}", rng.choice(KINDS[kind].split()))
        for slot, low, high, end in (("{s}", 1, 5, ""), ("{m}", 4, 25, "."), ("{l}", 20, 90, ".")):
            while slot in part:
                part = part.replace(slot, words(low, high, rng.choice((end, end, "."))), 1)
        return part

    def around(kind: str) -> str:
        return filled(rng.choice(SURROUNDINGS[kind]), kind)

    pages = []
    for _ in range(number):
        before = [around(k) for k in ("menu", "header", "notice", "advert", "form", "unseen") if rng.random() < 0.5]
        after = [around(k) for k in ("comment", "side", "advert", "share", "form", "notice", "footer", "unseen") if rng.random() < 0.5]
        body = [f"\x02{filled(rng.choice(PARAGRAPHS), 'text')}\x03" for _ in range(rng.randint(1, 9))]
        title = f"\x02<h1>{words(2, 9, '')}</h1>\x03"
        body.insert(0, title if rng.random() < 0.7 else f"<header>{title}</header>" if rng.random() < 0.5 else "")
        for kind in ("advert", "share", "side", "comment", "form", "notice", "unseen"):
            if rng.random() < 0.12:
                body.insert(rng.randint(1, len(body)), around(kind))
        article = filled(rng.choice(ARTICLES).replace("{}", "\x04"), "text").replace("\x04", "".join(body))
        rng.shuffle(before)
        page = "<html><head><title>x</title></head><body>" + "".join([*before, article, *after]) + "</body></html>"
        # Marked stretches hold whole blocks; the marks become a word that is taken off again.
        page = re.sub("\x02(.*?)\x03", lambda m: re.sub(r">([^<\x02\x03]+)(?=<)", ">\x05\\1", m[1]), page, flags=re.S)
        blocks = blocks_of(page)
        labels = [int("\x05" in b.text) for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace("\x05", " ").split()) or "x"
        pages.append((features(blocks), labels))
    return pages


def marked_page(page: str) -> tuple[list[list[str]], list[int]] | None:
    """Features and labels of a page that marks its article itself; None for one that does not.

    Pages nested deeper than ``DEEPEST`` are no samples.
    """
    blocks = blocks_of(page)
    if any(b.around and b.around.depth > DEEPEST for b in blocks):
        return None
    labels = []
    for b in blocks:
        elements = chain(b.around)
        kinds = {k for e in elements for k in kinds_of(e)}
        inside = any(e.tag in ("article", "main") for e in elements)
        unseen = any(UNSEEN in e.parts for e in elements)
        labels.append(int(inside and not unseen and not kinds - {"text"}))
    return (features(blocks), labels) if any(labels) else None


def fit(pages: DataFrame, most: int = MOST_PAGES) -> Field:
    """The field, from built layouts and at most ``most`` given pages.

    The pages are chosen by numbers alone; only the chosen ones' html is sent to the driver.
    """
    numbers = pages.filter(F.length("html") <= LONGEST_PAGE).select("page_id", F.xxhash64("html").alias("of"))
    chosen = numbers.orderBy(F.xxhash64("page_id"), "page_id", "of").limit(most)
    chosen = chosen.select(F.col("page_id").alias("chosen"), F.col("of").alias("chosen_of")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("chosen")) & (F.col("of") == F.col("chosen_of"))
    rows = pages.select("page_id", "html", F.xxhash64("html").alias("of")).join(F.broadcast(chosen), same)
    found = rows.groupBy("page_id", "of").agg(F.first("html").alias("html")).orderBy(F.xxhash64("page_id"), "page_id", "of")
    marked = [marked_page(row.html) for row in found.collect()]
    return train([*layout_pages(BUILT_PAGES), *(m for m in marked if m)])


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(at, BATCH_PAGES)
                texts = [field.text(page) if page else "" for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn(
        "n_chars", F.length("text").cast("long")
    )
