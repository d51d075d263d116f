"""Leaf blocks of HTML pages: texts between the borders of block elements, with what their ancestors say.

A small reader of tags, not a browser: it knows void, raw-text and block elements, and which elements end an
open paragraph, list item, row or cell. Broken markup is read on in the way browsers do where that decides
over blocks: unclosed paragraphs and cells end at the next one, unknown end tags are skipped, an unclosed
comment or script swallows the rest. Time and memory are linear in the page, whatever its nesting: an element
carries the sum of its ancestors' marks, and searches for open elements only pass what they close.
"""

from __future__ import annotations

import functools
import html as entities
import re
from typing import NamedTuple

# Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("canvas datalist noscript object select svg template".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CELL_BORDER = frozenset("caption table td th button".split())
# What ends an open element of each group when it starts, and inside what an open one can't be seen.
_GROUPS = (
    (frozenset("p"), BLOCK - frozenset("body button caption head html legend option tbody td tfoot th thead tr".split()), _CELL_BORDER),
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    (frozenset("dd dt".split()), frozenset("dd dt".split()), frozenset("dl table td th".split())),
    (frozenset("td th".split()), frozenset("td th tr tbody thead tfoot".split()), frozenset("table tr".split())),
    (frozenset(["tr"]), frozenset("tr tbody thead tfoot".split()), frozenset(["table"])),
)
_NONE = (-1,) * len(_GROUPS)

# Marks of ancestors: elements, and what class, id and role names say.
TAGS = "article main section nav header footer aside form ul ol table blockquote pre figure figcaption div p li h1 h2 td dl button label a details address".split()
NAMES = {
    "content": "article content post entry story main body text prose copy blog reading",
    "nav": "nav navigation navbar menu breadcrumb crumb crumbs pagination pager toc tabs sitemap skip topnav",
    "head": "header masthead banner logo topbar brand site-header",
    "foot": "footer foot copyright colophon legal imprint bottom",
    "side": "sidebar aside side widget related recommended rail popular trending teaser more secondary complementary",
    "advert": "ad ads advert advertisement adverts advertising sponsor sponsored promo promoted promotion commercial banner",
    "notice": "cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup paywall toast disclaimer",
    "comment": "comment comments reply replies discussion disqus respond review reviews feedback thread",
    "share": "share sharing social follow tools toolbar",
    "form": "form search login register contact poll survey",
    "hidden": "hidden invisible",
}
_TAG_BIT = {t: 1 << k for k, t in enumerate(TAGS)} | {"h3": 1 << TAGS.index("h2"), "h4": 1 << TAGS.index("h2"), "h5": 1 << TAGS.index("h2"), "h6": 1 << TAGS.index("h2"), "th": 1 << TAGS.index("td")}
_NAME_BIT = {n: 1 << len(TAGS) + k for k, n in enumerate(NAMES)}
_OF_WORD: dict[str, int] = {}
for _kind, _words in NAMES.items():
    for _word in _words.split():
        _OF_WORD[_word] = _OF_WORD.get(_word, 0) | _NAME_BIT[_kind]
MARKS = len(TAGS) + len(NAMES)
_TAGS_ALL = (1 << len(TAGS)) - 1
_GOOD = _TAG_BIT["article"] | _TAG_BIT["main"] | _NAME_BIT["content"]
_BAD = sum(_TAG_BIT[t] for t in "nav header footer aside form button label".split()) | sum(b for n, b in _NAME_BIT.items() if n != "content")

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


class Block(NamedTuple):
    text: str  # decoded, white space turned into single spaces
    marks: int  # of all ancestors
    own: int  # of its block element
    near: int  # 1 if the nearest telling ancestor speaks for the main text, 2 if against it
    linked: int  # characters inside links


def _said(attributes: str) -> int:
    """Marks of the attributes of a tag."""
    return _said_often(attributes) if len(attributes) < 200 else _marks(attributes)


def _marks(attributes: str) -> int:
    marks = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for word in _WORDS.findall(value):
                marks |= _OF_WORD.get(word.lower(), 0)
        elif name == "style" and "display:none" in value.replace(" ", "").lower() or name == "hidden" or name == "aria-hidden" and value == "true":
            marks |= _NAME_BIT["hidden"]
    return marks


_said_often = functools.lru_cache(maxsize=10_000)(_marks)


class _Open(NamedTuple):
    name: str
    marks: int
    own: int
    near: int
    groups: tuple[int, ...]  # where the innermost open element of each group is
    block: bool


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order."""
    reader = _Reader()
    reader.read(page)
    return reader.found


class _Reader:
    def __init__(self):
        self.found: list[Block] = []
        self.open = [_Open("", 0, 0, 0, _NONE, True)]
        self.counts: dict[str, int] = {}  # open block elements by name
        self.inline: list[dict[str, int]] = [{}]  # open other elements by name, inside each open block element
        self.unseen = 0
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0

    def read(self, page: str) -> None:
        at, bare = 0, False
        while True:
            tag = page.find("<", at)
            if tag < 0 or tag + 1 == len(page):
                self.text(page[at:])
                break
            after = page[tag + 1]
            closing = after == "/"
            name = _NAME.match(page, tag + 1 + closing)
            if name is None:
                if after not in "!?/":
                    self.text(page[at : tag + 1])  # a bare sign
                    at = tag + 1
                    continue
                self.text(page[at:tag])
                comment = page.startswith("<!--", tag)
                stop = page.find("-->", tag + 2) if comment else page.find(">", tag)
                if stop < 0:
                    break
                at = stop + (3 if comment else 1)
                continue
            self.text(page[at:tag])
            rest = None if bare else _REST.match(page, name.end())
            if rest is None:
                bare = True  # quotes don't pair from here to the end: tags end at the next sign
                stop = page.find(">", name.end()) + 1
                if not stop:
                    break
            else:
                stop = rest.end()
            word = name[0].lower()
            at = stop
            if closing:
                self.close(word)
            elif word in RAW:
                end = _END[word].search(page, stop)
                if end is None:
                    break
                at = page.find(">", end.end()) + 1
                if not at:
                    break
            else:
                self.start(word, page[name.end() : stop - 1])
        self.flush()

    def text(self, run: str) -> None:
        if run and not self.unseen:
            run = entities.unescape(run)
            self.pieces.append(run)
            if self.links:
                self.linked += len(run)

    def flush(self) -> None:
        """The text read since the last border is a block of the innermost block element."""
        if self.pieces and not self.unseen:
            text = " ".join("".join(self.pieces).split())
            if text:
                top = self.open[-1]
                self.found.append(Block(text, top.marks, top.own, top.near, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def start(self, word: str, attributes: str) -> None:
        if word == "br" or word == "wbr":
            self.text(" " if word == "br" else "")
            return
        unseen = word in UNSEEN
        block = word in BLOCK or unseen
        if block and not unseen:
            self.flush()
            for k, (_, enders, _) in enumerate(_GROUPS):
                if word in enders and self.open[-1].groups[k] >= 0:
                    self.cut(self.open[-1].groups[k])
            if word in ("html", "head", "body"):
                return
        elif word == "a" and self.inline[-1].get("a"):
            self.close("a")
        if word in VOID or unseen and attributes.endswith("/"):
            return
        top = self.open[-1]
        own = _TAG_BIT.get(word, 0) | (_said(attributes) if attributes else 0)
        near = 2 if own & _BAD else 1 if own & _GOOD else top.near
        groups = tuple(len(self.open) if word in members else -1 if word in borders else g for g, (members, _, borders) in zip(top.groups, _GROUPS, strict=True))
        # an element within a line counts as one's own only where it holds the whole block; blocks look at blocks
        if block:
            self.counts[word] = self.counts.get(word, 0) + 1
            self.inline.append({})
            self.unseen += unseen
            self.open.append(_Open(word, top.marks | own, own, near, groups, True))
        else:
            here = self.inline[-1]
            here[word] = here.get(word, 0) + 1
            self.links += word == "a"
            self.open.append(_Open(word, top.marks | own, top.own | own & _TAGS_ALL, near, groups, False))

    def close(self, word: str) -> None:
        if word in BLOCK or word in UNSEEN:
            if word in BLOCK:
                self.flush()
            if not self.counts.get(word):
                return
            for k, (members, _, _) in enumerate(_GROUPS):
                if word in members and self.open[-1].groups[k] < 0:
                    return  # open, but beyond a border
            at = len(self.open) - 1
            while self.open[at].name != word:
                at -= 1
            self.cut(at)
        elif self.inline[-1].get(word):
            at = len(self.open) - 1
            while self.open[at].name != word:
                at -= 1
            self.cut(at)

    def cut(self, size: int) -> None:
        """Close all but the first ``size`` open elements."""
        while len(self.open) > size:
            gone = self.open.pop()
            if gone.block:
                self.counts[gone.name] -= 1
                self.inline.pop()
                self.unseen -= gone.name in UNSEEN
            else:
                self.inline[-1][gone.name] -= 1
                self.links -= gone.name == "a"
