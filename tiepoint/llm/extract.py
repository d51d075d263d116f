"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of blocks (``dom.blocks``), each to be labelled as main text or not. A block's features
are the elements and the class, id and role names above it, what the nearest telling ancestor says, and its
text's length, links, marks and neighbours; no word of any language is a feature. The field has a weight for
each feature and for each pair of successive labels; it is trained on labelled pages by the gradient of the
conditional likelihood (forward and backward sums) and decoded by Viterbi.

Labelled pages are pairs of html and main text, a line a block. ``labelled_pages`` builds some by a rule, with
invented words in layouts of many sorts; ``train`` takes any others as well, at most ``SAMPLE`` of them, chosen
by hash, so that what the driver gathers is bounded. Every page is read and decoded whole, in its task; pages
aren't shuffled. Memory is that of a page's blocks and of features of ``CHUNK`` blocks.

Cases: null or empty html gives an empty text; pages without main text too; rows that repeat are extracted
each; nulls in other columns are kept; an empty table gives no rows; further columns of ``pages`` are kept,
except ones named like the results of ``extract``; without labelled pages every block is main text.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import dom
from .storage import table

SAMPLE = 2_000  # labelled pages at most
PAGES = 500  # that are built by a rule
STEPS, RATE, DECAY = 150, 0.1, 1e-3
CHUNK = 4_000  # blocks whose features are held at once

_LENGTHS = (15, 40, 100, 250, 800)
_LINKS = (0.0, 0.33, 0.8)
_TEXT = len(_LENGTHS) + 1 + len(_LINKS) + 1 + 6
_PLACE = 12
FEATURES = 2 * dom.MARKS + 3 + _TEXT + _PLACE + 1


# ---- features ------------------------------------------------------------------------------------


def _text_bits(text: str, linked: int) -> int:
    n = len(text)
    bits = 1 << sum(n > x for x in _LENGTHS)
    at = len(_LENGTHS) + 1
    bits |= 1 << at + sum(linked > n * x for x in _LINKS)
    at += len(_LINKS) + 1
    end = text.rstrip("\"'»”’)]")[-1:]
    for test in (
        end in ".!?…。！？؟।", end in ":;,", any(c in text for c in ",;，、،"), text[:1].isupper(),
        "©" in text, n < 200 and sum(map(str.isdigit, text)) * 5 > n,
    ):
        if test:
            bits |= 1 << at
        at += 1
    return bits


_LONG = sum(1 << k for k in range(3, len(_LENGTHS) + 1))
_LINKED = 1 << len(_LENGTHS) + len(_LINKS)
_H1 = 1 << dom.TAGS.index("h1")


def _place_bits(page: list[dom.Block], texts: list[int]) -> list[int]:
    """Neighbours and position."""
    n = len(page)
    first_title = next((k for k, b in enumerate(page) if b.marks & _H1), n)
    seen: dict[str, int] = {}
    for b in page:
        seen[b.text] = seen.get(b.text, 0) + 1
    found = []
    for k, b in enumerate(page):
        left, right = texts[k - 1] if k else 0, texts[k + 1] if k + 1 < n else 0
        tests = (
            k == 0, k == n - 1, k * 10 < n, k * 10 >= 9 * n, k < first_title < n, k > first_title, seen[b.text] > 1,
            left & _LONG, right & _LONG, left & _LINKED, right & _LINKED, k > 0 and page[k - 1].marks == b.marks,
        )
        found.append(sum(1 << j for j, t in enumerate(tests) if t))
    return found


def _spread(bits: list[int], width: int) -> np.ndarray:
    return ((np.asarray(bits, dtype=np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def features(page: list[dom.Block]) -> Iterator[np.ndarray]:
    """Rows of ``FEATURES`` numbers for the blocks of a page, ``CHUNK`` at a time."""
    texts = [_text_bits(b.text, b.linked) for b in page]
    places = _place_bits(page, texts)
    for k in range(0, len(page), CHUNK):
        own = page[k : k + CHUNK]
        yield np.concatenate(
            [
                _spread([b.marks for b in own], dom.MARKS), _spread([b.own for b in own], dom.MARKS), _spread([1 << b.near for b in own], 3),
                _spread(texts[k : k + CHUNK], _TEXT), _spread(places[k : k + CHUNK], _PLACE), np.ones((len(own), 1), np.float32),
            ],
            axis=1,
        )


# ---- the field -----------------------------------------------------------------------------------


class Field(NamedTuple):
    weights: np.ndarray  # what speaks for main text
    steps: np.ndarray  # of label pairs, 2 x 2

    def decode(self, page: list[dom.Block]) -> list[bool]:
        """The likeliest labels of a page's blocks (Viterbi); ties go to main text."""
        scores = np.concatenate([x @ self.weights for x in features(page)]).tolist() if page else []
        (same_no, no_yes), (yes_no, same_yes) = self.steps.tolist()
        no = yes = 0.0
        back = []
        for k, score in enumerate(scores):
            if k:
                from_yes = yes + yes_no > no + same_no, yes + same_yes >= no + no_yes
                no, yes = max(no + same_no, yes + yes_no), max(no + no_yes, yes + same_yes)
                back.append(from_yes)
            yes += score
        labels, at = [], yes >= no
        for from_yes in reversed(back):
            labels.append(at)
            at = from_yes[at]
        return [at, *reversed(labels)] if scores else []


def _sums(scores: np.ndarray, mask: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log normalizers, probabilities of main text by block, and expected label pairs, of padded pages."""
    pages, longest = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    ahead, behind = np.empty_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, longest):
        moved = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + emit[:, t]
        ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        coming = behind[:, t + 1] + emit[:, t + 1]
        moved = np.logaddexp(steps[:, 0] + coming[:, :1], steps[:, 1] + coming[:, 1:])
        behind[:, t] = np.where(mask[:, t + 1, None], moved, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    likely = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * mask
    pairs = ahead[:, :-1, :, None] + steps + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
    return total, likely, (np.exp(pairs) * mask[:, 1:, None, None]).sum((0, 1))


def fit(pages: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Weights of greatest conditional likelihood for pages of ``(features, labels)``, by gradient steps (Adam)."""
    pages = [(x, y) for x, y in pages if len(y)]
    if not pages:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)))
    longest = max(len(y) for _, y in pages)
    mask, truth = np.zeros((len(pages), longest), bool), np.zeros((len(pages), longest))
    for k, (_, y) in enumerate(pages):
        mask[k, : len(y)], truth[k, : len(y)] = True, y
    x = np.concatenate([x for x, _ in pages])
    both = mask[:, 1:]
    seen = np.asarray([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    w, m, v = (np.zeros(FEATURES + 4) for _ in range(3))
    scores = np.zeros_like(truth)
    for t in range(1, STEPS + 1):
        scores[mask] = x @ w[:FEATURES].astype(np.float32)
        _, likely, pairs = _sums(scores, mask, w[FEATURES:].reshape(2, 2))
        g = np.append(x.T @ (likely - truth)[mask].astype(np.float32), pairs - seen) / len(pages) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(w[:FEATURES], w[FEATURES:].reshape(2, 2))


def labels(page: list[dom.Block], text: str) -> np.ndarray:
    """Which blocks are lines of ``text``, matched in order from the end (a title comes after its copies in menus)."""
    lines = text.split("\n") if text else []
    found = np.zeros(len(page))
    for k in range(len(page) - 1, -1, -1):
        if lines and page[k].text == lines[-1]:
            lines.pop()
            found[k] = 1
    return found


# ---- labelled pages by a rule --------------------------------------------------------------------

_LETTERS = ("aeiou", "bcdfghklmnprstvw"), ("aeiouäöü", "bdfghklmnrstwz"), ("aeiouéèê", "bcdlmnprstv"), ("аеиоуыя", "бвгдзклмнпрст"), ("αεηιου", "βγδθκλμνπρστ")


class _Maker:
    """One page: pieces of html and the lines of its main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        vowels, others = self.r.choice(_LETTERS)
        self.words = ["".join(self.r.choice(others) + self.r.choice(vowels) for _ in range(self.r.randint(1, 4))) for _ in range(150)]
        self.lines: list[str] = []

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.phrase(2, 16).capitalize() + self.r.choice(["."] * 6 + ["?", "!", ", " + self.phrase(2, 8) + "."]) for _ in range(self.r.randint(low, high)))

    def links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self.phrase(1, 3).capitalize()}</a>' for k in range(n)]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(items)

    def wrap(self, tags: str, names: str, inside: str, bare: float = 0.15) -> str:
        """In an element of ``tags``, mostly with a telling class or id."""
        tag = self.r.choice(tags.split())
        known = tag not in ("div", "section", "ul", "p", "span", "td")
        if self.r.random() < (0.6 if known else bare):
            return f"<{tag}>{inside}</{tag}>"
        prefix = self.r.choice(["", "", "site-", "page-", "main-", "js-", "x-", "the-"])
        return f'<{tag} {self.r.choice(["class", "id", "class"])}="{prefix}{self.r.choice(names.split())}">{inside}</{tag}>'

    def line(self, text: str) -> str:
        self.lines.append(text)
        return text

    def inline(self, text: str) -> str:
        """The same text with links, emphasis and breaks in it."""
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(words))
            words[k] = self.r.choice(['<a href="#">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<br>{}"]).format(words[k])
        return " ".join(words)

    def paragraph(self) -> str:
        kind = self.r.random()
        if kind < 0.7:
            text = self.inline(self.line(self.sentences(1, self.r.choice([1, 2, 8]))))
            return self.r.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"])
        if kind < 0.78:
            return f"<p>{self.line(self.phrase(1, 5))}{self.r.choice(['', '</p>'])}"
        if kind < 0.86:
            return f"<h2>{self.line(self.phrase(2, 7).capitalize())}</h2>"
        if kind < 0.92:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.line(self.sentences(1, 2)))}</li>" for _ in range(self.r.randint(1, 4))) + f"</{tag}>"
        if kind < 0.94:
            return f"<figure><img src='x.png'><figcaption>{self.line(self.sentences(1, 1))}</figcaption></figure>"
        if kind < 0.97:
            return f"<blockquote><p>{self.line(self.sentences(1, 3))}</p></blockquote>"
        return "<table>" + "".join(f"<tr><td>{self.line(self.phrase(1, 3))}</td><td>{self.line(self.phrase(1, 6))}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>"

    def beside(self) -> str:
        """Something that isn't main text."""
        kind = self.r.choice(["advert", "advert", "notice", "form", "side", "share", "comment"])
        if kind == "form":
            return f"<form><label>{self.phrase(1, 3)}</label><input name='q'><button>{self.phrase(1, 2)}</button></form>"
        names = dom.NAMES[kind]
        if kind in ("side", "share"):
            inside = self.links(self.r.randint(1, 6))
            if kind == "side":
                inside = f"<h3>{self.phrase(1, 3)}</h3>" + inside + self.r.choice(["", f"<p>{self.sentences(1, 2)}</p>"])
            return self.wrap("aside div section", names, inside, 0.05)
        if kind == "comment":
            each = [f"<p>{self.phrase(1, 2)}</p><p>{self.sentences(1, 4)}</p>" for _ in range(self.r.randint(1, 5))]
            tag = self.r.choice(["div", "li", "article"])
            inside = f"<h3>{self.phrase(1, 3)}</h3>" + "".join(f"<{tag} class='comment'>{x}</{tag}>" if self.r.random() < 0.7 else x for x in each)
            return self.wrap("div section ol ul", names, inside, 0.0)
        text = self.sentences(1, self.r.choice([1, 3]))
        return self.wrap("div aside section p" if kind == "advert" else "div p section", names, self.r.choice([text, f"<p>{text}</p>"]) if kind != "advert" else text, 0.0)

    def page(self) -> tuple[str, str]:
        r = self.r
        title = self.phrase(2, 9).capitalize()
        before = []
        if r.random() < 0.5:
            before.append(self.wrap("header div", dom.NAMES["head"], r.choice([f"<h1>{self.phrase(1, 3)}</h1>", f'<a href="/">{self.phrase(1, 2)}</a>', f"<p>{self.phrase(2, 6)}</p>"])))
        if r.random() < 0.85:
            before.append(self.wrap("nav nav div ul", dom.NAMES["nav"], self.links(r.randint(2, 9)), 0.3))
        before += [self.beside() for _ in range(r.choice([0, 1, 1, 2]))]
        main = []
        if r.random() < 0.9:
            heading = f"<h1>{self.line(title)}</h1>"
            main.append(r.choice([heading, heading, f"<header>{heading}</header>"]))
        for _ in range(r.choice([0, 1, 2, 5, 12, 25])):
            main.append(self.paragraph())
            if r.random() < 0.06:
                main.append(self.beside())
        inside = "".join(main)
        if r.random() < 0.2:
            inside += self.beside()
        shape = r.random()
        if shape < 0.45:
            inside = f"<article>{inside}</article>"
        elif shape < 0.6:
            inside = f"<main>{r.choice([inside, f'<article>{inside}</article>', f'<div>{inside}</div>'])}</main>"
        elif shape < 0.85:
            inside = self.wrap("div section", "article content post entry story main body", inside, 0.0)
        else:
            inside = self.wrap("div section td", "", f"{inside}", 1.0) if r.random() < 0.7 else inside
        after = [self.beside() for _ in range(r.choice([0, 0, 1, 2, 3]))]
        if r.random() < 0.9:
            after.append(self.wrap("footer footer div", dom.NAMES["foot"], r.choice(["", f"<p>{self.sentences(1, 2)}</p>"]) + r.choice([f"&copy; {self.phrase(1, 3)}", self.links(4), f"&copy; {self.phrase(1, 2)} &middot; {self.sentences(1, 1)}"]), 0.1))
        html = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" + "".join(before) + "<!-- main -->" + inside + "".join(after)
        return html + r.choice(["</body></html>", ""]), "\n".join(self.lines)


def labelled_pages(pages: int = PAGES, seed: int = 1) -> list[tuple[str, str]]:
    """``(html, main text)`` of invented pages."""
    return [_Maker(seed * 1_000_003 + k).page() for k in range(pages)]


# ---- tables --------------------------------------------------------------------------------------


def learn(pages: list[tuple[str, str]]) -> Field:
    found = []
    for html, text in pages:
        page = dom.blocks(html or "")
        if page:
            found.append((np.concatenate([*features(page)]), labels(page, text or "")))
    return fit(found)


@functools.lru_cache(maxsize=1)
def built_in() -> Field:
    return learn(labelled_pages())


def train(labelled: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` rows of ``(html, text)``, chosen by hash."""
    rows = labelled.select("html", "text").orderBy(F.xxhash64("html"), "html", "text").limit(sample).collect()
    return learn([(r.html, r.text) for r in rows])


def main_text(html: str | None, field: Field) -> str:
    page = dom.blocks(html or "")
    return "\n".join(b.text for b, chosen in zip(page, field.decode(page), strict=True) if chosen)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points, in place of ``html``."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [main_text(html.as_py(), field) for html in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=[*kept, "text", "n_chars"])

    schema = StructType([*(pages.schema[c] for c in kept), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*kept, "html").mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), built_in())
