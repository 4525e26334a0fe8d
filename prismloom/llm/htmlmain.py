"""Main text of web pages, by a linear-chain conditional random field over their leaf blocks.

Every leaf block is main text or not. Its score comes from the elements above it (names of tags, words of
their classes and ids), from its text (length, share of links, punctuation, cue words) and from its place (how it
compares with the page's longest block, whether it stands in the element that holds most text); the chain adds what
neighbours say of each other, apart for those of one element and others. Weights are trained by gradient descent on the exact likelihood (forwards and
backwards over the chain) of labelled pages, and the best sequence of labels is found by Viterbi.

``labelled_pages`` makes the labelled pages: layouts drawn at random, whose blocks are known to be main
text or not. Other labelled pages can be given to ``train``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.htmlblocks import Block, blocks
from prismloom.llm.storage import table
from prismloom.llm.words import slices

#: Labelled pages that the model is trained on, rounds of descent, step, and the weight of the ridge.
PAGES, ROUNDS, RATE, RIDGE = 900, 120, 0.1, 2e-4
#: In a labelled page, the character that marks text as main text; it is taken out before training.
MARK = "\ue000"

#: Words that speak of notices, adverts, comments, forms and footers in any place, in lower case.
CUES = re.compile(
    r"cookies?\b|consent\b|privacy\b|copyright\b|all rights reserved\b|subscribe\b|newsletter\b|sign ?(?:up|in)\b|log ?in\b|advert(?:isement)?s?\b|sponsored\b|promoted\b|repl(?:y|ies)\b|comments?\b|share\b|tweet\b|related\b|read more\b|terms\b|search\b|follow us\b|javascript\b|accept\b|menu\b|home\b|skip to\b|©|&copy;"
)
#: What ends a sentence before another.
STOPS = (". ", "! ", "? ", "… ", "。", "！", "？", "। ", "۔ ", "؟ ")
_STOP = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def features(block: Block) -> list[str]:
    """Names of what holds of a block's text and element. Sizes are bytes of UTF-8, so that scripts of many letters compare."""
    text, n = block.text, len(block.text)
    link = block.linked / n
    low = text.lower()
    cues = sum(1 for m in CUES.finditer(low) if not m.start() or not low[m.start() - 1].isalnum())
    words = text.count(" ") + 1
    return [
        f"tag:{block.tag}", f"tag:{block.tag},told:{not TELLING.isdisjoint(block.marks)}", f"links:{0 if link == 0 else 1 if link < 0.5 else 2}", f"stop:{bool(_STOP.search(text))}",
        f"cues:{0 if not cues else 1 if cues * 12 < words else 2}", f"digits:{sum(map(text.count, '0123456789')) * 4 > n}",
        *(f"size>{k}" for k in range(0, len(text.encode("utf-8", "replace")).bit_length(), 2)),
    ]


def places(page: list[Block]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Of each block: names of what its place says, four numbers, and whether the block before shares its element.

    The numbers are logarithms (base 2) without an end: of the block's size, of the longest block over it, of the text
    of the element that holds most over that of the block's own, and of the ends of sentences. Text in links doesn't count.
    """
    size = np.array([len(b.text.encode("utf-8", "replace")) for b in page], dtype=float)
    own = size * [1 - min(1, b.linked / len(b.text)) for b in page] + 1
    held: dict[int, float] = {}
    blocks_in: dict[int, int] = {}
    for b, s in zip(page, own.tolist(), strict=True):
        held[b.home.number] = held.get(b.home.number, 0) + s
        blocks_in[b.home.number] = blocks_in.get(b.home.number, 0) + 1
    most = max(held, key=held.get)
    top = next(b.home for b in page if b.home.number == most)
    longest = int(own.argmax())
    names, near = [], {}
    for i, b in enumerate(page):
        h = b.home
        if h.number not in near:
            kin = "same" if h is top else "inside" if h.within(top) else "kin" if h.around is top.around else "around" if top.within(h) else "apart"
            near[h.number] = [f"home:{kin}", f"alone:{blocks_in[h.number] == 1}", f"home:{kin},alone:{blocks_in[h.number] == 1}"]
        names.append([*near[h.number], f"side:{'at' if i == longest else 'before' if i < longest else 'after'}"])
    ends = np.array([sum(map(b.text.count, STOPS)) for b in page])
    numbers = np.log2(np.stack([size + 1, own[longest] / own, held[most] / np.array([held[b.home.number] for b in page]), ends + 1], axis=1)) / 4
    together = np.array([0, *(int(a.home is b.home) for a, b in zip(page, page[1:]))])
    return names, numbers, together


#: Names of the numbers of a place among the weights.
NUMBERS = ("n:size", "n:longest", "n:held", "n:ends")


@dataclass
class Model:
    """Score of main text over other text by feature, and by (same element or not, label before, label); then of the first label."""

    weights: dict[str, float]
    steps: np.ndarray
    first: np.ndarray

    def scores(self, page: list[Block]) -> tuple[list[float], list[int]]:
        """The score of each block, and whether it shares its element with the block before."""
        get, above = self.weights.get, {}  # marks are few: the model knows some hundreds
        names, numbers, together = places(page)
        out = (numbers @ [get(k, 0.0) for k in NUMBERS] + get("bias", 0.0)).tolist()
        for i, b in enumerate(page):
            if b.marks not in above:
                above[b.marks] = sum(get(m, 0.0) for m in b.marks)
            out[i] += above[b.marks] + sum(get(f, 0.0) for f in features(b)) + sum(get(f, 0.0) for f in names[i])
        return out, together.tolist()

    def labels(self, page: list[Block]) -> list[bool]:
        """The best sequence of labels, by Viterbi. A tie is not main text."""
        if not page:
            return []
        steps = self.steps.tolist()
        no, yes = self.first.tolist()
        scores, together = self.scores(page)
        yes += scores[0]
        back = []
        for s, kind in zip(scores[1:], together[1:], strict=True):
            (a, b), (c, d) = steps[kind]
            to_no, to_yes = yes + c > no + a, yes + d > no + b
            back.append((to_no, to_yes))
            no, yes = max(no + a, yes + c), max(no + b, yes + d) + s
        out = [yes > no]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """The model of greatest penalised likelihood, by Adam over all pages. Pages without blocks teach nothing."""
    pages = [p for p in pages if p[0]]
    told = [places(page) for page, _ in pages]
    held = [[["bias", *b.marks, *features(b), *more] for b, more in zip(page, place[0], strict=True)] for (page, _), place in zip(pages, told, strict=True)]
    names = [*NUMBERS, *sorted({f for page in held for own in page for f in own})]
    number = {f: i for i, f in enumerate(names)}
    longest = max(len(page) for page, _ in pages)
    n, length = len(pages), longest
    real, y = np.zeros((n, length), dtype=bool), np.zeros((n, length), dtype=np.int64)
    kinds, value = np.zeros((n, length), dtype=np.int64), np.zeros((n, length, len(NUMBERS)))
    rows, ids = [], []
    for p, (page, labels) in enumerate(pages):
        real[p, : len(page)], y[p, : len(labels)] = True, labels
        value[p, : len(page)], kinds[p, : len(page)] = told[p][1:]
        for i, own in enumerate(held[p]):
            rows += [p * length + i] * len(own)
            ids += [number[f] for f in own]
    rows, ids = np.array(rows), np.array(ids)  # what holds, as (block, feature)
    value = value.reshape(n * length, -1)
    both, kinds = real[:, 1:], kinds[:, 1:]
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kinds[both], y[:, :-1][both], y[:, 1:][both]), 1)
    seen_first = np.bincount(y[:, 0], minlength=2)
    total = real.sum()
    params = np.zeros(len(names) + 10)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, steps, first = params[:-10], params[-10:-2].reshape(2, 2, 2)[kinds], params[-2:]
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = (np.bincount(rows, w[ids], n * length) + value @ w[: len(NUMBERS)]).reshape(n, length)
        ahead = np.zeros((n, length, 2))
        ahead[:, 0] = first + emit[:, 0]
        for i in range(1, length):
            new = _log_add(ahead[:, i - 1, :, None] + steps[:, i - 1], 1) + emit[:, i]
            ahead[:, i] = np.where(real[:, i, None], new, ahead[:, i - 1])
        after = np.zeros((n, length, 2))
        for i in range(length - 2, -1, -1):
            new = _log_add(steps[:, i] + (emit[:, i + 1] + after[:, i + 1])[:, None, :], 2)
            after[:, i] = np.where(real[:, i + 1, None], new, 0)
        z = _log_add(ahead[:, -1], 1)
        p = np.exp(ahead + after - z[:, None, None])[:, :, 1] * real
        pair = np.exp(ahead[:, :-1, :, None] + steps + (emit[:, 1:] + after[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        off = (p - y * real).ravel()
        by_name = np.bincount(ids, off[rows], len(names))
        by_name[: len(NUMBERS)] = off @ value
        by_step = np.stack([pair[kinds == k].sum(axis=0) for k in (0, 1)]) - seen
        slope = np.concatenate([by_name, by_step.ravel(), np.exp(ahead[:, 0] + after[:, 0] - z[:, None]).sum(axis=0) - seen_first])
        slope = slope / total + ridge * params
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        params -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(v) for f, v in zip(names, params[:-10], strict=True)}, params[-10:-2].reshape(2, 2, 2).copy(), params[-2:].copy())


#: Words of class and id by what an element holds.
NAMES = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs topbar tabs links pagination pager skip toc".split(),
    "header": "header masthead site top branding logo banner title hero tagline".split(),
    "footer": "footer foot bottom copyright legal colophon credits sitemap".split(),
    "sidebar": "sidebar side aside rail widget widgets related recommended trending popular tags archive secondary complementary".split(),
    "advert": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner outbrain".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay banner message warning paywall".split(),
    "comments": "comment comments commentlist discussion reply replies respond disqus responses thread".split(),
    "form": "form search login signup newsletter subscribe subscription contact feedback".split(),
    "share": "share sharing social buttons toolbar tools actions follow".split(),
    "main": "content main article post entry story body text page prose primary articlebody".split(),
}
#: Marks that tell of other text than an article's.
TELLING = frozenset(f".{name}" for kind, names in NAMES.items() if kind != "main" for name in names) | {f"<{tag}" for tag in ("nav", "header", "footer", "aside", "form", "dialog", "ins")}
#: Elements that hold each kind besides a div.
TAGS = {"menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "advert": ("div", "aside", "ins"), "notice": ("div", "section", "dialog"), "comments": ("section", "div", "aside"), "form": ("form", "div"), "share": ("div", "ul"), "main": ("article", "main", "div", "section")}
#: Phrases that notices and the like use; most of their text is drawn at random.
PHRASES = {
    "header": ("Welcome to our site", "Daily news", "Skip to content"),
    "footer": ("© 2024", "All rights reserved.", "Terms of use", "Privacy policy", "Copyright"),
    "sidebar": ("Related articles", "Most read", "Tags", "About the author", "Read more"),
    "advert": ("Advertisement", "Sponsored", "Buy now", "Promoted content"),
    "notice": ("This site uses cookies.", "Accept all", "We value your privacy.", "Please enable JavaScript."),
    "comments": ("3 comments", "Reply", "Leave a comment", "Posted by", "Log in to comment"),
    "form": ("Search", "Sign up for our newsletter", "Subscribe", "Your email", "Log in"),
    "share": ("Share", "Tweet", "Follow us"),
}
_SYLLABLES = "the an er in on re ti es or en ed th ing ion le la de que os ar sch ung ei ich ou è á ñ ü ö mar tel vo ka su ni do pra".split()


#: Names that say nothing of what an element holds.
NEUTRAL = "wrapper wrap container row col md lg inner outer region block module box group wp elementor section layout grid flex cell node field item clearfix left right center page site root app".split()
#: Kinds of layouts: HTML 5 elements, named divs, elements that tell nothing, tables, and no element about the main text.
FAMILIES = ("semantic", "named", "bare", "table", "flat")


#: Scripts beside the Latin one: whether words are parted by spaces, and the code points that letters are drawn from.
SCRIPTS = ((True, 0x430, 0x450), (True, 0x3B1, 0x3CA), (True, 0x627, 0x64B), (True, 0x905, 0x93A), (False, 0x4E00, 0x9000), (False, 0x3042, 0x3094))


class _Drawn:
    """A page of a family, drawn at random."""

    def __init__(self, rng: np.random.Generator, families: tuple[str, ...] = FAMILIES):
        self.rng = rng
        self.family = self.pick(families)
        self.letters = self.pick(SCRIPTS) if rng.random() < 0.2 else None

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def neutral(self, inner: str) -> str:
        """An element whose names, if any, say nothing."""
        names = " ".join("-".join(self.pick(NEUTRAL) for _ in range(int(self.rng.integers(1, 3)))) for _ in range(int(self.rng.integers(0, 3))))
        tag = self.pick(("div", "div", "section", "span") if "<p" not in inner else ("div", "div", "section"))
        return f"<{tag}{f' class={chr(34)}{names}{chr(34)}' if names else ''}>{inner}</{tag}>"

    def words(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        if self.letters:
            spaced, *span = self.letters
            drawn = ["".join(map(chr, self.rng.integers(*span, int(self.rng.integers(1, 7 if spaced else 4))))) for _ in range(n)]
            return (" " if spaced else "").join(drawn)
        out = ["".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        junk = self.pick(("", "", "", "", "%%%", "###"))
        return " ".join(w + (junk if self.rng.random() < 0.5 else "") for w in out)

    def sentences(self, most: int) -> str:
        ends, between = ("。。。？！", "") if self.letters and not self.letters[0] else (".....?!", " ")
        return between.join(self.words(1, 18).capitalize() + self.pick(ends) for _ in range(int(self.rng.integers(1, most + 1))))

    def attributes(self, kind: str) -> str:
        if self.rng.random() < 0.25:
            return ""
        name = "-".join(self.pick(NAMES[kind]) for _ in range(1 + (self.rng.random() < 0.3)))
        return f' {self.pick(("class", "class", "id"))}="{name}{self.pick(("", "", "-1", "_x", " wide"))}"'

    def within(self, kind: str, inner: str) -> str:
        tag = self.pick(TAGS[kind])
        if self.family == "semantic" and tag == "div":
            tag = TAGS[kind][0]
        if self.family in ("named", "table") and kind == "main":
            tag = "div"
        if tag == "ul":
            inner = "".join(f"<li>{x}</li>" for x in inner.split("\n"))
        if self.family == "bare" and (kind == "main" or kind in ("menu", "share", "footer", "header", "advert") and self.rng.random() < 0.3):
            return f"<ul>{inner}</ul>" if tag == "ul" else self.neutral(inner)
        if self.family == "table" and kind == "main":
            beside = f"<td>{self.pick(('<br>', ' | ', ' ')).join(f'<a href={chr(34)}/x{chr(34)}>{self.words(1, 3)}</a>' for _ in range(int(self.rng.integers(1, 6))))}</td>" if self.rng.random() < 0.4 else ""
            return f"<table><tr>{beside}<td{self.attributes(kind) if self.rng.random() < 0.3 else ''}>{inner}</td></tr></table>"
        if self.family == "flat" and kind == "main":
            return inner
        named = self.attributes(kind) if tag in ("nav", "header", "footer", "aside", "form", "article", "main") else f' class="{self.pick(NAMES[kind])}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def line(self, kind: str) -> str:
        text = self.pick(PHRASES[kind]) if kind in PHRASES and self.rng.random() < 0.4 else self.sentences(3) if self.rng.random() < 0.6 else self.words(1, 8)
        return text

    def other(self, kind: str) -> str:
        """An element that is not main text."""
        n = int(self.rng.integers(1, 5))
        if kind == "menu":
            items = [f'<a href="/x">{self.words(1, 3)}{self.pick(("", "", "."))}</a>' for _ in range(n + 2)]
            return self.within(kind, "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.7 else "\n".join(items))
        if kind == "form":
            return self.within(kind, f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.line(kind)}</button>' + (f"<p>{self.sentences(2)}</p>" if self.rng.random() < 0.5 else ""))
        if kind == "comments":
            own = [self.pick(("<div class=\"comment\"><p>{}</p></div>", "<li><p>{}</p></li>", "<p>{}</p>", "<div>{}</div>")).format(self.sentences(6)) for _ in range(n)]
            head = f"<h{self.pick((2, 3, 4))}>{self.line(kind)}</h3>" if self.rng.random() < 0.5 else ""
            return self.within(kind, head + "".join(own))
        inner = [self.line(kind) for _ in range(n)]
        wrap = self.pick(("{}", "<p>{}</p>", "<span>{}</span>", "<div>{}</div>", '<a href="/y">{}</a>', "<h3>{}</h3>"))
        return self.within(kind, "\n".join(wrap.format(x) for x in inner) if wrap != "{}" else " ".join(inner))

    def short(self) -> list[str]:
        """Main text of few blocks, or of text that stands in its element without one of its own."""
        mark = lambda s: MARK + s
        out = [f"<h{self.pick((1, 1, 2))}>{mark(self.words(2, 12))}</h1>"] if self.rng.random() < 0.4 else []
        kind, n = self.rng.random(), int(self.rng.integers(1, 7))
        if kind < 0.3:
            return [*out, mark(self.sentences(9 * self.pick((1, 1, 2, 4))))]
        if kind < 0.6:
            return [*out, mark(self.pick(("<br>", "<br><br>", "<br/>\n<br/>")).join(self.sentences(3) for _ in range(n + 1)))]
        wrap = self.pick(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<div><p>{}</p></div>", "<section><p>{}</p></section>"))
        return [*out, *(wrap.format(mark(" ".join(self.sentences(6) for _ in range(1 + n // 3)))) for _ in range(int(self.rng.integers(1, 4))))]

    def body(self) -> list[str]:
        """Blocks of main text."""
        if self.rng.random() < 0.5:
            return self.short()
        mark = lambda s: MARK + s
        out = [f"<h{self.pick((1, 1, 2))}>{mark(self.words(2, 12))}{self.pick(('', '.'))}</h1>"] if self.rng.random() < 0.8 else []
        paragraph = self.pick(("<p>{}</p>",) * 6 + ("<div>{}</div>", "<div><p>{}</p></div>"))
        for _ in range(int(self.rng.integers(1, 13))):
            kind = self.rng.random()
            if kind < 0.1:  # articles use such words too; what stands above them must tell
                out.append(f"<p>{mark(self.pick(PHRASES[self.pick(sorted(PHRASES))]))}{self.pick(('', ' ' + self.sentences(2)))}</p>")
            elif kind < 0.68:
                out.append(paragraph.format(mark(self.sentences(9))))
            elif kind < 0.76:
                out.append(f"<p><b>{mark(self.sentences(4))}<br>")
            elif kind < 0.82:
                out.append(f"<h{self.pick((2, 3))}>{mark(self.words(1, 7))}</h3>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{mark(self.words(2, 14))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{mark(self.sentences(3))}</blockquote>")
            elif kind < 0.95:
                out.append(f"<pre>{mark(self.words(3, 20))}</pre>")
            elif kind < 0.975:
                out.append("<table><tr>" + "".join(f"<td>{mark(self.words(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(f'<p>{mark(self.words(3, 9))} <a href="/z">{self.words(1, 4)}</a> {self.sentences(2)}</p>')
        return out

    def page(self) -> str:
        body = self.body()
        for kind in ("advert", "share", "notice", "form", "sidebar"):
            if self.rng.random() < 0.15:
                body.insert(int(self.rng.integers(len(body) + 1)), self.other(kind))
        if self.rng.random() < 0.1:
            body.append(self.other("comments"))
        main = self.within("main", "".join(body))
        for _ in range(int(self.rng.integers(0, 3))):
            main = self.neutral(main)
        if self.rng.random() < 0.15:
            main = f"<main>{main}</main>"
        before = [self.other(k) for k in ("notice", "header", "menu", "advert", "sidebar") if self.rng.random() < 0.5]
        after = [self.other(k) for k in ("share", "comments", "sidebar", "advert", "form", "footer", "notice") if self.rng.random() < 0.45]
        # Names of the whole page say nothing of its parts.
        whole = " ".join(f"{self.pick(NAMES[self.pick(sorted(NAMES))])}-{self.pick(NEUTRAL)}" for _ in range(int(self.rng.integers(0, 4))))
        return f"<html><head><title>{self.words(1, 8)}</title></head><body class='{whole}'>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a page whose main text has marks, without the marks, and the labels."""
    found = blocks(page)
    labels = [MARK in b.text for b in found]
    return [replace(b, text=b.text.replace(MARK, "")) for b in found], labels


def labelled_pages(n: int, seed: int = 19, families: tuple[str, ...] = FAMILIES) -> list[tuple[list[Block], list[bool]]]:
    rng = np.random.default_rng(seed)
    return [labelled(_Drawn(rng, families).page()) for _ in range(n)]


@lru_cache(maxsize=2)
def default_model(pages: int = PAGES, seed: int = 19) -> Model:
    return train(labelled_pages(pages, seed))


def main_text(model: Model, page: str) -> str:
    found = blocks(page, model.weights)
    return "\n\n".join(b.text for b, own in zip(found, model.labels(found), strict=True) if own)


def extract(pages: DataFrame, model: Model | None = None, *, html: str = "html", into: str = "text") -> DataFrame:
    """Adds the main text of every page: its blocks in page order, with an empty line between two.

    Character references are decoded and white space inside a block becomes one space. Null or empty html, and a
    page without main text, give the empty text. Other columns and repeated rows stay as they are,
    whatever the size of a page; ``into`` must be a new name. An empty table gives no rows.
    """
    if into in pages.columns:
        raise ValueError(f"column {into} is there already")
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundreds of weights
    own = [f"_{i}" for i in range(len(pages.columns))]
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, own[at]):
                texts = [main_text(shared.value, page or "") for page in piece.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*own, "_text"])

    schema = ", ".join([*(f"{o} {f.dataType.simpleString()}" for o, f in zip(own, pages.schema, strict=True)), "_text string"])
    out = pages.toDF(*own).mapInArrow(run, schema)
    return out.select(*(F.col(o).alias(n) for o, n in zip(own, pages.columns, strict=True)), F.col("_text").alias(into))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE_SQL: dict[str, str] = {}
