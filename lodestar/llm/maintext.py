"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks (runs of text between block-level tags). Each has features: tags of its ancestors,
words of their class, id and role, and the shape of its text. A two-state chain (article or not) is trained by maximum
likelihood on labelled pages and decoded by Viterbi. Everything runs in one pass over a page; no shuffle.
"""

from __future__ import annotations

import collections
import functools
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.mainpages import Page
from lodestar.llm.media import sliced

#: Training pages, gradient steps and the weight of the squared norm.
PAGES, STEPS, RIDGE = 900, 400, 0.1
# Elements whose content is no text, elements that separate blocks, and elements without an end tag.
SILENT = "script|style|noscript|template|title|svg|iframe|object|textarea|canvas|audio|video"
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TELLING = frozenset("nav header footer aside article main section form ul ol li table td blockquote figure figcaption h1 h2 h3 h4 h5 h6 p pre dl dt dd button label legend select option dialog details summary fieldset menu a".split())
_QUOTED = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_FORM = (
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:{more})(?<=/)>|<(?P<silent>" + SILENT + r")(?=[\s/>])[^>]*+>.*?(?:(?P<shut></(?P=silent)(?=[\s/>])[^>]*+>)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<more>{more})>|<[!?/a-zA-Z][^>]*+>|(?P<text>[^<]++|<)"
)
_TOKEN, _PLAIN = (re.compile(_FORM.format(more=more), re.DOTALL | re.IGNORECASE) for more in (_QUOTED, r"[^>]*+"))
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_LABEL = re.compile(r'data-label="(\d)"')
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Tags that a start tag of the same group ends.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Model(NamedTuple):
    """Weights of features for the article state, and of steps between states."""

    weights: dict[str, float]
    steps: tuple[float, float, float, float]  # 0 to 0, 0 to 1, 1 to 0, 1 to 1


def attribute_words(more: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role."""
    return tuple({w.lower() for found in _NAMES.findall(more) for w in _SPLIT.findall("".join(found))}) if "=" in more else ()


class Open:
    """The open elements, with counts of their tags and attribute words, so that no block has to walk all of them."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...], int | None]] = []
        self.tags, self.words = collections.Counter(), collections.Counter()
        self.blocks: list[str] = []
        self.labels: list[int] = []

    def push(self, tag: str, words: tuple[str, ...], label: int | None) -> None:
        self.stack.append((tag, words, label))
        self.tags[tag] += 1
        self.words.update(words)
        if tag in BLOCKS:
            self.blocks.append(tag)
        if label is not None:
            self.labels.append(label)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag, words, label = self.stack.pop()
            for counts, names in ((self.tags, (tag,)), (self.words, words)):
                for name in names:
                    counts[name] -= 1
                    if not counts[name]:
                        del counts[name]
            if tag in BLOCKS:
                self.blocks.pop()
            if label is not None:
                self.labels.pop()

    def frame(self) -> tuple[set[str], set[str], str, int | None]:
        """Telling tags, attribute words, the nearest block element and label of what is open."""
        return TELLING & self.tags.keys(), set(self.words), self.blocks[-1] if self.blocks else "", self.labels[-1] if self.labels else None


def pieces(page: str) -> Iterator[re.Match | str]:
    """A page's tags, comments, silent elements and texts in order, in time linear in its length.

    Behind the last ``>`` no tag can end, so the rest is one text. A tag whose quotes never close is looked through to the
    page's end once; from there on quotes mean nothing.
    """
    end, at, pattern = page.rfind(">") + 1, 0, _TOKEN
    whole = True
    while at < end:
        m = pattern.match(page, at, end)
        at = m.end()
        found = m[0]
        if found.startswith("<!--"):
            whole = found.endswith("-->")
        elif m["silent"] is not None:
            whole = m["shut"] is not None
        elif m["tag"] is None and m["text"] is None and (found[1:2].isalpha() or found[1:2] == "/" and found[2:3].isalpha()):
            pattern = _PLAIN
        yield m
    if whole and at < len(page):
        yield page[at:].partition("<!--")[0]


def leaf_blocks(page: str) -> list[tuple[str, list[str], int | None]]:
    """(text, features, label) of the leaf blocks in page order. Labels are in training pages only."""
    open_ = Open()
    stack = open_.stack
    found: list[tuple[str, list[str], int | None]] = []
    parts: list[str] = []
    linked = 0
    frame = open_.frame()

    def close() -> None:
        nonlocal parts, linked
        raw = "".join(parts)
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            found.append((text, features(frame, text, linked / max(1, len(raw))), frame[3]))
        parts, linked = [], 0

    for m in pieces(page):
        text = m if isinstance(m, str) else m["text"]
        if text is not None:
            if not parts:
                frame = open_.frame()
            parts.append(text)
            if "a" in open_.tags:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head":
            # Its end tag is optional and what it may hold is void or silent: anything else is of the body.
            close()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            close()
        if m["end"]:
            if tag in open_.tags:
                # An inline element ends only what is open inside the nearest block.
                at = len(stack) - 1
                while stack[at][0] != tag and (block or stack[at][0] not in BLOCKS):
                    at -= 1
                if stack[at][0] == tag:
                    open_.cut(at)
        else:
            if block:
                # An open paragraph ends where a block begins; so do siblings of lists and tables.
                ends = ("p", *_SIBLINGS.get(tag, ()))
                while any(x in open_.tags for x in ends):
                    at = len(stack) - 1
                    while stack[at][0] not in ends and stack[at][0] not in BLOCKS:
                        at -= 1
                    if stack[at][0] not in ends:
                        break
                    open_.cut(at)
            if not m["more"].rstrip().endswith("/") or block:
                label = _LABEL.search(m["more"])
                open_.push(tag, attribute_words(m["more"]), int(label[1]) if label else None)
    close()
    return found


def features(frame: tuple[set[str], set[str], str, int | None], text: str, linked: float) -> list[str]:
    tags, names, nearest, _ = frame
    words = text.count(" ") + 1
    size = "1" if words == 1 else "3" if words < 4 else "7" if words < 8 else "15" if words < 16 else "40" if words < 41 else "+"
    out = ["", "t " + nearest, "n " + size, "l " + ("0" if linked == 0 else "1" if linked < 0.5 else "2"), "e " + str(text[-1] in ".!?\"'”»…")]
    out += ["a " + t for t in sorted(tags)]
    out += ["w " + w for w in sorted(names)]
    if text[0] == "©" or text[:9].lower() == "copyright":
        out.append("c")
    if "header" in tags and ("article" in tags or "main" in tags):
        out.append("header in article")
    out.append(f"s {nearest} {size}")
    return out


def decode(blocks: list[tuple[str, list[str], int | None]], model: Model) -> list[int]:
    """The most probable states (Viterbi)."""
    get, (a, b, c, d) = model.weights.get, model.steps
    zero, one, back = 0.0, 0.0, []
    for k, (_, names, _) in enumerate(blocks):
        w = 0.0
        for f in names:
            w += get(f, 0.0)
        if k:
            from0, from1 = zero + a < one + c, zero + b < one + d
            zero, one = (one + c if from0 else zero + a), (one + d if from1 else zero + b) + w
            back.append((from0, from1))
        else:
            one = w
    state = int(one > zero)
    out = [state]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return out[::-1]


@functools.cache
def train(pages: int = PAGES) -> Model:
    """Maximum likelihood on the labelled pages, by gradient steps with adapted rates."""
    chains = [b for b in (leaf_blocks(Page(k).html()) for k in range(pages)) if b]
    names = {f: k for k, f in enumerate(dict.fromkeys(f for c in chains for b in c for f in b[1]))}
    longest = max(map(len, chains))
    cell, column = [], []
    truth = np.zeros((len(chains), longest), np.int64)
    there = np.zeros((len(chains), longest), bool)
    for i, chain in enumerate(chains):
        for t, (_, found, label) in enumerate(chain):
            truth[i, t], there[i, t] = label or 0, True
            cell += [i * longest + t] * len(found)
            column += [names[f] for f in found]
    cell, column = np.array(cell), np.array(column)
    weights, steps = np.zeros(len(names)), np.zeros((2, 2))
    seen_w, seen_s = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    pairs = there[:, 1:]
    usual = np.zeros((2, 2))
    np.add.at(usual, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
    n = there.sum()
    for _ in range(STEPS):
        score = np.bincount(cell, weights[column], len(chains) * longest).reshape(len(chains), longest)
        emit = np.stack([np.zeros_like(score), score], axis=2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            step = forward[:, t - 1, :, None] + steps
            forward[:, t] = np.where(there[:, t, None], np.logaddexp(step[:, 0], step[:, 1]) + emit[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = steps + (emit[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(there[:, t + 1, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0.0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        likely = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
        joint = np.exp(forward[:, :-1, :, None] + steps + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        slope = np.bincount(column, np.where(there, likely - truth, 0.0).reshape(-1)[cell], len(names)) / n + RIDGE * weights / n
        slope_s = (np.where(pairs[:, :, None, None], joint, 0.0).sum(axis=(0, 1)) - usual) / n
        seen_w += slope**2
        seen_s += slope_s**2
        weights -= 0.5 * slope / np.sqrt(seen_w)
        steps -= 0.5 * slope_s / np.sqrt(seen_s)
    return Model({f: float(weights[k]) for f, k in names.items()}, tuple(float(x) for x in steps.reshape(-1)))


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    blocks = leaf_blocks(page)
    return " ".join(b[0] for b, keep in zip(blocks, decode(blocks, model), strict=True) if keep) if blocks else ""


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of every page; null html has the empty text. Narrow; other columns are ignored."""
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("html").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "html"):
                texts = [main_text(h.as_py(), model) for h in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"{plain}, text string, n_chars long")
