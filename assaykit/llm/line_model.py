"""Costs of lines for the minimum cut: a logistic classifier over words, form and place, fitted to the corpus itself.

There are no labelled lines. Cues that are sure by themselves (``page_lines.seed``) label part of the lines of a bounded
sample of packs; a logistic model over all features learns from them what else such lines have in common, labels the sample by
the minimum cut, and is fitted again to those labels. Its log-odds are the terminal capacities of the final cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache
from math import exp

import numpy as np

from assaykit.llm.page_lines import seed
from assaykit.llm.textforms import words_of

#: Rounds of fitting (the first on seeds, the others on labels of the cut), steps a round, and the pull of weights to 0.
ROUNDS, STEPS, RIDGE = 2, 60, 2e-5
#: A feature must stand on so many lines of the sample; log-odds are bounded by CLIP.
LEAST_LINES, CLIP = 3, 4.0

#: Size from which a line's beginning, end and marks say no more than its words.
LONG = 128

_SEPARATORS = re.compile(r"\s[|·•-]\s|\s{2,}|\s\|")
_NUMBERS = re.compile(r"\d+(?:[.,:/-]\d+)*")
_MARKS = re.compile(r"[©…»(%|·]|\]\(|  |\d")
_BULLET = re.compile(r"^(?:[*•·–-]|\d+[.)])\s+")
_SENTENCE_END = (".", "。", "!", "?", "！", "？", ":", "：", ";", ")")


def size(s: str) -> int:
    """Length of a line in bytes, so that a Han character counts as three letters."""
    return len(s) if s.isascii() else len(s.encode())


@lru_cache(maxsize=30_000)
def shape(line: str) -> str:
    """Form of a line: table row, heading, link, bullet, value, running text, parts, figures, bare words."""
    s = line.strip()
    if s[0] == "|" and s[-1] == "|":
        return "table"
    if s[0] == "#" or s[:2] == "**" == s[-2:]:
        return "heading"
    if "](" in s:
        return "link"
    if _BULLET.match(s):
        return "bullet"
    n = size(s)
    if s.endswith("…") or s.endswith("...") or s.endswith("]"):
        return "cut"
    if n > 30 and s.endswith(_SENTENCE_END) or n > 120:
        return "text"
    if re.match(r"^\w{1,10}\s*[:：]\s*[\d.,]+", s):
        return "value"
    if _SEPARATORS.search(s):
        return "parts"
    return "figures" if any(c.isdigit() for c in s) else "words"


def form_features(line: str, words: tuple[str, ...]) -> list[str]:
    """Features of a line's form: shape, size, ending; of lines below ``LONG`` also marks, beginning and end; short lines as a whole."""
    s = line.strip()
    n = size(s)
    if n >= LONG:
        return [f"s:{shape(line)}", f"n:{n.bit_length()}", f"e:{s[-1] if not s[-1].isalnum() else 'a'}"]
    out = [f"s:{shape(line)}", f"n:{n.bit_length()}", f"e:{s[-1] if not s[-1].isalnum() else 'a'}", f"k:{min(len(words), 12)}", f"a:{' '.join(words[:2])}", f"z:{' '.join(words[-2:])}"]
    out.extend({"0" if m.isdigit() else m for m in _MARKS.findall(s)})
    if n < 60:
        out.append(f"t:{_NUMBERS.sub('0', _BULLET.sub('', s.lower()).strip('#* '))}")
        if s.isupper():
            out.append("s:upper")
    return out


def line_features(line: str) -> tuple[str, ...]:
    """All features of a line by itself: its form and its words, which are features by themselves."""
    words = words_of(line)
    return (*form_features(line, words), *sorted(set(words)))


#: A line's place: lines above it up to six, below it up to six, lines of its block up to four, whether it has the site's own name.
Place = tuple[int, int, int, bool]


@lru_cache(maxsize=1_000)
def place_features(place: Place) -> tuple[str, ...]:
    above, below, block, brand = place
    return (f"u:{above}", f"d:{below}", f"b:{block}", f"brand:{brand}")


class LineModel:
    """Weights by feature; unknown features weigh nothing."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}
        get, weight, known = self.weights.get, self.weights.__getitem__, frozenset(self.weights)
        @lru_cache(maxsize=50_000)
        def own(line: str) -> float:
            words = words_of(line)
            return get("", 0.0) + sum(map(weight, known.intersection(words))) + sum(map(weight, known.intersection(form_features(line, words))))

        @lru_cache(maxsize=1_000)
        def at(place: Place) -> float:
            return sum(get(f, 0.0) for f in place_features(place))

        self._own, self._at = own, at

    def cost(self, line: str, place: Place) -> float:
        x = self._own(line) + self._at(place)
        return -CLIP if x < -CLIP else CLIP if x > CLIP else x


def logistic(rows: list[tuple[str, ...]], labels: np.ndarray, least: int = LEAST_LINES) -> dict[str, float]:
    """Weights of a logistic regression, both classes weighing alike, by full steps with a scale of its own for each weight."""
    alike = Counter(zip(rows, labels.tolist()))  # equal rows are one with a weight
    counts: Counter = Counter()
    for (r, _), k in alike.items():
        for f in r:
            counts[f] += k
    index = {f: k for k, f in enumerate((f for f, n in counts.items() if n >= least), 1)}
    sizes, column = [], []
    for r, _ in alike:
        known = [index[f] for f in r if f in index]
        sizes.append(len(known) + 1)
        column.append(0)
        column.extend(known)
    row, column = np.repeat(np.arange(len(sizes)), sizes), np.asarray(column)
    y, k = np.asarray([float(y) for _, y in alike]), np.asarray(list(alike.values()), dtype=float)
    if not len(y) or y.min() == y.max():
        return {}
    share = (y * k).sum() / k.sum()
    each = k * np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / k.sum()
    w, scale = np.zeros(len(index) + 1), np.full(len(index) + 1, 1e-12)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(y)), -30, 30)))
        g = np.bincount(column, ((p - y) * each)[row], len(w)) + RIDGE * w
        scale += g * g
        w -= 0.3 * g / np.sqrt(scale)
    return {"": float(w[0]), **{f: float(w[k]) for f, k in index.items() if abs(w[k]) > 0.01}}


def fit(sections: list[list[tuple[str, Place]]], cut: Callable[[LineModel, list[tuple[str, Place]]], list[float]]) -> LineModel:
    """The model of sections given as ``(line, place)``; ``cut(model, section)`` labels a section, 1 content, 0 furniture, between 0 and 1 neither."""
    model, features = LineModel(), [[(*line_features(line), *place_features(place)) for line, place in section] for section in sections]
    for turn in range(ROUNDS):
        rows, labels = [], []
        for section, known in zip(sections, features):
            marks = [(seed(line) + 1) / 2 for line, _ in section] if not turn else cut(model, section)
            for row, y in zip(known, marks):
                if y in (0.0, 1.0):
                    rows.append(row)
                    labels.append(y)
        model = LineModel(logistic(rows, np.asarray(labels)))
    return model


class MessageModel:
    """How much the words of a line sound like a message, as a probability; fitted to lines that are messages by wording against lines of sections that have a body."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}
        get = self.weights.get

        @lru_cache(maxsize=30_000)
        def score(line: str) -> float:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, sum(get(f, 0.0) for f in message_features(line)) + get("", -30.0)))))
            return p if len(words_of(line)) > 2 else p / 2  # one or two words say little

        self.score = score


def message_features(line: str) -> tuple[str, ...]:
    words = words_of(line)
    return tuple(sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), f"#{min(len(words), 16) // 4}"}))


def fit_messages(messages: Iterable[str], others: Iterable[str]) -> MessageModel:
    """Distinct lines weigh alike, so a message seen everywhere counts no more than one seen once."""
    known = set(messages)
    rows = [(x, True) for x in sorted(known)] + [(x, False) for x in sorted(set(others) - known)]
    return MessageModel(logistic([message_features(x) for x, _ in rows], np.asarray([y for _, y in rows]), 2))
