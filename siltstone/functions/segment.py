"""Words of text without blanks: a dictionary's words as a graph over each run of CJK
characters, its best path, and in search mode the shorter words inside."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a-z and 0-9, and runs of CJK characters; all else separates.
RUN = re.compile("[a-z0-9]+|[一-龥]+")


class Segmenter:
    """A dictionary {word: frequency}. A path's score is the sum of log(frequency / total);
    a character that is no word counts as one of frequency 1. Of equal scores (to nine
    places) the path with the longer first word stands."""

    def __init__(self, words: dict[str, float]):
        self.words = {w: f for w, f in words.items() if w and f > 0}
        total = math.log(sum(self.words.values()) or 1.0)
        self.score = {w: math.log(f) - total for w, f in self.words.items()}
        self.unknown = -total
        self.starts = {w[:k] for w in self.words for k in range(1, len(w) + 1)}  # all beginnings of words

    def ends(self, text: str, at: int) -> list[int]:
        """Where the words that begin at a place end; the character itself at least."""
        out = [at + 1]
        end = at + 1
        while end <= len(text) and text[at:end] in self.starts:
            if end > at + 1 and text[at:end] in self.words:
                out.append(end)
            end += 1
        return out

    def path(self, text: str) -> list[str]:
        """The words of the best path through a run, found from its end."""
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(text) + 1)
        for at in range(len(text) - 1, -1, -1):
            scored = ((self.score.get(text[at:end], self.unknown) + best[end][0], end) for end in self.ends(text, at))
            best[at] = max(scored, key=lambda x: (round(x[0], 9), x[1]))
        out, at = [], 0
        while at < len(text):
            out.append(text[at : best[at][1]])
            at = best[at][1]
        return out

    def tokens(self, text: str | None, search: bool = True) -> list[str]:
        """Lower-case words in order; search: before a word of more than two (three)
        characters, the dictionary's words of two (three) inside it."""
        out = []
        for run in RUN.findall((text or "").lower()):
            for word in self.path(run) if run[0] >= "一" else [run]:
                if search and word[0] >= "一":
                    for n in (2, 3):
                        if len(word) > n:
                            out += [word[k : k + n] for k in range(len(word) - n + 1) if word[k : k + n] in self.words]
                out.append(word)
        return out


def tokenizer(words: dict[str, float], search: bool = True) -> Callable[[Column], Column]:
    """A tokenizer for bm25 and postings. The dictionary goes to each task with the function."""
    held = Segmenter(words)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([held.tokens(t, search) for t in texts])

    return lambda c: cut(c)
