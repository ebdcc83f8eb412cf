"""Token counts by a vocabulary of word pieces: greedy longest match over a trie, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: What a piece that goes on a word begins with; longest word that is cut into pieces.
MORE, LONGEST = "##", 100
_PARTS = re.compile(r"[^\W_]+|[^\w\s]|_")
_END = ""


class Pieces:
    """Two tries of nested dictionaries: pieces that begin a word, and those that go on with one."""

    def __init__(self, vocabulary: list[str], lower: bool = True):
        self.lower, self.begin, self.more, self.known = lower, {}, {}, {}
        for piece in vocabulary:
            node, rest = (self.more, piece[len(MORE) :]) if piece.startswith(MORE) and piece != MORE else (self.begin, piece)
            for c in rest:
                node = node.setdefault(c, {})
            node[_END] = True

    def word(self, word: str) -> int:
        """Pieces of a word, the longest first; 1, the unknown piece, if it can't be cut so."""
        if len(word) > LONGEST:
            return 1
        at, n, root = 0, 0, self.begin
        while at < len(word):
            node, end = root, -1
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if _END in node:
                    end = k + 1
            if end < 0:
                return 1
            at, n, root = end, n + 1, self.more
        return n

    def count(self, text: str) -> int:
        """Pieces of all words; every sign of punctuation is a word; accents go with the capitals."""
        if self.lower:
            text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
        total = 0
        for part in _PARTS.findall(text):
            if part not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[part] = self.word(part)
            total += self.known[part]
        return total


def counter(vocabulary: list[str], lower: bool = True, special: int = 2) -> Callable[[Column], Column]:
    """A counter for ``digest.chunk_audit``: tokens of a text with ``special`` ones around it; null for null. The vocabulary, a
    line of its file each, goes to the tasks with the function."""
    pieces = Pieces(vocabulary, lower)

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else pieces.count(t) + special for t in texts], dtype="Int64")

    return count


def read_vocabulary(path: str) -> list[str]:
    """The lines of a vocabulary file; blank ones go."""
    with open(path, encoding="utf-8") as file:
        return [line for x in file if (line := x.rstrip("\r\n"))]
