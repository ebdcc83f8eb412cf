"""A byte-level BPE vocabulary compiled to a deterministic transducer over bytes.

Two machines run one after the other. The first cuts text into words: a cut before a character depends only on the
classes (letter, number, white space, other) of its neighbours, so the machine has a memory of a few characters
and needs no scan. The second runs over the bytes of a word. In byte-level BPE the last token of every prefix is
determined: it's the one suffix of the prefix that is a token and fits the last token of what comes before it.
Hence a state is the longest suffix that may still grow into a token, with the last tokens and relative counts at
the places from which it may; a byte leads to one next state, and the transition is annotated with the change in
the number of tokens. The sum of annotations over a text is its number of tokens.

States and transitions are compiled from the merges when they are first met, and kept in an open hash table of
bounded size; a full table starts anew. Chunks of ``CHUNK`` bytes run side by side. Every cut resets the machine, so
a chunk maps any state it is entered in to the same state at its end once it holds a cut; its bytes before that are run
from the state in which the chunk before ends, which a scan over the maps of the chunks gives.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from quern.llm.wordhash import U, buffers, hashes

LETTER, NUMBER, SPACE, OTHER, EDGE, UNSEEN = 1, 2, 3, 4, 5, 0
CHUNK = 256
#: The pre-tokenizer this compiles, and the endings it keeps with an apostrophe. Fixed values of the format.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
DEAD, START = 0, 1
#: Lanes below which bytes are run one at a time.
FEW = 24
_SPREAD = 0x9E3779B97F4A7C15


def _bytes_of() -> dict[str, int]:
    """The format's printable stand-ins of all bytes: printable ones stand for themselves, the rest for 256 and up in order."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


class Transducer:
    """The compiled vocabulary of a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str, transitions: int = 1 << 20, states: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        odd = model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or file.get("normalizer")
        odd = odd or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
        if odd or any(x["single_word"] or x["lstrip"] or x["rstrip"] or len(x["content"].split()) != 1 for x in file["added_tokens"]):
            raise ValueError("only plain byte-level BPE files can be compiled")
        byte = _bytes_of()
        raw = lambda s: bytes(byte[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        #: Rank of every pair of ids that merges, and by id the parts a token is merged from and when.
        self.rank, self.parts = {}, {}
        for k, m in enumerate(model["merges"]):
            x, y = map(raw, m.split(" ") if isinstance(m, str) else m)
            a, b, whole = self.ids[x], self.ids[y], self.ids[x + y]
            if whole in self.parts or any(self.parts.get(p, (0, 0, -1))[2] > k for p in (a, b)):
                raise ValueError("a token is merged in two ways, or before its parts")
            self.rank[a, b] = k
            self.parts[whole] = a, b, k
        self.special = {x["content"].encode(): x["id"] for x in file["added_tokens"]}
        self._special = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.grows = {t[:k] for t in self.ids for k in range(1, len(t))}
        self._pre, self._class = Tokenizer.from_file(path).pre_tokenizer, np.zeros(0x110000, np.uint8)
        self._classes(np.arange(128))
        self._ends: tuple[dict, dict] = ({}, {})
        self._fits: dict[tuple, bool] = {}
        self.transitions, self.states, self.bits = transitions, states, (2 * transitions - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self._key = np.zeros(1 << self.bits, U)
        self._value = np.zeros(1 << self.bits, np.int64)
        self._of: dict[tuple, int] = {}
        self._info: list[tuple] = [()]
        self._filled = 0
        self._state((b"", (0, -1, 0)))

    def _state(self, info: tuple) -> int:
        n = self._of.get(info)
        if n is None:
            n = self._of[info] = len(self._info)
            self._info.append(info)
        return n

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that end (side 1) or begin (0) a token while it's merged, and when each is merged further."""
        out = self._ends[side].get(token)
        if out is None:
            out, at, until = [], token, float("inf")
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            self._ends[side][token] = out
        return out

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: nothing) in a tokenized word: no end of the one merges with a
        beginning of the other while both are there. Of equal merges the left one comes first."""
        out = self._fits.get((before, token))
        if out is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            if before >= 0:
                out = self.fits(-1, token) and not self._meet(before, token, float("inf"))
            else:
                out = True
                if token in self.parts:
                    a, b, k = self.parts[token]
                    out = self.fits(-1, a) and self.fits(-1, b) and not self._meet(a, b, k)
            self._fits[before, token] = out
        return out

    def _meet(self, a: int, b: int, limit: float) -> bool:
        for x, until in self._spine(a, 1):
            for y, till in self._spine(b, 0):
                k = self.rank.get((x, y), limit)
                if k < limit and k < until and k <= till:
                    return True
        return False

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the number of tokens), compiled.

        A state is the growing suffix and, for each of its suffixes that may grow (longest first, the empty one last),
        its length, the last token before it and the count there less the present one.
        """
        grown, places = self._info[state]
        grown += bytes((byte,))
        n, k = len(grown), 0
        while True:
            token = self.ids.get(grown[n - 1 - places[k] :])
            if token is not None and self.fits(places[k + 1], token):
                break
            k += 3
        change, kept = places[k + 2] + 1, []
        for k in range(0, len(places), 3):
            if grown[n - 1 - places[k] :] in self.grows:
                kept += (places[k] + 1, places[k + 1], places[k + 2] - change)
        longest = kept[0] if kept else 0
        return self._state((grown[n - longest :], (*kept, 0, token, 0))), change

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(_SPREAD)) >> U(64 - self.bits)).astype(np.int64)

    def _add(self, key: int) -> int:
        """The value of one transition, which is compiled if it's new: the next state and the change."""
        at, mask = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits), (1 << self.bits) - 1
        while self._key[at]:
            if self._key[at] == key:
                return int(self._value[at])
            at = (at + 1) & mask
        to, change = self.step(key >> 8, key & 255)
        self._key[at], self._value[at] = key, to << 8 | (change + 128)
        self._filled += 1
        return int(self._value[at])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at, mask = self._slot(keys), (1 << self.bits) - 1
        miss = np.flatnonzero(self._key[at] != keys)
        if len(miss):
            for key in np.unique(keys[miss]).tolist():
                self._add(key)
            while len(miss):
                miss = miss[self._key[at[miss]] != keys[miss]]
                at[miss] = (at[miss] + 1) & mask
        return self._value[at]

    def _room(self, state: np.ndarray) -> None:
        """Starts anew with the states at hand where the tables are full."""
        if self._filled + len(state) > 1.5 * self.transitions or len(self._info) + len(state) > self.states + (1 << 16):
            some, at = np.unique(state, return_inverse=True)
            infos = [self._info[k] for k in some.tolist()]
            self._clear()
            state[:] = np.array([self._state(x) if x else DEAD for x in infos], state.dtype)[at]

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        """Classes of code points, asked of the library's own pre-tokenizer once for each."""
        out = self._class[codes]
        if not out.all():
            one = lambda text: len(self._pre.pre_tokenize_str(text)) == 1
            for c in np.unique(codes[out == UNSEEN]).tolist():
                x = chr(c)
                self._class[c] = LETTER if one("a" + x) else NUMBER if one("1" + x) else OTHER if one("!" + x) else SPACE
            out = self._class[codes]
        return out

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        kind = self._class[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & (0xFF >> (size + 1))
            for k in range(1, 4):
                more = np.flatnonzero(size > k)
                code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
            of = self._classes(code)
            for k in range(4):
                more = np.flatnonzero(size > k)
                kind[lead[more] + k] = of[more]
        return kind

    def cuts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which bytes begin a word. ``edges``: where texts and special tokens begin and end."""
        n, kind = len(data), self._kinds(data)
        edge = np.zeros(n + 3, bool)
        edge[edges], edge[n:] = True, True
        before, after = np.full(n, EDGE, np.uint8), np.full(n, EDGE, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[edge[:n]], after[edge[1 : n + 1]] = EDGE, EDGE
        space = kind == SPACE
        cut = kind != before
        cut[1:] &= space[1:] | (data[:-1] != 32) | edge[1:n]
        cut |= space & (after != SPACE) & (after != EDGE)
        inside = np.flatnonzero(cut & ((data & 0xC0) == 0x80))  # of a white space character of several bytes
        while len(inside):
            cut[inside] = False
            cut[inside - 1] = True
            inside = inside[(data[inside - 1] & 0xC0) == 0x80] - 1
        quote = np.flatnonzero((data == 39) & cut)  # an apostrophe that begins a word keeps some endings
        if len(quote):
            ahead = np.concatenate([data, np.zeros(2, np.uint8)])
            length = np.zeros(len(quote), np.int64)
            for end in CONTRACTIONS:
                hit = np.ones(len(quote), bool)
                for k, c in enumerate(end, 1):
                    hit &= (ahead[np.minimum(quote + k, n)] == ord(c)) & ~edge[np.minimum(quote + k, n)]
                length[hit] = len(end)
            quote, length = quote[length > 0], length[length > 0]
            cut[quote + 1] = False
            cut[(quote + length + 1)[quote + length + 1 < n]] = True
        return cut

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(which bytes begin a word, spans of special tokens) of texts that begin and end at ``offsets``."""
        spans = [m.span() for m in self._special.finditer(data.tobytes())] if self._special else []
        if spans:  # not those that lie across two texts
            a, b = np.array(spans).T
            spans = [s for s, same in zip(spans, np.searchsorted(offsets, a, side="right") == np.searchsorted(offsets, b, side="left"), strict=True) if same]
        begins = self.cuts(data, np.unique(np.concatenate([offsets, np.array(spans, np.int64).ravel()])))
        for a, b in spans:
            begins[a + 1 : b] = False
        return begins, spans

    def _forward(self, state: np.ndarray, bytes_: np.ndarray, resets: np.ndarray, out: np.ndarray) -> None:
        """Runs all lanes from their states over the rows of ``bytes_``; lanes without a state wait for their first cut."""
        for k in range(len(bytes_)):
            self._room(state)
            state[resets[k]] = START
            live = slice(None) if state.all() else np.flatnonzero(state)
            value = self._find(state[live] << U(8) | bytes_[k][live])
            state[live] = value >> 8
            out[k][live] = (value & 255) - 128

    def changes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The change in the number of tokens at every byte of texts that begin and end at ``offsets``."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int8)
        begins, spans = self.words(data, offsets)
        lanes = -(-n // CHUNK)
        grid, cut = np.zeros((lanes, CHUNK), np.uint8), np.ones((lanes, CHUNK), bool)
        grid.ravel()[:n], cut.ravel()[:n] = data, begins
        rows, resets, out = np.ascontiguousarray(grid.T), np.ascontiguousarray(cut.T), np.zeros((CHUNK, lanes), np.int8)
        ends = np.full(lanes, DEAD, U)  # the states at the ends of chunks, as far as they are known
        self._forward(ends, rows, resets, out)
        head = np.where(cut.any(axis=1), cut.argmax(axis=1), CHUNK)
        todo = np.flatnonzero(head > 0)
        while len(todo):
            ready = todo[ends[todo - 1] != DEAD]
            todo = todo[ends[todo - 1] == DEAD]
            if len(ready) <= FEW:
                for lane in ready.tolist():
                    self._one(lane, head, ends, grid, out)
                todo = todo[(head[todo] < CHUNK) | (ends[todo] == DEAD)]
            else:
                self._heads(ready, head, ends, rows, out)
        flat = np.ascontiguousarray(out.T).ravel()[:n]
        for a, b in spans:
            flat[a : b - 1], flat[b - 1] = 0, 1
        return flat

    def _heads(self, lanes: np.ndarray, head: np.ndarray, ends: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        """Bytes before the first cut of these chunks, from the states in which the chunks before them end."""
        lanes = lanes[np.argsort(-head[lanes], kind="stable")]
        size = head[lanes]
        state = ends[lanes - 1]
        for k in range(int(size[0])):
            self._full(state, ends)
            m = int(np.searchsorted(-size, -k))
            value = self._find(state[:m] << U(8) | rows[k][lanes[:m]])
            state[:m] = value >> 8
            out[k][lanes[:m]] = (value & 255) - 128
        open_ = size == CHUNK
        ends[lanes[open_]] = state[open_]

    def _full(self, state: np.ndarray, ends: np.ndarray) -> None:
        both = np.concatenate([state, ends])
        self._room(both)
        state[:], ends[:] = both[: len(state)], both[len(state) :]

    def _one(self, lane: int, head: np.ndarray, ends: np.ndarray, grid: np.ndarray, out: np.ndarray) -> None:
        """The same for one chunk, and on through chunks after it that have no cut at all."""
        state = int(ends[lane - 1])
        while True:
            size = int(head[lane])
            for k, b in enumerate(grid[lane, :size].tolist()):
                value = self._add(state << 8 | b)
                state, out[k, lane] = value >> 8, (value & 255) - 128
            if size < CHUNK:
                return
            ends[lane] = state
            now = np.array([state], U)
            self._full(now, ends)
            state = int(now[0])
            lane += 1
            if lane == len(head) or not head[lane]:
                return

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty. The scan's totals at the ends of texts."""
        data, offsets = buffers(texts)
        total = np.concatenate([[0], np.cumsum(self.changes(data, offsets), dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]


class Words(dict):
    """Ids of words (little-endian unsigned 16- or 32-bit integers), by the library, kept for those met of late."""

    def __init__(self, path: str, memory: int = 600_000):
        self.transducer = compiled(path)
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._blank, self._newline = np.zeros((2, self.tokenizer.get_vocab_size()), bool)  # tokens with a space first, the newline
        self._blank[[i for t, i in self.transducer.ids.items() if t[0] == 32]] = True
        self._newline[self.transducer.ids[b"\n"]] = True

    def _learn(self, new: list[bytes]) -> None:
        """Encodes new words. Most go to the library in rows: those that begin with a space one after another, since no
        other of their tokens begins with one, and those without white space with a newline before each."""
        led, plain, other = [], [], []
        for w in new:
            (other if w in self.transducer.special or w.decode().isspace() else led if w[0] == 32 else plain).append(w)
        for some, mark, skip, starts in ((led, b"", 0, self._blank), (plain, b"\n", 1, self._newline)):
            rows = [(mark + mark.join(some[k : k + 256])).decode() for k in range(0, len(some), 256)]
            if rows:
                ids = np.concatenate([np.array(x.ids, self.type) for x in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)])
                first = np.append(np.flatnonzero(starts[ids]), len(ids)) * self.type.itemsize
                raw, at, skip = ids.tobytes(), first.tolist(), skip * self.type.itemsize
                self.update(zip(some, [raw[a + skip : b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        self.update((w, np.array(x.ids, self.type).tobytes()) for w, x in zip(other, found, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has). Words that aren't known yet go to the library together.

        Equal words are found by hash, and every word is compared with the one that stands for it.
        """
        data, offsets = buffers(texts)
        first = np.flatnonzero(self.transducer.words(data, offsets)[0])
        if not len(first):
            return np.zeros(0, self.type), np.zeros(len(texts), np.int64)
        last, raw = np.append(first[1:], len(data)), data.tobytes()
        _, one, of = np.unique(hashes(data, first, last, cased=True), return_index=True, return_inverse=True)
        like = np.repeat(first[one][of] - first, last - first) + np.arange(len(data))
        if (last - first != (last - first)[one][of]).any() or (data[np.minimum(like, len(data) - 1)] != data).any():
            one = of = np.arange(len(first))
        words = [raw[a:b] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)]
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.memory:
            kept = [(w, self[w]) for w in words if w in self]
            self.clear()
            self.update(kept)
        self._learn(list(dict.fromkeys(new)))
        ids = list(map(self.__getitem__, words))
        size = np.array(list(map(len, ids))) // self.type.itemsize
        table, at = np.frombuffer(b"".join(ids), self.type), np.cumsum(size) - size
        n = size[of]
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.searchsorted(first, offsets)
        return table[np.repeat(at[of] - total[:-1], n) + np.arange(total[-1])], np.diff(total[where])


_compiled: dict[tuple[type, str], object] = {}


def _kept(kind: type, path: str):
    if (kind, path) not in _compiled:
        _compiled[kind, path] = kind(path)
    return _compiled[kind, path]


def compiled(path: str) -> Transducer:
    """This process's transducer of a vocabulary; it outlives a task."""
    return _kept(Transducer, path)


def words(path: str) -> Words:
    """This process's words of a vocabulary; they outlive a task."""
    return _kept(Words, path)
