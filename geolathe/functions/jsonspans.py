"""A structural index over many JSON texts at once: quote, bracket and delimiter bitmaps, depth by prefix sums.

The texts are joined into one buffer. Unescaped quotes toggle "inside a string"; brackets, commas and colons outside of
strings are structural; the running sum of brackets is the depth. Sorted by depth, the structural characters of each
container follow one another, so each two neighbours enclose a key or a value: the value's span, its container, its
place and its key come from array arithmetic, without parsing a character in Python.
"""

from __future__ import annotations

import json

import numpy as np

QUOTE, BACKSLASH, COMMA, COLON, OPEN_A, CLOSE_A, OPEN_O, CLOSE_O = (ord(c) for c in '"\\,:[]{}')


class Spans:
    """Values of the texts: arrays over values (``start``, ``end``, ``char``, ``owner``, ``place``, ``inner``, ``text``).

    owner: the container that holds the value (-1: the text's own root); place: its number there, from 0;
    inner: the container that the value itself is (-1: it's a scalar); text: which text it belongs to;
    key_start, key_end: the span of the key with its quotes (-1 in arrays). Texts whose quotes or brackets don't
    pair up are in ``broken`` and have no values.
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.buffer = b"\n".join(texts) + b"\n"
        b = np.frombuffer(self.buffer, dtype=np.uint8).copy()
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        for s in self.starts[[t[:3] == b"\xef\xbb\xbf" for t in texts]] if len(texts) else []:
            b[s : s + 3] = 32
        self.broken = np.zeros(len(texts), dtype=bool)
        quote = self._quotes(b)
        if len(texts):
            self._drop(b, ends, np.add.reduceat(quote, self.starts, dtype=np.int64) % 2 == 1)
        self._drop(b, ends, self._index(b, ends))
        self._index(b, ends)
        self._values(b, ends)

    def _drop(self, b: np.ndarray, ends: np.ndarray, bad: np.ndarray) -> None:
        """Blanks broken texts out, so that they can't reach into others."""
        for i in np.flatnonzero(bad):
            b[self.starts[i] : ends[i]] = 32
        self.broken |= bad

    def _quotes(self, b: np.ndarray) -> np.ndarray:
        """Quotes that aren't escaped: not behind an odd number of backslashes."""
        quote = b == QUOTE
        slash = np.flatnonzero(b == BACKSLASH)
        if len(slash):
            head = np.concatenate([[True], np.diff(slash) != 1])
            nth = np.arange(len(slash)) - np.maximum.accumulate(np.where(head, np.arange(len(slash)), 0))
            escaped = slash[nth % 2 == 0] + 1
            quote[escaped[escaped < len(b)]] = False
        return quote

    def _index(self, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sets the structural characters and their depths; the texts whose brackets don't pair up."""
        inside = np.bitwise_xor.accumulate(self._quotes(b).view(np.uint8)).view(bool)
        kind = np.zeros(256, dtype=bool)
        kind[[COMMA, COLON, OPEN_A, CLOSE_A, OPEN_O, CLOSE_O]] = True
        self.at = np.flatnonzero(kind[b] & ~inside)
        self.what = b[self.at]
        opens, closes = np.isin(self.what, [OPEN_A, OPEN_O]), np.isin(self.what, [CLOSE_A, CLOSE_O])
        depth = np.cumsum(opens.astype(np.int64) - closes)
        self.level = depth + closes
        self.opens, self.closes = opens, closes
        text = np.searchsorted(ends, self.at, side="right")
        bad = np.zeros(len(ends), dtype=bool)
        if len(self.at):
            first = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
            last = np.concatenate([first[1:] - 1, [len(text) - 1]])
            before = np.concatenate([[0], depth[last[:-1]]])
            low = np.minimum.reduceat(np.where(closes, depth, self.level - opens), first)
            bad[text[first[(depth[last] != before) | (low < before)]]] = True
        self.token_text = text
        return bad

    def _values(self, b: np.ndarray, ends: np.ndarray) -> None:
        order = np.argsort(self.level, kind="stable")
        order = order[self.level[order] > 0]
        at, what, opens, closes = self.at[order], self.what[order], self.opens[order], self.closes[order]
        n = len(order)
        slot = np.maximum.accumulate(np.where(opens, np.arange(n), 0))  # the container's opening, in this order
        # pairs of brackets must be of one kind
        bad = closes & (what != b[at[slot]] + 2)
        if bad.any():
            self.broken[np.unique(self.token_text[order][bad])] = True
        ok = ~self.broken[self.token_text[order]] if n else np.zeros(0, bool)
        commas = np.cumsum(what == COMMA)
        gap = np.flatnonzero(~closes & ok)
        nxt = gap + 1
        to_colon = what[nxt] == COLON if len(gap) else np.zeros(0, bool)
        keys, vals = gap[to_colon], gap[~to_colon]
        solid = np.flatnonzero(~np.isin(b, [32, 9, 10, 13]))
        start = solid[np.minimum(np.searchsorted(solid, at[vals] + 1), max(0, len(solid) - 1))] if len(vals) else vals
        some = start < at[vals + 1]
        vals, start = vals[some], start[some]
        key_of = np.full(n + 1, -1, dtype=np.int64)
        key_of[keys + 1] = keys  # by the colon
        k = key_of[vals]
        roots = np.flatnonzero(~self.broken)
        r0 = solid[np.minimum(np.searchsorted(solid, self.starts[roots]), max(0, len(solid) - 1))] if len(solid) and len(roots) else roots[:0]
        here = r0 < ends[roots] if len(r0) else np.zeros(0, bool)
        roots, r0 = (roots[here], r0[here]) if len(r0) else (roots[:0], r0)
        self.n_roots = len(roots)
        self.start = np.concatenate([r0, start]).astype(np.int64)
        self.end = np.concatenate([ends[roots] - 1, at[vals + 1] if len(vals) else vals]).astype(np.int64)
        self.char = b[self.start]
        # containers are numbered in the order of their openings in the buffer
        open_at = np.sort(at[opens])
        self.owner = np.concatenate([np.full(len(roots), -1), np.searchsorted(open_at, at[slot[vals]])]).astype(np.int64)
        self.place = np.concatenate([np.zeros(len(roots), np.int64), commas[vals] - commas[slot[vals]] if len(vals) else vals]).astype(np.int64)
        box = np.isin(self.char, [OPEN_A, OPEN_O])
        self.inner = np.where(box, np.searchsorted(open_at, self.start), -1)
        self.text = np.concatenate([roots, self.token_text[order][vals] if len(vals) else vals]).astype(np.int64)
        named = np.concatenate([np.full(len(roots), -1), k]).astype(np.int64)
        self.key_start, self.key_end = np.full(len(named), -1, dtype=np.int64), np.full(len(named), -1, dtype=np.int64)
        has = named >= 0
        if has.any():
            ks = solid[np.searchsorted(solid, at[named[has]] + 1)]
            before = np.searchsorted(solid, at[named[has] + 1]) - 1
            self.key_start[has], self.key_end[has] = ks, solid[before] + 1
        self.boxes = len(open_at)
        self.box_char = b[open_at]
        self.bytes = b

    def keyed(self, name: str, any_case: bool = False) -> np.ndarray:
        """Positions of the values whose key is ``name``."""
        want = name.encode()
        out = self.key_end - self.key_start == len(want) + 2
        at = np.flatnonzero(out)
        for i, c in enumerate(want):
            got = self.bytes[self.key_start[at] + 1 + i]
            at = at[(got | 32) == (c | 32) if any_case and chr(c).isalpha() else got == c]
        longer = np.flatnonzero((self.key_end - self.key_start > len(want) + 2) & (self.key_start >= 0))
        if len(longer) and self.has_slash:  # a key written with escapes
            longer = longer[[b"\\" in self.buffer[s:e] for s, e in zip(self.key_start[longer], self.key_end[longer])]]
            same = [self._plain(i, any_case) == (name.lower() if any_case else name) for i in longer]
            at = np.sort(np.concatenate([at, longer[np.array(same, dtype=bool)]])) if len(longer) else at
        return at

    @property
    def has_slash(self) -> bool:
        return b"\\" in self.buffer

    def _plain(self, i: int, lower: bool) -> str | None:
        try:
            key = json.loads(self.buffer[self.key_start[i] : self.key_end[i]])
        except ValueError:
            return None
        return key.lower() if lower else key

    def by_box(self, values: np.ndarray) -> np.ndarray:
        """For each container, the last of ``values`` that it holds, or -1."""
        out = np.full(self.boxes + 1, -1, dtype=np.int64)
        values = values[self.owner[values] >= 0]
        out[self.owner[values]] = values
        return out

    def member(self, boxes: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        return np.where(boxes >= 0, lookup[boxes], -1)

    def raw(self, i: int) -> str:
        return self.buffer[self.start[i] : self.end[i]].decode("utf-8", "replace").rstrip()

    def equals(self, values: np.ndarray, text: str) -> np.ndarray:
        """Which of the values (-1 allowed) are the string ``text``."""
        want = f'"{text}"'.encode()
        safe = np.maximum(values, 0)
        start = self.start[safe] if len(self.start) else safe
        out = (values >= 0) & (start + len(want) <= len(self.bytes))
        for i, c in enumerate(want):
            out[out] = self.bytes[start[out] + i] == c
        return out

    def children(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For containers without repeats: (index into ``boxes``, value) of everything they hold, in order of place."""
        at = np.full(self.boxes + 1, -1, dtype=np.int64)
        at[boxes] = np.arange(len(boxes))
        held = np.flatnonzero(self.owner >= 0)
        of = at[self.owner[held]]
        held, of = held[of >= 0], of[of >= 0]
        order = np.lexsort((self.start[held], of))
        return of[order], held[order]
