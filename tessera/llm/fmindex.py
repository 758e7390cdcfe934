"""A compressed full-text index over word sequences, searched backwards for many texts at once.

The index is a compressed suffix array. For each row of the sorted suffixes it keeps the row of the suffix one symbol
later; within the rows of one symbol these grow, so they are stored as gaps, packed by byte planes. The same numbers,
read as (symbol, row) codes, make one step of backward search for a whole batch two binary searches. The rows of every
SAMPLED-th position are kept, from which the texts and the places of all rows are unfolded: the index holds its texts.
"""

from __future__ import annotations

import io

import numpy as np

#: Symbol between two texts of the index; never part of a query.
PART = 0
#: Positions from one kept row to the next.
SAMPLED = 64


class FMIndex:
    """Index over texts given as one flat array of symbols (>= 1) and the offsets where each begins (and the end)."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        count = len(offsets) - 1
        self.n = n = len(flat) + count + 1
        sequence = np.zeros(n, np.int64)
        sequence[np.arange(len(flat)) + np.repeat(np.arange(count), np.diff(offsets))] = flat
        self.starts = offsets[:-1] + np.arange(count)
        rows = suffix_array(sequence)
        self.width = n + 1
        codes = sequence[rows - 1] * self.width + np.arange(n)
        at = np.empty(n, np.int64)
        at[rows] = np.arange(n)
        # The suffix of the last symbol is the least; behind it the texts begin again.
        codes[at[0]] = -1
        self.codes = np.sort(codes)
        self.codes[0] = at[0]
        self.samples = at[::SAMPLED]
        self._unfold()

    def _unfold(self) -> None:
        """The symbols in their order and the text of each row, walked from all samples at once."""
        self.sequence = np.zeros(self.n, np.int32)
        self.texts = np.zeros(self.n, np.int32)
        rows, at = self.samples, np.arange(len(self.samples)) * SAMPLED
        text = np.searchsorted(self.starts, np.arange(self.n), side="right") - 1
        for _ in range(min(SAMPLED, self.n)):
            symbol, follows = np.divmod(self.codes[rows], self.width)
            self.sequence[at], self.texts[rows] = symbol, text[at]
            at, rows = at + 1, follows
            inside = at < self.n
            rows, at = rows[inside], at[inside]

    def to_bytes(self) -> bytes:
        """The index in its compressed form: gaps by byte planes, samples and where texts begin."""
        planes = np.diff(self.codes, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
        out = io.BytesIO()
        np.savez_compressed(out, planes=np.ascontiguousarray(planes), samples=self.samples.astype(np.uint32), starts=np.diff(self.starts, prepend=0).astype(np.uint32))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        """The index that to_bytes() gave."""
        made = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            planes = np.ascontiguousarray(parts["planes"].T).view("<u8").ravel()
            made.codes = np.cumsum(planes.astype(np.int64))
            made.samples, made.starts = parts["samples"].astype(np.int64), np.cumsum(parts["starts"].astype(np.int64))
        made.n = len(made.codes)
        made.width = made.n + 1
        made._unfold()
        return made

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the matches [low, high) extended by a symbol on the left; an empty range if there are none."""
        base = symbol * self.width
        return np.searchsorted(self.codes, base + low), np.searchsorted(self.codes, base + high)

    def text_of(self, rows: np.ndarray) -> np.ndarray:
        """The number of the text in which the suffix of each row begins."""
        return self.texts[rows]


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Rows of the sorted suffixes, by doubling the compared length until all ranks differ."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while True:
        code = rank * (n + 1)
        code[: n - reach] += rank[reach:] + 1
        order = np.argsort(code, kind="stable")
        ordered = code[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        rank = fresh
        if rank[order[-1]] == n - 1 or reach >= n:
            return order
        reach *= 2


def pieces(index: FMIndex, flat: np.ndarray, offsets: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each query, from its end backwards, into pieces that stand in the index at no more than so many places.

    flat holds the symbols of the queries; a value below 0 is a word the index doesn't have. A match grows to the left
    until its places are few or, with places = 0, until it is maximal: the word that ends it is the piece's last and
    the piece stands nowhere. What is left at the beginning of a query is a piece too, with all places it has.
    Returns (query, low, high)."""
    query = np.flatnonzero(np.diff(offsets) > 0)
    at, first = offsets[query + 1] - 1, offsets[query]
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    while len(query):
        symbol = flat[at]
        low, high = index.step(np.maximum(symbol, PART), low, high)
        high = np.where(symbol < 0, low, high)
        done = (high - low <= places) | (at == first)
        out.append((query[done], low[done], high[done]))
        low, high = np.where(done, 0, low), np.where(done, index.n, high)
        stay = at > first
        query, at, first, low, high = query[stay], at[stay] - 1, first[stay], low[stay], high[stay]
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]
