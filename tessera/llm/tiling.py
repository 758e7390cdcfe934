"""Greedy string tiling: the longest common runs of two word sequences, marked without overlap, longest first."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

#: Base and modulus of the rolling hash.
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def _hashes(sequence: Sequence[int], length: int) -> list[int]:
    """Karp–Rabin hashes of all windows of a length."""
    top = pow(BASE, length - 1, MODULUS)
    value = 0
    out = []
    for i, x in enumerate(sequence):
        if i >= length:
            value = (value - sequence[i - length] * top) % MODULUS
        value = (value * BASE + x) % MODULUS
        if i >= length - 1:
            out.append(value)
    return out


def tiles(a: Sequence, b: Sequence, least: int) -> list[tuple[int, int, int]]:
    """(position in a, position in b, length) of the tiles of at least `least` words, in order of a.

    Seeds are the windows of `least` words that both share, found by their rolling hash and verified. Every seed is
    extended to its maximal match; matches are taken from the longest, cut back where a tile already lies and set aside
    if less than `least` remains. Each word of either side is in at most one tile."""
    if least < 1 or len(a) < least or len(b) < least:
        return []
    number: dict = {}
    x = [number.setdefault(w, len(number) + 1) for w in a]
    y = [number.setdefault(w, len(number) + 1) for w in b]
    where = defaultdict(list)
    for j, h in enumerate(_hashes(y, least)):
        where[h].append(j)
    found = []
    covered: dict[int, int] = {}  # by diagonal: up to where in a it is matched already
    for i, h in enumerate(_hashes(x, least)):
        for j in where.get(h, ()):
            if covered.get(i - j, -1) >= i + least or x[i : i + least] != y[j : j + least]:
                continue
            end = i + least
            while end < len(x) and end - i + j < len(y) and x[end] == y[end - i + j]:
                end += 1
            covered[i - j] = end
            found.append((i, j, end - i))
    found.sort(key=lambda m: (-m[2], m[0], m[1]))
    used_a, used_b, out = bytearray(len(x)), bytearray(len(y)), []
    # Matches cut back by earlier tiles wait in order of what is left of them.
    heap = [(-n, i, j) for i, j, n in found]
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if not used_a[i + k] and not used_b[j + k]]
        if len(free) == n:
            used_a[i : i + n] = used_b[j : j + n] = b"\x01" * n
            out.append((i, j, n))
            continue
        run = 0
        for k in range(n + 1):
            if k < n and not used_a[i + k] and not used_b[j + k]:
                run += 1
            else:
                if run >= least:
                    heapq.heappush(heap, (-run, i + k - run, j + k - run))
                run = 0
    return sorted(out)
