"""Minimum-edit path and distance of two sequences, one bit for each cell of the cost table.

Neighbouring cells of the table differ by -1, 0 or 1, so a row is two long integers: where the cost rises and where it
falls along the candidate. A row follows from the one above by a few operations on whole integers, whatever its length.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from math import isqrt

import numpy as np

MATCH, SUBSTITUTION, DELETION, INSERTION = 0, 1, 2, 3


class _Table:
    """Rows of the cost table of ``reference`` (down) against ``candidate`` (along)."""

    def __init__(self, candidate: Sequence[Hashable]):
        self.width = len(candidate)
        self.full = (1 << self.width) - 1
        places: dict[Hashable, list[int]] = {}
        for at, token in enumerate(candidate):
            places.setdefault(token, []).append(at)
        self.where = {token: _with_bits(found, self.width) for token, found in places.items()}

    def rows(self, reference: Sequence[Hashable], rises: int, falls: int) -> Iterator[tuple[int, int, int, int]]:
        """(rises, falls, more, less) of each row: steps along the row, and steps from the row above."""
        full = self.full
        for token in reference:
            equal = self.where.get(token, 0)
            free = equal | falls
            diagonal = (((equal & rises) + rises) ^ rises) | equal
            more = (falls | ~(diagonal | rises)) & full
            less = rises & diagonal
            shifted = (more << 1 | 1) & full
            rises = ((less << 1) | ~(free | shifted)) & full
            falls = shifted & free
            yield rises, falls, more, less


def _with_bits(places: list[int], width: int) -> int:
    data = bytearray(width // 8 + 1)
    for at in places:
        data[at >> 3] |= 1 << (at & 7)
    return int.from_bytes(data, "little")


def edit_path(reference: Sequence[Hashable], candidate: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Operations with their reference and candidate positions (-1 where absent).

    Ties prefer match, then substitution, deletion, insertion, looking back from the end. Only every k-th row
    is kept; the rows between are made again while tracing back, so memory is about
    ``len(candidate) * sqrt(len(reference)) / 2`` bytes.
    """
    reference, candidate = list(reference), list(candidate)
    n, m = len(reference), len(candidate)
    table = _Table(candidate)
    stride = max(1, isqrt(n))
    kept, cost = [(table.full, 0)], m
    for i, (rises, falls, more, less) in enumerate(table.rows(reference, table.full, 0), 1):
        cost += (more >> m - 1 & 1) - (less >> m - 1 & 1) if m else 1
        if i % stride == 0:
            kept.append((rises, falls))

    ops: list[int] = []
    i, j, base = n, m, -1
    rows: list[tuple[int, int, int, int]] = []
    while i or j:
        if i and j:
            if base < 0 or i <= base:
                base = (i - 1) // stride * stride
                rows = [(*kept[base // stride], 0, 0), *table.rows(reference[base:i], *kept[base // stride])]
            bit = j - 1
            _, _, more, less = rows[i - base]
            rises, falls, _, _ = rows[i - 1 - base]
            above = cost - (more >> bit & 1) + (less >> bit & 1)
            corner = above - (rises >> bit & 1) + (falls >> bit & 1)
            same = reference[i - 1] == candidate[j - 1]
            if corner + (not same) == cost:
                op, cost = (MATCH if same else SUBSTITUTION), corner
            elif above + 1 == cost:
                op, cost = DELETION, above
            else:
                op, cost = INSERTION, cost - 1
        else:
            op = DELETION if i else INSERTION
        i -= op != INSERTION
        j -= op != DELETION
        ops.append(op)
    done = np.array(ops[::-1], dtype=np.int32)
    down, along = done != INSERTION, done != DELETION
    return (
        done, np.where(down, np.cumsum(down) - 1, -1).astype(np.int32), np.where(along, np.cumsum(along) - 1, -1).astype(np.int32),
    )


def edit_distance(reference: Sequence[Hashable], candidate: Sequence[Hashable]) -> int:
    """Edits between two sequences, after common ends are taken off."""
    first, shorter = 0, min(len(reference), len(candidate))
    while first < shorter and reference[first] == candidate[first]:
        first += 1
    last = 0
    while last < shorter - first and reference[-1 - last] == candidate[-1 - last]:
        last += 1
    reference, candidate = reference[first:len(reference) - last], candidate[first:len(candidate) - last]
    if len(candidate) > len(reference):
        reference, candidate = candidate, reference
    cost, top = len(candidate), len(candidate) - 1
    if not cost:
        return len(reference)
    table = _Table(candidate)
    for _, _, more, less in table.rows(reference, table.full, 0):
        cost += (more >> top & 1) - (less >> top & 1)
    return cost
