"""Sorting the suffixes of a block by a difference cover, for one worker (numpy)."""

from __future__ import annotations

import numpy as np

#: A difference cover: every difference modulo PERIOD is one of two members'. Fixed values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
#: For each residue the shifts that lead into the cover, as bits.
_SHIFTS = np.array([sum(1 << d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD]) for r in range(PERIOD)], np.int64)


class Suffixes:
    """The suffixes of the pieces of a block; each ends with its piece.

    Suffixes are compared by their first 31 bytes and, if these tie, by the ranks of two suffixes of the cover sample, one the same number of
    bytes behind each; these ranks are made once. So a tie of any length costs one look, and memory is some words a byte of the block.
    """

    def __init__(self, block: np.ndarray, ends: np.ndarray):
        """``block``: bytes; ``ends``: rising ends of the pieces, which fill the block."""
        n = len(block)
        self.end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        left = self.end_of - np.arange(n)
        padded = np.concatenate([block, np.zeros(8, np.uint8)])
        self.words = np.zeros(n + 1, np.uint64)
        for k in range(8):  # big-endian, zero behind the piece
            self.words[:n] |= np.where(left > k, padded[k : n + k], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
        self.left = np.append(left, 0)
        self.n = n
        self.ranks = self._sample_ranks()

    def _word(self, at: np.ndarray, offset: int, size: int = 8) -> np.ndarray:
        """The ``size`` bytes at ``offset`` behind each place, 0 behind the piece."""
        inside = self.left[at] > offset
        found = np.where(inside, self.words[np.where(inside, at + offset, self.n)], np.uint64(0))
        return found if size == 8 else found >> np.uint64(64 - 8 * size)

    def heads(self, at: np.ndarray) -> list[np.ndarray]:
        """Keys for the first 31 bytes; the last also holds how many of them there are, for pieces that end sooner."""
        last = self._word(at, 24, 7) << np.uint64(8)
        return [self._word(at, 0), self._word(at, 8), self._word(at, 16), last | np.minimum(self.left[at], PERIOD).astype(np.uint64)]

    def _sample_ranks(self) -> np.ndarray:
        """The rank of each suffix of the cover sample, from 1, equal suffixes sharing one; 0 elsewhere."""
        at = np.flatnonzero(_IN_COVER[np.arange(self.n) % PERIOD])
        ranks = np.zeros(self.n + 1, np.int64)
        if not len(at):
            return ranks
        ranks[at] = _dense(self.heads(at))
        reach, longest = PERIOD, int(self.left.max())
        while reach < longest:  # a sample place and one whole periods behind are both in the sample
            inside = self.left[at] > reach
            behind = np.where(inside, ranks[np.where(inside, at + reach, self.n)], 0)
            ranks[at] = _dense([ranks[at], behind])
            reach *= 2
        return ranks

    def sort(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The order of the suffixes ``at`` (each with 31 bytes or more) within their ``bucket``s."""
        keys = [bucket, *self.heads(at)]
        order = np.lexsort(keys[::-1])
        same = np.ones(len(at), bool)
        same[:1] = False
        for key in keys:
            sorted_key = key[order]
            same[1:] &= sorted_key[1:] == sorted_key[:-1]
        group = np.cumsum(~same) - 1
        first = np.flatnonzero(~same)
        sizes = np.diff(np.append(first, len(at)))
        if not (sizes > 1).any():
            return order
        shifts = _SHIFTS[at[order] % PERIOD]
        common = np.bitwise_and.reduceat(shifts, first)
        # one shift that leads all of a tie into the sample, else by pairs
        low = (common & -common).astype(np.float64)
        shift = np.where(common > 0, np.log2(np.maximum(low, 1)), 0).astype(np.int64)
        place = at[order] + shift[group]
        key = np.where((common > 0)[group] & (sizes > 1)[group], self.ranks[np.minimum(place, self.n)], 0)
        order = order[np.lexsort((key, group))]
        for g in np.flatnonzero((common == 0) & (sizes > 1)):
            part = order[first[g] : first[g] + sizes[g]]
            order[first[g] : first[g] + sizes[g]] = self._by_pairs(part, at)
        return order

    def _by_pairs(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``part``, whose first 31 bytes tie, in order: residues that share a shift are sorted at once, then merged by looks at pairs."""
        from functools import cmp_to_key

        ranks, places = self.ranks, at

        def compare(a: int, b: int) -> int:
            i, j = int(places[a]), int(places[b])
            both = int(_SHIFTS[i % PERIOD] & _SHIFTS[j % PERIOD])
            d = (both & -both).bit_length() - 1
            return int(ranks[i + d] - ranks[j + d])

        return np.array(sorted(part.tolist(), key=cmp_to_key(compare)))

    def same_prefix(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Whether each suffix, in order, has the first ``depth`` bytes of the one before (both have as many)."""
        out = np.zeros(len(at), bool)
        if len(at) > 1:
            out[1:] = True
            for k in range(0, depth, 8):
                word = self._word(at, k, min(8, depth - k))
                out[1:] &= word[1:] == word[:-1]
        return out


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 by ``keys``, the first the most significant; equal keys share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out
