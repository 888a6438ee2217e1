"""SimHash fingerprints and their comparison by bit planes, for one worker (numpy)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np

#: Members of a block that are compared at once.
BLOCK = 512


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``hashes`` (uint64): a bit is set if it is in over half of the run.

    ``starts``: of the runs, none empty, in order. Works in slices, so that the unpacked bits stay small.
    """
    out = np.zeros(len(starts), np.uint64)
    ends = np.append(starts[1:], len(hashes))
    k = 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + (1 << 16), side="right")))
        counts = np.zeros((j - k, 64), np.int64)
        for low in range(int(starts[k]), int(ends[j - 1]), 1 << 18):
            high = min(low + (1 << 18), int(ends[j - 1]))
            bits = np.unpackbits(hashes[low:high].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            if j - k == 1:
                counts[0] += bits.sum(axis=0, dtype=np.int64)
            else:
                counts += np.add.reduceat(bits, starts[k:j] - low, axis=0, dtype=np.int64)
        packed = np.packbits(2 * counts > (ends[k:j] - starts[k:j])[:, None], axis=1)
        out[k:j] = packed.view(">u8").ravel().astype(np.uint64)
        k = j
    return out


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words) uint64: bit i of a plane's word w is that bit of member 64 w + i."""
    n = len(prints)
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    padded = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    padded[:n] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")


def within(prints: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """(queries, words) uint64: which members of ``prints`` are within ``radius`` bits of each query.

    The planes are added up by carry-save counters of a few bits, for 64 members at a time; what overflows the counter is
    marked as beyond. Queries whose members are all beyond are abandoned, block by block of planes.
    """
    planes = planes_of(prints)
    n, words = len(prints), planes.shape[1]
    out = np.zeros((len(queries), words), np.uint64)
    bits = np.unpackbits(queries.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    live = np.arange(len(queries))
    width = (radius + 1).bit_length()
    counters = [np.zeros((len(queries), words), np.uint64) for _ in range(width)]
    beyond = np.zeros((len(queries), words), np.uint64)
    ones = ~np.uint64(0)
    tail = np.full(words, ones)
    if n % 64:
        tail[-1] = np.uint64((1 << (n % 64)) - 1)

    def far() -> np.ndarray:
        """Members whose count is over the radius."""
        above, equal = beyond.copy(), np.full_like(beyond, ones)
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return above

    for at in range(0, 64, 8):
        for p in range(at, at + 8):
            carry = planes[p][None, :] ^ np.where(bits[live, p, None] == 1, ones, np.uint64(0))
            for c in counters:
                c ^= carry
                carry &= ~c
            beyond |= carry
        if at < 56:
            going = ((~far() & tail) != 0).any(axis=1)
            if not going.all():
                live, beyond = live[going], beyond[going]
                counters = [c[going] for c in counters]
                if not len(live):
                    return out
    out[live] = ~far() & tail
    return out


def spanning_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) of the members of one block: one for each member that is not its component's first."""
    prints = np.unique(prints)
    near = within(prints, prints, radius)
    root = np.full(len(prints), -1)
    alone = np.bitwise_count(near).sum(axis=1) <= 1
    for i in np.flatnonzero(~alone):
        if root[i] >= 0:
            continue
        root[i] = i
        front = [i]
        while front:
            reached = np.unpackbits(near[front].view(np.uint8).reshape(len(front), -1), axis=1, bitorder="little")
            new = np.flatnonzero(reached[:, : len(prints)].any(axis=0) & (root < 0))
            root[new] = i
            front = list(new)
    linked = np.flatnonzero((root >= 0) & (root != np.arange(len(prints))))
    return prints[linked], prints[root[linked]]


def masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """Masks by pigeonhole: fingerprints within ``radius`` agree on at least one; each covers ``blocks - radius`` blocks."""
    edges = [bits * k // blocks for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def link_runs(batches: Iterator[tuple[np.ndarray, np.ndarray]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of fingerprints that share a key; ``batches`` of (key, fingerprint), sorted by key, of which runs may cross batches.

    Whole runs are put together to blocks of about ``BLOCK`` members; a longer run is a block of its own.
    """
    keys, prints = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def blocks(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal keys, prints
        cuts = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)] if last else [])
        cuts = cuts.astype(int)
        low = 0
        while len(cuts) and low < cuts[-1]:
            k = int(np.searchsorted(cuts, low + BLOCK, side="right")) - 1
            high = int(cuts[k]) if k >= 0 and cuts[k] > low else int(cuts[np.searchsorted(cuts, low, side="right")])
            yield spanning_links(prints[low:high], radius)
            low = high
        keys, prints = keys[low:], prints[low:]

    for key, found in batches:
        keys, prints = np.concatenate([keys, key]), np.concatenate([prints, found])
        if len(keys) >= 16 * BLOCK:
            yield from blocks(False)
    if len(keys):
        yield from blocks(True)
