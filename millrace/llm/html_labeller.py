"""A bidirectional LSTM in numpy that labels every block of a page as main text or not."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .html_blocks import NUMBERS, PATHS, WORDS, Block, numbers, path_codes, word_codes

#: Size of a block's vector and of the state of each direction.
VECTOR, STATE = 32, 24
WEIGHTS = os.path.join(os.path.dirname(__file__), "html_labeller.npz")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int) -> dict[str, np.ndarray]:
    """Weights to train from; hashed tokens that training never meets keep vectors of zeros."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {"paths": np.zeros((PATHS, VECTOR), np.float32), "words": np.zeros((WORDS, VECTOR), np.float32), "numbers": draw(NUMBERS, VECTOR), "bias": draw(1, VECTOR)[0]}
    for d in "lr":
        out |= {f"{d}x": draw(VECTOR, 4 * STATE), f"{d}h": draw(STATE, 4 * STATE), f"{d}b": np.zeros(4 * STATE, np.float32)}
        out[f"{d}b"][STATE : 2 * STATE] = 1
    return out | {"out": draw(2 * STATE + VECTOR, 1), "out_bias": np.zeros(1, np.float32)}


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as found:
        return {k: found[k].astype(np.float32) for k in found.files}


class Input:
    """The hashed tokens and numbers of pages, padded to the longest: (step, page)."""

    def __init__(self, pages: list[list[Block]]):
        self.steps, self.pages = max(map(len, pages)), len(pages)
        self.lengths = np.array([len(p) for p in pages])
        self.mask = np.arange(self.steps)[:, None] < self.lengths[None, :]
        self.numbers = np.zeros((self.steps, self.pages, NUMBERS), np.float32)
        self.tokens: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        flat: dict[str, tuple[list[int], list[int], list[float]]] = {"paths": ([], [], []), "words": ([], [], [])}
        for p, page in enumerate(pages):
            if page:
                self.numbers[: len(page), p] = numbers(page)
            for t, block in enumerate(page):
                for kind, codes in (("paths", path_codes(block.path)), ("words", word_codes(block))):
                    if codes:
                        cells, tokens, shares = flat[kind]
                        cells += [t * self.pages + p] * len(codes)
                        tokens += codes
                        shares += [1.0 if kind == "paths" else 1 / len(codes)] * len(codes)
        for kind, (cells, tokens, shares) in flat.items():
            self.tokens[kind] = np.array(cells, np.int64), np.array(tokens, np.int64), np.array(shares, np.float32)


def vectors(w: dict[str, np.ndarray], x: Input) -> np.ndarray:
    """(steps, pages, VECTOR), within -1 and 1."""
    out = x.numbers.reshape(-1, NUMBERS) @ w["numbers"] + w["bias"]
    for kind, (cells, tokens, shares) in x.tokens.items():
        if len(cells):
            order = np.argsort(cells, kind="stable")
            cells, tokens, shares = cells[order], tokens[order], shares[order]
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            out[cells[first]] += np.add.reduceat(w[kind][tokens] * shares[:, None], first, axis=0)
    return np.tanh(out).reshape(x.steps, x.pages, VECTOR)


def lstm(w: dict[str, np.ndarray], d: str, e: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (steps, pages, STATE) of one direction; ``r`` reads from the end. Padding leaves a state as it is."""
    steps, pages, _ = e.shape
    into = e @ w[f"{d}x"] + w[f"{d}b"]
    h, c = np.zeros((pages, STATE), np.float32), np.zeros((pages, STATE), np.float32)
    out = np.empty((steps, pages, STATE), np.float32)
    for t in range(steps) if d == "l" else range(steps - 1, -1, -1):
        z = into[t] + h @ w[f"{d}h"]
        gates, new = sigmoid(z[:, : 3 * STATE]), np.tanh(z[:, 3 * STATE :])
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        c2 = f * c + i * new
        s = np.tanh(c2)
        m = mask[t][:, None]
        if tape is not None:
            tape.append((t, h, c, i, f, o, new, s, m))
        h, c = np.where(m, o * s, h), np.where(m, c2, c)
        out[t] = h
    return out


def logits(w: dict[str, np.ndarray], x: Input) -> np.ndarray:
    """(steps, pages): above 0 for main text, by a context of the whole page."""
    e = vectors(w, x)
    both = np.concatenate([lstm(w, "l", e, x.mask), lstm(w, "r", e, x.mask), e], axis=2)
    return (both @ w["out"] + w["out_bias"])[:, :, 0]


def label(pages: list[list[Block]], batch: int = 128) -> list[np.ndarray]:
    """For each page, which of its blocks are main text. Pages of like lengths are read together."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        chosen = order[at : at + batch]
        while len(chosen) > 1 and len(pages[chosen[-1]]) * len(chosen) > 64 * batch:
            chosen = chosen[: len(chosen) // 2]
        x = Input([pages[k] for k in chosen])
        found = logits(trained(), x) > 0
        for j, k in enumerate(chosen):
            out[k] = found[: len(pages[k]), j]
        at += len(chosen)
    return out
