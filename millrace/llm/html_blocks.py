"""HTML to blocks: leaf texts in page order, each with the path of its elements and hashed features."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np

#: Elements that are part of the line they stand in; any other begins and ends a block. Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr object canvas "
    "math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mfenced mstyle mspace semantics".split()
)
#: Elements without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and, but for that of xmp, never text of the page. Fixed values.
RAW = "script style textarea iframe noembed noframes xmp template svg select annotation"
#: What an opening element closes, if it is open and no element after the bar stands between. Fixed values.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}

#: What stands between a tag's name and its end. A quote counts where it begins a value and is closed; at most one of each kind is not, so that each
#: character is read a bounded number of times, however long values are.
_REST = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW.split())})\b{_REST}(?:(?<=/)>|>(?P<inside>.*?)(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST}(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+|[0-9]+")

#: Buckets of hashed path tokens and of hashed words, numbers to a block.
PATHS, WORDS, NUMBERS = 1024, 512, 8


@dataclass
class Block:
    """A leaf text and what its element path and links tell."""

    path: tuple[str, ...]
    text: str
    linked: int = 0
    words: list[str] = field(default_factory=list)


@lru_cache(maxsize=1 << 14)
def _names(rest: str) -> tuple[str, ...]:
    """The words of an element's class, id and role."""
    found = (a or b or c for a, b, c in _NAMES.findall(rest))
    return tuple(dict.fromkeys(w for x in found for w in _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", x).lower())))


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page that have text; character references decoded, white space runs made one space."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                path = tuple(x for name, names in stack if name not in INLINE for x in (name, *("." + n for n in names)))
                out.append(Block(path, " ".join(words), linked, words))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        for name, _ in stack[k:]:
            links -= name == "a"
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        name = (m["name"] or "").lower()
        if (m["raw"] or "").lower() == "xmp":
            flush()
            parts.append(html.escape(m["inside"] or ""))
            flush()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name not in INLINE
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if block:
                flush()
            if k >= 0 and (block or all(x in INLINE for x, _ in stack[k:])):
                pop_to(k)
            continue
        if block:
            flush()
            if name not in VOID:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), -1)
                if k >= 0 and stack[k][0] == "p":
                    pop_to(k)
            if name in CLOSES:
                closed, walls = CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in walls:
                        break
                    if stack[k][0] in closed:
                        pop_to(k)
        if name not in VOID and not (m["rest"] or "").endswith("/>"):
            stack.append((name, _names(m["rest"]) if block else ()))
            links += name == "a"
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    flush()
    return out


@lru_cache(maxsize=1 << 14)
def path_codes(path: tuple[str, ...]) -> tuple[int, ...]:
    """Buckets of a path's tokens; the two innermost elements count once more as such."""
    names = [x for x in path if x[0] != "."]
    tokens = dict.fromkeys([*path, *("^" + x for x in names[-1:]), *("^^" + x for x in names[-2:-1])])
    return tuple(crc32(t.encode()) % PATHS for t in tokens)


@lru_cache(maxsize=1 << 16)
def _word_code(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def word_codes(block: Block) -> list[int]:
    """Buckets of all words of a block, lower-cased."""
    return [(_word_code if len(w) <= 40 else _word_code.__wrapped__)(w.lower()) for w in block.words]


def numbers(found: list[Block]) -> np.ndarray:
    """(blocks, NUMBERS): length, links, punctuation, places."""
    n = len(found)
    out = np.empty((n, NUMBERS), np.float32)
    for k, b in enumerate(found):
        size, m = len(b.text), len(b.words)
        stops = b.text.count(".") + b.text.count(",")
        out[k] = (np.log1p(m) / 4, np.log1p(size) / 6, min(1.0, b.linked / size), min(1.0, stops / m), b.text[-1] in ".!?", k / n, (n - k) / n, "©" in b.text)
    return out
