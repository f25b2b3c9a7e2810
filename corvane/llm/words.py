"""Words and word hashes shared by the text operators.

Two word definitions are in use, both after lower-casing A-Z only:

* ``space_words``: runs of anything but ASCII white space;
* ``letter_words``: runs of ASCII letters, ASCII digits and non-ASCII characters.

Both work on UTF-8 bytes, where ``bytes.lower`` and ``bytes.split`` touch ASCII
alone. Hashes of words are made for many texts at once: prefix sums of a
polynomial over the bytes give the hash of any run of bytes by a difference.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def letter_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LETTERS).split() if text else []


_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    values = values ^ (values >> _SHIFT)
    values *= _MUL
    values ^= values >> np.uint64(32)
    return values


#: A base that is 3 mod 4, so that powers of it differ in all but a few low bits.
_BASE = 0xC6A4A7935BD1E99B
_SEGMENT = 1 << 21
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made when first needed."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)
        self.letters = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def upto(self, n: int) -> _Powers:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.full(size, _BASE, np.uint64))
            self.down = np.cumprod(np.full(size, inverse, np.uint64))
        return self


_powers = _Powers()


@dataclass(frozen=True)
class Words:
    """The words of some texts: runs of anything but ASCII white space.

    ``data`` is the texts' UTF-8, each followed by a line feed; ``starts`` and
    ``ends`` are byte offsets in it, ``hashes`` 64-bit hashes of the words;
    those of text i are ``first[i]`` to ``first[i + 1]``, its bytes begin at
    ``offset[i]``.
    """

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offset: np.ndarray


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word borders and polynomial hashes of bytes that end in white space."""
    raw = np.frombuffer(data, np.uint8)
    solid = _SOLID[raw]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate((np.zeros(1, edge.dtype), edge))
    starts, ends = edge[0::2], edge[1::2]
    powers = _powers.upto(len(raw))
    sums = powers.letters[raw]
    sums *= powers.up[: len(raw)]
    np.cumsum(sums, out=sums)
    before = sums[starts - 1]
    if len(starts) and starts[0] == 0:
        before[0] = 0
    return starts, ends, mix((sums[ends - 1] - before) * powers.down[starts])


def words_of(texts: list[str | None], lower: bool = False) -> Words:
    """The words of ``texts``, with A-Z in lower case if ``lower``; null as empty."""
    parts = [t.encode() if t else b"" for t in texts]
    offset = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=offset[1:])
    data = b"\n".join([*parts, b""])
    if lower:
        data = data.lower()
    if len(data) <= 2 * _SEGMENT:
        starts, ends, hashes = _hash_words(data)
    else:  # in segments cut at white space, so that memory follows the segment
        found, at = [], 0
        while at < len(data):
            gap = _SPACE.search(data, min(at + _SEGMENT, len(data) - 1))
            piece = data[at : gap.end()]
            a, b, h = _hash_words(piece)
            found.append((a + at, b + at, h))
            at += len(piece)
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offset), offset)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate((np.ones(1, bool), values[1:] != values[:-1]))] if len(values) > 1 else values


def _run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    out = hashes[:n] + np.uint64(width)
    for i in range(1, width):
        out = mix(out)
        out += hashes[i : i + n]
    return mix(out)


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of all runs of ``width`` words of each text.

    Fewer words, but not none, are one shingle; no words give an empty set.
    """
    runs = _run_hashes(words.hashes, width) if len(words.hashes) >= width else words.hashes[:0]
    out = []
    first = words.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            out.append(_distinct(runs[a : b - width + 1]))
        else:
            out.append(_run_hashes(words.hashes[a:b], b - a) if b > a else runs[:0])
    return out
