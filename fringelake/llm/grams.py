"""Hashed byte n-grams of texts, as arrays."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z and all ASCII white space to blanks, which keep word borders apart.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 32 else c for c in range(256))
_MULT = np.uint32(0x9E3779B1)
_BASE = np.uint32(0x01000193)


def gram_buckets(text: bytes, sizes: tuple[int, ...], bits: int, *,
                 fold: bool = True) -> list[np.ndarray]:
    """For each size, the buckets of all n-grams of the text between blanks, repeats
    included; with `fold` letter case and kinds of white space don't count."""
    text = text.translate(FOLD) if fold else text
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(data), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            if n > len(data):
                break
            h = h[:len(data) - n + 1] * _BASE + data[n - 1:] + np.uint32(1)
            if n in sizes:
                x = (h ^ np.uint32(n)) * _MULT
                x = (x ^ (x >> np.uint32(15))) * _BASE
                out.append(x >> np.uint32(32 - bits))
    return out


def parts_of(text: bytes, size: int = 1 << 20, overlap: int = 8):
    """A long text in overlapping parts, so that work arrays stay small."""
    for i in range(0, max(len(text), 1), size):
        yield text[i:i + size + overlap]
