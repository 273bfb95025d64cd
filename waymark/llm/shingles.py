"""Texts as sets of word shingles."""

import numpy as np
import xxhash

from waymark.llm.common import word_blocks
from waymark.llm.decontaminate import Hashes, grams


def shingle_set(data: bytes, known: Hashes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all word shingles; none without words.

    A-Z count as a-z, words lie between ASCII white space, fewer words than a
    shingle are one shingle.
    """
    found, tail = [], np.empty(0, np.uint64)
    for words in word_blocks(data):
        here = np.fromiter((known[w.lower()] for w in words), np.uint64, len(words))
        here = np.concatenate([tail, here])
        tail = here[max(0, len(here) - shingle + 1) :]
        if len(here) >= shingle:
            found.append(np.unique(grams(here, shingle)))
    if not found:
        return grams(tail, len(tail)) if len(tail) else tail
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def class_of(found: np.ndarray) -> int:
    """The number that texts of equal shingle sets share, as a signed long."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)
