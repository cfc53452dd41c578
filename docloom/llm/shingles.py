"""Hashed word shingles of one text, with array operations only."""

import numpy as np

from docloom.llm.common import U, mix, seeds

WIDTH = 5

# White space of the word rule: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = seeds(256, 1) | U(1)
STEP = U(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each white-space word of ``text``, A-Z taken as a-z."""
    codes = np.frombuffer(text.lower(), dtype=np.uint8)
    inside = ~SPACE[codes]
    if not inside.any():
        return np.zeros(0, dtype=U)
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    letters = LETTER[codes[inside]]
    power = np.ones(int(lengths.max()), dtype=U)
    power[1:] = STEP
    power = np.multiply.accumulate(power)
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(letters * power[place], first) + lengths.astype(U))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` make one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    out = np.full(count, U(width))
    for at in range(width):
        out = out * STEP + words[at : at + count]
    return np.unique(mix(out))
