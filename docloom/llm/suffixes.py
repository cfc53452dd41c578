"""Suffix array by two-stage sorting, in array operations, to a limited depth.

A suffix is *small* if it is smaller than the suffix one place further on. Small suffixes are
sorted directly. All others begin with a byte that is followed by something smaller, so one scan
over the buckets of first bytes, in order, puts each behind the suffix that follows it.
"""

import numpy as np

from docloom.llm.common import U

#: Bytes compared at a time.
WORD = 8
#: Suffixes whose words are gathered at a time.
ROWS = 1 << 15


def padded(data: bytes, depth: int) -> np.ndarray:
    """``data`` with zeros behind it, so that every suffix has ``depth`` whole words."""
    out = np.zeros(len(data) + depth + 2 * WORD, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


def words(codes: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
    """(len(places), count) unsigned words at the places; only their equality means something."""
    view = np.lib.stride_tricks.as_strided(codes, (len(codes) - count * WORD + 1, count * WORD), (1, 1))
    return view[places].view(U)


def small(codes: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; runs of a byte go by what ends them."""
    step = np.sign(codes[1:].astype(np.int16) - codes[:-1])
    differs = np.where(step != 0, np.arange(len(step)), len(step))
    after = np.minimum.accumulate(differs[::-1])[::-1]
    rises = np.append(step, -1)
    return np.append(rises[after] > 0, False)


def sort_directly(codes: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their first ``depth`` bytes, rounded up to whole words.

    Sorted by one word first; then each group that is still tied skips the words which all of it
    shares and is sorted by the next one, until its members agree to the full depth.
    """
    count = -(-depth // WORD)
    key = words(codes, places, 1)[:, 0].byteswap()
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    # Positions in ``places`` that are tied, and the position where their group begins.
    tied, heads = _ties(np.arange(len(places)), key, np.zeros(len(places), dtype=np.int64))
    while len(tied):
        shared = np.empty(len(tied), dtype=np.int64)
        for at in range(0, len(tied), ROWS):
            part = slice(at, at + ROWS)
            differ = words(codes, places[tied[part]], count) != words(codes, places[heads[part]], count)
            first = differ.argmax(axis=1)
            first[~differ[np.arange(len(first)), first]] = count
            shared[part] = first
        starts = np.flatnonzero(tied == heads)
        sizes = np.diff(np.append(starts, len(tied)))
        skip = np.repeat(np.minimum.reduceat(shared, starts), sizes)
        open_ = skip < count
        tied, heads, skip = tied[open_], heads[open_], skip[open_]
        if not len(tied):
            break
        own = places[tied]
        key = words(codes, own + skip * WORD, 1)[:, 0].byteswap()
        order = np.lexsort((key, heads))
        places[tied] = own[order]
        tied, heads = _ties(tied, key[order], heads)
    return places


def _ties(at: np.ndarray, key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``at`` that share group and key with a neighbour, and the first of their run."""
    if not len(at):
        return at, at
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(at)))
    keep = np.repeat(sizes > 1, sizes)
    return at[keep], np.repeat(at[starts], sizes)[keep]


def suffix_array(codes: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` suffixes of ``codes`` (as ``padded`` gives it) in the order of at least
    their first ``depth`` bytes.

    ``wanted`` flags places; a large suffix also needs those up to the next small one, which
    are sorted along and left out of the result.
    """
    is_small = small(codes)
    size = len(codes)
    nearest = np.where(is_small, np.arange(size), size)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    # Places from a wanted one up to the next small suffix.
    edges = np.zeros(size + 2, dtype=np.int64)
    asked = np.flatnonzero(wanted)
    np.add.at(edges, asked, 1)
    np.add.at(edges, np.minimum(nearest[asked], size - 1) + 1, -1)
    needed = np.cumsum(edges)[:size] > 0
    # Zeros behind the text end every run of large suffixes: the last place starts the scan.
    needed[-1] = needed[-1] or bool((nearest[asked] == size).any())
    direct = sort_directly(codes, np.flatnonzero(needed & is_small), depth)
    large = needed & ~is_small
    limits = np.searchsorted(codes[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if large[-1]:
        induced[codes[-1]].append(np.array([size - 1]))
    out = []
    for byte in range(256):
        own = induced[byte]
        # Large suffixes that begin with a run of this byte follow those that it leads to.
        wave = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
        own = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[large[before] & (codes[before] == byte)]
            own.append(wave)
        bucket = np.concatenate([*own, direct[limits[byte] : limits[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before]]
        first = codes[before]
        later = first > byte
        before, first = before[later], first[later]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else []:
            induced[codes[part[0]]].append(part)
    ranked = np.concatenate(out)
    return ranked[wanted[ranked]]


def common_prefix_reaches(codes: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes ``left`` and ``right`` share their first ``depth`` bytes."""
    count, odd = divmod(depth, WORD)
    alike = np.ones(len(left), dtype=bool)
    if count:
        alike = words(codes, left, 1)[:, 0] == words(codes, right, 1)[:, 0]
    rest = np.flatnonzero(alike)
    for at in range(0, len(rest), ROWS):
        part = rest[at : at + ROWS]
        same = np.ones(len(part), dtype=bool)
        if count:
            same = (words(codes, left[part], count) == words(codes, right[part], count)).all(axis=1)
        for byte in range(count * WORD, count * WORD + odd):
            same &= codes[left[part] + byte] == codes[right[part] + byte]
        alike[part] = same
    return alike


def repeated(codes: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Flags of the ``wanted`` places whose first ``depth`` bytes also start at another one."""
    ranked = suffix_array(codes, wanted, depth)
    flags = np.zeros(len(codes), dtype=bool)
    if len(ranked) > 1:
        same = common_prefix_reaches(codes, ranked[:-1], ranked[1:], depth)
        flags[ranked[:-1][same]] = True
        flags[ranked[1:][same]] = True
    return flags
