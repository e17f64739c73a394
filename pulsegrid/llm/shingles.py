"""Hashed word shingles of many texts at a time, as numpy arrays."""

import numpy as np

WIDTH = 5
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_RADIX_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                    0x589965CC75374CC3], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, and where each text's begin.

    Words are split at ASCII white space. The second array has one end more than texts.
    """
    raw = [v.encode("utf-8", "surrogatepass").lower() for v in values]
    chars = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    power = np.ones(len(chars), np.uint64)
    power[1:] = _RADIX
    np.multiply.accumulate(power, out=power)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    # Dividing by the radix to the power of the start makes a hash the same wherever the word is.
    shift = np.ones(len(chars), np.uint64)
    shift[1:] = _RADIX_INVERSE
    np.multiply.accumulate(shift, out=shift)
    words = mixed((total[ends] - total[starts]) * shift[starts] + (ends - starts).astype(np.uint64))
    at = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return words, np.searchsorted(starts, at)


def shingle_sets(values: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of WIDTH words.

    A text with fewer words has one shingle, all of its words; one without words has none.
    """
    words, at = word_hashes(values)
    last = len(words) - WIDTH + 1
    rolled = np.zeros(max(last, 0), np.uint64)
    for k in range(WIDTH):
        rolled += words[k:k + len(rolled)] * _PLACES[k]
    rolled = mixed(rolled)
    out = []
    for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
        if end - first >= WIDTH:
            out.append(np.unique(rolled[first:end - WIDTH + 1]))
        elif end > first:
            own = (words[first:end] * _PLACES[:end - first]).sum(dtype=np.uint64) + np.uint64(end - first)
            out.append(mixed(np.array([own], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
