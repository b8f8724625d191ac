"""Words, word hashes and shingle sets of whole texts, for a batch of texts at once with numpy."""

import hashlib

import numpy as np

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Odd multipliers.
_BASE, _MIX1, _MIX2, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """h with each bit spread over all 64."""
    h = (h ^ (h >> _U(30))) * _MIX1
    h = (h ^ (h >> _U(27))) * _MIX2
    return h ^ (h >> _U(31))


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run of anything but blanks) of all texts, and the number of words of each text."""
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    word = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum([len(d) + 1 for d in data])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, _U), counts
    chars = (_LOWER[raw[word]] if lower else raw[word]).astype(_U) + _U(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    return mixed(np.add.reduceat(chars * powers[place], first) + lengths.astype(_U) * _LENGTH), counts


def shingle_sets(texts: list[str], size: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's size-word shingles; of a shorter text, its whole sequence as one."""
    words, counts = word_hashes(texts, lower)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, _U)
    factor = _BASE
    with np.errstate(over="ignore"):
        for k in range(size):
            rolled += words[k : k + n] * factor
            factor = factor * _MIX1 | _U(1)
        rolled = mixed(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            s = np.sort(rolled[at : at + count - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif count:
            whole = hashlib.blake2b(words[at : at + count].tobytes(), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(whole, np.uint64).copy())
        else:
            out.append(np.zeros(0, _U))
        at += count
    return out
