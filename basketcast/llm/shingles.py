"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 16  # bytes hashed together; longer words are hashed on their own
_TOGETHER = 1 << 14  # bytes of short texts hashed together


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between runs of space, tab, line feed, vertical tab, form feed, return."""
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9FB21C651E98DF25
_POWERS, _INVERSES = _powers(_BASE, _PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACES = re.compile(rb"[\x09-\x0d\x20]")


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of ``words(text)``, in their order, for all words of a piece of text at once."""
    return words_by_piece(text, _hashes)


def hashes_and_endings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` of the texts one after another, the words' last two bytes as a number (256 times the last but one,
    plus the last), and the number of words of each text; the place of the last but one is empty (a space) in words of
    one byte. Short texts are hashed together."""
    raws = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    found, counts, lo = [np.empty((2, 0), dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64), 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) < _TOGETHER):
            size += len(raws[hi]) + 1
            hi += 1
        if hi == lo + 1:
            found.append(words_by_piece(texts[lo], lambda raw: _hashes(raw, endings=True)))
            counts[lo] = found[-1].shape[1]
        else:
            both, first = _hashes_at(b" ".join(raws[lo:hi]), True)
            found.append(both)
            begin = np.cumsum([0, *(len(raw) + 1 for raw in raws[lo:hi])])
            counts[lo:hi] = np.diff(np.searchsorted(first, begin))
        lo = hi
    both = np.concatenate(found, axis=1)
    return both[0], both[1].view(np.int64), counts


def words_by_piece(text: str, of) -> np.ndarray:
    """``of`` (an array with a last axis of words) over pieces of the lower-cased text that cut no word."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) < _PIECE:
        return of(raw)
    out, at = [], 0
    while at < len(raw):
        stop = at + _PIECE
        if stop < len(raw):  # cut behind a white space
            spaces = np.flatnonzero(_SPACE[np.frombuffer(raw, dtype=np.uint8, count=_PIECE, offset=at)])
            if not len(spaces):  # a word of its own
                end = _SPACES.search(raw, stop)
                stop = end.start() if end else len(raw)
            else:
                stop = at + int(spaces[-1]) + 1
        out.append(of(raw[at:stop]))
        at = stop
    return np.concatenate(out, axis=-1)


def _hashes(raw: bytes, endings: bool = False) -> np.ndarray:
    """Hashes of the words; with ``endings`` a second row has their last two bytes."""
    if len(raw) >= _PIECE and len(found := raw.split()) == 1 and len(found[0]) >= _PIECE:
        own = np.array([xxhash.xxh64_intdigest(found[0])], dtype=np.uint64)
        return np.stack([own, np.array([256 * found[0][-2] + found[0][-1]], dtype=np.uint64)]) if endings else own
    return _hashes_at(raw, endings)[0]


def _hashes_at(raw: bytes, endings: bool) -> tuple[np.ndarray, np.ndarray]:
    """``_hashes`` of at most ``_PIECE`` bytes, and where the words begin."""
    data = np.frombuffer(raw, dtype=np.uint8)
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = edges[::2], edges[1::2]
    # sums of byte * base^place up to each place; a word's is the difference, brought back to place 0
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(data)], out=sums[1:])
    own = mix((sums[last] - sums[first]) * _INVERSES[first])
    if not endings:
        return own, first
    before = np.where(last - first > 1, data[last - 2], 32).astype(np.uint64)
    return np.stack([own, before * np.uint64(256) + data[last - 1]]), first


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words than a shingle is one whole
    shingle, a text without words has none."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    span = min(SHINGLE_WORDS, len(h))
    last = len(h) - span + 1
    acc = h[:last] + np.uint64(span)
    for k in range(1, span):  # a polynomial in an odd base, then mixed: order and place count
        acc *= _MULTIPLIER
        acc += h[k:k + last]
    return distinct(mix(acc))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    fresh = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]
