"""Hashed n-gram indicators of documents, for the linear classifiers."""

from __future__ import annotations

import numpy as np

from .arrays import SPACE, Words, mix64, words

BITS = 18
BUCKETS = 1 << BITS
_U = np.uint64

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = True
_SEPARATOR = _PUNCT | SPACE
#: The same bytes with every ASCII mark made a blank, for words without their marks.
BARE = np.where(_SEPARATOR, 32, np.arange(256)).astype(np.uint8)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - BITS)).astype(np.int64)


def _shape(w: Words) -> np.ndarray:
    """Class of each word by its edges: last two marks, first mark, capitals only, no letter."""
    data = w.data
    last, first = data[w.start + w.length - 1], data[w.start]
    but_one = data[np.maximum(w.start + w.length - 2, w.start)]
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)) | (data >= 128))])
    end = w.start + w.length
    n_cap, n_small = capital[end] - capital[w.start], small[end] - small[w.start]
    key = np.where(_PUNCT[last], last, 0).astype(_U) << _U(24)
    key |= np.where(_PUNCT[last] & _PUNCT[but_one], but_one, 0).astype(_U) << _U(16)
    key |= np.where(_PUNCT[first], first, 0).astype(_U) << _U(8)
    key |= ((n_cap > 1) & (n_small == 0)).astype(_U) << _U(1)
    key |= ((n_cap == 0) & (n_small == 0)).astype(_U)
    return mix64(key + _U(0xABCD00000000))


def indicators(data: np.ndarray, offsets: np.ndarray, *, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(document row, bucket)`` pairs.

    Word unigrams, word bigrams in which a word equal to the one before is the token
    "same", the trigram "same same", and unigrams and bigrams of word shapes.
    ``bare``: unigrams of words without marks only.
    """
    w = words(BARE[data] if bare else data, offsets)
    if len(w.hashes) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    feats, doc = [_bucket(w.hashes)], [w.doc]
    if not bare:
        pair = w.doc[1:] == w.doc[:-1]
        same = w.hashes[1:] == w.hashes[:-1]
        with np.errstate(over="ignore"):
            two = mix64(w.hashes[:-1] * _U(0x9E3779B97F4A7C15) + w.hashes[1:])
        two[same] = mix64(np.array([101], dtype=_U))[0]
        feats.append(_bucket(two[pair]))
        doc.append(w.doc[1:][pair])
        thrice = pair[1:] & pair[:-1] & same[1:] & same[:-1]
        feats.append(np.repeat(_bucket(mix64(np.array([102], dtype=_U))), int(thrice.sum())))
        doc.append(w.doc[2:][thrice])
        shape = _shape(w)
        feats.append(_bucket(shape))
        doc.append(w.doc)
        with np.errstate(over="ignore"):
            feats.append(_bucket(mix64(shape[:-1] * _U(0xC2B2AE3D27D4EB4F) + shape[1:]))[pair])
        doc.append(w.doc[1:][pair])
    key = np.sort((np.concatenate(doc) << BITS) | np.concatenate(feats))
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return key >> BITS, key & (BUCKETS - 1)
