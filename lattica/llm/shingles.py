"""Word shingle sets of Arrow text columns, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers by place in the shingle, from the digits of pi; the last mixes.
_PLACE = np.array([0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1, 0x082EFA98EC4E6C89, 0x452821E638D01377], np.uint64)
_MIX = np.uint64(0xBE5466CF34E90C6D)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _PLACE[0]
    return h ^ (h >> np.uint64(32))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: (code by word, words per text, distinct words)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # white space at an end makes an empty word
        keep = codes != empty
        codes, owner = codes[keep], owner[keep]
    return codes, np.bincount(owner, minlength=len(texts)), coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, hashes sorted within each set, set after set).

    A text of fewer than ``width`` words has its whole sequence as one shingle; one
    without words has the empty set.
    """
    codes, n, distinct = words_of(texts)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    left = n[owner] - (np.arange(len(codes)) - starts[owner])  # words from here to the end of the text
    rolled = np.zeros(len(codes), np.uint64)
    for k in range(width):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: max(len(codes) - k, 0)] = h[k:]
        rolled += np.where(left > k, shifted * _PLACE[k], np.uint64(0))
    full = np.minimum(n, width)[owner]
    keep = left >= full  # a short text has one place where all its words are left
    rolled, owner = mix(rolled + full.astype(np.uint64))[keep], owner[keep]
    order = np.lexsort((rolled, owner))
    rolled, owner = rolled[order], owner[order]
    if len(rolled):
        fresh = np.append(True, (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1]))
        rolled, owner = rolled[fresh], owner[fresh]
    return np.bincount(owner, minlength=len(n)), rolled


def set_digests(sizes: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """128-bit digest of each set."""
    ends = np.cumsum(sizes) * 8
    raw = memoryview(hashes.tobytes())
    return [hashlib.blake2b(raw[e - 8 * n : e], digest_size=16).digest() for n, e in zip(sizes.tolist(), ends.tolist())]
