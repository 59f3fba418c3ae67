"""Space-led chunks of texts and a compact memo of what a tokenizer makes of them.

A text is cut in front of every single space that stands between two
characters that are no white space.  Neither byte-level BPE pre-tokens nor
merge-type SentencePiece symbols cross such a place, so a chunk is encoded once
and its result reused wherever the chunk stands.  Texts with other runs of
white space are told apart by ``plain_mask`` and take the caller's whole-text
path: no text is cut, capped or skipped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged_index

#: White space as the tokenizers' patterns know it (Unicode White_Space), for RE2.
SPACE_CLASS = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def plain_mask(texts: pa.Array) -> np.ndarray:
    """True where every space stands alone between two other characters."""
    odd = pc.match_substring_regex(texts, f"{SPACE_CLASS} | {SPACE_CLASS}|^ | $")
    return ~odd.to_numpy(zero_copy_only=False).astype(bool)


class ChunkMemo:
    """Distinct chunks with a row of int32 values each, held in flat arrays.

    ``encode`` turns an array of new chunks into
    (lengths, values).  When more than ``limit`` chunks are held the memo starts
    anew, which costs time but no result.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = 2_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.string())
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int32)

    def find(self, chunks: pa.Array) -> np.ndarray:
        """Row numbers in the memo of (distinct) chunks."""
        if len(self.keys) + len(chunks) > self.limit:
            self.clear()
        at = pc.index_in(chunks, value_set=self.keys) if len(self.keys) else pa.nulls(len(chunks), pa.int32())
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        rows = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if fresh.any():
            new = chunks.filter(pa.array(fresh))
            lengths, values = self.encode(new)
            rows[fresh] = len(self.keys) + np.arange(len(new))
            self.keys = pa.concat_arrays([self.keys, new])
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.values = np.concatenate([self.values, values.astype(np.int32)])
        return rows

    def gather(self, rows: np.ndarray) -> np.ndarray:
        return self.values[ragged_index(self.starts[rows], self.lengths[rows])]


def split_plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Chunks of plain texts: (index of each chunk among the distinct ones, offsets by text, distinct chunks)."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], coded.dictionary.cast(pa.string())
