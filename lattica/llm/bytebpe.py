"""Byte-level BPE over distinct pieces: pre-tokens by one pattern, merges by the tokenizers library.

Fixed values: the pre-token pattern and the byte alphabet are those of the
byte-level vocabularies (OpenAI's GPT-2 publication).
"""

from __future__ import annotations

import functools
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .chunking import ChunkMemo, plain_mask, split_plain

WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The published pre-token pattern, with white space written out.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
IS_SPACE = regex.compile(f"[{WS}]+")

def byte_alphabet() -> dict[int, str]:
    """Latin-1 code point to the printable stand-in that the vocabulary uses for this byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()


def to_alphabet(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_ALPHABET)


def cut_pieces(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pre-tokens of chunks: (piece index, pieces per chunk, distinct pieces).

    Chunks with a leading space are cut by one scan over all of them joined: such
    a space always starts a pre-token, and no other pre-token of theirs does.
    """
    led = pc.starts_with(chunks, " ").to_numpy(zero_copy_only=False)
    joined = chunks if led.all() else chunks.filter(pa.array(led))
    flat = PRETOKEN.findall("".join(joined.to_pylist()))
    all_pieces = pa.array(flat, pa.string())
    begins = np.flatnonzero(pc.starts_with(all_pieces, " ").to_numpy(zero_copy_only=False))
    per_chunk = np.zeros(len(chunks), np.int64)
    per_chunk[led] = np.diff(np.append(begins, len(flat)))
    if not led.all():
        ends = np.cumsum(per_chunk)
        mixed: list[str] = []
        at = 0
        for i in np.flatnonzero(~led):
            pieces = PRETOKEN.findall(chunks[int(i)].as_py())
            mixed += flat[at : ends[i]]
            mixed += pieces
            at = int(ends[i])
            per_chunk[i] = len(pieces)
        all_pieces = pa.array(mixed + flat[at:], pa.string())
    coded = all_pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), per_chunk, coded.dictionary


class ByteBPE:
    """Ids of whole texts, exactly as ``Tokenizer.encode(..., add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.pieces = ChunkMemo(self._encode_pieces, limit=1_500_000)
        self.chunks = ChunkMemo(self._encode_chunks, limit=2_000_000)

    def _encode_pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = new.to_pylist()
        shown = "\0".join(pieces).encode().decode("latin-1").translate(_ALPHABET).split(_ALPHABET[0])
        if len(shown) != len(pieces):  # a piece holds NUL itself
            shown = [to_alphabet(p) for p in pieces]
        rows = [[t.id for t in tokens] for tokens in map(self.model.tokenize, shown)]
        return np.fromiter(map(len, rows), np.int64, len(rows)), np.fromiter(chain.from_iterable(rows), np.int32)

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.zeros(len(chunks), bool)
        for s in self.special:
            odd |= pc.match_substring(chunks, s).to_numpy(zero_copy_only=False)
        piece, per_chunk, distinct = cut_pieces(pc.if_else(pa.array(odd), "", chunks) if odd.any() else chunks)
        rows = self.pieces.find(distinct)[piece]
        ends = np.append(0, np.cumsum(self.pieces.lengths[rows]))
        cut = np.append(0, np.cumsum(per_chunk))
        lengths = ends[cut[1:]] - ends[cut[:-1]]
        values = self.pieces.gather(rows)
        if odd.any():
            own = self.library.encode_batch_fast(chunks.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
            parts = np.split(values, np.cumsum(lengths)[:-1])
            for i, e in zip(np.flatnonzero(odd), own):
                parts[i], lengths[i] = np.array(e.ids, np.int32), len(e.ids)
            values = np.concatenate(parts)
        return lengths, values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens per text, ids of all texts one after the other); null counts as empty."""
        return encode_with(self.chunks, texts, lambda odd: [e.ids for e in self.library.encode_batch_fast(odd, add_special_tokens=False)])


def encode_with(memo: ChunkMemo, texts: pa.Array, whole, join=None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the memo for plain texts and of ``whole`` for the others, in the order of the texts.

    ``join`` (memo rows, chunk offsets by text) puts the rows of a text together; by default they follow each other.
    """
    texts = pc.fill_null(texts, "")
    plain = plain_mask(texts)
    idx, offsets, distinct = split_plain(texts.filter(pa.array(plain)))
    first = offsets[:-1]
    led = pc.binary_join_element_wise(" ", distinct, "")
    if len(first):
        heads = pc.take(distinct, pa.array(idx[first])).dictionary_encode()
        idx[first] = len(distinct) + heads.indices.to_numpy(zero_copy_only=False)
        led = pa.concat_arrays([led, heads.dictionary.cast(pa.string())])
    rows = memo.find(led)[idx]
    ends = np.append(0, np.cumsum(memo.lengths[rows]))
    lengths = np.zeros(len(texts), np.int64)
    lengths[plain] = ends[offsets[1:]] - ends[offsets[:-1]]
    values = join(rows, offsets) if join else memo.gather(rows)
    if not plain.all():
        odd = np.flatnonzero(~plain)
        own = [np.asarray(x, np.int32) for x in whole(texts.take(pa.array(odd)).to_pylist())]
        parts = np.split(values, np.cumsum(lengths[plain])[:-1]) if plain.any() else []
        merged: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i, x in zip(np.flatnonzero(plain), parts):
            merged[i] = x
        for i, x in zip(odd, own):
            merged[i], lengths[i] = x, len(x)
        values = np.concatenate(merged) if merged else values
    return lengths, values


@functools.lru_cache(maxsize=2)
def shared(path: str) -> ByteBPE:
    """One encoder, and one memo, for each Python worker."""
    return ByteBPE(path)
