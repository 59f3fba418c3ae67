"""SentencePiece encoding and decoding for merge-type vocabularies (operator 9).

The encoder keeps an agenda of adjacent symbol pairs ordered by score, then by
position, and merges the best until none is left; every segment, short or long,
has a heap of its own.  No piece holds the space mark after another
character, so a segment (space marks and what follows them) is encoded once and
reused.  Every new segment is checked against the sentencepiece library before
its result is used.  One that differs is encoded once more and counted in ``n_taken``
(0 on all data seen so far); if it still differs the run fails, as the library's ids take no one's place.

Defined results: null text counts as empty and has the end id alone; null or
repeated keys are passed through, one row for each input row; empty input gives
no rows; clashing columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunking import ChunkMemo, split_plain
from .common import ship, text_slices

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bits of an offer that are its piece; those above are the place of its score.
_PIECE = (1 << 20) - 1


class Agenda:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = lib.eos_id()
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a space mark after another character")
        #: Symbols: vocabulary ids, then single characters that no piece is equal to.
        self.symbol = {self.pieces[i]: i for i in plain}
        self.score = {i: lib.get_score(i) for i in plain}
        chars = {c for i in plain for c in self.pieces[i]}
        self.text_of = dict(enumerate(self.pieces))
        for c in sorted(chars):
            self._char(c)
        # place of the score (equal scores share one) and piece, by pair of symbols
        place = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True), 1)}
        self.offer: dict[int, int] = {}
        for i in plain:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    self.offer[a << 32 | b] = place[self.score[i]] << 20 | i
        self.memo = ChunkMemo(self._rows, limit=900_000)
        self.shown: list[bytes] = []
        self.decoded: list[str] = []

    def _char(self, c: str) -> int:
        s = self.symbol.get(c)
        if s is None:
            s = self.symbol[c] = max(len(self.pieces), len(self.text_of))
            self.text_of[s] = c
        return s

    def _out(self, symbol: int) -> tuple[int, ...]:
        """Ids of a symbol: itself, or the bytes of a character that the vocabulary lacks."""
        if symbol < len(self.pieces):
            return (symbol,)
        return tuple(self.byte_id[b] for b in self.text_of[symbol].encode())

    def encode_segment(self, segment: str) -> list[int]:
        """One segment by its agenda, a heap of (place of the score, position) of adjacent pairs that make a piece."""
        symbol, offer, top = self.symbol, self.offer.get, len(self.pieces)
        try:
            sym = [symbol[c] for c in segment]
        except KeyError:
            sym = [self._char(c) for c in segment]
        n = len(sym)
        due = [offer(a << 32 | b, 0) for a, b in zip(sym, sym[1:])]  # the offer that stands at each position
        due.append(0)
        agenda = [(x >> 20) * n + i for i, x in enumerate(due) if x]
        heapq.heapify(agenda)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            place, i = divmod(pop(agenda), n)
            x = due[i]
            if x >> 20 != place:
                continue  # a side of it has gone into another piece
            j = nxt[i]
            sym[i] = piece = x & _PIECE
            sym[j], due[i], due[j] = -1, 0, 0
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if x := offer(piece << 32 | sym[k]):
                    due[i] = x
                    push(agenda, (x >> 20) * n + i)
            h = prv[i]
            if h >= 0:
                due[h] = x = offer(sym[h] << 32 | piece, 0)
                if x:
                    push(agenda, (x >> 20) * n + h)
        if n and max(sym) >= top:
            return [x for s in sym if s >= 0 for x in self._out(s)]
        return [s for s in sym if s >= 0]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        return list(map(self.encode_segment, segments))

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids with its space marks still standing for spaces at the front."""
        return b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")

    def _rows(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Memo rows: number of ids alone; the shown ids and the decoded text stand beside."""
        segments = chunks.to_pylist()
        if not len(self.memo.keys):
            self.shown, self.decoded, self.differs = [], [], []
        rows = self.encode_segments(segments)
        # an exact check; the library puts a mark of its own in front of a text, so it gets the segment without its first one
        expected = self.library.encode([s[1:] for s in segments], num_threads=1)
        expected = [e if s != MARK else [self.library.piece_to_id(MARK)] for s, e in zip(segments, expected)]  # no mark for an empty text
        differs = [a != b for a, b in zip(rows, expected)]
        for i in [i for i, x in enumerate(differs) if x]:  # once more by itself, as the library's ids never stand in
            rows[i] = self.encode_segment(segments[i])
            if rows[i] != expected[i]:
                raise ValueError(f"agenda and library differ on a segment of {len(segments[i])} characters that begins with {segments[i][:80]!r}")
        self.differs += differs
        self.shown += [b" ".join(map(b"%d".__mod__, r)) for r in rows]
        joined = self._decode_rows(rows)
        self.decoded += joined
        return np.ones(len(rows), np.int64), np.fromiter(map(len, rows), np.int32, len(rows))

    def _decode_rows(self, rows: list[list[int]]) -> list[str]:
        text, is_byte = self._plain_text, self._byte_set
        return ["".join(map(text.__getitem__, r)) if is_byte.isdisjoint(r) else self.decode_ids(r) for r in rows]

    @functools.cached_property
    def _raw(self) -> list[bytes]:
        """Bytes by id; none for control ids."""
        value = {i: b for b, i in self.byte_id.items()}
        return [bytes([value[i]]) if i in value else b"" if self.library.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]

    @functools.cached_property
    def _plain_text(self) -> list[str]:
        lib = self.library
        return ["" if lib.is_control(i) else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]

    @functools.cached_property
    def _byte_set(self) -> frozenset[int]:
        return frozenset(self.byte_id.values())

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str], list[int]]:
        """Per text: number of ids with the end id, digest of the ids, digest of the decoded text, segments that were encoded once more."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, f"  |^ |{MARK}").to_numpy(zero_copy_only=False).astype(bool)
        plain = texts.filter(pa.array(~odd))
        idx, offsets, distinct = split_plain(plain)
        keys = pc.binary_join_element_wise(MARK, distinct, "")
        extra = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) for t in texts.filter(pa.array(odd)).to_pylist()]
        if extra:
            more = pa.array([s for segs in extra for s in segs], pa.string()).dictionary_encode()
            both = pa.concat_arrays([keys, more.dictionary.cast(pa.string())]).dictionary_encode()
            place = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            idx = np.concatenate([place[: len(keys)][idx], place[len(keys) :][more.indices.to_numpy(zero_copy_only=False)]])
            sizes = np.cumsum([len(s) for s in extra])
            offsets = np.append(offsets, offsets[-1] + sizes)
            keys = both.dictionary.cast(pa.string())
        rows = self.memo.find(keys)
        counts = self.memo.values[self.memo.starts[rows]].astype(np.int64)[idx]
        done = np.append(0, np.cumsum(counts))
        shown = np.array(self.shown, object)[rows] if len(rows) else np.zeros(0, object)
        decoded = np.array(self.decoded, object)[rows] if len(rows) else np.zeros(0, object)
        end = b"%d" % self.end_id
        differs = np.array(self.differs, bool)[rows] if len(rows) else np.zeros(0, bool)
        n, ids, text, taken = [0] * len(texts), [""] * len(texts), [""] * len(texts), [0] * len(texts)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for at, i in enumerate([*np.flatnonzero(~odd), *np.flatnonzero(odd)]):
            a, b = offsets[at], offsets[at + 1]
            if empty[i]:
                n[i], ids[i], text[i] = 1, hashlib.sha256(end).hexdigest(), hashlib.sha256(b"").hexdigest()
                continue
            own = idx[a:b]
            n[i] = int(done[b] - done[a]) + 1
            taken[i] = int(differs[own].sum())
            ids[i] = hashlib.sha256(b" ".join([*shown[own], end])).hexdigest()
            text[i] = hashlib.sha256("".join(decoded[own])[1:].encode()).hexdigest()
        return n, ids, text, taken

    def encode_text(self, text: str | None) -> list[int]:
        segments = _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []
        return [i for row in self.encode_segments(segments) for i in row] + [self.end_id]

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids)[1:]


@functools.lru_cache(maxsize=2)
def shared(path: str) -> Agenda:
    return Agenda(path)


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): ids with the end id."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(model)
        for b in text_slices(batches, text, 2_000_000):
            ids = [coder.encode_text(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(rows, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows that ``encode`` made; null ids give null."""
    ship(coded.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(model)
        for b in batches:
            texts = [None if x is None else coder.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], [key, "text"])

    return coded.select(key, "ids").mapInArrow(rows, f"{key} {coded.schema[key].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_taken) of every whole text; ``n_taken`` segments did not pass the check at first and were encoded once more.

    Where ``key`` is called like one of the other columns, it has an underscore in front.
    """
    ship(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_taken"]
    name = f"_{key}" if key in names else key

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(model)
        for b in text_slices(batches, text, 8_000_000):
            n, ids, decoded, taken = coder.digests(b.column(text))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(taken, pa.int64())], [name, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(rows, f"{name} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_taken long")
