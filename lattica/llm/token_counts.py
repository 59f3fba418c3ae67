"""Token counts by prefix dynamic programming (operator 5).

For every code point prefix of a text the exact number of byte-level BPE tokens
is known: ``prefix_counts`` makes a table of them, and ``answers`` reads truncation or
budget questions off the stored rows, without encoding anything again.

The dynamic programme runs over the distinct pre-tokens of an Arrow slice.
``last[i]`` is the last token of the encoding of a pre-token's first i bytes; it
is the only vocabulary token t ending at i that may follow ``last[i - len(t)]``,
so ``count[i] = count[i - len(t)] + 1``.  Two tokens may follow each other iff no
merge would ever join a right-spine part of the first to a left-spine part of the
second before either is consumed by its own token (``may_follow``).

Defined results: null text counts as empty (0 tokens); null or repeated ids are
passed through, one output row for each input row; empty input gives no rows;
further columns of the input are ignored.  The special strings of the tokenizer
count as one token, as in the library's default.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import IS_SPACE, PRETOKEN, byte_alphabet, cut_pieces, encode_with
from .chunking import ChunkMemo
from .common import materialize, ragged_index, ship, text_slices

NEVER = np.int64(1) << 40
#: Pre-tokens of more bytes go by many start places at a time instead of by many pre-tokens.
LONG_PIECE, STARTS_AT_ONCE = 2048, 16_384


class PrefixCounter:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        back = {c: b for b, c in byte_alphabet().items()}
        special_ids = {t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in special_ids}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = max(vocab.values()) + 1
        self.size = size
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        rank = np.full(size, -1, np.int64)  # single bytes come before every merge
        keys = []
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if rank[t] < 0 and len(a + b) > 1:
                left[t], right[t], rank[t] = vocab[a], vocab[b], r
            keys.append(vocab[a] * size + vocab[b])
        self.pair_keys = np.array(keys, np.int64)
        order = np.argsort(self.pair_keys, kind="stable")
        self.pair_keys, self.pair_rank = self.pair_keys[order], order.astype(np.int64)
        self.right_spine = self._spine(right, rank)
        self.left_spine = self._spine(left, rank)
        self._build_trie({bytes(back[c] for c in t): i for t, i in vocab.items()})
        self.chunks = ChunkMemo(self._chunk_rows, limit=700_000)

    @staticmethod
    def _spine(child: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level: (part, rank at which it appears, rank at which its own token consumes it), -1 where none."""
        part, until = np.arange(len(child)), np.full(len(child), NEVER)
        levels = []
        while (part >= 0).any():
            since = np.where(part >= 0, rank[part], -1)
            levels.append((part, since, until))
            down = np.where(part >= 0, child[part], -1)
            until = np.where(down >= 0, since, -1)
            part = down
        return levels

    def _build_trie(self, tokens: dict[bytes, int]) -> None:
        node_of, ids = {b"": 0}, [-1]
        for t in sorted(tokens):
            for k in range(1, len(t) + 1):
                if t[:k] not in node_of:
                    node_of[t[:k]] = len(ids)
                    ids.append(-1)
            ids[node_of[t]] = tokens[t]
        self.node_token = np.array(ids, np.int64)
        edge = np.array([node_of[p[:-1]] * 256 + p[-1] for p in node_of if p], np.int64)
        to = np.array([n for p, n in node_of.items() if p], np.int64)
        order = np.argsort(edge)
        self.edge, self.edge_to = edge[order], to[order]

    def _step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = nodes * 256 + byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.edge_to[at], -1)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay apart when their bytes are encoded together."""
        keys, back = np.unique(a * self.size + b, return_inverse=True)
        a, b = keys // self.size, keys % self.size
        fine = np.ones(len(keys), bool)
        for x, x_since, x_until in self.right_spine:
            xa, xs, xu = x[a], x_since[a], x_until[a]
            if not (xa >= 0).any():
                break
            for y, y_since, y_until in self.left_spine:
                yb, ys, yu = y[b], y_since[b], y_until[b]
                live = np.flatnonzero(fine & (xa >= 0) & (yb >= 0) & (xs < yu) & (ys < xu))
                if not len(live):
                    if not (yb >= 0).any():
                        break
                    continue
                k = xa[live] * self.size + yb[live]
                at = np.minimum(np.searchsorted(self.pair_keys, k), len(self.pair_keys) - 1)
                r = np.where(self.pair_keys[at] == k, self.pair_rank[at], NEVER)
                # of equal pairs the leftmost merges first: a's own before this one, this one before b's own
                fine[live[(r < xu[live]) & (r <= yu[live]) & (r < NEVER)]] = False
        return fine[back]

    def piece_counts(self, pieces: list[bytes]) -> list[np.ndarray] | tuple[np.ndarray, np.ndarray]:
        """Counts after every byte: (lengths, counts one after the other)."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lens) - lens
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        out = np.zeros(len(flat), np.int32)
        for i in np.flatnonzero(lens > LONG_PIECE):
            self._long(flat[starts[i] : starts[i] + lens[i]], out[starts[i] : starts[i] + lens[i]])
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] <= LONG_PIECE]
        width = 8
        while len(order):
            top = int(lens[order[-1]])
            # one group holds pieces of up to twice the length of its shortest
            width = max(8, 2 * top)
            cut = np.searchsorted(-lens[order], -width)
            rows, order = order[cut:], order[:cut]
            self._group(flat, starts[rows], lens[rows], out)
        return lens, out

    def _long(self, piece: np.ndarray, out: np.ndarray) -> None:
        """Counts of one long pre-token: tokens from many start places at once, then the dynamic programme over what fits."""
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        held_end, held_token = np.zeros(0, np.int64), np.zeros(0, np.int64)  # tokens that end within the coming starts
        for base in range(0, n, STARTS_AT_ONCE):
            stop = min(base + STARTS_AT_ONCE, n)
            begin, found = np.arange(base, stop), []
            nodes, reach = np.zeros(len(begin), np.int64), 0
            while len(begin):
                inside = begin + reach < n
                begin, nodes = begin[inside], nodes[inside]
                nodes = self._step(nodes, piece[begin + reach])
                begin, nodes = begin[nodes >= 0], nodes[nodes >= 0]
                reach += 1
                token = self.node_token[nodes]
                found.append(np.stack([begin, begin + reach, token])[:, token >= 0])
            begin, end, token = np.concatenate(found, axis=1)
            order = np.argsort(begin, kind="stable")
            begin, end, token = begin[order], end[order], token[order]
            held_end, held_token = np.append(held_end, end), np.append(held_token, token)
            order = np.argsort(held_end, kind="stable")
            held_end, held_token = held_end[order], held_token[order]
            # all that may stand before a token, each pair of tokens once
            lo, hi = np.searchsorted(held_end, begin), np.searchsorted(held_end, begin, side="right")
            pairs = np.unique(held_token[ragged_index(lo, hi - lo)] * self.size + np.repeat(token, hi - lo))
            fits = set(pairs[self.may_follow(pairs // self.size, pairs % self.size)].tolist()) if len(pairs) else set()
            for s, e, t in zip(begin.tolist(), end.tolist(), token.tolist()):
                if not s or last[s] * self.size + t in fits:
                    last[e], count[e] = t, count[s] + 1
            held_end, held_token = held_end[held_end >= stop], held_token[held_end >= stop]
        out[:] = count[1:]

    def _group(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, out: np.ndarray) -> None:
        width, n = int(lens[0]), len(lens)
        count = np.zeros((width + 1, n), np.int32)
        last = np.full((width + 1, n), -1, np.int32)
        alive: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i in range(1, width + 1):
            rows = np.arange(np.searchsorted(-lens, -i, side="right"))
            byte = flat[starts[rows] + i - 1]
            alive.append((i - 1, rows, np.zeros(len(rows), np.int64)))
            kept = []
            for s, who, nodes in alive:
                if who[-1] >= len(rows):
                    short = np.searchsorted(who, len(rows))
                    who, nodes = who[:short], nodes[:short]
                    if not len(who):
                        continue
                nodes = self._step(nodes, byte[who])
                good = nodes >= 0
                if not good.all():
                    who, nodes = who[good], nodes[good]
                if not len(who):
                    continue
                kept.append((s, who, nodes))
                token = self.node_token[nodes]
                ends = token >= 0
                w, t = who[ends], token[ends]
                if s and len(w):
                    ok = self.may_follow(last[s, w].astype(np.int64), t)
                    w, t = w[ok], t[ok]
                last[i, w] = t
                count[i, w] = count[s, w] + 1
            alive = kept
            out[starts[rows] + i - 1] = count[i, rows]

    def _code_point_counts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points per piece, counts after every code point, count of each whole piece)."""
        raw = pieces.cast(pa.binary()).to_pylist()
        lens, counts = self.piece_counts(raw)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends_char = np.append((flat[1:] & 0xC0) != 0x80, True) if len(flat) else np.zeros(0, bool)
        points = np.add.reduceat(ends_char, np.cumsum(lens) - lens) if len(flat) else np.zeros(len(raw), np.int64)
        whole = counts[np.cumsum(lens) - 1] if len(flat) else np.zeros(len(raw), np.int32)
        return points.astype(np.int64), counts[ends_char], whole

    def _chunk_rows(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the memo: counts after every code point of a chunk, without what stands before it."""
        odd = pc.match_substring_regex(chunks, r"\s\s|'..|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]").to_numpy(zero_copy_only=False).astype(bool)
        for s in self.special:
            odd |= pc.match_substring(chunks, s).to_numpy(zero_copy_only=False)
        piece, per_chunk, distinct = cut_pieces(pc.if_else(pa.array(odd), "", chunks) if odd.any() else chunks)
        points, counts, whole = self._code_point_counts(distinct)
        first = np.cumsum(points) - points
        n = points[piece]
        values = counts[ragged_index(first[piece], n)]
        done = np.append(0, np.cumsum(whole[piece]))  # tokens of all pieces before
        cut = np.append(0, np.cumsum(per_chunk))
        before = done[:-1] - np.repeat(done[cut[:-1]], per_chunk)
        values = values + np.repeat(before, n)
        ends = np.append(0, np.cumsum(n))
        lengths = ends[cut[1:]] - ends[cut[:-1]]
        if odd.any():
            parts = np.split(values, np.cumsum(lengths)[:-1])
            at = np.flatnonzero(odd)
            for i, row in zip(at, self.text_counts(chunks.take(pa.array(at)).to_pylist())):
                parts[i] = row
                lengths[i] = len(row)
            values = np.concatenate(parts)
        return lengths, values

    def text_counts(self, texts: list[str]) -> list[np.ndarray]:
        """Counts after every code point of any texts, by the definition: white space runs, contractions, special strings."""
        cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        parts: list[tuple[int, str, bool]] = []  # (code points before a special string, they and most of it, whether it is one)
        counts_of_text: list[int] = []
        for text in texts:
            at, before = 0, len(parts)
            for m in cut.finditer(text):
                # inside the special string the text so far is ordinary text
                parts.append((m.start() - at, text[at : m.end() - 1], True))
                at = m.end()
            parts.append((len(text) - at, text[at:], False))
            counts_of_text.append(len(parts) - before)
        counted = iter(zip(parts, self._ordinary([p for _, p, _ in parts])))
        out = []
        for n in counts_of_text:
            row: list[int] = []
            base = 0
            for (size, _, special), counts in itertools.islice(counted, n):
                row += [base + c for c in counts]
                base += counts[size - 1] if size else 0
                if special:
                    base += 1
                    row.append(base)
            out.append(np.array(row, np.int32))
        return out

    def _ordinary(self, texts: list[str]) -> list[list[int]]:
        """Counts of texts without special strings, all of their distinct pieces at once."""
        shown: dict[str, int] = {}
        show = lambda p: shown.setdefault(p, len(shown))
        plans: dict[str, list[tuple[int, int, list[int]]]] = {}  # (piece shown, code points taken from it, pieces whose whole counts follow)
        for text in texts:
            if text in plans:
                continue
            plan = plans[text] = []
            pieces = PRETOKEN.findall(text)
            i = 0
            while i < len(pieces):
                p = pieces[i]
                if not IS_SPACE.fullmatch(p):
                    plan.append((show(p), len(p), []))
                    i += 1
                    continue
                j = i
                while j < len(pieces) and IS_SPACE.fullmatch(pieces[j]):
                    j += 1
                run = "".join(pieces[i:j])
                lead = j < len(pieces) and pieces[j][0] == " "
                plan.append((show(run + " " * lead), len(run) + lead, [show(x) for x in pieces[i:j]]))
                if lead:
                    plan.append((show(pieces[j]), -1, []))  # its first code point belongs to the run
                    j += 1
                i = j
        names = list(shown)
        points, counts, whole = self._code_point_counts(pa.array(names, pa.string()))
        first = np.cumsum(points) - points
        done = {}
        for text, plan in plans.items():
            out: list[int] = []
            base = 0
            for k, n, run in plan:
                row = counts[first[k] : first[k] + points[k]].tolist()
                if run:
                    out += [base + c for c in row[:n]]
                    base += int(whole[run].sum())
                    continue
                if names[k] in ("'re", "'ve", "'ll"):
                    row[1] = 2  # cut short, the apostrophe and the letter are two pre-tokens
                out += [base + c for c in (row[1:] if n < 0 else row)]
                base += int(whole[k])
            done[text] = out
        return [done[text] for text in texts]

    def prefix_counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code points per text, token counts after every code point, text after text)."""
        lengths, values = encode_with(self.chunks, texts, self.text_counts, self._carry)
        return lengths, values

    def _carry(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Memo rows of plain texts, each raised by the tokens of the text before it."""
        memo = self.chunks
        n = memo.lengths[rows]
        ends = memo.starts[rows] + n - 1
        last = np.where(n > 0, memo.values[np.maximum(ends, 0)] if len(memo.values) else 0, 0)
        done = np.append(0, np.cumsum(last))
        before = done[:-1] - np.repeat(done[offsets[:-1]], np.diff(offsets))
        return memo.gather(rows) + np.repeat(before, n).astype(np.int32)


@functools.lru_cache(maxsize=2)
def shared(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_key, n_bytes, n_chars, steps): ``steps`` holds by how much each code point of the text changes the token count.

    Steps are one byte each where a text's all fit, else four; their running sum is the count at every prefix.
    """
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(tokenizer)
        for b in text_slices(batches, "_text", 8_000_000):
            lengths, values = counter.prefix_counts(b.column("_text"))
            ends = np.cumsum(lengths)
            steps = np.diff(values.astype(np.int32), prepend=np.int32(0))
            heads = (ends - lengths)[lengths > 0]
            steps[heads] = values[heads]
            wide = np.zeros(len(lengths), bool)
            wide[np.searchsorted(ends, np.flatnonzero((steps < -128) | (steps > 127)), side="right")] = True
            narrow = steps.astype(np.int8).tobytes()
            bounds = np.append(0, ends).tolist()
            packed = [steps[x:y].astype("<i4").tobytes() if w else narrow[x:y] for x, y, w in zip(bounds, bounds[1:], wide.tolist())]
            size = pc.fill_null(pc.binary_length(b.column("_text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_key"), size, pa.array(lengths, pa.int64()), pa.array(packed, pa.binary())], ["_key", "n_bytes", "n_chars", "steps"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(rows, f"_key {kind}, n_bytes long, n_chars long, steps binary")


def counts_of(steps: bytes, n_chars: int) -> np.ndarray:
    """The token count at every prefix of a text, from its stored row."""
    return np.cumsum(np.frombuffer(steps, np.int8 if len(steps) == n_chars else "<i4"), dtype=np.int64)


def answers(stored: DataFrame, budget: int = 512, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, cut) from stored prefix counts; no text is read or encoded again.

    ``cut`` is the number of code points of the longest prefix within ``budget``.
    Where ``key`` is called like one of the other columns, it has an underscore in front.
    """
    ship(stored.sparkSession)
    names = ["n_bytes", "n_tokens", "over_limit", "cut"]
    name = f"_{key}" if key in names else key

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "steps", 8_000_000):
            lengths = b.column("n_chars").to_numpy()
            raw = b.column("steps").to_pylist()
            total, cut = np.zeros(len(raw), np.int64), lengths.copy()
            for i, (x, n) in enumerate(zip(raw, lengths.tolist())):
                total[i] = np.frombuffer(x, np.int8 if len(x) == n else "<i4").sum(dtype=np.int64)
                if total[i] > budget:
                    within = np.flatnonzero(counts_of(x, n) <= budget)
                    cut[i] = within[-1] + 1 if len(within) else 0
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("n_bytes"), pa.array(total), pa.array(total > budget), pa.array(cut)], [name, *names])

    kind = stored.schema["_key"].dataType.simpleString()
    return stored.mapInArrow(rows, f"{name} {kind}, n_bytes long, n_tokens long, over_limit boolean, cut long")


def token_counts(docs: DataFrame, tokenizer: str, budget: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``answers`` from prefix counts that are stored in the shared folder."""
    stored, _ = materialize(prefix_counts(docs, tokenizer, text, key), "prefix-counts")
    return answers(stored, budget, key)
