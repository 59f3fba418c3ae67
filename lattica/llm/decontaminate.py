"""Benchmark decontamination (operator 2): BM25 inverted index of test items, block-max WAND.

The index holds the test items; training passages are the queries.  A passage is
a window of words, long enough that every item lies whole in some window.  An
item's score is taken as a share of the score it gives itself, so one threshold
holds for all.  For each passage

1.  the greatest weights of its terms within groups of neighbouring items are added up;
    a passage that stays below the threshold in every group has no item;
2.  cursors stand on the posting lists of its terms, in order of their items;
3.  the pivot is the first cursor at which the lists' greatest weights add up to
    the threshold: no item in front of it can reach it;
4.  the greatest weights of the blocks that hold the pivot's item bound it again;
    if they stay below the threshold, the cursors jump past the nearest block end;
5.  else the item is scored exactly; all at or above the threshold are retrieved.

A retrieved pair counts as a leak if both the item's question and its answer
overlap with the passage in word trigrams.

Items are indexed in shards of about ``SHARD_ITEMS`` items and ``SHARD_WORDS`` words, one
pass over the documents for each shard, so what is broadcast is bounded whatever
the benchmark's size.  Document frequencies, mean length and the passages' length
are those of all items, so results do not depend on the shards.  Documents are
never shuffled.

Defined results: null or empty texts and items are never leaks; items of fewer
words than a trigram are matched by their whole text; rows with equal or null ids
are judged by themselves; items with equal ids are items of their own; empty tables give no rows (``remove_leaks`` with an empty
benchmark keeps all); clashing columns are handed on untouched.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ragged_index, ship, text_slices

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
BLOCK = 16
GRAM = 3
LEAST_STRIDE = 64
SHARD_ITEMS, SHARD_WORDS = 20_000, 2_000_000
WORDS_AT_ONCE = 400_000
#: Sums of weights are compared with this much room for rounding.
SLACK = 1e-9
#: Groups of items for the first bound: their least width, most of them in a shard, room for single precision.
GROUP_ITEMS, MOST_GROUPS, ROUNDED = 8, 64, 1e-4
#: Punctuation that is trimmed from words.
TRIM = ".,;:!?¡¿…\"'«»“”„()[]{}<>*#|&%$-–—_/\\"


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words without punctuation at their ends: (code by word, words per text, distinct words)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), TRIM).dictionary_encode()
    codes = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    empty = pc.index(bare.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        codes, owner = codes[keep], owner[keep]
    return codes, np.bincount(owner, minlength=len(texts)), bare.dictionary


def question_and_answer(words: list[int]) -> tuple[list[int], list[int]]:
    """The first two thirds of an item's words ask, the rest answers."""
    cut = max(1, (2 * len(words) + 2) // 3)
    return words[:cut], words[cut:]


def grams(words: list[int], n: int = GRAM) -> set[tuple[int, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@dataclass
class Index:
    """Posting lists of one shard of items, each list cut into blocks with the greatest weight of each.

    A weight is a term's BM25 score in an item as a share of the score the item gives itself.
    Postings are sorted by (term, item), so one sorted array of ``term * items + item`` finds any place in any list.
    """

    items: pa.Array
    vocabulary: pa.Array
    begin: np.ndarray  # of each term's postings
    places: np.ndarray  # postings as term * items + item
    weights: np.ndarray
    term_max: np.ndarray
    block_last: np.ndarray  # last posting of each block, as in ``places``
    block_max: np.ndarray
    block_of: np.ndarray  # each posting's block
    group_max: np.ndarray  # terms x groups of neighbouring items: greatest weight
    word: np.ndarray  # all items' words, one after the other
    word_begin: np.ndarray
    stride: int

    @staticmethod
    def build(items: pa.Array, words: pa.ListArray, df: dict[str, np.ndarray | pa.Array], total: int, mean: float, longest: int) -> "Index":
        """``df`` has the terms and in how many of all ``total`` items each stands; ``mean`` and ``longest`` are of all items as well."""
        offsets = words.offsets.to_numpy().astype(np.int64)
        begin, n = offsets - offsets[0], np.diff(offsets)
        coded = words.flatten().dictionary_encode()
        vocabulary = coded.dictionary.cast(pa.string())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        many = max(len(n), 1)
        places, tf = np.unique(code * many + owner, return_counts=True)
        term, item = places // many, places % many
        often = np.asarray(df["df"], np.float64)[pc.index_in(vocabulary, value_set=df["term"]).to_numpy(zero_copy_only=False).astype(np.int64)] if len(vocabulary) else np.zeros(0)
        idf = np.log(1 + (total - often + 0.5) / (often + 0.5))
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / mean)) if len(term) else np.zeros(0)
        weights = score / np.maximum(np.bincount(item, weights=score, minlength=many), 1e-12)[item]
        starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        rank = np.arange(len(term)) - starts[term]
        heads = np.flatnonzero(rank % BLOCK == 0)
        lasts = np.append(heads[1:], len(term))[: len(heads)] - 1
        greatest = lambda at: np.maximum.reduceat(weights, at) if len(at) else np.zeros(0)
        width = max(GROUP_ITEMS, -(-many // MOST_GROUPS))
        group_max = np.zeros((len(vocabulary), -(-many // width)), np.float32)
        np.maximum.at(group_max, (term, item // width), weights.astype(np.float32))
        return Index(items, vocabulary, starts, places, weights, greatest(starts[:-1]), places[lasts], greatest(heads), np.repeat(np.arange(len(heads)), lasts - heads + 1), group_max, code.astype(np.int32), begin, max(LEAST_STRIDE, longest))

    def search(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs at or above the threshold; terms are distinct within a passage.

        Block-max WAND with a fixed threshold.  All passages take their steps together: a
        passage's cursors stand in order of their items; its pivot is the first cursor
        at which the lists' greatest weights add up to the threshold; if the weights of
        the blocks at the pivot's item do as well, the item is scored, else all cursors
        in front jump past the nearest end of these blocks.
        """
        many, least = max(len(self.items), 1), THRESHOLD - SLACK
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = np.repeat(np.arange(len(sizes)), sizes)
        some = np.flatnonzero(sizes)
        alive = np.zeros(len(sizes), bool)
        if len(some):  # block maxima over the same items for all terms: most passages reach the threshold in no group
            alive[some] = np.add.reduceat(self.group_max[terms], (np.cumsum(sizes) - sizes)[some], axis=0).max(axis=1) >= least - ROUNDED
        own, term = own[alive[own]], terms[alive[own]]
        at = self.begin[term]
        item = self.places[at] - term * many
        while len(own):
            order = np.argsort(own * (many + 1) + item, kind="stable")  # nearly in order from the step before
            own, term, at, item = own[order], term[order], at[order], item[order]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            size = np.diff(np.append(heads, len(own)))
            who = np.repeat(np.arange(len(heads)), size)
            upto = np.cumsum(self.term_max[term])
            upto -= (upto[heads] - self.term_max[term[heads]])[who]
            pivot = np.minimum.reduceat(np.where(upto >= least, np.arange(len(own)), len(own)), heads)
            live = pivot < len(own)
            if not live.any():
                break
            target = np.where(live, item[np.minimum(pivot, len(own) - 1)], -1)
            aim = target[who]
            front = np.flatnonzero(item <= aim)
            base, goal = term[front] * many, aim[front]
            block = self.block_of[at[front]]
            last = self.block_last[block] - base
            behind = np.flatnonzero(last < goal)  # the item lies beyond the block in which the cursor stands
            block[behind] = np.searchsorted(self.block_last, base[behind] + goal[behind])
            ended = np.zeros(len(front), bool)
            ended[behind] = block[behind] == len(self.block_last)
            block[ended] = 0
            last[behind] = self.block_last[block[behind]] - base[behind]  # of another term's list if this one ends before the item
            ended |= last >= many
            bound = np.bincount(who[front], weights=np.where(ended, 0.0, self.block_max[block]), minlength=len(heads))
            scored = live & (bound >= least)
            # the next item that can matter where the blocks' bound is too low
            beyond = item.copy()
            beyond[front] = np.where(ended, many, last + 1)
            aim = np.where(scored, target, np.minimum.reduceat(beyond, heads))[who]
            moved = front[item[front] < aim[front]]
            at[moved] = np.searchsorted(self.places, term[moved] * many + aim[moved])
            item[moved] = self._items_at(at[moved], term[moved], many)
            hit = front[(item[front] == aim[front]) & scored[who[front]]]
            score = np.bincount(who[hit], weights=self.weights[at[hit]], minlength=len(heads))
            good = np.flatnonzero(scored & (score >= least))
            found.append((own[heads[good]], target[good], score[good]))
            at[hit] += 1
            item[hit] = self._items_at(at[hit], term[hit], many)
            keep = (item < many) & live[who]
            own, term, at, item = own[keep], term[keep], at[keep], item[keep]
        return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, t)]) for k, t in enumerate((np.int64, np.int64, np.float64)))

    def _items_at(self, at: np.ndarray, term: np.ndarray, many: int) -> np.ndarray:
        """Items of cursors; ``many`` for those past the end of their list."""
        done = at >= self.begin[term + 1]
        return np.where(done, many, self.places[np.minimum(at, len(self.places) - 1)] - term * many)

    def leaks(self, texts: pa.Array) -> list[dict[int, float]]:
        """For each text: item and its best score, for the items it leaks."""
        out: list[dict[int, float]] = [{} for _ in range(len(texts))]
        codes, n, words = normal_words(texts)
        if not len(codes) or not len(self.items):
            return out
        term = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        starts = np.cumsum(n) - n
        # windows of two strides, one stride apart
        count = np.maximum(1, -(-n // self.stride) - 1) * (n > 0)
        owner = np.repeat(np.arange(len(n)), count)
        at = starts[owner] + self.stride * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(at + 2 * self.stride, starts[owner] + n[owner])
        step = max(1, WORDS_AT_ONCE // (2 * self.stride))
        for lo in range(0, len(owner), step):
            a, e = at[lo : lo + step], end[lo : lo + step]
            window = np.repeat(np.arange(len(a)), e - a)
            t = term[ragged_index(a, e - a)]
            pair = np.unique(window[t >= 0] * len(self.vocabulary) + t[t >= 0])  # distinct terms of each passage
            sizes = np.bincount(pair // len(self.vocabulary), minlength=len(a))
            here: tuple[int, set] | None = None
            for w, item, score in sorted(zip(*(x.tolist() for x in self.search(pair % len(self.vocabulary), sizes)))):
                if here is None or here[0] != w:
                    here = (w, grams(term[a[w] : e[w]].tolist()))
                if self._overlaps(here[1], item):
                    own = out[owner[lo + w]]
                    own[item] = max(own.get(item, 0.0), score)
        return out

    def _overlaps(self, here: set, item: int) -> bool:
        for part in map(grams, question_and_answer(self.word[self.word_begin[item] : self.word_begin[item + 1]].tolist())):
            whole = {g for g in part if len(g) == GRAM}
            if whole and len(whole & here) < OVERLAP * len(whole):
                return False
            if part and not whole:  # too short for a trigram: its words in a row
                n = len(next(iter(part)))
                if not any(g in part for h in here for g in (h[i : i + n] for i in range(len(h) - n + 1))):
                    return False
        return True


_held: tuple[str, Index] | None = None


def _index(name: str, broadcast) -> Index:
    """The worker's copy of a broadcast index; one is held at a time, known by its own name."""
    global _held
    if _held is None or _held[0] != name:
        _held = (name, pickle.loads(broadcast.value))
    return _held[1]


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words): normal words of every item that has any."""
    kind = items.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "_text"):
            codes, n, words = normal_words(b.column("_text"))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), words.cast(pa.string()).take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays([b.column("_item"), lists], ["item", "words"]).filter(pa.array(n > 0))

    return items.select(F.col(key).alias("_item"), F.col(text).alias("_text")).mapInArrow(rows, f"item {kind}, words array<string>")


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", shard_items: int = SHARD_ITEMS, shard_words: int = SHARD_WORDS) -> Iterator[Index]:
    """Indexes over shards of the items, of a bounded size; how they are dealt has no bearing on weights or windows."""
    spark = items.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        table = scratch.table(item_words(items, key, text), "items")
        n = F.size("words")
        total, words, longest = table.agg(F.count(F.lit(1)), F.sum(n), F.max(n)).first()
        if not total:
            return
        shards = max(-(-total // shard_items), -(-words // shard_words))
        df = scratch.table(table.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
        for k in range(shards):
            own = table.where(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == k)
            held = own.toArrow().combine_chunks()
            if held.num_rows:
                terms = df.join(own.select(F.explode("words").alias("term")).distinct(), "term", "left_semi").toArrow().combine_chunks()
                yield Index.build(_one(held, "item"), _one(held, "words"), {"term": _one(terms, "term"), "df": _one(terms, "df").to_numpy()}, total, words / total, longest)


def _one(table: pa.Table, column: str) -> pa.Array:
    found = table.column(column)
    return found.chunk(0) if found.num_chunks else pa.array([], found.type)


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, item_id, score) of every leak; one row for each row of ``docs`` and item.

    Where ``key`` is itself called item_id or score, the other column has an underscore in front.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    names = ["_key", *(f"_{c}" if key == c else c for c in ("item_id", "score"))]
    schema = f"_key {kind}, {names[1]} {item_kind}, {names[2]} double"
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item_key, item_text, shard_items):
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(index))  # postings of a shard, whose size is bounded

        def rows(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared)
            for b in text_slices(batches, "_text"):
                found = [(i, item, score) for i, own in enumerate(index.leaks(b.column("_text"))) for item, score in sorted(own.items())]
                if found:
                    at, item, score = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at)), index.items.take(pa.array(item)), pa.array(score)], names)

        out = out.unionByName(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(rows, schema))
    return out.withColumnRenamed("_key", key)


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of ``docs`` without any leak, with all their columns."""
    spark = docs.sparkSession
    for index in indexes(items, item_key, item_text, shard_items):
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(index))

        def rows(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared)
            for b in text_slices(batches, text):
                clean = [not own for own in index.leaks(b.column(text))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(rows, T.StructType(docs.schema.fields))
    return docs
