"""Training-data operators: brute force, round trips, odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, html_blocks, huffman, jaccard_join, line_dedup, quality_rules, registry, sentencepiece_bpe, substring_dedup, token_counts, url_filter
from lattica.llm.common import fresh_path
from lattica.llm.components import connected_components
from lattica.llm.shingles import shingle_sets

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a  b", "a   b c", "x<|endoftext|>y  <|endoftext|> z", "it's we'll 'tis  \n\n foo", "\n\na\n\nb \n c", "naïve  Ünïcode 123 45a6 … ''s", "日本語 テスト", "a b　c", "tab\tb \t c", "trail ", "'''s 're I've  ", "x" * 300 + " " + "ab" * 200, "🎉🎉 é", "▁▁x ▁ <s>", None]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats and columns with clashing names."""
    rows = [(i, t, "n") for i, t in enumerate(ODD)] + [(0, "", "n"), (None, "null id", "n"), (None, None, None), (3, "other text", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def empty(df):
    return df.limit(0)


# --- 1 line dedup


def dropped_by_force(texts, least):
    """Texts in order of id; a line goes if it lies in a run of ``least`` lines that stood earlier."""
    lines = [t.split("\n") for t in texts]
    seen, gone = {}, [set() for _ in texts]
    for d, ls in enumerate(lines):
        for i in range(len(ls) - least + 1):
            run = tuple(ls[i : i + least])
            if run in seen:
                gone[d] |= set(range(i, i + least))
            seen.setdefault(run, (d, i))
    return ["\n".join(x for i, x in enumerate(ls) if i not in g) for ls, g in zip(lines, gone)]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(14)] + ["", "long\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in line_dedup.drop_copies(df, least).orderBy("doc_id").collect()]
    assert got == dropped_by_force(texts, least)


def test_line_dedup_long_lines(spark):
    """Later copies of one line go where it has more than ``min_words`` words."""
    passage, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"v{i}" for i in range(50))
    texts = [passage, "a\n" + passage + "\nb", short, "c\n" + short, passage, passage + "\n" + passage, "d\ne", "d\ne\nf"]
    want = [passage, "a\nb", short, "c\n" + short, "", "", "d\ne", "f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in line_dedup.drop_copies(df, min_words=50).orderBy("doc_id").collect()] == want


def test_line_dedup_equal_rows(spark):
    """Rows equal in id and text are one document: they keep their lines, and copies of them elsewhere go."""
    rows = [(None, "a\nb"), (None, "a\nb"), (1, "c\nd\ne"), (1, "c\nd\ne"), (1, "other"), (2, "x\nc\nd"), (2, "x\nc\nd")]
    want = [(None, "a\nb")] * 2 + [(1, "c\nd\ne")] * 2 + [(1, "other")] + [(2, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.text) for r in line_dedup.drop_copies(df).collect()), key=str) == sorted(want, key=str)


def test_line_dedup_odd(spark, odd):
    out = line_dedup.drop_copies(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.drop_copies(empty(odd)).count() == 0


# --- 2 decontamination


def test_decontamination(spark, odd):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    item = " ".join(rng.sample(words, 30))
    noise = lambda n: " ".join(rng.choices(words, k=n))
    texts = [noise(200), noise(90) + " " + item.upper() + ". " + noise(300), noise(40) + " " + " ".join(item.split()[:12]) + " " + noise(50), item, None, ""]
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, noise(25))], "item_id int, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, items).collect()} == {(1, 7), (3, 7)}
    assert {r.doc_id for r in decontaminate.remove_leaks(df, items).collect()} == {0, 2, 4, 5}
    assert decontaminate.remove_leaks(odd, items).columns == odd.columns
    assert decontaminate.leaks(df, empty(items)).count() == 0 and decontaminate.remove_leaks(df, empty(items)).count() == 6
    assert decontaminate.leaks(empty(df), items).count() == 0


def test_block_max_search_is_exact():
    """All pairs at or above the threshold, and no others, with weights added up term by term."""
    rng = random.Random(2)
    words = [rng.choices([f"t{j}" for j in range(50)], [1 / (j + 1) for j in range(50)], k=rng.randint(1, 14)) for _ in range(170)]
    df = collections.Counter(t for w in words for t in set(w))
    mean = sum(map(len, words)) / len(words)
    ix = decontaminate.Index.build(pa.array(range(170)), pa.array(words), {"term": pa.array(list(df)), "df": np.array(list(df.values()))}, 170, mean, 14)
    names = ix.vocabulary.to_pylist()

    def share(terms, item):
        part = {t: math.log(1 + (170 - df[t] + 0.5) / (df[t] + 0.5)) * words[item].count(t) * 2.2 / (words[item].count(t) + 1.2 * (0.25 + 0.75 * len(words[item]) / mean)) for t in set(words[item])}
        return sum(part.get(t, 0) for t in terms) / sum(part.values())

    queries = [sorted(rng.sample(range(len(names)), rng.randint(0, 14))) for _ in range(300)]
    found = zip(*(x.tolist() for x in ix.search(np.array(sum(queries, []), np.int64), np.array([len(q) for q in queries]))))
    got = {(q, i): s for q, i, s in found}
    want = {(q, i): s for q, ts in enumerate(queries) for i in range(170) if (s := share([names[t] for t in ts], i)) >= decontaminate.THRESHOLD}
    assert set(got) == set(want) and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def leaks_by_force(rows, items):
    """Leaks of all passages of texts against all items, without an index."""
    normal = lambda t: [w for w in (x.lower().strip(decontaminate.TRIM) for x in re.split(r"[ \t-\r]+", t or "")) if w]
    items = [(i, w) for i, t in items if (w := normal(t))]
    df = collections.Counter(t for _, w in items for t in set(w))
    mean, longest = sum(len(w) for _, w in items) / len(items), max(len(w) for _, w in items)
    stride, out = max(decontaminate.LEAST_STRIDE, longest), {}
    for doc, text in rows:
        w = normal(text)
        for a in range(0, max(len(w) - stride, 1), stride):
            passage = w[a : a + 2 * stride]
            here = decontaminate.grams(passage)
            for i, own in items:
                part = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in set(own)}
                score = sum(s for t, s in part.items() if t in set(passage)) / sum(part.values())
                halves = [decontaminate.grams(h) for h in decontaminate.question_and_answer(own)]
                if score >= decontaminate.THRESHOLD and all(len(h & here) >= decontaminate.OVERLAP * len(h) for h in halves if h):
                    out[doc, i] = max(out.get((doc, i), 0), score)
    return {(d, i, round(s, 6)) for (d, i), s in out.items()}


@pytest.mark.parametrize("shard_items", [20_000, 7])
def test_decontamination_by_force(spark, shard_items):
    """Pairs and scores are those of brute force, however the items are dealt over shards."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(9, 40)))) for i in range(40)] + [(40, None), (41, " - ")]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 400)))) for i in range(40)]
    for i in range(40, 90):
        part = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 6)):
            part[rng.randrange(len(part))] = rng.choice(words)
        rows.append((i, " ".join([*rng.choices(words, k=rng.randint(0, 200)), *part, *rng.choices(words, k=rng.randint(0, 200))])))
    df = spark.createDataFrame(rows + [(90, None), (91, "")], "doc_id long, text string")
    got = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"), shard_items=shard_items)
    want = leaks_by_force(rows, items)
    assert {(r.doc_id, r.item_id, round(r.score, 6)) for r in got.collect()} == want and len(want) > 20
    again = decontaminate.leaks(df.withColumnRenamed("doc_id", "item_id"), spark.createDataFrame(items, "item_id long, text string"), key="item_id")
    assert again.columns == ["item_id", "_item_id", "score"] and again.count() == len(want)


# --- 3 URL filter


def test_url_filter(spark):
    urls = ["https://A.Example.NET/en/1?x=1", "http://example.net/de/", "http://xexample.net/en/", "https://b.example.com/de/2", "https://b.example.com/den", "http://q.org/fr/", "http://q.org/en/", "http://sub.spam-farm.example.org/fr/1", "http://sub.spam-farm.example.org/en/1", "no url", None, "", "http://org", "mailto://x@y"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, url_filter.default_list(spark)).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"),
        ("org/fr/", "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    nothing = spark.createDataFrame([], "url string")
    assert url_filter.judge(df, nothing).where("listed is not null").count() == 0
    assert url_filter.judge(empty(df), url_filter.default_list(spark)).count() == 0


def test_url_filter_long_list(spark):
    """A list of 100,000 entries, a filter so small that false positives pass it, one host with half of all pages."""
    rng = random.Random(3)
    domains, urls = {f"d{i}.example/" for i in range(60_000)}, {f"s{i}.example/a/{i}" for i in range(40_000)}
    listed = spark.createDataFrame([(u,) for u in [*domains, *urls, None, "d1.example/"]], "url string")
    pages = [f"http://d7.example/{i}" for i in range(2000)]
    pages += [rng.choice([f"https://x.d{rng.randint(0, 120_000)}.example/p?q", f"http://www.s{(i := rng.randint(0, 80_000))}.example/a/{i}/#f", f"http://s{rng.randint(0, 80_000)}.example/a/b"]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(pages)), "host long, url string").repartition(4)

    def want(u):
        host, path = re.match(r"[a-z]+://([^/?#]*)([^?#]*)", u).groups()
        labels = host.split(".")
        keys = {".".join(labels[i:]) + "/" for i in range(len(labels))} & domains | {re.sub(r"^www\.", "", host) + path.rstrip("/")} & urls
        return min(keys) if keys else None

    for blocks in (None, 1 << 10):
        got = {r["_host"]: (r.verdict, r.listed) for r in url_filter.judge(df, listed, blocks=blocks, key="host").collect()}
        assert got == {i: ("block" if want(u) else "allow", want(u)) for i, u in enumerate(pages)}
    assert 2200 < sum(v == "block" for v, _ in got.values()) < 3900


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.createDataFrame([(f"h{i}.example/",) for i in range(3000)], "url string")
    row = url_filter.bloom_filter(listed, 1 << 8).withColumn("k", F.lit(1))
    tried = listed.withColumn("k", F.lit(1)).join(row, "k").where(url_filter.may_be_listed(F.col("url"), 1 << 8))
    assert tried.count() == 3000


# --- 4 HTML


def test_html_blocks(spark):
    net = html_blocks.trained()
    data = html_blocks.training_pages(60, 12345)
    marks = html_blocks.label(net, [b for b, _ in data])
    wrong = sum(int((m != np.array(y)).sum()) for m, (_, y) in zip(marks, data))
    assert wrong <= 0.02 * sum(len(m) for m in marks)
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>one\n two<p>three <b>bold</b>.</article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", "<p")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_blocks.extract(df).collect())
    assert (1, "A & B\none two\nthree bold.", 25) in got and (2, "", 0) in got and (3, "", 0) in got and len(got) == 4


def test_html_query(spark):
    """On the test pages, the query returns the whole article and nothing else."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {(r.page_id, r.url, "\n".join(t for p, t, _ in html_blocks.leaf_blocks(r.html) if "article" in p)) for r in rows}
    got = registry.op4_html_blocks(spark, sf).collect()
    assert {(r.page_id, r.url, r.text) for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>one <a title=5\" x>two</a> three</p><p>four five</p>", ["one two three", "four five"]),
        ("<p>a <b class='x\">b</b> c</p><p>d'> e</p>", ["a e"]),  # a quoted value runs to the next quote of its kind
        ("<p>a<a href=x'y>b</a>c", ["abc"]),
        ("<p>x <math><mi>y</mi></math> <object>z</object> <svg><text>t</text></svg></p>", ["x y z t"]),
        ("<p>a</p><title>b<p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><script>if (a<b) '</p>'</script ><p>c</p><style>p{}", ["a", "c"]),
        ("<p>1 < 2 & 3 &lt; 4 &#x41;&nbsp;B</p>", ["1 < 2 & 3 < 4 A B"]),
        ("<p>a<!-- <p>b --><p>c <![CDATA[x]]> d", ["a", "c d"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<p>" + "w " * 50_000 + "</p>" + "<div>" * 3000 + "deep", ["w " * 49_999 + "w", "deep"]),
        ("<p a='", []),
        ("", []),
    ],
)
def test_leaf_blocks(page, want):
    assert [t for _, t, _ in html_blocks.leaf_blocks(page)] == want


def test_html_names_that_training_never_had():
    """Held-out layouts whose classes and ids are words of another language: blocks are told by place, tags and text."""
    net, rng = html_blocks.trained(), random.Random(99)
    pages = []
    while len(pages) < 80:
        page, labels = html_blocks.training_page(rng)
        page = re.sub(r'(class|id)="?([a-z-]+)"?', lambda m: f'{m[1]}="kx{sum(map(ord, m[2])) % 97}"', page)
        blocks = html_blocks.leaf_blocks(page)
        if len(blocks) == len(labels):
            pages.append((blocks, labels))
    wrong = sum(int((m != np.array(y)).sum()) for m, (_, y) in zip(html_blocks.label(net, [b for b, _ in pages]), pages))
    total = sum(len(y) for _, y in pages)
    assert wrong <= 0.12 * total


def test_leaf_blocks_of_unclosed_tags():
    """Time and memory grow with the page, not with the square of its open tags."""
    for page in ("<div><p>x" * 32_000, "<b><h1>x</h1>" * 32_000):
        t = time.process_time()
        assert len(html_blocks.leaf_blocks(page)) == 32_000 and time.process_time() - t < 10
    few = html_blocks.leaf_blocks('<div class="main-body"><p id=a>x')
    _, x = html_blocks.features([few])
    slots = {html_blocks._slot(w, html_blocks.PATH_SLOTS) for w in ("div", "class=main-body", "class", "main", "body", "p", "id=a", "id", "a")}
    assert len(few[0][0]) == 4 and "class=main-body" in few[0][0] and set(np.flatnonzero(x[0, : html_blocks.PATH_SLOTS])) == slots


# --- 5, 6, 9 tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_prefix_counts(library):
    lengths, counts = token_counts.shared(BPE).prefix_counts(pa.array(ODD))
    at = 0
    for t, n in zip(ODD, lengths):
        t = t or ""
        want = [len(e.ids) for e in library.encode_batch([t[: i + 1] for i in range(len(t))], add_special_tokens=False)] if t else []
        assert counts[at : at + n].tolist() == want, t
        at += n


def test_prefix_counts_of_long_words(library):
    """Long pre-tokens and texts full of special strings: the library's counts, in seconds."""
    rng = random.Random(11)
    counter = token_counts.shared(BPE)
    letters = "".join(rng.choices("etaoinshrdlu", k=40_000))
    texts = [letters, "".join(map(chr, (rng.randint(0x4E00, 0x9FFF) for _ in range(8000)))), "a" * 9000, "-=" * 5000, "ab <|endoftext|>" * 3000 + "<|endoftext|>" * 3000, "x" * 2047 + "y" * 2]
    lengths, values = counter.prefix_counts(pa.array(texts))
    ends = np.cumsum(lengths)
    assert lengths.tolist() == [len(t) for t in texts]
    assert values[ends - 1].tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    for n in (1, 2049, 16_383, 16_384, 16_385, 16_400, 33_000):
        assert values[n - 1] == len(library.encode(letters[:n], add_special_tokens=False).ids)
    t = time.process_time()
    big = ["".join(rng.choices("etaoinshrdlu", k=1_000_000)), "<|endoftext|>x" * 100_000]
    lengths, values = counter.prefix_counts(pa.array(big))
    assert time.process_time() - t < 60
    assert values[np.cumsum(lengths) - 1].tolist() == [len(x.ids) for x in library.encode_batch(big, add_special_tokens=False)]


def test_token_counts(spark, docs, odd, library):
    for df in (docs, odd):
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        texts = {(d, len(t.encode())): t for d, t in rows}
        got = token_counts.token_counts(df, BPE, 100).collect()
        assert collections.Counter(tuple(r)[:4] for r in got) == collections.Counter((d, len(t.encode()), count(t), count(t) > 100) for d, t in rows)
        assert all(count(texts[r.doc_id, r.n_bytes][: r.cut]) <= 100 for r in got)
    assert token_counts.token_counts(empty(odd), BPE).count() == 0


def test_stored_counts_answer_budgets(spark, docs, library):
    """Every budget is answered from the stored rows; long runs of one character change counts by more than a byte holds."""
    rows = [(0, "a " * 50), (1, "=" * 3000 + " x"), (2, None), (3, " " * 900 + "y")]
    stored = token_counts.prefix_counts(spark.createDataFrame(rows, "n_tokens int, text string"), BPE, key="n_tokens").cache()
    for budget in (0, 1, 7, 60, 10**6):
        for r in token_counts.answers(stored, budget, "n_tokens").collect():
            t = dict(rows)[r["_n_tokens"]] or ""
            fits = [i for i in range(len(t) + 1) if len(library.encode(t[:i], add_special_tokens=False).ids) <= budget] if budget in (7, 60) else []
            assert r.n_tokens == len(library.encode(t, add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > budget)
            assert not fits or r.cut == fits[-1]


def test_sentencepiece_takes_the_library_where_they_differ(spark, monkeypatch):
    agenda = sentencepiece_bpe.Agenda(SP)
    right = agenda.encode_segments
    monkeypatch.setattr(agenda, "encode_segments", lambda segments: [r[:-1] if "qu" in s else r for s, r in zip(segments, right(segments))])
    texts = ["a quick fox", None, "quite  quiet", "a fox"]
    n, ids, _, taken = agenda.digests(pa.array(texts))
    assert taken == [1, 0, 2, 0]
    for t, k, digest in zip(texts, n, ids):
        want = [*agenda.library.encode(t or ""), 2]
        assert k == len(want) and digest == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_sentencepiece_rows_are_the_agendas(monkeypatch):
    """Short segments have an agenda as long ones do, and the library's ids stand in for none."""
    agenda = sentencepiece_bpe.Agenda(SP)
    asked = []
    right = agenda.encode_segment
    monkeypatch.setattr(agenda, "encode_segment", lambda segment: asked.append(segment) or right(segment))
    assert agenda.digests(pa.array(["a quick fox", "w" * 200]))[3] == [0, 0]
    assert sorted(asked) == sorted(["▁a", "▁quick", "▁fox", "▁" + "w" * 200])
    monkeypatch.setattr(agenda, "encode_segment", lambda segment: right(segment)[:-1])
    with pytest.raises(ValueError, match="agenda and library differ"):
        agenda.digests(pa.array(["never met"]))


def test_sentencepiece_segments_at_random():
    agenda = sentencepiece_bpe.Agenda(SP)
    rng = random.Random(5)
    letters = ["a", "e", "t", "th", "ing", "0", "1", "-", "=", "\n", "\t", "é", "ß", "中", "日本", "😀", "\u0301", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "\u00a0", "\u200b", "\u3000", "Q", "."]
    segments = ["▁" + "".join(rng.choices(letters, k=rng.randint(1, 70))) for _ in range(4000)]
    assert agenda.encode_segments(segments) == agenda.library.encode([s[1:] for s in segments])


def test_huffman_codes():
    rng = np.random.default_rng(0)
    counts = np.minimum(rng.zipf(1.2, 3000), 10**9)
    for most in (12, 18):
        lengths = huffman.code_lengths(counts, most)
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 and lengths.max() <= most
    codes = huffman.canonical_codes(lengths)
    table = huffman.decode_table(lengths, codes)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.choice(3000, n)
        payload, marks = huffman.encode_block(ids, lengths, codes)
        assert (huffman.decode_block(payload, marks, n, table) == ids).all()


def test_huffman_round_trip(spark, docs, odd, library):
    for df, partitions in ((docs, 5), (odd, 3)):
        files = huffman.write(df, fresh_path(spark, "test"), BPE, 2, partitions=partitions)
        got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in huffman.read(spark, files).collect()), key=lambda r: r[1])
        want = collections.Counter()
        for d, t in df.select("doc_id", "text").collect():
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert collections.Counter((d, n, c) for d, _, n, c in got) == want
        assert [s for _, s, _, _ in got] == list(itertools.accumulate([0, *(n for _, _, n, _ in got)]))[:-1]
        assert [d for d, *_ in got] == sorted((d for d, *_ in got), key=lambda d: (d is not None, d))
    files = huffman.write(odd.select(F.col("doc_id").alias("ids"), F.col("text").alias("shard")), fresh_path(spark, "test"), BPE, text="shard", key="ids")
    assert huffman.read(spark, files, "ids").columns == ["_ids", "start", "n_tokens", "ids_crc32", "ids"]
    files = huffman.write(empty(odd), fresh_path(spark, "test"), BPE)
    assert huffman.read(spark, files).count() == 0


def test_sentencepiece(spark, docs, odd):
    agenda = sentencepiece_bpe.shared(SP)
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        got = sorted((tuple(r)[:4] for r in sentencepiece_bpe.digests(df, SP).collect()), key=str)
        want = []
        for d, t in rows:
            ids = [*agenda.library.encode(t or ""), 2]
            text = agenda.library.decode(ids)
            assert agenda.encode_text(t) == ids and agenda.decode(ids) == text
            want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want, key=str)
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs.limit(20), SP), SP)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.limit(20).collect()}


# --- 7 substrings


def test_substring_dedup(spark, odd):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    passage = words(80)
    texts = [words(100), words(30) + " " + passage + " " + words(20), passage + " " + words(60), words(50), words(11) + " x " + passage, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in substring_dedup.repeats(df).collect()} == {1, 2, 4}
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert out[1] == texts[1] and out[5] is None and len(out[2]) < len(texts[2]) - 200
    assert substring_dedup.remove_repeats(odd).count() == odd.count() and substring_dedup.repeats(empty(odd)).count() == 0


def test_substring_dedup_keeps_characters(spark):
    """Texts of characters of two to four bytes: what stays is a subsequence of whole characters, and little more than the rest."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("äßçñ日本語文🎉🙂é", k=rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, heads = text(120), [text(rng.randint(1, 40)) for _ in range(12)]
    texts = [h + passage + text(20) for h in heads]
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == texts[0]
    for i in range(1, 12):
        rest = iter(texts[i])
        assert all(c in rest for c in out[i]) and len(out[i].encode()) < len(texts[i].encode()) - 600
        assert out[i].startswith(heads[i][:-8])


def test_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    gear = substring_dedup.gear_table()

    def parts(x):
        begin, size = substring_dedup.cuts(x, np.array([len(x)]), gear)
        assert size.sum() == len(x) and (size <= substring_dedup.MOST).all()
        return {x[a : a + n].tobytes() for a, n in zip(begin, size)}

    assert len(parts(data) & parts(np.insert(data, 5000, 65))) >= len(parts(data)) - 3


def test_substring_dedup_equal_rows(spark):
    """Rows equal in id and text are one document: they keep their passages, and copies of them elsewhere go."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    passage, end = words(80), words(60)
    rows = [(0, passage), (1, passage + " " + end), (1, passage + " " + end), (None, words(70)), (2, end)]
    rows.insert(4, rows[3])
    out = [r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    texts = [t for _, t in rows]
    assert out.count(texts[0]) == 1 and out.count(texts[3]) == 2
    cut = [t for t in out if t != texts[1] and t.endswith(end)]
    assert len(cut) == 2 and cut[0] == cut[1] and len(cut[0]) < len(texts[1]) - 200
    assert min(map(len, out)) < len(end) - 200


def test_substring_dedup_of_short_periods(spark):
    """Cuts closer than the least chunk come back at least that far apart, so two texts meet in one word said over and over."""
    gear, rng, said = substring_dedup.gear_table(), random.Random(2), []
    while len(said) < 5:  # words with a place for a cut in each repetition
        word = "".join(rng.choices("abcdefgh", k=rng.randint(4, 9))) + " "
        data = np.frombuffer(word.encode() * 80, np.uint8)
        begin, size = substring_dedup.cuts(data, np.array([len(data)]), gear)
        assert (size <= substring_dedup.MOST).all() and (size[:-1] >= substring_dedup.LEAST).all()
        hashes = (sum(int(gear[b]) << i for i, b in enumerate(data[100 + k - substring_dedup.SPAN : 100 + k][::-1])) & 0xFFFFFFFF for k in range(len(word)))
        if any(h >> (32 - substring_dedup.MASK_BITS) == 0 for h in hashes):
            said.append(word)
    words = lambda n: " ".join("".join(rng.choices("mnopqrst", k=rng.randint(2, 8))) for _ in range(n)) + " "
    rows = [(2 * i + k, words(30) + w * 70 + words(30)) for i, w in enumerate(said) for k in (0, 1)]
    assert {r.doc_id for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(range(10))


def test_substring_dedup_query_removes(spark):
    """The query reports what removal leaves of each row found; rows not found stay whole."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    got = {r.doc_id: r for r in registry.op7_substring_dedup(spark, sf).collect()}
    assert got and any(r.copied_bytes for r in got.values())
    for r in docs.collect():
        if r.doc_id in got:
            assert got[r.doc_id].text_md5 == hashlib.md5(left[r.doc_id].encode()).hexdigest() and got[r.doc_id].left_bytes == len(left[r.doc_id].encode())
        else:
            assert left[r.doc_id] == r.text


def test_substring_dedup_digests_of_equal_rows(spark, odd):
    """Rows equal in id and text, null ids among them, are told apart and cut alike."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    passage = words(80)
    rows = [(0, passage), (1, words(50) + " " + passage), (None, passage + " " + words(9)), (5, words(70))]
    df = spark.createDataFrame([*rows, *rows[1:3]], "doc_id long, text string").coalesce(1)
    left = collections.Counter(hashlib.md5(r.text.encode()).hexdigest() for r in substring_dedup.remove_repeats(df).collect() if r.doc_id != 5)
    got = substring_dedup.digests(df).collect()
    assert collections.Counter(r.text_md5 for r in got) == left and sorted(map(str, (r.doc_id for r in got))) == ["0", "1", "1", "None", "None"]
    assert substring_dedup.digests(empty(odd)).count() == 0


def chunks_by_force(text):
    """(start, bytes) of each chunk: the gear hash byte by byte."""
    gear, raw = [int(g) for g in substring_dedup.gear_table()], text.encode()
    h, ends = 0, set()
    for i, b in enumerate(raw):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        if i + 1 >= substring_dedup.SPAN and h >> (32 - substring_dedup.MASK_BITS) == 0:
            ends.add(i + 1)
    out, at = [], 0
    while at < len(raw):
        end = next((e for e in range(at + substring_dedup.LEAST, min(at + substring_dedup.MOST, len(raw))) if e in ends), min(at + substring_dedup.MOST, len(raw)))
        out.append((at, raw[at:end]))
        at = end
    return out


def digests_by_force(rows, least=substring_dedup.RUN_BYTES):
    """(id, n_spans, span_bytes, copied_bytes, left_bytes, text_md5) of rows with different ids."""
    cut = {i: chunks_by_force(t or "") for i, t in rows}
    holders = collections.defaultdict(list)
    for i in sorted(cut):
        for _, c in cut[i]:
            holders[c].append(i)
    again = {c: ids[0] for c, ids in holders.items() if ids[0] != ids[-1]}

    def runs(i, fits):
        found, open_ = [], None
        for at, c in cut[i]:
            if not fits(c):
                open_ = None
            elif open_:
                open_[1], open_[2] = at + len(c), open_[2] + len(c) * (again[c] < i)
            else:
                open_ = [at, at + len(c), len(c) * (again[c] < i)]
                found.append(open_)
        return [r for r in found if r[1] - r[0] >= least]

    out = []
    for i, t in rows:
        spans = runs(i, lambda c: c in again)
        if not spans:
            continue
        raw, parts, at = t.encode(), [], 0
        for a, e, _ in runs(i, lambda c: again.get(c, i) < i):
            while a < e and raw[a] & 0xC0 == 0x80:
                a += 1
            while a < e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            parts.append(raw[at : max(at, a)])
            at = max(at, e)
        left = b"".join([*parts, raw[at:]])
        out.append((i, len(spans), sum(e - a for a, e, _ in spans), sum(c for *_, c in spans), len(left), hashlib.md5(left).hexdigest()))
    return sorted(out)


def test_substring_dedup_by_force_in_any_order(spark, docs):
    """Query and force agree in all columns, whatever the order and the partitions of the table's rows."""
    want = digests_by_force([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 10
    assert sorted(map(tuple, registry.op7_substring_dedup(spark, "/root/testdata/sf0.001").collect())) == want
    assert sorted(map(tuple, substring_dedup.digests(docs.orderBy(F.desc("doc_id")).repartition(3)).collect())) == want


# --- 8 Jaccard join


def words_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles_of(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def by_force(rows):
    sets = [shingles_of(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (d, _) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(known) if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 70))] for _ in range(8)]
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(90):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w + (common if rng.random() < 0.4 else []))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.components(df).collect()), key=str) == by_force(rows)


def test_jaccard_join_large_group(spark, monkeypatch):
    """Exact copies, near copies of near copies, and sets just too far from them; leaders and comparisons dealt over salts."""
    monkeypatch.setattr(jaccard_join, "PAIRS_A_SALT", 4)
    monkeypatch.setattr(jaccard_join, "TRIES_A_SALT", 300)
    monkeypatch.setattr(jaccard_join, "FIRST_LEADERS", 2)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 360):
        w = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 6)}"
        rows.append((i, " ".join(w)))
    rows += [(None, rows[70][1]), (70, rows[71][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, jaccard_join.components(df).collect()), key=str)
    assert got == by_force(rows) and len({c for *_, c in got}) > 5


def test_jaccard_join_walks_few_links(spark, monkeypatch):
    """Near copies that each link with many: after the leaders' rounds, neither settled links nor all links of a set are walked."""
    monkeypatch.setattr(jaccard_join, "FIRST_LEADERS", 2)
    walked, walk = [], jaccard_join.connected_components

    def counted(links):
        walked.append(links.count())
        return walk(links)

    monkeypatch.setattr(jaccard_join, "connected_components", counted)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 2])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 400)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.components(df).collect()), key=str) == by_force(rows)
    assert len(walked) > 2 and all(n < len(rows) for n in walked[2:])


def test_connected_components(spark):
    """Cliques, a path in random order, a star around its greatest node, and no links at all."""
    rng = random.Random(8)
    path = rng.sample(range(1000, 1200), 200)
    links = [*itertools.combinations(range(30), 2), *zip(path, path[1:]), *((2000, n) for n in range(1500, 1540)), (7, 7), (3000, 3000), (1, 0)]
    rng.shuffle(links)
    want = {n: 0 for n in range(30)} | {n: 1000 for n in path} | {n: 1500 for n in [2000, *range(1500, 1540)]} | {3000: 3000}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.comp for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_connected_components_of_an_ascending_path(spark, monkeypatch):
    """Rounds grow with the logarithm of a path's length, in whatever order its nodes are numbered."""
    from lattica.llm import components

    tables, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: tables.append(label) or write(df, label))
    got = components.connected_components(spark.range(1000).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert len(got) == 1001 and {r.comp for r in got} == {0} and tables.count("moved") <= 12


def test_jaccard_join_deals_a_grid(spark, monkeypatch):
    """Members of one shingle dealt over cells of a few comparisons are still all compared."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:20] + rng.sample(base[20:], 12) + [f"own{i}x{k}" for k in range(i % 5)])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(0, 120, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "TRIES_A_SALT", 16)
    assert sorted(map(tuple, jaccard_join.components(df).collect()), key=str) == by_force(rows)


def test_jaccard_join_odd(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard_join.components(odd).collect()), key=str) == by_force(rows)
    assert jaccard_join.components(empty(odd)).count() == 0
    assert jaccard_join.keep_one(odd).columns == odd.columns


def test_keep_one_by_text(spark):
    """A text that resembles nothing stays, whatever its id; of a component one row stays."""
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(1, a, "p"), (5, b, "q"), (5, a, "r"), (None, a, "s"), (7, c, "t"), (7, c, "t"), (7, c, "u"), (7, c + "more", "v"), (8, None, "w"), (8, "", "x"), (8, "", "x"), (2, b + "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = sorted((tuple(r) for r in jaccard_join.keep_one(df).collect()), key=str)
    kept = [r for r in got if r[0] != 7]
    assert kept == sorted([(1, a, "p"), (None, a, "s"), (8, None, "w"), (8, "", "x"), (2, b + "x", "y")], key=str)
    assert len(got) == len(kept) + 1
    apart = [(5, a, "p"), (5, b, "q"), (5, c, "r")]
    assert jaccard_join.keep_one(spark.createDataFrame(apart, df.schema)).count() == 3


def test_shingle_sets():
    for t in ODD:
        assert shingle_sets(pa.array([t], pa.string()))[0][0] == len(shingles_of(t))


# --- 10 quality rules


def statistics_by_force(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs, odd):
    more = spark.createDataFrame([(1, "a b c d e f g h " * 5, "x"), (2, "a b c d e f g h i a b c d e f g h", "x"), (3, "x\nx\n \n\nx|$", "x")], "doc_id long, text string, n_tokens string")
    for df in (docs, odd, more):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        got = sorted(tuple(r[c] for c in names) for r in quality_rules.judge(df).collect())
        assert got == sorted(statistics_by_force(r.text) for r in df.select("text").collect())
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.judge(empty(odd)).count() == 0 and quality_rules.keep_good(empty(odd)).count() == 0


def votes_by_force(t):
    """Votes from the raw text, and whether the base rule fails."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n, chars, symbols, dup, repeat = statistics_by_force(t)
    k, lines = max(n, 1), max(sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n")), 1)
    closed = len(re.findall(r"[.!?:;…](?=[\x20\x09-\x0D]|\Z)", t or ""))
    share = lambda x, good, bad, of=k: -1 if 100 * x > bad * of else 1 if 100 * x <= good * of else 0
    out = {
        "symbols": share(symbols, 2, 10),
        "marked": share(sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), 2, 10),
        "letters": share(sum(not any(c.isalpha() for c in x) for x in w), 5, 25),
        "word_length": -1 if not 2 * k <= chars <= 14 * k else 1 if 3 * k <= chars <= 10 * k else 0,
        "variety": -1 if 100 * len(set(w)) < 25 * min(k, 400) else 1 if len(set(w)) ** 2 >= 2 * k else 0,
        "stutter": share(sum(a == b for a, b in zip(w, w[1:])), 5, 25),
        "dup_lines": share(dup, 10, 40, lines),
        "repeats": share(repeat, 10, 25),
        "sentences": -1 if closed == 0 and n >= 30 else 1 if 100 * closed >= 3 * k else 0,
    }
    return out, n < 20 or 100 * repeat > 30 * n


def test_quality_verdict_by_force(spark):
    """Expectation-maximisation document by document, from raw texts, gives the query's verdicts."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    voted = {r.doc_id: votes_by_force(r.text) for r in rows}
    classes, seen = ["good", "marks", "repetition"], [v for v, failed in voted.values() if not failed]
    names = list(seen[0])
    prior = dict(zip(classes, (0.9, 0.05, 0.05)))
    says = {r: {c: 0.6 if r in quality_rules.KINDS.get(c, ()) else 0.05 for c in classes} for r in names}

    def chances(v):
        p = {c: prior[c] * math.prod(says[r][c] if v[r] < 0 else 1 - says[r][c] for r in names if v[r]) for c in classes}
        return {c: x / sum(p.values()) for c, x in p.items()}

    for _ in range(quality_rules.ROUNDS):
        ps = [chances(v) for v in seen]
        tally = {r: {c: (sum(p[c] for p, v in zip(ps, seen) if v[r] < 0) + 0.5) / (sum(p[c] for p, v in zip(ps, seen) if v[r]) + 1) for c in classes} for r in names}
        prior, says = {c: (sum(p[c] for p in ps) + 1) / (len(seen) + 3) for c in classes}, tally
    got = {r.doc_id: r for r in registry.op10_quality_rules(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, (v, failed) in voted.items():
        good = chances(v)["good"]
        assert got[d].base_failed == failed and abs(got[d].quality - good) < 1e-6, d
        assert got[d].kept == (not failed and good >= 0.5)


def test_quality_agrees_with_labels(spark):
    """Of labelled documents that pass the base rule, bad ones go and good ones stay."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in registry.op10_quality_rules(spark, sf).where("not base_failed").collect() if r.doc_id in labels]
    bad, good = [k for y, k in judged if not y], [k for y, k in judged if y]
    assert len(bad) > 20 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.98 * len(good)


def test_estimates_find_reliable_rules():
    """A rule that fires on its kind of bad text is told from one that fires by chance."""
    rng = random.Random(0)
    rate = {"good": {}, "marks": {"symbols": 0.95, "marked": 0.9, "letters": 0.5}, "repetition": {"variety": 0.9, "stutter": 0.8}}
    names = ["symbols", "marked", "letters", "variety", "stutter", "sentences"]
    patterns = collections.Counter()
    for _ in range(6000):
        kind = rng.choices(list(rate), [0.85, 0.1, 0.05])[0]
        patterns[tuple(0 if rng.random() < 0.1 else -1 if rng.random() < rate[kind].get(r, 0.3 if r == "sentences" else 0.01) else 1 for r in names)] += 1
    share, says = quality_rules.fit(list(patterns.items()), names, 60)
    assert abs(share["marks"] - 0.1) < 0.02 and abs(share["repetition"] - 0.05) < 0.02
    assert says["symbols"]["marks"] > 0.9 and says["stutter"]["repetition"] > 0.7 and all(says[r]["good"] < 0.05 for r in names[:5])
    assert all(abs(p - 0.3) < 0.1 for p in says["sentences"].values())


# --- pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece"]
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    kept = {r.doc_id: r.text for r in quality_rules.keep_good(docs).collect()}
    ids = sorted(kept)
    lines = {i: t for i, t in zip(ids, dropped_by_force([kept[i] for i in ids], 2)) if t or not kept[i]}
    single = {d for d, _, c in by_force(sorted(lines.items())) if d == c}
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d in single if not any(x in " ".join(words_of(lines[d])) for x in items)}
    assert set(out) == clean
    assert len(kept) > len(lines)
    agenda = sentencepiece_bpe.shared(SP)
    assert all(out[d] == len(agenda.library.encode(lines[d])) + 1 for d in clean)


def test_pipeline_odd(spark, tmp_path):
    """Nulls, repeated rows, clashing and further columns, no rows, no benchmark."""
    import corpus_pipeline

    rng = random.Random(1)
    text = lambda n: "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(12)) + "." for _ in range(n))
    good, other, item = text(5), text(6), " ".join(text(3).split())
    rows = [(1, good), (1, good), (2, good), (None, other), (None, None), (3, None), (4, ""), (5, "x " * 400), (6, text(4) + "\n" + item), (7, text(9))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, sid string, node long, _row string, n_tokens string"
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 5, "r", "n") for d, t in rows], schema)

    def run(docs, items, name):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return corpus_pipeline.run(spark, f"{tmp_path}/{name}")

    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    got = collections.Counter(r.doc_id for r in run(df, items, "a").collect())
    assert got == {1: 1, None: 1, 7: 1}
    assert collections.Counter(r.doc_id for r in run(df, items.limit(0), "b").collect()) == {1: 1, None: 1, 6: 1, 7: 1}
    assert run(df.limit(0), items, "c").count() == 0
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/a")
        assert docs.columns == df.columns
