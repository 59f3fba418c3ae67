"""Scalar text functions as Column expressions; only the hashes of signatures leave the JVM, as Arrow data."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def slug(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash but for a bare root."""
    plain = F.regexp_replace(c, r"#.*$", "")
    head = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substr(plain, F.length(head) + 1)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    bare = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, r"/+$", ""))
    return F.concat(F.lower(head), bare, query)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def context_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_-]{3,})"), F.lit(1)))


def surface_forms(label: Column) -> Column:
    """A label, the text of its trailing bracket (2 to 20 characters), and the label without it."""
    inner = F.regexp_extract(label, r"\(([^()]{2,20})\)\s*$", 1)
    outer = F.trim(F.regexp_replace(label, r"\s*\([^()]{2,20}\)\s*$", ""))
    return F.filter(F.array_distinct(F.array(label, F.trim(inner), outer)), lambda x: x != "")


def trusted_form(form: Column) -> Column:
    """An acronym of 2 to 6 capitals, or five characters or more."""
    return ((form == F.upper(form)) & form.rlike(r"^\p{L}{2,6}$")) | (F.length(form) >= 5)


def fnv1a(c: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, kept to 31 bits at each byte."""
    digits = F.hex(F.encode(c, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(digits).cast("int"), F.lit(2)), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    folded = F.aggregate(bytes_, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(0x7FFFFFFF))
    return F.when(F.length(digits) > 0, folded).otherwise(F.lit(2166136261).cast("bigint"))


def shingles(c: Column, k: int = 3) -> Column:
    """Distinct character k-grams of the lower-cased text with single spaces; a shorter text is one shingle."""
    clean = F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(clean) - (k - 1), F.lit(1))), lambda i: F.substr(clean, i, F.lit(k)))
    return F.array_distinct(grams)


def permutations(count: int = 64, seed: int = 42) -> list[tuple[int, int]]:
    """Coefficients (a, b) of universal hashes modulo 2 ** 31 - 1."""
    prime, rng = 2147483647, random.Random(seed)
    a = [rng.randint(1, prime - 1) for _ in range(count)]
    return list(zip(a, [rng.randint(0, prime - 1) for _ in range(count)]))


def minhash(c: Column, k: int = 3, count: int = 64) -> Column:
    """Signature of ``count`` least hash values over the text's shingles; a null text counts as empty."""
    ab = permutations(count)

    def signature(grams: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(grams), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = pc.fill_null(pc.list_flatten(grams), "").cast(pa.large_binary())
        lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False)
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        h = np.full(len(lengths), 2166136261, np.int64)  # as ``fnv1a``
        for j in range(int(lengths.max(initial=0))):
            more = lengths > j
            h[more] = ((h[more] ^ data[begin[more] + j]) * 16777619) & 0x7FFFFFFF
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        least = np.zeros((len(sizes), len(ab)), np.int64)
        for i, (a, b) in enumerate(ab if len(starts) else []):
            least[some, i] = np.minimum.reduceat((h * a + b) % 2147483647, starts)
        values = pa.array(least.ravel(), mask=np.repeat(~some, len(ab)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * len(ab)), values)

    return F.arrow_udf(signature, "array<bigint>")(shingles(c, k))


def question_score(question: str, c: Column) -> Column:
    """1 for equal texts, 0.8 if one holds the other, else half the share of question words found."""
    q = question.lower().strip()
    parts = sorted(set(q.split()))
    t = F.lower(F.trim(c))
    overlap = F.size(F.array_intersect(F.split(t, r"\s+"), F.array(*map(F.lit, parts)))) if parts else F.lit(0)
    score = F.when(t == q, 1.0).when(t.contains(q) | F.lit(q).contains(t), 0.8).otherwise(0.5 * overlap / max(len(parts), 1))
    return F.when(c.isNull() | (t == "") | F.lit(q == ""), F.lit(0.0)).otherwise(score)


def fuzzy_score(query: str, c: Column) -> Column:
    """1 equal, .95 prefix, .9 whole word, .85 word prefix, .75 contained, up to .7 for a subsequence, else 0."""
    q, t = query.lower().strip(), F.lower(c)
    parts = F.split(t, r"[\s_\-/]+")
    # least place after which all letters have been met in order; -1 once one is missing
    end = F.lit(0)
    for ch in q:
        at = F.call_function("locate", F.lit(ch), t, end + 1)
        end = F.when((end < 0) | (at == 0), F.lit(-1)).otherwise(at)
    spread = 0.7 * len(q) / F.greatest(end, F.lit(1))
    return (
        F.when(t == q, 1.0)
        .when(t.startswith(q), 0.95)
        .when(F.array_contains(parts, q), 0.9)
        .when(F.exists(parts, lambda w: w.startswith(q)), 0.85)
        .when(t.contains(q), 0.75)
        .when(end > 0, F.least(F.lit(0.7), spread))
        .otherwise(0.0)
    )


def xml_escape(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.regexp_replace(out, '"', "&quot;")


def quoted(c: Column, quote: str = '"') -> Column:
    """Backslash escapes of quotes, backslashes and line ends, for Turtle and Cypher."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(quote), F.lit("\\" + quote))
    return F.concat(F.lit(quote), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit(quote))
