"""Quality rules by weak supervision (operator 10).

Rules vote good (+1), bad (-1) or abstain (0) on each document.  How far a rule
can be trusted is not set by hand: expectation-maximisation over the counts of
vote patterns estimates the shares of good texts and of two kinds of bad ones
(marks instead of words, repetition) and how each rule votes on each, and the
posterior probability of good quality replaces an all-must-pass filter.  Documents
that fail the base rule take no part in the estimates.

Only DataFrame functions are used.  All statistics of a text come from arrays
within its row, so nothing is shuffled but the counts of vote patterns; their
number is bounded by 3 to the number of rules (19,683), whatever the input's size,
and the estimates are computed from this summary alone.

Defined results: a null text counts as empty: no words, all counts 0, base_failed
true and so not kept; repeated documents keep a row each; null ids are passed
through; an empty table gives no rows; further columns of the input are ignored
by ``judge`` and handed on untouched by ``keep_good``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 8
ROUNDS = 30
SMOOTH = 0.5
THRESHOLD = 0.5


def _repeat_words(hashes: Column) -> Column:
    """Words within windows that stand in the text twice or more.

    Windows are numbered by their hash; sorted by (hash, place) equal ones are
    neighbours, and their places in order tell how many words they cover.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def places(s: Column) -> Column:
        n = F.size(s)
        return F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < n - 1) & (F.get(s, F.least(i + 1, n - 1))["h"] == x["h"])),
                    x["p"],
                ),
            ),
            lambda p: p.isNotNull(),
        )

    def covered(at: Column) -> Column:
        n = F.size(at)
        return F.aggregate(
            F.transform(at, lambda p, i: F.when(i < n - 1, F.least(F.lit(WINDOW), F.get(at, F.least(i + 1, n - 1)) - p)).otherwise(F.lit(WINDOW))),
            F.lit(0),
            lambda a, x: a + x,
        )

    # transform over one-element arrays binds an intermediate array once
    at = F.transform(F.array(pairs), places)
    at = F.transform(at, lambda a: F.array_sort(a))
    return F.get(F.transform(at, covered), F.lit(0)).cast("long")


def statistics(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the votes use)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step1 = docs.select(*carry, whole.alias("_text")).select(
        *carry,
        F.length(F.regexp_replace("_text", WHITE, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"[.!?:;…]([\x20\x09-\x0D]|$)")).cast("long").alias("n_closed"),
        # a word is looked at once, from its start
        F.regexp_count("_text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>]")).cast("long").alias("n_marked"),
        F.regexp_count("_text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_unlettered"),
        F.transform(F.filter(F.split("_text", WHITE), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("_w"),
        lines.alias("_lines"),
    )
    n = F.size("_w")
    # a window is known by the hash of its words' hashes
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    step2 = step1.select(
        *carry,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        "n_closed",
        "n_marked",
        "n_unlettered",
        F.size(F.filter("_w", lambda w, i: (i > 0) & (F.get(F.col("_w"), i - 1) == w))).cast("long").alias("n_stutter"),
        hashes.alias("_h"),
    )
    repeated = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_h")))
    return step2.select(*[c for c in step2.columns if c != "_h"], repeated.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule: +1 good, -1 bad, 0 abstains."""
    c = F.col

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    n = F.greatest(c("n_words"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    return {
        "symbols": vote(100 * c("n_symbols") <= 2 * n, 100 * c("n_symbols") > 10 * n),
        "marked": vote(100 * c("n_marked") <= 2 * n, 100 * c("n_marked") > 10 * n),
        "letters": vote(100 * c("n_unlettered") <= 5 * n, 100 * c("n_unlettered") > 25 * n),
        "word_length": vote(c("word_chars").between(3 * n, 10 * n), ~c("word_chars").between(2 * n, 14 * n)),
        "variety": vote(c("n_distinct") * c("n_distinct") >= 2 * n, 100 * c("n_distinct") < 25 * F.least(n, F.lit(400))),
        "stutter": vote(100 * c("n_stutter") <= 5 * n, 100 * c("n_stutter") > 25 * n),
        "dup_lines": vote(100 * c("n_dup_lines") <= 10 * lines, 100 * c("n_dup_lines") > 40 * lines),
        "repeats": vote(100 * c("n_repeat_words") <= 10 * n, 100 * c("n_repeat_words") > 25 * n),
        "sentences": vote(100 * c("n_closed") >= 3 * n, (c("n_closed") == 0) & (n >= 30)),
    }


#: Which kind of bad text each rule is written against; where the estimates start.
KINDS = {"marks": ("symbols", "marked", "letters", "word_length"), "repetition": ("variety", "stutter", "dup_lines", "repeats")}

Model = tuple[dict[str, float], dict[str, dict[str, float]]]


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over (votes, count) of vote patterns, of which there are 3 ** len(names) at most.

    A document is good or of one of the ``KINDS`` of bad text.  Returns the share of
    each and, for each rule and class, how often the rule says bad where it votes at all.
    An abstention tells nothing.  Counts are smoothed.  Rules that fire together
    because they see the same fault do so within one class, so they are not taken for
    independent witnesses.  The start trusts votes, so "good" stays their side.
    """
    classes = ["good", *KINDS]
    share = {k: 0.9 if k == "good" else 0.1 / len(KINDS) for k in classes}
    says = {r: {k: 0.6 if r in KINDS.get(k, ()) else 0.05 for k in classes} for r in names}
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        mass = dict.fromkeys(classes, 0.0)
        bad = {r: dict.fromkeys(classes, 0.0) for r in names}
        voted = {r: dict.fromkeys(classes, 0.0) for r in names}
        for pattern, n in sorted(patterns):
            score = {k: math.log(share[k]) + sum(math.log(says[r][k] if v < 0 else 1 - says[r][k]) for r, v in zip(names, pattern) if v) for k in classes}
            most = max(score.values())
            whole = sum(math.exp(x - most) for x in score.values())
            for k, x in score.items():
                p = n * math.exp(x - most) / whole
                mass[k] += p
                for r, v in zip(names, pattern):
                    if v:
                        voted[r][k] += p
                        bad[r][k] += p * (v < 0)
        share = {k: (m + 1) / (total + len(classes)) for k, m in mass.items()}
        says = {r: {k: (bad[r][k] + SMOOTH) / (voted[r][k] + 2 * SMOOTH) for k in classes} for r in names}
    return share, says


def posterior(model: Model) -> Column:
    """Probability of good quality."""
    share, says = model
    scores = []
    for k in share:
        total = F.lit(math.log(share[k]))
        for r, by_class in says.items():
            total = total + F.when(F.col(r) < 0, F.lit(math.log(by_class[k]))).when(F.col(r) > 0, F.lit(math.log(1 - by_class[k]))).otherwise(F.lit(0.0))
        scores.append(total)
    return 1 / sum((F.exp(x - scores[0]) for x in scores[1:]), F.lit(1.0))


def _voted(docs: DataFrame, text: str, carry: tuple[str, ...], rounds: int, threshold: float) -> DataFrame:
    marked, _ = materialize(statistics(docs, text, carry).withColumn("base_failed", base_failed()), "quality")
    named = votes()
    voted = marked.withColumns(named)
    # what fails the base rule is out already and would only teach the estimates to know it again
    counted = voted.where("not base_failed").groupBy(*named).agg(F.count(F.lit(1)).alias("n"))
    model = fit([(tuple(r[k] for k in named), r["n"]) for r in counted.collect()], list(named), rounds)
    return voted.withColumn("quality", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(key, statistics, base_failed, votes, quality, kept) for every document."""
    return _voted(docs, text, (key,), rounds, threshold)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """The rows of documents that are kept, with all their columns; each row is judged by itself."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_whole"))
    good = _voted(packed, "_whole", ("_row",), rounds, threshold).where("kept")
    return good.select("_row.*")
