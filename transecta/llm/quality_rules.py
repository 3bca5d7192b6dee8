"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import columns, labelled_sample, on_workers, slices, texts

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UPPER, LOWER, DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))

#: Each feature of the trees and the direction in which the score may move as it rises (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "duplicate_line_share": -1,
    "repeated_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "bars_per_word": -1,
    "exclamations_per_word": -1,
    "distinct_word_share": 0,
    "longest_run_share": -1,
    "words_per_line": 0,
    "stops_per_word": 0,
}


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    total = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of a text; every ratio of an empty text is 0."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    if len(set(lines)) < len(lines):
        again = Counter(lines)
        duplicates = sum(k - 1 for line, k in again.items() if k > 1 and line.encode().split())
    else:
        duplicates = 0
    repeated = repeat_words(words)
    runs = longest = 1
    if n > 1 and repeated:
        for a, b in zip(words, words[1:]):
            runs = runs + 1 if a == b else 1
            longest = max(longest, runs)
    some, letters = max(1, n), max(1, len(raw))
    upper = len(raw) - len(raw.translate(None, UPPER))
    lower = len(raw) - len(raw.translate(None, LOWER))
    features = (
        math.log1p(n),
        chars / some,
        symbols / some,
        duplicates / len(lines),
        repeated / some,
        upper / max(1, upper + lower),
        (len(raw) - len(raw.translate(None, DIGIT))) / letters,
        text.count("|") / some,
        text.count("!") / some,
        len(set(words)) / some,
        (longest - 1) / some,
        n / len(lines),
        text.count(".") / some,
    )
    return (n, chars, symbols, duplicates, repeated), features


def fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def _features(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [list(statistics(t)[1]) for t in texts(part)]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id", "label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, **options) -> Forest:
    """Trees that predict labels(doc_id, quality) from document statistics, on at most `most` labelled rows.

    The driver gets one row of len(FEATURES) numbers for each of them. Without labels the trees
    keep every document.
    """
    sample = labelled_sample(docs, labels, "quality", 1, -1, most)
    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(on_workers(_features), f"doc_id {kind}, label int, x array<double>").toArrow()
    order = pc.sort_indices(rows["doc_id"]).to_numpy()  # one row for each id
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit(x, rows["label"].to_numpy()[order].astype(float), list(FEATURES.values()), **options)


def _judge(batches, forest, least):
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [statistics(t) for t in texts(part)]
            counts = np.array([r[0] for r in rows], np.int64)
            p = forest.probability(np.array([r[1] for r in rows]))
            failed = fails(counts[:, 0], counts[:, 4])
            cols = [*(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p)]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id"), *cols], ["doc_id", *COUNTS, "base_failed", "kept", "score"])


def judge(docs: DataFrame, forest: Forest, least: float = 0.3) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and score (the trees' probability of good quality) of every row of docs(doc_id, text).

    Words are runs of bytes other than space and \\t to \\r. A null or empty text has no words and
    fails the base rules. kept is base rules passed and score at least `least`.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(on_workers(_judge, forest, least), schema)
