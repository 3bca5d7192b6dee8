"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other signs, hashed for a whole slice of texts
at once. A text's features are its words, its pairs of words and the triples of its tokens'
shapes (case, digits, signs, repeats of the token before), hashed to a table of fixed size; each
occurrence adds 1 / sqrt(n) for n occurrences in all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, labelled_sample, on_workers, slices, texts

BITS = 18
#: Text bytes hashed at once; the arrays of a slice take some sixty times as much.
HASHED_BYTES = 1 << 20
_U = np.uint64
_BYTES = np.arange(256)
#: 0: white space, 1: letters, digits and all of other scripts, 2: other signs.
KIND = np.full(256, 2, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[(_BYTES >= 128) | np.isin(_BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))] = 1
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
SMALL = (_BYTES >= 97) & (_BYTES <= 122)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
FOLDED = (np.where(UPPER, _BYTES + 32, _BYTES) + 1).astype(np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, at least n of them."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1 << 12), BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def _pieces(raw: bytes):
    """The runs of one kind of byte in raw, as arrays (start, size, hash, capitals, small letters, digits, whether the first is a capital, kind), a piece of HASHED_BYTES at a time."""
    for at in range(0, len(raw), HASHED_BYTES):
        b = np.frombuffer(raw, np.uint8, min(HASHED_BYTES, len(raw) - at), at)
        kind = KIND[b]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        sizes = np.diff(np.append(starts, len(b)))
        offset = np.arange(len(b)) - np.repeat(starts, sizes)
        h = np.add.reduceat(FOLDED[b] * _power(int(sizes.max()))[offset], starts)
        counts = [np.add.reduceat(t[b].astype(np.int64), starts) for t in (UPPER, SMALL, DIGIT)]
        yield [starts + at, sizes, h, *counts, UPPER[b[starts]], kind[starts]]


def _tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash of the folded bytes and shape of each token in raw. A token that pieces cut is put together again."""
    found: list[list[np.ndarray]] = []
    for piece in _pieces(raw):
        if found and found[-1][-1][-1] == piece[-1][0]:
            last = found[-1]
            shift = np.array([pow(BASE, int(last[1][-1]), 1 << 64)], np.uint64)
            last[2][-1:] += shift * piece[2][:1]
            for k in (1, 3, 4, 5):
                last[k][-1] += piece[k][0]
            piece = [x[1:] for x in piece]
        if len(piece[0]):
            found.append(piece)
    if not found:
        return np.empty(0, int), np.empty(0, np.uint64), np.empty(0, np.uint64)
    starts, sizes, h, upper, small, digit, capital, what = (np.concatenate(x) for x in zip(*found))
    shape = np.full(len(starts), 1, np.uint64)
    shape[(upper > 0) & (small == 0)] = 2
    shape[(upper == 1) & capital & ((small > 0) | (sizes == 1))] = 3
    shape[(upper > 1) & (small > 0)] = 4
    shape[digit > 0] = 5
    shape[digit == sizes] = 6
    shape[what == 2] = mix(h[what == 2]) | _U(8)
    keep = what > 0
    return starts[keep], mix(h[keep]), shape[keep]


def ngrams(found: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all n-gram occurrences of the texts, one text after another, and where each text's start."""
    raws = [t.encode() for t in found]
    starts, h, shape = _tokens(b"\n".join(raws))
    ends = np.cumsum([len(x) + 1 for x in raws])
    doc = np.searchsorted(ends, starts, "right")
    same = doc[1:] == doc[:-1]
    again = np.zeros(len(h), bool)
    again[1:] = same & (h[1:] == h[:-1])
    shape = shape * _U(2) + again.astype(np.uint64)
    pair = mix(h[:-1] * _U(3) + h[1:] * _U(7) + _U(1))[same]
    both = same[1:] & same[:-1]
    triple = mix(shape[:-2] * _U(0x9E3779B97F4A7C15) + shape[1:-1] * _U(0xC2B2AE3D27D4EB4F) + shape[2:] * _U(0x165667B19E3779F9))[both] if len(h) > 2 else h[:0]
    places = np.concatenate([h, pair, triple]) >> _U(64 - bits)
    owner = np.concatenate([doc, doc[1:][same], doc[2:][both] if len(h) > 2 else doc[:0]])
    order = np.argsort(owner, kind="stable")
    return places[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(found) + 1))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, 2**BITS
    bias: float

    def score(self, found: list[str]) -> np.ndarray:
        """Probability of label 1 for each text, from the sparse dot products of all texts at once."""
        places, at = ngrams(found)
        total = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=float)])
        n = np.maximum(1, np.diff(at))
        return 1 / (1 + np.exp(-np.clip(self.bias + (total[at[1:]] - total[at[:-1]]) / np.sqrt(n), -30, 30)))


class Ftrl:
    """Per-coordinate FTRL-proximal state; the last place is the bias, which no penalty holds."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _hashed(batches):
    for batch in batches:
        for part in slices(batch, "text", HASHED_BYTES):
            places, at = ngrams(texts(part))
            rows = [np.unique(places[a:b], return_counts=True) for a, b in zip(at, at[1:])]
            cols = [pa.array([x[k].astype("<i4").tobytes() for x in rows], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id", "label"), *cols], ["doc_id", "label", "places", "counts"])


def _train(batches, passes):
    rows = []
    for batch in batches:
        for places, counts, y in zip(*(c.to_pylist() for c in columns(batch, "places", "counts", "label"))):
            n = np.frombuffer(counts, "<i4")
            rows.append((np.frombuffer(places, "<i4"), (n / np.sqrt(max(1, n.sum()))).astype(np.float32), y))
    state = Ftrl()
    for k in range(passes):
        for i in np.random.default_rng(k).permutation(len(rows)):
            state.learn(rows[i][0], rows[i][1].astype(float), rows[i][2])
    w = state.weights(np.arange(len(state.z)))
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(w[some])], ["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0, most: int = 8_000, passes: int = 3) -> Model:
    """A model of labels(doc_id, label) from at most `most` labelled documents whose fold is not `held`.

    Texts are hashed where they lie. One task learns from the sparse rows of that bounded sample, each of
    2**BITS places at most, in a fixed order; the driver gets at most 2**BITS + 1 weights. Without
    labels every score is 0.5.
    """
    sample = labelled_sample(docs, labels, label, parts, held, most)
    hashed = sample.mapInArrow(on_workers(_hashed), f"doc_id {dict(sample.dtypes)['doc_id']}, label int, places binary, counts binary")
    ordered = hashed.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = ordered.mapInArrow(on_workers(_train, passes), "place int, weight double").toArrow()
    w = np.zeros((1 << BITS) + 1)
    w[found["place"].to_numpy()] = found["weight"].to_numpy()
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _score(batches, model):
    for batch in batches:
        for part in slices(batch, "text", HASHED_BYTES):
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id"), pa.array(model.score(texts(part)))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, of every row of docs(doc_id, text). Empty and null texts score by the bias."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(on_workers(_score, model), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def _keep(batches, model, least):
    for batch in batches:
        for part in slices(batch, "text", HASHED_BYTES):
            yield part.filter(pa.array(model.score(texts(part)) >= least))


def keep(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns."""
    return docs.mapInArrow(on_workers(_keep, model, least), docs.schema)
