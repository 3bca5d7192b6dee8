"""Language-model scoring: the marginal probability of a text over all segmentations into subwords.

The vocabulary and its first scores come from an existing tokenizer model. A word's lattice has
an arc for every piece that spells a part of it; forward recursion in log space sums over all
paths. Piece probabilities are re-estimated from expected counts over all training words, each
distinct word of the corpus once, weighted by how often it occurs.

Words never go to the driver, nor is a table of words broadcast. Texts are read once, in chunks
of bounded size that number their own words; only each chunk's distinct words are shuffled, to
meet the corpus' counts, and come back to the chunk as arrays.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fold, on_workers, slices, texts, written

#: Text bytes of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
WORDS_PER_TASK = 50_000
MARK = "▁"  # what the vocabulary's pieces have for the space before a word


@dataclass(frozen=True)
class Model:
    """Natural log probabilities of the pieces, of the 256 byte pieces, and of the end of a text."""

    pieces: dict[str, float]
    octets: tuple[float, ...]
    end: float

    def __post_init__(self):
        # None: no piece, but the start of one
        table: dict[str, float | None] = {p[:i]: None for p in self.pieces for i in range(1, len(p))}
        object.__setattr__(self, "table", table | self.pieces)

    def lattice(self, text: str) -> tuple[list[float], list[tuple[int, int, float, str]]]:
        """Log of the total probability of all segmentations of each beginning of text, and the arcs.

        An arc is start, end, log probability of all ways that end with it, and what it spells.
        A character that is no piece alone has an arc of its bytes' pieces.
        """
        n, table, exp, log1p, inf = len(text), self.table, math.exp, math.log1p, -math.inf
        alpha, arcs = [0.0] + [inf] * n, []
        for i in range(n):
            a, j = alpha[i], i + 1
            part = text[i]
            p = table.get(part, inf)
            if p is None or p == inf:
                y, x = a + sum(self.octets[b] for b in part.encode()), alpha[j]
                arcs.append((i, j, y, part))
                alpha[j] = y if x == inf else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
            while p != inf:
                if p is not None:
                    y, x = a + p, alpha[j]
                    arcs.append((i, j, y, part))
                    alpha[j] = y if x == inf else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
                j += 1
                if j > n:
                    break
                part = text[i:j]
                p = table.get(part, inf)
        return alpha, arcs

    def log_probability(self, word: str) -> float:
        return self.lattice(MARK + word)[0][-1]

    def expect(self, word: str, times: float, counts: dict[str, float], octets: np.ndarray) -> None:
        """Add to counts how often each piece is expected in the word's segmentations, times times.

        What passes through a node is shared among the arcs that end there by their probability,
        from the last node to the first.
        """
        alpha, arcs = self.lattice(MARK + word)
        flow, exp, pieces = [0.0] * (len(alpha) - 1) + [float(times)], math.exp, self.pieces
        for i, j, x, part in reversed(arcs):
            share = flow[j] * exp(x - alpha[j])
            flow[i] += share
            if part in pieces:
                counts[part] += share
            else:
                for b in part.encode():
                    octets[b] += share


def vocabulary(model_file: str) -> Model:
    """The model of a SentencePiece file's own scores.

    Scores of a unigram model are log probabilities. Scores of a BPE model are ranks below 0; they
    become the log probabilities of Zipf's law. Control and unknown pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    use = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    score = np.array([sp.get_score(i) for i in use])
    byte = np.array([sp.is_byte(i) for i in use])
    ranked = score[~byte].size and float(score.min()) <= -len(use) / 2  # scores of log probabilities don't go so low
    weight = -np.log(2.7 - score) if ranked else score.copy()
    weight[byte] = weight[~byte].min()
    weight -= np.log(np.exp(weight - weight.max()).sum()) + weight.max()
    pieces = {sp.id_to_piece(i): float(w) for i, w, b in zip(use, weight, byte) if not b}
    octets = [float(weight.min())] * 256
    for i, w, b in zip(use, weight, byte):
        if b:
            octets[int(sp.id_to_piece(i)[3:-1], 16)] = float(w)
    return Model(pieces, tuple(octets), math.log(1e-3))


def _chunks(batches, parts, held):
    part, number = TaskContext.get().partitionId(), 0
    ids: dict[bytes, int] = {}
    train = np.zeros(1 << 16, np.int64)
    rows, size = [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        chunk = part << 24 | number
        for at in range(0, len(rows), 2000):
            doc_id, held_out, n, local, counts = zip(*rows[at : at + 2000])
            yield _record(chunk, "text", len(n), doc_id=pa.array(doc_id, kind), held_out=held_out, n_words=n, locals=local, counts=counts)
        words = list(ids)
        for at in range(0, len(words), 100_000):
            some = words[at : at + 100_000]
            word = pa.array(some, pa.binary()).cast(pa.string())
            yield _record(chunk, "word", len(some), doc_id=pa.nulls(len(some), kind), word=word, local=np.arange(at, at + len(some), dtype=np.int32), train=train[at : at + len(some)])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for piece in slices(batch, "text"):
            for doc_id, text in zip(columns(piece, "doc_id")[0].to_pylist(), texts(piece)):
                raw = text.encode().lower()
                if rows and size + len(raw) > CHUNK_BYTES:
                    yield from emit()
                    number, size = number + 1, 0
                    ids.clear(), rows.clear(), train.fill(0)
                words = raw.split()
                new = [w for w in dict.fromkeys(words) if w not in ids]
                ids.update(zip(new, range(len(ids), len(ids) + len(new))))
                if len(ids) > len(train):
                    train = np.concatenate([train, np.zeros(max(len(train), len(ids) - len(train)), np.int64)])
                found, counts = np.unique(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), return_counts=True)
                held_out = fold(doc_id, parts) == held
                if not held_out:
                    train[found] += counts
                rows.append((doc_id, held_out, len(words), np.diff(found, prepend=0).astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
                size += len(raw)
    if rows:
        yield from emit()


_FIELDS = {"held_out": pa.bool_(), "n_words": pa.int64(), "locals": pa.binary(), "counts": pa.binary(), "word": pa.string(), "local": pa.int32(), "train": pa.int64()}


def _record(chunk: int, what: str, n: int, doc_id: pa.Array, **found) -> pa.RecordBatch:
    cols = [pa.array([chunk] * n, pa.int64()), pa.array([what] * n), doc_id]
    cols += [pa.nulls(n, k) if name not in found else found[name] if isinstance(found[name], pa.Array) else pa.array(found[name], k) for name, k in _FIELDS.items()]
    return pa.RecordBatch.from_arrays(cols, ["chunk", "what", "doc_id", *_FIELDS])


def _expect(batches, model):
    counts: dict[str, float] = defaultdict(float)
    octets = np.zeros(256)
    for batch in batches:
        for word, n in zip(*(c.to_pylist() for c in columns(batch, "word", "c"))):
            model.expect(word, n, counts, octets)
    keys = [*counts, *(f"<{b}>" for b in range(256))]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([False] * len(counts) + [True] * 256), pa.array([*counts.values(), *octets])], ["piece", "byte", "n"])


def _marginals(batches, model):
    for batch in batches:
        word, c = columns(batch, "word", "c")
        found = [model.log_probability(w) / math.log(10) for w in word.to_pylist()]
        yield pa.RecordBatch.from_arrays([word, c, pa.array(found, pa.float64())], ["word", "c", "log10_p"])


def re_estimate(model: Model, words: DataFrame, texts_seen: int, prior: float = 0.1) -> Model:
    """One round of expectation maximisation over words(word, c), c > 0, and texts_seen ends.

    Each piece also counts `prior` times as often as the model has it on average. The driver gets
    one number for each piece of the vocabulary.
    """
    found = words.mapInArrow(on_workers(_expect, model), "piece string, byte boolean, n double").groupBy("piece", "byte").agg(F.sum("n").alias("n")).collect()
    seen = {r["piece"]: r["n"] for r in found if not r["byte"]}
    octet = {int(r["piece"][1:-1]): r["n"] for r in found if r["byte"]}
    held = prior * (len(model.pieces) + 256)
    mass = {p: seen.get(p, 0.0) + held * math.exp(w) for p, w in model.pieces.items()}
    bytes_ = [octet.get(b, 0.0) + held * math.exp(w) for b, w in enumerate(model.octets)]
    ends = texts_seen + 1.0
    total = math.log(math.fsum(mass.values()) + math.fsum(bytes_) + ends)
    return Model({p: math.log(n) - total for p, n in mass.items()}, tuple(math.log(n) - total for n in bytes_), math.log(ends) - total)


def _scores(docs: pa.Table, words: pa.Table, totals: tuple, end: float, names: list[str]) -> pa.Table:
    n, v, ends = totals
    order = np.argsort(words["local"].to_numpy())
    c, p = words["c"].to_numpy()[order], words["log10_p"].to_numpy()[order]
    floor = math.log10(n + v + 1)
    base = np.log10(c + 1.0) - floor
    out = []
    for deltas, counts in zip(docs["locals"].to_pylist(), docs["counts"].to_pylist()):
        at, k = np.cumsum(np.frombuffer(deltas, "<u4").astype(np.int64)), np.frombuffer(counts, "<u4").astype(np.int64)
        known = int(k[c[at] > 0].sum()) + (ends > 0)
        out.append((known, float(base[at] @ k) + math.log10(ends + 1.0) - floor, float(p[at] @ k) + end / math.log(10)))
    known, base_score, score = zip(*out)
    cols = [docs["doc_id"], docs["held_out"], pa.array(docs["n_words"].to_numpy() + 1), pa.array(known, pa.int64()), pa.array([n] * len(out), pa.int64()), pa.array(base_score), pa.array(score)]
    return pa.table(cols, names=names)


def score(docs: DataFrame, model_file: str, parts: int = 7, held: int = 2, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Texts whose fold (crc32 of the id, modulo parts) is not `held` are learnt from. A text's
    tokens are its words, lower-cased in A to Z, and one end. base_score is the sum of log10 of
    add-one smoothed token frequencies; score is log10 of the probability of the text's pieces
    and end, summed over all segmentations of its words. An empty or null text is one end. With
    nothing to learn from, the vocabulary's own scores hold.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"chunk long, what string, doc_id {kind}, held_out boolean, n_words long, locals binary, counts binary, word string, local int, train long"
    chunks = written(rows.mapInArrow(on_workers(_chunks, parts, held), schema), "chunks")
    found = chunks.where("what = 'word'").select("chunk", "local", "word", "train")
    words = written(found.groupBy("word").agg(F.sum("train").alias("c")), "words")
    ends = chunks.where("what = 'text' and not held_out").count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count("*").alias("all")).first()
    totals = (total["n"] + ends, total["v"] + (ends > 0), ends)
    model = vocabulary(model_file)
    # few bytes, much work: as many tasks as the words need, not as their bytes do
    words = words.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, total["all"] // WORDS_PER_TASK))
    if ends:
        for _ in range(rounds):
            model = re_estimate(model, words.where("c > 0"), ends)
    marginals = words.mapInArrow(on_workers(_marginals, model), "word string, c long, log10_p double")
    by_chunk = found.join(marginals, "word").select(F.col("chunk").alias("owner"), "local", "c", "log10_p")
    names, end = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], model.end
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    text_rows = chunks.where("what = 'text'").select("chunk", "doc_id", "held_out", "n_words", "locals", "counts")
    return text_rows.groupBy("chunk").cogroup(by_chunk.groupBy("owner")).applyInArrow(_local(totals, end, names), schema)


def _local(totals, end, names):
    run = on_workers(_scores_of, totals, end, names)
    return lambda docs, words: next(run((docs, words)))


def _scores_of(pair, totals, end, names):
    yield _scores(*pair, totals, end, names)
