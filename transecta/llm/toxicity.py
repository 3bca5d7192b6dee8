"""Toxicity: Levenshtein automata on a lexicon trie, weighed by the context of each hit.

The lexicon is learnt from labelled documents: words, and stems of words, much more frequent in
toxic ones. The Levenshtein automata of all terms run together as one automaton over the trie of
the lexicon: a state holds the trie's nodes that a word's beginning can stand for, each with its
least number of edits. States are built as words ask for them and kept, so that a word costs a
look-up a character. Stems match the starts of words. Each hit counts by its term's weight, by
its edits and by a window of words around it: quotation marks and verbs of reporting lower it,
words of direct address raise it. A logistic regression on the document's sums gives the score.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, labelled_sample, on_workers, slices, texts, written

#: Word characters; inside a word, signs that stand for letters.
WORD = re.compile(r"\w(?:[\w@$!*'’-]*\w)?")
EDGES = ".,;:!?()[]{}\"'#*$%&|-“”„«»"
TOKEN = re.compile(r"\S+")
WINDOW = 6
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes term word slur insult mot wort palabra sagte dit dijo".split())
ADDRESS = frozenset("you your you're youre ur du dich dir dein ihr tu te toi vous ton usted tú ti eres".split())
QUOTES = frozenset("\"“”„«»‹›")
#: Lengths from which one and two edits are allowed.
ONE_EDIT, TWO_EDITS = 5, 9
#: Tokens that a worker remembers to be free of hits.
CACHE_WORDS = 400_000
#: States of the automaton that a worker keeps.
STATES = 50_000
STEM = "*"
#: A term is a word of LEAST_LETTERS letters or more, or a stem of STEM_SIZES letters.
LEAST_LETTERS = 3
STEM_SIZES = range(4, 11)
FEATURES = 6


def edits_for(size: int) -> int:
    return 2 if size >= TWO_EDITS else 1 if size >= ONE_EDIT else 0


class Trie:
    """A lexicon's trie and the automaton over it that reads words with edits.

    Terms that end in STEM are stems, which match as they stand. All other terms are matched with
    edits, as many as edits_for() allows a term.
    """

    def __init__(self, lexicon: list[str]):
        self.exact = {t: i for i, t in enumerate(lexicon) if not t.endswith(STEM)}
        self.stems = {t[:-1]: i for i, t in enumerate(lexicon) if t.endswith(STEM)}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        self.children: list[dict[str, int]] = [{}]
        self.term, self.most = [-1], [0]  # of a node: its term, and the edits that any term below it allows
        for t in self.exact:
            node, k = 0, edits_for(len(t))
            self.most[0] = max(self.most[0], k)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.term[node] = self.exact[t]
        self.allowed = [edits_for(len(t.removesuffix(STEM))) for t in lexicon]
        self.forget()

    def forget(self) -> None:
        """Drop all states; the dead one is 0, the first one 1."""
        self.states: list[bytes] = []  # a node and its edits in four bytes: four times the node plus the edits
        self.numbers: dict[bytes, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self._number({})
        self.first = self._number({0: 0} if len(self.children) > 1 else {})

    def _number(self, nodes: dict[int, int]) -> int:
        """The number of the state of these nodes and all that skipping letters of terms leads to from them."""
        found, todo = {}, sorted(nodes.items())
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or found.get(node, 9) <= e:
                continue
            found[node] = e
            todo.extend((child, e + 1) for child in self.children[node].values())
        key = array("I", sorted(4 * node + e for node, e in found.items())).tobytes()
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, self.term[node]) for node, e in found.items() if self.term[node] >= 0 and e <= self.allowed[self.term[node]]]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for code in array("I", self.states[state]):
            node, e = divmod(code, 4)
            nodes[node] = min(nodes.get(node, 9), e + 1)  # the word has a letter more
            for d, child in self.children[node].items():
                nodes[child] = min(nodes.get(child, 9), e + (c != d))
        self.steps[state][c] = found = self._number(nodes)
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """Number and edits of the term that stands for word: itself, else the nearest, else the longest stem."""
        if (i := self.exact.get(word)) is not None:
            return i, 0
        if found := self.nearest(word):
            return found
        for size in self.stem_sizes:
            if size < len(word) and (i := self.stems.get(word[:size])) is not None:
                return i, 0
        return None

    def nearest(self, word: str) -> tuple[int, int] | None:
        """Number and edits of the term with the fewest edits from word; ties go to the first term."""
        if len(self.states) > STATES:
            self.forget()
        state, steps = self.first, self.steps
        for c in word:
            following = steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if not state:
                return None
        return self.accepts[state]


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    weights: tuple[float, ...]  # of the terms
    coefficients: tuple[float, ...] = (0.0,) * FEATURES
    bias: float = 0.0
    background: tuple[float, float] = (0.0, 0.0)  # exact and misspelled hits' sums for each token of other documents

    def design(self, x: np.ndarray) -> np.ndarray:
        """Features from a document's sums: hits beyond twice what so long a clean document has by chance."""
        exact, fuzzy, context, best, terms, tokens = x.T
        chance = 2 * np.outer(tokens, self.background)
        left = np.maximum(0, np.stack([exact, fuzzy], 1) - chance)
        rest = np.maximum(0, context - chance.sum(1))
        return np.stack([np.log1p(left[:, 0]), np.log1p(left[:, 1]), np.log1p(rest), best * (rest > 0), np.minimum(terms, 4) * (rest > 0), rest / np.sqrt(np.maximum(1, tokens))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.design(x) @ np.array(self.coefficients), -30, 30)))


class Matcher:
    """The trie of a model's lexicon with the tokens that a worker has seen, each looked up once.

    Tokens stand between white space; the words in a token are matched one by one.
    """

    def __init__(self, model: Model):
        self.weights, self.trie = model.weights, Trie(list(model.terms))
        self.clean: set[str] = set()
        self.hits: dict[str, list[tuple[int, int, float]]] = {}

    def look_up(self, tokens: set[str]) -> None:
        if len(self.clean) > CACHE_WORDS:
            self.clean.clear()
        for token in tokens - self.clean:
            if token not in self.hits:
                word = token.strip(EDGES)
                words = (word,) if word.isalnum() else WORD.findall(token)
                found = [(m[0], m[1], self.weights[m[0]] * 0.6 ** m[1]) for w in words if (m := self.trie.match(w))]
                if found:
                    self.hits[token] = found
                else:
                    self.clean.add(token)

    def features(self, text: str) -> list[float]:
        """Sums over the hits of a text: exact, misspelled, both, the greatest, how many terms; and the text's tokens."""
        low = text.lower()
        tokens = low.split()
        distinct = set(tokens)
        self.look_up(distinct)
        if distinct.isdisjoint(self.hits):
            return [0.0] * (FEATURES - 1) + [float(len(tokens))]
        exact = fuzzy = context = best = 0.0
        terms = set()
        for i, m in enumerate(TOKEN.finditer(low)):
            for term, edits, weight in self.hits.get(m[0], ()):
                value = weight * self.context(low, m.start(), m.end(), tokens, i)
                exact += (edits == 0) * value
                fuzzy += (edits > 0) * value
                context += value
                best = max(best, value)
                terms.add(term)
        return [exact, fuzzy, context, best, float(len(terms)), float(len(tokens))]

    @staticmethod
    def context(text: str, start: int, end: int, words: list[str], i: int) -> float:
        """1 for a plain hit, less in a quotation, more where somebody is addressed."""
        around = [w.strip(".,;:!?\"'“”«»()") for w in words[max(0, i - WINDOW) : i + WINDOW + 1]]
        if m := WORD.search(text, start, end):  # quotation marks can stand in the token itself
            start, end = m.span()
        before, after = text[max(0, start - 40) : start], text[end : end + 40]
        quoted = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
        factor = 0.3 if quoted else 1.0
        if any(w in REPORTING for w in around):
            factor *= 0.6
        return factor * (1.5 if not quoted and any(w in ADDRESS for w in around) else 1.0)


_matchers: dict[Model, Matcher] = {}


def matcher(model: Model) -> Matcher:
    if model not in _matchers:
        _matchers.clear()
        _matchers[model] = Matcher(model)
    return _matchers[model]


def forget() -> None:
    _matchers.clear()


def _distinct(text: str) -> set[str]:
    return {w for w in WORD.findall(text.lower()) if len(w) >= LEAST_LETTERS and not w.isdigit()}


def _mark(text: str) -> int:
    """The least hash of the text's triples of tokens, which near copies mostly have in common."""
    tokens = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(tokens[i : i + 3])) for i in range(max(1, len(tokens) - 2))), default=0) >> 1


def _words(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            found = texts(part)
            words = [sorted(_distinct(t)) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array([_mark(t) for t in found], pa.int64())], ["words", "mark"])


def _counts(batches, candidates):
    found: Counter[str] = Counter()
    for batch in batches:
        for part in slices(batch, "text"):
            for text in texts(part):
                words = _distinct(text)
                found.update(words & candidates)
                found.update({w[:n] + STEM for w in words for n in STEM_SIZES if n < len(w)} & candidates)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])


def likelihood_ratio(a: float, b: float, toxic: float, other: float) -> float:
    """Twice the log likelihood ratio of a term in a of `toxic` and b of `other` documents against equal shares."""
    share = toxic / (toxic + other)
    return 2 * sum(n * math.log(n / ((a + b) * p)) for n, p in ((a, share), (b, 1 - share)) if n)


def lexicon(sample: DataFrame, least: int = 3, ratio: float = 11.0, odds: float = 1.5) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """Terms, best first, and their weights in (0, 1), from sample(doc_id, text, label).

    Candidates are the words and stems that at least `least` toxic documents share, near copies
    (equal mark) counted once by their least words; a stem also needs `least` words. Kept are all those whose
    likelihood ratio and log odds reach the limits, a stem's longer stems left out. The driver
    holds the candidates and their counts, which the bound of the sample bounds.
    """
    documents = written(sample.where("label = 1").mapInArrow(on_workers(_words), "words array<string>, mark long").groupBy("mark").agg(F.min("words").alias("words")), "toxic")
    word = documents.select("mark", F.explode("words").alias("word"))
    sizes = F.filter(F.array(*(F.lit(k) for k in STEM_SIZES)), lambda k: k < F.char_length("word"))
    stem = word.select("mark", "word", F.explode(F.transform(sizes, lambda k: F.concat(F.substr("word", F.lit(1), k), F.lit(STEM)))).alias("term"))
    shared = stem.select("term", "word").distinct().groupBy("term").count().where(F.col("count") >= least).select("term")
    terms = word.select("mark", F.col("word").alias("term")).union(stem.join(shared, "term").select("mark", "term").distinct())
    by_term = {r["term"]: r["n"] for r in terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    candidates = set(by_term)
    other = sample.where("label = 0")
    counts = other.mapInArrow(on_workers(_counts, candidates), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    against = {r["term"]: r["n"] for r in counts.collect()} if candidates else {}
    n, m = documents.count(), max(1, other.count())
    found = []
    for t in candidates:
        a, b = by_term[t], against.get(t, 0)
        w = math.log((a + 0.5) * (m + 1) / ((b + 0.5) * (n + 1)))
        g = likelihood_ratio(a, b, n, m)
        if w >= odds and g >= ratio:
            found.append((t, min(1.0, w / 5) * g / (g + 20), g))
    found.sort(key=lambda x: (-x[2], x[0]))
    kept: dict[str, float] = {}
    for t, weight, _ in found:
        if not (t.endswith(STEM) and any(t[:k] + STEM in kept for k in STEM_SIZES if k < len(t) - 1)):
            kept[t] = weight
    return tuple(kept), tuple(kept.values())


def _features(batches, model):
    m = matcher(model)
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [m.features(t) for t in texts(part)]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id", "label"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def regression(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by damped Newton steps, fitted again without features whose coefficient is negative."""
    use = np.arange(x.shape[1])
    while True:
        z, w = np.hstack([x[:, use], np.ones((len(x), 1))]), np.zeros(len(use) + 1)
        hold = np.append(np.full(len(use), penalty), 1e-6)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-9)
            step = np.linalg.solve(h, z.T @ (p - y) + hold * w)
            w = w - step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1])
            out[use] = w[:-1]
            return out, float(w[-1])
        use = use[w[:-1] > w[:-1].min()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, most: int = 10_000) -> Model:
    """A model of labels(doc_id, label) from at most `most` labelled documents whose fold is not `held`.

    The driver gets the lexicon and FEATURES numbers for each of those documents. Without toxic
    labels the lexicon is empty and every score is the share of label 1, or 0 without labels.
    """
    sample = written(labelled_sample(docs, labels, label, parts, held, most), "labelled")
    model = Model(*lexicon(sample))
    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(on_workers(_features, model), f"doc_id {kind}, label int, x array<double>").toArrow()
    if not rows.num_rows:
        return Model((), (), bias=-30.0)
    x, y = np.array(rows["x"].to_pylist(), float).reshape(-1, FEATURES), rows["label"].to_numpy().astype(float)
    clean = x[y == 0].sum(0) if (y == 0).any() else np.zeros(FEATURES)
    background = tuple((clean[:2] / max(1.0, clean[-1])).tolist())
    model = Model(model.terms, model.weights, background=background)
    coefficients, bias = regression(model.design(x), y)
    return Model(model.terms, model.weights, tuple(coefficients.tolist()), bias, background)


def _score(batches, model):
    m = matcher(model)
    for batch in batches:
        for part in slices(batch, "text"):
            x = np.array([m.features(t) for t in texts(part)], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id"), pa.array(model.score(x))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text). A text without hits, or none, scores by the bias alone."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(on_workers(_score, model), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def _keep(batches, model, limit):
    m = matcher(model)
    for batch in batches:
        for part in slices(batch, "text"):
            x = np.array([m.features(t) for t in texts(part)], float).reshape(-1, FEATURES)
            yield part.filter(pa.array(model.score(x) < limit))


def keep(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows of docs that score below limit, with all their columns."""
    return docs.mapInArrow(on_workers(_keep, model, limit), docs.schema)
