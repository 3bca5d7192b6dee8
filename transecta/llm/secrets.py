"""Secret scanning: fixed patterns, and guess costs of values that stand in a credential's place.

The guess cost of a value is the least number of guesses (as a power of ten) over all its
segmentations into dictionary words, dates, repeats, keyboard walks and brute-force characters,
found by dynamic programming over the end positions. Words, repeated units and walks may have any
length. Of a stretch of a thousand neighbouring keys or a thousand repeats not every pair of ends is
tried: costs grow with the logarithm of a span's length, so that of two starts the earlier one, once it is the
better, stays so, and the starts that can still win lie on a stack.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, on_workers, slices, texts

# Fixed values of the base scan.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # of a greedy class, runs of 16 or more are the matches that pass
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: A credential's name, in the corpus' languages. Letters may stand before it (dbPassword, user_token), none after.
NAME = re.compile(
    r"""(?ai:(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|bearer|passwort|kennwort|contrase(?:[ñÑ]|ñ?)a|clave[_\x20-](?:secreta|api|de[_\x20-]acceso)|mot[_\x20-]de[_\x20-]passe)(?![a-z]))"""
)
#: What assigns a value to a name: a sign, or the end of a tag; or words or white space only, where the name must be a word.
SIGN = re.compile(r"""["'`]?[\x20\t]*(?::=|=>|[:=])[\x20\t]*""")
SAID = re.compile(r"""[\x20\t]+(?:(?:is|was|est|ist|lautet|es)[\x20\t]+)?""")
#: Values: to the closing quote of the line, to the end of a tag, or to white space or a sign that ends values.
QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\[^\n])*+){q}") for q in "\"'`"}
TAGGED = re.compile(r"([^<>\n]+)</")
BARE = re.compile(r"""["'`]?([^\s"'`<>,;]+)""")
#: One of these is in every text that NAME matches.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "kennwort", "contrase", "clave")
COMMON = (
    "password passwd letmein welcome admin login qwerty monkey dragon master shadow sunshine princess football baseball "
    "superman batman trustno1 iloveyou hello freedom whatever secret abc123 changeme default guest root test user example "
    "sample placeholder none null true false summer winter spring autumn monday friday love"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {a: (x, y) for y, row in enumerate(ROWS) for x, a in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
PLAIN = str.maketrans("0134578@$!", "oieastbasi")
DATE_SIZES = (4, 6, 7, 8, 9, 10)
#: Values up to this length are searched for repeats period by period.
SHORT = 64


class Words(dict):
    """Words and log10 of their ranks, with the lengths that occur."""

    def __init__(self, found: dict[str, float]):
        super().__init__(found)
        self.sizes = sorted({len(w) for w in found if w})


_words: dict[str | None, Words] = {}


def dictionary(path: str | None = None) -> Words:
    """log10 of the rank of each word: the common passwords, then the whole words of a tokenizer's vocabulary file."""
    if path not in _words:
        ranked = list(COMMON)
        if path:
            with open(path, encoding="utf-8") as f:
                vocabulary = json.load(f)["model"]["vocab"]
            ranked += [w[:-4] for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>") and len(w) > 6 and w[:-4].isalpha()]
        found: dict[str, float] = {}
        for i, w in enumerate(ranked):
            found.setdefault(w, math.log10(i + 2))
        _words[path] = Words(found)
    return _words[path]


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


class Starts:
    """The starts i of which a[i] + log10(end - i) is the least for some end to come, the latest on top."""

    __slots__ = ("found",)

    def __init__(self):
        self.found: list[tuple[float, int]] = []

    @staticmethod
    def _from(old: tuple[float, int], new: tuple[float, int]) -> float:
        """The end from which the older start is the better one."""
        more = new[0] - old[0]
        if more <= 0:
            return math.inf
        if more > 300:
            return new[1]
        r = 10.0**more
        return (r * new[1] - old[1]) / (r - 1) if r > 1 else math.inf

    def least(self, end: int, a: float, i: int) -> tuple[float, int]:
        """Add the start i and find the least for this end; ends must grow, and starts."""
        found = self.found
        while len(found) > 1 and found[-2][0] + math.log10(end - found[-2][1]) <= found[-1][0] + math.log10(end - found[-1][1]):
            found.pop()
        new = (a, i)
        if not found or a + math.log10(end - i) < found[-1][0] + math.log10(end - found[-1][1]):
            while len(found) > 1 and self._from(found[-1], new) >= self._from(found[-2], found[-1]):
                found.pop()
            found.append(new)
        a, i = found[-1]
        return a + math.log10(end - i), i


class Stretch:
    """Part of a value of which all spans of `least` characters or more, by whole steps, cost the logarithm of their length and something constant."""

    __slots__ = ("kind", "start", "end", "step", "least", "cost", "turns", "starts")

    def __init__(self, kind: str, start: int, end: int, step: int, least: int, cost: float, turns: list[float] | None = None):
        self.kind, self.start, self.end, self.step, self.least, self.cost, self.turns = kind, start, end, step, least, cost, turns
        self.starts: dict[int, Starts] = {}

    def best(self, end: int, best: list[float]) -> tuple[float, int]:
        i = end - self.least
        found = self.starts.setdefault((i - self.start) % self.step, Starts())
        if self.turns is None:
            cost, i = found.least(end, best[i], i)
            return cost + self.cost, i
        cost, i = found.least(end, best[i] - self.turns[i - self.start], i)
        return cost + self.cost + self.turns[end - 2 - self.start], i


def walks(low: str) -> list[Stretch]:
    """Stretches of neighbouring keys, whose turns cost, and along the alphabet or digits."""
    found, n = [], len(low)
    i = 0
    while i < n - 2:
        steps, j = [], i
        while j + 1 < n and (a := PLACE.get(low[j])) and (b := PLACE.get(low[j + 1])):
            step = (b[0] - a[0], b[1] - a[1])
            if step == (0, 0) or max(map(abs, step)) > 1:
                break
            steps.append(step)
            j += 1
        if len(steps) >= 2:
            turns = [0.0]
            for a, b in zip(steps, steps[1:]):
                turns.append(turns[-1] + (a != b) * math.log10(4))
            found.append(Stretch("walk", i, j + 1, 1, 3, math.log10(len(PLACE)), turns))
        i = max(i + 1, j)
    i = 0
    while i < n - 2:
        j, step = i + 1, ord(low[i + 1]) - ord(low[i])
        while step in (1, -1) and j < n and low[j].isalnum() and low[j - 1].isalnum() and ord(low[j]) - ord(low[j - 1]) == step:
            j += 1
        if j - i >= 3:
            found.append(Stretch("walk", i, j, 1, 3, math.log10(36)))
        i = max(i + 1, j - 1)
    return found


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the suffixes in their order, and for k = 0, 1, ... equal numbers where 2**k characters are equal."""
    rank = np.unique(codes, return_inverse=True)[1] + 1
    levels, k, n = [], 1, len(codes)
    while True:
        levels.append(rank.astype(np.int32))
        if rank.max() == n:
            return rank, levels
        rank = np.unique(rank * (n + 1) + np.append(rank[k:], np.zeros(min(k, n), np.int64)), return_inverse=True)[1] + 1
        k *= 2


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters from a and from b on are equal, a and b being different."""
    size = np.zeros(len(a), np.int64)
    n = len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + size, b + size
        inside = np.maximum(x, y) < n
        same = inside.copy()
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        size[same] += 1 << k
    return size


def repeats(low: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches of two periods or more, of their least period, as long as they go.

    In a long value their periods are the longest Lyndon words from each position on, in the order of
    the characters or its reverse.
    """
    n = len(low)
    if n <= SHORT:
        found = {}
        for p in range(1, n // 2 + 1):
            i = 0
            while i + p < n:
                j = i
                while j + p < n and low[j] == low[j + p]:
                    j += 1
                if j - i >= p:
                    found.setdefault((i, j + p), p)
                i = j + 1
        return [(i, j, p) for (i, j), p in found.items() if not any(p % q == 0 and a <= i and j <= b for (a, b), q in found.items() if q < p)]
    codes = np.array([ord(c) for c in low], np.int64)
    forward, levels = _ranks(codes)
    _, back = _ranks(codes[::-1])
    found = set()
    for rank in (forward, _ranks(-codes)[0]):
        order, stack, following = rank.tolist(), [], [n] * n
        for i, r in enumerate(order):
            while stack and order[stack[-1]] > r:
                following[stack.pop()] = i
            stack.append(i)
        i, j = np.arange(n), np.array(following)
        p = j - i
        at = j < n
        ahead, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ahead[at] = _common(levels, i[at], j[at])
        at = i > 0
        behind[at] = _common(back, n - i[at], n - j[at])
        start, end = i - behind, j + ahead
        some = end - start >= 2 * p
        found.update(zip(start[some].tolist(), end[some].tolist(), p[some].tolist()))
    return sorted(found)


def guess_cost(value: str, words: dict[str, float]) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that the cheapest segmentation takes, and that segmentation as (kind, start, end).

    A character costs its class's size; a word its rank, times one and twice the characters that
    are capitals or stand for letters; a date its kind's number; a walk over neighbouring keys their
    number times its length, and four for each turn; one along the alphabet or digits 36 times its length; a
    repeat its unit, by characters or as a word, times how often it stands there. Ties go to the
    span that is found first. An empty value costs nothing.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(PLAIN)
    sizes = words.sizes if isinstance(words, Words) else sorted({len(w) for w in words if w})
    capitals, signs, brute = [0], [0], [0.0]
    for a, b, c in zip(value, low, plain):
        capitals.append(capitals[-1] + (a != b))
        signs.append(signs[-1] + (b != c))
        brute.append(brute[-1] + _brute(b))
    best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    opens: dict[int, list[Stretch]] = {}
    for x in walks(low):
        opens.setdefault(x.start + x.least, []).append(x)
    for i, j, p in repeats(low):
        opens.setdefault(i + 2 * p, []).append(Stretch("repeat", i, j, p, 2 * p, brute[i + p] - brute[i] - math.log10(p)))
    chains: dict[tuple[int, int], Starts] = {}  # of the same word again and again, by where it would go on

    def offer(start: int, end: int, cost: float, kind: str) -> None:
        if cost < best[end] - 1e-12:
            best[end], back[end] = cost, (kind, start)

    active: list[Stretch] = []
    for i in range(n + 1):
        if i in opens or active:
            active = [x for x in active if x.end >= i] + opens.pop(i, [])
            for x in active:
                cost, start = x.best(i, best)
                offer(start, i, cost, x.kind)
        if i == n:
            break
        here = best[i]
        offer(i, i + 1, here + _brute(value[i]), "brute")
        for size in sizes:
            j = i + size
            if j > n:
                break
            piece = low[i:j]
            rank, changed = words.get(piece), capitals[j] - capitals[i]
            if rank is not None:
                offer(i, j, here + rank + math.log10(1 + 2 * changed), "word")
                chain = chains.pop((i, size), None)
                if chain is not None and low[i - size : i] == piece:
                    cost, start = chain.least(j, best[i - size], i - size)
                    offer(start, j, cost - math.log10(size) + rank, "repeat")
                else:
                    chain = Starts()
                chains[j, size] = chain
            if signs[j] > signs[i] and (rank := words.get(plain[i:j])) is not None:
                offer(i, j, here + rank + math.log10(1 + 2 * (changed + signs[j] - signs[i])), "word")
        if value[i].isdigit():
            for size in DATE_SIZES:
                if i + size <= n and DATE.fullmatch(value, i, i + size):
                    offer(i, i + size, here + math.log10(200 if size == 4 else 36_500), "date")
    spans, end = [], n
    while end:
        kind, start = back[end]
        spans.append((kind, start, end))
        end = start
    return best[n], spans[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, by start, then kind."""
    low = text.lower()
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    return sorted(found)


def _value(text: str, name: re.Match) -> tuple[int, int, bool] | None:
    """Where the value of a credential's name starts and ends, and whether a sign assigns it; nothing if there is none."""
    at, tag = name.end(), text[name.end() : name.end() + 1] == ">"
    if tag:
        found = TAGGED.match(text, at + 1)
        return (*found.span(1), True) if found else None
    sign = SIGN.match(text, at)
    start = sign or SAID.match(text, at)
    if not start:
        return None
    quote = QUOTED.get(text[start.end() : start.end() + 1])
    found = quote and quote.match(text, start.end())
    if found:
        return (*found.span(1), bool(sign))
    found = BARE.match(text, start.end())
    return (found.start(1), found.start(1) + len(found[1].rstrip(".!?)]}:")), bool(sign)) if found else None


def guess_spans(text: str, base: list[tuple[int, int, int]], words: dict[str, float], least: float) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, cost) of values in a credential's place that cost at least 10**least guesses and don't lie wholly inside a base span.

    A value in quotes goes to the closing quote of its line, spaces and commas included. A value that no sign
    assigns ("the password is x") must also mix letters with digits or signs, as prose has words there, and its name
    must be a word of its own. A name inside a value is no name. No value has a least length: at 1.52 for a sign,
    five signs don't reach 8.
    """
    low = text.lower()
    if not any(x in low for x in HINTS):
        return []
    starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for *_, e in base), max))
    found, end = [], 0
    for name in NAME.finditer(text):
        place = _value(text, name) if name.start() >= end else None
        if not place or place[0] == place[1]:
            continue
        start, stop, assigned = place
        value = text[start:stop]
        body = value.strip(".,!?()[]{}*#$%&|-_=+:/~")
        if not assigned and (text[name.start() - 1 : name.start()].isalpha() or not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body))):
            continue
        end = stop
        k = bisect.bisect_right(starts, start) - 1
        if k >= 0 and reach[k] >= stop:
            continue
        cost, _ = guess_cost(value, words)
        if cost >= least:
            found.append((start, 3, stop, cost))
    return found


def scan_text(text: str, words: dict[str, float], least: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    base = base_spans(text)
    return base, guess_spans(text, base, words, least)


def _scan(batches, words_path, least):
    words = dictionary(words_path)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for text in texts(part):
                base, more = scan_text(text, words, least)
                rows = sorted([(s, k, e, None) for s, k, e in base] + more, key=lambda x: x[:2])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": c} for s, k, e, c in rows])
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id"), pa.array(out, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame, words_path: str | None = None, least: float = 8.0) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, log10_guesses>> of every row of docs(doc_id, text).

    Positions are code points, ends exclusive, in order of start, then kind. Kinds assign, access
    and hex are the fixed patterns; kind guess is a value in a credential's place whose guess
    cost is at least 10**least. Null and empty texts have no spans. Whole texts are scanned.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind string, start bigint, end bigint, log10_guesses double>>"
    return rows.mapInArrow(on_workers(_scan, words_path, least), schema)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts by kind and the joined spans of what scan() returns."""
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"),
    )


def _redact(batches, words_path, least, mark, length_column):
    words = dictionary(words_path)
    for batch in batches:
        for part in slices(batch, "text"):
            at = part.schema.get_field_index("text")
            out = []
            for text in part.column(at).to_pylist():
                if text:
                    base, more = scan_text(text, words, least)
                    pieces, end = [], 0
                    for s, _, e, *_ in sorted([*base, *more]):
                        if s >= end:
                            pieces += [text[end:s], mark]
                        end = max(end, e)
                    text = "".join([*pieces, text[end:]])
                out.append(text)
            new = pa.array(out, part.schema.field(at).type)
            cols = [new if i == at else c for i, c in enumerate(part.columns)]
            if length_column and (k := part.schema.get_field_index(length_column)) >= 0:
                # only where the text has changed: other rows keep what they came with
                changed = pc.fill_null(pc.not_equal(part.column(at), new), False)
                cols[k] = pc.if_else(changed, pc.utf8_length(new).cast(cols[k].type), cols[k])
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)


def redact(docs: DataFrame, words_path: str | None = None, least: float = 8.0, mark: str = "[SECRET]", length_column: str | None = "n_chars") -> DataFrame:
    """docs with every span that scan() finds replaced by mark, overlapping spans by one.

    Rows and other columns stay; length_column, where there is one, follows a text that changed.
    """
    return docs.mapInArrow(on_workers(_redact, words_path, least, mark, length_column), docs.schema)
