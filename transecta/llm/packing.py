"""Sequence packing: shortest pack first over the histogram of piece lengths.

Documents become token ids, are cut into full sequences and a rest, and only the histogram of
the pieces' lengths (one count for each length up to the sequence length) reaches the driver.
There lengths are placed longest first, each into the shortest open pack that it fits, whole
runs of equal packs at once, which gives patterns with counts. The patterns go back to the
pieces by the rank of a piece among those of its length. Packs that stay open, as where most pieces have
one length, are laid end to end, and the piece at a sequence's end is cut there.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import columns, on_workers, slices, written

#: Text bytes whose distinct units are encoded together.
SLICE = 4 << 20
#: Units that the tokenizer gets as one text, and texts at a time.
LINE, LINES = 512, 16
#: Signs that often end a word.
SIGNS = ".,;:!?#$%&*)"
#: Units with more of them than this at the end are encoded whole.
MOST_SIGNS = 8
#: Spaces that stand alone between two other signs.
ALONE = re.compile(r"(?<=\S) (?=\S)")

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core

#: A pack with no more room than this part of a sequence is full.
SLACK = 1 / 256

_tokenizers: dict[str, tuple[Tokenizer, np.ndarray, list[str]]] = {}


def tokenizer(path: str) -> tuple[Tokenizer, np.ndarray, list[str]]:
    """The tokenizer, of each id whether its token starts with a space, and the special tokens, which texts can spell."""
    if path not in _tokenizers:
        found = Tokenizer.from_file(path)
        spaced = np.zeros(found.get_vocab_size(), bool)
        spaced[[i for token, i in found.get_vocab().items() if token.startswith("Ġ")]] = True
        _tokenizers[path] = found, spaced, [x.content for x in found.get_added_tokens_decoder().values()]
    return _tokenizers[path]


def _alone(path: str, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts that are encoded one by one, and how many each has."""
    encode = tokenizer(path)[0].encode_batch_fast
    out = [np.array(e.ids, "<u4") for at in range(0, len(found), LINE) for e in encode(found[at : at + LINE], add_special_tokens=False)]
    return np.concatenate([np.zeros(0, "<u4"), *out]), np.array([len(x) for x in out], np.int64)


def _spaced(path: str, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units that each follow a space and have none, nor other white space at an end, and how many each has.

    The tokenizer gets many units as one text. A match of its pattern starts at the space before
    each, and no other token starts with a space, so that these tokens tell where units begin.
    """
    own, starts, _ = tokenizer(path)
    lines = [" " + " ".join(found[at : at + LINE]) for at in range(0, len(found), LINE)]
    ids, sizes = [], []
    for at in range(0, len(lines), LINES):
        for k, e in enumerate(own.encode_batch_fast(lines[at : at + LINES], add_special_tokens=False), at):
            these = np.array(e.ids, "<u4")
            first = np.flatnonzero(starts[these])
            units = found[LINE * k : LINE * (k + 1)]
            if len(first) != len(units) or first[0]:
                raise ValueError("the tokenizer does not start a token at every lone space")
            ids.append(these)
            sizes.append(np.diff(first, append=len(these)))
    return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])


def _is_plain(units: pa.Array) -> np.ndarray:
    """Whether a unit is not empty, has no space, and no other white space at an end."""
    ok = pc.and_(pc.equal(pc.utf8_trim_whitespace(units), units), pc.greater(pc.binary_length(units), 0))
    return pc.and_not(ok, pc.match_substring(units, " ")).to_numpy(zero_copy_only=False)


def _gathered(ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, each of `size` from `at` on, one after another, and where each ends."""
    ends = np.cumsum(size)
    return ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


def _tails(data: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last `size` bytes before each end, as strings of MOST_SIGNS bytes at most."""
    out = np.zeros((len(ends), MOST_SIGNS), np.uint8)
    for k in range(MOST_SIGNS):
        some = np.flatnonzero(size > k)
        out[some, k] = data[ends[some] - size[some] + k]
    return out.view(f"S{MOST_SIGNS}").ravel()


def _worded(path: str, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """_spaced() with the signs that end a unit taken off, so that a word is encoded once whatever it ends with.

    Signs after a letter or digit are a match of the tokenizer's pattern of their own.
    """
    words = pc.utf8_rtrim(units, SIGNS)
    short = pc.less_equal(pc.subtract(pc.binary_length(units), pc.binary_length(words)), MOST_SIGNS)
    words = pc.if_else(pc.and_(short, pc.utf8_is_alnum(pc.utf8_slice_codeunits(words, -1))), words, units)
    coded = words.dictionary_encode()
    ids, sizes = _spaced(path, coded.dictionary.to_pylist())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.subtract(pc.binary_length(units), pc.binary_length(words)).to_numpy(zero_copy_only=False)
    ended = np.flatnonzero(size)
    ends = np.frombuffer(units.buffers()[1], np.int32)[units.offset + 1 :][ended].astype(np.int64)
    signs, which = np.unique(_tails(np.frombuffer(units.buffers()[2] or b"", np.uint8), ends, size[ended]), return_inverse=True)
    more, more_sizes = _alone(path, [x.decode() for x in signs.tolist()])
    parts = np.full((len(code), 2), len(sizes) + len(more_sizes))  # the last part is none
    parts[:, 0] = code
    parts[ended, 1] = which + len(sizes)
    sizes = np.concatenate([sizes, more_sizes, [0]])
    at = np.cumsum(sizes) - sizes
    ids, _ = _gathered(np.concatenate([ids, more]), at[parts.ravel()], sizes[parts.ravel()])
    return ids, sizes[parts].sum(1)


def _encoded(path: str, coded: pa.DictionaryArray, starts: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, one after another, and where each ends: of texts cut into units, of which texts begin at `starts` and those that are `plain` _is_plain()."""
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    units = coded.dictionary
    n = len(units)
    first = np.zeros(len(code), bool)
    first[starts] = True
    use = np.zeros((2, n), bool)  # as a later unit, as a text's first
    use[0, code[~first]] = use[1, code[first]] = True
    ids, at, size, base = [], np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), 0
    for which, shift, space in ((use[0] & plain, 0, None), (use[0] & ~plain, 0, " "), (use[1], n, "")):
        some = np.flatnonzero(which)
        found = units.take(pa.array(some))
        these, sizes = _worded(path, found) if space is None else _alone(path, [space + x for x in found.to_pylist()])
        size[some + shift] = sizes
        at[some + shift] = base + np.cumsum(sizes) - sizes
        base += len(these)
        ids.append(these)
    code[first] += n
    out, ends = _gathered(np.concatenate(ids), at[code], size[code])
    return out, ends[np.append(starts[1:], len(code)) - 1]


def encoded(path: str, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts in some order, and where those of each text start and end; empty texts have none.

    Texts are cut at lone spaces, where a match of the tokenizer's pattern starts, so that units
    encode apart and each distinct one once. Texts with other white space beside a space or at an end are cut
    by a pattern, all others where a space is. Texts that spell a special token, which the tokenizer takes out first, are
    encoded whole.
    """
    begin, end = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    out, base = [], 0
    spells = np.zeros(len(found), bool)
    for special in tokenizer(path)[2]:
        spells |= pc.match_substring(found, special).to_numpy(zero_copy_only=False)
    if spells.any():
        ids, sizes = _alone(path, found.filter(pa.array(spells)).to_pylist())
        end[spells] = np.cumsum(sizes)
        begin[spells] = end[spells] - sizes
        out, base = [ids], len(ids)
    some = np.flatnonzero(pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False) & ~spells)

    def add(rows: np.ndarray, coded: pa.DictionaryArray, starts: np.ndarray, plain: np.ndarray) -> None:
        nonlocal base
        ids, ends = _encoded(path, coded, starts, plain)
        begin[rows], end[rows] = base + np.append(0, ends[:-1]), base + ends
        out.append(ids)
        base += len(ids)

    lists = pc.split_pattern(found.take(pa.array(some)), " ")
    starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))[:-1].astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    if not len(some):
        return np.concatenate([np.zeros(0, "<u4"), *out]), begin, end
    plain = _is_plain(coded.dictionary)
    odd = np.logical_or.reduceat(~plain[coded.indices.to_numpy(zero_copy_only=False)], starts)
    if odd.any():
        cut = [ALONE.split(t) for t in found.take(pa.array(some[odd])).to_pylist()]
        sizes = np.array([len(x) for x in cut])
        own = pa.array([u for x in cut for u in x], pa.string()).dictionary_encode()
        add(some[odd], own, np.cumsum(sizes) - sizes, _is_plain(own.dictionary))
        lists = lists.filter(pa.array(~odd))
        starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))[:-1].astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        plain = _is_plain(coded.dictionary)
    if not odd.all():
        add(some[~odd], coded, starts, plain)
    return np.concatenate(out), begin, end


def encode_texts(path: str, found: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers; empty texts have none."""
    ids, begin, end = encoded(path, pa.array(found, pa.string()))
    return [ids[a:b].tobytes() for a, b in zip(begin, end)]


def _pieces(batches, path, length, end_id):
    part, seen = TaskContext.get().partitionId(), defaultdict(int)
    last = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for rows in slices(batch, "text", SLICE):
            out = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids")}
            found, begin, end = encoded(path, columns(rows, "text")[0].cast(pa.string()))
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
                for at in range(a, b + 1, length):
                    n = min(length, b + 1 - at)
                    piece = found[at : min(b, at + length)].tobytes()
                    if at + n > b:
                        piece += last
                    for k, v in zip(out, (i, at - a, n, zlib.crc32(piece), b + 1 - a, seen[n], piece)):
                        out[k].append(v)
                    seen[n] += 1
            id_ = columns(rows, "doc_id")[0].take(pa.array(out.pop("row"), pa.int32()))
            ids = pa.array(out.pop("ids"), pa.binary())
            more = [pa.array(v, pa.int64()) for v in out.values()]
            yield pa.RecordBatch.from_arrays([id_, *more, pa.array([part] * len(id_), pa.int32()), ids], ["doc_id", *out, "part", "ids"])


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used, for counts by piece length.

    Lengths are placed longest first. A run of n equal pieces goes, one piece to a pack, to the
    shortest open packs that have room for it: those with the most room left. Where none has, the
    rest of the run opens the least number of new packs.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r, packs in open_packs.items() if packs and r >= size), default=None)
            if room is None:
                # equal pieces fill new packs: as many as fit in each, and those over share one more
                most = length // size
                full, over = divmod(left, most)
                for pieces, count in ((most, full), (over, 1)):
                    if pieces and count:
                        open_packs[length - size * pieces].append(((size,) * pieces, count))
                break
            pattern, count = open_packs[room].pop()
            used = min(left, count)
            if used < count:
                open_packs[room].append((pattern, count - used))
            open_packs[room - size].append(((*pattern, size), used))
            left -= used
    return [(pattern, count) for room in sorted(open_packs) for pattern, count in open_packs[room]]


def laid_open(patterns: list[tuple[tuple[int, ...], int]], length: int) -> tuple[list, list]:
    """The patterns to keep, and those whose packs are laid end to end: all with more room than SLACK, if that saves a sequence."""
    room = lambda pattern: length - sum(pattern)
    opened = [x for x in patterns if room(x[0]) > SLACK * length]
    if sum(room(pattern) * count for pattern, count in opened) < length:
        return patterns, []
    return [x for x in patterns if room(x[0]) <= SLACK * length], opened


def slots(patterns: list[tuple[tuple[int, ...], int]], opened: list[tuple[tuple[int, ...], int]], length: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of a run of pieces, where the first of them lies if all sequences are one, and how far each lies behind the one before."""
    runs, taken, base = defaultdict(list), defaultdict(int), 0
    for found, is_open in ((patterns, False), (opened, True)):
        for pattern, count in found:
            step, at = sum(pattern) if is_open else length, base
            for size in pattern:
                runs[size].append((taken[size], at, step))
                taken[size] += count
                at += size
            base += step * count
    return {size: tuple(np.array(x, np.int64) for x in zip(*found)) for size, found in runs.items()}


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _placed(batches, runs, length):
    for batch in batches:
        size, rank = (x.to_numpy(zero_copy_only=False) for x in columns(batch, "length", "rank"))
        at = np.zeros(len(size), np.int64)
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            first, base, step = runs[int(n)]
            k = np.searchsorted(first, rank[some], "right") - 1
            at[some] = base[k] + (rank[some] - first[k]) * step[k]
        sequence, offset = at // length, at % length
        cut = np.where(offset + size > length, length - offset, 0)
        keep = columns(batch, "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset), pa.array(cut)], ["row", *FIELDS[:-1], "cut"])


def _halved(batches):
    """The two parts of pieces that are cut."""
    for batch in batches:
        size, sequence, offset, start, cut = (x.to_numpy(zero_copy_only=False) for x in columns(batch, "length", "sequence_id", "offset", "start", "cut"))
        ids = columns(batch, "ids")[0].to_pylist()
        for second in (False, True):
            parts = [x[4 * k :] if second else x[: 4 * k] for x, k in zip(ids, cut.tolist())]
            new = {
                "start": pa.array(start + cut * second), "length": pa.array(size - cut if second else cut), "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                "sequence_id": pa.array(sequence + second), "offset": pa.array(offset * (not second)), "ids": pa.array(parts, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([new[c] if c in new else columns(batch, c)[0] for c in FIELDS], FIELDS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text) with their places in sequences of at most `length` tokens.

    One row for each piece: doc_id, start (tokens of its document before it), length, ids_crc32,
    doc_tokens, ids (little-endian unsigned 32-bit, null without with_ids), sequence_id, offset.
    Each text is encoded without special tokens added and end_id follows it, so that an empty or null
    text is one piece of one token; a text that spells a special token has its id, as the tokenizer gives it. A document
    is cut after every `length` tokens, and where packs are laid end to end also at a sequence's end; all but the last
    sequence have at most SLACK of padding where that saves any. Repeated rows are packed each for
    itself. The driver sees one count for each length. An id of a sequence depends on the order of
    partitions, everything else but those cuts on the texts alone.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long"
    made = rows.mapInArrow(on_workers(_pieces, tokenizer_path, length, end_id), f"{own}, rank long, part int, ids binary")
    pieces = written(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    kept, opened = laid_open(shortest_pack_first(histogram, length), length)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.drop("ids").join(shift, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift")
    placed = ranked.mapInArrow(on_workers(_placed, slots(kept, opened, length), length), f"row long, {own}, sequence_id long, offset long, cut long")
    ids = pieces.select("row", "ids")
    if opened:
        placed = written(placed, "placed")
    found = (placed.join(ids, "row") if with_ids else placed.withColumn("ids", F.lit(None).cast("binary"))).where(F.col("cut") == 0).select(FIELDS)
    if opened:
        halves = placed.where(F.col("cut") > 0).join(ids, "row").mapInArrow(on_workers(_halved), f"{own}, sequence_id long, offset long, ids binary")
        found = found.unionByName(halves if with_ids else halves.withColumn("ids", F.lit(None).cast("binary")))
    return found
