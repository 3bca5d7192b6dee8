"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments. If two fingerprints differ in at most three
bits, they differ in at most one bit of some segment. So each distinct fingerprint looks up, in
the table of segments, its own segments and those with one of their set bits cleared (of two
segments that differ in one bit, one has it set), and full distances are verified.

Segments that more than HOT fingerprints share are looked up another way, which is exact too and
makes no pairs: each fingerprint there lists the points of the other segment within two bits, and
whoever has come to a point at a cost of at most one bit links all that have come to it.

keep_one, the pipeline's stage, has another rule: five-word shingles that agree by 0.8 or more. Its
candidates come from fingerprints of those shingles, looked up in the same way. At
0.8 these differ in ten bits of 64 on average, which no ball of segments reaches at a cost
that follows the rows, so bands of least shingle hashes give candidates beside them. Each is
verified on the sets of shingles. Buckets of more than CROWD different texts make no pairs: their texts
meet the least one, and then only those meet all others that lie outside the bucket's largest
group so far, in blocks, until no two texts of a bucket that have not met are in different groups.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, on_workers, slices, texts, written
from .components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 15
#: Fingerprints with one segment in common from which pairs are no longer looked at one by one.
HOT = 1024
#: keep_one: words of a shingle, the least similarity of near copies, and bands of least values; a
#: pair of similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 20, 5
#: Classes with a key in common from which not every two of them are compared.
CROWD = 64
#: Classes of two blocks that meet in a task.
ASKING, ASKED = 256, 1024
#: Shingles that are put in all orders at once.
FEW = 1024


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the text's word shingles, as a signed 64-bit number; 0 for a text without words."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    first, last = (starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()) if n >= shingle else ([0], [len(line)])
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big", signed=True)


def _fingerprints(batches, shingle, seed):
    for batch in batches:
        for part in slices(batch, "text"):
            found = [fingerprint(t, shingle, seed) for t in texts(part)]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row of docs(doc_id, text); a null text has no words."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(on_workers(_fingerprints, shingle, seed), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _segments(fp: Column) -> list[Column]:
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    return [high, low + F.lit(1 << 32)]  # the number of the segment stands above its 32 bits


def _cleared(key: Column) -> Column:
    """The key with each one of its segment's set bits cleared."""
    bits = F.array([F.lit(1 << b) for b in range(32)])
    return F.transform(F.filter(bits, lambda b: key.bitwiseAND(b) != 0), lambda b: key - b)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of distinct(fp) within DISTANCE bits of each other.

    Every edge is a link. Links within a segment shared by more than `hot` fingerprints are
    given as stars that connect the same fingerprints.
    """
    keys = _segments(F.col("fp"))
    table = distinct.select(F.explode(F.array(keys)).alias("key"), "fp")
    asks = distinct.select(
        F.explode(F.concat(*(F.concat(F.array(F.struct(k.alias("key"), F.lit(0).alias("off"))), F.transform(_cleared(k), lambda c: F.struct(c.alias("key"), F.lit(1).alias("off")))) for k in keys))).alias("ask"),
        F.col("fp").alias("a"),
    ).select("ask.*", "a")
    crowded = table.groupBy("key").count().where(F.col("count") > hot).select("key")
    crowded = written(crowded, "crowded")
    some = not crowded.isEmpty()
    rest, few = (asks.join(crowded, "key", "left_anti"), table.join(crowded, "key", "left_anti")) if some else (asks, table)
    pairs = rest.join(few, "key").where("(off = 1 or a < fp) and bit_count(a ^ fp) <= 3").select("a", F.col("fp").alias("b"))
    if not some:
        return pairs
    other = F.when(F.col("key") < (1 << 32), F.col("a").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("a", 32))
    here = asks.join(crowded, "key", "left_semi").select("key", "off", "a", other.alias("other"))
    bits = F.array([F.lit(1 << b) for b in range(32)])
    one = F.transform(bits, lambda b: F.struct(F.col("other").bitwiseXOR(b).alias("point"), (F.col("off") + 1).alias("cost")))
    two = F.flatten(F.transform(bits, lambda b: F.transform(F.filter(bits, lambda c: c > b), lambda c: F.struct(F.col("other").bitwiseXOR(b).bitwiseXOR(c).alias("point"), (F.col("off") + 2).alias("cost")))))
    none = F.array(F.struct(F.col("other").alias("point"), F.col("off").alias("cost")))
    ball = F.when(F.col("off") == 0, F.concat(none, one, two)).otherwise(F.concat(none, one))
    points = here.select("key", "a", F.explode(ball).alias("at")).select("key", "a", "at.*")
    centre = points.where("cost <= 1").groupBy("key", "point").agg(F.min("a").alias("b"))
    stars = points.join(centre, ["key", "point"]).where("a <> b").select("a", "b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links reach, of every row of docs(doc_id, text).

    Fingerprints link at DISTANCE or fewer differing bits; texts without words all have
    fingerprint 0 and so are one component, which others can join. Rows with equal doc_ids are
    rows of their own. A component whose ids are all null has a null component_id.
    """
    found = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), hot))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str, size: int = WORDS, seed: int = SEED) -> tuple[int, np.ndarray]:
    """A signed 64-bit hash of the text's words and the distinct hashes of its shingles, none without words."""
    words = text.encode().lower().split()
    line = b" ".join(words)
    digest, ends = xxhash.xxh64_digest, list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    pairs = zip(starts, ends[size - 1 :]) if len(words) >= size else [(0, len(line) + 1)] * bool(words)
    raw = b"".join([digest(line[a : b - 1], seed) for a, b in pairs])
    return int.from_bytes(digest(line, seed), "big", signed=True), np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def majority(hashes: np.ndarray) -> int:
    """SimHash of distinct 64-bit hashes, as a signed number; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def band_keys(hashes: np.ndarray, seed: int = SEED) -> list[int]:
    """For each of BANDS bands a hash of its ROWS least values, over as many orders of the shingles."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), FEW):
        np.minimum(least, (hashes[at : at + FEW, None] * factors).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), seed + i) - (1 << 63) for i, r in enumerate(rows)]


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted sets of 32-bit numbers."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _sketches(batches, size):
    for batch in batches:
        for part in slices(batch, "text"):
            found = [shingles(t, size) for t in texts(part)]
            sets = [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for _, h in found]
            numbers = [pa.array(x, pa.int64()) for x in ([c for c, _ in found], [majority(h) for _, h in found])]
            out = [*numbers, pa.array([band_keys(h) for _, h in found], pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id", "t"), *out], ["doc_id", "t", "c", "fp", "keys", "set"])


def _similar(batches, least):
    for batch in batches:
        x, y = (c.to_pylist() for c in columns(batch, "x", "y"))
        keep = pa.array([similarity(p, q) >= least for p, q in zip(x, y)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def shared_counts(asks: list[bytes], there: list[bytes]) -> np.ndarray:
    """How many numbers each set of asks has in common with each of there."""
    left, right = [np.frombuffer(x, np.uint32) for x in asks], [np.frombuffer(x, np.uint32) for x in there]
    sizes = np.array([len(x) for x in right])
    out = np.zeros((len(left), len(right)), np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    kinds, code = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.cumsum(sizes[some]) - sizes[some]
    for i, x in enumerate(left):
        has = np.zeros(len(kinds) + 1, np.int32)
        at = np.searchsorted(kinds, x)
        has[np.where(kinds[np.minimum(at, len(kinds) - 1)] == x, at, len(kinds))] = 1
        out[i, some] = np.add.reduceat(has[code], starts)
    return out


def _meet(pair, least):
    asks, there = pair
    x, y = asks["set_l"].to_pylist(), there["set_r"].to_pylist()
    both = shared_counts(x, y)
    whole = np.array([len(v) for v in x])[:, None] // 4 + np.array([len(v) for v in y])[None] // 4 - both
    a, b = asks["c_l"].to_numpy(), there["c_r"].to_numpy()
    i, j = np.nonzero((both >= least * whole) & (whole > 0) & (a[:, None] != b[None]))
    yield pa.table([pa.array(a[i]), pa.array(b[j])], names=["a", "b"])


def _meeting(least):
    run = on_workers(_meet, least)
    return lambda asks, there: next(run((asks, there)))


def by_fingerprints(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of classes of sketches(c, fp, set): those that links() connects by their fingerprints, and with the least class of a fingerprint all others that have it. Classes without shingles have no pair."""
    classes = written(sketches.where(F.length("set") > 0).select("c", "fp").distinct(), "classes")
    prints = written(classes.groupBy("fp").agg(F.min("c").alias("p")), "prints")
    here = lambda at: prints.select(F.col("fp").alias(at), F.col("p").alias(f"{at}_c")).hint("merge")
    linked = links(prints.select("fp")).join(here("a"), "a").join(here("b"), "b").select(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b"))
    equal = classes.join(prints.hint("merge"), "fp").where("p < c").select(F.col("p").alias("a"), F.col("c").alias("b"))
    return linked.union(equal)


def similar(sketches: DataFrame, least: float = LEAST, hot: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between classes of sketches(c, h, fp, keys, set), h any hash of the row, whose shingles agree by `least` or more, and (node, root) of the groups that they and all further such pairs with a key in common connect.

    Candidates have fingerprints within DISTANCE bits or share a key; each is verified on the shingles' sets. In a bucket of more than `hot`
    classes these are the pairs with its least class at first. Then, as long as a class has not met its bucket and
    lies outside the bucket's largest group, it meets all classes there, in one bucket for each class at
    first, as classes share many, and in ever more. Two classes of a bucket that never met are in one group at the end.
    """
    keys = sketches.select("c", F.explode("keys").alias("key")).distinct()
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("a")).where("n > 1"), "shared")
    members = written(keys.join(shared.hint("merge"), "key"), "members")
    small = members.where(F.col("n") <= hot)
    pairs = small.select("key", F.col("c").alias("l")).join(small.select("key", F.col("c").alias("b")).hint("merge"), "key").where("l < b").select(F.col("l").alias("a"), "b")
    pairs = pairs.union(members.where((F.col("n") > hot) & (F.col("a") < F.col("c"))).select("a", F.col("c").alias("b")))
    pairs = written(pairs.union(by_fingerprints(sketches)).distinct(), "pairs")
    crowd = members.where(F.col("n") > hot).select("key", "c", "n")
    named = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    # one row of each class is asked for by its own hash, so that the copies of a text don't meet
    one = named.join(sketches.groupBy("c").agg(F.min("h").alias("h")).hint("merge"), "c")
    sets = written(sketches.select("c", "h", "set").join(one.hint("merge"), ["c", "h"]).groupBy("c").agg(F.first("set").alias("set")), "sets")
    first = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
    both = first.join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    edges = written(both.mapInArrow(on_workers(_similar, least), "a long, b long"), "links")
    roots = components(edges)
    if crowd.isEmpty():
        return edges, roots
    todo, most = crowd, 1
    while True:
        root = F.coalesce("root", "c").alias("root")
        rooted = written(crowd.join(roots.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "n", root), "rooted")
        largest = rooted.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
        outside = todo.join(rooted, ["key", "c", "n"]).join(largest, "key").where("root <> largest").select("key", "c", "n", "root")
        place = F.row_number().over(Window.partitionBy("c").orderBy("n", "key"))  # of BANDS keys at most
        chosen = written(outside.withColumn("place", place).where(F.col("place") <= most).select("c", "key", "n"), "chosen")
        if chosen.isEmpty():
            return edges, roots
        most *= 5
        # every two blocks of a bucket are a key of their own
        asking = chosen.groupBy("key").agg(F.ceil(F.count("*") / F.lit(float(ASKING))).cast("int").alias("p"), F.max(F.ceil(F.col("n") / F.lit(float(ASKED)))).cast("int").alias("q"))
        dealt = lambda rows, own, other: rows.join(asking, "key").join(sets, "c").select(
            "key", F.pmod(F.xxhash64("c"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "c", "set"
        )
        name = lambda rows, at: rows.select(F.concat_ws("|", "key", "p", "q").alias(at), F.col("c").alias(f"c_{at}"), F.col("set").alias(f"set_{at}"))
        left, right = name(dealt(chosen.select("key", "c"), "p", "q"), "l"), name(dealt(rooted.select("key", "c"), "q", "p"), "r")
        met = left.groupBy("l").cogroup(right.groupBy("r")).applyInArrow(_meeting(least), "a long, b long")
        new = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(edges, ["a", "b"], "left_anti"), "links")
        if not new.isEmpty():
            # what has been linked before is one edge for each class, to its group's root
            edges, roots = edges.union(new), components(roots.toDF("a", "b").union(new))
        todo = written(todo.join(chosen.select("key", "c"), ["key", "c"], "left_anti"), "todo")


def keep_one(docs: DataFrame, size: int = WORDS, least: float = LEAST, hot: int = CROWD) -> DataFrame:
    """One row of docs for each group of near copies, the one with the least id, with all its columns.

    Near copies agree in `least` or more of their shingles of `size` words (Jaccard), and groups are
    what such pairs connect; texts without words are one group. Of several rows with the least id
    and one text in a group one stays, the first by its columns as JSON. Rows without an id can't be told apart and stay.
    """
    id_, text_, row_ = (next(n for n in (name + "_" * k for k in range(1, len(docs.columns) + 2)) if n not in docs.columns) for name in ("id", "mark", "row"))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), mark.alias("t"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, t long, c long, fp long, keys array<long>, set binary"
    found = written(rows.mapInArrow(on_workers(_sketches, size), schema), "sketches")
    roots = similar(found.select("c", F.xxhash64("doc_id", "t").alias("h"), "fp", "keys", "set"), least, hot)[1].withColumnRenamed("node", "c")
    # of a class of equal words the least row stands for all, so that hot classes are small before they meet
    classes = found.where("doc_id is not null").groupBy("c", "doc_id", "t").agg(F.count("*").alias("n"))
    first = classes.groupBy("c").agg(F.min(F.struct("doc_id", "t", "n")).alias("x")).join(roots, "c", "left")
    kept = first.groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("x").alias("x")).select(F.col("x.doc_id").alias(id_), F.col("x.t").alias(text_), F.col("x.n").alias(row_))
    kept = written(kept, "kept")
    same = (F.col("doc_id") == F.col(id_)) & (mark == F.col(text_))
    # always dealt anew, as the texts of a larger table would be
    out = docs.join(kept.where(F.col(row_) == 1).hint("merge"), same, "left_semi").unionByName(docs.where("doc_id is null"))
    several = kept.where(F.col(row_) > 1)
    if not several.isEmpty():
        rows = docs.join(several, same, "left_semi")
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = rows.groupBy("doc_id", mark.alias(text_)).agg(F.min_by(whole, F.to_json(whole)).alias(row_))
        out = out.unionByName(one.select(f"{row_}.*"))
    return out


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
