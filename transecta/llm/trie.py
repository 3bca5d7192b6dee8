"""Trie of the prefixes that conversations share, by an LCP-aware mergesort.

A turn is a token of fixed size: a digest of role and text, and the text's code points. A
conversation is its tokens, one after another, whose order as bytes is that of the sequences.
A range exchange over (tokens, id) deals conversations to tasks, those with equal turns too. A
task sorts runs, in which every conversation carries how many turns it shares with the one before (its
LCP), and merges them by a tree of losers, which compares two conversations only from the turns on that both share with
the last one out. The merged stream opens and ends the nodes of a path on a stack.

A node that a range's first or last conversation goes through may lie in other ranges too. Such
seams, at most two paths for each range, are added up by node; all others leave their task finished.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fold_column, on_workers, written

#: Bytes of a turn's digest, and of its token: after the digest the code points of its text.
DIGEST = 16
TOKEN = DIGEST + 4
#: Conversations of a run, rows that leave a task at once, ids in a row.
RUN, ROWS, IDS = 1024, 1 << 16, 1 << 16
#: Keys that a seam's children are dealt to.
SALTS = 16


def keyed(conversations: DataFrame) -> DataFrame:
    """conv_id and tokens array<string> (in hexadecimal) of each conversation, in order of turn, null first, then of token; null role and text are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    token = F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    found = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", token.alias("token")))).alias("turns"))
    return found.select("conv_id", F.col("turns.token").alias("tokens"))


def rebuilt(found: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """found(conv_id, tokens) with the first h turns of each conversation c replaced by those of conversation c - c % every, h = crc32(c) % most.

    Where that conversation is shorter all its turns come, where it is absent none; c's own turns after its first h follow.
    """
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("base")
    heads = found.where(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("base"), F.slice("tokens", 1, most - 1).alias("head"))
    h = fold_column(F.col("conv_id"), most).cast("int")
    joined = found.select("conv_id", "tokens", base, h.alias("h")).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    return joined.select("conv_id", F.concat(head, F.slice("tokens", F.col("h") + 1, F.size("tokens"))).alias("tokens"))


def common(a: bytes, b: bytes, at: int) -> int:
    """How many turns are equal in a and b, of which the first `at` are known to be."""
    end = min(len(a), len(b)) // TOKEN
    while at < end and a[at * TOKEN : (at + 1) * TOKEN] == b[at * TOKEN : (at + 1) * TOKEN]:
        at += 1
    return at


def _order(conv_id):
    return (conv_id is not None, conv_id)


class Run:
    """Conversations in order of tokens, then id (null first), each with the turns that it shares with the one before."""

    __slots__ = ("keys", "ids", "lcps")

    def __init__(self, rows: list[tuple[bytes, object]]):
        rows.sort(key=lambda x: (x[0], *_order(x[1])) if x[1] is not None else (x[0], False))
        self.keys, self.ids = [x[0] for x in rows], [x[1] for x in rows]
        self.lcps = [0, *(common(a, b, 0) for a, b in zip(self.keys, self.keys[1:]))]


class Losers:
    """Tree of losers over runs. A run's head carries the turns that it shares with the one that it lost to, in the end with the last one out."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.at, self.lcp = [0] * self.size, [0] * self.size
        self.lost = [-1] * self.size  # at each inner node the run that lost there
        self.compared = 0

    def _ended(self, run: int) -> bool:
        return run >= len(self.runs) or self.at[run] >= len(self.runs[run].keys)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs whose heads' turns in common with the same conversation before them are known."""
        if self._ended(b):
            return a, b
        if self._ended(a):
            return b, a
        if self.lcp[a] != self.lcp[b]:  # who shares more with what came before comes first
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        x, y = (self.runs[r].keys[self.at[r]] for r in (a, b))
        same = common(x, y, self.lcp[a])
        self.compared += same - self.lcp[a] + 1
        first, second = x[same * TOKEN : (same + 1) * TOKEN], y[same * TOKEN : (same + 1) * TOKEN]
        if first == second:  # both end here
            i, j = (self.runs[r].ids[self.at[r]] for r in (a, b))
            wins = i is None or j is not None and i <= j
        else:
            wins = first < second
        winner, loser = (a, b) if wins else (b, a)
        self.lcp[loser] = same
        return winner, loser

    def _built(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.lost[node] = self._play(self._built(2 * node), self._built(2 * node + 1))
        return winner

    def merged(self) -> Iterator[tuple[bytes, object, int]]:
        """(tokens, id, turns shared with the one before) in order."""
        winner = self._built(1)
        while not self._ended(winner):
            run, at = self.runs[winner], self.at[winner]
            yield run.keys[at], run.ids[at], self.lcp[winner]
            self.at[winner] = at + 1
            if at + 1 < len(run.keys):
                self.lcp[winner] = run.lcps[at + 1]
            node = (winner + self.size) // 2
            while node:
                winner, self.lost[node] = self._play(winner, self.lost[node])
                node //= 2


class Node:
    """An open node: what is known of it so far. leaves and saved are those of the finished subtrees below."""

    __slots__ = ("key", "parent", "depth", "chars", "least", "n_convs", "n_children", "leaves", "saved", "ids", "seam", "waiting")

    def __init__(self, key: bytes, parent: bytes | None, depth: int, chars: int):
        self.key, self.parent, self.depth, self.chars = key, parent, depth, chars
        self.least, self.n_convs, self.n_children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids: list = []
        self.seam = False
        self.waiting: list[int] = []  # rows of finished children, which want to know this node's least id


def least(a, b):
    """The smaller id; null where both are."""
    return b if a is None else a if b is None else min(a, b)


def _decimal(ids: list) -> bytes:
    return ",".join("" if x is None else str(x) for x in ids).encode()


NODE, SEAM, ENDS = 0, 1, 2
FIELDS = "kind int, part int, seq int, key binary, parent binary, conv_id {id}, depth long, parent_conv_id {id}, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, ids binary"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


class Open:
    """The open path of nodes, from the root down, and the rows of those that are finished."""

    def __init__(self, part: int):
        self.part, self.path, self.rows, self.begun = part, [], [], False

    def add(self, tokens: bytes, conv_id, shared: int) -> None:
        """A conversation that shares so many turns with the one before."""
        while len(self.path) > shared + 1:
            self.finish()
        if not self.path:
            self.path.append(Node(hashlib.blake2b(digest_size=DIGEST).digest(), None, 0, 0))
        for d in range(len(self.path), len(tokens) // TOKEN + 1):
            token, above = tokens[(d - 1) * TOKEN : d * TOKEN], self.path[-1].key
            key = hashlib.blake2b(above + token, digest_size=DIGEST).digest()
            self.path.append(Node(key, above, d, int.from_bytes(token[DIGEST:], "big")))
        end = self.path[-1]
        end.n_convs += 1
        end.least = least(end.least, conv_id)
        end.ids.append(conv_id)
        if not self.begun:  # the range's first path
            self.begun = True
            for node in self.path:
                node.seam = True

    def finish(self) -> None:
        """The deepest open node ends."""
        node = self.path.pop()
        above = self.path[-1] if self.path else None
        if above:
            above.n_convs += node.n_convs
            above.least = least(above.least, node.least)
        if node.seam:
            for i in node.waiting:
                self.rows[i][4] = node.key
            self.rows.append([SEAM, self.part, 0, node.key, node.parent, node.least, node.depth, None, node.n_convs, node.n_children, node.leaves, node.saved, node.chars, None, None])
            for k in range(0, len(node.ids), IDS):
                self.rows.append([ENDS, self.part, k // IDS, node.key, *[None] * 10, _decimal(node.ids[k : k + IDS])])
            return
        for i in node.waiting:
            self.rows[i][7] = node.least
        leaves = node.leaves + (not node.n_children)
        saved = node.saved + (node.n_convs - 1) * node.chars
        above.n_children += 1
        above.leaves += leaves
        above.saved += saved
        row = [NODE, self.part, 0, None, above.key if above.seam else None, node.least, node.depth, None, node.n_convs, node.n_children, leaves, saved, None, hashlib.sha256(_decimal(node.ids)).hexdigest(), None]
        if not above.seam:
            above.waiting.append(len(self.rows))
        self.rows.append(row)

    def close(self) -> None:
        """The range ends: the path that is open is a seam."""
        for node in self.path:
            node.seam = True
        while self.path:
            self.finish()

    def settled(self) -> bool:
        """Whether no row waits for a node above it."""
        return len(self.rows) >= ROWS and all(not x.waiting for x in self.path)


def _batch(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [id_type, pa.int64(), id_type] + [pa.int64()] * 5 + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], NAMES)


def _nodes(batches):
    runs, id_type = [], None
    for batch in batches:
        ids, keys = columns(batch, "conv_id", "key")
        id_type = ids.type
        rows = list(zip(keys.to_pylist(), ids.to_pylist()))
        runs += [Run(rows[k : k + RUN]) for k in range(0, len(rows), RUN)]
    if not runs:
        return
    found = Open(TaskContext.get().partitionId())
    for tokens, conv_id, shared in Losers(runs).merged():
        found.add(tokens, conv_id, shared)
        if found.settled():
            yield _batch(found.rows, id_type)
            found.rows = []
    found.close()
    for k in range(0, len(found.rows), ROWS):
        yield _batch(found.rows[k : k + ROWS], id_type)


def _stitched(batches):
    """The seams' nodes: parts of a node are added up, then those below it."""
    nodes: dict[bytes, list] = {}
    id_type = None
    for batch in batches:
        id_type = columns(batch, "conv_id")[0].type
        for key, parent, conv_id, depth, *sums, chars in zip(*(c.to_pylist() for c in columns(batch, "key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars"))):
            node = nodes.setdefault(key, [parent, None, depth, 0, 0, 0, 0, chars])
            node[1] = least(node[1], conv_id)
            for k, x in enumerate(sums, 3):
                node[k] += x
    if not nodes:
        return
    for node in nodes.values():
        if node[0] is not None:
            nodes[node[0]][4] += 1
    for node in sorted(nodes.values(), key=lambda x: -x[2]):
        node[5] += not node[4]
        node[6] += (node[3] - 1) * node[7]
        if node[0] is not None:
            nodes[node[0]][5] += node[5]
            nodes[node[0]][6] += node[6]
    rows = [[SEAM, 0, 0, key, x[0], x[1], x[2], nodes[x[0]][1] if x[0] is not None else None, *x[3:7], None, None, None] for key, x in nodes.items()]
    for k in range(0, len(rows), ROWS):
        yield _batch(rows[k : k + ROWS], id_type)


def _hashed(batches):
    """key and ends_sha256 of rows (key, ids) in order; ids of one key may be any number of rows."""
    last, hashed = None, None
    for batch in batches:
        out = []
        for key, ids in zip(*(c.to_pylist() for c in columns(batch, "key", "ids"))):
            if key != last:
                if hashed:
                    out.append((last, hashed.hexdigest()))
                last, hashed = key, hashlib.sha256(ids)
            else:
                hashed.update(b"," + ids)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.string()))], ["key", "ends_sha256"])
    if hashed:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([hashed.hexdigest()])], ["key", "ends_sha256"])


def trie(found: DataFrame) -> DataFrame:
    """One row for each distinct prefix, the empty one included, of found(conv_id, tokens array<string>), one row for each conversation.

    conv_id (the least of the members: conversations that start with the prefix), depth,
    parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of the subtree, ends_sha256 (of
    the ids of the members that end there). A null id is a member, whose decimal is empty and
    which comes first; it is the least only where it is alone. An empty table has no nodes, nor a root.
    """
    id_type = dict(found.dtypes)["conv_id"]
    fields = FIELDS.format(id=id_type)
    rows = written(found.select("conv_id", F.unhex(F.array_join("tokens", "")).alias("key")), "sequences")  # not made again to sample ranges
    parts = written(rows.repartitionByRange("key", "conv_id").mapInArrow(on_workers(_nodes), fields), "trie")
    seams = written(parts.where(F.col("kind") == SEAM).repartition(1).mapInArrow(on_workers(_stitched), fields), "seams")
    ends = parts.where(F.col("kind") == ENDS).select("key", "part", "seq", "ids").repartition("key").sortWithinPartitions("key", "part", "seq")
    ends = ends.select("key", "ids").mapInArrow(on_workers(_hashed), "key binary, ends_sha256 string")

    keys = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = F.sha2(F.lit("").cast("binary"), 256)
    joined = seams.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(keys)
    whole = parts.where(F.col("kind") == NODE)
    inner = whole.where(F.col("parent").isNull()).select(keys)
    # a seam's children may be most of all nodes: they are SALTS keys, not one
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    above = seams.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"), salts)
    below = whole.where(F.col("parent").isNotNull()).withColumn("salt", F.pmod(F.hash("conv_id", "depth"), F.lit(SALTS)))
    below = below.join(above, ["parent", "salt"]).withColumn("parent_conv_id", F.col("above")).select(keys)
    return joined.unionByName(inner).unionByName(below)
