"""Merkle manifest of a table of documents: a tree of digests for each source, and one over the sources.

Leaves lie in blocks of a fixed number of consecutive ones, arrays that higher-order functions
collapse level by level; the blocks' roots are the leaves of the next round. A block of
3**LEVELS nodes is exactly LEVELS levels of its tree, so that rounds change nothing of the roots. A
document's siblings are those inside its block and, joined on by block, those of its block's root.

Places in the order of a source come from a range exchange over (source, id): rows are counted by
partition and source, and no source is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_column, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that one digest of the next level covers.
ARITY = 3
#: Levels of a block, and its nodes.
LEVELS = 5
BLOCK = ARITY**LEVELS


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a document's fields: each a minus if null, else its size in bytes, a colon and its value."""
    parts = []
    for field in (doc_id, source, lang, n_chars, text):
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with `pos`, a row's place from 0 among those of its key in the given order, and `n`, how many these are.

    The rows of a key lie in as many partitions as they fill. A window sees one row for each partition
    that holds some of a key.
    """
    laid = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    laid = written(laid.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)  # of the number that a row got when it was written
    parts = laid.groupBy("key", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    key = Window.partitionBy("key")
    before = F.sum("size").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("key", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(key).alias("n"))
    found = laid.withColumn("part", part).join(starts, ["key", "part"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def block_levels(nodes: str, count: str) -> Column:
    """The levels of a block from its nodes up, for a tree of which this round has `count` nodes in all: LEVELS, or as many as its root takes."""
    powers = ", ".join(f"{ARITY**i}L" for i in range(LEVELS))
    last = "element_at(done, -1)"
    runs = f"sequence(0, CAST((size({last}) - 1) DIV {ARITY} AS INT))"
    level = f"transform({runs}, i -> sha2(array_join(slice({last}, i * {ARITY} + 1, {ARITY}), ''), 256))"
    return F.expr(f"aggregate(filter(array({powers}), p -> p < {count}), array({nodes}), (done, p) -> concat(done, array({level})))")


def siblings(place: str) -> str:
    """SQL for the siblings left and right of the node at a place of a block, level by level."""
    node = f"CAST({place} DIV element_at(array({', '.join(str(ARITY**i) for i in range(LEVELS))}), k + 1) AS INT)"
    level = "element_at(levels, k + 1)"
    left = f"array_join(slice({level}, {node} - {node} % {ARITY} + 1, {node} % {ARITY}), '')"
    right = f"array_join(slice({level}, {node} + 2, {ARITY - 1} - {node} % {ARITY}), '')"
    return f"transform(slice(sequence(0, {LEVELS - 1}), 1, size(levels) - 1), k -> named_struct('left', {left}, 'right', {right}))"


def rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of blocks, round by round, of nodes(key, pos, n, node, more).

    A row is a block: key, block (its place among the key's), n (the key's nodes in this round), rows
    (what its nodes carry), levels (its digests, from the nodes to its root). A key is in rounds until it has
    one block.
    """
    more = [c for c in nodes.columns if c not in ("key", "pos", "n")]
    found = []
    while True:
        block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
        gathered = nodes.groupBy("key", block).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *more))).alias("rows"))
        table = written(gathered.withColumn("levels", block_levels("rows.node", "n")), name)
        found.append(table)
        most = table.agg(F.max("n")).first()[0] or 0
        if most <= BLOCK:
            return found
        count = F.ceil(F.col("n") / BLOCK).cast("long").alias("n")
        nodes = table.where(F.col("n") > BLOCK).select("key", F.col("block").alias("pos"), count, root().alias("node"))
        more = ["node"]


def root() -> Column:
    """The last digest of a block."""
    return F.expr("element_at(element_at(levels, -1), 1)")


def roots(tables: list[DataFrame]) -> DataFrame:
    """key and node, the root of each key's tree."""
    found = [t.where(F.col("n") <= BLOCK).select("key", root().alias("node")) for t in tables]
    for other in found[1:]:
        found[0] = found[0].unionByName(other)
    return found[0]


def paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's blocks with `path`, the siblings of their roots up to the last, and more, from above(key, path, more), the siblings of each key's root."""
    more = [c for c in above.columns if c not in ("key", "path")]
    over = None
    for table in reversed(tables):
        ends = table.where(F.col("n") <= BLOCK).select("key", "block").join(above, "key")
        over = ends if over is None else over.unionByName(ends)
        if table is tables[0]:
            break
        inner = f"transform(element_at(levels, 1), (x, i) -> named_struct('block', block * {BLOCK} + i, 'path', concat({siblings('i')}, path)))"
        over = table.join(over, ["key", "block"]).select("key", *more, F.expr(f"inline({inner})"))
    return tables[0].join(over, ["key", "block"])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs(doc_id, source, lang, n_chars, text).

    Leaves of a source ascend by doc_id, null first; rows with one id by their digests. Null is a source like any
    other, the first. proof_sha256 is the digest of a leaf's siblings up to the root. Documents with an
    even crc32 of their id (a null id is the empty text there) are checked without their line feeds: folded_root is what
    their leaf and the siblings give, verified whether that is the root. An empty table has no rows.
    """
    rows = docs.select(*(F.col(c) for c in FIELDS))
    other = F.replace("text", F.lit("\n"), F.lit(""))
    tampered = F.when((fold_column(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n")), leaf(*(F.col(c) for c in FIELDS[:-1]), other))
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = rows.select(key.alias("key"), "doc_id", leaf(*(F.col(c) for c in FIELDS)).alias("node"), tampered.alias("tampered"))
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")  # digests are not made again to sample ranges
    sources = rounds(numbered(leaves, "ordered", "doc_id", "node", "row").drop("row"), "blocks")

    subroots = roots(sources).select(F.lit("").alias("key"), F.col("key").alias("source_key"), "node")
    whole = rounds(numbered(subroots, "subroots", "source_key"), "subroot_blocks")
    total = roots(whole).first()
    tops = paths(whole, roots(whole).select("key", F.expr("cast(array() AS array<struct<left:string,right:string>>)").alias("path")))
    inner = f"transform(rows, (x, i) -> named_struct('key', x.source_key, 'subroot', x.node, 'path', concat({siblings('i')}, path)))"
    tops = tops.select(F.expr(f"inline({inner})"))

    blocks = paths(sources, tops)
    with_paths = f"transform(rows, (x, i) -> named_struct('x', x, 'path', concat({siblings('i')}, path)))"
    fields = (
        "'doc_id', y.x.doc_id, 'leaf', y.x.node, 'subroot', subroot, "
        "'proof_sha256', sha2(array_join(transform(y.path, p -> concat(p.left, p.right)), ''), 256), "
        "'folded_root', aggregate(y.path, coalesce(y.x.tampered, y.x.node), (node, p) -> sha2(concat(p.left, node, p.right), 256))"
    )
    found = blocks.select(F.expr(f"inline(transform({with_paths}, y -> named_struct({fields})))"))
    end = F.lit(total["node"] if total else None).cast("string")
    return found.select("doc_id", "leaf", "subroot", end.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == end).alias("verified"))
