"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, on_workers, slices, texts

#: Characters above which a text is cut before it is encoded.
LONG_TEXT = 1 << 16
#: A space between two ASCII letters starts a match of the split pattern whatever stands around it.
SAFE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Unicode's white space, which the split pattern calls so; Python's class has four control signs more.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Runs of white space that are encoded by themselves: the library's regex engine gives up on some longer ones.
BLANK = re.compile(SPACE + "{65536,}")

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 bytes, space, rank in each line); one is kept for each worker."""
    if (rank_path, pattern) not in _encodings:
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _encodings[rank_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[rank_path, pattern]


def safe_pieces(text: str, most: int = LONG_TEXT) -> list[str]:
    """The text in pieces of about `most` characters, cut only where a match of the split pattern must start.

    Where no such place follows, the rest stays whole.
    """
    pieces, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        pieces.append(text[start : cut.start()])
        start = cut.start()
    return [*pieces, text[start:]]


def _plain(enc: tiktoken.Encoding, text: str) -> list[np.ndarray]:
    return [enc.encode_to_numpy(x, disallowed_special=()) for x in safe_pieces(text)]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The text's ids.

    A long run of white space is one match of the split pattern, without its last sign where a text goes on
    after it, since that sign may belong to what follows. It is merged by itself.
    """
    if len(text) <= LONG_TEXT:
        return enc.encode_to_numpy(text, disallowed_special=())
    found, start = [], 0
    for run in BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        found += _plain(enc, text[start : run.start()])
        found.append(np.array(enc._encode_single_piece(text[run.start() : end]), np.uint32))
        start = end
    return np.concatenate([*found, *_plain(enc, text[start:])])


def _encode(batches, rank_path, pattern):
    enc = encoding(rank_path, pattern)
    for batch in batches:
        for part in slices(batch, "text"):
            ids = [encode_text(enc, t) for t in texts(part)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            raw = pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id"), lists, raw], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary (the bytes that the ids stand for) of every row of docs(doc_id, text).

    Each match of the pattern is encoded by itself, without special tokens: a text that spells
    one is ordinary text. Null and empty texts have no ids and decode to no bytes. The path must
    be readable on the executors.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(on_workers(_encode, rank_path, pattern), f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
