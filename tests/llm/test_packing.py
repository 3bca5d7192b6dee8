import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from transecta.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_units_encode_as_the_whole_text(odd_texts):
    plain = Tokenizer.from_file(PATH)
    texts = [t or "" for t in odd_texts]
    for text, ids in zip(texts, packing.encode_texts(PATH, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1.' \n\té ", max_size=30))
def test_any_white_space_splits_safely(text):
    plain = Tokenizer.from_file(PATH) if not hasattr(packing, "_plain") else packing._plain
    packing._plain = plain
    assert np.frombuffer(packing.encode_texts(PATH, [text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_patterns_use_every_length_as_often_as_it_occurs(histogram):
    patterns = packing.shortest_pack_first(histogram, 50)
    used = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 50 and list(pattern) == sorted(pattern, reverse=True)
        for size in pattern:
            used[size] += count
    assert used == Counter(histogram)


def test_a_run_of_equal_pieces_opens_no_more_packs_than_it_fills():
    sequences = lambda histogram: sum(n for _, n in packing.shortest_pack_first(histogram, 2048))
    assert sequences({1024: 10}) == 5 and sequences({1024: 11}) == 6
    assert sequences({300: 10_000}) == -(-10_000 // 6)
    rng = np.random.default_rng(4)
    sizes = np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 2048)
    for hot in (300, 600, 900, 1024):
        histogram = Counter(sizes.tolist()) + Counter({hot: 10_000})
        tokens = sum(size * n for size, n in histogram.items())
        assert -(-tokens // 2048) <= sequences(histogram) <= 1.01 * tokens / 2048


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a", "b ", " c", "|>", "  "]), max_size=12))
def test_special_tokens_that_a_text_spells(parts):
    test_any_white_space_splits_safely.hypothesis.inner_test("".join(parts))


def test_special_tokens_beside_other_texts():
    plain, texts = Tokenizer.from_file(PATH), ["x <|endoftext|> y", "plain words", "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b" * 50, " two  spaces "]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [87, 220, 50256, 331]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(PATH, texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def places(histogram, length):
    """(sequence, offset, size) of all pieces after cutting, as _placed() reckons."""
    kept, opened = packing.laid_open(packing.shortest_pack_first(histogram, length), length)
    runs, out = packing.slots(kept, opened, length), []
    for size, n in histogram.items():
        first, base, step = runs[size]
        k = np.searchsorted(first, np.arange(n), "right") - 1
        for at in (base[k] + (np.arange(n) - first[k]) * step[k]).tolist():
            a = min(size, length - at % length)
            out += [(at // length, at % length, a)] + ([(at // length + 1, 0, size - a)] if a < size else [])
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=12))
def test_packs_laid_end_to_end_leave_no_gap(histogram):
    by = defaultdict(list)
    for sequence, offset, size in places(histogram, 64):
        by[sequence].append((offset, size))
    assert sorted(by) == list(range(len(by)))
    for found in by.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at <= 64


def test_lengths_that_gather_leave_little_padding():
    rng = np.random.default_rng(4)
    some = Counter(np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 2048).tolist())
    for histogram in ({1025: 5000}, {700: 5000}, {1100: 5000, 1000: 100}, {2047: 100, 1500: 3000}, {1367: 999}, some, some + Counter({1500: 10_000})):
        tokens = sum(size * n for size, n in histogram.items())
        sequences = len({x[0] for x in places(histogram, 2048)})
        assert sequences * 2048 - tokens < 0.01 * tokens + 2048, histogram if len(histogram) < 5 else "many"


def test_cut_pieces_carry_their_own_digests(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["one", "two", "three", "x9"], 139))) for i in range(200)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH, length=256).collect()
    again = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH, length=256, with_ids=False).collect()
    assert sorted(r["length"] for r in rows) == sorted(r["length"] for r in again) and {r["ids"] for r in again} == {None}
    by_doc = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc[r["doc_id"]].append(r)
    assert any(len(x) > 1 for x in by_doc.values())
    for i, text in docs:
        found = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in found), "<u4").tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
        assert [r["start"] for r in found] == [0, *np.cumsum([r["length"] for r in found])[:-1].tolist()]
    tokens = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) == -(-tokens // 256)


def test_every_token_lies_in_one_place(odd_docs, odd_texts):
    rows = packing.pack(odd_docs, PATH, length=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for i, text in enumerate(odd_texts):
        if i == 6:
            continue  # a repeated row
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist()
        assert ids == np.frombuffer(packing.encode_texts(PATH, [text or ""])[0], "<u4").tolist() + [1]
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    assert len(by_doc[6]) == 2


def test_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []
