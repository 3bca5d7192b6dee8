import base64
import hashlib

import public_tokenizers
import tiktoken

from transecta.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_equal_the_library_on_whole_texts(odd_docs):
    enc = plain()
    rows = byte_bpe.digests(byte_bpe.encode(odd_docs, PATH, public_tokenizers.PATTERN)).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    want = sorted(
        ((-1 if i is None else i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for i, t in texts
        for ids in [enc.encode_ordinary(t)]
    )
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_pieces_of_long_texts_join_to_the_text_and_encode_alike():
    enc = plain()
    for text in ("ab cd  ef\n gh " * 40, "a" * 500, " " * 300 + "x y", "é à " * 90 + "b c d e f"):
        pieces = byte_bpe.safe_pieces(text, 16)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_empty_table(no_docs):
    assert byte_bpe.digests(byte_bpe.encode(no_docs, PATH, public_tokenizers.PATTERN)).collect() == []


def test_runs_of_white_space_are_merged_as_one_match():
    enc = byte_bpe.encoding(PATH, public_tokenizers.PATTERN)
    for text in ("ab " + " " * 400_000 + "x yz", "ab\n" + "\n" * 300_000 + " x", "ab" + " " * 300_000, " \n\t" * 100_000 + "x" * 70_000 + "　" * 70_000 + "q", " " * 65_536, "\x1c" * 70_000 + " " * 70_000 + "'s"):
        assert (byte_bpe.encode_text(enc, text) == enc.encode_to_numpy(text, disallowed_special=())).all()


def test_very_long_matches():
    """Of which the library's regex engine gives up on some; ids are the merge of the one match, and its last sign goes with the word after it."""
    enc = byte_bpe.encoding(PATH, public_tokenizers.PATTERN)
    for n in (1_000_000, 10_000_000):
        spaces = byte_bpe.encode_text(enc, "word" + " " * n + "word").tolist()
        assert spaces == [*enc.encode_ordinary("word"), *enc._encode_single_piece(" " * (n - 1)), *enc.encode_ordinary(" word")]
        assert byte_bpe.encode_text(enc, "\n" * n).tolist() == enc._encode_single_piece("\n" * n)
    for text in ("a" * 1_000_000, "a_" * 500_000, "!" * 1_000_000):
        assert enc.decode_bytes(byte_bpe.encode_text(enc, text).tolist()).decode() == text
