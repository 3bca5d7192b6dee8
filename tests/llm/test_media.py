import hashlib
import tarfile
import zlib

import pyarrow.fs as pafs

from transecta.llm import media


def test_png_round_trip():
    for text in ("", "a", "é" * 96, "x" * 192, "y" * 193):
        payload, n = media.payload_of(text)
        assert n == len(text.encode()) and len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == text.encode()
        stored = media.encode_png(payload)
        assert media.decode_png(stored) == payload
        assert media.read_header(stored[:33]) == (192, len(payload) // 192, 8, 0)


def test_rows_lead_to_what_is_stored(odd_docs, odd_texts, tmp_path):
    folder = f"file://{tmp_path}/media"
    rows = media.media_columns(odd_docs, folder).collect()
    assert len(rows) == odd_docs.count()
    fs, base = pafs.FileSystem.from_uri(folder)
    for r in rows:
        with fs.open_input_file(f"{base}/{r['shard']}") as f:
            stored = f.read_at(r["media_bytes"], r["offset"])
        payload = media.decode_png(stored)
        assert hashlib.sha256(stored).hexdigest() == r["media_sha256"] and hashlib.sha256(payload).hexdigest() == r["payload_sha256"] == r["digest"]
        assert len(payload) == r["payload_bytes"] and zlib.crc32(payload[-16:]) == r["tail_crc32"]
        if r["doc_id"] is not None and r["doc_id"] < len(odd_texts):
            assert payload[: r["n_bytes"]] == (odd_texts[r["doc_id"]] or "").encode()
    assert len({(r["digest"], r["shard"], r["offset"], r["feature"]) for r in rows}) == len({r["digest"] for r in rows})
    members = [m for p in (tmp_path / "media").iterdir() for m in tarfile.open(p).getmembers()]
    assert {m.name.split("/")[1][:-4] for m in members} == {r["digest"] for r in rows}


def test_headers_alone_fill_the_metadata(odd_docs, no_docs, tmp_path):
    folder = f"file://{tmp_path}/media"
    _, index = media.store(odd_docs, folder)
    found = media.read(index, folder, whole=False).collect()
    assert found and all((r["width"], r["bit_depth"]) == (192, 8) and r["height"] > 0 for r in found)
    assert media.media_columns(no_docs, f"file://{tmp_path}/none").collect() == []
