import pytest

from transecta.sources import readers


def test_exact_headers(spark, tmp_path):
    good, bad = tmp_path / "good.tsv", tmp_path / "bad.tsv"
    good.write_text("\t".join(readers.OCCURRENCES) + "\n" + "\t".join("abc123456") + "\n")
    bad.write_text("\t".join(readers.OCCURRENCES[::-1]) + "\n")
    assert readers.exact_table(spark, str(good), readers.OCCURRENCES).first()["latitude"] == "1"
    with pytest.raises(ValueError):
        readers.exact_table(spark, str(bad), readers.OCCURRENCES)


def test_fasta_and_headers(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_bytes(b">ID0 one\nACgt\nAC\n>ID1\n\nNNNN\n>ID2\n--AC")
    got = [(r["header"], r["sequence"]) for r in readers.fasta(spark, str(path)).orderBy("number").collect()]
    assert got == [("ID0 one", "ACGTAC"), ("ID1", "NNNN"), ("ID2", "--AC")]
    assert [r["header"] for r in readers.fasta_headers(spark, str(path)).orderBy("number").collect()] == ["ID0 one", "ID1", "ID2"]


def test_flat_files_stop_at_the_sequence(spark, tmp_path):
    path = tmp_path / "a.gb"
    path.write_text(
        'LOCUS  A\nACCESSION   AB1\nSOURCE x\n  ORGANISM  Abies alba\n            Eukaryota; Plantae;\n            Pinales.\nFEATURES\n     /lat_lon="1 N 2 E"\nORIGIN\n  1 acgt\nACCESSION   NO\n//\nLOCUS  B\nACCESSION   AB2\n//\n'
    )
    rows = {r["accession"]: r for r in readers.genbank(spark, str(path)).collect()}
    assert set(rows) == {"AB1", "AB2"}
    assert (rows["AB1"]["organism"], rows["AB1"]["taxonomy"], rows["AB1"]["lat_lon"]) == ("Abies alba", ["Eukaryota", "Plantae", "Pinales"], "1 N 2 E")


def test_required_columns_digests_and_bundles(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x,unit,y\n1,a,2.5\n2,b,3\n3,b,4\n")
    rows = readers.required_columns(spark, str(path), "unit string,y double")
    assert sorted(map(tuple, rows.collect())) == [("a", 2.5), ("b", 3.0), ("b", 4.0)]
    assert readers.at_least(rows, "unit", 2).count() == 2
    with pytest.raises(ValueError):
        readers.required_columns(spark, str(path), "z int")
    found = readers.file_digests(spark, str(path))
    manifest = found.select("path", found["sha256"].alias("expected")).unionByName(spark.createDataFrame([("gone", "0")], "path string, expected string"))
    assert [r["path"] for r in readers.changed_files(found, manifest).collect()] == ["gone"]
    readers.bundle({"rows": rows}, f"{tmp_path}/out")
    with pytest.raises(Exception):
        readers.bundle({"rows": rows}, f"{tmp_path}/out")
