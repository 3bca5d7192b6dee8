"""Numbered records for any size of byte range, and runs of shards that are stopped and started again."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from transecta.sources import records
from transecta.sources.ledger import Run


def plain(data):
    out, header = [], None
    for line in data.split(b"\n"):
        if line.startswith(b">"):
            header = line[1:].decode().strip()
            if header:
                out.append([header, ""])
        elif header and out:
            out[-1][1] += "".join(line.decode().split()).upper()
    return [tuple(x) for x in out]


def sample(seed):
    rng = random.Random(seed)
    parts = [rng.choice([b"", b"preface\n"])]
    for k in range(rng.randint(0, 12)):
        parts.append(b">" + rng.choice([b"", b" ", f"id{k} é".encode(), b"x>y"]) + rng.choice([b"\n", b"\r\n"]))
        parts += [rng.choice([b"", b"acgt-N", b"A>C", b" ac gt "]) + b"\n" for _ in range(rng.randint(0, 3))]
    data = b"".join(parts)
    return data if rng.random() < 0.5 else data.rstrip(b"\n")


@pytest.mark.parametrize("split", [5, 64, 1 << 20])
def test_ranges_of_any_size_number_alike(spark, tmp_path, split):
    want = set()
    for k in range(6):
        data = sample(k)
        (tmp_path / f"{k:02}.fa").write_bytes(data)
        want |= {(f"{k:02}.fa", n, *r) for n, r in enumerate(plain(data))}
    (tmp_path / "_hidden").write_bytes(b">no\nA")
    found = records.numbered(spark, str(tmp_path), split=split).collect()
    assert {(r["path"].split("/")[-1], r["number"], r["header"], r["sequence"]) for r in found} == want and len(found) == len(want)
    heads = records.numbered(spark, str(tmp_path), False, split)
    assert heads.columns == ["path", "number", "header"]
    assert {(r["path"].split("/")[-1], r["number"], r["header"]) for r in heads.collect()} == {x[:3] for x in want}


def test_every_cut_of_a_file():
    reader = records.RecordReader("", 1, True)
    for k in range(12):
        data = sample(k)
        for split in (1, 2, 3, 11, 10_000):
            with tempfile.NamedTemporaryFile() as f:
                f.write(data)
                f.flush()
                reader.path, reader.split = f.name, split
                rows = [r for part in reader.partitions() for batch in reader.read(part) for r in zip(*(c.to_pylist() for c in batch.columns[3:]))]
            assert rows == plain(data), (k, split)


def test_a_long_record_over_many_ranges_and_no_files(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one\n" + b"ACGT\n" * 200_000 + b">two\nA\n")
    found = {r["header"]: (r["number"], len(r["sequence"])) for r in records.numbered(spark, f"file://{tmp_path}/a.fa", split=5000).collect()}
    assert found == {"one": (0, 800_000), "two": (1, 1)}
    (tmp_path / "b").mkdir()
    assert records.numbered(spark, str(tmp_path / "b")).collect() == []
    with pytest.raises(Exception):
        records.numbered(spark, str(tmp_path / "none")).collect()


SCHEMA = "label string, replicate long, value double"


def plan_of(spark):
    return spark.range(12).select(F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("label"), F.floor(F.col("id") / 3).alias("replicate"))


def compute(shards):
    return shards.select("label", "replicate", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("label", "replicate", (F.hash("label", "replicate", "k") / 7.0).alias("value"))


def test_a_run_that_is_killed_goes_on_where_it_was(spark, tmp_path):
    whole = Run(spark, f"file://{tmp_path}/whole", SCHEMA)
    assert whole.results().count() == 0 and whole.resume(plan_of(spark), compute, 100) == 1
    broken, asked = Run(spark, f"file://{tmp_path}/broken", SCHEMA), []

    def failing(shards):
        asked.append({(r["label"], r["replicate"]) for r in shards.collect()})
        if len(asked) == 3:  # the rows are written, but the run ends before their commit
            compute(shards).write.parquet(f"{broken.path}/results/orphan")
            raise KeyboardInterrupt
        return compute(shards)

    with pytest.raises(KeyboardInterrupt):
        broken.resume(plan_of(spark), failing, 4)
    assert broken.lacking(plan_of(spark)).count() == 4
    again = Run(spark, broken.path, SCHEMA)
    assert again.resume(plan_of(spark), failing, 4) == 1 and again.resume(plan_of(spark), failing, 4) == 0
    assert sum(map(len, asked)) == 16 and asked[2] == asked[3] and not (asked[0] & asked[1])
    rows = lambda run: sorted(map(tuple, run.results().collect()))
    assert rows(again) == rows(whole) and len(rows(again)) == 36
    assert all(r["complete"] and r["found"] == 4 for r in again.audit(4).collect())


def test_a_retry_replaces(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}/run", SCHEMA)
    run.resume(plan_of(spark), compute, 100)
    shard = plan_of(spark).where("label = 'w1' AND replicate = 2")
    run.commit(shard, shard.select("label", "replicate", F.lit(0.5).alias("value")))
    found = run.results().where("label = 'w1' AND replicate = 2").collect()
    assert [r["value"] for r in found] == [0.5] and run.results().count() == 34
    assert all(r["complete"] and not r["duplicates"] for r in run.audit(4).collect())
