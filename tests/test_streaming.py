"""Messages: same rows as the batch, exactly once, also after a restart."""

from __future__ import annotations

import json

import pytest
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fiscora.plans import ingest_stream
from fiscora.sources.messages import publish, to_keyed_json
from fiscora.streaming import stream

SCHEMA = StructType([StructField("Provider CCN", StringType()),
                     StructField("Net (Income)", DoubleType())])


def write_messages(folder, values, name):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"key": "k", "value": v}) for v in values))


def record(i, income=1.5):
    return json.dumps({"Provider CCN": f"{i:06d}", "Net (Income)": income})


@pytest.mark.parametrize("n", [100, 101, 250])
def test_all_messages_arrive(spark, tmp_path, n):
    for start in range(0, n, 100):
        write_messages(tmp_path / "in", [record(i) for i in range(start, min(n, start + 100))],
                       f"{start:04d}.json")
    table, batches = ingest_stream.ingest(
        spark, stream.StreamConfig(location=str(tmp_path / "in"), files=1), SCHEMA,
        ingest_stream.StreamPaths.under(str(tmp_path / "out")))
    assert table.columns == ["Provider_CCN", "Net_Income"]
    assert table.select("Provider_CCN").distinct().count() == table.count() == n
    assert dict(table.dtypes)["Net_Income"] == "string"
    assert sorted(r["valid"] for r in batches.collect() if r["valid"]) == sorted(
        min(100, n - s) for s in range(0, n, 100))


def test_every_micro_batch_is_counted(spark, tmp_path):
    """More batches than a query remembers of its own progress."""
    for i in range(110):
        write_messages(tmp_path / "in", [record(i), "{broken"], f"{i:04d}.json")
    table, batches = ingest_stream.ingest(
        spark, stream.StreamConfig(location=str(tmp_path / "in"), files=1), SCHEMA,
        ingest_stream.StreamPaths.under(str(tmp_path / "out")))
    told = batches.collect()
    assert len(told) == 110 and all((r["valid"], r["rejected"]) == (1, 1) for r in told)
    assert table.count() == 110


def test_no_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table, batches = ingest_stream.ingest(
        spark, stream.StreamConfig(location=str(tmp_path / "in")), SCHEMA,
        ingest_stream.StreamPaths.under(str(tmp_path / "out")))
    assert table.count() == batches.count() == 0


def test_malformed_missing_and_extra(spark, tmp_path):
    write_messages(tmp_path / "in", [
        record(1), "{broken", '{"Provider CCN": "000002"}',
        '{"Provider CCN": "000003", "Net (Income)": null, "More": 1}',
        '{"Provider CCN": "000004", "Net (Income)": "a lot"}', None], "a.json")
    paths = ingest_stream.StreamPaths.under(str(tmp_path / "out"))
    table, _ = ingest_stream.ingest(
        spark, stream.StreamConfig(location=str(tmp_path / "in")), SCHEMA, paths)
    got = {r["Provider_CCN"]: r["Net_Income"] for r in table.collect()}
    # Missing stays NULL, never the text of it.
    assert got == {"000001": "1.5", "000002": None, "000003": None}
    rejected = {r["value"] for r in spark.read.parquet(paths.rejected).collect()}
    assert rejected == {"{broken", '{"Provider CCN": "000004", "Net (Income)": "a lot"}', None}


def test_restart_continues_after_the_last_batch(spark, tmp_path):
    paths = ingest_stream.StreamPaths.under(str(tmp_path / "out"))
    cfg = stream.StreamConfig(location=str(tmp_path / "in"))
    for part in range(3):
        write_messages(tmp_path / "in", [record(i) for i in range(part * 50, part * 50 + 50)],
                       f"{part}.json")
        table, _ = ingest_stream.ingest(spark, cfg, SCHEMA, paths)
        assert table.count() == (part + 1) * 50
    table, _ = ingest_stream.ingest(spark, cfg, SCHEMA, paths)
    assert table.groupBy("Provider_CCN").count().filter("count <> 1").count() == 0
    with pytest.raises(ValueError, match="outside"):
        stream.append_bronze_stream(table, "/x/out", "/x/out/progress")


def test_counts_accumulate(spark, tmp_path):
    write_messages(tmp_path / "in", [record(i % 3) for i in range(30)], "a.json")
    source = stream.stream_source(spark, stream.StreamConfig(location=str(tmp_path / "in")))
    valid, _ = stream.decode_json(source, SCHEMA)
    out, progress = str(tmp_path / "counts"), str(tmp_path / "progress")
    stream.stream_counts(valid, ["Provider CCN"], out, progress)
    write_messages(tmp_path / "in", [record(0)] * 5, "b.json")
    stream.stream_counts(valid, ["Provider CCN"], out, progress)
    assert sorted(r["records"] for r in stream.latest_counts(
        spark, out, ["Provider CCN"]).collect()) == [10, 10, 15]


def folders(path):
    return sorted(p.name for p in path.glob("micro_batch=*")) if path.exists() else []


def test_counts_are_compacted(spark, tmp_path):
    """Many batches leave few folders, and every read finds all counts."""
    out = tmp_path / "counts"
    for i in range(23):
        write_messages(tmp_path / "in", [record(i % 4), record(9)], f"{i:03d}.json")
    source = stream.stream_source(spark, stream.StreamConfig(location=str(tmp_path / "in"), files=1))
    valid, _ = stream.decode_json(source, SCHEMA)
    stream.stream_counts(valid, ["Provider CCN"], str(out), str(tmp_path / "progress"), compact_every=4)
    # Batches 0 to 22; snapshots 15 and 19, and the batches that 15 does not cover.
    assert folders(out / "_snapshots") == ["micro_batch=15", "micro_batch=19"]
    assert folders(out) == [f"micro_batch={n}" for n in range(16, 23)]
    want = {f"{k:06d}": n for k, n in ((0, 6), (1, 6), (2, 6), (3, 5), (9, 23))}
    def read():
        return {r[0]: r["records"] for r in stream.latest_counts(spark, str(out), ["Provider CCN"]).collect()}
    assert read() == want
    # Doing a batch again, or a crash inside a compaction, changes nothing.
    stream.compact_counts(spark, str(out), ["Provider CCN"], 19)
    assert read() == want
    (out / "_snapshots" / "micro_batch=19" / "_SUCCESS").unlink()
    assert read() == want
    stream.compact_counts(spark, str(out), ["Provider CCN"], 22)
    assert read() == want


def test_keyed_json_and_order(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", float("nan") if i == 4 else float(i))
            for i in range(400)] + [(400, None, 1.0)]
    df = spark.createDataFrame(rows, "seq int, ccn string, v double").repartition(5)
    keyed = to_keyed_json(df, "ccn", keep=["seq"])
    values = {json.loads(r["value"])["seq"]: r for r in keyed.collect()}
    assert json.loads(values[4]["value"])["v"] is None
    assert values[400]["key"] == "unknown" and json.loads(values[400]["value"])["ccn"] is None
    assert {r["key"] for r in to_keyed_json(df, "absent").collect()} == {"unknown"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        publish(keyed, "files", str(tmp_path / "topic"), order=["seq"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "topic").glob("part-*.json"))
    assert len(files) > 1
    last = {}
    for f in files:
        for line in f.read_text().splitlines():
            message = json.loads(line)
            seq = json.loads(message["value"])["seq"]
            assert seq > last.get(message["key"], -1)
            last[message["key"]] = seq
    with pytest.raises(ValueError, match="sink"):
        publish(keyed, "pipe", "x")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"{i:06d}", i / 4) for i in range(60)],
                               "`Provider CCN` string, `Net (Income)` double")
    publish(to_keyed_json(df, "Provider CCN"), "files", str(tmp_path / "in"))
    table, _ = ingest_stream.ingest(
        spark, stream.StreamConfig(location=str(tmp_path / "in")), SCHEMA,
        ingest_stream.StreamPaths.under(str(tmp_path / "out")))
    want = stream.as_text(df)
    assert table.exceptAll(want).count() == 0 and want.exceptAll(table).count() == 0
