"""Readers, sinks, streams, and that every registered query has SQL of the same columns or is known to have none."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from framelode.plans import registry
from framelode.sources import readers, sinks
from framelode.streaming import streams


def test_scan_reads_each_path_once(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.mp4").write_bytes(b"x" * 70_000)
    (tmp_path / "sub" / "b.jpg").write_bytes(b"y")
    got = readers.scan_files(spark, [str(tmp_path), str(tmp_path / "sub")], content=True).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.size_bytes) for r in got) == [("a.mp4", 70_000), ("b.jpg", 1)]
    kind, status, reason = readers.media_kind(F.col("n"), F.col("s"), F.col("s").isNull())
    names = [("A.MP4", 1), ("b.jpg", 0), (".DS_Store", 5), ("c", 4), ("d.xmp", None), ("e.xmp", 3), ("f.M2TS", 1), ("g.cr2", 1), ("h.webm", 1), ("i.srt", 1), ("j.7z", 1), (".mov", 1), ("k.", 1), ("l.opus", 1)]
    df = spark.createDataFrame(names, "n string, s long")
    assert [tuple(r) for r in df.select(kind, status, reason).collect()] == [
        ("video", "supported", ""), ("unsupported", "unsupported", "zero_byte_file"), ("unsupported", "unsupported", "system_sidecar_ignored_name"), ("unsupported", "unsupported", "missing_extension"), ("unsupported", "blocked", "stat_failed"),
        ("metadata_sidecar", "metadata_sidecar", "linked_metadata_sidecar_not_processing_queue"), ("video", "supported", ""), ("image", "supported", ""), ("unsupported", "unsupported", "unsupported_extension:.webm"), ("text", "supported", ""),
        ("unsupported", "unsupported", "archive_or_disk_image_not_processed"), ("unsupported", "unsupported", "missing_extension"), ("unsupported", "unsupported", "missing_extension"), ("audio", "supported", ""),
    ]


def test_rows_in_any_notation(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x;y,z\n1;2\n")
    (tmp_path / "b.jsonl").write_text('{"x": 1}\nnot json\n')
    assert readers.read_rows(spark, str(tmp_path / "a.txt")).collect()[0].asDict() == {"x": "1", "y,z": "2"}
    assert {(r.x, r._corrupt_record) for r in readers.read_rows(spark, str(tmp_path / "b.jsonl")).collect()} == {(1, None), (None, "not json")}


def test_vectors_are_checked(spark, tmp_path):
    def row(i, v, run="r", unit=None, sha=None):
        return {"embedding_id": i, "visual_unit_id": unit or f"u{i[1:]}", "vector": v, "run_id": run, "vector_sha256": sha or hashlib.sha256(json.dumps(v, separators=(",", ":")).encode()).hexdigest()}

    path, odd = str(tmp_path / "v.jsonl"), [0.6000000000000001, 0.7999999999999999]
    rows = [row("e1", [1.0, 0.0]), row("e2", [2.0, 0.0]), row("e3", [0.0, 1.0], run="old"), row("e4", odd), row("e4", odd), row("e6", [0.0, 1.0], sha="0" * 64), row("e7", [0.0, 1.0], unit="u1"), row("e8", odd)]
    (tmp_path / "v.jsonl").write_text("\n".join(map(json.dumps, rows)))
    index = spark.createDataFrame([(f"e{i}", f"u{i}") for i in range(1, 9)], "embedding_id string, visual_unit_id string")
    got = {r.embedding_id: r.problem for r in readers.check_vectors(spark, path, index, "r", 2).collect()}
    assert got == {"e1": None, "e2": "invalid", "e3": "invalid", "e4": "duplicate", "e5": "missing", "e6": "invalid", "e7": "invalid", "e8": None}
    with pytest.raises(ValueError, match="duplicate=1, invalid=4, missing=1"):
        readers.read_vectors(spark, path, index, "r", 2)
    assert sorted((r.embedding_id, r.vector) for r in readers.read_vectors(spark, path, index.where("embedding_id in ('e1', 'e8')"), "r", 2).collect()) == [("e1", [1.0, 0.0]), ("e8", odd)]
    lenient = readers.lenient_vectors(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>"), "v")
    assert [r.v for r in lenient.collect()] == [[0.6, 0.8]]


def test_commits_are_idempotent_and_snapshots_hold(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    path = str(tmp_path / "t")
    assert [sinks.commit_once(df, path), sinks.commit_once(df.orderBy(F.desc("i")), path), sinks.commit_once(df.union(df), path)] == ["COMMITTED", "IDEMPOTENT_PASS", "COMMITTED"]
    other = spark.createDataFrame([(1, "b"), (2, None)], "i int, s string")
    assert sinks.table_digest(other) != sinks.table_digest(df) == sinks.table_digest(df.repartition(3))
    fs, _ = sinks._fs(spark, path)
    fs.rename(sinks._fs(spark, path)[1], sinks._fs(spark, f"{path}.before")[1])  # a commit that was cut off before its rename
    assert sinks.restore(spark, path) and spark.read.parquet(path).count() == 4 and not sinks.restore(spark, path)
    sinks.snapshot(df, str(tmp_path / "s"))
    assert sinks.read_snapshot(spark, str(tmp_path / "s")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.snapshot(df, str(tmp_path / "s"))
    df.write.mode("append").parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, str(tmp_path / "s"))


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _run(spark, made, name, mode="append"):
    q = made.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a", 1, 0), ("a", 2, 4000), ("a", 3, 5000), ("b", 4, 0), ("a", 5, 9999), ("a", 6, 10_000)]
    s = _stream(spark, str(tmp_path / "x"), rows, "k string, i long, ms long")
    assert _run(spark, streams.spaced(s, "k", "i", "ms", 5000), "spaced") == [("a", 1, 0), ("a", 3, 5000), ("a", 6, 10_000), ("b", 4, 0)]
    timed = s.withColumn("ts", F.timestamp_millis("ms"))
    assert [r[2:] for r in _run(spark, streams.windowed(timed, "ts", "k", "5 seconds"), "windowed", "complete")] == [("a", 2), ("b", 1), ("a", 2), ("a", 1)]
    assert sorted(r[2:] for r in _run(spark, streams.sessions(timed, "ts", "k", "4500 milliseconds"), "sessions", "complete")) == [("a", 2), ("a", 3), ("b", 1)]
    q = streams.write_once(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_every_query_gives_columns(spark):
    d = "/root/testdata/sf0.001"
    made, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(made) and len(sql) > 100
    for name in ("hybrid_search", "density_selection", "unit_documents", "gap_sessions"):
        assert made[name](spark, d).columns


def test_lost_rows_come_back_from_a_manifest(spark):
    table, manifest = spark.createDataFrame([("a", 1)], "k string, n int"), spark.createDataFrame([("a", 9), ("b", 2), ("b", 2), ("c", 3)], "k string, n int")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "k string")
    assert sorted(tuple(r) for r in sinks.restore_missing(table, "k", asked, manifest).collect()) == [("a", 1), ("b", 2)]
