"""The subtitle data source, incremental runs, metadata of any shape, SQL functions and the live bridged blocks."""

import json
import os
import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from dialoom.functions import sql
from dialoom.functions.text import lexicon_score, timestamp, turn_type, word_count
from dialoom.operators import grouping, turns
from dialoom.sources import adapters, incremental, metadata, subtitles
from dialoom.streaming import live

DIR = "/root/testdata/sf0.001"


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def srt(k):
    return f"1\n00:00:0{k % 10},500 --> 00:00:1{k % 10},250\nline {k}\nsecond\n\nno times here\n\n2\n01:00:00,000 --> 01:00:01,000\n\n"


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    folder = tmp_path_factory.mktemp("srt")
    for k in range(1_000):
        (folder / f"d{k % 3}").mkdir(exist_ok=True)
        (folder / f"d{k % 3}" / f"f{k:04d}.srt").write_text(srt(k), encoding="utf-8")
    (folder / "other.txt").write_text(srt(1))
    return folder


def test_srt_source_reads_many_files_in_few_tasks(spark, many):
    subtitles.register(spark)
    df = spark.read.format("srt").option("taskBytes", 1_000_000).load(str(many))
    assert df.columns == ["file", "cue", "start_ms", "end_ms", "text"] and df.rdd.getNumPartitions() == 5
    rows = df.where("start_ms < 3600000").collect()
    assert len(rows) == 1_000 and df.count() == 2_000
    r = next(r for r in rows if r.file.endswith("f0007.srt"))
    assert (r.cue, r.start_ms, r.end_ms, r.text) == (1, 7_500, 17_250, "line 7\nsecond")


def test_srt_source_reads_wanted_columns_only(spark, many):
    subtitles.register(spark)
    df = spark.read.format("srt").schema("start_ms long, cue int").load(f"file://{many}/d0")
    assert df.columns == ["start_ms", "cue"] and df.where("start_ms = 3600000").count() == 334
    assert next(subtitles.cues(str(many / "d1" / "f0001.srt"), ["end_ms"])) == (11_250,)


def test_srt_source_of_odd_files(spark, tmp_path):
    subtitles.register(spark)
    (tmp_path / "a.srt").write_bytes(b"\xef\xbb\xbf1\r\n00:00:01,000 --> 00:00:02,000\r\nhi\r\n\r\n")
    (tmp_path / "b.srt").write_bytes(b"")
    (tmp_path / "c.srt").write_bytes(b"\xff\xfe broken --> no")
    df = spark.read.format("srt").load(str(tmp_path))
    assert [(r.cue, r.start_ms, r.text) for r in df.collect()] == [(1, 1_000, "hi")]
    assert spark.read.format("srt").load(str(tmp_path / "nowhere")).count() == 0


def test_srt_stream_reads_new_files(spark, tmp_path):
    subtitles.register(spark)
    where = tmp_path / "in"
    where.mkdir()
    (where / "a.srt").write_text(srt(1))
    q = spark.readStream.format("srt").load(str(where)).writeStream.format("memory").queryName("srt_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("srt_stream").count() == 2
        (where / "b.srt").write_text(srt(2))
        os.utime(where / "b.srt", (2_000_000_000, 2_000_000_000))
        q.processAllAvailable()
        assert spark.table("srt_stream").select("file").distinct().count() == 2 and spark.table("srt_stream").count() == 4
    finally:
        q.stop()


def test_video_files_are_listed_without_reading(spark, tmp_path):
    from dialoom.sources import files

    for name in ("b.mp4", "a.MKV", "c.txt", "d.mov.part"):
        (tmp_path / name).write_bytes(b"x" * 3)
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in files.video_files(spark, str(tmp_path)).collect()] == [("a.MKV", 3), ("b.mp4", 3)]


def test_incremental_runs_read_only_what_is_new(spark, tmp_path):
    data, store, worked = tmp_path / "data", str(tmp_path / "store"), []
    data.mkdir()
    for k in range(4):
        (data / f"{k}.txt").write_text("x" * (k + 1))

    def work(files):
        worked.append(sorted(os.path.basename(r.path) for r in files.collect()))
        return files.select("path", (F.col("length") * 10).alias("value"))

    files = lambda: incremental.inputs(spark, str(data))
    go = lambda p: incremental.run(files(), store, p, work)
    values = lambda p: sorted(r.value for r in incremental.results(files(), store, p).collect())
    assert go({"a": 1}) == 4 and go({"a": 1}) == 0 and len(worked) == 1 and values({"a": 1}) == [10, 20, 30, 40]
    (data / "3.txt").write_text("y" * 7)
    (data / "4.txt").write_text("z")
    assert go({"a": 1}) == 2 and worked[-1] == ["3.txt", "4.txt"] and values({"a": 1}) == [10, 10, 20, 30, 70]
    assert go({"a": 2}) == 5 and len(worked[-1]) == 5 and values({"a": 2}) == [10, 10, 20, 30, 70]
    assert go({"a": 2, "output_root": "elsewhere"}) == 0


def test_broken_run_is_replaced_by_the_next(spark, tmp_path):
    data, store = tmp_path / "data", str(tmp_path / "store")
    data.mkdir()
    (data / "a.txt").write_text("abc")
    work = lambda files: files.select("path", F.lit(1).alias("value"))
    files = incremental.inputs(spark, str(data))
    incremental.run(files, store, {}, work)
    before = incremental.results(files, store, {}).count()
    shutil.rmtree(f"{store}/manifest")  # as if it had ended before that
    assert incremental.run(files, store, {}, work) == 1 and incremental.results(files, store, {}).count() == before == 1


def test_metadata_of_any_shape_and_report_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seg = [{"start": 0.0, "end": 2.0, "text": "a"}, {"start": 1.5, "end": 3.25, "text": " "}]
    for name, value in {"x_subs": json.dumps({"segments": seg}), "y_subs": json.dumps(seg), "z_subs": "{broken", "w_subs": "{}"}.items():
        (tmp_path / "in" / f"{name}.json").write_text(value)
    files = metadata.read_any(spark, str(tmp_path / "in"))
    reports = metadata.caption_reports(files)
    assert shown(reports) == [("w_subs", 0, 0.0, 0, 0, False), ("x_subs", 2, 3.25, 1, 1, True), ("y_subs", 2, 3.25, 1, 1, True), ("z_subs", 0, 0.0, 0, 0, False)]
    out = str(tmp_path / "out")
    for _ in range(2):
        metadata.write_reports(reports, out)
    back = metadata.read_any(spark, out, "*.txt")
    assert back.count() == 4 and sorted(n for n in os.listdir(out) if n.startswith("stem")) == [f"stem={n}_subs_phase4_report" for n in "wxyz"]
    assert back.where(metadata.first_of(F.col("value"), ["$.duration"]) == 3.25).count() == 2
    assert spark.sql("SELECT 1 AS k").select(metadata.first_of(metadata.parsed(F.lit('{"a": "7"}')), ["$.b", "$.a"], "int", 3)).first()[0] == 7


def test_sql_functions_say_what_column_functions_say(spark):
    from dialoom.functions import lexicons

    sql.register(spark)
    texts = [None, "", "  two  words ", "What?", 'He said "no!"', "one two three four", "why»", "wait a moment please, look what is wrong?"]
    df = spark.createDataFrame([(t, 1_000 * i * 977) for i, t in enumerate(texts)], "text string, ms long")
    df.createOrReplaceTempView("said")
    a = spark.sql("SELECT ms, dl_turn_type(text) AS t, dl_word_count(text) AS n, dl_timestamp(ms) AS s, dl_hook_score(text) AS h FROM said")
    tidy = df.withColumn("text", F.coalesce("text", F.lit("")))
    b = tidy.select("ms", turn_type(F.col("text")).alias("t"), word_count(F.col("text")).alias("n"), timestamp(F.col("ms")).alias("s"), lexicon_score(F.col("text"), lexicons.HOOK).alias("h"))
    assert shown(a) == shown(b)
    assert "dl_" not in a._jdf.queryExecution().executedPlan().toString()  # inlined
    assert spark.sql("SELECT * FROM dl_grid(0L, 5L, 5L)").count() == 0 and shown(spark.sql("SELECT * FROM dl_grid(12L, 5L, 5L)")) == [(0, 5), (10, 12), (5, 10)]


def test_sql_runs_keep_sources_apart(spark):
    sql.register(spark)
    rows = [(1, "a", 0, 5), (1, "a", 5, 9), (1, None, 9, 11), (1, None, 11, 12), (1, "a", 12, 13), (2, "a", 0, 1)]
    spark.createDataFrame(rows, "source_id long, key string, start_ms long, end_ms long").createOrReplaceTempView("spoken")
    assert shown(spark.sql("SELECT * FROM dl_runs(TABLE(spoken) PARTITION BY source_id ORDER BY start_ms)")) == [(1, 1, "a", 0, 9, 2), (1, 2, None, 9, 12, 2), (1, 3, "a", 12, 13, 1), (2, 1, "a", 0, 1, 1)]


def test_live_bridged_blocks_equal_the_batch_ones(spark, tmp_path):
    """Turns in three batches, one turn too late; the state of idle sources is closed by timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    talk = turns.dialogue_turns(adapters.segments(spark, DIR)).where("source_id < 6")
    talk = talk.withColumn("at", F.timestamp_millis(F.col("start_ms") + 86_400_000)).select("source_id", "turn_id", "start_ms", "end_ms", "speaker", "text", "at")
    rows = sorted(talk.collect(), key=lambda r: (r.turn_id, r.source_id))
    cut = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]]
    late = rows[0].asDict()
    last = {**rows[-1].asDict(), "source_id": 99, "turn_id": 0, "start_ms": 10**9, "end_ms": 10**9 + 1}
    last["at"] = rows[0].at + timedelta(days=9)
    cut[2] = [*cut[2], late]
    where = str(tmp_path / "in")
    q = live.live_bridged_blocks(spark.readStream.schema(talk.schema).parquet(where + "/*"), late="10 minutes") if os.makedirs(where) is None else None
    for i, part in enumerate([*cut, [tuple(last[c] for c in talk.columns)]]):
        spark.createDataFrame([tuple(r) if not isinstance(r, dict) else tuple(r[c] for c in talk.columns) for r in part], talk.schema).coalesce(1).write.parquet(f"{where}/{i}")
        if i == 0:
            query = q.writeStream.outputMode("append").format("memory").queryName("bridged").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    found = spark.table("bridged").collect()
    batch = {(r.source_id, r.turn_id): r.block_no for r in grouping.bridged_blocks(talk).collect()}
    assert {(r.source_id, r.turn_id): r.block_no for r in found if r.kind == "turn" and r.source_id != 99} == batch
    assert [(r.source_id, r.turn_id) for r in found if r.kind == "late"] == [(late["source_id"], late["turn_id"])]
    closed = {r.source_id: r.block_no for r in found if r.kind == "closed"}
    assert closed and all(closed[s] <= max(b for (x, _), b in batch.items() if x == s) for s in closed)
