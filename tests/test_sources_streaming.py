import os

import pytest
from pyspark.sql import functions as F

from mosaicq.operators import graph
from mosaicq.sources import readers, sinks
from mosaicq.streaming import watch, windows


def test_names(spark):
    df = spark.createDataFrame([("C001-T0002-cy3-Z003.tif",), ("C010-T0100-DAPI-Z000.tif",), ("notes.txt",)], "name string")
    got = sorted((r.cycle, r.tile, r.channel, r.z) for r in readers.parsed_names(df).collect())
    assert got == [(1, 2, "cy3", 3), (10, 100, "DAPI", 0)]


def test_positions_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a_001.tif", 0.9, 120, 35, 0, 0), ("a_002.tif", float("nan"), -4, 0, 1, 0)], "file string, corr double, x int, y int, grid_c int, grid_r int")
    sinks.write_positions(rows, f"{tmp_path}/p")
    got = sorted(tuple(r) for r in readers.read_positions(spark, f"{tmp_path}/p").collect())
    assert got == [("a_001.tif", 0.9, 120, 35, 0, 0), ("a_002.tif", -1.0, -4, 0, 1, 0)]


def test_offsets(spark):
    wide = spark.createDataFrame([(1, "0 0", " -3   12 "), (3, "4 5", None)], "cycle int, `a.tif` string, `b.tif` string".replace(".", "_"))
    got = sorted(tuple(r) for r in readers.offsets_long(wide).collect())
    assert got == [(1, "a_tif", 0, 0), (1, "b_tif", -3, 12), (3, "a_tif", 4, 5)]


def test_tables_and_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "y int, x double")
    sinks.write_ints(df, f"{tmp_path}/ints/a")
    open(f"{tmp_path}/ints/empty.csv", "w").close()
    assert sorted(tuple(r) for r in readers.read_int_blocks(spark, f"{tmp_path}/ints/*", ["y", "x"]).collect()) == [(1, 2), (2, 4)]
    with open(f"{tmp_path}/i.csv", "w") as f:
        f.write(",Y,X\n0,5,6\n1,7,8\n")
    assert readers.read_csv(spark, f"{tmp_path}/i.csv", index=True).columns == ["Y", "X"]
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/i.csv", "y int, x int", index=True).collect()] == [(5, 6), (7, 8)]
    assert readers.read_indexed(spark, f"{tmp_path}/i.csv").columns == ["index", "Y", "X"]
    with open(f"{tmp_path}/a.loc4", "w") as f:
        f.write("x_in_pix\ty_in_pix\tz_in_pix\tintegratedIntensity\n1.5\t2.4\t3.0\t9\n")
    assert tuple(readers.read_localisations(spark, f"{tmp_path}/a.loc4").first()) == (1, 1, 2, 9.0)
    with open(f"{tmp_path}/book.csv", "w") as f:
        f.write(",gene_name\nP_1,Abc\n")
    assert tuple(readers.read_codebook(spark, f"{tmp_path}/book.csv").first()) == ("P_1", "Abc")
    sinks.append_csv(df, f"{tmp_path}/app")
    sinks.append_csv(df, f"{tmp_path}/app")
    assert spark.read.option("header", True).csv(f"{tmp_path}/app").count() == 4
    sinks.write_table(df.withColumn("run", F.lit(1)), f"{tmp_path}/t", ["run"])
    sinks.write_table(df.limit(1).withColumn("run", F.lit(2)), f"{tmp_path}/t", ["run"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    sinks.write_parameters(spark, {"a": {"b": [1]}}, f"{tmp_path}/par")
    assert spark.read.text(f"{tmp_path}/par").first().value == '{"a": {"b": [1]}}'
    sinks.write_run_metadata(spark, "r1", "s", {"x": 1}, f"{tmp_path}/meta")
    assert spark.read.parquet(f"{tmp_path}/meta").count() == 1
    with open(f"{tmp_path}/p.yaml", "w") as f:
        f.write("b: 2\n")
    pytest.importorskip("yaml")
    assert readers.read_parameters(f"{tmp_path}/p.yaml", {"a": 1, "b": 0}, {"c": 3}) == {"a": 1, "b": 2, "c": 3}


def test_watcher_takes_finished_cycles_once(spark, tmp_path):
    root, done = tmp_path / "run", set()
    calls = []

    def finish(n):
        (root / f"cyc_{n}").mkdir(parents=True)
        (root / f"cyc_{n}" / "finish.txt").write_text("x")

    for n in (0, 1, 3):
        finish(n)
    (root / "cyc_5").mkdir()

    def process(_, cycle, path):
        calls.append((cycle, os.path.basename(path)))
        done.add(cycle)

    def run():
        watch.run_available(watch.finished_cycles(spark, f"file://{root}"), process, done.__contains__, f"{tmp_path}/ck")

    run()
    assert calls == [(1, "cyc_1"), (3, "cyc_3")]
    (root / "cyc_5" / "finish.txt").write_text("x")
    run()
    run()
    assert calls[2:] == [(5, "cyc_5")]
    now = [0.0]

    def sleep(s):
        now[0] += s

    n = watch.run_until_idle(watch.finished_cycles(spark, f"file://{root}"), process, done.__contains__, f"{tmp_path}/ck2", 300, 600, lambda: now[0], sleep)
    assert n == 0 and now[0] == 600
    spark.range(1).write.parquet(f"{tmp_path}/stage")
    assert watch.stage_exists(spark, f"{tmp_path}/stage")
    watch.drop_stages(spark, [f"{tmp_path}/stage"])
    assert not watch.stage_exists(spark, f"{tmp_path}/stage")


def test_stream_equals_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = windows.tumbling(events, "1 hour")
    assert sorted(map(repr, spark.table("tumbled").select("start", "event_type", "n").collect())) == sorted(map(repr, want.select("start", "event_type", "n").collect()))


def test_components_and_seams(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.connected_components(edges).collect()} == {(i, 0) for i in range(31)} | {(50, 50), (60, 50)}
    px = spark.createDataFrame([("A", 0, 0, 1), ("A", 0, 1, 1), ("B", 0, 1, 4), ("B", 0, 2, 4), ("B", 5, 5, 2)], "block string, y int, x int, label int")
    got = {(r.y, r.x): r.label for r in graph.merged_labels(px).collect()}
    assert got[0, 0] == got[0, 1] == got[0, 2] != got[5, 5]
    corner = spark.createDataFrame([(b, 9, 9, 1) for b in "012"] + [("1", 9, 10, 1), ("2", 10, 9, 1), ("0", 8, 8, 1)], px.schema)
    assert {r.label for r in graph.merged_labels(corner).collect()} == {"0:1"}


def test_files_of_parameters():
    assert readers.files_of({"fileProcessingMode": "singleFile", "dataFileName": "a/b.tif"}) == ["a/b.tif"]
    batch = {"fileProcessingMode": "batch", "dataFileName": "in/", "threshLevel": {"cy3": 1, "FAM": 2}}
    assert readers.files_of(batch) == ["in/cy3.tif", "in/FAM.tif"]
    with pytest.raises(ValueError):
        readers.files_of({**batch, "fileProcessingMode": "other"})
