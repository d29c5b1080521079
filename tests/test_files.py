import gzip
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from walkmoments import cli
from walkmoments.operators import fingerprint, moments, reporting, sampling, search
from walkmoments.operators.graph import Graph
from walkmoments.sources import files, store
from walkmoments.streaming import edits

PAW = [(0, 1), (1, 2), (0, 2), (2, 3)]


def test_edge_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,v\n# note\n1,0\n2, 3\n")
    (tmp_path / "b.txt").write_text("# c\n0 1\n1\t2\n\n")
    assert sorted(map(tuple, files.read_edges(spark, f"{tmp_path}/a.csv").collect())) == [(1, 0), (2, 3)]
    assert sorted(map(tuple, files.read_edges(spark, f"{tmp_path}/b.txt").collect())) == [(0, 1), (1, 2)]
    (tmp_path / "bad.csv").write_text("u,v\nx,y\n0,1\n")
    with pytest.raises(ValueError):
        files.read_edges(spark, f"{tmp_path}/bad.csv")
    with gzip.open(f"{tmp_path}/c.txt.gz", "wt") as f:
        f.write("# raw\n10 20\n20 10\n10 10\n700 20\n5\n")
    g = files.read_relabelled(spark, f"{tmp_path}/c.txt.gz")
    assert g.n == 3 and sorted(map(tuple, g.edges.collect())) == [(0, 1), (1, 2)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.csv").write_text("".join(f"{u},{v}\n" for u, v in PAW))
    (tmp_path / "c.csv").write_text("u,v\n2,0\n3,2\n")
    out = f"{tmp_path}/deep/out.csv"
    assert cli.main(["delta-delete", "--edge-list", f"{tmp_path}/g.csv", "--num-nodes", "4", "--candidates", f"{tmp_path}/c.csv", "--output", out]) == 0
    lines = open(out).read().split()
    assert lines[0] == "u,v,delta_m2,delta_m3" and [x[:4] for x in lines[1:]] == ["0,2,", "2,3,"] and "2 rows" in capsys.readouterr().out


def test_tables_and_figures(spark, tmp_path):
    path = f"{tmp_path}/x/rows.csv"
    files.write_rows([{"a": 1}, {"a": 2, "b": "z"}], path)
    files.write_rows([{"a": 3, "b": "y"}], path, ["a", "b"], append=True)
    assert [tuple(r) for r in files.read_rows(spark, path).collect()] == [("1", None), ("2", "z"), ("3", "y")]
    with pytest.raises(FileNotFoundError):
        files.read_rows(spark, f"{tmp_path}/none.csv")
    files.write_rows([], f"{tmp_path}/empty.csv")
    assert not os.path.exists(f"{tmp_path}/empty.csv")
    g = Graph(spark.createDataFrame(PAW, "u long, v long"), 4)
    svg = fingerprint.save_svg(g, f"{tmp_path}/f/p.svg", step=10.0)
    assert open(svg).read().startswith("<svg")
    with pytest.raises(ValueError):
        fingerprint.save_svg(g, f"{tmp_path}/p.bmp")
    grid = fingerprint.density(fingerprint.profile(g), 10.0, 5.0)
    assert grid.agg(F.sum("prob")).first()[0] == pytest.approx(1.0) and grid.count() == 36
    none = fingerprint.density(fingerprint.profile(Graph(g.edges.limit(0), 4)), 90.0)
    assert [r.prob for r in none.collect()] == [0.0] * 4
    made = search.sample_by_moments(g.edges, 4, budget=2, checkpoints=(0, 2))
    shots = spark.createDataFrame([(s, k, m) for s, x in made.snapshot_moments.items() for k, m in x.items()], "step int, k int, m double")
    files.write_snapshots(made.snapshots, shots, f"{tmp_path}/snap")
    back, rows = files.read_snapshots(spark, f"{tmp_path}/snap")
    assert back.count() == made.snapshots.count() and rows.count() == 4


def test_reporting_helpers(spark):
    assert reporting.budgets(10, [0.05, 0.3, 1.0]) == [1, 3, 10] and reporting.checkpoint_steps(10, 0.5, 0.25) == [0, 2, 5]
    assert reporting.snapshot_id(3, 0.05, 12, 1) == "dir03_ratio050000_bud00012_rep01"
    rows = spark.createDataFrame([(1, 1), (2, 1)], "k int, s int")
    assert reporting.merged_shards([rows], ["k"], rows).count() == 2
    for shards, expected in (([rows, rows], rows), ([rows], rows.filter("k = 1")), ([rows.filter("k = 1")], rows)):
        with pytest.raises(ValueError):
            reporting.merged_shards(shards, ["k"], expected)


def test_sampling_facts(spark):
    g = Graph(spark.createDataFrame([(i, j) for i in range(20) for j in range(i + 1, 20) if (i * j) % 3], "u long, v long"), 20).cached()
    size = g.edges.count()
    one, two = (sorted(map(tuple, sampling.subsample(g.edges.repartition(k), 10, 3).collect())) for k in (2, 5))
    assert one == two and len(one) == 10
    assert sampling.non_edges(g, -1, 0).count() == 190 - size
    weighted = g.edges.withColumn("w", F.lit(1.0)).withColumn("prob", F.lit(1.0 / size))
    assert sampling.weighted_without_replacement(weighted, 7, 1).count() == 7
    assert sampling.weighted_without_replacement(weighted, 999, 1).count() == size
    assert sampling.weighted_with_replacement(weighted, 400, 1).agg(F.sum("count")).first()[0] == pytest.approx(400, abs=1)
    parts = {r.part: r["count"] for r in sampling.split_nodes(g, 1).groupBy("part").count().collect()}
    assert parts == {"train": 2, "test": 16, "valid": 2}


def test_stream_of_edits(spark, tmp_path):
    for k, rows in enumerate(([("add", 0, 1, 1), ("add", 1, 2, 2)], [("add", 2, 0, 3), ("delete", 1, 0, 4)])):
        spark.createDataFrame(rows, "op string, u long, v long, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema("op string, u long, v long, seq long").parquet(f"{tmp_path}/in/part=*")
        edits.follow(stream, 3, f"{tmp_path}/out").awaitTermination(120)
    got = {(r.batch, r.k): r.m for r in spark.read.parquet(f"{tmp_path}/out/moments").collect()}
    path = Graph(spark.createDataFrame([(1, 2), (0, 2)], "u long, v long"), 3)
    assert got[1, 2] == pytest.approx(moments.compute_moments(path)[2])


def test_files_by_uri_are_replaced_whole(spark, tmp_path):
    home = f"file://{tmp_path}/deep"
    deltas = spark.range(500).select((F.col("id") % 7).alias("u"), (F.col("id") + 10).alias("v"), (F.col("id") / 4).alias("delta_m2")).repartition(5)
    for count in (500, 3):  # the second takes the first one's place
        assert files.write_deltas(deltas.limit(count) if count < 500 else deltas, f"{home}/d.csv") == count
    lines = open(f"{tmp_path}/deep/d.csv").read().split()
    assert lines[0] == "u,v,delta_m2" and len(lines) == 4
    assert files.write_deltas(deltas, f"{home}/d.csv") == 500
    back = [tuple(map(int, x.split(",")[:2])) for x in open(f"{tmp_path}/deep/d.csv").read().split()[1:]]
    assert back == sorted(back) and len(back) == 500
    files.write_json({"b": 1, "a": tmp_path}, f"{home}/x.json")
    files.write_json({"b": [1, "é"]}, f"{home}/x.json")
    assert store.read_text(f"{home}/x.json") == '{\n  "b": [\n    1,\n    "\\u00e9"\n  ]\n}'
    files.write_rows([{"a": "x,y", "b": 'q"'}], f"{home}/r.csv")
    files.write_rows([{"a": 1}], f"{home}/r.csv", ["a", "b"])
    assert [tuple(r) for r in files.read_rows(spark, f"{home}/r.csv").collect()] == [("1", None)]
    assert sorted(x for x in os.listdir(f"{tmp_path}/deep") if not x.endswith(".crc")) == ["d.csv", "r.csv", "x.json"]


def test_two_appending_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log.csv"

    def write(k):
        for i in range(8):
            files.write_rows([{"who": k, "i": i}], path, append=True)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    rows = [tuple(map(int, r)) for r in files.read_rows(spark, path).collect()]
    assert sorted(rows) == [(k, i) for k in range(3) for i in range(8)]
    with store.locked(path), pytest.raises(TimeoutError), store.locked(path, wait=0.2):
        pass
    files.write_rows([{"who": 9, "i": 9}], path, append=True)
    assert files.read_rows(spark, path).count() == 25


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    path = f"file://{tmp_path}/d.csv"
    rows = spark.range(5).select(F.col("id").alias("u"), F.col("id").alias("v"))
    files.write_deltas(rows, path)
    with pytest.raises(Exception):
        files.write_deltas(rows.withColumn("delta_m2", F.raise_error(F.lit("lost")).cast("double")), path)
    assert open(f"{tmp_path}/d.csv").read().split() == ["u,v", *[f"{i},{i}" for i in range(5)]]
    assert [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == ["d.csv"]
