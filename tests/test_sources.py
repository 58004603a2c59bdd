"""Files, streams and the command line."""

import numpy as np

from gridloom.operators import fields
from gridloom.plans.commands import main, random_field
from gridloom.sources import files
from gridloom.streaming.windows import reduce_batches, window_stats


def test_commands_round_trip(spark, tmp_path):
    u = random_field((17, 9))
    (tmp_path / "in").mkdir()
    u.astype("<f8").tofile(tmp_path / "in" / "a.bin")
    main(["compress", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "c"), "--shape", "17x9", "--tolerance", "0.01"], spark)
    main(["decompress", "--input", str(tmp_path / "c"), "--output", str(tmp_path / "d")], spark)
    back = np.array(spark.read.parquet(str(tmp_path / "d")).first()["data"])
    assert np.abs(back - u.ravel()).max() <= 0.01


def test_refactor_reads_only_what_it_needs(spark, tmp_path):
    u = random_field((65,))
    (tmp_path / "in").mkdir()
    u.tofile(tmp_path / "in" / "a.bin")
    main(["refactor", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "f")], spark)
    main(["reconstruct", "--input", str(tmp_path / "f"), "--output", str(tmp_path / "r"), "--tolerance", "1", "0.001"], spark)
    errors = [np.abs(np.array(spark.read.parquet(f"{tmp_path}/r/tolerance={t}").first()["data"]) - u).max() for t in ("1", "0.001")]
    assert errors[1] <= errors[0] and errors[1] < 0.01
    plan = files.read_fragments(spark, str(tmp_path / "f"), level=2, stop=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


def test_blocks_refine(spark):
    data = spark.createDataFrame([(1, random_field((33,)).tolist()), (2, [0.0] * 33)], "block_id long, data array<double>")
    fragments = fields.refactor(data)
    plan = fields.request(fragments, 1e-4)
    got = {r["block_id"]: r["data"] for r in fields.refine(fragments, plan).collect()}
    assert np.abs(np.array(got[1]) - random_field((33,))).max() < 1e-3


def test_gmsh(spark, tmp_path):
    (tmp_path / "m.msh").write_text("$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n3\n1 0 0 0\n2 1 0 0\n3 0 1 0\n$EndNodes\n$Elements\n2\n1 1 2 0 1 1 2\n2 2 2 0 1 1 2 3\n$EndElements\n")
    nodes, elements = files.read_gmsh(spark, str(tmp_path / "m.msh"))
    assert nodes.count() == 3
    assert {r["kind"]: r["nodes"] for r in elements.collect()} == {"line": [1, 2], "tri": [1, 2, 3]}


def test_seeded(spark):
    assert files.seeded(spark, 100).filter("value < 1 or value > 10 or value != floor(value)").count() == 0


def test_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").write_bytes(open(f"{sf_dir}/events.parquet", "rb").read())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = reduce_batches(stream, "user_id", ["ts", "event_id"], "value", 5.0, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    stats = window_stats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("cast(ts as timestamp) as ts", "value"), "ts", "value")
    assert stats.isStreaming


def test_level_files_and_raw_files(spark, tmp_path):
    """Fragments in files of a level come back by ranges, those of a request only; raw blocks come back as they were."""
    data = spark.createDataFrame([(i, random_field((40 + i,)).tolist()) for i in range(5)], "block_id long, data array<double>")
    for codec in ("raw", "zstd", "adaptive"):
        fragments = fields.refactor(data, level_codec=codec)
        files.write_levels(fragments, f"file://{tmp_path}/{codec}", parts=2).write.parquet(f"{tmp_path}/{codec}-index")
        index = spark.read.parquet(f"{tmp_path}/{codec}-index")
        want = {(r["block_id"], r["level"], r["bitplane"]): bytes(r["payload"]) for r in fragments.collect()}
        got = {(r["block_id"], r["level"], r["bitplane"]): bytes(r["payload"]) for r in files.read_ranges(index, f"file://{tmp_path}/{codec}").collect()}
        assert got == want and index.select("file").distinct().count() == 2 * index.select("level").distinct().count()
        for s in (None, 0.0, 1.0):
            plan = fields.request(index, 1e-3, s)
            part = files.read_ranges(index.join(plan, ["block_id", "level"]).filter("bitplane < planes").drop("planes"), f"file://{tmp_path}/{codec}")
            back = {r["block_id"]: r["data"] for r in fields.refine(part, plan).collect()}
            assert all(np.abs(np.array(back[i]) - random_field((40 + i,))).max() < 0.1 for i in range(5))
    assert files.write_raw(data, f"{tmp_path}/raw-files").agg({"bytes": "sum"}).first()[0] == 8 * sum(40 + i for i in range(5))
    read = sorted((len(r["data"]), r["data"]) for r in files.read_raw(spark, f"{tmp_path}/raw-files/*.bin").collect())
    assert read == sorted((len(r["data"]), r["data"]) for r in data.collect())


def test_adaptive_planes():
    rng = np.random.default_rng(3)
    words = [b"\0" * 400, rng.bytes(400), b"\0" * 400, *[rng.bytes(400)] * 23, b"\0" * 400]
    got = fields._adaptive(words)
    assert [c for c, _ in got] == ["zstd", *["raw"] * 25, "zstd"] and got[2][1] == words[2]
