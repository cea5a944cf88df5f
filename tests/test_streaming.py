"""Late rows, resuming and the end of state."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from threadloom.streaming import online
from threadloom.streaming.ledger import Ledger

SCHEMA = "dataset string, conv_id string, msg_id long, author string, ts timestamp, mentions array<string>"


def add(spark, folder, rows):
    data = [("d", "c", m, a, f"2024-01-01 {h:02d}:00:00", names) for m, h, a, names in rows]
    df = spark.createDataFrame(data, "dataset string, conv_id string, msg_id long, author string, at string, mentions array<string>")
    df.select("dataset", "conv_id", "msg_id", "author", F.to_timestamp("at").alias("ts"), "mentions").coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, folder, late):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    got = online.run_to_table(online.mention_edges(online.mention_rows(stream)), folder=folder, late=late)
    return sorted((r.child, r.parent) for r in got.collect())


def test_late_rows_are_counted_and_runs_resume(spark, tmp_path):
    source, folder, late = str(tmp_path / "in"), str(tmp_path / "out"), []
    add(spark, source, [(1, 1, "ann", []), (2, 2, "bob", ["ann"]), (3, 12, "cat", [])])
    assert run(spark, source, folder, late) == [(2, 1)]
    # the first two come behind the watermark (11:00), the others do not
    add(spark, source, [(4, 3, "ann", []), (5, 4, "dan", ["ann"]), (6, 13, "eve", ["cat", "ann"]), (7, 20, "fay", [])])
    assert run(spark, source, folder, late) == [(2, 1), (6, 3)]
    assert late == [0, 3]
    assert run(spark, source, folder, late) == [(2, 1), (6, 3)]


def edges_in_files(spark, folder, edges, files, seed):
    rng = random.Random(seed)
    rng.shuffle(edges)
    for k in range(files):
        part = [("d", f"c{c}", a, b) for c, a, b in edges[k::files]]
        spark.createDataFrame(part, "dataset string, conv_id string, child long, parent long").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("dataset string, conv_id string, child long, parent long").option("maxFilesPerTrigger", 1).parquet(folder)


def smallest(edges):
    comp = {}
    for c, a, b in edges:
        low, high = sorted((comp.setdefault((c, a), a), comp.setdefault((c, b), b)))
        comp = {k: low if k[0] == c and v == high else v for k, v in comp.items()}
    return comp


@pytest.mark.parametrize("keep_ms", [None, 3_600_000])
def test_components_over_shuffled_batches(spark, tmp_path, keep_ms):
    rng = random.Random(3)
    edges = [(c, a, rng.randrange(a)) for c in range(3) for a in range(1, 25) for _ in range(rng.choice([0, 1, 1, 2]))]
    stream = edges_in_files(spark, str(tmp_path / "in"), edges, 4, 1)
    rows = online.run_to_table(online.online_components(stream, keep_ms), folder=str(tmp_path / "out"), idle=keep_ms is None)
    assert rows.count() == len(edges)
    got = {(int(r.conv_id[1:]), r.pos): r.comp for r in online.final_components(rows).collect()}
    assert got == smallest(edges)
    lost = [(r.conv_id, r.lost) for r in rows.where("lost is not null").collect()]
    assert len(lost) == len(set(lost))


def test_components_go_on_after_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    edges = [(0, 1, 0), (0, 3, 2)]
    stream = edges_in_files(spark, source, list(edges), 1, 1)
    online.run_to_table(online.online_components(stream), folder=folder)
    more = [(0, 4, 3), (0, 4, 1)]
    stream = edges_in_files(spark, source, list(more), 1, 1)
    rows = online.run_to_table(online.online_components(stream), folder=folder)
    assert {(r.child, r.parent): (r.comp, r.lost) for r in rows.collect()} == {(1, 0): (0, 1), (3, 2): (2, 3), (4, 1): (0, 4), (4, 3): (0, 2)}
    assert {r.pos: r.comp for r in online.final_components(rows).collect()} == dict.fromkeys(range(5), 0)


def numbers(spark, folder, rows, files):
    spark.createDataFrame(rows, "k long, v string").repartition(files, "k").write.mode("append").parquet(folder)
    return spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("step", ["written", "committed"])
def test_cut_off_runs_leave_the_same_table(spark, tmp_path, step):
    rows = [(k, f"v{k}") for k in range(40)]
    stream = numbers(spark, str(tmp_path / "in"), rows, 3)
    sink = Ledger(spark, str(tmp_path / "out"), "q", ["k"])
    assert not sink.run(stream, stop=(step, 1))
    partly = sink.read(stream.schema)
    assert 0 < partly.count() < 40 and sink.pending(spark.createDataFrame(rows, stream.schema), stream.schema).count() == 40 - partly.count()
    assert sink.run(stream) and sink.run(stream)
    assert sorted(tuple(r) for r in sink.read(stream.schema).collect()) == rows
    written = [p for p in (tmp_path / "out" / "rows").iterdir()]
    assert len(written) == sink.entries().count() + (step == "written")


def test_later_batches_win_and_ranges_prune(spark, tmp_path):
    sink = Ledger(spark, str(tmp_path / "out"), "q", ["k"])
    stream = numbers(spark, str(tmp_path / "in"), [(1, "old"), (2, "old")], 1)
    sink.run(stream)
    stream = numbers(spark, str(tmp_path / "in"), [(2, "new"), (7, "new")], 1)
    sink.run(stream)
    assert {r.k: r.v for r in sink.read(stream.schema).collect()} == {1: "old", 2: "new", 7: "new"}
    assert {r.k for r in sink.read(stream.schema, low='{"k":3}').collect()} == {2, 7}
    assert Ledger(spark, str(tmp_path / "out"), "other", ["k"]).read(stream.schema).count() == 0


def test_other_errors_are_raised(spark, tmp_path):
    stream = numbers(spark, str(tmp_path / "in"), [(1, "x")], 1).select("k", F.raise_error(F.lit("broken")).cast("string").alias("v"))
    with pytest.raises(StreamingQueryException):
        Ledger(spark, str(tmp_path / "out"), "q", ["k"]).run(stream, stop=("written", 5))


def test_names_of_a_conversation_share_states(spark, tmp_path):
    """300 names: a state each before."""
    source = str(tmp_path / "in")
    names = [f"u{k}" for k in range(300)]
    add(spark, source, [(k, 1, n, []) for k, n in enumerate(names)])
    add(spark, source, [(300, 3, "zoe", names[::2]), (301, 9, "zoe", names[1::2]), (302, 12, "zoe", [])])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    edges = online.mention_edges(online.mention_rows(stream))
    query = edges.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "log")).foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
    query.awaitTermination()
    states = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert states <= online.NAME_BUCKETS
    got = {(r.name, r.child, r.parent) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # eight hours later is too late
    assert got == {(n, 300, k) for k, n in enumerate(names) if k % 2 == 0}
