"""Readers on tiny files in the formats they are for."""

import json

from threadloom.functions.responses import classify
from threadloom.sources import chatlogs, runs, threads


def test_chat_logs(spark, tmp_path):
    d = tmp_path / "dev"
    d.mkdir()
    (d / "x.tok.txt").write_text("<s> hi all </s>\nbob : yes </s>\n<s> </s>\n")
    (d / "x.ascii.txt").write_text("[10:00] <ann> hi all\n[10:01] <cat> bob: yes\n=== eve joined\n")
    (d / "x.annotation.txt").write_text("0 0 -\n0 1 -\n\n")
    msgs, edges = chatlogs.read_chat_logs(spark, str(tmp_path))
    rows = {r["pos"]: r for r in msgs.collect()}
    assert [rows[i]["author"] for i in range(3)] == ["ann", "cat", ""]
    assert [rows[i]["text"] for i in range(2)] == ["hi all", "bob : yes"]
    assert rows[0]["tokens"] == ["<s>", "hi", "all"] and rows[2]["is_system"]
    assert {(r["child"], r["parent"]) for r in edges.collect()} == {(0, 0), (1, 0)}
    kept, linked = chatlogs.profile_logs(msgs, edges)
    assert {r["seconds"] for r in kept.collect()} == {36000, 36060, None}
    assert {(r["child"], r["parent"]) for r in linked.collect()} == {(1, 0)}
    (d / "gold.txt").write_text("# comment\n\nx:1 0 -\nx:1 0 -\n")
    assert [tuple(r) for r in chatlogs.read_gold_graph(spark, str(d / "gold.txt")).collect()] == [("x", 1, 0)]


def test_threads(spark, tmp_path):
    good = {"dataset": "d", "conv_id": "c", "msgs": [
        {"id": "b", "author": "y", "parent": "a", "ts": 2, "text": "two"},
        {"id": "a", "author": "x", "parent": None, "ts": 1, "text": "one"},
        {"id": "z", "author": "x", "parent": "gone", "ts": 3, "text": "three"}]}
    p = tmp_path / "t.jsonl"
    p.write_text(json.dumps(good) + "\n{broken\n")
    msgs, edges = threads.read_threads(spark, str(p))
    assert [r["msg_id"] for r in msgs.orderBy("pos").collect()] == ["a", "b", "z"]
    assert [(r["child"], r["parent"]) for r in edges.collect()] == [(1, 0)]


def test_edu_json(spark, tmp_path):
    p = tmp_path / "DP_test.json"
    p.write_text(json.dumps([{"id": "7", "edus": [{"text": "a", "speaker": "s"}, {"text": "b", "speaker": "t"}],
                              "relations": [{"x": 0, "y": 1, "type": "Q"}, {"x": 1, "y": 1, "type": "S"}, {"x": 0, "y": 9, "type": "S"}]}]))
    msgs, edges = threads.read_edu_json(spark, str(p))
    assert msgs.count() == 2 and [(r["child"], r["parent"], r["type"]) for r in edges.collect()] == [(1, 0, "Q")]
    assert threads.read_edu_json(spark, str(p), drop_self=False)[1].count() == 2


def test_channel_dump(spark, tmp_path):
    row = lambda i, **k: {"id": str(i), "type": 0, "is_bot": False, "timestamp": f"2024-01-01T00:00:{i:02d}Z", "channel_id": "ch",
                          "content": "t", "author": {"id": "u"}, **k}
    rows = [row(1), row(2, message_reference={"message_id": "1"}), row(3, is_bot=True), row(4, type=7), row(5, message_reference={"message_id": "3"})]
    p = tmp_path / "s.json"
    p.write_text("\n".join(map(json.dumps, rows)) + "\nnope\n")
    msgs, edges = threads.read_channel_dump(spark, str(p), min_msgs=2)
    assert [r["msg_id"] for r in msgs.orderBy("pos").collect()] == ["1", "2", "5"]
    assert [(r["child"], r["parent"]) for r in edges.collect()] == [(1, 0)]


def test_trees_runs_vectors_instances(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps({"id": 1, "author": "a", "created_at_i": 5, "children": [{"id": 2, "parent_id": 1, "text": "xy", "children": [{"id": 3, "parent_id": 2}]}]}))
    flat = threads.flatten_tree(spark, str(tmp_path / "tree.json")).orderBy("id").collect()
    assert [(r["id"], r["parent"], r["depth"], r["tlen"]) for r in flat] == [(1, None, 0, 0), (2, 1, 1, 2), (3, 2, 2, 0)]
    (tmp_path / "irc__prev1__s0.json").write_text(json.dumps({"metrics": {"link": {"P": 1.5}, "cats": {"1-1": {"F1": 2.0}}, "tp": 3, "none": None, "s": "text"}}))
    got = {(r["dataset"], r["algorithm"], r["seed"], r["key"], r["value"]) for r in runs.flatten_metrics(spark, str(tmp_path / "irc__*.json")).collect()}
    assert got == {("irc", "prev1", 0, "link.P", 1.5), ("irc", "prev1", 0, "cats.1-1.F1", 2.0), ("irc", "prev1", 0, "tp", 3.0)}
    (tmp_path / "v.txt").write_text("The 1 2\nbad 1\n")
    assert [tuple(r) for r in runs.read_word_vectors(spark, str(tmp_path / "v.txt"), dim=2).collect()] == [("the", [1.0, 2.0])]
    (tmp_path / "i.json").write_text(json.dumps({"dataset": "d", "instance_id": "q", "items": [{"idx": 0, "text": "a", "ts": 0, "meta": {"k": "v"}}, {"idx": 1, "text": "b", "ts": 1, "meta": {}}], "gold_parent": {"0": -1, "1": 0}}))
    msgs, gold = threads.read_instances(spark, str(tmp_path / "i.json"))
    assert msgs.count() == 2 and [(r["child"], r["parent"]) for r in gold.collect()] == [(1, 0)]


def test_responses(spark):
    body = lambda why, text: json.dumps({"choices": [{"finish_reason": why, "message": {"content": text}}]})
    rows = [(0, body("stop", '{"chains":[]}')), (1, body("length", '{"chai')), (2, body("stop", "")), (3, '{"oops":1}'), (4, None)]
    df = spark.createDataFrame(rows, "k int, b string").select("k", classify("b").alias("r")).orderBy("k")
    got = [(r["r"]["content"], r["r"]["failure_mode"]) for r in df.collect()]
    assert got == [('{"chains":[]}', None), ('{"chai', "output_truncated"), (None, "empty_content"), (None, "bad_response"), (None, "network")]


def test_deep_trees(spark, tmp_path):
    from threadloom.sources.threads import flatten_tree

    tree = '{"id": 60, "author": "a", "children": []}'
    for k in range(59, -1, -1):
        tree = '{"id": %d, "author": "a", "children": [%s]}' % (k, tree)
    (tmp_path / "tree.json").write_text(tree + "\n")
    assert sorted((r.id, r.depth) for r in flatten_tree(spark, str(tmp_path / "tree.json")).collect()) == [(k, k) for k in range(61)]


def test_prepared_tables_follow_their_files(spark, tmp_path):
    from threadloom.sources.events import prepared

    folder = str(tmp_path / "t")
    spark.range(3).write.parquet(folder)
    read = lambda: prepared(spark, ("three", folder), lambda: spark.read.parquet(folder)).count()
    assert read() == read() == 3
    spark.range(2).write.mode("append").parquet(folder)
    assert read() == 5
