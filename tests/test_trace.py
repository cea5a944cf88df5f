"""Tracing follows the predictor's first parent and keeps system lines out of the context."""

from threadloom.operators.chains import trace


def test_ranked_parents_and_system_lines(spark):
    msgs = spark.createDataFrame([("d", "c", p, p == 5) for p in range(8)], "dataset string, conv_id string, pos long, is_system boolean")
    edges = [(6, 4, 0), (6, 2, 1), (4, 1, 0), (2, 0, 0), (5, 4, 0), (7, 4, 0)]
    preds = spark.createDataFrame([("d", "c", *e) for e in edges], "dataset string, conv_id string, child long, parent long, rank int")
    asked = spark.createDataFrame([("q", "d", "c", 6)], "query_id string, dataset string, conv_id string, pos long")
    got = {r.pos: (r.hop, r.relation) for r in trace(msgs, preds, asked).collect()}
    assert got[4] == got[2] == (1, "direct-parent") and got[1] == (2, "direct-parent")
    assert 0 not in got and 5 not in got and got[7] == (-1, "thread-context")
    plain = {r.pos: r.hop for r in trace(msgs.drop("is_system"), preds.drop("rank"), asked).collect()}
    assert plain[0] == 2 and plain[5] == -1 and 1 not in plain
