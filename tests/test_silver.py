"""Boundary cases of the mention as-of join, by hand."""

from pyspark.sql import functions as F

from threadloom.operators import silver

HOUR = 3_600_000_000


def table(spark, rows):
    """(pos, ts in hours, author, mentions)"""
    data = [("d", "c", p, int(h * HOUR), a, m) for p, h, a, m in rows]
    return spark.createDataFrame(data, "dataset string, conv_id string, pos long, ts_us long, author string, mentions array<string>")


def edges(df, **options):
    got = silver.mention_lookup(df, **options)
    return {(r["child"], r["parent"]) for r in silver.edges_of(got).collect()}


def test_window_and_ties(spark):
    df = table(spark, [
        (0, 0, "ann", []), (1, 0, "bob", ["ann"]),          # same instant: no match
        (2, 6, "bob", ["ann"]),                             # exactly six hours: match
        (3, 6.001, "cat", ["ann"]),                         # just above: none
        (4, 6.1, "dan", ["bob", "bob"]), (5, 6.2, "eve", ["bob", "cat"]),
        (6, 6.3, "eve", ["eve", "nobody"]),                 # own previous message; unknown name
    ])
    want = {(2, 0), (4, 2), (5, 2), (5, 3), (6, 5)}
    assert edges(df) == want
    assert edges(df, limit=0) == want
    lookup = silver.mention_lookup(df)
    assert lookup.count() == 8 and lookup.where(F.col("parent").isNull()).count() == 3


def test_name_fallback(spark):
    df = table(spark, [(0, 0, "Bob", []), (1, 1, "bob", []), (2, 2, "Bob", []), (3, 3, "x", ["bob"]), (4, 4, "x", ["Bob"]), (5, 5, "x", ["BOB"])])
    # bob sees both spellings, Bob only itself, BOB falls back to bob
    assert edges(df) == {(3, 2), (4, 2), (5, 2)}
    assert edges(df, match="exact") == {(3, 1), (4, 2)}


def test_positional(spark):
    rows = [("d", "c", 0, "ann", "x"), ("d", "c", 1, "bob", "<@ann> <@ann> <@no one>"), ("d", "c", 2, "ann", "<@ann>")]
    df = spark.createDataFrame(rows, "dataset string, conv_id string, pos long, author string, text string")
    for limit in (None, 0):
        got = {(r["child"], r["nth"], r["parent"]) for r in silver.positional_lookup(df, limit).collect()}
        assert got == {(1, 0, 0), (1, 1, 0), (1, 2, None), (2, 0, 0)}


def test_stream_equals_batch_out_of_order(spark, tmp_path):
    """Files arrive out of order within the watermark; the result is the batch result."""
    from threadloom.streaming import online

    rows = [(i, 1_000_000 + i * 60, f"u{i % 3}", [f"u{(i + 1) % 3}"]) for i in range(12)] + [(99, 1_400_000, "end", [])]
    schema = "dataset string, conv_id string, msg_id long, s long, author string, mentions array<string>"
    all_rows = [("d", "c", *r) for r in rows]
    src = tmp_path / "src"
    for part in (all_rows[6:12], all_rows[:6], all_rows[12:]):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(str(src))
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = online.run_to_table(online.mention_edges(online.mention_rows(read), delay="1 hour"))
    batch = table(spark, [(r[0], r[1] / 3600, r[2], r[3]) for r in rows])
    assert {(r["child"], r["parent"]) for r in got.collect()} == edges(batch, match="exact")
