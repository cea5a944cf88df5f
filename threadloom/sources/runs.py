"""Run results, word vectors, prediction tables: reading, writing, resuming, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import tune


def read_word_vectors(spark: SparkSession, path: str, dim: int = 50) -> DataFrame:
    """(word, vec) of a text table with ``dim`` numbers per line; other lines are skipped."""
    parts = F.split("value", " ")
    rows = tune(spark).read.text(path).where(F.size(parts) == dim + 1)
    return rows.select(F.lower(F.get(parts, F.lit(0))).alias("word"), F.slice(parts, 2, dim).cast("array<float>").alias("vec"))


def flatten_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run files ``DATASET__ALGORITHM__sSEED.json`` -> (dataset, algorithm, seed, key, value).

    Nested metric objects up to three levels become dotted keys; what is not a number is left out.
    """
    raw = tune(spark).read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f"))
    pat = r"^(.+)__(.+)__s(\d+)\.json$"
    ids = [F.regexp_extract("f", pat, 1).alias("dataset"), F.regexp_extract("f", pat, 2).alias("algorithm"), F.regexp_extract("f", pat, 3).cast("int").alias("seed")]
    level = raw.select(*ids, F.lit("").alias("key"), F.try_variant_get(F.try_parse_json("value"), "$.metrics", "variant").alias("v"))
    out = None
    for _ in range(3):
        entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
        inner = level.select("dataset", "algorithm", "seed", "key", F.explode(entries).alias("e"))
        key = F.when(F.col("key") == "", F.col("e.key")).otherwise(F.concat_ws(".", "key", "e.key"))
        level = inner.select("dataset", "algorithm", "seed", key.alias("key"), F.col("e.value").alias("v"))
        numbers = level.select("dataset", "algorithm", "seed", "key", F.try_variant_get("v", "$", "double").alias("value")).where("value is not null")
        out = numbers if out is None else out.unionByName(numbers)
    return out


def parse_chains(content: str | Column) -> Column:
    """Chains and single parents of a text answer; falls back to its outermost braces."""
    c = F.col(content) if isinstance(content, str) else content
    schema = "chains array<struct<topic:string,message_ids:array<long>>>, backtrack array<struct<message_id:long,parent:long>>"
    usable = lambda x: F.get_json_object(x, "$.chains").isNotNull() | F.get_json_object(x, "$.backtrack").isNotNull()
    cut = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(usable(c), F.from_json(c, schema)).when(usable(cut), F.from_json(cut, schema))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("dataset", "algorithm"), mode: str = "append") -> None:
    """Partitioned sink; ``overwrite`` replaces only the partitions that are written again."""
    writer = df.write.format(fmt).mode(mode).partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.option("partitionOverwriteMode", "dynamic").save(path)


def fingerprint(df: DataFrame, by: str = "dataset") -> DataFrame:
    """Row count and an order-free hash sum per dataset (DECIMAL, so that it cannot overflow)."""
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).cast("string")
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), total.alias("fingerprint"))
