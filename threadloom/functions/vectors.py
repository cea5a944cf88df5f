"""Vector columns: hashed text vectors, dot products, standardising."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import HASH_BUCKETS, grams

DIM = 64


@lru_cache(maxsize=2)
def projection(seed: int = 42, dim: int = DIM) -> np.ndarray:
    """The random projection; a pure function of its seed, so each worker makes its own (5 MB)."""
    draw = np.random.default_rng(seed).standard_normal((HASH_BUCKETS, dim))
    return (draw / np.sqrt(dim)).astype(np.float32)


@lru_cache(maxsize=1_000_000)
def bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest(), 16) % HASH_BUCKETS


def hash_vectors(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """(keys, vec): unit vector of the summed projection rows of the trigrams of ``text``.

    Trigrams are cut on the JVM side; a text without any gets the zero vector.
    """
    keys = list(keys)

    def embed(batches):
        table = projection(seed)
        for pdf in batches:
            out = []
            for found in pdf["_grams"]:
                v = table[[bucket(g) for g in found]].sum(axis=0) if len(found) else np.zeros(table.shape[1], np.float32)
                n = float(np.linalg.norm(v))
                out.append(v / n if n > 0 else v)
            yield pdf[keys].assign(vec=out)

    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", vec array<float>"
    return df.select(*keys, grams("text").alias("_grams")).mapInPandas(embed, schema)


def with_hash_vector(msgs: DataFrame, seed: int = 42) -> DataFrame:
    """Attach ``vec``, computed once per distinct text."""
    return msgs.join(hash_vectors(msgs.select("text").distinct(), ["text"], seed), "text", "left")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Z-scores with the population deviation; a constant or undefined column becomes 0."""
    stats = df.agg(*[f(c).alias(f"{p}_{c}") for c in cols for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))])
    wide = df.withColumn("_one", F.lit(1)).join(stats.withColumn("_one", F.lit(1)), "_one")
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in cols}
    return wide.withColumns(z).select(*df.columns)
