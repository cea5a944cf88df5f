"""Features of raw chat lines: known users, addressed users, word vectors of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import speaker
from threadloom.schema import CONV

# Fixed value: ASCII punctuation that may surround a name.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def addressed_users(msgs: DataFrame) -> DataFrame:
    """(conversation, pos, user): known users of the conversation named by a word of the text.

    A word counts as it is, else without trailing punctuation, else also without leading
    punctuation; names of one or two letters are left out.  Purely numeric authors are no users.
    """
    users = msgs.select(*CONV, speaker("author").alias("user")).where("user <> '' and not user rlike '^[0-9]+$'").distinct()
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+")))
    asked = msgs.select(*CONV, "pos", word.alias("word"))
    tail = F.regexp_replace("word", PUNCTUATION + "+$", "")
    forms = F.array(F.col("word"), tail, F.regexp_replace(tail, "^" + PUNCTUATION + "+", ""))
    tried = asked.select(*CONV, "pos", "word", F.posexplode(forms).alias("nth", "user")).where(F.length("user") > 2)
    hits = tried.join(users, [*CONV, "user"])
    best = hits.groupBy(*CONV, "pos", "word").agg(F.min_by("user", "nth").alias("user"))
    return best.select(*CONV, "pos", "user").distinct()


def node_features(msgs: DataFrame, n_words: Column) -> DataFrame:
    """Word count (log), position ratio, and the marks ``?``, ``!`` and a leading ``@``."""
    size = msgs.groupBy(*CONV).agg(F.count("*").alias("_n"))
    flag = lambda c: c.cast("double")
    return msgs.join(size, CONV).select(
        *CONV, "pos",
        F.log1p(n_words.cast("double")).alias("log_words"),
        (F.col("pos") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("place"),
        flag(F.contains("text", F.lit("?"))).alias("question"),
        flag(F.contains("text", F.lit("!"))).alias("exclaim"),
        flag(F.startswith(F.trim("text"), F.lit("@"))).alias("at_start"),
    )


def message_vectors(msgs: DataFrame, vectors: DataFrame, dim: int = 50) -> DataFrame:
    """(conversation, pos, d, top, mean): per dimension the maximum and mean over the words.

    ``vectors(word, vec)``; a word without vector takes that of ``<unka>`` if there is one, else 0.
    Words are counted per message first and joined by word; nothing grows with the message length.
    """
    words = msgs.select(*CONV, "pos", F.explode("tokens").alias("word")).groupBy(*CONV, "pos", "word").agg(F.count("*").alias("n"))
    known = vectors.select("word", "vec")
    unka = vectors.where("word = '<unka>'").agg(F.first("vec").alias("other")).withColumn("_one", F.lit(1))
    got = words.join(known, "word", "left")
    lower = known.select(F.col("word").alias("low"), F.col("vec").alias("vec2"))
    got = got.withColumn("low", F.lower("word")).join(lower, "low", "left").withColumn("_one", F.lit(1)).join(unka, "_one")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    rows = got.select(*CONV, "pos", "n", F.posexplode(F.coalesce("vec", "vec2", "other", zero)).alias("d", "x"))
    return rows.groupBy(*CONV, "pos", "d").agg(
        F.max("x").alias("top"), (F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("mean")
    )
