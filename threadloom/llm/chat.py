"""Chat samples from conversations with quoting replies (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import let
from threadloom.operators.ordered import last_before, number_rows
from threadloom.session import materialize

#: Messages of one sample at most; longer conversations give several samples.
SAMPLE_MESSAGES = 1000

# Fixed value: the quote marks at the start of a line.
QUOTE = r"^(?:[ \t]?>)+ ?"


def quote_level(line: Column) -> Column:
    """Quote marks in front of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def passages(text: Column) -> Column:
    """Runs of lines of one quote level, in order: ARRAY<STRUCT<level INT, text STRING>>."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("text")))

    def cut(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda k: ~F.get(rows, k)["level"].eqNullSafe(F.get(rows, k - 1)["level"]))

        def runs(s: Column) -> Column:
            return F.transform(
                s,
                lambda k, i: F.struct(
                    F.get(rows, k)["level"].alias("level"),
                    F.array_join(F.transform(F.slice(rows, k + 1, F.coalesce(F.get(s, i + 1), F.size(rows)) - k), lambda r: r["text"]), "\n").alias("text"),
                ),
            )

        return let(starts, runs)

    return let(lines, cut)


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def keys(text: Column) -> Column:
    """Distinct hashes under which a passage can be found: the whole of it and each line; empty ones are left out."""
    parts = F.concat(F.array(text), F.split(text, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normal), lambda x: x != ""), F.md5))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with a conversation key, a dense number, their own text and their quoted passages."""
    rows = messages.withColumn("_conv", F.to_json(F.struct("dataset", "conv_id")))
    rows = number_rows(rows, ["_conv"], ["pos", "author", "text"], "_i")
    rows = rows.withColumn("_parts", passages(F.col("text")))
    own = F.trim(F.array_join(F.transform(F.filter("_parts", lambda p: p["level"] == 0), lambda p: F.trim(p["text"])), "\n"))
    rows = rows.withColumns({"_own": own, "_quotes": F.filter("_parts", lambda p: (p["level"] > 0) & (normal(p["text"]) != ""))})
    return materialize(rows.drop("_parts"), "parsed")


def quote_links(rows: DataFrame) -> DataFrame:
    """(_conv, _i, level, quote, original): the message that each quoted passage comes from.

    A passage and its lines look up the latest earlier message whose own words hold the same
    passage or line.  The whole passage decides; failing that, the message found for most lines
    (the latest of equals).  The look-up is an as-of step over (conversation, hash), so a line that
    stands in very many messages is carried forward, never paired.
    """
    own = F.concat(F.array("_own"), F.filter(F.split("_own", "\n\n"), lambda x: x != ""))
    own = F.array_distinct(F.flatten(F.transform(own, keys)))
    have = rows.select("_conv", "_i", F.explode(own).alias("_key"), F.lit(-1).alias("quote"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("whole"))
    asked = rows.select("_conv", "_i", F.posexplode("_quotes").alias("quote", "q"))
    wanted = F.transform(keys(F.col("q.text")), lambda k: F.struct(k.alias("k"), (k == F.md5(normal(F.col("q.text")))).alias("w")))
    asked = asked.select("_conv", "_i", "quote", F.col("q.level").cast("int").alias("level"), F.explode(wanted).alias("x"))
    asked = asked.select("_conv", "_i", F.col("x.k").alias("_key"), "quote", "level", F.col("x.w").alias("whole"))
    # at one message the questions come first, so a message never answers its own quote
    both = have.unionByName(asked.select("_conv", "_i", "_key", "quote", "level", "whole")).withColumn("_turn", F.when(F.col("quote") < 0, 1).otherwise(0))
    found = last_before(both, ["_conv", "_key"], ["_i", "_turn", "quote", "level"], F.when(F.col("quote") < 0, F.col("_i")), "original")
    found = found.where("quote >= 0 and original is not null")
    votes = found.groupBy("_conv", "_i", "quote", "level", "original").agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    best = F.max_by("original", F.struct("whole", "n", "original")).alias("original")
    return votes.groupBy("_conv", "_i", "quote", "level").agg(best)


def reply_order(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """(_conv, _i, order): messages in the order of a walk over the replies.

    A message without a link continues the message before it; one that answers an earlier message
    starts a branch there.  The walk goes through a branch to its end and then through the branches
    that hang off it, the latest place first.  Only branches are worked on: their sizes add up, and
    their places follow, by doubling over the tree, so rounds grow with the logarithm of its depth.
    """
    jumps = replies.where("original < _i - 1").select("_conv", "_i", "original")
    marked = rows.select("_conv", "_i").join(jumps, ["_conv", "_i"], "left")
    marked = last_before(marked, ["_conv"], ["_i"], F.when(F.col("original").isNotNull(), F.col("_i")), "_prev")
    branch = F.when(F.col("original").isNotNull(), F.col("_i")).otherwise(F.coalesce("_prev", F.lit(0).cast("long")))
    marked = materialize(marked.select("_conv", "_i", branch.alias("branch")), "branches")
    size = marked.groupBy("_conv", "branch").agg(F.count("*").alias("len"))
    hung = jumps.join(marked.withColumnRenamed("_i", "original").withColumnRenamed("branch", "up"), ["_conv", "original"])
    tree = size.join(hung.select("_conv", F.col("_i").alias("branch"), "original", "up"), ["_conv", "branch"], "left")
    tree = materialize(tree.join(hung.select("_conv").distinct(), "_conv", "left_semi"), "tree")
    total = _walk(tree.select("_conv", "branch", "up", F.col("len").alias("value")), down=True)
    sized = tree.join(total, ["_conv", "branch"])
    line = tree.select("_conv", F.col("branch").alias("up"), F.col("len").alias("up_len"))
    before = Window.partitionBy("_conv", "up").orderBy(F.desc("original"), "branch").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("total").over(before), F.lit(0)) + F.coalesce("up_len", F.lit(0))
    offset = sized.join(line, ["_conv", "up"], "left").withColumn("value", F.when(F.col("up").isNull(), 0).otherwise(own))
    start = _walk(offset.select("_conv", "branch", "up", F.col("value").cast("long").alias("value")), down=False)
    placed = marked.join(start, ["_conv", "branch"], "left")
    return placed.select("_conv", "_i", (F.coalesce("total", F.lit(0)) + F.col("_i") - F.col("branch")).alias("order"))


def _walk(tree: DataFrame, down: bool) -> DataFrame:
    """(_conv, branch, total): values summed over the descendants (``down``) or the ancestors, each with itself."""
    cur = materialize(tree.select("_conv", "branch", "up", F.col("value").alias("total")), "walk")
    while not cur.where("up is not null").isEmpty():
        ahead = cur.select("_conv", F.col("branch").alias("up"), F.col("up").alias("up2"), F.col("total").alias("more"))
        moved = cur.join(ahead, ["_conv", "up"], "left")
        if down:
            gain = cur.where("up is not null").groupBy("_conv", F.col("up").alias("branch")).agg(F.sum("total").alias("gain"))
            moved = moved.join(gain, ["_conv", "branch"], "left").select("_conv", "branch", F.col("up2").alias("up"), (F.col("total") + F.coalesce("gain", F.lit(0))).alias("total"))
        else:
            moved = moved.select("_conv", "branch", F.col("up2").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        cur = materialize(moved, "walk")
    return cur.select("_conv", "branch", "total")


def threaded(messages: DataFrame) -> DataFrame:
    """Messages in reply order: dataset, conv_id, pos, author, order, reply_to, n_quotes, n_linked, own_text.

    See :func:`chat_samples`; ``reply_to`` is the number of the message answered, null for none.
    """
    rows = parsed(messages.select("dataset", "conv_id", "pos", "author", "text"))
    links = materialize(quote_links(rows), "quotes")
    per = links.groupBy("_conv", "_i").agg(
        F.min_by("original", F.struct("level", "quote")).alias("original"), F.count("*").alias("n_linked")
    )
    order = reply_order(rows, per)
    out = rows.join(order, ["_conv", "_i"]).join(per, ["_conv", "_i"], "left")
    answered = F.coalesce("original", F.when(F.col("_i") > 0, F.col("_i") - 1))
    return out.select(
        "_conv", "dataset", "conv_id", "pos", "author", "order", answered.alias("reply_to"),
        F.size("_quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("_own").alias("own_text"),
    )


def chat_samples(messages: DataFrame, sample_messages: int = SAMPLE_MESSAGES) -> DataFrame:
    """Conversations as chat samples: quotes become reply links and leave the text.

    messages(dataset, conv_id, pos, author, text, ...) -> dataset, conv_id, part, n_messages,
    n_quotes, n_linked, chat.

    Lines that start with ``>`` marks are quotes of that level; runs of lines of a level are
    passages.  A quoted passage is compared, in lower case and with white space squeezed, by hash
    with the own words of earlier messages of its conversation.  A message answers the origin of
    its first linked passage of the lowest level, else the message before it.  ``chat`` has, in
    reply order, ``<|author|>`` and the text without quotes for each message.  A conversation of
    more than ``sample_messages`` messages gives several samples, numbered by ``part``.

    Null text is empty; a message that is only quotes keeps its turn with an empty text.  A null
    author is ``unknown``.  Null dataset or conv_id are values of their own.  Messages are numbered
    by pos (null first), then author and text, so repeated rows are messages of their own.  Other
    columns are not kept.  An empty table gives an empty result.
    """
    rows = threaded(messages).withColumn("part", F.floor(F.col("order") / sample_messages))
    turn = F.struct("order", F.concat(F.lit("<|"), F.coalesce("author", F.lit("unknown")), F.lit("|>\n"), F.col("own_text")).alias("text"))
    got = rows.groupBy("_conv", "part").agg(
        F.first("dataset").alias("dataset"), F.first("conv_id").alias("conv_id"), F.count("*").alias("n_messages"),
        F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    chat = F.array_join(F.transform("turns", lambda t: t["text"]), "\n")
    return got.select("dataset", "conv_id", "part", "n_messages", "n_quotes", "n_linked", chat.alias("chat"))
