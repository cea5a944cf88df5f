"""Quality rules whose thresholds follow each language and dataset (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import let
from threadloom.session import materialize

# Fixed values of the base rules.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
FEWEST_WORDS = 10
MOST_REPEATED = 20

#: Leading bits of a value that its sketch cell keeps (a cell is at most 1/16 of its value wide).
CELL_BITS = 5
#: Messages of the whole language that each group borrows; they weigh less the more it has itself.
BORROWED = 100
#: Fences stand so many times the spread beyond the quartiles, and a text may show so many occurrences by chance.
SPREAD = 3

#: Adaptive metrics: (name, whether there is a lower fence).
METRICS = [("word_length", True), ("symbol_rate", False), ("dup_line_rate", False), ("repeat_rate", False)]


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the array.

    Windows are told apart by 64-bit hashes.  Texts without a repeat stop at the count of distinct
    hashes; otherwise the starts of repeated windows are put in order, and each start covers
    ``window`` words less what the next one covers.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            at = lambda k: F.get(s, k)["h"]
            twice = F.filter(s, lambda x, k: x["h"].eqNullSafe(at(k - 1)) | x["h"].eqNullSafe(at(k + 1)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def length(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        some = let(pairs, lambda s: let(starts(s), length))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(some)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def base_metrics(messages: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (BIGINT) and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = messages.withColumns(
        {
            "_words": let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))),
            "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
            "word_chars": F.char_length(F.regexp_replace(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    found = found.withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.r"), "n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.d")})
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.drop("_words", "_lines").withColumn("base_failed", failed)


def rates() -> dict[str, Column]:
    """The adaptive metrics as whole numbers: characters a word (hundredths), the others in thousandths."""
    over = lambda num, den, scale: F.floor(scale * F.col(num) / F.greatest(F.col(den), F.lit(1)))
    return {
        "word_length": over("word_chars", "n_words", 100),
        "symbol_rate": over("n_symbols", "n_words", 1000),
        "dup_line_rate": over("n_dup_lines", "n_lines", 1000),
        "repeat_rate": over("n_repeat_words", "n_words", 1000),
    }


def cell(value: Column) -> Column:
    """Sketch cell of a whole number: its ``CELL_BITS`` leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - CELL_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(value / unit) * unit


def sketches(metrics: DataFrame) -> DataFrame:
    """Quantile sketch of each metric per lang and dataset: (lang, dataset, metric, cell, n).

    Sketches merge by adding the counts of equal cells, so the engine builds them on the map side
    and groups can be pooled; a sketch has some hundred cells at most.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), cell(F.col(k)).alias("cell")) for k, _ in METRICS])
    rows = metrics.where("not base_failed").select("lang", "dataset", F.inline(cells))
    return rows.groupBy("lang", "dataset", "metric", "cell").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """(lang, dataset, metric, q1, q3, spread): quartiles of a sketch; spread is the wider of q1 to q3 and q3 to the ninth decile."""
    by = Window.partitionBy("lang", "dataset", "metric")
    up_to = F.sum("n").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.withColumns({"_upto": up_to, "_all": F.sum("n").over(by)})
    at = lambda k: F.min(F.when(F.col("_upto") * 20 >= F.col("_all") * k, F.col("cell")))
    q = ranked.groupBy("lang", "dataset", "metric").agg(at(5).alias("q1"), at(15).alias("q3"), at(18).alias("q9"))
    return q.select("lang", "dataset", "metric", "q1", "q3", F.greatest(F.col("q3") - F.col("q1"), F.col("q9") - F.col("q3")).alias("spread"))


def fences(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """(_l, _d, <metric>_lo, <metric>_hi) of every group(lang, dataset, n): quartiles widened by SPREAD spreads.

    The numbers of a group are drawn towards the means of its language with the weight of BORROWED
    messages, so they follow the group the closer the more messages it has, without a step; the
    quartiles of the group itself always lie within its fences.
    """
    size = groups.select(F.col("lang").alias("_l"), F.col("dataset").alias("_d"), "n")
    own = quantiles(sketch).join(size, F.col("lang").eqNullSafe(F.col("_l")) & F.col("dataset").eqNullSafe(F.col("_d")))
    parts = ("q1", "q3", "spread")
    mean = own.groupBy(F.col("lang").alias("_lang"), F.col("metric").alias("_metric")).agg(
        *[F.floor(F.try_divide(F.sum(F.col("n") * F.col(k)), F.sum("n"))).alias(f"_{k}") for k in parts]
    )
    both = own.join(mean, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric")))
    drawn = {k: F.floor((F.col("n") * F.col(k) + BORROWED * F.col(f"_{k}")) / (F.col("n") + BORROWED)) for k in parts}
    both = both.withColumns({f"{k}_": c for k, c in drawn.items()})
    low = F.least("q1", "q1_") - SPREAD * F.col("spread_")
    high = F.greatest("q3", "q3_") + SPREAD * F.col("spread_")
    cols = []
    for name, lower in METRICS:
        mine = lambda c, name=name: F.max(F.when(F.col("metric") == name, c))
        cols.append(mine(low if lower else F.lit(0).cast("long")).alias(f"{name}_lo"))
        cols.append(mine(high).alias(f"{name}_hi"))
    return both.groupBy("_l", "_d").agg(*cols)


def chance() -> dict[str, Column]:
    """What a text may lie beyond its group's fence by chance, in the units of the metric.

    A rate of 0 still shows up to SPREAD occurrences in a text (each repeat is a window of words),
    and the mean of n word lengths, which spread no wider than their mean, strays by its n-th root.
    """
    words = F.greatest("n_words", F.lit(1))
    return {
        "word_length": F.floor(SPREAD * F.col("word_length_hi") / F.sqrt(words)),
        "symbol_rate": F.floor(1000 * SPREAD / words),
        "dup_line_rate": F.floor(1000 * SPREAD / F.greatest("n_lines", F.lit(1))),
        "repeat_rate": F.floor(1000 * SPREAD * REPEAT_WINDOW / words),
    }


def quality_rules(messages: DataFrame) -> DataFrame:
    """Base rules and adaptive rules for messages.

    messages(msg_id, dataset, lang, text, ...) -> msg_id, lang, dataset, n_words, word_chars,
    n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, the adaptive metrics with their
    fences (``<metric>``, ``<metric>_lo``, ``<metric>_hi``) and ``kept``.

    A message fails the base rules with fewer than 10 words, or with more than a fifth of its words
    in repeated 5-word windows.  For the others each lang and dataset has quantile sketches of word
    length, symbols, repeated lines and repeated words; a message is kept if every metric lies
    within the fences of its group, widened by what a text of its length shows by chance (the
    columns have the widened ones).  Metrics are written once; texts are never shuffled.

    Null or empty text: no words, so the base rules fail.  Null lang and null dataset are groups of
    their own.  A group without a message that passes the base rules needs no fences.  Rows are
    judged one by one, repeated ones alike; other columns are not kept; an empty table gives an
    empty result.
    """
    rows = materialize(base_metrics(messages.select("msg_id", "lang", "dataset", "text")).drop("text").withColumns(rates()), "metrics")
    sketch = materialize(sketches(rows), "sketch")
    groups = sketch.where(F.col("metric") == METRICS[0][0]).groupBy("lang", "dataset").agg(F.sum("n").alias("n"))
    limits = materialize(fences(sketch, groups), "fences")
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("dataset").eqNullSafe(F.col("_d"))
    judged = rows.join(limits, same, "left").drop("_l", "_d")
    wider = {f"{k}_hi": F.col(f"{k}_hi") + c for k, c in chance().items()}
    judged = judged.withColumns(wider | {f"{k}_lo": F.col(f"{k}_lo") - chance()[k] for k, lower in METRICS if lower})
    ok = ~F.col("base_failed")
    for name, _ in METRICS:
        ok = ok & F.col(name).between(F.col(f"{name}_lo"), F.col(f"{name}_hi"))
    return judged.withColumn("kept", F.coalesce(ok, F.lit(False)))
