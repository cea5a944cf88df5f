"""Columns over logged service responses and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.schema import CONV

# Budgets of a request.
MAX_TOKENS, BASE_TOKENS, TOKENS_PER_MSG, CONTEXT_TOKENS = 8192, 400, 80, 60_000


def classify(body: str | Column) -> Column:
    """struct(content, finish_reason, failure_mode); a NULL body is a network failure."""
    c = F.col(body) if isinstance(body, str) else body
    first = F.get_json_object(c, "$.choices[0]")
    why = F.get_json_object(c, "$.choices[0].finish_reason")
    text = F.get_json_object(c, "$.choices[0].message.content")
    mode = (
        F.when(c.isNull(), "network")
        .when(first.isNull(), "bad_response")
        .when(why == "length", "output_truncated")
        .when(F.coalesce(text, F.lit("")) == "", "empty_content")
    )
    shown = F.when(mode.isNull() | (mode == "output_truncated"), text)
    return F.struct(shown.alias("content"), why.alias("finish_reason"), mode.alias("failure_mode"))


def budget(n_msgs: Column) -> Column:
    return F.least(F.lit(MAX_TOKENS), BASE_TOKENS + TOKENS_PER_MSG * n_msgs)


def audit(calls: DataFrame) -> DataFrame:
    """Estimated tokens, whether the prompt is cut to its tail, and the escalated budget.

    ``calls`` carries ``prompt``, ``max_tokens`` and ``failure_mode``.
    """
    est = F.floor(F.length("prompt") / 2)
    over = est > CONTEXT_TOKENS
    return calls.withColumns(
        {
            "est_tokens": est,
            "cut": over,
            "sent_chars": F.when(over, F.lit(2 * CONTEXT_TOKENS)).otherwise(F.length("prompt")),
            "next_max_tokens": F.when(F.col("failure_mode") == "output_truncated", F.lit(MAX_TOKENS)).otherwise(F.col("max_tokens")),
        }
    )


def prompt_text(msgs: DataFrame, window: int = 300, max_chars: int = 200) -> DataFrame:
    """(conversation, window, prompt): one line per message; windows bound what is gathered.

    A prompt shows the first ``max_chars`` characters of a message.
    """
    when = F.coalesce((F.col("ts_us") / 1e6).cast("string"), F.lit("?"))
    line = F.concat(
        F.lit("["), (F.col("pos") % window).cast("string"), F.lit("] ("), F.coalesce(F.nullif("author", F.lit("")), F.lit("?")),
        F.lit(" @"), when, F.lit(") "), F.substring("text", 1, max_chars),
    )
    rows = msgs.select(*CONV, F.floor(F.col("pos") / window).alias("window"), F.struct("pos", line.alias("line")).alias("m"))
    lines = F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"])
    return rows.groupBy(*CONV, "window").agg(F.array_join(lines, "\n").alias("prompt"))


# What the secret and personal-path scan looks for.
SECRETS = {
    "api_key": r"sk-[A-Za-z0-9]{20,}",
    "credential": r"(?i)api[_-]?key\s*[=:]\s*[\"'][A-Za-z0-9]{20,}[\"']",
    "home_path": r"/Users/[A-Za-z0-9_.-]+/",
}


def scan(docs: DataFrame, key: str, patterns: dict[str, str] = SECRETS) -> DataFrame:
    """(key, pattern, n): number of matches per text and pattern; texts without a match give no row."""
    counts = F.array(
        *[F.struct(F.lit(name).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("n")) for name, p in patterns.items()]
    )
    return docs.select(key, F.explode(counts).alias("m")).select(key, "m.pattern", F.col("m.n").cast("long").alias("n")).where("n > 0")
