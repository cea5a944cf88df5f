"""Chat logs kept as line files: tokens, raw lines and annotations side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.schema import CONV
from threadloom.session import tune

# The line formats.
LINE_TIME = r"^\[(\d{2}:\d{2})\]"
LINE_SPEAKER = r"^<([^>]+)>\s*(.*)"


def parse_line(line: str | Column) -> Column:
    """struct(speaker, text, is_system) of a raw ``[HH:MM] <speaker> text`` line."""
    c = F.col(line) if isinstance(line, str) else line
    timed = F.regexp_extract(c, LINE_TIME, 1) != ""
    body = F.when(timed, F.trim(F.regexp_replace(c, LINE_TIME, ""))).otherwise(c)
    who = F.regexp_extract(body, LINE_SPEAKER, 1)
    system = F.startswith(body, F.lit("===")) | (who == "")
    return F.struct(
        F.when(system, F.lit("")).otherwise(who).alias("speaker"),
        F.when(system, body).otherwise(F.regexp_extract(body, LINE_SPEAKER, 2)).alias("text"),
        system.alias("is_system"),
    )


def parse_annotation(line: str | Column) -> Column:
    """array<struct(child, parent)>: the largest number is the child; two equal numbers mark a root."""
    c = F.col(line) if isinstance(line, str) else line
    nums = F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: F.rlike(x, F.lit(r"^\d+$"))), lambda x: x.cast("long"))
    top = F.array_max(nums)
    root = (F.size(nums) == 2) & (F.get(nums, F.lit(0)) == F.get(nums, F.lit(1)))
    others = F.when(root, F.array(top)).otherwise(F.filter(nums, lambda x: x != top))
    pairs = F.transform(others, lambda x: F.struct(top.alias("child"), x.alias("parent")))
    return F.when(F.size(nums) >= 2, pairs).otherwise(F.array().cast("array<struct<child:bigint,parent:bigint>>"))


def numbered_lines(spark: SparkSession, glob: str, suffix: str) -> DataFrame:
    """(name, split, pos, line): one task per file, since the line number is the message id."""
    raw = tune(spark).read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return raw.select(
        F.replace(base, F.lit(suffix), F.lit("")).alias("name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("split"),
        F.posexplode(lines).alias("pos", "line"),
    )


def read_chat_logs(spark: SparkSession, root: str, with_gold: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``root/SPLIT/NAME.{tok,ascii,annotation}.txt`` -> (messages, edges); self links stay as edges."""
    key = ["split", "name", "pos"]
    tok = numbered_lines(spark, f"{root}/*/*.tok.txt", ".tok.txt").withColumnRenamed("line", "tok")
    raw = numbered_lines(spark, f"{root}/*/*.ascii.txt", ".ascii.txt").withColumn("p", parse_line("line"))
    words = F.filter(F.split(F.trim("tok"), r"\s+"), lambda w: w != "")
    words = F.when(F.element_at(words, -1) == "</s>", F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    words = F.when(F.get(words, F.lit(0)) == "<s>", words).otherwise(F.concat(F.array(F.lit("<s>")), words))
    msgs = tok.withColumn("tokens", words).join(raw, key, "left").select(
        F.col("split").alias("dataset"), F.col("name").alias("conv_id"), F.col("pos").cast("long").alias("pos"),
        F.coalesce("p.speaker", F.lit("")).alias("author"),
        F.array_join(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(1))), " ").alias("text"),
        F.coalesce("p.is_system", F.lit(True)).alias("is_system"), F.coalesce("line", F.lit("")).alias("raw"), "tokens",
    )
    if not with_gold:
        return msgs, None
    ann = numbered_lines(spark, f"{root}/*/*.annotation.txt", ".annotation.txt")
    edges = ann.select("split", "name", F.explode(parse_annotation("line")).alias("e"))
    return msgs, edges.select(F.col("split").alias("dataset"), F.col("name").alias("conv_id"), "e.child", "e.parent").distinct()


def profile_logs(msgs: DataFrame, edges: DataFrame, files_per_split: int = 80) -> tuple[DataFrame, DataFrame]:
    """The profile variant: the first files of a split, clock time in seconds, no self links."""
    from threadloom.operators.ordered import number_rows

    names = number_rows(msgs.select(*CONV).distinct(), ["dataset"], ["conv_id"], "nth").where(F.col("nth") < files_per_split)
    hour, minute = F.regexp_extract("raw", r"^\[(\d{2}):(\d{2})\]", 1), F.regexp_extract("raw", r"^\[(\d{2}):(\d{2})\]", 2)
    seconds = F.when(hour != "", hour.cast("int") * 3600 + minute.cast("int") * 60)
    kept = msgs.join(names, CONV, "left_semi").withColumn("seconds", seconds)
    return kept, edges.where("child <> parent").join(names, CONV, "left_semi")


def parse_gold_graph(line: str | Column) -> Column:
    """struct(name, child, parent) of ``file:src tgt -``; NULL for comments and blank lines."""
    c = F.col(line) if isinstance(line, str) else line
    pat = r"^\s*([^#:][^:]*):(\d+)\s+(\d+)"
    got = F.struct(
        F.regexp_extract(c, pat, 1).alias("name"),
        F.regexp_extract(c, pat, 2).try_cast("long").alias("child"),
        F.regexp_extract(c, pat, 3).try_cast("long").alias("parent"),
    )
    return F.when(F.rlike(c, F.lit(pat)), got)


def read_gold_graph(spark: SparkSession, path: str) -> DataFrame:
    lines = tune(spark).read.text(path)
    return lines.select(parse_gold_graph("value").alias("g")).where("g is not null").select("g.*").distinct()
