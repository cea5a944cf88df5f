"""The messages, gold edges and predictions that the registered queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.edge_metrics import compare
from threadloom.operators.probes import run_probes
from threadloom.operators.silver import edges_of, mention_lookup, sized
from threadloom.schema import HOUR_US, WINDOW
from threadloom.sources.events import event_messages, prepared, read_turns, with_mentions

NAMES = ["prev1", "saprev"]


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return event_messages(spark, sf)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, ("turns", sf), lambda: read_turns(spark, sf))


def lookup(spark: SparkSession, sf: str, hours: int = 6, first_only: bool = False, min_msgs: int = 30) -> DataFrame:
    msgs = with_mentions(sized(messages(spark, sf), min_msgs), first_only)
    return mention_lookup(msgs, hours * HOUR_US)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold edges of the evaluation queries: both mentions, 24 hours (several parents occur)."""
    return prepared(spark, ("gold", sf), lambda: edges_of(lookup(spark, sf, 24, False, 0)))


def preds(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    return run_probes(messages(spark, sf), names or NAMES)


def compared(spark: SparkSession, sf: str, names: list[str] | None = None, w: int | None = WINDOW) -> DataFrame:
    return compare(gold(spark, sf), preds(spark, sf, names), names or NAMES, w)


# ---------------------------------------------------------------- the same tables in SQL

MSGS = """
m0 AS (
  SELECT event_type AS dataset,
         event_type || '-w' || CAST(epoch_us(ts) // 604800000000 AS VARCHAR) AS conv_id,
         event_id AS msg_id, CAST(user_id AS VARCHAR) AS author, epoch_us(ts) AS ts_us,
         CAST(json_extract(props, '$.k') AS VARCHAR) AS m1, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS m2,
         '<@' || CAST(json_extract(props, '$.k') AS VARCHAR) || '> ' || event_type || ' <@'
           || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '>' AS text
  FROM events),
msgs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts_us, msg_id) - 1 AS pos FROM m0)"""


def lookup_sql(name: str, hours: int, first_only: bool, min_msgs: int) -> str:
    """CTEs up to ``name``: one row per message and distinct mention with the parent found."""
    second = "" if first_only else "UNION SELECT dataset, conv_id, pos, ts_us, m2 FROM kept_{n}".replace("{n}", name)
    return f"""
kept_{name} AS (
  SELECT * FROM msgs WHERE conv_id IN (SELECT conv_id FROM msgs GROUP BY conv_id HAVING count(*) >= {min_msgs})),
ask_{name} AS (
  SELECT dataset, conv_id, pos, ts_us, m1 AS name FROM kept_{name} {second}),
{name} AS (
  SELECT a.dataset, a.conv_id, a.pos AS child, a.name, a.ts_us,
         CASE WHEN a.ts_us - p.ts_us <= {hours} * 3600000000 THEN p.pos END AS parent,
         CASE WHEN a.ts_us - p.ts_us <= {hours} * 3600000000 THEN a.ts_us - p.ts_us END AS lag_us
  FROM ask_{name} a ASOF LEFT JOIN kept_{name} p
    ON a.conv_id = p.conv_id AND a.name = p.author AND a.ts_us > p.ts_us)"""


GOLD = lookup_sql("look24", 24, False, 0) + """,
gold AS MATERIALIZED (SELECT DISTINCT dataset, conv_id, child, parent FROM look24 WHERE parent IS NOT NULL)"""

PREDS = """
preds AS (
  SELECT 'prev1' AS algorithm, dataset, conv_id, pos AS child, pos - 1 AS parent FROM msgs WHERE pos > 0
  UNION ALL
  SELECT 'saprev', dataset, conv_id, pos, CASE WHEN pos - lp <= 100 THEN lp ELSE pos - 1 END
  FROM (SELECT *, lag(pos) OVER (PARTITION BY conv_id, author ORDER BY pos) AS lp FROM msgs) WHERE pos > 0),
algs AS (SELECT unnest(['prev1', 'saprev']) AS algorithm)"""

COMPARED = """
gw AS (SELECT * FROM gold WHERE child - parent <= 100),
ga AS (SELECT algorithm, gw.* FROM gw, algs),
cmp AS (
  SELECT coalesce(g.algorithm, p.algorithm) AS algorithm, coalesce(g.dataset, p.dataset) AS dataset,
         coalesce(g.conv_id, p.conv_id) AS conv_id, coalesce(g.child, p.child) AS child,
         coalesce(g.parent, p.parent) AS parent,
         g.child IS NOT NULL AS in_gold, p.child IS NOT NULL AS in_pred
  FROM ga g FULL OUTER JOIN preds p
    ON g.algorithm = p.algorithm AND g.conv_id = p.conv_id AND g.child = p.child AND g.parent = p.parent)"""

EVAL = f"WITH RECURSIVE {MSGS}, {GOLD}, {PREDS}, {COMPARED}"


def prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn", prefix: str = "") -> str:
    p = f"({tp}::DOUBLE / greatest({tp} + {fp}, 1))"
    r = f"({tp}::DOUBLE / greatest({tp} + {fn}, 1))"
    return (
        f"round(100 * {p}, 6) AS {prefix}P, round(100 * {r}, 6) AS {prefix}R, "
        f"round(100 * 2 * {p} * {r} / greatest({p} + {r}, 1e-9), 6) AS {prefix}F1"
    )


COUNTS = (
    "count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, "
    "count(*) FILTER (in_gold AND NOT in_pred) AS fn"
)
