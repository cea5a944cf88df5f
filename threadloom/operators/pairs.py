"""Candidate pairs in the window: labels, scalar features, similarities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import speaker, words
from threadloom.operators.blocks import PART_ROWS, band_pairs, with_reach
from threadloom.operators.graph import keyed_schema
from threadloom.schema import CONV, WINDOW
from threadloom.session import materialize

try:
    from _md5 import md5  # a short text takes half the time of hashlib's
except ImportError:
    from hashlib import md5

PAIR = [*CONV, "_blk", "i"]


def with_gold(children: DataFrame, gold: DataFrame, asked_only: bool = True) -> DataFrame:
    """Attach the gold parents of child ``i`` as the short array ``_gold``; by default children without any go."""
    parents = gold.groupBy(*CONV, F.col("child").alias("i")).agg(F.collect_set("parent").alias("_gold"))
    return children.join(parents, [*CONV, "i"], "inner" if asked_only else "left")


def candidates(
    msgs: DataFrame, child_cols: Sequence[str] = (), cand_cols: Sequence[str] = (), w: int = WINDOW, include_self: bool = False, gold: DataFrame | None = None
) -> DataFrame:
    """Pairs with the chosen message columns as ``i_*`` and ``c_*``.

    With ``gold``, only pairs of children that have gold parents, ready for :func:`label`: the
    parents join the children before there are pairs.
    """
    left = msgs.select(*CONV, F.col("pos").alias("i"), *[F.col(c).alias(f"i_{c}") for c in child_cols])
    left = left if gold is None else with_gold(left, gold)
    right = msgs.select(*CONV, F.col("pos").alias("c"), *[F.col(c).alias(f"c_{c}") for c in cand_cols])
    return band_pairs(left, right, w, include_self)


def label(pairs: DataFrame, gold: DataFrame, asked_only: bool = True) -> DataFrame:
    """Attach ``label``; by default keep only children that have gold parents at all.

    Pairs whose children carry their gold parents already (``_gold``) stay where they are; others
    are dealt by child, so join the parents to the children first where pairs are many.
    """
    out = pairs if "_gold" in pairs.columns else with_gold(pairs, gold, asked_only)
    hit = F.coalesce(F.array_contains("_gold", F.col("c")), F.lit(False))
    return out.withColumn("label", hit.cast("int")).drop("_gold")


def features(pairs: DataFrame) -> DataFrame:
    """The six scalar pair features; needs author, ts_us and n_chars of both sides."""
    gap = (F.col("i") - F.col("c")).cast("double")
    timed = F.col("i_ts_us").isNotNull() & F.col("c_ts_us").isNotNull()
    seconds = F.greatest((F.col("i_ts_us") - F.col("c_ts_us")) / 1e6, F.lit(0.0))
    same = (F.col("i_author") == F.col("c_author")) & (F.col("i_author") != "")
    return pairs.withColumns(
        {
            "same_author": F.coalesce(same, F.lit(False)).cast("double"),
            "log_gap": F.log1p(gap),
            "log_seconds": F.when(timed, F.log1p(seconds)).otherwise(F.lit(0.0)),
            "has_ts": timed.cast("double"),
            "log_len_diff": F.log1p(F.abs(F.col("i_n_chars") - F.col("c_n_chars")).cast("double")),
            "log_between": F.log1p(gap - 1),
        }
    )


FEATURES = ["same_author", "log_gap", "log_seconds", "has_ts", "log_len_diff", "log_between"]


def scored(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    """A plain closed-form score in (0, 1]: nearness, same author, and "i mentions c's author".

    Needs ``mentions``.  Uses only exact arithmetic, so any engine gets the same bits.
    """
    p = candidates(msgs, ["author", "mentions"], ["author"], w)
    same = (F.col("i_author") == F.col("c_author")).cast("double")
    named = F.array_contains("i_mentions", F.col("c_author")).cast("double")
    score = (1 + 40 * same + 15 * named) / (56.0 * (F.col("i") - F.col("c")))
    return p.select(*CONV, "_blk", "i", "c", score.alias("score"))


# ---------------------------------------------------------------- pairs that are looked at and not made

#: Positions that a grouped task looks at together.
STRETCH = 8192


def by_stretch(msgs: DataFrame, cols: Sequence[str], gold: DataFrame, look: Callable[[pa.Table], pa.Table], rest: str, w: int = WINDOW) -> DataFrame:
    """Hand ``look`` the messages of ``STRETCH`` positions and of the ``w`` positions before, in order.

    The tables hold the position as ``i``, ``cols``, the gold parents as ``_gold`` (null: none) and as
    ``_own`` whether a message is of the stretch itself.  ``rest``: columns of the result besides the keys.
    Positions are unique in a conversation.
    """
    rows = with_gold(msgs.select(*CONV, F.col("pos").alias("i"), *cols), gold, asked_only=False)
    rows = with_reach(rows.dropna(subset=CONV), "i", w, STRETCH).withColumn("_own", F.floor(F.col("i") / STRETCH) == F.col("_blk"))
    n = max(1, -(-msgs.count() // PART_ROWS))
    return rows.repartition(n, *CONV, "_blk").groupBy(*CONV, "_blk").applyInArrow(lambda t: look(t.sort_by("i")), keyed_schema(rows, CONV, rest))


def sampled(msgs: DataFrame, gold: DataFrame, cols: Sequence[str], k: int = 2, seed: int = 7, w: int = WINDOW) -> DataFrame:
    """Candidates of messages with gold parents: the true ones and ``k`` others each, drawn by a seeded hash.

    The same rows as ``sample_negatives(label(candidates(msgs, cols, cols, gold=gold), gold), k, seed)``; other pairs are not made.
    """
    types = dict(msgs.dtypes)
    sides = [f"{p}_{c} {types[c]}" for p in "ic" for c in cols]

    def look(t: pa.Table) -> pa.Table:
        pos, names = t["i"].to_numpy(), [t[k][0].as_py() for k in CONV]
        first, at = np.searchsorted(pos, pos - w).tolist(), pos.tolist()
        ends = [f"{c}|{seed}".encode() for c in at]
        rows: list[tuple[int, int, int]] = []
        for n, (own, true) in enumerate(zip(t["_own"].to_pylist(), t["_gold"].to_pylist())):
            if not own or true is None:
                continue
            true, begin = set(true), "|".join([*names, f"{at[n]}|"]).encode()
            start, draws = md5(begin).copy, []
            for end in ends[first[n] : n]:
                draw = start()
                draw.update(end)
                draws.append(draw.digest())
            near = [first[n] + m for m in sorted(range(len(draws)), key=draws.__getitem__)]
            rows += [(n, m, 1) for m in near if at[m] in true]
            rows += [(n, m, 0) for m in islice((m for m in near if at[m] not in true), k)]
        kid, cand, label = (np.array(x, dtype=np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        i, c = t.take(kid), t.take(cand)
        made = {"i": i["i"], "c": c["i"], "label": pa.array(label, pa.int32()), **{f"i_{x}": i[x] for x in cols}, **{f"c_{x}": c[x] for x in cols}}
        return pa.table({**{x: i[x] for x in CONV}, **made})

    got = by_stretch(msgs, cols, gold, look, ", ".join(["i long, c long, label int", *sides]), w)
    return got.withColumn("_blk", F.floor(F.col("i") / max(w, 128)))


def decoded(
    msgs: DataFrame, gold: DataFrame, models: dict[str, tuple[Sequence[float], float]], tau: float = 0.5, only: str | None = None, w: int = WINDOW
) -> DataFrame:
    """(conversation, child, parent, name): candidates that a linear model on :data:`FEATURES` gives ``tau`` or more, or the best one if it gives none so much.

    Of all messages with gold parents.  ``models``: coefficients and intercept under each name;
    ``only``: a column with the name of the one model that is asked there.  Needs author, ts_us and
    n_chars; pairs are numbers of a task and never rows.
    """
    cols = ["author", "ts_us", "n_chars", *([only] if only else [])]

    def look(t: pa.Table) -> pa.Table:
        pos = t["i"].to_numpy()
        who = t["author"].combine_chunks().dictionary_encode()
        author = who.indices.fill_null(-1).to_numpy()
        blank = who.dictionary.to_pylist().index("") if "" in who.dictionary.to_pylist() else -1
        real = (author >= 0) & (author != blank)
        timed, ts = t["ts_us"].is_valid().to_numpy(), t["ts_us"].fill_null(0).to_numpy()
        chars = t["n_chars"].cast(pa.float64()).fill_null(float("nan")).to_numpy()
        asked = np.flatnonzero(t["_own"].to_numpy(zero_copy_only=False) & t["_gold"].is_valid().to_numpy())
        use = {n: m for n, m in models.items() if only is None or n == str(t[only][0].as_py())}
        best = {n: (np.full(len(pos), -np.inf), np.full(len(pos), -1)) for n in use}
        found: list[tuple[str, np.ndarray, np.ndarray]] = []
        for d in range(1, w + 1):
            kid = asked[asked >= d]
            kid = kid[pos[kid - d] >= pos[kid] - w]
            if not len(kid):
                break
            cand = kid - d
            gap = (pos[kid] - pos[cand]).astype(float)
            both = timed[kid] & timed[cand]
            seconds = np.maximum((ts[kid] - ts[cand]) / 1e6, 0.0)
            same = (author[kid] == author[cand]) & real[kid]
            x = [same.astype(float), np.log1p(gap), np.where(both, np.log1p(seconds), 0.0), both.astype(float), np.log1p(np.abs(chars[kid] - chars[cand])), np.log1p(gap - 1)]
            for name, (weights, base) in use.items():
                score = probability(sum(v * f for v, f in zip(weights, x)) + base, np.exp)
                top, arg = best[name]
                new = score >= top[kid]  # of equal ones the oldest, which comes last
                top[kid[new]], arg[kid[new]] = score[new], cand[new]
                high = score >= tau
                found.append((name, kid[high], cand[high]))
        for name, (top, arg) in best.items():
            kid = np.flatnonzero((arg >= 0) & (top < tau))
            found.append((name, kid, arg[kid]))
        kid, cand = (np.concatenate([f[k] for f in found]) if found else np.empty(0, dtype=np.int64) for k in (1, 2))
        name = pa.concat_arrays([pa.repeat(n, len(k)) for n, k, _ in found]) if found else pa.array([], pa.string())
        return pa.table({**{x: pa.repeat(t[x][0], len(kid)) for x in CONV}, "child": pos[kid], "parent": pos[cand], "name": name})

    return by_stretch(msgs, cols, gold, look, "child long, parent long, name string", w)


def probability(margin, exp):
    """Of the positive class, from the margin of a logistic model; columns or arrays."""
    with np.errstate(over="ignore"):
        return 1.0 - 1.0 / (1.0 + exp(margin))


# ---------------------------------------------------------------- vectors inside a block


def _blocked(msgs: DataFrame, w: int) -> DataFrame:
    size = max(w, 128)
    rows = with_reach(msgs.select(*CONV, "pos", "vec"), "pos", w, size)
    return rows.withColumn("_own", F.floor(F.col("pos") / size) == F.col("_blk"))


def _similarities(pdf: pd.DataFrame, w: int):
    """Own rows, all rows of the block, and their dot products with out-of-window pairs at -inf."""
    pdf = pdf.sort_values("pos")
    own = pdf[pdf["_own"]]
    kids, cands = own["pos"].to_numpy(), pdf["pos"].to_numpy()
    sims = np.stack(own["vec"].to_numpy()).astype(np.float64) @ np.stack(pdf["vec"].to_numpy()).astype(np.float64).T
    gap = kids[:, None] - cands[None, :]
    sims[(gap < 1) | (gap > w)] = -np.inf
    return kids, cands, sims


def most_similar(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    """(conversation, child, parent, score): largest dot product in the window, oldest on ties.

    One matrix product per block of positions; the pairs themselves are never written down.
    """

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_own"].any():
            return pd.DataFrame(columns=[*CONV, "child", "parent", "score"])
        kids, cands, sims = _similarities(pdf, w)
        at = sims.argmax(axis=1)
        out = pd.DataFrame({"child": kids, "parent": cands[at], "score": sims[np.arange(len(kids)), at]})
        out.insert(0, CONV[1], key[1])
        out.insert(0, CONV[0], key[0])
        return out[np.isfinite(out["score"])]

    rows = _blocked(msgs, w)
    schema = keyed_schema(rows, CONV, "child long, parent long, score double")
    return rows.groupBy(*CONV, "_blk").applyInPandas(best, schema)


def pair_dots(msgs: DataFrame, w: int = WINDOW) -> DataFrame:
    """(conversation, i, c, dot) for every pair of the window."""

    def dots(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_own"].any():
            return pd.DataFrame(columns=[*CONV, "_blk", "i", "c", "dot"])
        kids, cands, sims = _similarities(pdf, w)
        r, k = np.nonzero(np.isfinite(sims))
        out = pd.DataFrame({"_blk": key[2], "i": kids[r], "c": cands[k], "dot": sims[r, k]})
        out.insert(0, CONV[1], key[1])
        out.insert(0, CONV[0], key[0])
        return out

    rows = _blocked(msgs, w)
    schema = keyed_schema(rows, CONV, "_blk long, i long, c long, dot double")
    return rows.groupBy(*CONV, "_blk").applyInPandas(dots, schema)


# ---------------------------------------------------------------- words


def fit_idf(texts: DataFrame) -> DataFrame:
    """(word, idf) with idf = ln((1+N)/(1+df)) + 1, and the value for unseen words in ``unseen``; written once."""
    n = F.lit(texts.count())
    df = texts.select(F.explode(F.array_distinct(words("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    out = df.select("word", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"), (F.log(1.0 + n) + 1).alias("unseen"))
    return materialize(out, "idf")


def weigh(rows: DataFrame, idf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, word, weight, norm): tf-idf weights of every text and the length of its vector; written once."""
    tf = rows.select(*keys, F.explode(words("text")).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("tf"))
    known = idf.select("unseen").first()  # one number
    unseen = F.lit(known[0] if known else 1.0)
    w = tf.join(idf.select("word", "idf"), "word", "left")
    w = w.select(*keys, "word", (F.col("tf") * F.coalesce("idf", unseen)).alias("weight"))
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return materialize(w.join(norm, list(keys)), "weights")


def shared_words(weights: DataFrame, w: int = WINDOW) -> DataFrame:
    """(conversation, _blk, i, c, cosine, n_shared) of pairs in the window that share a word.

    The word is part of the join key and the block bounds each key, so a word that everybody uses
    meets at most a window of partners.
    """
    size = max(w, 128)
    left = weights.select(*CONV, F.col("pos").alias("i"), "word", F.col("weight").alias("a"), F.col("norm").alias("na"))
    left = left.withColumn("_blk", F.floor(F.col("i") / size))
    right = weights.select(*CONV, F.col("pos").alias("c"), "word", F.col("weight").alias("b"), F.col("norm").alias("nb"))
    met = left.join(with_reach(right, "c", w, size), [*CONV, "_blk", "word"]).where((F.col("c") < F.col("i")) & (F.col("c") >= F.col("i") - w))
    return met.groupBy(*CONV, "_blk", "i", "c").agg(
        (F.sum(F.col("a") * F.col("b")) / (F.first("na") * F.first("nb"))).alias("cosine"), F.count("*").alias("n_shared")
    )


# Weights and thresholds of the feature score.
WEIGHTS = {
    "dist_log": -0.8, "same_speaker": 1.2, "mention": 2.5, "overlap": 1.5,
    "cosine": 2.0, "short_answer": 0.6, "prev1": 0.9, "root_bias": 0.35,
}
SHORT_WORDS, SECOND_MARGIN, SECOND_MIN = 8, 0.05, 0.5
DECAY, MIN_COSINE = 0.02, 0.02


def feature_scores(msgs: DataFrame, idf: DataFrame, w: int = WINDOW) -> DataFrame:
    """(conversation, _blk, i, c, score): hand-weighted combination of the plain features."""
    from threadloom.functions.text import addressee

    toks = words("text")
    side = msgs.select(
        *CONV, "pos", speaker("author").alias("who"), addressee("text").alias("asked"), F.size(toks).alias("n_words"),
        F.size(F.array_distinct(toks)).alias("n_distinct"), F.rlike("text", F.lit(r"\?\s*$")).alias("question"),
    )
    p = candidates(side, ["who", "asked", "n_words", "n_distinct"], ["who", "n_distinct", "question"], w)
    met = shared_words(weigh(msgs, idf, [*CONV, "pos"]), w)
    p = p.join(met, [*CONV, "_blk", "i", "c"], "left").na.fill(0.0, ["cosine"]).na.fill(0, ["n_shared"])
    g, zero = WEIGHTS, F.lit(0.0)
    smaller = F.least("i_n_distinct", "c_n_distinct")
    overlap = F.when(smaller > 0, F.col("n_shared") / F.greatest(smaller, F.lit(1))).otherwise(zero)
    on = lambda cond, name: F.when(cond, F.lit(g[name])).otherwise(zero)
    score = (
        g["dist_log"] * F.log1p((F.col("i") - F.col("c")).cast("double"))
        + on((F.col("i_who") == F.col("c_who")) & (F.col("i_who") != ""), "same_speaker")
        + on(F.col("i_asked") == F.col("c_who"), "mention")
        + g["overlap"] * overlap
        + g["cosine"] * F.col("cosine")
        + on(F.col("c_question") & (F.col("i_n_words") <= SHORT_WORDS), "short_answer")
        + on(F.col("c") == F.col("i") - 1, "prev1")
    )
    return p.select(*CONV, "_blk", "i", "c", score.alias("score"))
