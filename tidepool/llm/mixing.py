"""Mixing sources to target weights (operator 6) by iterative proportional fitting.

Documents fall in cells (source, language, topic). Token weights of the cells are
raked until their marginals match the targets of each dimension; then a document is
kept with probability rate * raked weight / tokens of its cell, decided by a hash of
the document, so a rerun keeps the same rows.

No probability is above 1: raking holds the weights at tokens / rate and takes what
such cells can't supply from the others. A value whose documents are too few for its
target is kept whole, and the others of its dimension share what it misses, so the
sample has the rate of all tokens; marginals() lists what is missing.

Cells are aggregated before anything moves and stay a Spark table: raking is window
sums over cells. The cell table is broadcast to the documents only if its counted
size is at most BROADCAST_CELLS; else a sort-merge join takes over, whose hot cells
AQE splits.

Default targets: the shares of tokens, each to the power TEMPER, made to sum to 1, so
large sources, languages and topics give way to small ones.

Defined cases: a null source or language counts as the empty name; a null text has
no tokens and stays with the probability of its cell; cells without tokens keep
probability 1; values without a target (where targets are given) go; repeated rows
share one decision; empty tables give no rows; clashing extra columns are kept.
"""

from __future__ import annotations

import warnings
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import dropped, written

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.7
#: Tokens wanted, as a share of all tokens.
KEEP = 0.6
#: Sweeps of one plan: longer plans take longer to make than to run.
SWEEPS, CLOSE = 2, 1e-4
#: Raking ends with a warning if this many rounds of SWEEPS bring no marginal nearer.
STALLED = 3
BROADCAST_CELLS = 20_000


def topic_of(text: Column) -> Column:
    """A coarse topic of a text by fixed marks."""
    return (
        F.when(text.contains("licens") | text.contains("copyright"), "legal").when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table").otherwise("prose")
    )


def measured(docs: DataFrame, topic: Column | None = None) -> list[Column]:
    """Columns c_source, c_lang, c_topic, c_tokens and c_draw (0 to 1) of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.coalesce(F.col("source"), F.lit("")).alias("c_source"), F.coalesce(F.col("lang"), F.lit("")).alias("c_lang"),
        (topic_of(text) if topic is None else topic).alias("c_topic"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("c_tokens"),
        (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 11).cast("double") / float(1 << 53)).alias("c_draw"),
    ]


def _level(goal: Column, cap: Column, x: Column, by, order: list[Column]) -> Column:  # noqa: ANN001
    """The factor f of a partition with sum(least(cap, f * x)) = goal; one that takes all to
    their caps if they are less than goal. order is by cap / x. To count the first k as
    capped and no other never counts too little, so the best of these factors is exact."""
    w = by.orderBy(*order)
    before = F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return (goal - before) / F.sum(x).over(w.rowsBetween(0, Window.unboundedFollowing))


def _goals(cells: DataFrame, d: str, given: dict[str, float] | None, keep: float | None) -> DataFrame:
    """(c_d, target_d, goal_d) of the values of a dimension, in tokens of weight. What a
    value can't supply at probability 1 goes to the others, by their targets."""
    values = cells.groupBy(f"c_{d}").agg(F.sum("tokens").cast("double").alias("mass"))
    raw = F.pow("mass", F.lit(TEMPER)) if given is None else F.create_map(*chain(*((F.lit(k), F.lit(float(v))) for k, v in given.items())))[F.col(f"c_{d}")]
    all_values = Window.partitionBy()
    values = values.withColumn("raw", raw).withColumn("n", F.sum("mass").over(all_values))
    values = values.withColumn("target", F.col("raw") * F.col("n") / F.sum("raw").over(all_values))
    if keep is None:
        return values.select(f"c_{d}", F.col("target").alias(f"target_{d}"), F.col("target").alias(f"goal_{d}"))
    cap = F.col("mass") / F.lit(keep)
    values = values.withColumn("f", _level(F.col("n"), cap, F.col("target"), all_values, [F.col("mass") / F.col("target"), F.col(f"c_{d}")]))
    return values.select(f"c_{d}", F.col("target").alias(f"target_{d}"), F.least(cap, F.col("target") * F.max("f").over(all_values)).alias(f"goal_{d}"))


def _targeted(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """Cells with tokens whose values all have a target."""
    cells = cells.where("tokens > 0")
    for d, given in (targets or {}).items():
        cells = cells.where(F.col(f"c_{d}").isin([k for k, v in given.items() if v > 0]))
    return cells


def _raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float | None) -> DataFrame:
    """cells with weight w, target_d and goal_d."""
    by = {d: Window.partitionBy(f"c_{d}") for d in DIMENSIONS}
    cells = _targeted(cells, targets)
    current = cells.withColumn("m", F.lit(1.0))
    for d in DIMENSIONS:
        current = current.join(F.broadcast(_goals(cells, d, (targets or {}).get(d), keep)), f"c_{d}")
    last = current = written(current, "cells")
    x = F.col("tokens") * F.col("m")
    cap = None if keep is None else F.col("tokens") / F.lit(keep)
    w = x if keep is None else F.least(cap, x)
    offs: list[float] = []
    while True:
        for _ in range(SWEEPS):
            for d in DIMENSIONS:
                goal = F.col(f"goal_{d}")
                if keep is None:
                    current = current.withColumn("m", F.col("m") * goal / F.sum(x).over(by[d]))
                else:
                    order = [F.col("m").desc(), *(F.col(f"c_{e}") for e in DIMENSIONS)]
                    current = current.withColumn("f", _level(goal, cap, x, by[d], order)).withColumn("m", F.col("m") * F.max("f").over(by[d])).drop("f")
        current = written(current, "raked")
        dropped(last)
        last = current
        off = current
        for d in DIMENSIONS:
            off = off.withColumn(f"off_{d}", F.abs(F.sum(w).over(by[d]) / F.col(f"goal_{d}") - 1))
        offs.append(off.agg(F.max(F.greatest(*(f"off_{d}" for d in DIMENSIONS)))).first()[0] or 0.0)
        if offs[-1] < CLOSE:
            break
        if len(offs) > STALLED and offs[-1] > 0.99 * offs[-1 - STALLED]:
            warnings.warn(f"mixing: the targets can't be met together, a marginal stays off by {offs[-1]:.3g}; see marginals()", stacklevel=2)
            break
    return current.withColumn("w", w).drop("m")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float | None = None) -> DataFrame:
    """cells (c_source, c_lang, c_topic, tokens) with their raked weight; the weights
    sum to the tokens of all cells that have a target. With keep, none is above
    tokens / keep: what such a cell can't supply comes from others."""
    return _raked(cells, targets, keep).select(*(f"c_{d}" for d in DIMENSIONS), "tokens", "w")


def _counted(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("c_source", "c_lang", "c_topic").agg(F.sum("c_tokens").alias("tokens")), "counted")


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """(dimension, value, target, expected, missing) in tokens of the sample: missing is
    what of the target the value can't get, for its documents have too few tokens or the
    other dimensions' targets exclude it; negative where it takes what others miss."""
    raked = _raked(_counted(docs.select(*measured(docs, topic))), targets, keep)
    out = None
    for d in DIMENSIONS:
        target, expected = F.first(f"target_{d}") * F.lit(keep), F.sum("w") * F.lit(keep)
        part = raked.groupBy(F.lit(d).alias("dimension"), F.col(f"c_{d}").alias("value")).agg(target.alias("target"), expected.alias("expected"), (target - expected).alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """rows (with the columns of measured()) plus c_probability."""
    cells = _counted(rows)
    raked = rake(cells, targets, keep).select(*(f"c_{d}" for d in DIMENSIONS), F.least(F.lit(1.0), F.lit(keep) * F.col("w") / F.col("tokens")).alias("p"))
    # cells without tokens keep 1, cells without a target get 0
    p = F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("p", F.lit(0.0)))
    final = written(cells.hint("merge").join(raked.hint("merge"), [f"c_{d}" for d in DIMENSIONS], "left").select(*(f"c_{d}" for d in DIMENSIONS), p.alias("c_probability")), "probability")
    small = final.count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(final) if small else final.hint("merge"), [f"c_{d}" for d in DIMENSIONS])


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    names = docs.columns
    packed = docs.select(F.struct("*").alias("c_row"), *measured(docs, topic))
    return probabilities(packed, targets, keep).where("c_draw < c_probability").select(*(F.col("c_row")[n].alias(n) for n in names))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its cell, tokens, probability and whether it is kept."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *measured(docs)), "measured")
    return probabilities(rows).select(
        "doc_id", F.col("c_source").alias("source"), F.col("c_lang").alias("lang"), F.col("c_topic").alias("topic"), F.col("c_tokens").alias("tokens"),
        F.col("c_probability").alias("probability"), (F.col("c_draw") < F.col("c_probability")).alias("kept"),
    )
