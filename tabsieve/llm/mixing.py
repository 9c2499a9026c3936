"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted once per cell (source, language, topic).  A cell's weight is a product of one factor
per margin; raking rescales one margin's factors after another until the weighted tokens meet every
margin's target.  A document is then kept with probability ``min(1, c * weight)``, with ``c`` solved for
the wanted number of tokens.  While no ``c * weight`` passes 1 the expected tokens of every margin are in
the target ratios; beyond that the most wanted cells are kept whole, so a tiny cell never sets the rate of
the others, and what the margins then miss is reported.

A margin may have any number of values: cells, targets and factors stay tables.  A sweep sums the cells by each margin and
brings the factors back by a counted lookup; documents meet their cells the same way.  Only a table of few cells, counted, is
raked in one place.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.common import BROADCAST_ROWS, lookup

_LOG = logging.getLogger(__name__)
TOLERANCE, SWEEPS = 1e-6, 200


def _key(column: str) -> Column:
    """A margin's value as text, with a missing value as a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def shares(cells: DataFrame, margin: str, wanted: float | dict[str, float]) -> DataFrame:
    """``(margin, goal)``: target shares of the values that have tokens.  A power of the token shares (1 keeps them, 0 makes them
    equal), or given weights by value, where values that are not named get none."""
    tokens = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    if isinstance(wanted, dict):
        named = cells.sparkSession.createDataFrame([("-" if k is None else f"={k}", float(v)) for k, v in wanted.items()],
                                                   f"{margin} string, raw double")
        raw = tokens.join(F.broadcast(named), margin, "left").select(margin, F.coalesce("raw", F.lit(0.0)).alias("raw"))  # as many as the caller named
    else:
        raw = tokens.select(margin, F.pow("t", F.lit(float(wanted))).alias("raw"))
    raw = raw.checkpoint()
    whole = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(margin, (F.col("raw") / F.lit(whole)).alias("goal"))


def rake(cells: DataFrame, margins: list[str], targets: dict[str, float | dict[str, float]]) -> tuple[DataFrame, float]:
    """``cells`` (the margins' key columns and ``tokens``) with ``__w`` and the targets ``__goal_<margin>``, raked, and the largest relative
    miss of a target in the last sweep.

    Up to ``BROADCAST_ROWS`` counted cells are raked as one small table, more by a join and a grouped sum per margin; the
    steps are the same.  Cells without tokens are left out.  Where targets contradict each other (a target for cells that
    have no tokens), raking stops after ``SWEEPS`` rounds with the residual it has, and warns."""
    cells = cells.where("tokens > 0").checkpoint()
    few = cells.count() <= BROADCAST_ROWS
    work = cells
    for m in margins:  # every cell has a target in each margin
        goal = shares(cells, m, targets[m]).withColumnRenamed("goal", f"__goal_{m}")
        work = work.join(F.broadcast(goal), m) if few else lookup(work, goal.checkpoint(), m, F.struct(*margins))
    out, residual = (_rake_few if few else _rake_many)(work.checkpoint(), margins)
    if residual >= TOLERANCE:
        _LOG.warning("raking stopped after %d sweeps; targets are missed by up to %g", SWEEPS, residual)
    return out, residual


def _rake_few(work: DataFrame, margins: list[str]) -> tuple[DataFrame, float]:
    table = work.toArrow()  # at most ``BROADCAST_ROWS``
    mass, residual = table["tokens"].to_numpy().astype(float), 0.0
    weight = np.ones(len(mass))
    groups = [np.unique(table[m].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1] for m in margins]
    goals = [table[f"__goal_{m}"].to_numpy() for m in margins]
    for _ in range(SWEEPS if len(mass) else 0):
        residual = 0.0
        for group, goal in zip(groups, goals):
            reached = np.bincount(group, mass * weight)[group]
            some = reached > 0
            step = np.divide(goal, reached, out=np.zeros(len(goal)), where=some)
            missed = np.abs(np.divide(reached, goal, out=np.ones(len(goal)), where=goal > 0) - 1.0)
            residual = max(residual, float(missed.max()))
            weight = weight * step
        if residual < TOLERANCE:
            break
    out = table.append_column("__w", pa.array(weight))
    columns = [*margins, "tokens", "__w", *[f"__goal_{m}" for m in margins]]
    schema = ", ".join(f"{c} {'long' if c == 'tokens' else 'string' if c in margins else 'double'}" for c in columns)
    return work.sparkSession.createDataFrame(out.select(columns), schema), residual


def _rake_many(work: DataFrame, margins: list[str]) -> tuple[DataFrame, float]:
    work = work.withColumns({f"__a_{m}": F.lit(1.0) for m in margins})
    residual = 0.0
    for _ in range(SWEEPS):
        work = work.withColumn("__miss", F.lit(0.0))
        for m in margins:
            mass = F.col("tokens").cast("double")
            for other in margins:
                mass = mass * F.col(f"__a_{other}")
            reached = work.groupBy(m).agg(F.sum(mass).alias("__v"), F.first(f"__goal_{m}").alias("__g"))
            step = reached.select(m, F.when(F.col("__v") > 0, F.col("__g") / F.col("__v")).otherwise(0.0).alias("__s"),
                                  F.when(F.col("__g") > 0, F.abs(F.col("__v") / F.col("__g") - 1.0)).otherwise(0.0).alias("__m"))
            work = lookup(work, step.checkpoint(), m, F.struct(*margins))
            work = work.withColumns({f"__a_{m}": F.col(f"__a_{m}") * F.col("__s"), "__miss": F.greatest("__miss", "__m")}).drop("__s", "__m")
        work = work.checkpoint()
        residual = work.agg(F.max("__miss")).first()[0]
        if residual < TOLERANCE:
            break
    weight = F.lit(1.0)
    for m in margins:
        weight = weight * F.col(f"__a_{m}")
    return work.select(*margins, "tokens", weight.alias("__w"), *[f"__goal_{m}" for m in margins]), residual


def scale_for(weighted: DataFrame, budget: float | None) -> float:
    """The ``c`` for which ``min(1, c * weight)`` keeps ``budget`` of the tokens of ``weighted`` (columns ``tokens``
    and ``__w``); without a budget the largest that keeps every probability within 1.  A budget beyond all
    tokens of positive weight keeps those whole.

    The kept tokens are concave in ``c``, so Newton's steps from below only rise; each saturates further
    cells or is the last."""
    positive = weighted.where("__w > 0")
    top, low, mass, held = positive.agg(F.max("__w"), F.min("__w"), F.sum(F.col("__w") * F.col("tokens")), F.sum("tokens")).first()
    if not top:
        return 0.0
    if budget is None:
        return 1.0 / top
    if budget >= held:
        return 1.0 / low
    scale, full = budget / mass, 0
    while True:
        above = F.col("__w") * F.lit(scale) >= 1.0
        cells, whole, rest = positive.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("tokens"))), F.lit(0)),
                                          F.sum(F.when(~above, F.col("__w") * F.col("tokens")))).first()
        if cells == full or not rest:
            return scale
        scale, full = max(scale, (budget - whole) / rest), cells


def _missed(weighted: DataFrame, keys: list[str], expected: float) -> list[float]:
    """Per margin, the largest relative miss of a target share by the expected tokens (``__kept``)."""
    out = []
    for m in keys:
        reached = weighted.groupBy(m).agg((F.sum("__kept") / F.lit(expected)).alias("v"), F.first(f"__goal_{m}").alias("g"))
        out.append(reached.where("g > 0").agg(F.max(F.abs(F.col("v") / F.col("g") - 1.0))).first()[0] or 0.0)
    return out


def sample(df: DataFrame, margins: dict[str, Column], tokens: Column, targets: dict[str, float | dict[str, float]],
           key: list[str], budget: float | None = None, seed: int = 0, share: float | None = None,
           report: dict | None = None) -> DataFrame:
    """``df`` with ``weight`` (relative to the largest), ``probability`` and ``kept`` for every row.

    ``margins`` names the margins and how to compute them.  The
    expected number of kept tokens is ``budget``, or ``share`` of all tokens of ``df``; cells whose
    probability would pass 1 for that are kept whole, and the margins then miss their targets.  Without
    either it is as many as no probability passes 1 for, which the most wanted cell decides, however small
    it is.  ``kept`` compares the probability to a hash of the columns ``key`` and ``seed``: rows equal in
    them are kept or left together, whatever the partitioning.  A missing margin value is a value of its
    own.  A row without tokens, or in a cell whose target is 0, has weight and probability 0 and is not
    kept.  Columns named like the three are replaced.

    What came out is logged, and put into ``report`` if given: ``share`` (expected kept tokens of all),
    ``cells`` and ``whole_cells`` (all with tokens, and those with probability 1), ``residual`` (by margin,
    the largest relative miss of a target share), ``raking_residual`` (that of the weights) and ``raked`` (whether that is
    within ``TOLERANCE``)."""
    if budget is not None and share is not None:
        raise ValueError("give budget or share, not both")
    names = list(margins)
    inner = [f"__c{k}" for k in range(len(df.columns))]  # columns of any name, out of the way
    keyed = df.select("*", *[c.alias(f"__v{k}") for k, c in enumerate(margins.values())],
                      F.coalesce(tokens, F.lit(0)).cast("long").alias("__tokens"), chance_of(key, seed).alias("__chance"))
    keyed = keyed.toDF(*inner, *[f"__v{k}" for k in range(len(names))], "__tokens", "__chance")
    keys = [f"__m{k}" for k in range(len(names))]
    keyed = keyed.select(*inner, *[_key(f"__v{k}").alias(f"__m{k}") for k in range(len(names))], "__tokens", "__chance")
    cells = keyed.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")).checkpoint()
    weighted, raking_residual = rake(cells, keys, dict(zip(keys, (targets[n] for n in names))))
    weighted = weighted.checkpoint()
    total, top = weighted.agg(F.sum("tokens"), F.max("__w")).first()
    scale = scale_for(weighted, share * (total or 0) if share is not None else budget)
    told = {"share": 0.0, "cells": 0, "whole_cells": 0, "residual": dict.fromkeys(names, 0.0), "raking_residual": raking_residual,
            "raked": raking_residual < TOLERANCE}
    chosen = F.least(F.col("__w") * F.lit(scale), F.lit(1.0))
    weighted = weighted.withColumn("__kept", chosen * F.col("tokens"))
    expected, count, full = weighted.agg(F.sum("__kept"), F.count("*"), F.count(F.when(chosen >= 1.0, 1))).first()
    if expected:
        told |= {"share": expected / total, "cells": count, "whole_cells": full,
                 "residual": dict(zip(names, _missed(weighted, keys, expected)))}
    _LOG.info("mixture: %s", told)
    if report is not None:
        report.update(told)
    out = lookup(keyed.withColumn("__cell", F.array(*keys)), weighted.select(F.array(*keys).alias("__cell"), "__w"), "__cell", F.col("__chance"))
    out = out.withColumn("__w", F.when(F.col("__tokens") > 0, F.coalesce("__w", F.lit(0.0))).otherwise(0.0))
    added = {"weight": F.col("__w") / F.lit(float(top or 1.0)),
             "probability": F.least(F.col("__w") * F.lit(scale), F.lit(1.0)),
             "kept": F.col("__chance") < F.col("__w") * F.lit(scale)}
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, df.columns) if c not in added], *[c.alias(n) for n, c in added.items()])


def chance_of(key: list[str], seed: int) -> Column:
    """A hash of the columns ``key`` and ``seed``, even between 0 and 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]), F.lit(1 << 53)) / F.lit(float(1 << 53))
