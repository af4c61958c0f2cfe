"""Mix sources to target weights by raking (iterative proportional fitting). JVM functions only.

Tokens are added up per cell of source, language and topic before anything is shuffled by key, so a
source with a third of all rows is a few partial sums. Raking scales the cells' weights to each
margin's targets in turn. Weight over tokens, divided by its largest value, is the probability that
a document of the cell is drawn: the expected mix meets the targets with as many tokens as no
document being taken twice allows. That number is set by the scarcest cell, so ``keep`` names a share
of all tokens to draw instead: scarce cells are taken whole, the others share the rest in proportion
to their targets, and ``margins`` tells how far each value stays from its target. Draws depend on
the document only, so a retry repeats them.

Targets are powers of the corpus's own shares, or given per value of a margin. Margins that go
together may contradict each other; raking then ends after its rounds with a gap left.
"""

from __future__ import annotations

import logging
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.text import word_count
from turnledger.session import staged

MARGINS = ("source", "lang", "topic")
ROUNDS = 12
#: Target share of a value is its share of all tokens to this power, scaled to add up to one.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
TOGETHER = 100_000  # cells raked in one task
#: Share of the tokens that the registered query draws.
SHARE = 2 / 3
GAP = 0.01  # a margin's distance from its target that ``mix`` logs a warning for

log = logging.getLogger(__name__)


def topic(text: Column) -> Column:
    """A coarse topic by the shape of the text: its separators, numbers, line length and case."""
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(F.regexp_like(text, F.lit(r" \| ")), "table")
        .when(F.regexp_like(text, F.lit(r"[0-9]{4}")), "numeric")
        .when(F.length(text) < 400, "brief")
        .otherwise("prose")
    )


def _cell(prefix: str = "") -> dict[str, Column]:
    """The columns that place a row in a cell, and ``draw``: a number in [0, 1) from its id and text."""
    mark = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    draw = F.conv(F.substring(mark, 1, 12), 16, 10).cast("long") / F.lit(float(2**48))
    known = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("source", "lang")}
    return {f"{prefix}{name}": value for name, value in (known | {"topic": topic(F.col("text")), "draw": draw}).items()}


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, draw, n_tokens) of each row of ``docs``.

    Null sources and languages are a value of their own, the empty string.
    """
    cell = [value.alias(name) for name, value in _cell().items()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *cell, word_count(F.col("text")).alias("n_tokens"))


def _part(name: str, tokens: Column, power: float, targets: dict[str, dict[str, float]] | None) -> Column:
    """A value's part of its margin's targets: as given, 0 where it has no tokens or is not named, or a power of its tokens."""
    given = (targets or {}).get(name)
    if given is None:
        part = F.pow(tokens, F.lit(power))
    elif given:
        part = F.coalesce(F.create_map(*[F.lit(x) for x in chain(*((k, float(v)) for k, v in given.items()))])[F.col(name)], F.lit(0.0))
    else:
        part = F.lit(0.0)
    return F.when(tokens > 0, part).otherwise(0.0)


def _targets(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Add each margin's target share as ``_<name>``: 0 for values without tokens."""
    for name, power in powers.items():
        whole = F.sum("n_tokens").over(Window.partitionBy(name))
        first = F.row_number().over(Window.partitionBy(name).orderBy(*MARGINS))
        cells = cells.withColumn("_part", _part(name, whole, power, targets)).withColumn("_once", F.when(first == 1, F.col("_part")))
        total = cells.agg(F.sum("_once").alias("_all"))  # one row
        share = F.when(F.col("_all") > 0, F.col("_part") / F.col("_all")).otherwise(0.0)
        cells = cells.join(F.broadcast(total)).withColumn(f"_{name}", share).drop("_part", "_once", "_all")
    return cells


def _gap(cells: DataFrame, powers: dict[str, float], counted: Column) -> float:
    """The largest distance of a margin's value from its target."""
    away = [F.max(f"_gap_{name}") for name in powers]
    gaps = {f"_gap_{name}": F.abs(F.sum(counted).over(Window.partitionBy(name)) - F.col(f"_{name}")) for name in powers}
    return max((value or 0.0 for value in cells.withColumns(gaps).agg(*away).first()), default=0.0)


def _filling(rows: DataFrame, want: Column, most: Column, total: float) -> float:
    """The factor that makes the sum of least(factor * want, most) ``total``, or all of ``most`` if that is less.

    Each step takes the values that are full at the last factor as given; the factor only grows, and
    ends with the first step that fills no more of them.
    """
    factor = 0.0
    while True:
        full = F.lit(factor) * want >= most
        held, free = rows.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(want))).first()
        if not free:
            return factor
        grown = (total - (held or 0.0)) / free
        if grown <= factor * (1 + 1e-12):
            return factor
        factor = grown


def _able(cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    """Lower the targets that a margin's value has too few tokens for, and raise the others alike."""
    for name in powers:
        values = cells.filter("n_tokens > 0").groupBy(name).agg(F.sum("_most").alias("_most"), F.first(f"_{name}").alias("_want"))
        factor = _filling(values, F.col("_want"), F.col("_most"), 1.0)
        most = F.sum("_most").over(Window.partitionBy(name))
        cells = cells.withColumn(f"_{name}", F.least(F.lit(factor) * F.col(f"_{name}"), most))
    return cells


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, budget: float | None = None,
         targets: dict[str, dict[str, float]] | None = None, tolerance: float | None = None) -> DataFrame:
    """Add ``weight`` to cells with ``n_tokens``: shares that meet each margin's targets.

    A cell without tokens weighs nothing. Up to ``TOGETHER`` cells are raked in one task without
    any shuffle; more are shuffled by each margin in turn. Both give the same weights. With a
    ``budget`` of tokens a cell counts for no more than it has of it, so the other cells of its
    margins are raked up to make good for it; its own weight may be larger. ``targets`` names the parts
    of a margin's values, in place of its power; values that it does not name weigh nothing. With a
    ``tolerance`` raking ends when no value is further from its target; ``rounds`` is then its bound.
    """
    small = cells.count() <= TOGETHER
    near = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    fitted = near(cells).withColumn("weight", F.col("n_tokens").cast("double"))
    counted = F.col("weight")
    if budget:
        fitted = fitted.withColumn("weight", F.col("weight") / F.lit(float(budget)))
        counted = F.least("weight", "_most")
    fitted = near(staged(_targets(fitted, powers, targets), "cells"))
    if budget:
        fitted = near(staged(_able(fitted.withColumn("_most", F.col("n_tokens") / F.lit(float(budget))), powers), "cells"))
    for done in range(rounds):
        for name in powers:
            held = F.sum(counted).over(Window.partitionBy(name))
            scaled = F.col("weight") * F.col(f"_{name}") / held
            fitted = fitted.withColumn("weight", F.when(held > 0, scaled).otherwise(0.0))
        if done % 3 == 2 or done == rounds - 1:
            fitted = near(staged(fitted, "cells"))
            if tolerance is not None and _gap(fitted, powers, counted) <= tolerance:
                break
    return fitted.drop("_most", *[f"_{name}" for name in powers])


def calibrated(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep: float | None = None,
               targets: dict[str, dict[str, float]] | None = None, tolerance: float | None = None) -> DataFrame:
    """source, lang, topic, n_tokens, weight and probability of every cell of ``docs``.

    With ``keep``, a share of all tokens, the probabilities add up to that many tokens, by one factor
    for all cells that are not taken whole; without it the largest probability is 1. ``targets`` and
    ``tolerance`` are those of ``rake``.
    """
    cells = staged(measured(docs).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    ratio = F.when(F.col("n_tokens") > 0, F.col("weight") / F.col("n_tokens")).otherwise(0.0)
    budget = keep and keep * (cells.agg(F.sum("n_tokens")).first()[0] or 0)
    fitted = staged(rake(cells, powers, rounds, budget, targets, tolerance).withColumn("ratio", ratio), "fitted")
    if budget:
        factor = _filling(fitted.filter("n_tokens > 0"), F.col("weight"), F.col("n_tokens").cast("double"), budget)
        return fitted.withColumn("probability", F.least(F.lit(factor) * F.col("ratio"), F.lit(1.0))).drop("ratio")
    largest = fitted.agg(F.max("ratio").alias("most"))  # one row
    chance = F.when(F.col("most") > 0, F.col("ratio") / F.col("most")).otherwise(0.0)
    return fitted.join(F.broadcast(largest)).withColumn("probability", chance).drop("most", "ratio")


def margins(cells: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, value, n_tokens, target, share) of ``calibrated`` cells: what each value should and will have of the mix."""
    out = None
    for name, power in powers.items():
        mine = cells.groupBy(name).agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("_drawn"))
        mine = mine.select(
            F.lit(name).alias("margin"), F.col(name).alias("value"), "n_tokens", "_drawn", _part(name, F.col("n_tokens"), power, targets).alias("_part")
        )
        out = mine if out is None else out.union(mine)
    whole = out.groupBy("margin").agg(F.sum("_part").alias("_parts"), F.sum("_drawn").alias("_all"))  # one row per margin
    share = lambda part, of: F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(0.0)
    return out.join(F.broadcast(whole), "margin").select(
        "margin", "value", "n_tokens", share("_part", "_parts").alias("target"), share("_drawn", "_all").alias("share")
    )


def drawn(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep: float | None = None,
          targets: dict[str, dict[str, float]] | None = None, tolerance: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, its cell, n_tokens, draw, probability and ``kept``.

    A document is kept if its draw is below its cell's probability. Documents without tokens weigh
    nothing and are never kept. Repeated rows draw alike; an empty table gives an empty result;
    other columns are ignored.
    """
    cells = calibrated(docs, powers, rounds, keep, targets, tolerance).select(*MARGINS, "probability")
    return measured(docs).join(cells, list(MARGINS)).withColumn("kept", F.col("draw") < F.col("probability"))


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, keep: float | None = None,
        targets: dict[str, dict[str, float]] | None = None, tolerance: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn (see ``drawn``), with their columns unchanged.

    With ``keep``, the values that stay furthest from their targets are logged.
    """
    cells = calibrated(docs, powers, rounds, keep, targets, tolerance)
    if keep:
        far = margins(cells, powers, targets).withColumn("gap", F.col("share") - F.col("target")).filter(F.abs("gap") > GAP)
        for row in far.orderBy(F.abs("gap").desc()).limit(20).collect():
            log.warning("mixture: %s %r has %.4f of the tokens drawn, its target is %.4f", row["margin"], row["value"], row["share"], row["target"])
    cells = cells.select(*[F.col(m).alias(f"_mix_{m}") for m in MARGINS], F.col("probability").alias("_mix_probability"))
    hit = docs.withColumns(_cell("_mix_")).join(cells, [f"_mix_{m}" for m in MARGINS])
    return hit.filter("_mix_draw < _mix_probability").select(*[F.col(f"`{c}`") for c in docs.columns])
