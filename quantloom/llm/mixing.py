"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they
are) and normalised. The exponent is the largest whose weights reach the target entropy (a part of the
logarithm of the number of sources), but not so small that a source would be repeated more often than
the limit. It is found by narrowing: one aggregate over the table of sources gives the entropy and the
largest repetition at GRID exponents at once.

The weights times the token budget say how often each source is used: a number of whole epochs, and a
last one cut where its tokens reach the rest. Each epoch of a source is a block permutation of its own:
documents lie in BLOCKS hashed blocks, the blocks come in an order hashed with the epoch, the documents of
a block in another. A row's `order` holds both. For the cut, tokens are summed by block, whole blocks are
taken until one crosses the budget, and only in that block are documents summed one by one; so no source is
sorted as a whole, and the cut is one number per source. The text is read once for the tokens.

Tokens of a document are its pieces between blanks, tabs and line ends.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and go with
their source's epochs; a source without tokens is kept as it is, once; equal rows have equal places in the
permutation and so are taken or left together; an empty table stays empty; extra columns stay, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

ENTROPY = 0.9
REPEATS = 4.0
BLOCKS = 4096
GRID = 64
ROUNDS = 5
BREAKS = " \t\n\r"


def tokens(text: str = "text"):
    """Pieces between runs of white space of BREAKS, counted without a regular expression: the places where
    a piece begins."""
    one = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\r", "   ")
    return F.size(F.filter(F.split(one, " "), lambda x: x != "")).cast("long")


def exponent(sources: DataFrame, budget: float | None, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for a table of (source, n_tokens > 0)."""
    head = sources.agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n"), F.min("n_tokens").alias("least")).first()
    if not head["n"] or head["n"] < 2:
        return 1.0
    budget, goal = budget or head["total"], entropy * math.log(head["n"])
    share = F.col("n_tokens") / F.lit(float(head["total"]))

    def measured(grid: list[float]) -> list[tuple[bool, bool]]:
        """For each exponent whether its entropy is enough and whether it repeats little enough."""
        row = sources.agg(*[e for k, x in enumerate(grid) for e in (F.sum(F.pow(share, F.lit(x))).alias(f"s{k}"), F.sum(F.pow(share, F.lit(x)) * F.log(share)).alias(f"t{k}"))]).first()
        spread = [math.log(row[f"s{k}"]) - x * row[f"t{k}"] / row[f"s{k}"] for k, x in enumerate(grid)]
        # the source with the fewest tokens is repeated most often
        often = [(head["least"] / head["total"]) ** x / row[f"s{k}"] * budget / head["least"] for k, x in enumerate(grid)]
        return [(s >= goal - 1e-12, r <= repeats + 1e-12) for s, r in zip(spread, often, strict=True)]

    found = []
    for part in (0, 1):  # both measures fall as the exponent grows
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            good = [m[part] for m in measured(grid)]
            if part == 0:
                k = max((k for k in range(GRID + 1) if good[k]), default=0)
                low, high = grid[k], grid[min(GRID, k + 1)]
            else:
                k = min((k for k in range(GRID + 1) if good[k]), default=GRID)
                low, high = grid[max(0, k - 1)], grid[k]
            if low == high:
                break
        found.append(low if part == 0 else high)
    return round(max(found), 9)


def _place(docs: DataFrame, seed: int):
    """Where a document lies, 0 to 2**63 - 1; its block is in the highest bits."""
    names = [c for c in ("doc_id", "text") if c in docs.columns]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 1)


def _block_order(epoch, place):
    """The block's place among the blocks of an epoch, 31 bits."""
    return F.shiftrightunsigned(F.xxhash64(epoch.cast("long"), F.shiftright(place, 63 - int(math.log2(BLOCKS)))), 33)


def _order(epoch, place):
    """A document's place in an epoch: its block's, then its own in the block."""
    return F.shiftleft(_block_order(epoch, place), 32) + F.shiftrightunsigned(F.xxhash64(place, epoch.cast("long")), 32)


def measured(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens and place of each document, from a table."""
    return written(docs.select("doc_id", "source", tokens().alias("n_tokens"), _place(docs, seed).alias("place")), "mix-documents")


def plan(light: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """For each source of measured documents its weight, whole epochs, and the rest with the last order that
    the cut epoch takes (null: none)."""
    cell = F.shiftright("place", 63 - int(math.log2(BLOCKS)))
    blocks = written(light.groupBy("source", cell.alias("block")).agg(F.sum("n_tokens").alias("n_tokens"), F.min("place").alias("place")), "mix-blocks", light=True)
    sources = blocks.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    used = sources.filter("n_tokens > 0")
    x = exponent(used, budget, entropy, repeats)
    total = used.agg(F.sum("n_tokens").alias("total"), F.sum(F.pow(F.col("n_tokens"), F.lit(x))).alias("norm")).first()
    amount = float(budget or total["total"] or 0)
    weight = F.pow(F.col("n_tokens"), F.lit(x)) / F.lit(total["norm"] or 1.0)
    times = F.when(F.col("n_tokens") > 0, F.round(weight * amount / F.col("n_tokens"), 9)).otherwise(F.lit(1.0))
    use = sources.select(F.col("source").alias("s"), F.col("n_tokens").alias("all"), weight.alias("weight"), F.floor(times).cast("int").alias("epochs"), F.round((times - F.floor(times)) * F.col("n_tokens")).cast("long").alias("rest"))
    use = written(use, "mix-sources", light=True)

    same = F.col("source").eqNullSafe(F.col("s"))
    turns = blocks.join(use.filter("rest > 0"), same).groupBy("s", "rest", _block_order(F.col("epochs"), F.col("place")).alias("turn")).agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("turn"))
    edge = turns.withColumn("upto", upto).filter("upto - n < rest and upto >= rest").select(F.col("s").alias("e"), F.col("turn").alias("edge"), (F.col("rest") - F.col("upto") + F.col("n")).alias("need"))
    edge = use.join(edge, F.col("s").eqNullSafe(F.col("e"))).select("s", "epochs", "edge", "need")
    near = light.join(edge, same & (_block_order(F.col("epochs"), F.col("place")) == F.col("edge"))).withColumn("order", _order(F.col("epochs"), F.col("place")))
    before = F.sum("n_tokens").over(Window.partitionBy("s").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    cut = near.withColumn("before", F.coalesce(before, F.lit(0))).filter("before < need").groupBy(F.col("s").alias("t")).agg(F.max("order").alias("cut"))
    return written(use.join(cut, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "mix-plan", light=True)


def _uses(rows: DataFrame, use: DataFrame, place, names: list[str]) -> DataFrame:
    """A row for each use of a row, with its epoch and order under the two names."""
    source, s, epochs, cut, epoch, order = "source", *names
    use = use.select(F.col("s").alias(s), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    out = rows.join(use, F.col(source).eqNullSafe(F.col(s)))
    more = F.coalesce(_order(F.col(epochs), place) <= F.col(cut), F.lit(False)).cast("int")
    each = F.when(F.col(epochs) + more > 0, F.sequence(F.lit(0), F.col(epochs) + more - 1)).otherwise(F.array().cast("array<int>"))
    out = out.select(*rows.columns, F.explode(each).alias(epoch))
    return out.withColumn(order, _order(F.col(epoch), place))


def permuted(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 0) -> DataFrame:
    """The mixture without its texts: doc_id, source, epoch, position (gapless from 0 in each epoch of a
    source, in the permutation's order) and n_tokens of each use."""
    light = measured(docs, seed)
    uses = _uses(light, plan(light, budget, entropy, repeats), F.col("place"), ["s", "epochs", "cut", "epoch", "order"])
    uses = written(uses.withColumn("turn", F.shiftright("order", 32)), "mix-uses")
    keys = ["source", "epoch", "turn"]
    counts = uses.groupBy(*keys).agg(F.count("*").alias("n"))
    first = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("turn")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "doc_id")) - 1
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("turn") == F.col("_turn"))
    out = uses.withColumn("rank", rank).join(first, same)
    return out.select("doc_id", "source", "epoch", (F.col("first") + F.col("rank")).alias("position"), "n_tokens")


def mixed(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 0) -> DataFrame:
    """The documents of the mixture, a row for each use: all columns, the epoch and the order in the source's
    epoch, under the names that used_names gives."""
    use = plan(measured(docs, seed), budget, entropy, repeats)
    names = [unused(x, docs.columns) for x in ("_source_key", "_epochs", "_cut")]
    return _uses(docs, use, _place(docs, seed), [*names, *used_names(docs)])


def used_names(docs: DataFrame) -> tuple[str, str]:
    return unused("_epoch", docs.columns), unused("_order", docs.columns)
