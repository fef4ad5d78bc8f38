"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets in words follow the weights, but no source gives more than ``repeats`` times its size; what is over is
shared by the others. The mix is cut into equal blocks of words, and the blocks go to the sources by
the highest quotients ``target / (2 k + 1)``. The same rule then deals a source's blocks to its shards
(documents by hash), which makes one integer quota for each (source, shard). Inside such a cell
the documents stand in a seeded order, the cell is cut into blocks, and the quota is spread over them
evenly from a seeded offset, so a block is taken floor or ceil of quota / blocks times.

Everything is joins, windows and sums. A window holds one cell (about ``shard_docs`` documents however large the
source is), the cells of one source, or the sources. The highest quotients are found exactly without listing all of
them: for k parties with weight sum W, each party's seats lie between the values rounded at the rates
(seats - k) / W and (seats + k) / W, which leaves about 3 k candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, added, hashed
from weftgraph.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 16
SHARD_DOCS = 2_000
SEED = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of their group, dealt by highest quotients weight / (2 k + 1).

    Ties go to the first by ``order``. Parties of weight 0 get none.
    """
    within = Window.partitionBy(*group)
    rate = lambda side: F.greatest(F.lit(0.0), F.try_divide(F.col(seats) + side * F.col("_n"), F.col("_w")))
    known = (
        parties.withColumns({"_w": F.sum(F.col(weight).cast("double")).over(within),
                             "_n": F.sum((F.col(weight) > 0).cast("int")).over(within)})
        .withColumn("_low", F.when(F.col(weight) > 0, F.floor(F.col(weight) * rate(-1) + 0.5)).otherwise(F.lit(0)))
        .withColumn("_high", F.when(F.col(weight) > 0, F.floor(F.col(weight) * rate(1) + 0.5)).otherwise(F.lit(-1)))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(within))
    )
    claims = known.where("_high >= _low").select(
        *group, *[c for c in order if c not in group], "_open", weight, F.explode(F.sequence("_low", "_high")).alias("_k")
    )
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), *order)
    won = (
        claims.withColumn("_rank", F.row_number().over(best)).where("_rank <= _open")
        .groupBy(*dict.fromkeys(group + order)).agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        known.join(won, list(dict.fromkeys(group + order)), "left")
        .withColumn("quota", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("bigint"))
        .drop("_w", "_n", "_low", "_high", "_open", "_won")
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source_key, source_size) with ``target``, for all sources; weights repeat in the order of the keys.

    Filling up to the caps in the order of cap / weight, the common level is the largest of the levels reached.
    """
    ranked = sources.withColumn("_i", F.row_number().over(Window.orderBy("source_key")))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.withColumn("_weight", F.element_at(listed, ((F.col("_i") - 1) % len(weights) + 1).cast("int")))
    capped = weighted.withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
    everyone = Window.partitionBy()
    filled = Window.orderBy(F.col("_cap") / F.col("_weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        capped.withColumns({"_words": share * F.sum("source_size").over(everyone), "_all": F.sum("_weight").over(everyone)})
        .withColumns({"_given": F.coalesce(F.sum("_cap").over(filled), F.lit(0.0)),
                      "_past": F.coalesce(F.sum("_weight").over(filled), F.lit(0.0))})
        .withColumn("_level", F.max((F.col("_words") - F.col("_given")) / (F.col("_all") - F.col("_past"))).over(everyone))
    )
    return level.select(
        "source_key", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target")
    )


def quotas(cells: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, block: int = BLOCK) -> DataFrame:
    """(source_key, shard, cell_size) with source_size, target, and the cell's ``blocks`` and ``quota`` of blocks."""
    sources = cut(targets(cells.groupBy("source_key").agg(F.sum("cell_size").alias("source_size")), weights, share, repeats))
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint")
    by_source = cut(apportion(sources.withColumn("_seats", seats), [], "target", "_seats", ["source_key"]))
    by_cell = apportion(
        cells.join(by_source.withColumnRenamed("quota", "_of_source"), "source_key"),
        ["source_key"], "cell_size", "_of_source", ["shard"],
    )
    blocks = F.ceil(F.col("cell_size") / block).cast("bigint")
    return by_cell.select(
        "source_key", "shard", "cell_size", "source_size", "target", blocks.alias("blocks"),
        F.least("quota", repeats * blocks).alias("quota"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK,
        shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """The documents with size, source_size, target, taken (words the mix takes) and copies.

    ``copies`` is for whole documents: the running sum of taken / size, rounded down, over a cell's documents by size. So
    repeating whole documents meets the targets to within the largest document of each cell. Size is the number of words, 0 for a null text. A null source
    is a source of its own, last in order. Repeated rows and ids are documents of their own. Input columns with the new
    names are replaced. An empty table gives an empty one.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    keyed = docs.select(
        F.struct("*").alias("row"),
        # null last, all others by code point
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("source_key"),
        size_of(F.col("text")).alias("size"),
        hashed(F.lit(seed), F.col("doc_id")).alias("_order"),
    ).withColumn("shard", F.col("_order") % shards)
    cells = cut(keyed.groupBy("source_key", "shard").agg(F.sum("size").alias("cell_size")))
    cell = cut(quotas(cells, weights, share, repeats, block).withColumn(
        "_from", hashed(F.lit(seed), F.col("source_key"), F.col("shard")) % F.greatest("blocks", F.lit(1))
    ))
    running = Window.partitionBy("source_key", "shard").orderBy("_order", "row.doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    spread = lambda b: F.floor(F.try_divide(b * F.col("quota") + F.col("_from"), F.col("blocks")))

    def taken_before(x: Column) -> Column:
        b = F.floor(x / block)
        return block * spread(b) + (spread(b + 1) - spread(b)) * (x - b * block)

    start = F.col("_end") - F.col("size")
    full = F.col("cell_size") > 0
    by_size = Window.partitionBy("source_key", "shard").orderBy("size", "_order", "row.doc_id", F.xxhash64("row.text")).rowsBetween(
        Window.unboundedPreceding, 0)
    share_of = F.coalesce(F.try_divide(F.col("taken"), F.col("size")), F.lit(0.0))
    offset = hashed(F.lit(seed), F.lit("copies"), F.col("source_key"), F.col("shard")) / 2**32
    placed = keyed.withColumn("_end", F.sum("size").over(running)).join(cell, ["source_key", "shard"]).withColumn(
        "taken", F.when(full, taken_before(F.col("_end")) - taken_before(start)).otherwise(F.lit(0)).cast("bigint")
    ).withColumn("_due", F.sum(share_of).over(by_size) + offset + 1e-9).withColumn(
        "copies", (F.floor("_due") - F.floor(F.col("_due") - share_of)).cast("bigint"))
    return added(docs, ["size", "source_size", "target", "taken", "copies"], placed)


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mix as whole documents: each row as often as ``copies`` says."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    taken = mix(docs.select(*own), **settings)
    return taken.select(*own, F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select(*own)
