"""Mixing sources to target weights by Pfair scheduling.

A source of weight w releases its i-th block at floor((i - 1) / w) and must have it placed by ceil(i / w); each slot takes
the released block of the earliest deadline. With whole-number weights the schedule repeats after as many slots as the
weights add up to, so one period is scheduled by a fold over its slots and every block finds its slot by arithmetic.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from markgrid.llm.common import rank_within, table
from markgrid.session import cut

#: documents a block
BLOCK_DOCS = 16
#: slots that one period has about
PERIOD = 1000
#: rows of the input that one part of the ranking holds
PART_ROWS = 5_000


def tempered(docs: DataFrame, source: str = "source", period: int = PERIOD) -> DataFrame:
    """Target weights ``source, weight``: whole numbers in proportion to the square root of a source's documents.

    They add up to about ``period``; each is at least 1.
    """
    n = docs.groupBy(F.col(source).alias("source")).agg(F.floor(F.sqrt(F.count("*").cast("double"))).cast("long").alias("_root"))
    share = F.floor(F.col("_root") * period / F.sum("_root").over(Window.partitionBy(F.lit(0))))  # one row a source
    return n.select("source", F.greatest(F.lit(1), share).cast("long").alias("weight"))


def period_schedule(weights: DataFrame) -> DataFrame:
    """``source, weight, period, turn, slot``: where each block of one period goes, earliest deadline first.

    ``weights`` is the table of target weights, one row a source. One task folds over the slots of a period, with work in
    proportion to its slots times its sources. Ties of deadline go to the smaller source; a null source comes first. At every
    slot a source has had between w t - 1 and w t + 1 blocks, both excluded.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "weight"))).alias("all")).where(F.size("all") > 0)
    one = one.withColumn("period", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["weight"]))

    def step(state: Column, slot: Column) -> Column:
        # of a source that has had k blocks: the next is released at floor(k P / w) and due at ceil((k + 1) P / w)
        due = F.transform(
            F.arrays_zip(F.col("all").alias("s"), state["had"].alias("had")),
            lambda x, i: F.struct(
                F.when(F.floor(x["had"] * F.col("period") / x["s"]["weight"]) <= slot, F.ceil((x["had"] + 1) * F.col("period") / x["s"]["weight"])).otherwise(F.lit(2**62)).cast("long").alias("due"),
                i.alias("i"),
            ),
        )
        # an array of one element binds the pick, so that it is made once a slot
        after = lambda best: F.struct(F.transform(state["had"], lambda h, i: h + (i == best).cast("long")).alias("had"), F.concat(state["order"], F.array(best)).alias("order"))
        return F.transform(F.array(F.array_min(due)["i"]), after)[0]

    start = F.struct(F.transform("all", lambda _: F.lit(0).cast("long")).alias("had"), F.array().cast("array<int>").alias("order"))
    folded = one.select("all", "period", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step, lambda s: s["order"]).alias("order"))
    slots = folded.select("all", "period", F.posexplode("order").alias("slot", "i")).select(F.element_at("all", F.col("i") + 1).alias("s"), "period", F.col("slot").cast("long").alias("slot"))
    turn = Window.partitionBy("s").orderBy("slot")
    return slots.select("s.source", "s.weight", "period", (F.row_number().over(turn) - 1).cast("long").alias("turn"), "slot")


def mix(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``block``, ``slot`` and ``position`` of the mix, each row once.

    A source's rows, in a fixed shuffle by hash, are cut into blocks of ``block_docs``. While every source has blocks left,
    each is within one block of its weight at every slot; once one has run out its slots stay empty and the others keep
    their pattern. ``position`` counts rows in the order of slots without gaps, from 0. A null source is a source; sources
    without a target weight have weight 1; repeated rows and rows of a null key are placed like others; an empty table
    gives an empty one. Columns called block, slot or position are replaced.
    """
    docs = docs.drop("block", "slot", "position")
    columns = docs.columns
    rows = docs.count()
    own = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("_n"))
    weights = tempered(docs, source) if weights is None else weights.select("source", "weight")
    given = own.join(weights.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select("source", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long").alias("weight"))
    # written, so that their true sizes decide how they are joined
    given = cut(given)
    plan = cut(period_schedule(given))
    ranked = rank_within(docs, [source], [key], rows, PART_ROWS, "_rank")
    at = F.floor(F.col("_rank") / block_docs).cast("long")
    # the schedule has one row a slot of one period, whatever the number of documents
    placed = (
        ranked.withColumn("block", at)
        .join(given.withColumnRenamed("source", "_s").withColumnRenamed("weight", "_w"), F.col(source).eqNullSafe(F.col("_s")))
        .withColumn("_turn", F.col("block") % F.col("_w"))
        .join(plan.select(F.col("source").alias("_p"), "period", "turn", F.col("slot").alias("_slot")), F.col(source).eqNullSafe(F.col("_p")) & (F.col("_turn") == F.col("turn")))
        .withColumn("_round", F.floor(F.col("block") / F.col("_w")).cast("long"))
        .withColumn("slot", F.col("_round") * F.col("period") + F.col("_slot"))
    )
    # rows before a slot: those of earlier rounds, then those of earlier slots of its round
    sizes = placed.groupBy("_round", "slot").agg(F.count("*").alias("_n"))
    rounds = sizes.groupBy("_round").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("_round").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_round").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_round", "slot", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_in")).join(rounds.select("_round", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")), "_round")
    return (
        placed.join(starts.select(F.col("slot").alias("_at"), (F.col("_start") + F.col("_in")).alias("_first")), F.col("slot") == F.col("_at"))
        .select(*columns, "block", "slot", (F.col("_first") + F.col("_rank") % block_docs).cast("long").alias("position"))
    )


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
