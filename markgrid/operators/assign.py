"""Optimal one-to-one assignment, component by component.

Rows compete only inside a connected component of candidate pairs. Pairs without competitors are settled by counting;
components up to a bounded number of pairs are solved whole by shortest augmenting paths, each in one call, and larger ones
by the sorted greedy choice in rounds of joins. Opting out costs more than all pairs of the component together, so that most
rows are paired first and the least total is taken among these.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markgrid.operators.kernels import components, serial_choice
from markgrid.session import cut, is_empty

#: whole-number units of a cost of 1
UNITS = 4096
#: pairs of a component that one call solves at most
SOLVED_PAIRS = 50_000

c = F.col


def optimal_pairs(edges: DataFrame, keys: list[str], cost: str = "cost", units: int = UNITS, most: int = SOLVED_PAIRS) -> DataFrame:
    """Of the candidate pairs ``keys, l, r, cost`` as many disjoint ones as possible, of these the least total: ``keys, l, r, cost, method``.

    Costs count in steps of 1 / ``units`` and must not be negative; pairs of a null or non-finite cost, id or key are no candidates,
    of repeated pairs the cheapest counts. Ids of both sides are whole numbers. Which of several optimal assignments is returned
    is open. ``method`` is optimal, or greedy in components of more than ``most`` pairs: there left rows choose in order of their
    cheapest pair, each the cheapest free right row.
    """
    known = c(cost).isNotNull() & ~F.isnan(c(cost).cast("double")) & (F.abs(c(cost)) < float("inf"))
    for k in [*keys, "l", "r"]:
        known = known & c(k).isNotNull()
    pairs = cut(edges.where(known).groupBy(*keys, "l", "r").agg(F.min(cost).cast("double").alias("cost")))
    # a pair whose ends have no other partner is settled
    left = pairs.groupBy(*keys, "l").agg(F.count("*").alias("_nl"), F.min("r").alias("_one"))
    right = pairs.groupBy(*keys, "r").agg(F.count("*").alias("_nr"))
    alone = left.where("_nl = 1").select(*keys, "l", c("_one").alias("r")).join(right.where("_nr = 1"), [*keys, "r"]).select(*keys, "l", "r")
    settled = cut(pairs.join(alone, [*keys, "l", "r"], "left_semi"))
    rest = cut(pairs.join(alone, [*keys, "l", "r"], "left_anti"))
    columns = [*keys, "l", "r", "cost"]
    out = settled.select(*columns, F.lit("optimal").alias("method"))
    if is_empty(rest):
        return out
    # left rows get even numbers, right rows odd ones, so that one id names one end
    roots = components(rest.select(*keys, (c("l") * 2).alias("a"), (c("r") * 2 + 1).alias("b")), keys)
    rooted = rest.withColumn("_a", c("l") * 2).join(roots.select(*keys, c("id").alias("_a"), "root"), [*keys, "_a"]).drop("_a")
    group = [*keys, "root"]
    sized = cut(rooted.join(rooted.groupBy(*group).agg(F.count("*").alias("_n")), group))
    small = sized.where(c("_n") <= most).drop("_n")

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        whole = (df["cost"] * units).round().astype("int64").tolist()
        return df[shortest_paths(df["l"].tolist(), df["r"].tolist(), whole)]

    out = out.unionByName(small.groupBy(*group).applyInPandas(solve, small.schema).select(*columns, F.lit("optimal").alias("method")))
    large = sized.where(c("_n") > most)
    if is_empty(large):
        return out
    turn = large.groupBy(*keys, "l").agg(F.min("cost").alias("turn"))
    return out.unionByName(serial_choice(large.join(turn, [*keys, "l"]), keys, ["turn"], ["cost", "r"]).select(*columns, F.lit("greedy").alias("method")))


def shortest_paths(ls: list, rs: list, costs: list[int]) -> list[bool]:
    """Which pairs are taken: most pairs, then least total. Left rows enter one by one, each along the cheapest path of changes."""
    out = sum(costs) + 1  # opting out costs more than all pairs
    ways: dict = {}
    for k, (a, b, w) in enumerate(zip(ls, rs, costs)):
        ways.setdefault(a, []).append((("r", b), w, k))
    for a in ways:
        ways[a].append((("out", a), out, -1))
    price: dict = {}
    holder: dict = {}
    held: dict = {}
    for a in ways:
        # cheapest path from a to an object that nobody holds, by reduced costs
        base = {a: 0}
        heap, seen, came, n = [], {}, {}, 0
        todo, at = a, 0
        while True:
            for o, w, k in ways[todo]:
                d = at + w - price.get(o, 0) - base[todo]
                if o not in seen and d < came.get(o, (out * len(ways) + 1,))[0]:
                    came[o] = d, todo, k
                    n += 1
                    heapq.heappush(heap, (d, n, o))
            while True:
                d, _, o = heapq.heappop(heap)
                if o not in seen and came[o][0] == d:
                    break
            seen[o] = d
            if o not in holder:
                break
            todo, at = holder[o], d
            base[todo] = next(w - price.get(o, 0) for x, w, _ in ways[todo] if x == o)
        for x, dx in seen.items():
            price[x] = price.get(x, 0) + dx - d
        while True:
            _, who, k = came[o]
            before = held.get(who)
            holder[o], held[who] = who, (o, k)
            if who == a:
                break
            o = before[0]
    taken = {k for _, k in held.values()}
    return [k in taken for k in range(len(ls))]
