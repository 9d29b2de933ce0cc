"""Order-dependent resolution: a walk over sorted groups, and rounds of joins for groups too large for one task.

Every kernel takes candidate edges, keyed by ``keys`` (for example document and page), and a
strict total order. Spark deals the groups over tasks and sorts them; a task walks its groups in order
and remembers only what is taken, so a chain of dependent rows costs one pass, however long.
Groups of more than ``WALKED`` edges are resolved in rounds: each settles every row whose outcome cannot
depend on undecided rows, removes it, and writes the remainder to the shared folder, so plans stay short
and lost executors cost one round at most. The driver reads only emptiness. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from markgrid.session import cut, is_empty

#: edges of a group that one task walks at most
WALKED = 500_000


def _split(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Edges of groups that one task can walk, and those of larger groups, if there are any."""
    many = edges.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > WALKED).select(*keys)
    if is_empty(many):
        return edges, None
    many = cut(many)
    return edges.join(many, keys, "left_anti").select(*edges.columns), cut(edges.join(many, keys, "left_semi").select(*edges.columns))


def _walk(edges: DataFrame, keys: list[str], order: list[str], read: list[str], taker: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The edges that are taken when each group is walked in ``order``. ``taker()`` starts a group; what it returns is
    called with the columns ``read`` of one edge after another and says whether the edge is taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = take = None
        for b in batches:
            won = []
            for i, (g, *x) in enumerate(zip(zip(*[b.column(k).to_pylist() for k in keys]), *[b.column(c).to_pylist() for c in read], strict=True)):
                if g != group:
                    group, take = g, taker()
                if take(*x):
                    won.append(i)
            if won:
                yield b.take(pa.array(won, pa.int64()))

    return edges.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, edges.schema)


def mutual_best(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Greedy 1:1 pairing over edges ``keys, l, r, *order`` taken in ascending ``order``.

    Taking, over and over, every edge that is the best one of both its ends gives the same
    pairs as walking the globally sorted list, because ``(order, l, r)`` is strict.
    """
    rank = [c for c in order if c not in ("l", "r")] + ["l", "r"]
    cols = [*keys, *rank]
    few, todo = _split(cut(edges.select(*cols)), keys)

    def taker():
        left, right = set(), set()

        def take(le, ri) -> bool:
            if le in left or ri in right:
                return False
            left.add(le), right.add(ri)
            return True

        return take

    done = [cut(_walk(few, keys, rank, ["l", "r"], taker))]
    while todo is not None and not is_empty(todo):
        best = F.min(F.struct(*rank)).alias("_best")
        by_l = todo.groupBy(*keys, "l").agg(best).select(*keys, "_best.*")
        by_r = todo.groupBy(*keys, "r").agg(best).select(*keys, F.col("_best.l").alias("l"), F.col("_best.r").alias("r"))
        won = cut(by_l.join(by_r, [*keys, "l", "r"]).select(*cols))
        done.append(won)
        todo = cut(
            todo.join(won.select(*keys, "l"), [*keys, "l"], "left_anti")
            .join(won.select(*keys, "r"), [*keys, "r"], "left_anti")
            .select(*cols)
        )
    return reduce(DataFrame.unionByName, done)


def serial_choice(
    edges: DataFrame, keys: list[str], turn: list[str], prefer: list[str], consume: str | None = None
) -> DataFrame:
    """Left rows choose in ``turn`` order, each the free right row first in ``prefer`` order.

    A left row is settled once no undecided left row with an earlier turn is adjacent to its
    best right row. Where ``consume`` is false the choice is recorded but the right row stays
    free. Edges carry ``keys, l, r, *turn, *prefer``; ``turn`` plus ``l`` must be strict.
    """
    t = [*turn, "l"]
    p = prefer if "r" in prefer else [*prefer, "r"]
    extra = [consume] if consume and consume not in p else []
    cols = list(dict.fromkeys([*keys, *t, *p, *extra]))
    few, todo = _split(cut(edges.select(*cols)), keys)

    def taker():
        used = set()
        chose = object()

        def take(le, ri, takes=True) -> bool:
            nonlocal chose
            if le == chose or ri in used:
                return False
            chose = le
            if takes:
                used.add(ri)
            return True

        return take

    done = [cut(_walk(few, keys, [*t, *p, *extra], ["l", "r", *([consume] if consume else [])], taker))]
    while todo is not None and not is_empty(todo):
        best = (
            todo.groupBy(*keys, *t)
            .agg(F.min(F.struct(*p, *extra)).alias("_best"))
            .select(*keys, *t, *[F.col("_best." + c).alias(c) for c in [*p, *extra]])
        )
        first = todo.groupBy(*keys, "r").agg(F.min(F.struct(*t)).alias("first"))
        won = cut(best.join(first, [*keys, "r"]).where(F.struct(*t) == F.col("first")).select(*cols))
        done.append(won)
        taken = won.where(F.col(consume)) if consume else won
        todo = cut(
            todo.join(won.select(*keys, "l"), [*keys, "l"], "left_anti")
            .join(taken.select(*keys, "r"), [*keys, "r"], "left_anti")
            .select(*cols)
        )
    return reduce(DataFrame.unionByName, done)


def _grouped(edges: DataFrame, keys: list[str], order: list[str], read: list[str], out: T.StructType, solve: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """Rows ``out`` (``keys``, then what ``solve`` returns) of the groups of ``edges``, a group in memory at a time: ``solve``
    gets the columns ``read`` of its edges in ``order``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        group, held, rows = None, [], []

        def settled() -> Iterator[pa.RecordBatch]:
            if held:
                rows.extend([(*group, *x) for x in solve(held)])
            if len(rows) >= 10_000:
                yield made()

        def made() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

        for b in batches:
            for g, *x in zip(zip(*[b.column(k).to_pylist() for k in keys]), *[b.column(c).to_pylist() for c in read], strict=True):
                if g != group:
                    yield from settled()
                    group, held = g, []
                held.append(tuple(x))
        yield from settled()
        if rows:
            yield made()

    return edges.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _worse(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lo`` of what greedy suppression removes, a group at a time: a row is decided when all better ones are."""
    out = edges.select(*keys, "lo").schema

    def removed(pairs: list[tuple]) -> list:
        after, open_ = {}, {}
        for hi, lo in pairs:
            after.setdefault(hi, []).append(lo)
            open_[lo] = open_.get(lo, 0) + 1
        ready, gone = [x for x in after if x not in open_], {}
        while ready:
            x = ready.pop()
            for lo in after.get(x, ()):
                if x not in gone:
                    gone[lo] = True
                open_[lo] -= 1
                if not open_[lo]:
                    ready.append(lo)
        return list(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pairs, kinds = None, [], None

        def result() -> pa.RecordBatch:
            ids = removed(pairs)
            return pa.RecordBatch.from_arrays([*[pa.array([g] * len(ids), t) for g, t in zip(group, kinds[:-1])], pa.array(ids, kinds[-1])], names=[*keys, "lo"])

        for b in batches:
            kinds = [b.schema.field(k).type for k in [*keys, "lo"]]
            for g, hi, lo in zip(zip(*[b.column(k).to_pylist() for k in keys]), b.column("hi").to_pylist(), b.column("lo").to_pylist()):
                if g != group:
                    if pairs:
                        yield result()
                    group, pairs = g, []
                pairs.append((hi, lo))
        if pairs:
            yield result()

    return edges.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def suppressed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows removed by greedy suppression, given edges ``keys, hi, lo`` (hi ranks above lo).

    A row with no undecided better neighbour is kept; every row next to a kept better one is
    suppressed; edges of settled rows leave. Rows without edges never enter.
    """
    few, todo = _split(cut(edges.select(*keys, "hi", "lo").distinct()), keys)
    gone = [cut(_worse(few, keys))]
    while todo is not None and not is_empty(todo):
        kept = todo.select(*keys, "hi").distinct().join(
            todo.select(*keys, F.col("lo").alias("hi")).distinct(), [*keys, "hi"], "left_anti"
        )
        out = cut(todo.join(kept, [*keys, "hi"], "left_semi").select(*keys, "lo").distinct())
        gone.append(out)
        todo = cut(
            todo.join(kept, [*keys, "hi"], "left_anti")
            .join(out, [*keys, "lo"], "left_anti")
            .join(out.withColumnRenamed("lo", "hi"), [*keys, "hi"], "left_anti")
            .select(*keys, "hi", "lo")
        )
    return reduce(DataFrame.unionByName, gone).select(*keys, F.col("lo").alias("id"))


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Connected components of undirected edges ``keys, a, b``: rows ``keys, id, root``.

    Groups of up to ``WALKED`` edges are united in one task each. Larger ones alternate the large-star and small-star
    rewrites; each is one aggregate and one join, with no neighbour list ever gathered in one task. ``root`` is the
    smallest id of its component.
    """
    def united(pairs: list[tuple]) -> list[tuple]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        return [(x, root(x)) for x in list(up)]

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(
            *keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    def mark(df: DataFrame):
        # order-free fingerprint of the edge set
        return df.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()

    cur = cut(oriented(edges))
    ends = cur.select(*keys, F.col("a").alias("id"), F.col("b").alias("root"))
    done = ends.limit(0)
    if keys:  # without keys all edges are one group
        few, cur = _split(cur, keys)
        done = cut(_grouped(few, keys, [], ["a", "b"], ends.schema, united))
    if cur is None:
        return done
    seen = mark(cur)
    while True:
        both = cur.unionByName(cur.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(oriented(large))
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [*keys, "a"]).where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        cur = cut(oriented(small.unionByName(low.select(*keys, "a", F.col("m").alias("b")))))
        now = mark(cur)
        if now == seen:
            break
        seen = now
    leaf = cur.select(*keys, F.col("a").alias("id"), F.col("b").alias("root"))
    top = cur.select(*keys, F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return done.unionByName(leaf).unionByName(top)


def first_disjoint(sets: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Greedy choice of disjoint sets in ascending set order.

    ``sets`` holds one row ``keys, sid, m`` per member. A set wins when it is the first of every
    member it holds; sets touching a used member leave. No pair of sets is ever formed. Groups of up to ``WALKED``
    rows are walked in one task each, larger ones in rounds.
    """
    def chosen(rows: list[tuple]) -> list[tuple]:
        used, won = set(), []
        for sid, members in groupby(rows, key=lambda r: r[0]):
            members = {m for _, m in members}
            if len(members) == size and not members & used:
                used |= members
                won.append((sid,))
        return won

    few, todo = _split(cut(sets.select(*keys, "sid", "m")), keys)
    out = few.select(*keys, "sid").schema
    done = [cut(_grouped(few, keys, ["sid"], ["sid", "m"], out, chosen))]
    while todo is not None and not is_empty(todo):
        first = todo.groupBy(*keys, "m").agg(F.min("sid").alias("sid"))
        won = cut(first.groupBy(*keys, "sid").agg(F.count("*").alias("n")).where(F.col("n") == size).drop("n"))
        done.append(won)
        used = todo.join(won, [*keys, "sid"], "left_semi").select(*keys, "m")
        hit = todo.join(used, [*keys, "m"], "left_semi").select(*keys, "sid").distinct()
        todo = cut(todo.join(hit, [*keys, "sid"], "left_anti").select(*keys, "sid", "m"))
    return reduce(DataFrame.unionByName, done)
