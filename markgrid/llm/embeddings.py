"""Embedding near-duplicates by a forest of random projection trees.

Every tree splits the sphere by random directions; vectors near a split go to both sides. Trees are fitted on a bounded
sample and every vector is dropped into all of them; leaves that are still too large are split again by a tree grown on a
sample of their own rows, in rounds until none is left, so leaves stay small however large the table is. Vectors that share
a leaf are compared exactly. A pair that meets in several leaves counts in the first only, so links are counted without
listing pairs; leaves return spanning forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markgrid.llm.common import SLICE, bounded, flat_rows, share, table
from markgrid.operators.kernels import components
from markgrid.session import cut, is_empty

#: trees, vectors that they are fitted on at most (by a hash), and bytes of these vectors in double precision
TREES, FIT_ROWS, FIT_BYTES = 4, 65_536, 64 << 20
#: rows of a leaf that is too large that its own tree is grown on, and rows that pass one copy of this tree
OWN_ROWS, PASS_ROWS = 4096, 65_536
#: vectors a leaf should have, sample rows a split needs, tries for a split that parts its rows
LEAF_ROWS, SPLIT_ROWS, TRIES = 1024, 32, 4
#: half-width of the overlap at a split, in standard deviations of the projected distance of vectors just linked
SPILL = 0.4
#: a leaf of more rows is compared as pairs of blocks of about so many
BLOCK_ROWS = 4096
#: rows of a block that are multiplied at once
STEP = 512


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length without nulls as rows, not by way of Python lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def normal(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def direction(seed: int, size: int) -> np.ndarray:
    """The random direction of a seed; trees hold seeds, so that they are small at any length of vectors."""
    d = np.random.default_rng(seed).normal(size=size)
    return d / np.sqrt(d @ d)


def grow(x: np.ndarray, rows: int, margin: float, r: np.random.Generator) -> list[tuple[int, float, int, int]]:
    """A tree over ``x`` that stands for ``rows`` vectors: nodes ``seed (-1: leaf), value, left, right``."""
    nodes: list[tuple[int, float, int, int]] = []
    each = rows / max(1, len(x))

    def build(at: np.ndarray) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if len(at) < SPLIT_ROWS or len(at) * each <= LEAF_ROWS:
            return me
        for _ in range(TRIES):
            seed = int(r.integers(2**62))
            p = x[at] @ direction(seed, x.shape[1])
            v = float(np.quantile(p, r.uniform(0.4, 0.6)))
            left, right = at[p <= v + margin], at[p >= v - margin]
            # a heap that is narrower than the overlap stays whole
            if max(len(left), len(right)) <= 0.8 * len(at):
                nodes[me] = (seed, v, build(left), build(right))
                break
        return me

    build(np.arange(len(x)))
    return nodes


def planted(nodes: list[tuple[int, float, int, int]], size: int) -> list[tuple[np.ndarray | None, float, int, int]]:
    """A tree with its directions drawn."""
    return [(None if seed < 0 else direction(seed, size), v, left, right) for seed, v, left, right in nodes]


def leaves(x: np.ndarray, trees: list, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves they fall into over all trees, by row, then leaf; a leaf is ``tree * 2**24 + node``."""
    rows, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t, nodes in enumerate(trees):
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            d, v, left, right = nodes[node]
            if d is None:
                rows.append(at)
                names.append(np.full(len(at), (t << 24) + node))
                continue
            p = x[at] @ d
            for child, side in ((left, at[p <= v + margin]), (right, at[p >= v - margin])):
                if len(side):
                    todo.append((child, side))
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return row[order], name[order]


def first_shared(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether ``leaf`` is the first leaf that rows of padded leaf lists share, pair by pair."""
    both = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    return np.where(both.any(axis=2), a, np.iinfo(a.dtype).max).min(axis=1) == leaf


def compare(x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, mx: np.ndarray, my: np.ndarray, leaf: int, least: float, same: bool):
    """Links between rows of two blocks (``same``: one block with itself).

    Partial counts of links for either side, weighted by the other's copies, over pairs whose first shared leaf this is, and
    edges ``i, j`` (j counted on after x) that connect what the links connect.
    """
    nx, ny = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    kinds, kind = np.unique(np.concatenate([lx, ly]), axis=0, return_inverse=True)
    kind = kind.ravel()
    few_kinds = len(kinds) <= 64
    if few_kinds:
        i, j = np.divmod(np.arange(len(kinds) ** 2), len(kinds))
        here = first_shared(kinds[i], kinds[j], leaf).reshape(len(kinds), len(kinds))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(x), STEP):
        hit = x[s : s + STEP] @ y.T >= least
        if same:
            hit &= np.arange(len(y))[None, :] > np.arange(s, s + len(hit))[:, None]
        a, b = np.nonzero(hit)
        if not len(a):
            continue
        found.append((a + s, b))
        for c in range(0, len(a), 1 << 16):
            p, q = a[c : c + (1 << 16)] + s, b[c : c + (1 << 16)]
            counts = here[kind[p], kind[len(x) + q]] if few_kinds else first_shared(lx[p], ly[q], leaf)
            np.add.at(nx, p[counts], my[q[counts]])
            np.add.at(ny, q[counts], mx[p[counts]])
    if not found:
        return nx, ny, []
    a, b = (np.concatenate(c) for c in zip(*found))
    root = np.arange(len(x) + (0 if same else len(y)))
    b = b if same else b + len(x)
    while True:  # smallest label over links, halving paths, until nothing changes
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nx, ny, list(zip(moved.tolist(), root[moved].tolist()))


def own_trees(found: DataFrame, margin: float) -> DataFrame:
    """A tree for each leaf of ``leaf, n, vec``, grown on a sample of about ``OWN_ROWS`` of its ``n`` rows."""
    bounded(found.sparkSession)
    some = found.where(F.pmod(F.xxhash64("cid", "leaf"), F.col("n")) < OWN_ROWS).select("leaf", "n", "vec")

    def tree(t: pa.Table) -> pa.Table:
        leaf = t.column("leaf")[0].as_py()
        nodes = grow(normal(matrix(t.column("vec"))), t.column("n")[0].as_py(), margin, np.random.default_rng(leaf))
        return pa.table({"leaf": [leaf], "n": t.column("n")[:1], "nodes": pa.array([[dict(zip(("seed", "value", "left", "right"), x)) for x in nodes]], NODES)})

    return some.groupBy("leaf").applyInArrow(tree, "leaf long, n long, nodes array<struct<seed:long,value:double,left:int,right:int>>")


NODES = pa.list_(pa.struct([("seed", pa.int64()), ("value", pa.float64()), ("left", pa.int32()), ("right", pa.int32())]))


def split_to_the_end(met: DataFrame, size: int, margin: float) -> DataFrame:
    """``met`` (``leaf, cid, vec, copies, leaves``) without leaves of more than ``BLOCK_ROWS`` rows that can be split.

    A round splits all leaves that are too large at once: each has a tree grown on a bounded sample of its own rows, and its
    rows, in parts of about ``PASS_ROWS``, stream behind a copy of it. A child is never more than four fifths of the sample,
    so rounds end; a heap narrower than the overlap stays whole. ``leaves`` is gathered anew if anything was split.
    """
    spark = met.sparkSession
    columns, kind = ["leaf", "cid", "vec", "copies"], met.schema["vec"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def large(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS))

    def split(batches):
        forest, leaf = [], 0
        for batch in batches:
            first = np.flatnonzero(batch.column("cid").is_null().to_numpy(zero_copy_only=False))
            for s, e in zip([0, *first], [*first, batch.num_rows]):
                if s < e and batch.column("nodes")[int(s)].is_valid:
                    leaf = batch.column("leaf")[int(s)].as_py()
                    forest = [planted([(x["seed"], x["value"], x["left"], x["right"]) for x in batch.column("nodes")[int(s)].as_py()], size)]
                    s += 1
                for i in range(s, e, SLICE):
                    rows = batch.slice(i, min(SLICE, e - i))
                    row, node = leaves(normal(matrix(rows.column("vec"))), forest, margin)
                    # where two names collide, more rows are compared; a row that is in both counts once there
                    nodes, each = np.unique(node, return_inverse=True)
                    whole = len(forest[0]) == 1
                    new = np.array([leaf if whole else xxhash.xxh64_intdigest(f"{leaf}:{k}") >> 1 for k in nodes], dtype=np.int64)[each]
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(new), *(rows.column(c).take(row) for c in columns[1:]), pa.array(np.full(len(new), whole))], names=[*columns, "whole"])

    sizes = large(met.select("leaf"))
    if is_empty(sizes):
        return met
    todo, done = cut(met.select(*columns)), []
    while not is_empty(sizes):
        found = todo.join(sizes, "leaf")
        done.append(todo.join(sizes, "leaf", "left_anti"))
        parts = F.ceil(F.col("n") / PASS_ROWS).cast("int")
        trees = cut(own_trees(found, margin)).select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "nodes")
        rows = found.select("leaf", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), *columns[1:])
        both = trees.unionByName(rows, allowMissingColumns=True).select("leaf", "part", "cid", "vec", "copies", "nodes")
        dealt = both.repartition(n, "leaf", "part").sortWithinPartitions("leaf", "part", F.col("cid").asc_nulls_first())
        todo = cut(dealt.mapInArrow(split, f"leaf long, cid long, vec {kind}, copies long, whole boolean"))
        done.append(todo.where("whole").drop("whole"))
        todo = todo.where("not whole").drop("whole")
        sizes = large(todo.select("leaf"))
    met = todo
    for rows in done:
        met = met.unionByName(rows)
    met = cut(met)
    lists = met.groupBy("cid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    return met.join(lists, "cid")


def near_links(vectors: DataFrame, least: float, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Links of distinct vectors ``cid, vec, copies`` (a written table, one length, all finite, none zero).

    Returns ``cid, n`` (links, weighted by the copies of the other side) and edges ``a, b`` of the same components.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    size = (vectors.select(F.size("vec")).first() or [1])[0]
    most = max(SPLIT_ROWS, min(FIT_ROWS, FIT_BYTES // (8 * size)))
    part = max(1, 2 * rows // most)
    taken = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(part)) == 0).select("vec").limit(most).toArrow().column(0)
    sample = normal(matrix(taken)) if len(taken) else np.ones((1, size))
    margin = SPILL * float(np.sqrt(2 * max(0.0, 1 - least)) / np.sqrt(size))
    r = np.random.default_rng(1)
    get = share(spark, [grow(sample, rows, margin, r) for _ in range(trees)])

    def assign():
        forest = [planted(nodes, size) for nodes in get()]

        def f(batch: pa.RecordBatch):
            row, leaf = leaves(normal(matrix(batch.column(1))), forest, margin)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(leaf))
            row = pa.array(row)
            return [pa.array(leaf), *(batch.column(c).take(row) for c in range(3)), lists.take(row)]

        return f

    kind = vectors.schema["vec"].dataType.simpleString()
    met = flat_rows(vectors.select("cid", "vec", "copies"), assign, f"leaf long, cid long, vec {kind}, copies long, leaves array<long>")
    met = split_to_the_end(met, size, margin)
    sizes = met.groupBy("leaf").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    blocks = sizes.select(F.col("leaf").alias("_leaf"), F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks"))
    dealt = (
        met.join(blocks, F.col("leaf") == F.col("_leaf"), "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cid", "vec", "copies", "leaves")
    )

    def verify(batches):
        key, held = None, []

        def done():
            t = pa.Table.from_batches(held)
            t = t.take(np.unique(t.column("cid").to_numpy(), return_index=True)[1])
            leaf, low, high = key
            own = t.column("own").to_numpy()
            x = normal(matrix(t.column("vec")))
            cid, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy()
            lists = t.column("leaves").combine_chunks()
            many = pc.list_value_length(lists).to_numpy()
            wide = np.full((len(lists), many.max()), -1, dtype=np.int64)
            wide[np.arange(many.max()) < many[:, None]] = lists.flatten().to_numpy()
            a = own == low
            b = a if low == high else ~a
            na, nb, edges = compare(x[a], x[b], wide[a], wide[b], copies[a], copies[b], leaf, least, low == high)
            ids = np.concatenate([cid[a], cid[b]]) if low != high else cid[a]
            n = np.concatenate([na, nb]) if low != high else na + nb
            far = np.array([ids[j] for _, j in edges], dtype=np.int64)
            near = np.array([ids[i] for i, _ in edges], dtype=np.int64)
            some = np.flatnonzero(n)
            return np.concatenate([ids[some], near]), np.concatenate([n[some], np.zeros(len(near), np.int64)]), np.concatenate([np.full(len(some), -1), far])

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["cid", "n", "other"])

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy() for c in ("leaf", "low", "high")])
            at = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for s, e in zip(at, [*at[1:], batch.num_rows]):
                new = tuple(k[:, s].tolist())
                if key is not None and new != key:
                    yield out(done())
                    held = []
                key = new
                held.append(batch.slice(s, e - s))
        if key is not None:
            yield out(done())

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["leaf", "low", "high"]
    found = cut(dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(verify, "cid long, n long, other long"))
    return found.where("other < 0").groupBy("cid").agg(F.sum("n").alias("n")), found.where("other >= 0").select(F.col("cid").alias("a"), F.col("other").alias("b"))


def linked(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` for every row: links of cosine ``least`` or more, the smallest ``key`` reachable.

    Equal vectors are one in the forest and count for each other. Vectors that are null, empty, zero or hold a null or
    non-finite component, and vectors of different lengths, link with nothing. Rows of one id are vectors of their own; a
    null id has the smallest id of its component that is not null, else null, and is kept in the latter case only.
    """
    usable = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vec, lambda c: c != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    plain = F.transform(vec, lambda c: c + F.lit(0).cast("float"))
    rows = cut(vectors.select(key, F.when(usable, plain).alias("vec")))
    classes = cut(rows.where(F.col("vec").isNotNull()).groupBy("vec").agg(F.count("*").alias("copies"), F.min(key).alias("first")).withColumn("cid", F.monotonically_increasing_id()))
    found = [near_links(classes.where(F.size("vec") == size), least) for size, in classes.select(F.size("vec")).distinct().collect()]  # one, but for mixed tables
    named = classes.select("cid", "vec", "first", "copies")
    if found:
        counts, edges = found[0]
        for c, e in found[1:]:
            counts, edges = counts.unionByName(c), edges.unionByName(e)
        roots = components(edges, []).select(F.col("id").alias("cid"), "root")
        named = named.join(counts, "cid", "left").join(roots, "cid", "left")
    else:
        named = named.withColumns({"n": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    named = named.withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_vec = named.join(smallest, "root").select(F.col("vec").alias("_vec"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(by_vec, F.col("vec") == F.col("_vec"), "left")
    component = F.when(F.col("_vec").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
