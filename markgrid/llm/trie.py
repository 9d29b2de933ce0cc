"""Prefix trie of conversations from padded matrices of turn ids.

Equal conversations are one row with a count. Rows are sharded by ranges of their turn ids; a shard pads them to a matrix,
sorts it by ``numpy.lexsort``, and the OR of column changes accumulated from the left marks where a node of each depth
starts, so ``reduceat`` aggregates a depth at a time. Nodes on the path of a shard's first or last row may go on in the
neighbouring shard: they leave as parts and are recombined. Turns beyond ``WIDTH`` go to further levels, which only the
conversations that still share their whole beginning with another enter; what a single conversation has beyond is a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markgrid.llm.common import table
from markgrid.llm.turns import CRC_SQL, EMPTY, LEAST, hashes, listed_digests, numbered, tie_keys
from markgrid.session import cut, is_empty

#: turns that one level of matrices covers
WIDTH = 64
#: different beginnings that a shard holds about
SHARD_ROWS = 20_000
#: conversations that share a beginning, the turns they share at most, and one more than these
FAMILY, SHARED = 100, 6

NODES = pa.schema(
    [("cls", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64())]
    + [("chars", pa.int64()), ("ends", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("path", pa.list_(pa.binary()))]
)
NODES_SQL = "cls long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, ends string, key binary, parent_key binary, path array<binary>"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, _hi, _lo, chars``: turns numbered from 1 in their conversation, their texts as ids and lengths.

    A null role or text is empty. Rows of a null conv_id belong to no conversation and are left out. A null turn comes first,
    rows of one turn go by role, then text; repeated rows are turns of their own.
    """
    filled = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    slim = cut(filled.select("conv_id", "turn", *tie_keys(), F.length("text").cast("long").alias("chars")))
    return numbered(slim, slim.count()).select("conv_id", (F.col("_at") + 1).alias("pos"), "_hi", "_lo", "chars")


def with_shared_beginnings(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: their turns as in ``turn_rows``, and ``conv_id, n_turns`` of each.

    Conversation c starts with the first h turns of conversation c - c % ``family``, h being crc32(c) % ``shared``; its own
    turns after its first h follow.
    """
    turns = cut(turns)
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared, F.col("conv_id") - F.col("conv_id") % family
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("_own")).withColumns({"_h": h.cast("int"), "_base": base})
    # at most shared - 1 turns of each
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < shared)).groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("pos", "_hi", "_lo", "chars"))).alias("_first"))
    none = F.expr("cast(array() as array<struct<pos:bigint,_hi:bigint,_lo:bigint,chars:bigint>>)")
    convs = convs.join(first, "_base", "left").withColumn("_taken", F.coalesce(F.when(F.col("_h") > 0, F.slice("_first", F.lit(1), F.greatest("_h", F.lit(1)))), none))
    convs = cut(convs.withColumn("_n", F.size("_taken").cast("long")))
    begin = convs.select("conv_id", F.explode("_taken").alias("t")).select("conv_id", "t.*")
    rest = turns.join(convs.select("conv_id", "_h", "_n"), "conv_id").where("pos > _h").select("conv_id", (F.col("_n") + F.col("pos") - F.col("_h")).alias("pos"), "_hi", "_lo", "chars")
    sizes = convs.select("conv_id", (F.col("_n") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("n_turns"))
    return begin.unionByName(rest), sizes


def shard_nodes(t: pa.Table) -> pa.Table:
    """The nodes of one shard of different beginnings, depth by depth.

    Nodes that hold the shard's first or last row are parts: they carry a key, the keys on their path, and neither count
    themselves as leaves nor what they save; the others are final, but for parents that are parts.
    """
    get = lambda c: t.column(c).combine_chunks()
    ids, num = get("ids"), lambda c: get(c).to_numpy(zero_copy_only=False)
    size = np.diff(ids.offsets.to_numpy()) // 2
    rows, width = len(size), int(size.max())
    m, c = np.full((rows, 2 * width), LEAST), np.zeros((rows, width), np.int64)
    m[np.arange(2 * width) < 2 * size[:, None]] = ids.flatten().to_numpy()
    c[np.arange(width) < size[:, None]] = get("chars").flatten().to_numpy()
    order = np.lexsort([*(m[:, k] for k in reversed(range(2 * width))), num("cls")])
    m, c, size = m[order], c[order], size[order]
    cls, n, first, below, below_leaves, below_saved = (num(x)[order] for x in ("cls", "n", "first", "below", "below_leaves", "below_saved"))
    ends = get("ends").take(pa.array(order))

    def keys(row: int) -> list[bytes]:
        return [hashlib.blake2b(m[row, : 2 * d].tobytes(), digest_size=16).digest() for d in range(size[row] + 1)]

    edge = {0: keys(0), rows - 1: keys(rows - 1)}
    changed = [np.append(True, cls[1:] != cls[:-1])]
    for d in range(width):
        two = m[:, 2 * d : 2 * d + 2]
        changed.append(changed[-1] | np.append(True, (two[1:] != two[:-1]).any(axis=1)))
    leaves, saved, kids = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    found: list[dict] = []
    for d in range(width, -1, -1):
        here = np.flatnonzero(size >= d)
        starts = np.flatnonzero(changed[d][here])
        head = here[starts]
        total = lambda x: np.add.reduceat(x[here], starts)  # noqa: E731, B023
        part = np.zeros(len(head), bool)
        part[0], part[-1] = part[0] or size[0] >= d, part[-1] or size[-1] >= d
        last = size[head] == d
        convs, least = total(n), np.minimum.reduceat(first[here], starts)
        children = total(kids) + np.where(last, below[head], 0)
        leaves[head[last]] = below_leaves[head[last]]
        leaves[head[(children == 0) & ~part]] = 1
        text = c[head, d - 1] if d else np.zeros(len(head), np.int64)
        saved[head] += np.where(last, below_saved[head], 0) + np.where(part, 0, (convs - 1) * text)
        found.append({"depth": d, "head": head, "part": part, "least": least, "convs": convs, "children": children, "leaves": total(leaves), "saved": total(saved), "text": text, "last": last})
        kids = np.zeros(rows, np.int64)
        kids[head[~part]] = 1
    found.reverse()
    out = []
    for d, f in enumerate(found):
        head, part = f["head"], f["part"]
        key, parent_key, path, parent = [None] * len(head), [None] * len(head), [None] * len(head), np.zeros(len(head), np.int64)
        no_parent = np.ones(len(head), bool)
        if d:
            up = np.searchsorted(found[d - 1]["head"], head, "right") - 1
            parent, no_parent = found[d - 1]["least"][up], found[d - 1]["part"][up]
            for i in np.flatnonzero(no_parent):
                parent_key[i] = edge[0 if up[i] == 0 and size[0] >= d - 1 else rows - 1][d - 1]
        for i in np.flatnonzero(part):
            own = edge[0 if i == 0 and size[0] >= d else rows - 1]
            key[i], path[i] = own[d], own[: d + 1]
        end = ends.take(pa.array(np.where(f["last"], head, 0), mask=~f["last"]))
        columns = [cls[head], np.full(len(head), d), f["least"], pa.array(parent, mask=no_parent), f["convs"], f["children"], f["leaves"], f["saved"], f["text"], end, key, parent_key, path]
        out.append(pa.table([x if isinstance(x, pa.Array) else pa.array(x, k.type) for x, k in zip(columns, NODES)], schema=NODES))
    return pa.concat_tables(out)


def _level_nodes(groups: DataFrame) -> DataFrame:
    """``cls, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved, ends`` of one level, depths from its root."""
    shards = max(1, -(-groups.count() // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held)).combine_chunks().to_batches()

    columns = ["cls", "ids", "chars", "n", "first", "ends", "below", "below_leaves", "below_saved"]
    nodes = cut(groups.select(*columns).repartitionByRange(shards, "cls", "ids").mapInArrow(run, NODES_SQL))
    at = ["cls", "depth", "key"]
    total = lambda x: F.sum(x).alias(x)
    parts = nodes.where("key is not null").groupBy(*at).agg(
        F.min("conv_id").alias("conv_id"), *map(total, ("n_convs", "n_children", "n_leaves", "saved")), F.max("chars").alias("chars"), F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"), F.max("path").alias("path")
    )
    children = parts.where("depth > 0").groupBy("cls", (F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key")).agg(F.count("*").alias("_more"))
    parts = cut(parts.join(children, at, "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more"))
    # at most twice WIDTH parts a shard, each on a path of at most WIDTH
    own = parts.select("cls", F.posexplode("path").alias("depth", "key"), (F.col("n_children") == 0).cast("long").alias("_leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("_own"))
    own = own.withColumn("depth", F.col("depth").cast("long")).groupBy(*at).agg(total("_leaf"), total("_own"))
    parts = parts.join(own, at).withColumns({"n_leaves": F.col("n_leaves") + F.col("_leaf"), "saved": F.col("saved") + F.col("_own")}).drop("_leaf", "_own")
    names = parts.select("cls", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    whole = nodes.where("key is null").drop("path").unionByName(parts.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("path"))
    open_ = whole.where("parent_key is not null").join(names, ["cls", "depth", "parent_key"]).withColumn("parent_conv_id", F.col("_up"))
    columns = ["cls", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    return whole.where("parent_key is null").select(*columns).unionByName(open_.select(*columns))


def _groups(rows: DataFrame) -> DataFrame:
    """Different beginnings of a class: how many conversations have each, the smallest, and the digest of those that end."""
    key = [F.xxhash64("cls", "ids").alias("_k"), F.xxhash64(F.lit(1), "cls", "ids").alias("_l")]
    groups = rows.groupBy("cls", "ids").agg(
        F.min("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("first"), F.sum((~F.col("more")).cast("long")).alias("ended"), F.max(F.when(~F.col("more"), F.col("conv_id"))).alias("_one")
    )
    groups = cut(groups.select("*", *key))
    many = groups.where("ended > 1").select("_k", "_l")
    members = rows.where("not more").select("conv_id", *key).join(many, ["_k", "_l"])
    digests = listed_digests(members, ["_k", "_l"], "conv_id", "_many")
    return groups.join(digests, ["_k", "_l"], "left").withColumn("ends", F.when(F.col("ended") == 1, F.sha2(F.col("_one").cast("string").cast("binary"), 256)).otherwise(F.col("_many")))


def prefix_trie(turns: DataFrame, sizes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every node of the trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` holds ``conv_id, pos, _hi, _lo, chars``, pos from 1 without gaps; ``sizes`` holds ``conv_id, n_turns``, so that
    conversations without turns are members of the root. Turns are the same if both hashes are. A node is named by its
    smallest member and its depth. Without conversations there are no nodes. Members, conversations and hot beginnings may
    hold any share of the rows: equal ones are counted before they meet, and no row holds more than ``width`` turns.
    """
    block = F.floor((F.col("pos") - 1) / width).cast("long")
    gathered = turns.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "_hi", "_lo", "chars"))).alias("t"))
    blocks = cut(gathered.select("conv_id", "block", F.flatten(F.transform("t", lambda x: F.array(x["_hi"], x["_lo"]))).alias("ids"), F.transform("t", lambda x: x["chars"]).alias("chars")))
    sizes = cut(sizes)
    none = F.expr("cast(array() as array<bigint>)")
    rows = sizes.join(blocks.where("block = 0"), "conv_id", "left").select(
        F.lit(0).cast("long").alias("cls"), "conv_id", F.coalesce("ids", none).alias("ids"), F.coalesce("chars", none).alias("chars"), (F.col("n_turns") > width).alias("more")
    )
    levels, chains = [], None
    while True:
        rows = cut(rows)
        groups = cut(_groups(rows))
        levels.append(groups)
        alone = groups.where("n = 1 and ended = 0").select(F.col("first").alias("conv_id"), F.lit(len(levels)).alias("_from"))
        chains = alone if chains is None else chains.unionByName(alone)
        shared = groups.where("n > 1 and ended < n").select("_k", "_l", F.col("first").alias("_cls"))
        if is_empty(shared):
            break
        on = rows.where("more").select("conv_id", F.xxhash64("cls", "ids").alias("_k"), F.xxhash64(F.lit(1), "cls", "ids").alias("_l")).join(shared, ["_k", "_l"]).select("conv_id", F.col("_cls").alias("cls"))
        rows = on.join(blocks.where(F.col("block") == len(levels)), "conv_id").join(sizes, "conv_id").select("cls", "conv_id", "ids", "chars", (F.col("n_turns") > width * (len(levels) + 1)).alias("more"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    zero, out, roots = F.lit(0).cast("long"), [], None
    for level in reversed(range(len(levels))):
        groups = levels[level]
        if roots is None:
            groups = groups.withColumns({"_c": zero, "_v": zero, "_s": zero})
        else:
            groups = groups.join(roots.select(F.col("cls").alias("first"), F.col("n_children").alias("_c"), F.col("n_leaves").alias("_v"), F.col("saved").alias("_s")), "first", "left")
            groups = groups.withColumns({x: F.when((F.col("n") > 1) & (F.col("ended") < F.col("n")), F.col(x)) for x in ("_c", "_v", "_s")})
        chain = ((F.col("n") == 1) & (F.col("ended") == 0)).cast("long")
        groups = groups.withColumns({"below": F.coalesce("_c", zero) + chain, "below_leaves": F.coalesce("_v", zero) + chain, "below_saved": F.coalesce("_s", zero)})
        nodes = cut(_level_nodes(groups))
        roots = nodes.where("depth = 0")
        # a level's root is the last node of the level before, which may have members that end there
        kept = nodes.where("depth > 0").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("cls")).otherwise(F.col("parent_conv_id"))) if level else nodes
        out.append(kept.withColumn("depth", F.col("depth") + level * width).select(*columns))
    tail = blocks.join(chains, "conv_id").where("block >= _from").join(sizes, "conv_id").select("conv_id", "n_turns", "block", F.explode(F.sequence(F.lit(1), F.size("chars"))).alias("_i"))
    tail = tail.withColumn("depth", F.col("block") * width + F.col("_i"))
    done = F.col("depth") == F.col("n_turns")
    one = F.lit(1).cast("long")
    out.append(
        tail.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(done, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved"), F.when(done, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends"))
    )
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.withColumnRenamed("saved", "saved_tokens").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).drop("ends")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, rebuilt with shared beginnings.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, one row a node. Null roles and
    texts are empty, a null turn comes first, rows of a null conv_id belong to no conversation, repeated rows are turns of
    their own; an empty table gives no node.
    """
    return prefix_trie(*with_shared_beginnings(turn_rows(table(spark, sf_dir, "conversations"))))


OP13_SQL = f"""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p from conversations where conv_id is not null),
cv as (select c, count(*) as n, cast({CRC_SQL.format('c::varchar')} % {SHARED} as bigint) as h from t group by c),
rb as (select cv.c, b.p, b.r, b.x from cv join t b on b.c = cv.c - cv.c % {FAMILY} and b.p <= cv.h
 union all select t.c, least(cv.h, coalesce(bn.n, 0)) + t.p - cv.h, t.r, t.x from cv join t on t.c = cv.c left join cv bn on bn.c = cv.c - cv.c % {FAMILY} where t.p > cv.h),
k as (select c, p as d, md5(string_agg(md5(r) || md5(x), '') over (partition by c order by p)) as key, length(x) as len from rb union all select c, 0, '', 0 from cv),
m as (select c, max(d) as last from k group by c),
up as (select distinct d, key, above from (select d, key, lag(key) over (partition by c order by d) as above from k) z),
g as (select k.d, k.key, min(k.c) as conv_id, count(*) as n_convs, max(len) as len, coalesce(string_agg(k.c::varchar, ',' order by k.c) filter (where d = last), '') as ends from k join m on m.c = k.c group by k.d, k.key),
ch as (select d - 1 as d, above as key, count(*) as n from up where d > 0 group by 1, 2),
n as (select g.*, coalesce(ch.n, 0) as kids from g left join ch on ch.d = g.d and ch.key = g.key),
below as (select distinct a.d, a.key, b.d as d2, b.key as key2 from k a join k b on a.c = b.c and b.d >= a.d),
s as (select below.d, below.key, count(*) filter (where n.kids = 0) as leaves, sum((n.n_convs - 1) * n.len) as saved from below join n on n.d = d2 and n.key = key2 group by 1, 2)
select n.conv_id, n.d as depth, pn.conv_id as parent_conv_id, n.n_convs, n.kids as n_children, s.leaves as n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from n join up on up.d = n.d and up.key = n.key join s on s.d = n.d and s.key = n.key left join n pn on pn.d = n.d - 1 and pn.key = up.above"""
