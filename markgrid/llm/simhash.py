"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at a few differing bits. The bits are grouped into partitions of correlated bits, and each
partition gets its own threshold: if the thresholds of m partitions add up to ``bits - m + 1``, two linked fingerprints
are within the threshold in at least one of them. A dynamic programme picks the thresholds by estimated candidate
counts; probes enumerate the ball around a partition's value; candidates are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markgrid.llm.common import add_columns, flat_rows, table
from markgrid.operators.kernels import components
from markgrid.session import cut

BITS = 64
#: fingerprints on which correlations and candidate counts are estimated; results do not depend on it
FIT_ROWS = 2048
#: pairs that a verification step compares at once
BLOCK = 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the lower-cased word shingles; 0 without words.

    A-Z only are lowered and only space and \\t..\\r separate, which is what ``bytes`` methods do. Fewer than ``words``
    words make one shingle. A bit is 1 if set in over half the shingle hashes (XXH64, seed 42), repeats counted.
    """
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else [b" ".join(x) for x in zip(*(w[i:] for i in range(words)))]
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65536):  # 8 bytes become 64: in parts
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", words: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with its fingerprint as a signed 64-bit number."""

    def make():
        return lambda texts: [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)]

    return add_columns(docs, text, make, [(name, T.LongType())], drop)


def correlated_parts(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of near-equal width; each grows from a free bit by the bit most correlated with its members."""
    n = bits.shape[1]
    x = bits - bits.mean(axis=0)
    x /= np.maximum(np.sqrt((x * x).sum(axis=0)), 1e-9)
    c = np.abs(x.T @ x)
    free, parts = set(range(n)), []
    for k in range(m):
        width = -(-len(free) // (m - k))
        part = [min(free)]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: c[b, part].sum())
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds t >= -1 (-1: the partition is not probed) of sum ``total`` and least cost; ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, start=-1):
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total][1]


def probing_plan(sample: np.ndarray, rows: int, radius: int) -> list[tuple[list[int], int]]:
    """Partitions and thresholds for ``rows`` fingerprints, estimated on a sample.

    For 2 to ``radius + 1`` partitions, the cost of a threshold is the pairs it brings to verification (the sample's share of
    pairs within it, scaled to ``rows``) plus its probes; the programme splits ``radius - m + 1`` over them.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, radius + 2):
        parts, costs = correlated_parts(bits, m), []
        for part in parts:
            b = bits[:, part]
            apart = b @ (1 - b).T + (1 - b) @ b.T
            np.fill_diagonal(apart, 99)
            row, ball = [0.0], 1.0
            for t in range(radius - m + 2):
                ball = ball * (len(part) - t + 1) / t + ball if t else 1.0
                share = ((apart <= t + 0.5).sum() + 1) / max(1, apart.size)
                row.append(share * rows * rows * 0.02 + rows * ball * 20)  # a probe is moved and sorted, a pair is one popcount
            costs.append(row)
        ts = allocate(costs, radius - m + 1)
        if (c := sum(r[t + 1] for r, t in zip(costs, ts))) < best[0]:
            best = (c, [(p, t) for p, t in zip(parts, ts) if t >= 0])
    return best[1]


def spanning(own: np.ndarray, other: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``own`` and ``other`` values, compared in blocks."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for i in range(0, len(own), BLOCK):
        x = own[i : i + BLOCK]
        for j in range(0, len(other), BLOCK):
            y = other[j : j + BLOCK]
            a, b = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            for u, v in zip(x[a].tolist(), y[b].tolist()):
                if u != v and (p := find(u)) != (q := find(v)):
                    parent[q] = p
                    out.append((u, v))
    return out


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints (column ``fp``) that connect exactly what all links at ``radius`` connect.

    Each task verifies the candidates of whole partition values and returns a spanning forest of the links it found, so
    neither pairs nor stars of a heap leave it. The fit sample changes the cost, never the result.
    """
    fps = cut(fps.select("fp"))
    rows = fps.count()
    if rows < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    taken = fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, 2 * rows // (3 * FIT_ROWS)))) == 0).limit(FIT_ROWS)
    sample = np.array([r[0] for r in taken.collect()] or [0], dtype=np.int64).view(np.uint64)
    plan = probing_plan(sample, rows, radius)

    def make():
        def f(batch: pa.RecordBatch):
            v = batch.column(0).to_numpy().view(np.uint64)
            keys, roles, values = [], [], []
            for k, (part, t) in enumerate(plan):
                key = np.zeros(len(v), dtype=np.uint64)
                for i, b in enumerate(part):
                    key |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
                for d in range(t + 1):
                    for flips in combinations(range(len(part)), d):
                        mask = np.uint64(sum(1 << i for i in flips))
                        keys.append(((key ^ mask) * np.uint64(8) + np.uint64(k)).view(np.int64))
                        roles.append(np.full(len(v), d > 0))
                        values.append(v.view(np.int64))
            return [pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(values))]

        return f

    probes = flat_rows(fps, make, "key long, probe boolean, fp long")

    def verify(batches):
        """Whole keys in sorted order; a key's values are kept as numbers only."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, own, other = None, [], []

        def done():
            x = np.concatenate(own).view(np.uint64) if own else np.empty(0, np.uint64)
            y = np.concatenate(other).view(np.uint64) if other else np.empty(0, np.uint64)
            # members of the key against each other and against those whose ball reaches it; probes alone meet elsewhere
            return spanning(x, np.concatenate([x, y]), radius) if len(x) + len(y) > 1 and len(x) else []

        for b in batches:
            k, p, v = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            edges, at = [], np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
            for s, e in zip(at, [*at[1:], len(k)]):
                if k[s] != key:
                    edges += done()
                    key, own, other = k[s], [], []
                own.append(v[s:e][~p[s:e]])
                other.append(v[s:e][p[s:e]])
            if edges:
                x = np.array(edges, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], schema=schema)
        if edges := done():
            x = np.array(edges, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], schema=schema)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return probes.repartition(n, "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def near_classes(prints: DataFrame, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """``key, fp, component_id, root``: the smallest ``key`` reachable over links of at most ``radius`` differing bits, and the
    class, named by a fingerprint of it.

    ``prints`` has ``key, fp``. Copies meet as one fingerprint first, so a group of copies costs a partial aggregate per
    task. Rows of a null key keep a class, whose id is the smallest key that is not null, else null. Repeated rows stay.
    """
    prints = cut(prints.select(key, "fp"))
    least = prints.groupBy("fp").agg(F.min(key).alias("first"))
    joined = components(links(least, radius), []).select(F.col("id").alias("fp"), "root")
    named = cut(least.join(joined, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id", "root")
    return prints.join(by_fp, "fp").select(key, "fp", "component_id", "root")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_classes(with_fingerprint(docs, drop=("text",)).select("doc_id", F.col("fingerprint").alias("fp")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
