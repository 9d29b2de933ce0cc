"""Quality rules and an isolation forest on their statistics.

Every text gets counts that quality rules use. Forests of random splits, one over all shares of them and one over each
share, isolate unusual documents after few splits. Labels tell which unusual is bad: the threshold on each forest's
anomaly score is calibrated on labelled documents. Rules reject first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markgrid.llm.common import add_columns, share, table
from markgrid.session import cut

#: trees of a forest, documents a tree sees, and documents they are drawn from at most (by a hash of the id)
TREES, TREE_ROWS, FIT_DOCS = 60, 256, 8_192
#: share of good labelled documents that a forest may reject, and bad ones that each good one lost must bring
GOOD_LOST, WORTH = 0.005, 4
#: steps of the anomaly score in which labelled documents are counted
STEPS = 1000
#: shares that forests look at, by their place in ``features``
FORESTS = {"all": (0, 1, 2, 3, 4), "symbols": (0,), "dup_lines": (1,), "repeats": (2,), "upper": (3,), "marks": (4,)}
SYMBOLS, MARKS, BLANKS = "#*$%&|<>", "!?|", " \t\n\r\x0b\x0c"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks")


def repeat_words(words: list[bytes], size: int = 5) -> tuple[int, int]:
    """Words inside windows of ``size`` words that occur twice or more in the text, and distinct words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    n = len(ids) - size + 1
    if n < 2:
        return 0, len(known)
    if len(known) ** size < 2**62:
        key = np.zeros(n, dtype=np.int64)
        for i in range(size):
            key = key * len(known) + ids[i : i + n]
    else:  # exact too: names of pairs of names
        key = ids[:n]
        for i in range(1, size):
            key = np.unique(key * len(known) + ids[i : i + n], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum()), len(known)


def statistics(text: str | None) -> tuple[int, ...]:
    """``STATS`` of a text; all 0 for null and empty ones."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeats, distinct = repeat_words(words)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    b = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    return (
        len(words), len(text) - sum(text.count(c) for c in BLANKS), int(b[[ord(c) for c in SYMBOLS]].sum()), dup, repeats,
        lines, distinct, int(b[65:91].sum()), int(b[48:58].sum()), int(b[[ord(c) for c in MARKS]].sum()),
    )


def features(s: np.ndarray) -> np.ndarray:
    """Shares by which documents of any length compare, from rows of ``STATS``: near 0 in ordinary prose, so splits isolate
    what the rules watch for and not mere variety."""
    s = s.astype(np.float64)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.c_[s[:, 2] / chars, s[:, 3] / lines, s[:, 4] / words, s[:, 7] / chars, s[:, 9] / chars]


def usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, r: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """A tree of random splits: ``feature (-1: leaf), value, left, right, path length``."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0, level + usual_path(len(rows))))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        open_ = np.flatnonzero(high > low) if len(rows) > 1 else []
        if level < depth and len(open_):
            f = int(r.choice(open_))
            v = float(r.uniform(low[f], high[f]))
            left = rows[:, f] < v
            nodes[me] = (f, v, build(rows[left], level + 1), build(rows[~left], level + 1), 0.0)
        return me

    build(x, 0)
    return nodes


def forest(x: np.ndarray, seed: int) -> list[tuple[np.ndarray, ...]]:
    """``TREES`` trees, each over ``TREE_ROWS`` rows drawn without replacement."""
    r = np.random.default_rng(seed)
    size = min(TREE_ROWS, len(x))
    trees = [grow(x[r.choice(len(x), size, replace=False)], r, max(1, math.ceil(math.log2(max(2, size))))) for _ in range(TREES if len(x) else 0)]
    return [tuple(np.array(c) for c in zip(*t)) for t in trees]


def anomaly(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], size: int) -> np.ndarray:
    """Anomaly score of each row: 2 to the power of minus its mean path over the usual one; 0 without trees."""
    if not trees or size < 2:
        return np.zeros(len(x))
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, value, left, right, path in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := feature[at] >= 0).any():
            goes = x[rows, np.maximum(feature[at], 0)] < value[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        total += path[at]
    return 2.0 ** (-total / len(trees) / usual_path(size))


def with_statistics(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``STATS`` as longs."""

    def make():
        return lambda texts: list(np.array([statistics(t) for t in texts], dtype=np.int64).reshape(-1, len(STATS)).T.copy())

    return add_columns(docs, text, make, [(n, T.LongType()) for n in STATS], drop)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``stats`` (a written table of ``key`` and ``STATS``) with ``base_failed``, an anomaly score for each forest and ``kept``.

    The forests are fitted on at most ``FIT_DOCS`` documents that pass the rules. A forest's threshold is the score above
    which the most bad labelled documents lie, each good one counting as ``WORTH``, with at most ``GOOD_LOST`` of all good
    ones; labelled documents are counted by score in ``STEPS`` steps. Without such a score, or without bad labels, the
    rules alone decide. A null id has no label; of several labels the largest counts.
    """
    stats = stats.withColumn("base_failed", base_failed())
    fine = stats.where("not base_failed")
    part = max(1, fine.count() // (FIT_DOCS // 2))
    rows = fine.where(F.pmod(F.xxhash64(key), F.lit(part)) == 0).select(key, *STATS).orderBy(F.xxhash64(key), *STATS).limit(FIT_DOCS).collect()
    x = features(np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, len(STATS)))
    size = min(TREE_ROWS, len(x))
    get = share(stats.sparkSession, [(list(at), forest(x[:, list(at)], seed)) for seed, at in enumerate(FORESTS.values())])
    names = [f"anomaly_{n}" for n in FORESTS]
    kinds = T.StructType([*stats.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def score(batches):
        forests = get()
        for b in batches:
            f = features(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in STATS], axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(anomaly(f[:, at], t, size), pa.float64()) for at, t in forests]], names=[*b.schema.names, *names])

    scored = cut(stats.mapInArrow(score, kinds))
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    known = scored.where("not base_failed").join(one, key).select("_label", F.posexplode(F.array(*names)).alias("forest", "score"))
    counts = known.groupBy("forest", F.floor(F.col("score") * STEPS).cast("int").alias("step")).agg(F.sum(F.when(F.col("_label") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_label") > 0, 0).otherwise(1)).alias("bad")).collect()  # STEPS rows a forest
    limits = [threshold({r["step"]: (r["good"], r["bad"]) for r in counts if r["forest"] == i}) for i in range(len(names))]
    usual = F.lit(True)
    for n, limit in zip(names, limits):
        usual = usual & (F.floor(F.col(n) * STEPS) < limit)
    return scored.withColumn("kept", ~F.col("base_failed") & usual)


def threshold(counts: dict[int, tuple[int, int]]) -> int:
    """The step from which on rejecting pays most; beyond all steps if it never does."""
    good = bad = 0
    most, best, gain = GOOD_LOST * sum(g for g, _ in counts.values()), 2 * STEPS, 0
    for step in sorted(counts, reverse=True):
        good, bad = good + counts[step][0], bad + counts[step][1]
        if good > most:
            break
        if bad - WORTH * good > gain:
            best, gain = step, bad - WORTH * good
    return best


def op1_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",)))
    out = judged(stats, table(spark, sf_dir, "labels"))
    return out.select("doc_id", *STATS[:5], "base_failed", *[f"anomaly_{n}" for n in FORESTS], "kept")
