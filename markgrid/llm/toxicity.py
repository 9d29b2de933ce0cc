"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens get log-odds of being in toxic against other documents, with an informative Dirichlet prior; a term counts only where the
log-odds over their error exceed what the best of all terms shows by chance. A linear scan finds all maximal scoring segments of a text; Karlin-Altschul
statistics turn a segment's score into evidence beyond what a text of that length shows by chance, and a logistic fit
on documents the log-odds have not seen turns a text's evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markgrid.llm.common import add_columns, flat_rows, share, table
from markgrid.session import cut

#: labelled documents that the model is fitted on at most, in the order of a hash of their id
FIT_DOCS = 20_000
#: terms that the model keeps at most, those with the clearest log-odds
LEXICON = 20_000
#: lengths of word beginnings that stand for unseen forms of a word
STEMS = (6, 5, 4)
#: weight of the Dirichlet prior as a share of the documents counted, where a term is tested, and in counts, where it is scored
PRIOR, SMOOTH = 0.5, 0.5
#: what a token without evidence takes from a segment
DRIFT = 0.5
#: scale of the expected number of chance segments
CHANCE = 0.1
LETTERS = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")


def terms(word: str) -> list[str]:
    """The word and its beginnings, marked apart."""
    return ["=" + word, *("^" + word[:n] for n in STEMS if len(word) > n)]


@dataclass
class Model:
    """Scores of terms, the decay of chance segments, and the logistic fit of evidence."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    bias: float = -5.0
    slope: float = 0.0

    def token(self, raw: str) -> float:
        """Log-odds of a whitespace token: its clearest letter run, by the word itself or else its longest known beginning."""
        best = -DRIFT
        for w in LETTERS.findall(raw.lower()):
            for t in terms(w):
                if t in self.scores:
                    best = max(best, self.scores[t])
                    break
        return best


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``first, last, score`` of a sequence that is ``-drift`` but for the given positions.

    ``scores`` are ``position, positive score`` in order. Linear time: every segment links to the nearest earlier one that starts
    from a lower sum, so a search passes over no segment twice.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, at = 0.0, 0
    for pos, s in scores:
        total -= drift * (pos - at)
        first, before = pos, total
        total, at = total + s, pos + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, pos, before, total, j))
                break
            first, _, before, _, link = found[j]
            del found[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in found]


def evidence(text: str | None, model: Model, cache: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
    """Evidence of a text and its significant passages (code point spans with their evidence)."""
    raw = text.split() if text else []
    hits = []
    for i, w in enumerate(raw):
        s = cache.get(w)
        if s is None:
            if len(cache) > 500_000:
                cache.clear()
            s = cache[w] = model.token(w)
        if s > 0:
            hits.append((i, s))
    if not hits:
        return 0.0, []
    segs = segments(hits, DRIFT)
    wanted = {p for seg in segs for p in seg[:2]}
    at = {i: m.span() for i, m in enumerate(TOKEN.finditer(text)) if i in wanted}
    total, out = 0.0, []
    for a, b, s in segs:
        # nats by which the score exceeds the best one expected by chance in a text of this length
        bits = model.decay * s - math.log(max(1.0, CHANCE * len(raw)))
        if bits > 0:
            total += bits
            out.append((at[a][0], at[b][1], bits))
    return math.log1p(total), out


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = FIT_DOCS) -> DataFrame:
    """``key, text, label`` of at most ``most`` labelled documents outside the held-out fold, one for each different text.

    A document with several labels has the largest. The chosen ids are a bounded table, so the texts stay where they are.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("_label"))
    ids = one.orderBy(F.xxhash64(key), key).limit(most)
    found = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(ids), key).select(key, text, F.col("_label").alias(label))
    return found.dropDuplicates([text])


def fit(sample: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id") -> Model:
    """Fit on ``sample`` (bounded, see ``labelled``): log-odds on four fifths, the logistic fit on the rest.

    Without labels of both classes the score of every text is the share of label 1, 0 without labels.
    """
    sample = cut(sample.select(text, label, (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("rest")))
    sizes = {r[label]: r["n"] for r in sample.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model(bias=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))

    def make():
        def f(batch: pa.RecordBatch):
            by = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = LETTERS.findall(t.lower())
                by[bool(y)]["#tokens"] += len(words)
                words = set(words)
                by[bool(y)]["#"] += 1
                by[bool(y)].update({x for w in words for x in terms(w)})
            keys = list(by[0] | by[1])
            return [keys, [by[1][k] for k in keys], [by[0][k] for k in keys]]

        return f

    counts = cut(flat_rows(sample.where("not rest").select(text, label), make, "term string, y1 long, y0 long").groupBy("term").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    total = counts.where("term = '#'").first()
    if total is None or not total["y1"] or not total["y0"]:
        return Model(bias=math.log(sizes[1] / sizes[0]))
    n1, n0 = total["y1"], total["y0"]
    a, weight = PRIOR * (F.col("y1") + F.col("y0")), PRIOR * (n1 + n0)
    odds = F.log((F.col("y1") + a) / (n1 + weight - F.col("y1") - a)) - F.log((F.col("y0") + a) / (n0 + weight - F.col("y0") - a))
    tokens = counts.where("term = '#tokens'").first()["y0"]
    s1, s0 = SMOOTH * n1 / (n1 + n0), SMOOTH * n0 / (n1 + n0)
    score = F.log((F.col("y1") + s1) / n1) - F.log((F.col("y0") + s0) / n0)
    clear = (
        counts.where("term not like '#%' and y1 > 0")
        .select("term", score.alias("odds"), ((F.col("y0") + s0) / max(tokens, 1)).alias("p"), (odds / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))).alias("z"))
        .where((F.col("z") > by_chance(counts.count())) & (F.col("odds") > DRIFT))
        .orderBy(F.desc("z"), "term")
        .limit(LEXICON)
        .collect()
    )
    model = Model({r["term"]: r["odds"] for r in clear})
    if clear:
        model.decay = chance_decay([(r["odds"], r["p"]) for r in clear if r["term"][0] == "="] or [(r["odds"], r["p"]) for r in clear])
    points = scored(sample.where("rest").select(text, label), model, text, passages=False).select("_evidence", label).collect()  # a fifth of a bounded sample
    x, y = np.array([r[0] for r in points]), np.array([float(r[1] > 0) for r in points])
    model.bias, model.slope = logistic(x, y, prior=sizes[1] / (sizes[0] + sizes[1]))
    return model


def by_chance(n: int) -> float:
    """The largest of ``n`` standard normal values to be expected."""
    root = math.sqrt(2 * math.log(max(n, 10)))
    return root - (math.log(math.log(max(n, 10))) + math.log(4 * math.pi)) / (2 * root)


def chance_decay(scores: list[tuple[float, float]]) -> float:
    """The positive root of ``sum p exp(root * score) = 1``, tokens without evidence at ``-DRIFT``."""
    s, p = np.array([x for x, _ in scores]), np.array([x for _, x in scores])
    rest = max(1e-12, 1 - p.sum())
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() + rest * math.exp(-mid * DRIFT) < 1 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Bias and slope by Newton steps with a weak ridge; the slope is never negative."""
    b = np.array([math.log(prior / (1 - prior)), 0.0])
    if len(x) == 0 or y.min() == y.max():
        return float(b[0]), 1.0
    a = np.c_[np.ones(len(x)), x]
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ b)
        b += np.clip(step, -2, 2)
    return float(b[0]), max(0.0, float(b[1]))


def scored(docs: DataFrame, model: Model, text: str = "text", passages: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages``: spans of the significant toxic passages, most of them none.

    Null and empty texts have the score of no evidence. With ``passages=False`` the evidence is given instead.
    """
    get = share(docs.sparkSession, model)  # LEXICON terms at most
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("evidence", T.DoubleType())]))

    def make():
        m, cache = get(), {}

        def f(texts):
            found = [evidence(t, m, cache) for t in texts]
            x = np.array([e for e, _ in found])
            score = 1 / (1 + np.exp(-np.clip(m.bias + m.slope * x, -30, 30)))
            return [score, [[{"start": a, "end": b, "evidence": c} for a, b, c in p] for _, p in found]] if passages else [score, x]

        return f

    return add_columns(docs, text, make, [("score", T.DoubleType()), ("passages", kind) if passages else ("_evidence", T.DoubleType())], drop)


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labelled(docs, labels, "toxic"))
    out = scored(docs.select("doc_id", "text"), model, drop=("text",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
