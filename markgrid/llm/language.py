"""Language identification with error-correcting output codes.

Every language has a codeword of bits. Binary classifiers on hashed character n-grams predict one bit each; decoding sums,
for every codeword, the logistic loss of all margins against its bits and takes the least, so a few wrong bits are
corrected. Texts whose two best codewords are close are flagged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from markgrid.llm.common import add_columns, flat_rows, share, table
from markgrid.llm.toxicity import held_out

#: labelled documents of each language that the classifiers are fitted on at most, by a hash of their id
FIT_DOCS = 500
#: hashed n-gram features, characters read at a time
DIM, CHUNK = 4096, 1 << 20
#: all different splits of the languages are bits up to so many languages; random ones beyond
EXHAUSTIVE = 6
#: score under which a prediction is flagged as ambiguous
AMBIGUOUS = 0.6
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Square roots of hashed counts of 1 to 3 lower-case characters, of length 1."""
    out = np.zeros(DIM)
    low = text.lower()
    for i in range(0, len(low), CHUNK):
        c = np.frombuffer(low[max(0, i - 2) : i + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for k in range(3):
            if k:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[k:] * np.uint64(0x94D049BB133111EB)
            # what began before this chunk was counted with the one before
            new = h[max(0, min(i, 2) - k) :] if i else h
            out += np.bincount(((new ^ (new >> np.uint64(31))) >> np.uint64(20)).astype(np.int64) & (DIM - 1), minlength=DIM)
    out = np.sqrt(out)
    return (out / max(np.sqrt((out * out).sum()), 1e-12)).astype(np.float32)


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """``k`` codewords of -1 and 1, one row each; every bit splits the languages."""
    if k < 2:
        return np.ones((k, 0))
    if k <= EXHAUSTIVE:
        bits = [[1 if i == 0 else 1 - 2 * (b >> (i - 1) & 1) for i in range(k)] for b in range(1, 2 ** (k - 1))]
        return np.array(bits).T.astype(float)
    r, width = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(k)))
    best, far = np.ones((k, width)), -1
    for _ in range(200):
        m = r.choice([-1.0, 1.0], (k, width))
        gram = m @ m.T - 2 * width * np.eye(k)
        if (np.abs(m.sum(axis=0)) < k).all() and (d := (width - gram.max()) / 2) > far:
            best, far = m, d
    return best


class Classifiers:
    """A linear logistic classifier a bit, and the languages' codewords."""

    def __init__(self, languages: list[str]):
        self.languages, self.code = languages, codewords(len(languages))
        self.w = np.zeros((DIM + 1, self.code.shape[1]), dtype=np.float32)

    def train(self, x: np.ndarray, which: np.ndarray, rounds: int = 300, ridge: float = 1e-5) -> None:
        """Accelerated gradient steps on the logistic loss of all bits at once; languages weigh alike."""
        y = self.code[which].astype(np.float32)
        weight = (1 / np.bincount(which, minlength=len(self.languages))[which] / len(self.languages)).astype(np.float32)[:, None]
        a = np.c_[x, np.ones(len(x), dtype=np.float32)]
        rate, v = np.float32(4.0), np.zeros_like(self.w)
        for _ in range(rounds):
            ahead = self.w + np.float32(0.9) * v
            z = np.clip(y * (a @ ahead), -30, 30)
            g = -a.T @ (weight * y / (1 + np.exp(z))) + np.float32(ridge) * ahead
            v = np.float32(0.9) * v - rate * g
            self.w = self.w + v

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword under the summed logistic loss, and its share among all by that loss."""
        if len(self.languages) < 2:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        margin = np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)
        loss = np.log1p(np.exp(-margin[:, None, :] * self.code[None])).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), p.max(axis=1) / p.sum(axis=1)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifiers:
    """Classifiers from at most ``FIT_DOCS`` texts with a letter of each language outside the held-out fold."""
    ids = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(key, lang)
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIT_DOCS).select(F.col(key).alias("_id")).distinct()
    some = docs.join(F.broadcast(chosen), F.col(key) == F.col("_id")).where(F.col(lang).isNotNull()).select(text, lang)

    def make():
        def f(batch: pa.RecordBatch):
            pairs = [(t, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            return [[ngrams(t).tobytes() for t, _ in pairs], [y for _, y in pairs]]

        return f

    rows = flat_rows(some, make, "x binary, lang string").collect()  # FIT_DOCS a language, DIM floats each
    languages = sorted({r["lang"] for r in rows})
    model = Classifiers(languages)
    if len(languages) > 1:
        rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
        model.train(np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows]), np.array([languages.index(r["lang"]) for r in rows]))
    return model


def identified(docs: DataFrame, model: Classifiers, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Null texts, texts without a letter, and all texts if no language was learned get ``und``, score 0, ambiguous.
    """
    get = share(docs.sparkSession, model)

    def make():
        m = get()

        def f(texts):
            known = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                best, p = m.decode(np.stack([ngrams(texts[i]) for i in known]))
                score[known] = p
                for i, b in zip(known, best):
                    names[i] = m.languages[b]
            return [names, score, score < AMBIGUOUS]

        return f

    return add_columns(docs, text, make, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType())], drop)


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")), drop=("text",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
