"""Training-data pipeline: documents in, packed sequences out.

Each stage is one operator of ``markgrid.llm`` over all that its predecessor kept. All stages but the last return the
columns of their input. Rows of a null doc_id and repeated rows go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from markgrid.llm import mixing, secrets, simhash, toxicity
from markgrid.llm.common import table
from markgrid.llm.packing import packed_digests
from markgrid.session import cut

#: documents of this score or more are rejected
TOXIC = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under ``TOXIC``; null and empty texts stay unless all texts score as toxic."""
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), "toxic"))
    columns = docs.columns
    clashing = [c for c in columns if c in ("score", "passages", "_evidence")]
    docs = docs.withColumnsRenamed({c: f"_own_{c}" for c in clashing})
    kept = toxicity.scored(docs, model, passages=False).where(F.col("score") < TOXIC)
    return kept.select(*[F.col(f"_own_{c}" if c in clashing else c).alias(c) for c in columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints: the one of the smallest doc_id, once if its row is repeated."""
    # a key without nulls, so that join and window share one exchange of the texts
    keyed = lambda df: df.withColumns({"_id": F.coalesce("doc_id", F.lit(0).cast("long")), "_none": F.col("doc_id").isNull()})
    marked = simhash.with_fingerprint(docs, name="_fp")
    classes = simhash.near_classes(marked.select("doc_id", F.col("_fp").alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", F.col("fp").alias("_fp"))).alias("_first")
    stay = classes.groupBy("root").agg(first).select("_first.doc_id", "_first._fp")
    found = keyed(marked).join(keyed(stay).select("_id", "_none", "_fp"), ["_id", "_none", "_fp"])
    once = Window.partitionBy("_id", "_none", "_fp").orderBy(F.xxhash64("text"))
    return found.withColumn("_turn", F.row_number().over(once)).where("_turn = 1").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` counted anew where it is a column."""
    out = secrets.masked(docs, secrets.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def places(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, position`` of the mix. Only ids and sources are scheduled; rows of one id share its first place."""
    slots = mixing.mix(docs.select("doc_id", "source"), weights)
    return slots.groupBy("doc_id", "source").agg(F.min("position").alias("position"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """All documents in the order of the mix."""
    first = places(docs, weights).withColumnsRenamed({"doc_id": "_id", "source": "_source", "position": "_position"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    return docs.join(first, same).orderBy("_position").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """Sequences of at most 1024 tokens with every document's pieces placed, in the order of the mix.

    A table keeps no order, so the places are computed again from ids and sources; they are those of the stage before.
    """
    return packed_digests(docs, places(docs, weights))


STAGES = [
    ("toxic_segments", without_toxic),
    ("simhash_near_duplicates", without_near_duplicates),
    ("secret_scan", without_secrets),
    ("pfair_mixing", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # classifiers, fingerprints and token ids are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; ``weights`` are the targets of the mix."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, weights) if stage in (mixed, packed) else stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
