"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan sees counts, not documents: best-fit decreasing runs once over at most ``capacity`` lengths, placing whole
runs of equal pieces into runs of equal sequences. Pieces then take the planned slots by joining on their rank within
their length, so no task holds more than a part of the pieces and the driver only the histogram.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markgrid.llm.common import flat_rows, ordered_rank, per_process, rank_within, table
from markgrid.session import cut

#: rows of all pieces that one part of the ranking holds
PART_ROWS = 20_000


def encoder(path: str):
    """``text -> uint32 ids`` of a tokenizer file.

    A byte-level BPE whose ids follow its merges is run by tiktoken, which gives the same ids in a quarter of the time;
    any other file is run by tokenizers. The file's added tokens, such as ``<|endoftext|>``, have their own ids within a text.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    # tiktoken cuts at added tokens as they stand: none may start another or take what is around it
    plain = not any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")) and not any(a != b and a in b for a in special for b in special)
    pre = spec.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    follows = [model["vocab"].get(a + b) for a, b in merges]
    if plain and model.get("type") in ("BPE", None) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and follows == sorted(follows) and not model.get("ignore_merges"):
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[ch] for ch in t): i for t, i in model["vocab"].items() if t not in special}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: np.array(enc.encode(text, allowed_special="all"), dtype=np.uint32)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a piece: ``key, piece, start, length, ids`` (little-endian 32-bit ids as binary), then the columns ``carry``.

    A document is its ids followed by ``end_id``; null and empty texts are that id alone. Only documents of more than
    ``capacity`` ids are cut, into whole pieces of ``capacity``; their first piece holds what does not fill one.
    """

    def make():
        encode = per_process(("encoder", tokenizer), lambda: encoder(tokenizer))

        def f(batch: pa.RecordBatch):
            take, piece, start, length, ids = [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                all_ids = np.append(encode(t), np.uint32(end_id)) if t else np.array([end_id], dtype=np.uint32)
                raw, n = all_ids.astype("<u4").tobytes(), len(all_ids)
                a, b, k = 0, n if n <= capacity else n % capacity or capacity, 0
                while a < n:
                    take.append(row), piece.append(k), start.append(a), length.append(b - a), ids.append(raw[4 * a : 4 * b])
                    a, b, k = b, b + capacity, k + 1
            at = pa.array(take, pa.int32())
            return [batch.column(0).take(at), piece, start, length, ids, *(batch.column(2 + i).take(at) for i in range(len(carry)))]

        return f

    kind = lambda c: f"`{c}` {docs.schema[c].dataType.simpleString()}"
    return flat_rows(docs.select(key, text, *carry), make, ", ".join([kind(key), "piece int, start long, length long, ids binary", *map(kind, carry)]))


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``length -> count``.

    Rows ``length, first rank, end rank, first sequence, pieces a sequence, offset``: piece ``rank`` of its length goes to
    sequence ``first + (rank - first rank) div pieces`` at ``offset + (rank - first rank) mod pieces * length``. A piece
    goes where it leaves the least room; a sequence that just took one stays the tightest until the next does not fit,
    so every run of equal sequences takes ``room div length`` pieces each, and the plan equals the one-by-one rule.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs (first sequence, sequences) by room left
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for r in range(length, capacity):
            while left and room[r]:
                first, n = room[r].pop()
                rank, left = _fill(plan, room, length, rank, left, first, n, r, capacity)
        if left:
            n = -(-left // (capacity // length))
            rank, left = _fill(plan, room, length, rank, left, opened, n, capacity, capacity)
            opened += n
    return plan


def _fill(plan, room, length: int, rank: int, left: int, first: int, n: int, r: int, capacity: int) -> tuple[int, int]:
    """Put up to ``left`` pieces into a run of ``n`` sequences with room ``r``; what stays goes back to ``room``."""
    each = r // length
    full, rest = min(n, left // each), 0
    if full < n:
        rest = left - full * each if left < n * each else 0
    used = full * each + rest
    if used:
        plan.append((length, rank, rank + used, first, each, capacity - r))
    if full:
        room[r - each * length].append((first, full))
    if rest:
        room[r - rest * length].append((first + full, 1))
    if (untouched := n - full - (rest > 0)) > 0:
        room[r].append((first + n - untouched, untouched))
    return rank + used, left - used


def pack(pieces: DataFrame, capacity: int, order: list[str], by_order: bool = False) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``: as few sequences of at most ``capacity`` as best-fit
    decreasing needs, each filled without gaps from 0.

    ``length`` must lie in 1..capacity. ``order`` names columns that tell pieces apart; equal rows get slots of their
    own. The slim input is written once, as it is counted and then placed. An empty table gives an empty table. With
    ``by_order`` the pieces of a length take their slots in this order, else in a shuffle by hash, and sequences are numbered
    by their first piece in it.
    """
    slim = cut(pieces)
    counts = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = best_fit_plan(counts, capacity)
    spark = pieces.sparkSession
    slots = spark.createDataFrame(plan, "_len long, _from long, _to long, _first long, _each long, _base long")
    ranked = (ordered_rank if by_order else rank_within)(slim, ["length"], order, sum(counts.values()), PART_ROWS, "_rank")
    at = F.col("_rank") - F.col("_from")
    # the plan has a few rows for each of at most `capacity` lengths, whatever the number of pieces
    placed = (
        ranked.join(F.broadcast(slots), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumn("sequence_id", F.col("_first") + F.floor(at / F.col("_each")).cast("long"))
        .withColumn("offset", F.col("_base") + at % F.col("_each") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )
    if not by_order:
        return placed
    placed = cut(placed)
    least = placed.groupBy("sequence_id").agg(F.min(F.struct(*order)).alias("_least"))
    named = ordered_rank(least, [], ["_least", "sequence_id"], sum(counts.values()), PART_ROWS, "_named").select("sequence_id", "_named")
    return placed.join(named, "sequence_id").withColumn("sequence_id", F.col("_named")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, payload: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text", places: DataFrame | None = None) -> DataFrame:
    """Tokenize, cut and pack ``docs``: ``key, piece, start, length, <payload>, sequence_id, offset``.

    ``payload`` are columns of each piece's binary ``ids``; by default the ids themselves. Only they are written and moved.
    ``places`` (``key, source, position``) gives each document's position, in whose order pieces are packed; rows without
    one come first.
    """
    payload = {"ids": F.col("ids")} if payload is None else payload
    columns = [key, "piece", "start", "length", *payload]
    carry = () if places is None else ("source",)
    pieces = token_pieces(docs, tokenizer, end_id, capacity, key, text, carry).select(*columns[:4], *[c.alias(n) for n, c in payload.items()], *carry)
    if places is None:
        return pack(pieces, capacity, [key, "piece", "start"])
    at = places.select(F.col(key).alias("_key"), F.col("source").alias("_source"), F.col("position").alias("_position"))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("source").eqNullSafe(F.col("_source"))
    placed = pieces.join(at, same, "left").select(*columns, "_position")
    # all columns: pieces that share a place are told apart, however many
    out = pack(placed, capacity, ["_position", *columns], by_order=True)
    return out.select(*columns, "sequence_id", "offset")


def packed_digests(docs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The packing with a checksum of each piece's ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), payload={"ids_crc32": F.crc32("ids")}, places=places)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))
