"""What the operators on conversations share: turns in order, digests of long id lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markgrid.llm.common import ordered_rank

#: rows of the input that one part of the ranking holds
PART_ROWS = 50_000
#: ids that one row of a hashed list holds
LIST_ROWS = 8_192
#: characters of a role or text that order rows of one turn, before their hashes do
TIE_CHARS = 32
#: SHA-256 of the empty string
EMPTY = hashlib.sha256(b"").hexdigest()
LEAST = -(2**63)
#: CRC-32 of a string of ASCII characters, as SQL
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::ubigint)),
 lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda y, z: xor(y >> 1, (y & 1) * 3988292384::ubigint))), 4294967295::ubigint)"""


def hashes(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes of the columns, never the least number."""
    return [F.greatest(F.xxhash64(*columns), F.lit(LEAST + 1)).alias("_hi"), F.greatest(F.xxhash64(F.lit(1), *columns), F.lit(LEAST + 1)).alias("_lo")]


def tie_keys(role: str = "role", text: str = "text") -> list[Column]:
    """Columns ``_role, _text, _hi, _lo`` that put rows of one turn in order of role, then text, without moving texts."""
    return [F.substring(role, 1, TIE_CHARS).alias("_role"), F.substring(text, 1, TIE_CHARS).alias("_text"), *hashes(role, text)]


TURN_ORDER = ["turn", "_role", "_text", "_hi", "_lo"]


def numbered(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (slim) with ``_at``, the number of a row in its conversation from 0, in order of turn; a null turn comes first.

    Rows of one turn go by role, then text. A conversation of any length is dealt over tasks.
    """
    return ordered_rank(rows, ["conv_id"], ["conv_id", *TURN_ORDER], count, PART_ROWS, "_at")


def listed_digests(members: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """``key, name``: SHA-256 of the ascending decimal ``value`` of a key's rows, joined by commas.

    Lists are joined in ranges first, so the task that hashes a key reads few rows, one batch at a time, however long the list.
    """
    spark = members.sparkSession
    kinds = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, held = None, None, []

        def out():
            return pa.RecordBatch.from_pylist([dict(zip(key, own)) | {"_first": first, "_list": ",".join(map(str, held))}], schema=parts)

        parts = None
        for b in batches:
            parts = parts or pa.schema([b.schema.field(k) for k in key] + [pa.field("_first", pa.int64()), pa.field("_list", pa.string())])
            for *k, v in zip(*[b.column(c).to_pylist() for c in [*key, value]]):
                if k != own or len(held) == LIST_ROWS:
                    if held:
                        yield out()
                    own, first, held = k, v, []
                held.append(v)
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, kinds_ = None, None, None

        def out():
            return pa.RecordBatch.from_pylist([dict(zip(key, own)) | {name: state.hexdigest()}], schema=kinds_)

        for b in batches:
            kinds_ = kinds_ or pa.schema([b.schema.field(k) for k in key] + [pa.field(name, pa.string())])
            for *k, text in zip(*[b.column(c).to_pylist() for c in [*key, "_list"]]):
                if k != own:
                    if own is not None:
                        yield out()
                    own, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if own is not None:
            yield out()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = members.select(*key, value).repartitionByRange(n, *key, value).sortWithinPartitions(*key, value)
    lists = ranged.mapInArrow(join, f"{kinds}, _first long, _list string")
    return lists.repartition(n, *key).sortWithinPartitions(*key, "_first").mapInArrow(digest, f"{kinds}, {name} string")
