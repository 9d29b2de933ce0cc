"""Repeated byte strings by a common-prefix interval tree over an enhanced suffix array.

A string of ``length`` bytes that occurs twice selects the same anchor in both places (the last least hash of its short
grams), so suffixes are only taken at anchors, one in about thirty bytes, and meet by the anchor's hash. Within a hash the
suffixes are sorted, neighbours give the common prefixes, and a stack scan lists the intervals of the prefix tree. The
members of an interval are scanned the same way by what precedes them: an extension to the left that not all members
share splits them, and each part that still spans different continuations is a maximal repeat with all its occurrences.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markgrid.llm.common import flat_rows, table
from markgrid.session import cut, is_empty

#: bytes of the grams that anchors are chosen by
GRAM = 32
#: suffixes of one anchor hash that a task holds; more are parted by longer common strings first
MOST = 50_000


def gram_hashes(b: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every gram of ``size`` bytes (a power of two), by joining halves."""
    h, n, p = b.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while n < size:
        h = h[:-n] * np.uint64(p) + h[n:]
        p, n = p * p % 2**64, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return x if n == width else np.minimum(x[: len(x) - (width - n)], x[width - n :])


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of grams that are the least of some window of ``length`` bytes."""
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, width = gram_hashes(np.frombuffer(raw, np.uint8)), length - GRAM + 1
    low = sliding_min(h, width)
    edge = np.zeros(width - 1, np.uint64)
    # a gram counts if it is the least of one of the windows that hold it
    most = ~sliding_min(~np.concatenate([edge, low, edge]), width)
    at = np.flatnonzero(most == h)
    return at, h[at]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """``common length, first, last`` of the prefix tree's inner nodes of ``least`` or more, by one stack scan.

    ``lcp[i]`` is shared by the sorted strings i - 1 and i; ``lcp[0]`` is not looked at.
    """
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        value, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack[-1][0] > value:
            top, first = stack.pop()
            if top >= least:
                out.append((top, first, i - 1))
        if stack[-1][0] < value:
            stack.append((value, first))
    return out


def maximal_repeats(before: list[bytes], after: list[bytes], length: int, low: int, high: int) -> list[tuple[int, int, list[int]]]:
    """Groups ``left, right, members``: strings of ``left + right >= length`` bytes around the anchor with all places.

    ``before`` is read backwards from the anchor, ``after`` forwards. ``left`` is taken from ``low`` up to ``high``, beyond
    which another part looks. Groups whose members all go on alike are left to the longer string.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    lcp = [0] + [shared(after[i], after[j]) for i, j in zip(order, order[1:])]
    out = []
    for right, i, j in intervals(lcp, length - high):
        least = max(low, length - right)
        # members of one child go on alike after `right` bytes
        starts = [k for k in range(i + 1, j + 1) if lcp[k] == right]
        members = sorted(range(i, j + 1), key=lambda k: before[order[k]])
        lcs = [0] + [min(high, shared(before[order[k]], before[order[m]])) for k, m in zip(members, members[1:])]
        child = [bisect_right(starts, k) for k in members]
        found = intervals(lcs, max(least, 1))
        if least == 0:
            found = [f for f in found if f[0] > 0] + [(0, 0, len(members) - 1)]
        for left, p, q in found:
            if len(set(child[p : q + 1])) > 1:
                out.append((left, right, [order[k] for k in members[p : q + 1]]))
    return out


def later_places(before: list[bytes], after: list[bytes], age: list[int], length: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """``member, left, right``: strings around the anchor that an older member has too, enough to cover all of them.

    The interval tree is walked bottom-up as its stack scan closes intervals; every open interval keeps its members in the
    order of what precedes them. When a child joins, only the members of the smaller side are looked up in the larger:
    those that share ``left`` bytes before the anchor stand next to each other there, and their oldest decides. If it is
    older, the member repeats it, else it repeats the member; all others of that stretch already repeat their oldest, with
    a longer string. Walking outwards stops at the first older one or where the strings get too short.
    """
    n = len(after)
    if n == 2:
        right, left = shared(*after), min(high, shared(*before))
        return [(0 if age[0] > age[1] else 1, left, right)] if left >= low and left + right >= length else []
    order = sorted(range(n), key=after.__getitem__)
    by_left = sorted(range(n), key=before.__getitem__)
    lefts, rank = [before[k] for k in by_left], [0] * n
    for r, k in enumerate(by_left):
        rank[k] = r
    ages = np.array([age[k] for k in by_left])
    out: list[tuple[int, int, int]] = []

    def join(a: np.ndarray, b: np.ndarray, right: int) -> np.ndarray:
        small, big = (a, b) if len(a) <= len(b) else (b, a)
        least = max(low, length - right)
        for y in small.tolist():
            i = j = int(np.searchsorted(big, y))  # big[i:j] shares `left` bytes with y
            while True:
                left = max(shared(lefts[y], lefts[big[i - 1]]) if i else -1, shared(lefts[y], lefts[big[j]]) if j < len(big) else -1)
                left = min(left, high)
                if left < least:
                    break
                head = lefts[y][:left]
                i = int(np.searchsorted(big, bisect_left(lefts, head)))
                j = int(np.searchsorted(big, bisect_left(lefts, head + b"\xff" * (length + 1)) if left else len(lefts)))
                oldest = int(big[i + int(ages[big[i:j]].argmin())])
                if ages[oldest] < ages[y]:
                    out.append((by_left[y], left, right))
                    break
                out.append((by_left[oldest], left, right))
                if left == least:
                    break
        return np.insert(big, np.searchsorted(big, small), small)

    stack: list[list] = []  # common length and members of each open interval
    one = np.array([rank[order[0]]])
    for i in range(1, n + 1):
        value = shared(after[order[i - 1]], after[order[i]]) if i < n else 0
        value = value if value >= length - high else 0
        while stack and stack[-1][0] > value:
            right, members = stack.pop()
            one = join(members, one, right)
        if value and stack and stack[-1][0] == value:
            stack[-1][1] = join(stack[-1][1], one, value)
        elif value:
            stack.append([value, one])
        if i < n:
            one = np.array([rank[order[i]]])
    return out


def pieces_key(before: bytes, after: bytes, length: int, low: int, high: int) -> int | None:
    """Key under which all strings meet whose part before the anchor has ``low`` to ``high`` bytes; None if there is none."""
    import xxhash

    if len(before) < low or len(after) < length - high:
        return None
    return xxhash.xxh64_intdigest(before[:low] + b"|" + after[: length - high], 1000 * low + high)


def signed(x) -> np.ndarray:
    return np.array(x, dtype=np.uint64).view(np.int64)


def candidate_rows(docs: DataFrame, length: int) -> DataFrame:
    """From ``doc, text``: ``key, same, doc, pos, after`` of every anchor, or of a string known to repeat.

    ``key`` is the anchor's hash and ``same`` that of all bytes a string of ``length`` around it can have; equal ones in a
    slice of rows are one row, the earliest, and the others become rows ``same = null`` that hold a string already.
    """

    def make():
        import xxhash

        def f(batch: pa.RecordBatch):
            reach, out = length - GRAM, [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                at, h = anchors(raw, length)
                if len(at):
                    for col, v in zip(out, (h, [xxhash.xxh64_intdigest(raw[max(0, i - reach) : i + length]) for i in at.tolist()], np.full(len(at), doc), at, np.minimum(length, len(raw) - at))):
                        col.append(np.asarray(v, dtype=np.uint64 if v is h or isinstance(v, list) else np.int64))
            if not out[0]:
                return [[], [], [], [], []]
            key, same, doc, pos, after = (np.concatenate(c) for c in out)
            order = np.lexsort((pos, doc, after, same, key))
            first = np.ones(len(order), dtype=bool)
            k, s, a = key[order], same[order], after[order]
            first[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (a[1:] != a[:-1])
            keep = np.zeros(len(order), dtype=bool)
            keep[order[first]] = True
            # repeats go by document, where they are needed
            routed = np.where(keep, key, doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            return [pa.array(routed.view(np.int64)), pa.array(same.view(np.int64), mask=~keep), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(after.astype(np.int16))]

        return f

    return flat_rows(docs, make, "key long, same long, doc long, pos int, after short")


def settle(rows: DataFrame, length: int) -> DataFrame:
    """``kind, key, doc, pos, after``: kind 0 occurrences of a string met earlier, kind 1 one place of each different
    surrounding of an anchor that has several. Keys are streamed in order; a task holds one batch."""
    reach = length - GRAM

    def f(batches):
        names = ["kind", "key", "doc", "pos", "after"]
        types = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int16()]
        last = None  # key, same, after of the last place, its row if not given out, and whether its key has several

        def out(kind, cols):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind), types[0]), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names=names)

        for b in batches:
            null = b.column("same").is_null().to_numpy(zero_copy_only=False)
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "doc", "pos", "after")]
            if null.any():
                yield out(0, [c[null] for c in cols])
            same = b.column("same").fill_null(0).to_numpy(zero_copy_only=False)[~null]
            key, doc, pos, after = (c[~null] for c in cols)
            if not len(key):
                continue
            prev = last[:3] if last else (None, None, None)
            new_key = np.r_[prev[0] != key[0], key[1:] != key[:-1]]
            new = new_key | np.r_[(prev[1], prev[2]) != (same[0], after[0]), (same[1:] != same[:-1]) | (after[1:] != after[:-1])]
            if not new.all():
                yield out(0, [c[~new] for c in (key, doc, pos, after)])
            at = np.flatnonzero(new)
            fresh = new_key[at]
            # a place is given out if its key has another: before it, or after it
            several = ~fresh
            follow = np.r_[several[1:], False]
            give = several | follow
            if len(at) and several[0] and last and last[3] is not None:
                yield out(1, [[x] for x in last[3]])
            if give.any():
                yield out(1, [c[at[give]] for c in (key, doc, pos, after)])
            if len(at):
                i = at[-1]
                held = None if give[-1] else (key[i], doc[i], pos[i], after[i])
            else:
                held = last[3]
            last = (key[-1], same[-1], after[-1], held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "same", "after", "doc", "pos")
    return dealt.mapInArrow(f, "kind byte, key long, doc long, pos int, after short")


def with_text(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """``by_doc`` with the bytes of its document, which travel compressed."""

    def make():
        codec = pa.Codec("zstd")

        def f(batch: pa.RecordBatch):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            return [batch.column(0), [codec.compress(r, asbytes=True) for r in raw], [len(r) for r in raw]]

        return f

    small = flat_rows(docs.select("doc", "text"), make, "doc long, packed binary, n_bytes long")
    return small.join(by_doc, "doc", how)


def unpacked(packed: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, n, asbytes=True) if n else b""


def surroundings(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """``key, doc, pos, before, behind`` of ``key, doc, pos``: the bytes before an anchor, backwards, and from it on."""

    def make():
        def f(batch: pa.RecordBatch):
            out = [[], [], [], [], []]
            for doc, packed, n, found in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw = unpacked(packed, n)
                for p in found:
                    a = p["pos"]
                    for col, v in zip(out, (p["key"], doc, a, raw[max(0, a - length + GRAM) : a][::-1], raw[a : a + length])):
                        col.append(v)
            return out

        return f

    by_doc = places.groupBy("doc").agg(F.collect_list(F.struct("key", "pos")).alias("found"))  # at most a document's anchors
    return flat_rows(with_text(docs, by_doc, "inner").select("doc", "packed", "n_bytes", "found"), make, "key long, doc long, pos int, before binary, behind binary")


REPEATS = "doc long, start int, end int, first boolean, string long"


def search(around: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Occurrences ``doc, start, end, first, string`` of the maximal repeats within each key of ``around``, whose strings
    have ``low`` to ``high`` bytes before the anchor."""

    def f(batches):
        import xxhash

        schema = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.bool_()), ("string", pa.int64())])
        rows: list[tuple] = []
        key, held = None, [[], [], [], [], [], []]  # a key's doc, pos, before, behind, low, high

        def done():
            doc, pos, before, after, lows, highs = held
            if len(doc) < 2:
                return
            low, high = lows[0], highs[0]
            if not keep_first:
                age = list(zip(doc, pos))
                if len(doc) > 2:
                    rank = {x: i for i, x in enumerate(sorted(age))}
                    age = [rank[x] for x in age]
                rows.extend((doc[m], pos[m] - left, pos[m] + right, False, None) for m, left, right in later_places(before, after, age, length, low, high))
                return
            for left, right, members in maximal_repeats(before, after, length, low, high):
                earliest = min(members, key=lambda m: (doc[m], pos[m]))
                name = xxhash.xxh64_intdigest(before[members[0]][:left][::-1] + after[members[0]][:right])
                rows.extend((doc[m], pos[m] - left, pos[m] + right, m == earliest, int(signed([name])[0])) for m in members)

        def out():
            cols = list(zip(*rows)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

        for b in batches:
            k = b.column("key").to_numpy()
            cols = [b.column(c).to_pylist() for c in ("doc", "pos", "before", "behind", "low", "high")]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist() if len(k) else []
            for s, e in zip(at, [*at[1:], len(k)]):
                if k[s] != key:
                    done()
                    key, held = k[s], [[], [], [], [], [], []]
                for h, c in zip(held, cols):
                    h.extend(c[s:e])
                if len(rows) > 1 << 16:
                    yield out()
            yield out()
        done()
        yield out()

    n = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return around.repartition(n, "key").sortWithinPartitions("key").mapInArrow(f, REPEATS)


def ranged(around: DataFrame, low: int, high: int) -> DataFrame:
    return around.withColumns({"low": F.lit(low).cast("short"), "high": F.lit(high).cast("short")})


def parted(around: DataFrame, length: int) -> DataFrame:
    """The suffixes of too large keys, again under the keys of both halves of their range ``low`` to ``high``."""

    def make():
        def f(batch: pa.RecordBatch):
            cols = [batch.column(c).to_pylist() for c in range(3, 7)]
            keys, row, lows, highs = [], [], [], []
            for i, (before, behind, low, high) in enumerate(zip(*cols)):
                mid = (low + high) // 2
                for a, b in ((low, mid), (mid + 1, high)):
                    k = pieces_key(before, behind, length, a, b)
                    if k is not None:
                        for col, v in zip((keys, row, lows, highs), (k, i, a, b)):
                            col.append(v)
            take = pa.array(row, pa.int32())
            return [pa.array(signed(keys)), *(batch.column(c).take(take) for c in range(1, 5)), lows, highs]

        return f

    columns = ["key", "doc", "pos", "before", "behind", "low", "high"]
    return flat_rows(around.select(*columns), make, "key long, doc long, pos int, before binary, behind binary, low short, high short")


def of_one_string(around: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Repeats of keys that stand for one string each: the earliest place is a plain aggregate."""
    string = around.select("key", "doc", (F.col("pos") - F.col("low")).cast("int").alias("start"), (F.col("pos") - F.col("low") + length).cast("int").alias("end"))
    first = string.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rows = string.join(first, "key").withColumn("first", F.struct("doc", "start") == F.col("_first"))
    return (rows if keep_first else rows.where("not first")).select("doc", "start", "end", "first", F.col("key").alias("string"))


def crowded(around: DataFrame, length: int, low: int, high: int, keep_first: bool) -> list[DataFrame]:
    """Repeats of keys with more than ``MOST`` suffixes: ranges are halved until keys are small or one string each.

    Strings with ``low`` to ``high`` bytes before the anchor share what all of them have, so a half's key is that; most
    suffixes are then alone. All ranges of a round are one table, so the jobs, and what the driver holds of them, grow with
    the rounds (about seven) and not with the ranges; what a round finds is written before the next.
    """
    out, ranges, rows = [], [(low, high)], ranged(around, low, high)
    while True:
        if any(a == b for a, b in ranges):
            out.append(cut(of_one_string(rows.where("low = high"), length, keep_first)))
        ranges = [h for a, b in ranges if a < b for h in ((a, (a + b) // 2), ((a + b) // 2 + 1, b))]
        if not ranges:
            return out
        half = cut(parted(rows.where("low < high"), length))
        sizes = cut(half.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
        out.append(cut(search(half.join(sizes.where(F.col("_n") <= MOST), "key", "left_semi"), length, keep_first)))
        large = sizes.where(F.col("_n") > MOST)
        if is_empty(large):
            return out
        rows = half.join(large, "key", "left_semi")


def repeats(docs: DataFrame, length: int = 100, keep_first: bool = True) -> DataFrame:
    """Occurrences ``doc, start, end, first, string`` of repeated strings of at least ``length`` bytes.

    ``docs`` has unique long ``doc`` (the order of documents) and ``text``. ``string`` names equal strings and ``first`` the
    earliest place, by document and start. Together the places that are not first cover exactly the bytes of strings that
    also start earlier. Rows for a string met before in the same surroundings are given with no ``string``. Without
    ``keep_first`` the list is only as long as it must be to cover these bytes, and names no strings.
    """
    if length < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes")
    reach = length - GRAM
    rows = cut(settle(candidate_rows(docs, length), length))
    start = F.greatest(F.lit(0), F.col("pos") - reach)
    seen = rows.where((F.col("kind") == 0) & (F.col("pos") - start + F.col("after") >= length)).select("doc", start.alias("start"), (F.col("pos") + F.col("after")).cast("int").alias("end"), F.lit(False).alias("first"), F.lit(None).cast("long").alias("string"))
    places = rows.where("kind = 1").select("key", "doc", "pos")
    large = cut(places.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > MOST))
    out = seen.unionByName(search(ranged(surroundings(docs, places.join(large, "key", "left_anti"), length), 0, reach), length, keep_first))
    if not is_empty(large):
        for more in crowded(cut(surroundings(docs, places.join(large, "key", "left_semi"), length)), length, 0, reach, keep_first):
            out = out.unionByName(more)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc, text`` with a unique number in the order of ids, null ids last, and ``doc, <key>, copies`` unless it is the id.

    With unique ids, the usual case, no text moves. Else rows of an id are ordered by a hash of their text, and equal rows
    are one with its count.
    """
    ids = docs.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull())
    if not ids.limit(1).count():
        return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")), None
    rows = docs.select(F.col(key), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_hash"))
    order = cut(rows.groupBy(key, "_hash").agg(F.count("*").alias("copies")).orderBy(F.col(key).asc_nulls_last(), "_hash").withColumn("doc", F.monotonically_increasing_id()))
    one = rows.dropDuplicates([key, "_hash"]).withColumnRenamed(key, "_key")
    same = F.col("_key").eqNullSafe(F.col(key)) & (F.col("_hash") == F.col("_h"))
    return cut(one.join(order.withColumnRenamed("_hash", "_h"), same).select("doc", "text")), order.select("doc", key, "copies")


def without_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kept (binary), n_bytes, spans`` of every row: its bytes without those that a string of ``length`` bytes covers
    that also starts earlier, and the removed runs.

    Null texts are empty. A row equal to another in id and text loses all its bytes, once it has ``length`` of them.
    """
    docs, names = numbered(docs, key, text)
    found = repeats(docs, length, keep_first=False).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def make():
        def f(batch: pa.RecordBatch):
            kept, spans = [], []
            for packed, n, found in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                raw, runs, parts, at = unpacked(packed, n), merged([(s["start"], s["end"]) for s in found or []]), [], 0
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join(parts) + raw[at:])
                spans.append([{"start": a, "end": b} for a, b in runs])
            return [batch.column(0), kept, batch.column(2), spans]

        return f

    done = flat_rows(with_text(docs, found, "left").select("doc", "packed", "n_bytes", "found"), make, "doc long, kept binary, n_bytes long, spans array<struct<start:int,end:int>>")
    if names is None:
        return done.select(F.col("doc").alias(key), "kept", "n_bytes", "spans")
    again = done.join(names, "doc").withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    gone = (F.col("_turn") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return again.select(key, F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "n_bytes", F.when(gone, whole).otherwise(F.col("spans")).alias("spans"))


def op5_prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
