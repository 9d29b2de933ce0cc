"""SentencePiece encoding and decoding that keeps the source bytes of every piece.

A text is normalised by longest prefixes of the model's compiled character map, and every normalised byte remembers the
source byte it comes from. Pairs are then merged by score, best first; every piece is projected through the alignment to
the source bytes it stands for. Decoding goes back from ids alone. The model file is read here, field by field; the
sentencepiece library is not used on the way.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import math
import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from markgrid.llm.common import add_columns, per_process, table

#: what stands for a space in pieces
SPACE = "▁"
#: kinds of pieces in model files; fixed values of the file format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: stretches of text whose pieces a Python worker remembers at least, and the longest of them in characters
CACHED, CACHED_CHARS = 400_000, 64
#: characters up to which a scan for the best pair is faster than a heap
SCANNED = 48


def _replace_each_byte(e: UnicodeError):
    return "�" * (e.end - e.start), e.end


codecs.register_error("markgrid_each_byte", _replace_each_byte)


def _fields(raw: bytes):
    """``number, value`` of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


class CharMap:
    """Longest-prefix replacement by a compiled character map: a double array of byte transitions and a pool of results."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]
        first = bytes(b for b in range(1, 256) if self.units and self._step(self._base(0), b) is not None)
        #: what a replaced prefix can start with
        self.starts = first

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``raw`` from ``at`` on, and what replaces it."""
        base, found = self._base(0), None
        for n in range(at, len(raw)):
            node = self._step(base, raw[n])
            if node is None:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                found = n + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


@dataclass
class Model:
    """A pair-merging model: pieces with scores, what normalises texts, and what an unknown character becomes."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    chars: CharMap
    dummy: bool = True
    trim: bool = True
    escape: bool = True
    suffix: bool = False
    fallback: bool = False
    unknown_text: str = " ⁇ "
    rank: dict[str, int] = field(default_factory=dict)
    cache: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        if USER in self.kinds:
            raise ValueError("models with pieces that users define are not supported")
        self.rank = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, UNUSED)}
        self.score = {p: self.scores[i] for p, i in self.rank.items()}
        self.unused = UNUSED in self.kinds
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.joined = {a + b for p in self.rank for a, b in zip(p, p[1:])}
        # where no piece holds a space mark after another character, merging never crosses from a word to the next
        apart = not any(x[1] == SPACE and x[0] != SPACE for x in self.joined)
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else r"(?s:.+)")
        self.controls = [i for i, k in enumerate(self.kinds) if k == CONTROL]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.surface = []
        for p, k in zip(self.pieces, self.kinds):
            self.surface.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode())
        starts = self.chars.starts + (b" " if self.trim and b" " not in self.chars.starts else b"")
        self.special = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in starts) + b"]") if starts else None

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte where it comes from.

        Nothing but bytes that can start a mapped prefix (and spaces, where they are trimmed) is looked at one by one;
        stretches between them stand for themselves.
        """
        raw = text.encode()
        parts: list[tuple[bytes, int, bool]] = []  # bytes, source, whether they stand for themselves
        at, blank, done = 0, self.trim, 0
        while at < len(raw):
            m = self.special.search(raw, at) if self.special else None
            stop = m.start() if m else len(raw)
            if stop > at:
                parts.append((raw[at:stop], at, True))
                blank, at = False, stop
                continue
            took, new = (self.chars.longest(raw, at) if raw[at] in self.chars.starts else None) or (0, b"")
            if not took:
                # one character that is not mapped
                took = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + took]
            if blank:
                new = new.lstrip(b" ")
            if new:
                parts.append((new, at, False))
                blank = self.trim and new.endswith(b" ")
            at += took
        done = at
        plain = b"".join(p for p, _, _ in parts)
        origin = np.concatenate([np.arange(s, s + len(p)) if own else np.full(len(p), s) for p, s, own in parts] or [np.zeros(0, np.int64)])
        if self.trim:
            kept = len(plain.rstrip(b" "))
            if kept < len(plain):
                done = int(origin[kept])
            if not kept:
                return b"", np.array([done])
            origin, plain = origin[:kept], plain[:kept]
            first = int(origin[0])
        else:
            first = 0
        if not raw:
            return b"", np.array([0])
        mark = SPACE.encode() if self.escape else b" "
        if self.escape:
            wide = np.where(np.frombuffer(plain, np.uint8) == 0x20, len(mark), 1)
            plain, origin = plain.replace(b" ", mark), np.repeat(origin, wide)
        before, after = (mark if self.dummy and not self.suffix else b""), (mark if self.dummy and self.suffix else b"")
        return before + plain + after, np.concatenate([np.full(len(before), first), origin, np.full(len(after) + 1, done)])

    def merged(self, stretch: str) -> list[str]:
        """The characters of ``stretch`` after merging neighbours, the pair of the best score first, the leftmost of equals."""
        part: list[str] = list(stretch)
        if len(part) <= SCANNED and not self.unused:
            none, score = -math.inf, self.score
            best = [score.get(a + b, none) for a, b in zip(part, part[1:])]
            while best and (top := max(best)) > none:
                i = best.index(top)
                part[i] += part.pop(i + 1)
                del best[i]
                if i:
                    best[i - 1] = score.get(part[i - 1] + part[i], none)
                if i < len(best):
                    best[i] = score.get(part[i] + part[i + 1], none)
            return part
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        made: dict[str, tuple[str, str]] = {}
        heap: list[tuple[float, int, str, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (i := self.rank.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, part[a] + part[b], b))
                if self.kinds[i] == UNUSED:
                    made[part[a] + part[b]] = part[a], part[b]

        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, whole, b = heapq.heappop(heap)
            if not part[a] or b >= len(part) or part[a] + part[b] != whole or after[a] != b:
                continue
            part[a], part[b] = whole, ""
            after[a] = after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])

        def used(p: str) -> list[str]:
            i = self.rank.get(p)
            return [p] if i is None or self.kinds[i] != UNUSED or p not in made else [q for x in made[p] for q in used(x)]

        return [q for p in part if p for q in used(p)]

    def _stretch(self, s: str) -> bytes:
        """Pairs of 32-bit numbers: the ids of a stretch, and how many normalised bytes each stands for."""
        out = self.cache.get(s) or self.older.get(s)
        if out is None:
            joined = self.joined
            # merging never crosses two characters that no piece holds side by side
            cuts = [i for i in range(1, len(s)) if s[i - 1] + s[i] not in joined]
            out = b"".join([self._stretch(s[a:b]) for a, b in zip([0, *cuts], [*cuts, len(s)])]) if cuts else self._merged_ids(s)
        if len(s) <= CACHED_CHARS:
            if len(self.cache) >= CACHED:
                self.cache, self.older = {}, self.cache
            self.cache[s] = out
        return out

    def _merged_ids(self, s: str) -> bytes:
        out = array("I")
        for p in self.merged(s):
            i, raw = self.rank.get(p), p.encode()
            if i is not None:
                out.append(i), out.append(len(raw))
            elif self.fallback:
                for b in raw:
                    out.append(self.bytes[b]), out.append(1)
            else:
                out.append(self.unknown), out.append(len(raw))
        return out.tobytes()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids, begins, ends``; begins and ends are bytes of the source text.

        A character that falls back to bytes belongs to the last of its byte pieces; the others are empty at its start.
        """
        plain, origin = self.normalise(text) if text else (b"", np.array([0]))
        known, new = self.cache.get, self._stretch
        found = np.frombuffer(b"".join([known(s) or new(s) for s in self.stretch.findall(plain.decode())]), np.uint32).reshape(-1, 2)
        ids, width = found[:, 0], found[:, 1].astype(np.int64)
        if not len(ids):
            return ids, width, width
        stop = np.cumsum(width)
        start = stop - width
        lead = (np.frombuffer(plain, np.uint8) & 0xC0) != 0x80
        own = np.maximum.accumulate(np.where(lead, np.arange(len(plain)), 0))
        begins = origin[own[start]]
        ends = np.where(np.append(lead, True)[stop], origin[stop], begins)
        if not self.fallback and (unknown := ids == self.unknown).any():
            # neighbours that are unknown are one piece
            first = ~(unknown & np.append(False, unknown[:-1]))
            at = np.flatnonzero(first)
            ids, begins, ends = ids[at], begins[at], ends[np.append(at[1:], len(first)) - 1]
        return ids, begins, ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids. Bytes that are not UTF-8 become U+FFFD each."""
        ids = np.asarray(ids)
        # a control piece has no text, but bytes on both sides of it are no character
        stops = np.flatnonzero(np.isin(ids, self.controls))
        runs = [x.tolist() for x in np.split(ids, stops)] if len(stops) else [ids.tolist()]
        head = next((r[k] for r in runs for k in range(len(r)) if self.kinds[r[k]] != CONTROL), None)
        raw = [b"".join(map(self.surface.__getitem__, r)) for r in runs]
        if (self.dummy or self.trim) and head is not None and self.kinds[head] in (NORMAL, UNUSED) and self.pieces[head].startswith(SPACE):
            k = next(k for k, r in enumerate(raw) if r)
            raw[k] = raw[k].lstrip(b" ") if self.trim else raw[k][1:]
        return "".join([r.decode("utf-8", "markgrid_each_byte") for r in raw])


def load(path: str) -> Model:
    """The model of a ``.model`` file. Only pair-merging models without pieces that users define are supported."""
    with open(path, "rb") as f:
        return parsed(f.read())


def parsed(raw: bytes) -> Model:
    pieces, scores, kinds, trainer, spec = [], [], [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            x = dict(_fields(value))
            pieces.append(x.get(1, b"").decode()), kinds.append(x.get(3, NORMAL))
            scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            spec = dict(_fields(value))
    if trainer.get(3, 1) != 2:
        raise ValueError("only pair-merging models are supported")
    unknown = trainer.get(44, b" \xe2\x81\x87 ").decode()
    return Model(pieces, scores, kinds, CharMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)), bool(trainer.get(35, 0)), unknown)


def _model(path: str) -> Model:
    return per_process(("pieces", path), lambda: load(path))


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids, begins, ends``: the pieces of each whole text and the source bytes that each stands for.

    Null and empty texts have no pieces. Rows are neither joined nor reordered: repeated rows, null keys and further columns
    pass through, columns called ids, begins or ends are replaced, an empty table gives an empty one. A text is one row of
    one task, whatever its length; memory follows the longest.
    """
    def make():
        model = _model(path)

        def f(texts):
            found = [model.encode(t) for t in texts]
            return [[x[k].astype(np.int64) for x in found] for k in range(3)]

        return f

    longs = T.ArrayType(T.LongType())
    return add_columns(df, text, make, [("ids", longs), ("begins", longs), ("ends", longs)])


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids; null stays null, an empty array is an empty text."""
    def make():
        model = _model(path)
        return lambda rows: [[None if r is None else model.decode(np.array(r, dtype=np.int64)) for r in rows]]

    return add_columns(df, ids, make, [(name, T.StringType())])


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with the number of ids and digests of the ids, of the text they decode to and of the source spans.

    The same encoding and decoding as ``encoded`` and ``decoded`` in one pass, for tables whose ids need not be kept:
    ``n_tokens, ids_sha256, decoded_sha256, spans_sha256`` (of little-endian 64-bit begins, then ends).
    """
    def make():
        model = _model(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def one(t):
            ids, begins, ends = model.encode(t)
            return len(ids), sha(",".join(map(model.decimal.__getitem__, ids.tolist())).encode()), sha(model.decode(ids).encode()), sha(begins.astype("<i8").tobytes() + ends.astype("<i8").tobytes())

        return lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)] if texts else [[], [], [], []]

    return add_columns(df, text, make, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("spans_sha256", T.StringType())])


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded: ``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256``.

    Null and empty texts have no ids; repeated rows and rows of a null doc_id are kept; an empty table gives an empty one.
    """
    import public_tokenizers

    docs = digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
