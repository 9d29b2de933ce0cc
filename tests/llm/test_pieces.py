"""Piece encoding against the sentencepiece library; the character map against its normaliser."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from markgrid.llm import pieces
from markgrid.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


def texts():
    rnd = random.Random(1)
    pool = "abcdefgh  \n\t.,éß漢字𐍈▁<>0x19ÀàŁ"
    yield from ["", " ", "\n", "▁", "<s> <0x41> a▁b", "<unk></s>", "a\x00b", "  x  ", "�", "a⁇b", "▁▁ab  cd", "x" * 500, "ab " * 300, "  " * 40, "\U0001f600" * 30]
    yield from ("".join(rnd.choice(pool) for _ in range(rnd.randrange(200))) for _ in range(400))
    for _ in range(300):
        yield "".join(chr(rnd.choice([rnd.randrange(1, 0xD800), rnd.randrange(32, 127), rnd.randrange(0xE000, 0x110000)])) for _ in range(rnd.randrange(60)))


def test_ids_text_and_spans_equal_the_library(model, library):
    for t in texts():
        ids, begins, ends = model.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert model.decode(ids) == library.decode(library.encode(t)), t
        proto = library.encode_as_proto(t).pieces
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in proto], t


def test_any_ids_decode_as_the_library_does(model, library):
    rnd = random.Random(4)
    for _ in range(500):
        ids = [rnd.choice([0, 1, 2, 28705, 259, rnd.randrange(3, 259), rnd.randrange(259, 32000)]) for _ in range(rnd.randrange(12))]
        assert model.decode(np.array(ids, dtype=np.int64)) == library.decode(ids), ids


def test_merging_by_scan_and_by_heap(model, monkeypatch):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("▁aeinorst") for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    scanned = [model.merged(w) for w in words]
    monkeypatch.setattr(pieces, "SCANNED", 0)
    assert [model.merged(w) for w in words] == scanned


def message(**fields) -> bytes:
    out = b""
    for name, value in fields.items():
        number = int(name[1:])
        if isinstance(value, int):
            out += bytes([number << 3]) + bytes([value]) if number < 16 else bytes([(number << 3 & 127) | 128, number >> 4, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            size, n = b"", len(value)
            while n > 127:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            out += bytes([number << 3 | 2]) + size + bytes([n]) + value
    return out


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_map_and_alignment(rule):
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(pieces._fields(norm.serialized_normalizer_spec()))
    own = pieces.Model(["<unk>"], [0.0], [pieces.UNKNOWN], pieces.CharMap(spec[2]), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
    rnd = random.Random(9)
    pool = "ab  ｱﾞﬁ①Ａ㌔é 　\t\n漢ÅΩ​"
    for t in ["", " ", "   ", "ｱﾞ  x ﬁ ", " a", "　a　"] + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(30))) for _ in range(400)]:
        raw, origin = own.normalise(t)
        text, offsets = norm.normalize(t, with_offsets=True)
        assert raw.decode() == text, t
        if text:
            # the library's offsets are of characters
            at = [len(raw.decode()[:i].encode()) for i in range(len(text) + 1)]
            assert [len(t.encode()[: origin[i]].decode()) for i in at] == offsets, t


def test_model_without_byte_pieces_joins_unknown_neighbours():
    kinds = [(b"<unk>", 0.0, 2), ("▁".encode(), -1.0, 1), (b"a", -2.0, 1), (b"b", -3.0, 1), (b"ab", -0.5, 1), ("▁ab".encode(), -0.1, 1)]
    raw = b"".join(message(f1=message(f1=p, f2=s, f3=k)) for p, s, k in kinds) + message(f2=message(f3=2)) + message(f3=message(f1=b"identity", f3=1, f4=0))
    own, lib = pieces.parsed(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in ["ab", "abzzab", "zz", "a漢字b", "b a zyx  ab", "漢"]:
        ids, begins, ends = own.encode(t)
        assert ids.tolist() == lib.encode(t), t
        assert own.decode(ids) == lib.decode(ids.tolist()), t
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in lib.encode_as_proto(t).pieces], t


def test_query(spark, library):
    want = {}
    for r in table(spark, SMALL, "documents").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
    rows = pieces.op11_piece_codec(spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)


def test_edges(spark, docs, none, library):
    """Null, empty and very long texts, repeated rows, null ids, clashing columns, an empty table; ids back to texts."""
    df = docs.withColumnRenamed("score", "ids")
    out = pieces.decoded(pieces.encoded(df, PATH), PATH).collect()
    assert len(out) == docs.count() and "n_chars" in out[0].asDict()
    for r in out:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
        assert len(r.begins) == len(r.ends) == len(r.ids)
        raw = (r.text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
    assert pieces.digests(none, PATH).collect() == [] and pieces.encoded(none, PATH).collect() == []
    back = pieces.decoded(spark.createDataFrame([([],), (None,)], "ids array<long>"), PATH).collect()
    assert [r.decoded for r in back] == ["", None]
