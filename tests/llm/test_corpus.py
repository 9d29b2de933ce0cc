"""Operators over pairs, orders and the whole corpus, and the pipeline, against brute force."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from markgrid.llm import embeddings, mixing, packing, repeats, simhash, urls
from markgrid.llm.common import rank_within, table
from markgrid.llm.registry import ORACLE_SQL, QUERIES
from tools.check import rows

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---- SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    docs = sorted(table(spark, MID, "documents").collect(), key=lambda r: r["doc_id"])
    fp = [plain_fingerprint(d["text"]) for d in docs]
    linked = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = classes(len(fp), linked)
    got = {r["doc_id"]: r for r in QUERIES["op9_simhash_near_dedup"](spark, MID).collect()}
    for i, d in enumerate(docs):
        r = got[d["doc_id"]]
        assert r["fingerprint"] == f"{fp[i]:016x}" and r["component_id"] == docs[root[i]]["doc_id"]


def test_every_link_is_found_whatever_the_plan(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(30)} | {0, 2**64 - 1, 2**63}
    fps = sorted(fps)
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_classes(df).collect()}
    assert [got[i] for i in range(len(fps))] == want


def test_thresholds_hold_the_pigeonhole_sum():
    sample = np.array([random.Random(i).getrandbits(64) for i in range(300)], dtype=np.uint64)
    for n in (1000, 10**6, 10**9):
        plan = simhash.probing_plan(sample, n, 3)
        covered = sorted(b for part, _ in plan for b in part)
        assert len(set(covered)) == len(covered)
    assert sum(simhash.allocate([[0, 5, 50], [0, 1, 2], [0, 9, 90]], 0)) == 0


def test_simhash_of_edges(spark, docs, none):
    marked = simhash.with_fingerprint(docs).select("doc_id", "fingerprint").withColumnRenamed("fingerprint", "fp")
    got = simhash.near_classes(marked).collect()
    assert len(got) == docs.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0} and {r["component_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    assert simhash.near_classes(simhash.with_fingerprint(none).selectExpr("doc_id", "fingerprint as fp")).count() == 0
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)


# ---- embeddings


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links string")


def test_forest_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF_ROWS", 64)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([centres[rng.integers(0, 60, 900)] + rng.normal(scale=0.12, size=(900, 24)), centres[:1] + rng.normal(scale=0.05, size=(200, 24))]).astype(np.float32)
    x = np.concatenate([x, x[:30], 2 * x[30:40]])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embeddings.linked(vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)])).collect()}
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.9 * near.sum() > 0
    root = classes(len(x), list(zip(*np.nonzero(near))))
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.95
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_leaves_are_split_to_the_end(spark, monkeypatch):
    """The first trees know 64 of 6,000 rows; leaves end small all the same, but for a heap narrower than the overlap."""
    for name, value in (("FIT_ROWS", 64), ("LEAF_ROWS", 64), ("BLOCK_ROWS", 160), ("OWN_ROWS", 300), ("PASS_ROWS", 400)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(5400, 16)), np.ones((600, 16)) + rng.normal(scale=1e-3, size=(600, 16))])
    x[1:2000:2] = x[:2000:2] + rng.normal(scale=0.06, size=(1000, 16))
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    largest, split = [], embeddings.split_to_the_end

    def watched(met, size, margin):
        out = split(met, size, margin)
        for df in (met, out):
            largest.append(sorted((r["count"] for r in df.groupBy("leaf").count().collect()), reverse=True))
        lists = out.groupBy("cid").agg({"leaf": "count"}).collect()
        assert len(lists) == len(x) and out.where("not array_contains(leaves, leaf)").count() == 0
        return out

    monkeypatch.setattr(embeddings, "split_to_the_end", watched)
    got = {r["vec_id"]: r for r in embeddings.linked(vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)])).collect()}
    before, after = largest
    assert before[0] > 1500
    # a leaf that holds the heap stays whole when the heap is so much of it that no split leaves a fifth out
    large = [n for n in after if n > 160]
    assert all(600 <= n <= 600 / 0.6 for n in large) and len(after) > 100 and len(large) <= 12, large
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= near.sum(axis=1)).all() and n[:5400].sum() >= 0.9 * near[:5400].sum() > 1000
    assert (n[5400:] >= 599).all()


def test_embeddings_of_edges(spark):
    v = [1.0, 2.0, 3.0]
    data = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 2.0]), (5, [float("inf"), 1.0, 2.0]), (6, []), (7, v), (8, v), (8, v), (None, v), (9, [2.0, 4.0, 6.0]), (10, [1.0, 2.0]), (None, None), (11, [-0.0, 0.0, 1.0]), (12, [0.0, -0.0, 2.0])]
    got = embeddings.linked(vectors(spark, [(i, x, "s") for i, x in data])).collect()
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert all(by[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6, 10))
    assert by[7] == [(4, 7, True)] and by[8] == [(4, 7, False)] * 2 and by[9] == [(4, 7, False)]
    assert sorted(by[None], key=repr) == sorted([(4, 7, False), (0, None, True)], key=repr)
    assert by[11] == [(1, 11, True)] and by[12] == [(1, 11, False)]
    assert embeddings.linked(vectors(spark, [])).count() == 0


# ---- repeats


def plain_removal(texts, length=100):
    seen, out = set(), []
    for raw in texts:
        gone, here = bytearray(len(raw)), set()
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out.append((bytes(b for b, g in zip(raw, gone) if not g), sum(gone), len([1 for x in bytes(gone).split(b"\0") if x])))
    return out


def removal(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("most", [50_000, 2])
def test_repeats_against_all_strings(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    docs = sorted(table(spark, SF, "documents").collect(), key=lambda r: r["doc_id"])[: 200 if most > 2 else 25]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    got = removal(repeats.without_repeats(df))
    want = plain_removal([(d["text"] or "").encode() for d in docs])
    for d, (kept, gone, spans) in zip(docs, want):
        r = got[d["doc_id"]]
        assert bytes(r["kept"]) == kept and r["n_bytes"] - len(kept) == gone and len(r["spans"]) == spans


def test_crowded_keys_take_a_few_writes_however_many_ranges(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = word(240)
    texts = [word(60) + passage + word(60) for _ in range(40)]
    monkeypatch.setattr(repeats, "MOST", 10)
    written = []
    monkeypatch.setattr(repeats, "cut", lambda df, f=repeats.cut: written.append(df.columns) or f(df))
    got = removal(repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    # a key of 40 surroundings stays crowded in each of the 69 ranges, of seven rounds
    assert 10 < len(written) < 40
    for d, (kept, gone, spans) in enumerate(plain_removal([t.encode() for t in texts])):
        assert bytes(got[d]["kept"]) == kept and got[d]["n_bytes"] - len(kept) == gone and len(got[d]["spans"]) == spans


def test_repeats_query_gives_the_digest(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_prefix_intervals"](spark, SF).collect()}
    docs = sorted(table(spark, SF, "documents").collect(), key=lambda r: r["doc_id"])
    for d, (kept, gone, spans) in zip(docs, plain_removal([(d["text"] or "").encode() for d in docs])):
        r = got[d["doc_id"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (gone, spans, hashlib.sha256(kept).hexdigest())


def test_later_places_cover_what_older_ones_have():
    r = random.Random(1)
    for _ in range(1500):
        pairs = list({(bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))), b"zz" + bytes(r.choice(b"ab") for _ in range(r.randint(0, 6)))) for _ in range(r.randint(2, 9))})
        if len(pairs) < 2:
            continue
        before, after, age = [p[0] for p in pairs], [p[1] for p in pairs], r.sample(range(len(pairs)), len(pairs))
        low, high = r.choice([(0, 6), (0, 3), (4, 6), (2, 2)])
        cover = lambda spans: {(m, q) for m, x, y in spans for q in range(6 - x, 6 + y)}
        same = lambda i, j, o: min(len(before[i]), len(before[j])) >= o and min(len(after[i]), len(after[j])) >= 8 - o and before[i][:o] == before[j][:o] and after[i][: 8 - o] == after[j][: 8 - o]
        full = {(i, q) for i in range(len(pairs)) for j in range(len(pairs)) if age[j] < age[i] for o in range(7) if same(i, j, o) for q in range(6 - o, 14 - o)}
        part = {(i, q) for i in range(len(pairs)) for j in range(len(pairs)) if age[j] < age[i] for o in range(low, high + 1) if same(i, j, o) for q in range(6 - o, 14 - o)}
        listed = [(m, x, y) for x, y, ms in repeats.maximal_repeats(before, after, 8, low, high) for m in ms if age[m] > min(age[k] for k in ms)]
        for got in (cover(repeats.later_places(before, after, age, 8, low, high)), cover(listed)):
            assert part <= got <= full


def test_groups_name_all_places(spark):
    passage = "".join(random.Random(5).choice("abcdefghij ") for _ in range(160))
    df = spark.createDataFrame([(i, f"{i * 7919} {'xyz' * i} {passage} {i * 31} tail") for i in range(6)], "doc long, text string")
    found = repeats.repeats(df, 100).where("string is not null").collect()
    groups = defaultdict(list)
    for r in found:
        groups[r["string"]].append(r)
    assert any(len({r["doc"] for r in g}) == 6 and sum(r["first"] for r in g) == 1 and all(r["end"] - r["start"] >= 160 for r in g) for g in groups.values())


def test_repeats_of_edges(spark, docs, none):
    out = repeats.without_repeats(docs)
    got = out.collect()
    assert len(got) == docs.count() and repeats.without_repeats(none).count() == 0
    kept = sorted((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in got if r["doc_id"] == 4)
    assert kept == [(4, 97, 97), (4, 97, 97)]  # under the length nothing goes
    long = next(r for r in got if r["doc_id"] == 6)
    assert 0 < len(long["kept"]) < 300 and long["n_bytes"] > 200_000


# ---- packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_by_one_best_fit(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 64) for _ in range(r.choice([0, 1, 50, 400]))]
    slots = {}
    for length, a, b, first, each, base in packing.best_fit_plan(dict(Counter(lengths)), 64):
        for rank in range(a, b):
            slots[length, rank] = (first + (rank - a) // each, base + (rank - a) % each * length)
    fill = defaultdict(list)
    for (length, _), (seq, at) in slots.items():
        fill[seq].append((at, length))
    for pieces in fill.values():
        assert [a for a, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 64
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        i = min(fits, key=lambda i: bins[i]) if fits else len(bins)
        bins += [64] * (i == len(bins))
        bins[i] -= n
    assert len(fill) == len(bins) and len(slots) == len(lengths)


def test_packing_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = defaultdict(list)
    fill = defaultdict(list)
    for r in QUERIES["op8_best_fit_packing"](spark, SF).collect():
        got[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in table(spark, SF, "documents").collect():
        ids = np.array(tok.encode(d["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        parts = sorted(got[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == 1024 for r in parts[1:]) and (len(ids) > 1024 or len(parts) == 1)
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for pieces in fill.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at <= 1024
    total = sum(n for p in fill.values() for _, n in p)
    assert len(fill) <= 1.02 * total / 1024 + 1


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n", "  <|endoftext|>  z", "<|endoftext| >", "don't <|ENDOFTEXT|> 漢<|endoftext|>字"])
def test_added_tokens_have_their_own_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_files_that_tiktoken_cannot_cut_alike_are_run_by_tokenizers(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    path = tmp_path / "stripping.json"
    path.write_text(json.dumps(spec))
    text = "a   <|endoftext|> b"
    assert packing.encoder(str(path))(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_packing_of_edges(spark, docs, none):
    out = packing.packed_digests(docs)
    assert out.select("sequence_id", "offset").distinct().count() == out.count() >= docs.count()
    assert out.where("piece = 0").count() == docs.count() and packing.packed_digests(none).count() == 0


def test_ids_themselves_are_given(spark, docs):
    import public_tokenizers

    r = packing.pack_documents(docs.where("doc_id = 8"), public_tokenizers.path("byte_bpe_50k.json")).first()
    assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == [64, 2]


# ---- mixing


def plain_schedule(weights):
    """Earliest deadline first, slot by slot, with a heap of released blocks."""
    total, had, out, ready, later = sum(weights.values()), dict.fromkeys(weights, 0), [], [], []
    for s in weights:
        heapq.heappush(later, (0, s))
    for t in range(total):
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(had[s] + 1) * total // weights[s]), s))
        s = heapq.heappop(ready)[1]
        had[s] += 1
        heapq.heappush(later, (had[s] * total // weights[s], s))
        out.append(s)
    return out


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 50, "b": 1, "c": 1, "d": 48}, {f"s{i}": i + 1 for i in range(12)}])
def test_schedule_against_slot_by_slot(spark, weights):
    df = spark.createDataFrame(list(weights.items()), "source string, weight long")
    got = [r["source"] for r in mixing.period_schedule(df).orderBy("slot").collect()]
    assert got == plain_schedule(weights)
    had = Counter()
    for t, s in enumerate(got, 1):
        had[s] += 1
        assert all(abs(t * w / len(got) - had[x]) < 1 for x, w in weights.items())


def test_mix_places_every_document_once(spark):
    docs = table(spark, MID, "documents")
    got = QUERIES["op7_pfair_mixing"](spark, MID).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(docs.count())) and len({r["doc_id"] for r in got}) == docs.count()
    assert [r["slot"] for r in got] == sorted(r["slot"] for r in got)
    sizes = Counter((r["source"], r["block"]) for r in got)
    n = Counter(r["source"] for r in got)
    assert all(k == min(mixing.BLOCK_DOCS, n[s] - b * mixing.BLOCK_DOCS) for (s, b), k in sizes.items())


def test_mix_keeps_to_uneven_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else 's' || (id % 7) end as source")
    weights = spark.createDataFrame([("hot", 5), *((f"s{i}", 1) for i in range(7))], "source string, weight long")
    slots = sorted({(r["slot"], r["source"]) for r in mixing.mix(docs, weights, block_docs=4).collect()})
    w, had = {"hot": 5, **{f"s{i}": 1 for i in range(7)}}, Counter()
    for t, (slot, s) in enumerate(slots[:600], 1):
        had[s] += 1
        assert slot == t - 1 and all(abs(t * x / 12 - had[k]) < 1 for k, x in w.items())


def test_mixing_of_edges(spark, docs, none):
    out = mixing.mix(docs.withColumn("slot", docs.score))
    assert sorted(r["position"] for r in out.collect()) == list(range(docs.count())) and out.columns.count("slot") == 1
    assert mixing.mix(none).count() == 0


def test_mixing_runs_no_python(spark):
    plan = QUERIES["op7_pfair_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_rank_is_gapless_in_hot_groups(spark):
    df = spark.range(5000).selectExpr("case when id % 3 = 0 then null else id % 2 end as g", "id")
    by = defaultdict(list)
    for r in rank_within(df, ["g"], ["id"], 5000, 64).collect():
        by[r["g"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 5000


# ---- URLs

ODD = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://COM/x", "x://www.Example.com/en/", "x://a.example.com/en/a?b#c", "x://example.com/en", "x://net/es/", "x://a.net?/fr/", "x://a.net/fr/#", "x://u@b.net:80/fr/", "x://.com/", "x://a.com://b/", "x://InterNet/fr/", "x://ÄB.com/é\n/y"]


def test_urls_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{MID}/pages.parquet'")
    df = QUERIES["op6_digest_filter"](spark, MID)
    res = con.execute(ORACLE_SQL["op6_digest_filter"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in res.description], res.fetchall())


@pytest.mark.parametrize("most", [urls.MOST_BYTES, 1])
def test_odd_urls_against_sql(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_BYTES", most)
    data = [(i, u, "old") for i, u in enumerate(ODD + ODD[:3])]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [d[:2] for d in data])
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block")], "host string, path string, verdict string")
    df = urls.filtered(spark.createDataFrame(data, "page_id long, url string, rule string"), rules).select("page_id", "host", "path", "rule", "verdict")
    res = con.execute(ORACLE_SQL["op6_digest_filter"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in res.description], res.fetchall())


def test_digests_that_collide_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b, seed=0: len(b) % 3)
    path = tmp_path / "digests"
    path.write_bytes(urls.DigestArray.pack([("com", "/", "allow"), ("net", "/", "block"), ("org", "/", "block")]))
    a = urls.DigestArray.mapped(str(path))
    assert [a.key(j) for j in a.find([b"net\0/", b"com\0/"])] == [("net", "/"), ("com", "/")] and a.find([b"xyz\0/"])[0] == -1


@pytest.mark.parametrize("most", [urls.MOST_BYTES, 1])
def test_rules_of_equal_length_go_to_the_longer_host(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_BYTES", most)
    rules = spark.createDataFrame([("a.com", "/", "block"), ("com", "/xy", "allow")], "host string, path string, verdict string")
    r = urls.filtered(spark.createDataFrame([(1, "x://a.com/xy")], "page_id long, url string"), rules).first()
    assert (r["rule"], r["verdict"]) == ("a.com/", "block")


def test_urls_without_pages_or_rules(spark):
    pages = spark.createDataFrame([(1, "x://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    assert urls.filtered(pages.limit(0), rules).count() == 0
    assert urls.filtered(pages, rules.limit(0)).first()["verdict"] == "allow"


# ---- pipeline


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, MID, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if "text" in docs.columns else before
        out = corpus_pipeline.cut(stage(spark, docs, MID))
        after = out.collect()
        if name == "toxic_segments":
            toxic = {r["doc_id"] for r in table(spark, MID, "labels").collect() if r["toxic"] == 1}
            gone = set(before) - {r["doc_id"] for r in after}
            assert gone and len(gone & toxic) / len(toxic & set(before)) > 0.4
        if name == "simhash_near_duplicates":
            fp = {i: plain_fingerprint(r["text"]) for i, r in before.items()}
            ids = sorted(fp)
            root = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 3])
            assert sorted(r["doc_id"] for r in after) == sorted({ids[r] for r in root})
        if name == "secret_scan":
            from markgrid.llm.secrets import rule_spans

            assert len(after) == len(before) and all(not rule_spans(r["text"].replace("[secret]", "")) for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "pfair_mixing":
            assert sorted((r["doc_id"], r["text"]) for r in after) == sorted((i, r["text"]) for i, r in before.items())
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in after} == set(before) and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
        else:
            assert out.columns == docs.columns
        docs = out


def test_packing_follows_the_mix(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 64)
    docs = table(spark, SF, "documents")
    sources = sorted({r["source"] for r in docs.select("source").collect()})

    def run(weights):
        table_ = spark.createDataFrame(weights, "source string, weight long")
        at = {r["doc_id"]: r["position"] for r in corpus_pipeline.places(docs, table_).collect()}
        return at, sorted(tuple(r) for r in corpus_pipeline.packed(spark, docs, SF, table_).collect())

    (at, one), (_, other) = (run([(s, 1 + 30 * (s == hot)) for s in sources]) for hot in (sources[0], sources[-1]))
    assert [r[:5] for r in one] == [r[:5] for r in other] and one != other
    plan = {}
    for length, a, b, first, each, base in packing.best_fit_plan(dict(Counter(r[3] for r in one)), 1024):
        for rank in range(a, b):
            plan[length, rank] = (first + (rank - a) // each, base + (rank - a) % each * length)
    seen, want = Counter(), {}
    for r in sorted(one, key=lambda r: (at[r[0]], r[:5])):
        want[r[:5]] = plan[r[3], seen[r[3]]]
        seen[r[3]] += 1
    order = list(dict.fromkeys(want[r[:5]][0] for r in sorted(one, key=lambda r: (at[r[0]], r[:5]))))
    assert all((order[r[5]], r[6]) == want[r[:5]] for r in one)


def test_pipeline_of_edges(spark, docs, none, tmp_path):
    spark.createDataFrame([(3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data, name in ((docs, "some"), (none, "none")):
        d = data.coalesce(1)
        for _, stage in corpus_pipeline.STAGES:
            d = corpus_pipeline.cut(stage(spark, d, str(tmp_path)))
        assert (d.count() > 0) == (name == "some")


def test_repeated_rows_stay_once(spark, docs):
    out = corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()
    twice = spark.createDataFrame([(5, "one text of five words here"), (5, "ganz anderer Text mit sechs Wörtern"), (5, "one text of five words here")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.without_near_duplicates(spark, twice, SF).collect()) == ["ganz anderer Text mit sechs Wörtern", "one text of five words here"]
    assert Counter(r["doc_id"] for r in out)[3] == 1 and Counter(r["doc_id"] for r in out)[4] == 0 and Counter(r["doc_id"] for r in out)[0] == 1
