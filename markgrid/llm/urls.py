"""URL filter on a sorted digest array.

Rules are host and path prefixes. Their keys are hashed to 64 bits and sorted; every executor memory-maps one copy of
the array. A URL's possible keys are probed by vectorised binary search, and a hit counts only if the stored full string
is equal, so two keys of one digest cannot be confused.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markgrid.llm.common import add_columns, per_process, table
from markgrid.session import scratch_dir

#: bytes of rule strings up to which the array is built and sent to the executors; larger rule tables are joined
MOST_BYTES = 256 << 20
#: the contract's rules: host, path prefix, verdict (fixed values)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without a ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    cut = end if slash < 0 else slash
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:end]


class DigestArray:
    """Sorted 64-bit digests of ``host NUL path`` keys, with the keys and their verdicts in the same order.

    Of rules with the same key the first in order of verdict counts.
    """

    def __init__(self, digests: np.ndarray, offsets: np.ndarray, blob: np.ndarray, verdicts: np.ndarray, lengths: list[int]):
        self.digests, self.offsets, self.blob, self.verdicts, self.lengths = digests, offsets, blob, verdicts, lengths

    @staticmethod
    def pack(rules: list[tuple[str, str, str]]) -> bytes:
        """One file: a header of sizes, digests, offsets, verdicts (1: block), lengths of paths, key bytes."""
        import xxhash

        keys = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2], reverse=True):
            keys[f"{host}\0{path}".encode()] = verdict == "block"
        order = sorted(keys, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        ends = np.cumsum([0, *map(len, order)], dtype=np.int64)
        lengths = sorted({len(k.decode().partition("\0")[2]) for k in order})
        out = io.BytesIO()
        for a in (
            np.array([len(order), len(lengths)], dtype=np.int64),
            np.array([xxhash.xxh64_intdigest(k) for k in order], dtype=np.uint64),
            ends,
            np.array([keys[k] for k in order], dtype=np.int64),
            np.array(lengths, dtype=np.int64),
        ):
            out.write(a.tobytes())
        out.write(b"".join(order))
        return out.getvalue()

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        """The array of a file, read through the page cache that all tasks of a machine share."""
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, k = raw[:16].view(np.int64).tolist()
        at = np.cumsum([16, 8 * n, 8 * (n + 1), 8 * n, 8 * k])
        cut = [raw[a:b] for a, b in zip(at, at[1:])]
        return cls(cut[0].view(np.uint64), cut[1].view(np.int64), raw[at[-1] :], cut[2].view(np.int64), cut[3].view(np.int64).tolist())

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key, -1 if it is not stored."""
        import xxhash

        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        at = np.searchsorted(self.digests, h)
        out = np.full(len(keys), -1, dtype=np.int64)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, max(0, len(self.digests) - 1))] == h)) if len(self.digests) else []
        for i in hit:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == h[i]:  # keys of one digest stand together
                if self.blob[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def key(self, j: int) -> tuple[str, str]:
        host, _, path = self.blob[self.offsets[j] : self.offsets[j + 1]].tobytes().decode().partition("\0")
        return host, path


def probes(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Keys of the rules that could fit, longest first: the host and its parents with every stored length of path."""
    if not host:
        return []
    parents = [host] + [host[i + 1 :] for i, c in enumerate(host) if c == "."]
    pairs = [(p, path[:n]) for p in parents for n in lengths if n <= len(path)]
    return [f"{h}\0{p}".encode("utf-8", "surrogatepass") for h, p in sorted(pairs, key=lambda x: -len(x[0]) - len(x[1]))]


def published(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared folder and have every executor fetch it; its name for ``SparkFiles``."""
    name = f"digests-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def filtered(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host, path, verdict`` (allow or block). A rule fits its host and the hosts below it where the URL's path
    starts with the rule's; of those that fit the longest (host and path together; of equal ones that of the longer host) wins, else ``rule`` is null and the
    verdict ``otherwise``. Null URLs and those without ``://`` have an empty host and path and fit none. Rules of null host
    or path are left out. The array holds at most ``MOST_BYTES`` of rules; beyond, the same keys are joined.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict").where(F.col("host").isNotNull() & F.col("path").isNotNull())
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    if size > MOST_BYTES:
        return _joined(pages, rules, url, otherwise)
    name = published(spark, DigestArray.pack([tuple(r) for r in rules.collect()]))

    def make():
        from pyspark import SparkFiles

        array = per_process(("digests", name), lambda: DigestArray.mapped(SparkFiles.get(name)))

        def f(urls):
            parts = [split_url(u) for u in urls]
            keys = [probes(h, p, array.lengths) for h, p in parts]
            found = array.find([k for ks in keys for k in ks])
            rule, verdict, i = [None] * len(urls), [otherwise] * len(urls), 0
            for row, ks in enumerate(keys):
                hits = found[i : i + len(ks)]
                i += len(ks)
                if (hits >= 0).any():
                    j = int(hits[np.argmax(hits >= 0)])
                    rule[row], verdict[row] = "".join(array.key(j)), "block" if array.verdicts[j] else "allow"
            return [[h for h, _ in parts], [p for _, p in parts], rule, verdict]

        return f

    return add_columns(pages, url, make, [(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])


def _joined(pages: DataFrame, rules: DataFrame, url: str, otherwise: str) -> DataFrame:
    """The same decision by an equality join of distinct hosts and paths with the rules."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # as many as path lengths

    def split():
        return lambda urls: [list(c) for c in zip(*map(split_url, urls))] or [[], []]

    def keys():
        return lambda rows: [[[k.decode("utf-8", "surrogatepass") for k in probes(*(r.split("\0")), lengths)] for r in rows]]

    parted = add_columns(pages, url, split, [("host", T.StringType()), ("path", T.StringType())])
    distinct = parted.select(F.concat_ws("\0", "host", "path").alias("_both")).distinct()
    tried = add_columns(distinct, "_both", keys, [("_keys", T.ArrayType(T.StringType()))]).select("_both", F.explode("_keys").alias("_key"))
    stored = rules.groupBy(F.concat_ws("\0", "host", "path").alias("_key")).agg(F.min("verdict").alias("_verdict"))
    won = tried.join(stored, "_key").groupBy("_both").agg(F.max_by(F.struct("_key", "_verdict"), F.struct(F.length("_key"), F.length(F.substring_index("_key", "\0", 1)))).alias("_won"))
    out = parted.drop("rule", "verdict").withColumn("_both", F.concat_ws("\0", "host", "path")).join(won, "_both", "left")
    return out.withColumn("rule", F.replace(F.col("_won._key"), F.lit("\0"), F.lit(""))).withColumn("verdict", F.coalesce("_won._verdict", F.lit(otherwise))).drop("_both", "_won")


def op6_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filtered(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
