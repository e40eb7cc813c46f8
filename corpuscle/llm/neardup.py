"""MinHash near-dedup by BagMinHash: weighted signatures from hierarchical Poisson processes, banding, verified multiset overlap.

Items of a document's bag are its shingles of five words (lower case, split at white space), weighted by their counts. The
weight axis of an item is discretised into [0,1), [1,2), [2,4), [4,8) ..., each with a Poisson process of rate m times its width
whose first point is known; an interval that lies partly beyond the weight, or whose first point was used, is split in halves:
one inherits the point, the other draws a later one. Only intervals whose first point is below the document's limit are split,
so an item costs little however large its weight. Component i of the signature is the least time of a point of component i;
two documents agree in it with the probability of their weighted Jaccard similarity.

Documents of fewer than five words have one shingle of all their words. Texts that are null, empty or of white space alike form
one class. Copies (equal words) form a class and are signed once. doc_id may be null or repeat: groups are formed by text; the
least non-null doc_id names a class and a group, and a group without any has a null name. Other columns pass through, whatever their
names. Texts are compared whole, however long. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed, small_side
from corpuscle.llm.linkage import Seen, bag_jaccard, linked_groups
from corpuscle.llm.worker import release

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
#: Bytes of text that are hashed at once.
BLOCK = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _exponential(seed: np.ndarray, salt: int) -> np.ndarray:
    u = (mixed(seed + np.uint64(salt * int(_MULT) % 2**64)) >> np.uint64(11)).astype(np.float64)
    return -np.log((u + 1.0) * 2.0**-53)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULT)
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, by doubling."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _POWERS[name] = p[:n]
    return _POWERS["up"], _POWERS["down"]


def _word_hashes(text: bytes) -> np.ndarray:
    """Of words parted by single spaces or newlines; hashes don't depend on the place."""
    b = np.frombuffer(text, np.uint8)
    up, down = _powers(len(b) + 1)
    gaps = np.flatnonzero((b == 32) | (b == 10))
    start, end = np.r_[0, gaps + 1], np.r_[gaps, len(b)]
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)]
    return mixed((sums[end] - sums[start]) * down[start])


def shingle_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of normalised, non-empty texts, by document."""
    wh = _word_hashes("\n".join(texts).encode())
    sizes = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - SHINGLE + 1, 1)
    doc = np.repeat(np.arange(len(texts)), windows)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    last = (first + sizes - 1)[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        inside = at + k <= last
        h = mixed(h * _MULT + np.where(inside, wh[np.minimum(at + k, last)], np.uint64(k)))
    own = mixed(h + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))  # equal only for the same shingle of the same document
    order = np.argsort(own, kind="stable")
    s = own[order]
    new = np.r_[True, s[1:] != s[:-1]]
    count = np.diff(np.r_[np.flatnonzero(new), len(s)])
    one = order[new]
    back = np.argsort(one, kind="stable")
    one, count = one[back], count[back]
    return doc[one], h[one], count


def bag_signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n signatures of m times of points. doc: ascending, 0 to n-1; item: hashes; weight: counts of 1 or more."""
    out = np.full(n * m, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n)
    limit = np.where(total > 0, (np.log(m) + 4.0) / np.maximum(total, 1), -1.0)
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    todo = np.ones(n, bool)
    while True:
        of = np.flatnonzero(todo[doc])
        part = np.repeat(of, levels[of])
        level = np.arange(len(part)) - np.repeat(np.cumsum(levels[of]) - levels[of], levels[of])
        low = np.where(level > 0, np.left_shift(1, np.maximum(level - 1, 0)), 0)
        width = np.maximum(low, 1)
        seed = mixed(item[part] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        d, w = doc[part], weight[part]
        x = _exponential(seed, 1) / (width * float(m))
        step = 2
        while len(d):
            live = (x <= limit[d]) & (low < w)
            d, w, low, width, seed, x = d[live], w[live], low[live], width[live], seed[live], x[live]
            if not len(d):
                break
            leaf = width == 1
            if leaf.any():
                ld, ls, lx = d[leaf], seed[leaf], x[leaf]
                np.minimum.at(out, ld * m + (mixed(ls + np.uint64(7)) % np.uint64(m)).astype(np.int64), lx)
                ns = mixed(ls + np.uint64(11))  # the leaf's next point
                nxt = (ld, w[leaf], low[leaf], width[leaf], ns, lx + _exponential(ns, 2) / m)
            if not leaf.all():
                k = ~leaf
                half, heir = width[k] // 2, (mixed(seed[k] + np.uint64(3)) & np.uint64(1)).astype(bool)  # whether the upper half inherits the point
                drawn = x[k] + _exponential(mixed(seed[k] + np.uint64(5)), 3) / (half * float(m))
                halves = [(d[k], w[k], low[k] + up * half, half, mixed(seed[k] + np.uint64(13 + up)), np.where(heir == up, x[k], drawn)) for up in (False, True)]
                parts = [*([nxt] if leaf.any() else []), *halves]
                d, w, low, width, seed, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            else:
                d, w, low, width, seed, x = nxt
            step += 1
        todo = ~np.isfinite(out.reshape(n, m)).all(1) & (total > 0)
        if not todo.any():
            return out.reshape(n, m)
        out.reshape(n, m)[todo] = np.inf
        limit[todo] *= 2


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MULT, bits.shape[:2])
    for r in range(rows):
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + bits[:, :, r])
    return h.view(np.int64)


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def blocks(texts: list[str], size: int = BLOCK):
    """Runs of texts of about so many characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _signed(bands: int, rows: int):
    def run(batches):
        release()
        for b in batches:
            texts = [normalised(t) for t in b.column("text").to_pylist()]
            nodes = [xxhash.xxh3_128_digest(t) for t in texts]
            keys = np.zeros((len(texts), bands), np.int64)
            for i, j in blocks(texts):
                some = [k for k in range(i, j) if texts[k]]
                if some:
                    doc, item, weight = shingle_bags([texts[k] for k in some])
                    keys[some] = band_keys(bag_signatures(doc, item, weight, len(some), bands * rows), bands, rows)
            ids = np.frombuffer(b"".join(nodes), ">i8")[::2].astype(np.int64)
            lists = pa.array([k.tobytes() if t else b"" for t, k in zip(texts, keys, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(nodes, pa.binary()), pa.array(ids), lists], ["doc_id", "row", "node", "id", "keys"])

    return run


def _bag(text: str) -> tuple[dict, int]:
    words = text.split(" ") if text else []
    k = min(SHINGLE, len(words))
    bag = Counter(zip(*(words[i:] for i in range(k)), strict=False)) if k else Counter()
    return bag, sum(bag.values())


def _named(out):
    def run(batches):
        seen = Seen()
        for b in batches:
            columns = {n: b.column(n).to_pylist() for n in ("id", "r", "text", "heads", "salts")}
            rows = [x for x in zip(*columns.values(), strict=True) if not seen.again(x[:2])]
            texts = [normalised(t) for _, _, t, _, _ in rows]
            yield out([x[0] for x in rows], [xxhash.xxh3_128_digest(t) for t in texts], texts, [x[3] for x in rows], [x[4] for x in rows])

    return run


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, row (a hash of doc_id and text), class_id, class_size, group_id, group_size, kept.

    class_id is the least doc_id with the same words, group_id the least of all texts linked by a similarity of threshold or more, directly or by way of others.
    """
    keyed = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    with Scratch(docs.sparkSession, "near") as scratch:
        signed = scratch.staged(keyed.mapInArrow(_signed(bands, rows), "doc_id long, row long, node binary, id long, keys binary"), "signed")
        classes = scratch.staged(signed.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.first("id").alias("id"), F.first("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("at")), "classes")

        def fetch(wanted: DataFrame, out, schema: str) -> DataFrame:
            at = classes.select("id", "at").join(wanted, "id").select("id", F.col("at.doc_id").alias("d"), F.col("at.row").alias("r"), "heads", "salts")
            at = small_side(scratch.staged(at, "at"))
            found = keyed.join(at, keyed["doc_id"].eqNullSafe(F.col("d")) & (keyed["row"] == F.col("r")))
            return found.select("id", "r", "text", "heads", "salts").mapInArrow(_named(out), schema)

        groups = linked_groups(classes, fetch, _bag, bag_jaccard, threshold, scratch)
        named = classes.select("node", "class_id", "class_size", "at").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = scratch.staged(named, "named")
        heads = named.groupBy("root").agg(F.min("class_id").alias("group_id"), F.sum("class_size").alias("group_size"), F.min("at").alias("first")).where("group_size > 1")
        several = scratch.staged(named.join(small_side(scratch.staged(heads, "heads")), "root").select("node", "class_id", "class_size", "group_id", "group_size", "first"), "several")
        found = signed.select("doc_id", "row", "node").join(small_side(several), "node", "left")
        alone, own, one = F.col("group_size").isNull(), F.col("doc_id"), F.lit(1).cast("long")
        kept = alone | (own.eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))
        filled = [F.when(alone, own if c.endswith("id") else one).otherwise(F.col(c)).alias(c) for c in ("class_id", "class_size", "group_id", "group_size")]
        return checkpointed(found.select("doc_id", "row", *filled, kept.alias("kept")))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group: the first by doc_id (nulls last, then by a hash of the row); of rows equal in doc_id and text one stays."""
    g = near_groups(docs, threshold).where("group_size > 1").select("doc_id", "row", "kept")
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row"))  # a struct, so that no name can clash

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = small_side(checkpointed(keys.select(F.col("doc_id").alias("d"), F.col("row").alias("r"))))
        return rows.join(keys, rows["doc.doc_id"].eqNullSafe(F.col("d")) & (rows["row"] == F.col("r")), how)

    rest = among(keyed, g.where("not kept").distinct(), "left_anti")
    repeated = g.where("kept").groupBy("doc_id", "row").count().where("count > 1")
    once = among(rest, repeated, "left_semi").select("doc", "row", F.col("doc.doc_id").alias("id")).dropDuplicates(["id", "row"]).select("doc", "row")
    return among(rest, repeated, "left_anti").unionByName(once).select("doc.*")
