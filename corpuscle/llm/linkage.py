"""From band keys to groups of near-duplicates: candidates, exact verification, components.

Items that share a band key form a bucket. A task links the items of a key in a block of rows to the least of them, the key's head in
that block, and these links are written as they are: only heads are shuffled by key, so a hot bucket sends one pair per block. Heads are linked
to the bucket's least item, each link is verified exactly, and components are formed. Where a bucket still holds several components, its items from
different components are compared too, in tiles, while a bucket of thousands of alike items costs one pair for each. No task gathers a bucket's items. In a tile
a pair is passed over if the estimate by 64 MinHash values lies more than SLACK standard deviations under the threshold, which
loses a link in about one of three million at the threshold, and fewer above; all others are verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, small_side
from corpuscle.llm.components import components
from corpuscle.llm.worker import release

#: Items of one head that a task compares with it.
ITEMS = 1000
#: Keys that a task links among themselves before it sends on the least item of each.
STAR_KEYS = 1_000_000
#: Items on each side of a tile, the unit in which the rest of a bucket is compared.
TILE = 200
#: Pairs with an estimated similarity so far below the threshold, in standard deviations of the estimate, are not compared in a tile.
SLACK = 5.0


def _least(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the least id of its key; equal keys stand together."""
    first = np.r_[True, keys[1:] != keys[:-1]]
    return np.minimum.reduceat(ids, np.flatnonzero(first))[np.cumsum(first) - 1]


def _blocks(parts: int):
    """Of (id, keys): for each of `parts` parts of the keys a block of (key, id) of the least id of each key among so many rows, its head, and one
    of (key, id, head) of the other ids."""

    def block(rows):
        flat, ids = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(flat)
        flat, ids = flat[order], ids[order]
        head = _least(flat, ids)
        part = (flat.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        flat, ids, head, part = flat[order], ids[order], head[order], part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        blocks, others = [], head != ids
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            o = others[i:j]
            blocks.append((np.stack([flat[i:j][~o], ids[i:j][~o]], 1).tobytes(), np.stack([flat[i:j][o], ids[i:j][o], head[i:j][o]], 1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), *(pa.array([x[k] for x in blocks], pa.binary()) for k in (0, 1))], ["part", "heads", "others"])

    def run(batches):
        rows, n = [], 0
        for b in batches:
            keys = b.column("keys").to_pylist()
            flat = np.frombuffer(b"".join(keys), "<i8")
            if len(flat):
                rows.append((flat, np.repeat(b.column("id").to_numpy(zero_copy_only=False), [len(k) // 8 for k in keys])))
                n += len(flat)
            if n >= STAR_KEYS:
                yield block(rows)
                rows, n = [], 0
        if rows:
            yield block(rows)

    return run


_LINKS = ["key", "a", "b"]


def _own_links(batches):
    """Links (key, a, b) of the ids of each block to their heads, as the blocks hold them."""
    for b in batches:
        for raw in b.column("others").to_pylist():
            rows = np.frombuffer(raw, np.int64).reshape(-1, 3)
            for i in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[i : i + 100_000].T], _LINKS)


def _starred(batches):
    """Links (key, a, b) of a part's heads to the least of their key. A task holds 16 bytes for each of its heads."""
    heads = [np.frombuffer(x, np.int64).reshape(-1, 2) for b in batches for x in b.column("heads").to_pylist()]
    if not heads:
        return
    rows = np.concatenate(heads)
    del heads
    rows = rows[np.argsort(rows[:, 0])]
    key, ids = np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1])
    least = _least(key, ids)
    keep = np.flatnonzero(ids != least)
    for i in range(0, len(keep), 100_000):
        k = keep[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(ids[k]), pa.array(least[k])], _LINKS)


class Seen:
    """Which rows a task has seen lately, so that rows that repeat many times aren't sent on as often."""

    def __init__(self, most: int = 100_000):
        self.rows: set = set()
        self.most = most

    def again(self, row) -> bool:
        if row in self.rows:
            return True
        if len(self.rows) >= self.most:
            self.rows.clear()
        self.rows.add(row)
        return False


def spread(ids: list, nodes: list, texts: list, heads: list, salts: list) -> pa.RecordBatch:
    """A row for each head that an item is compared with; first is true where the item is the head."""
    rows = [(h, s, h == i, i, n, t) for i, n, t, hs, ss in zip(ids, nodes, texts, heads, salts, strict=True) for h, s in zip(hs, ss, strict=True)]
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["head", "salt", "first", "id", "node", "text"])


SPREAD = "head long, salt int, first boolean, id long, node binary, text string"


def plain(ids: list, nodes: list, texts: list, heads: list, salts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(texts, pa.string())], ["id", "node", "text"])


PLAIN = "id long, node binary, text string"


def _verified(similarity: Callable, threshold: float, feature: Callable):
    """Of rows sorted by head and salt, heads first: each item compared with its head (with all heads, if nodes share an id)."""

    def run(batches):
        release()
        now, heads = None, []
        for b in batches:
            out = []
            for h, s, first, i, node, text in zip(*(b.column(n).to_pylist() for n in ("head", "salt", "first", "id", "node", "text")), strict=True):
                if now != (h, s):
                    now, heads = (h, s), []
                own = feature(text)
                out += [(i, h, node, n, similarity(own, f, threshold)) for n, f in heads if n != node]
                if first and all(n != node for n, _ in heads):
                    heads.append((node, own))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], ["a", "b", "na", "nb", "sim"])

    return run


def set_jaccard(x: frozenset, y: frozenset, threshold: float) -> float:
    """Shared share of two sets; 0 where their sizes alone rule the threshold out. Two empty sets are alike."""
    low, high = sorted((len(x), len(y)))
    if not high:
        return 1.0
    if low < threshold * high:
        return 0.0
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def bag_jaccard(x: tuple[dict, int], y: tuple[dict, int], threshold: float) -> float:
    """Sum of the least over the sum of the greatest counts; each bag comes with its total. 0 where the totals alone rule the threshold out."""
    (p, n), (q, m) = x, y
    if not max(n, m):
        return 1.0
    if min(n, m) < threshold * max(n, m):
        return 0.0
    if len(p) > len(q):
        p, q = q, p
    both = sum(min(k, q[s]) for s, k in p.items() if s in q)
    return both / (n + m - both)


def linked_groups(banded: DataFrame, fetch: Callable[[DataFrame, Callable, str], DataFrame], feature: Callable, similarity: Callable, threshold: float, scratch: Scratch, sketch: Callable | None = None) -> DataFrame:
    """(node, root) for all items of groups of two or more but the roots.

    banded: id long (a hash that items may share), keys binary (little-endian 64-bit band keys, one behind another). fetch(wanted, out,
    schema), where wanted is a table (id, heads, salts): the batches that out makes of lists of ids, nodes, texts, heads and salts of the
    items with those ids. feature(text) and similarity(feature, feature, threshold) verify a pair; sketch(texts): MinHash values of
    texts, a row each, by which pairs in tiles are passed over that are far from the threshold.
    """
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.staged(banded.select("id", "keys").mapInArrow(_blocks(parts), "part long, heads binary, others binary"), "blocks")
    star = "key long, a long, b long"
    of_heads = blocks.select("part", "heads").repartition("part").select("heads").mapInArrow(_starred, star)
    stars = scratch.staged(of_heads.union(blocks.select("others").mapInArrow(_own_links, star)), "stars")
    scratch.drop(blocks)
    pairs = scratch.staged(stars.select("a", "b").distinct(), "pairs")
    # A text goes once to each head that it is compared with; the items of a head of many are dealt to several tasks.
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("shares"))
    items = pairs.join(small_side(scratch.staged(shares.where("shares > 1"), "shares")), "b", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    rows = items.select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("salt"))
    rows = rows.union(shares.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt")))
    wanted = rows.groupBy("id").agg(F.collect_list(F.struct("b", "salt")).alias("to")).select("id", F.col("to.b").alias("heads"), F.col("to.salt").alias("salts"))
    texts = fetch(scratch.staged(wanted, "wanted"), spread, SPREAD).repartition("head", "salt").sortWithinPartitions("head", "salt", F.desc("first"))
    tried = scratch.staged(texts.mapInArrow(_verified(similarity, threshold, feature), "a long, b long, na binary, nb binary, sim double"), "tried")
    scratch.drop(pairs)
    groups = components(tried.where(F.col("sim") >= threshold).select(F.col("na").alias("a"), F.col("nb").alias("b")), scratch)
    missed = tried.where(F.col("sim") < threshold)
    if missed.isEmpty():
        return groups
    nodes = tried.select(F.col("a").alias("id"), F.col("na").alias("node")).union(tried.select(F.col("b").alias("id"), F.col("nb").alias("node"))).distinct()
    named = scratch.staged(nodes.join(groups, "node", "left").select("id", F.coalesce("root", "node").alias("root"), "node"), "named")
    apart = missed.select("a", "b").join(named.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(named.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
    keys = scratch.staged(stars.join(apart.select("a", "b").distinct(), ["a", "b"], "left_semi").select("key").distinct(), "keys")
    scratch.drop(tried)
    of_key = stars.join(small_side(keys), "key", "left_semi")
    members = scratch.staged(of_key.select("key", F.col("a").alias("id")).union(of_key.select("key", F.col("b").alias("id"))).distinct().join(named, "id"), "members")
    scratch.drop(stars, named)
    main = members.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("of_main"))
    main = scratch.staged(main.where("n > 2").withColumn("s", F.col("n") - F.col("of_main")), "main")  # the one pair of a bucket of two was tried
    members = scratch.staged(members.join(small_side(main), "key").select("key", "id", "node", "root", (F.col("root") != F.col("main")).alias("side"), "n", "s"), "members")
    none = F.array().cast("array<long>")
    texts = scratch.staged(fetch(scratch.staged(members.select("id").distinct().select("id", none.alias("heads"), none.alias("salts")), "wanted"), plain, PLAIN), "texts")
    # Each item outside a bucket's main component meets all others of the bucket, tile by tile; only links come out.
    count = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    mine = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), count(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    rows = members.where("side").select("key", mine("s", 1).alias("i"), every("n").alias("j"), F.lit(True).alias("left"), "id", "node", "root", "side")
    rows = rows.union(members.select("key", every("s").alias("i"), mine("n", 2).alias("j"), F.lit(False).alias("left"), "id", "node", "root", "side"))
    shared = members.groupBy("id").agg(F.collect_set("key").alias("keys"))  # at most as many as there are bands
    tiles = rows.join(shared, "id").join(texts.select("node", "text").dropDuplicates(["node"]), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "left")
    more = scratch.staged(tiles.select("key", "i", "j", "left", "id", "node", "root", "side", "keys", "text").mapInArrow(_tiled(similarity, threshold, feature, sketch), "a binary, b binary"), "more")
    return groups if more.isEmpty() else components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch)


def _tiled(similarity: Callable, threshold: float, feature: Callable, sketch: Callable | None):
    """Links within tiles. A pair is compared in one of the buckets that it shares, and not at all if it was linked before."""

    def near(left: list, right: list) -> np.ndarray | None:
        """Which pairs may reach the threshold by the estimate of their sketches."""
        if sketch is None:
            return None
        x, y = (np.stack([item[-1] for item in side]) for side in (left, right))
        m = x.shape[1]
        least = threshold * m - SLACK * (threshold * (1 - threshold) * m) ** 0.5
        return np.stack([(row == y).sum(1) >= least for row in x])

    def links(right: list, left: list):
        if not left or not right:
            return
        features: dict = {}

        def of(node, text):
            if node not in features:
                features[node] = feature(text)
            return features[node]

        may = near(left, right)
        for at, (key, u, nu, ru, _, ku, tu, _) in enumerate(left):
            met = {ru}
            for k in range(len(right)) if may is None else np.flatnonzero(may[at]).tolist():
                _, v, nv, rv, sv, kv, tv, _ = right[k]
                if rv not in met and (not sv or u < v) and min(ku & kv) == key and similarity(of(nu, tu), of(nv, tv), threshold) >= threshold:
                    met.add(rv)
                    yield nu, nv

    def run(batches):
        release()
        now, right, left = None, [], []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            found = []
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            c["sketch"] = sketch(c["text"]) if sketch and c["text"] else [None] * b.num_rows  # of all rows at once
            for key, i, j, is_left, *item in zip(*(c[n] for n in ("key", "i", "j", "left", "id", "node", "root", "side", "keys", "text", "sketch")), strict=True):
                if now != (key, i, j):
                    found += links(right, left)
                    now, right, left = (key, i, j), [], []
                item[4] = frozenset(item[4])
                (left if is_left else right).append((key, *item))
            yield out(found)
        yield out(list(links(right, left)))

    return run
