"""Approximate nearest neighbours by largest inner product: NN-descent builds a neighbour graph, queries search it greedily.

The graph starts from the neighbours within leaves of a few random-projection trees (planes are fitted on a bounded sample; every
vector is dealt to its leaves; a leaf that is too large is split on at its own medians, by other planes in each tree). Each round joins
neighbours of neighbours: the neighbours of a vector, in both directions, are compared with each other, every pair with a link that the
last round brought, and what is nearer than a vector's worst neighbour is offered to it; rounds end when few lists still change. A query
starts from its neighbours in the graph and visits the neighbours of the nearest vectors found (their lists, and the nearest vectors that
list them) until all of these have been visited; those found are ranked in double precision on the original vectors. Queries that reach too few vectors this way are compared with all, in blocks.

Candidates are compared in half precision, each vector scaled to its greatest component, whose size is kept beside it, relative to the
table's median; sizes further than 2^50 from the median count as that far, so that no product over- or underflows. The final ranks
come from the original vectors.

Vectors that are null, zero, hold a null or non-finite component, or have another length than most, take no part, neither do rows with a null
id; of rows with one id the least vector counts. Ties go to the smaller id. With fewer candidates than asked for all are
returned. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed

#: Rows of the sample that planes are fitted on.
FIT_ROWS = 16_384
TREES, LEAF, DEGREE = 8, 1024, 40
#: Rounds end when no more than this share of all list entries is new.
FEW = 0.001
#: Bytes of vectors that one task splits further; a leaf beyond is dealt to several tasks, to others in each tree.
HELD = 1 << 25
#: Neighbours that a leaf offers a vector; members in one side of a tile, where a joint neighbour has many.
OFFERED, GROUP = 24, 200
BEAM = 96
#: Vectors that a search looks at around one that it visits, besides its own list: the nearest of those that list it.
AROUND = 160
#: Sizes of vectors are told apart up to this power of two from the median.
FAR = 50

#: Queries that are compared with all vectors at once.
AT_ONCE = 1024


def usable(table: DataFrame, vec_id: str, vector: str, scratch: Scratch) -> tuple[DataFrame, float]:
    """(id, vec) of the rows that take part, where vec holds little-endian floats of the column's own precision; and the median size of their greatest components."""
    wide = "double" in dict(table.dtypes)[vector]
    v = F.col("v")
    ok = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(ok)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))

    def packed(batches):
        for b in batches:
            v = [np.array(x, "<f8" if wide else "<f4") for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([float(np.abs(x).max()) for x in v], pa.float64())], ["id", "vec", "most"])

    rows = scratch.staged(rows.mapInArrow(packed, "id long, vec binary, most double"), "vectors")
    common = rows.groupBy(F.octet_length("vec").alias("n")).agg(F.count("*").alias("count"), F.percentile_approx("most", 0.5).alias("most")).orderBy(F.desc("count"), "n").first()
    return rows.where(F.octet_length("vec") == (common["n"] if common else 0)).select("id", "vec"), common["most"] if common else 1.0


def _matrix(column, kind: str) -> np.ndarray:
    raw = column.to_pylist() if not isinstance(column, list) else column
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _sized(v: np.ndarray, middle: float) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the greatest components relative to the table's middle, within 2^-FAR and 2^FAR; vectors over their greatest component's size)."""
    v = v.astype(np.float64)
    most = np.abs(v).max(1, keepdims=True)
    return np.exp2(np.clip(np.log2(most) - np.log2(middle), -FAR, FAR)), v / most


def _single(v: np.ndarray, middle: float) -> np.ndarray:
    """Vectors relative to the table's middle, in single precision."""
    size, v = _sized(v, middle)
    return (v * size).astype(np.float32)


def _halves(v: np.ndarray, middle: float) -> list[bytes]:
    """Vectors in half precision: the greatest component's size in single precision, then components relative to it."""
    size, v = _sized(v, middle)
    return [m.tobytes() + x.tobytes() for m, x in zip(size.astype("<f4"), v.astype("<f2"), strict=True)]


def _whole(column) -> np.ndarray:
    """What _halves made, in single precision."""
    raw = _matrix(column, "<u2")
    return np.ascontiguousarray(raw[:, 2:]).view("<f2").astype(np.float32) * np.ascontiguousarray(raw[:, :2]).view("<f4")


def fit_trees(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each tree: a random direction and the sample's median along it for every inner node."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        planes = rng.standard_normal(((1 << depth) - 1, sample.shape[1])).astype(np.float32)
        cuts, node = np.zeros(len(planes), np.float32), np.zeros(len(sample), np.int64)
        for level in range(depth):
            along = np.einsum("ij,ij->i", sample, planes[node])
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                if (here := node == k).any():
                    cuts[k] = np.median(along[here])
            node = 2 * node + 1 + (along > cuts[node])
        out.append((planes, cuts))
    return out


def leaves_of(vectors: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    planes, cuts = tree
    node = np.zeros(len(vectors), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", vectors, planes[node]) > cuts[node])
    return node


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """The k best of possibly repeated ids."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first].tobytes(), scores[first].astype("<f4").tobytes()


def _grouped(batches, key: tuple[str, ...], most: int | None = None):
    """Runs of rows with one key, in batches sorted by it, as dicts of lists; runs are cut at `most` rows."""
    now, rows = None, None
    for b in batches:
        c = {n: b.column(n).to_pylist() for n in b.schema.names}
        keys = list(zip(*(c[n] for n in key), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if rows is None or now != keys[start]:
                if rows is not None:
                    yield now, rows
                now, rows = keys[start], {n: [] for n in c}
            for n in c:
                rows[n] += c[n][start:i]
            start = i
            while most and len(rows[key[0]]) >= 2 * most:
                yield now, {n: v[:most] for n, v in rows.items()}
                rows = {n: v[most:] for n, v in rows.items()}
    if rows is not None:
        yield now, rows


def _emit(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


_LIST = (["id", "nbrs", "scores"], [pa.int64(), pa.binary(), pa.binary()])
_LISTS = "id long, nbrs binary, scores binary"


def halved(v: np.ndarray, most: int, seed) -> list[np.ndarray]:
    """Rows of v in parts of at most `most`: halves at the median along random directions, equal vectors dealt by lot."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(v))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        along = v[rows] @ rng.standard_normal(v.shape[1]).astype(np.float32)
        rows = rows[np.lexsort((rng.random(len(rows)), along))]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def _in_leaves(kind: str, leaf: int, middle: float):
    def run(batches):
        for key, rows in _grouped(batches, ("tree", "leaf", "part")):
            all_ids, vectors = np.array(rows["id"], np.int64), _single(_matrix(rows["vec"], kind), middle)
            for part in halved(vectors, 2 * leaf, key):
                ids, v = all_ids[part], vectors[part]
                if len(ids) < 2:
                    continue
                s = v @ v.T
                np.fill_diagonal(s, -np.inf)
                k = min(OFFERED, len(ids) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(s, top, 1)
                yield _emit([(int(i), ids[t].tobytes(), n.astype("<f4").tobytes()) for i, t, n in zip(ids, top, near, strict=True)], *_LIST)

    return run


def _merged(k: int):
    def run(batches):
        out = []
        for (i,), rows in _grouped(batches, ("id",)):
            out.append((i, *_best(np.frombuffer(b"".join(rows["nbrs"]), "<i8"), np.frombuffer(b"".join(rows["scores"]), "<f4"), k)))
            if len(out) >= 2000:
                yield _emit(out, *_LIST)
                out = []
        yield _emit(out, *_LIST)

    return run


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the k best for each id."""
    return lists.repartition("id").sortWithinPartitions("id").select("id", "nbrs", "scores").mapInArrow(_merged(k), _LISTS)


def _graph(k: int):
    """The k best of each id, with a flag for each that is not in the id's own list."""

    def run(batches):
        out = []
        for (i,), rows in _grouped(batches, ("id",)):
            nbrs, scores = _best(np.frombuffer(b"".join(rows["nbrs"]), "<i8"), np.frombuffer(b"".join(rows["scores"]), "<f4"), k)
            own = np.frombuffer(b"".join(x for x, o in zip(rows["nbrs"], rows["own"], strict=True) if o), "<i8")
            new = ~np.isin(np.frombuffer(nbrs, "<i8"), own)
            out.append((i, nbrs, scores, new.tobytes(), int(new.sum())))
            if len(out) >= 2000:
                yield _emit(out, *_GRAPH)
                out = []
        yield _emit(out, *_GRAPH)

    return run


_GRAPH = (["id", "nbrs", "scores", "new", "n_new"], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()])


def as_graph(found: DataFrame, k: int, scratch: Scratch, own: DataFrame | None = None) -> DataFrame:
    """The lists found merged with each id's own."""
    lists = found.select("id", "nbrs", "scores", F.lit(False).alias("own"))
    if own is not None:
        lists = lists.union(own.select("id", "nbrs", "scores", F.lit(True)))
    return scratch.staged(lists.repartition("id").sortWithinPartitions("id").mapInArrow(_graph(k), f"{_LISTS}, new binary, n_new int"), "graph")


def _links(batches):
    """Links (pivot, member) in both directions; new if the last round brought them."""
    for b in batches:
        ids, nbrs = b.column("id").to_pylist(), [np.frombuffer(x, "<i8") for x in b.column("nbrs").to_pylist()]
        own = np.repeat(np.array(ids, np.int64), [len(x) for x in nbrs])
        other = np.concatenate(nbrs) if nbrs else np.zeros(0, np.int64)
        new = np.frombuffer(b"".join(b.column("new").to_pylist()), bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, other]), pa.array(np.r_[other, own]), pa.array(np.r_[new, new])], ["pivot", "member", "new"])


def _scored_links(batches):
    """Links (pivot, member, score) in both directions; own is true for those of the pivot's list."""
    for b in batches:
        ids, nbrs = b.column("id").to_pylist(), [np.frombuffer(x, "<i8") for x in b.column("nbrs").to_pylist()]
        own = np.repeat(np.array(ids, np.int64), [len(x) for x in nbrs])
        other = np.concatenate(nbrs) if nbrs else np.zeros(0, np.int64)
        score = np.frombuffer(b"".join(b.column("scores").to_pylist()), "<f4")
        mine = np.r_[np.ones(len(own), bool), np.zeros(len(own), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, other]), pa.array(np.r_[other, own]), pa.array(np.r_[score, score]), pa.array(mine)], ["pivot", "member", "score", "own"])


def search_links(graph: DataFrame, around: int = AROUND) -> DataFrame:
    """(pivot, member): each list, and the nearest vectors that list it, so that a search that visits a hub doesn't look at all that do."""
    rows = graph.select("id", "nbrs", "scores").mapInArrow(_scored_links, "pivot long, member long, score float, own boolean")
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("score"), "member"))
    near = rows.where("not own").withColumn("rank", rank).where(F.col("rank") <= around).select("pivot", "member")
    return rows.where("own").select("pivot", "member").union(near).distinct()


def links(graph: DataFrame) -> DataFrame:
    rows = graph.select("id", "nbrs", "new").mapInArrow(_links, "pivot long, member long, new boolean")
    return rows.repartition("pivot").groupBy("pivot", "member").agg(F.max("new").alias("new"))


def tiled(around: DataFrame) -> DataFrame:
    """Links of pivots that have a new one, in tiles: (pivot, tile, side, member, new). Members are dealt to groups of about GROUP; tile i, j
    holds groups i (side 0) and j (side 1), so that all pairs of members meet, each in one tile."""
    of = Window.partitionBy("pivot")
    rows = around.withColumn("n", F.count("*").over(of)).withColumn("any", F.max("new").over(of)).where("any")
    groups = F.when(F.col("n") < 2 * GROUP, 1).otherwise(F.ceil(F.col("n") / GROUP)).cast("long")
    rows = rows.withColumn("groups", groups).withColumn("own", F.pmod(F.xxhash64("member"), F.col("groups")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    tile = F.least("own", "other") * F.col("groups") + F.greatest("own", "other")
    return rows.select("pivot", tile.alias("tile"), (F.col("own") > F.col("other")).alias("side"), "member", "new")


def _joined(batches):
    """The members in each tile compared with each other: pairs of which a link is new, across the sides if there are two."""
    out, held = [], 0
    for _, rows in _grouped(batches, ("pivot", "tile")):
        ids, v = np.array(rows["member"], np.int64), _whole(rows["vec"])
        new, side = np.array(rows["new"], bool), np.array(rows["side"], bool)
        if len(ids) < 2 or not new.any():
            continue
        s = v @ v.T
        better = (s > np.array(rows["worst"], np.float32)[:, None]) & (new[:, None] | new)
        if side.any():
            better &= side[:, None] != side
        np.fill_diagonal(better, False)
        for n in np.flatnonzero(better.any(1)):
            out.append((int(ids[n]), ids[better[n]].tobytes(), s[n][better[n]].astype("<f4").tobytes()))
            held += len(out[-1][1])
        if len(out) >= 5000 or held > 1 << 22:
            yield _emit(out, *_LIST)
            out, held = [], 0
    yield _emit(out, *_LIST)


def _small(kind: str, middle: float):
    """Vectors in half precision, for comparing candidates; with the worst score of each vector's list."""

    def run(batches):
        for b in batches:
            worst = [float(np.frombuffer(s, "<f4")[-1]) if s else -np.inf for s in b.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_halves(_matrix(b.column("vec"), kind), middle), pa.binary()), pa.array(worst, pa.float32())], ["member", "vec", "worst"])

    return run


def neighbour_graph(vectors: DataFrame, kind: str, scratch: Scratch, middle: float = 1.0, degree: int = DEGREE, trees: int = TREES, rounds: int | None = None, leaf: int = LEAF, fit_rows: int = FIT_ROWS, held: int = HELD) -> DataFrame:
    """(id, nbrs, scores): the best neighbours found for each vector. vectors: (id, vec). Rounds go on until few entries are new, or as many as told."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").toArrow().column("vec").to_pylist()
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(max(1, len(sample) / 16)))))
    fitted = fit_trees(_single(_matrix(sample, kind), middle), depth, trees) if sample else []

    def dealt(batches):
        for b in batches:
            v = _single(_matrix(b.column("vec"), kind), middle)
            for t, tree in enumerate(fitted):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(leaves_of(v, tree, depth)), b.column("id"), b.column("vec")], ["tree", "leaf", "id", "vec"])

    rows = vectors.mapInArrow(dealt, "tree int, leaf long, id long, vec binary")
    sizes = scratch.staged(vectors.mapInArrow(dealt, "tree int, leaf long, id long, vec binary").groupBy("tree", "leaf").count(), "leaves")
    # A leaf larger than a task can hold (many equal vectors) is dealt to several tasks; the tree is hashed too, so that two vectors apart in one tree can meet in another.
    together = max(2 * leaf, held // len(sample[0])) if sample else 1
    parts = F.greatest(F.lit(1), F.ceil(F.col("count") / together))
    rows = rows.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("tree", "id"), parts).cast("int")).select("tree", "leaf", "part", "id", "vec")
    rows = rows.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part")
    graph, done = as_graph(rows.mapInArrow(_in_leaves(kind, leaf, middle), _LISTS), degree, scratch), 0
    while done != rounds:
        before, graph, done = graph, joined(vectors, graph, kind, degree, scratch, middle), done + 1
        scratch.drop(before)
        if rounds is None and (graph.agg(F.sum("n_new")).first()[0] or 0) <= FEW * n * degree:
            break
    return graph


def joined(vectors: DataFrame, graph: DataFrame, kind: str, degree: int, scratch: Scratch, middle: float = 1.0) -> DataFrame:
    """The graph after one more round."""
    small = vectors.join(graph.select("id", "scores", F.octet_length("nbrs").alias("n")), "id", "left")
    full = F.coalesce(F.col("n") >= 8 * degree, F.lit(False))
    small = small.select("id", "vec", F.when(full, F.col("scores")).otherwise(F.lit(b"")).alias("scores")).mapInArrow(_small(kind, middle), "member long, vec binary, worst float")
    around = tiled(links(graph)).join(small, "member").repartition("pivot", "tile").sortWithinPartitions("pivot", "tile")
    return as_graph(around.select("pivot", "tile", "side", "member", "new", "vec", "worst").mapInArrow(_joined, _LISTS), degree, scratch, graph)


def _visited(beam: int):
    """Candidates of each query scored; its own vector comes first, as candidate null."""

    def run(batches):
        out = []
        for (q,), rows in _grouped(batches, ("query",)):
            v = _whole(rows["vec"])
            ids = np.array(rows["candidate"][1:], np.int64)
            if rows["candidate"][0] is not None or not len(ids):
                continue
            out.append((q, *_best(ids, v[1:] @ v[0], beam)))
            if len(out) >= 1000:
                yield _emit(out, *_LIST)
                out = []
        yield _emit(out, *_LIST)

    return run


def _exploded(batches):
    for b in batches:
        nbrs = [np.frombuffer(x, "<i8") for x in b.column("nbrs").to_pylist()]
        own = np.repeat(np.array(b.column("id").to_pylist(), np.int64), [len(x) for x in nbrs])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(nbrs) if nbrs else np.zeros(0, np.int64))], ["query", "node"])


def _ranked(k: int, kind: str):
    def run(batches):
        for (q,), rows in _grouped(batches, ("query",)):
            v = _matrix(rows["vec"], kind).astype(np.float64)
            ids = np.array(rows["candidate"][1:], np.int64)
            scores = (v[1:] * v[0]).sum(1)
            order = np.lexsort((ids, -scores))[:k]
            yield _emit([(q, r + 1, int(ids[j]), float(scores[j])) for r, j in enumerate(order)], ["query_id", "rank", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.float64()])

    return run


def searched(vectors: DataFrame, graph: DataFrame, queries: DataFrame, kind: str, scratch: Scratch, middle: float = 1.0, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score. queries: (id), of vectors in the graph."""

    def half(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_halves(_matrix(b.column("vec"), kind), middle), pa.binary())], ["id", "vec"])

    def with_vectors(pairs: DataFrame, of: DataFrame) -> DataFrame:
        own = queries.join(of, "id").select(F.col("id").alias("query"), F.lit(None).cast("long").alias("candidate"), "vec")
        rows = pairs.join(of, pairs["node"] == of["id"]).select("query", F.col("node").alias("candidate"), "vec")
        return rows.union(own).repartition("query").sortWithinPartitions("query", F.asc_nulls_first("candidate"))

    light = scratch.staged(vectors.mapInArrow(half, "id long, vec binary"), "half")
    around = scratch.staged(search_links(graph), "links")
    best = graph.select("id", "nbrs", "scores").join(queries, "id", "left_semi")
    opened = None
    while True:
        front = best.select("id", "nbrs").mapInArrow(_exploded, "query long, node long")
        if opened is not None:
            front = front.join(opened, ["query", "node"], "left_anti")
        front = scratch.staged(front, "front")
        if front.isEmpty():
            break
        new = front.join(around, front["node"] == around["pivot"]).select("query", F.col("member").alias("node")).where("query <> node").distinct()
        found = with_vectors(new, light).mapInArrow(_visited(beam), _LISTS)
        best = scratch.staged(merged(best.union(found), beam), "best")
        opened = front if opened is None else scratch.staged(opened.union(front), "opened")
    pairs = best.select("id", "nbrs").mapInArrow(_exploded, "query long, node long")
    ranked = scratch.staged(with_vectors(pairs, vectors).mapInArrow(_ranked(k, kind), "query_id long, rank int, vec_id long, score double"), "ranked")
    whole = min(k, vectors.count() - 1)
    enough = ranked.groupBy("query_id").count().where(F.col("count") >= whole).select(F.col("query_id").alias("id"))
    short = scratch.staged(queries.join(enough, "id", "left_anti"), "short")
    if whole < 1 or short.isEmpty():
        return ranked
    return ranked.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(compared_with_all(vectors, short, kind, k))


def compared_with_all(vectors: DataFrame, queries: DataFrame, kind: str, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other vectors for each of few queries (id), which are taken AT_ONCE at a time."""
    out, last = None, None
    while True:
        todo = vectors.join(queries, "id", "left_semi")
        todo = (todo if last is None else todo.where(F.col("id") > last)).orderBy("id").limit(AT_ONCE).toArrow()
        if not len(todo):
            return out
        own, ids = _matrix(todo.column("vec").combine_chunks(), kind).astype(np.float64), np.array(todo.column("id").to_pylist(), np.int64)
        last = int(ids[-1])

        def scored(batches, own=own, ids=ids):
            for b in batches:
                v, others = _matrix(b.column("vec"), kind).astype(np.float64), b.column("id").to_numpy()
                rows = []
                for q, x in zip(ids.tolist(), own, strict=True):
                    s = (v * x).sum(1)
                    order = np.lexsort((others, -s))[: k + 1]
                    rows += [(q, int(others[j]), float(s[j])) for j in order if others[j] != q][:k]
                yield _emit(rows, ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()])

        found = vectors.mapInArrow(scored, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.union(found)


def nearest(table: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """The k nearest found of each row that is_query (a column over `id`) marks, among all other rows."""
    kind = "<f8" if "double" in dict(table.dtypes)[vector] else "<f4"
    with Scratch(table.sparkSession, "neighbours") as scratch:
        vectors, middle = usable(table, vec_id, vector, scratch)
        graph = neighbour_graph(vectors, kind, scratch, middle)
        queries = scratch.staged(vectors.select("id").where(is_query), "queries")
        return checkpointed(searched(vectors, graph, queries, kind, scratch, middle, k))
