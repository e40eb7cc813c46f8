"""Token-id output: a content-addressed store of id streams.

A document's ids (with its end id) are cut where a rolling hash of the last WINDOW ids hits a mask, so that equal passages give
equal chunks. A chunk is named by the SHA-256 of its ids as little-endian 32-bit integers; each is written once, compressed, to
chunks/. recipes/ holds, in ascending doc_id order (nulls first), each document's chunk names, lengths, part, start inside its part
and Merkle root; manifest/ holds a Merkle root and the start in the whole stream for each part of the recipes, and a root over all.

Files: Parquet. chunks: name binary, n int, data binary (zstd of 16-bit ids where all fit, else of 32-bit ids; `wide` tells),
crc long. Null texts count as empty, so their stream is the end id alone. Rows that repeat are documents of their own. Rows
with one doc_id are ordered by their Merkle root. An empty table gives a store without rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, small_side
from corpuscle.llm.encoding import piece_table
from corpuscle.llm.neardup import blocks, mixed

WINDOW, MASK_BITS, LEAST, MOST = 16, 10, 256, 8192


def _hits(ids: np.ndarray) -> np.ndarray:
    """Places behind ids at which the rolling hash of the last WINDOW ids hits the mask."""
    h, span = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while span < WINDOW:
        h = h.copy()
        h[span:] += h[:-span] * np.uint64(pow(0xD1342543DE82EF95, span, 1 << 64))
        span *= 2
    return np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1


def boundaries(ids: np.ndarray, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of an id stream. The hash at an id depends on the WINDOW ids up to it alone."""
    return stream_ends(_hits(ids).tolist(), 0, len(ids), least, most)


def stream_ends(hits: list[int], start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the stream from start to end among streams that lie one behind another. A chunk has at least `least` ids, more than WINDOW, so no hash that counts reaches into the stream before."""
    out, n = [], len(hits)
    while start < end:
        k = bisect_left(hits, start + least)
        start = min(hits[k] if k < n else end, start + most, end)
        out.append(start)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 of pairs, up to one root; an odd last node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def packed_ids(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> tuple[bytes, bool]:
    wide = bool(ids.max(initial=0) > 0xFFFF)
    return compressor.compress(ids.astype("<u4" if wide else "<u2").tobytes()), wide


def unpacked_ids(data: bytes, wide: bool) -> bytes:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if wide else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


# zlib's crc of a concatenation, from the parts' crcs: appending n zero bytes multiplies by x**(8n) modulo the polynomial.
_POLY = 0xEDB88320
_SHIFTS: dict[int, int] = {}


def _times(a: int, b: int) -> int:
    """Product of two polynomials (bit-reversed) modulo the crc's."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
        bit >>= 1
    return out


def crc_joined(first: int, second: int, second_bytes: int) -> int:
    if second_bytes not in _SHIFTS:
        if len(_SHIFTS) > 20_000:
            _SHIFTS.clear()
        x, power, n = 1 << 31, 1 << 30, second_bytes * 8
        while n:
            if n & 1:
                x = _times(power, x)
            power, n = _times(power, power), n >> 1
        _SHIFTS[second_bytes] = x
    return _times(_SHIFTS[second_bytes], first) ^ second


def _chunked(path: str, leading: bool, end_id: int):
    """A row per chunk; a document's first chunk bears the document's recipe."""
    names = ["at", "name", "n", "wide", "data", "doc_id", "root", "n_tokens", "names", "sizes"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches):
        table, compressor = piece_table(path, leading), zstandard.ZstdCompressor(level=1)
        at = TaskContext.get().partitionId() << 40  # the place of a row in the whole table
        for b in batches:
            texts, docs = [t or "" for t in b.column("text").to_pylist()], b.column("doc_id").to_pylist()
            for i, j in blocks(texts, 1 << 22):
                ids, ends = table.flat(texts[i:j])
                ids = np.insert(ids, ends[1:], end_id).astype("<u4", copy=False)
                ends = (ends + np.arange(len(ends))).tolist()
                hits, rows = _hits(ids).tolist(), []
                for d, start, end in zip(docs[i:j], ends, ends[1:], strict=False):
                    cuts = stream_ends(hits, start, end)
                    parts = [ids[x:y] for x, y in zip([start, *cuts], cuts, strict=False)]
                    hashes = [hashlib.sha256(p).digest() for p in parts]
                    recipe = (d, merkle_root(hashes), end - start, hashes, [len(p) for p in parts])
                    for p, name in zip(parts, hashes, strict=True):
                        data, wide = packed_ids(p, compressor)
                        rows.append((at, name, len(p), wide, data, *recipe))
                        at, recipe = at + 1, (None,) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


_CHUNKED = "at long, name binary, n int, wide boolean, data binary, doc_id long, root binary, n_tokens long, names array<binary>, sizes array<int>"


def _roots(batches):
    """Of (part, root, n_tokens) in order: each part's Merkle root, documents and ids. A part's roots are held by its task."""
    now, roots, n = None, [], 0

    def out(part, roots, n):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([merkle_root(roots)], pa.binary()), pa.array([len(roots)], pa.int64()), pa.array([n], pa.int64())], ["part", "root", "documents", "n_tokens"])

    for b in batches:
        for part, root, k in zip(b.column("part").to_pylist(), b.column("root").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    yield out(now, roots, n)
                now, roots, n = part, [], 0
            roots.append(root)
            n += k
    if now is not None:
        yield out(now, roots, n)


def write_store(docs: DataFrame, out: str, path: str, leading: bool = True, end_id: int = 0, parts: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the store to the folder out, which all executors must see. Texts are encoded once."""
    spark = docs.sparkSession
    with Scratch(spark, "store") as scratch:
        staging = scratch.staged(docs.select("doc_id", "text").mapInArrow(_chunked(path, leading, end_id), _CHUNKED), "chunks")
        # Copies are found by name alone: of each name the first row stays, payloads aren't shuffled unless there are too many copies to broadcast their places.
        seen = staging.select("name", "at").join(staging.groupBy("name").agg(F.min("at").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k"), "name")
        copies = scratch.staged(seen.where("at <> least").select("at"), "copies")
        chunks = staging.select("at", "name", "n", "wide", "data").join(small_side(copies), "at", "left_anti").drop("at")
        chunks.write.option("compression", "uncompressed").parquet(f"{out}/chunks")  # the data are compressed
        recipes = staging.where("names is not null").select("doc_id", "root", "n_tokens", "names", "sizes")
        ordered = recipes.repartitionByRange(parts, "doc_id", "root") if parts else recipes.repartitionByRange("doc_id", "root")
        ordered = ordered.withColumn("part", F.spark_partition_id())
        place = Window.partitionBy("part").orderBy("doc_id", "root", "k").rowsBetween(Window.unboundedPreceding, 0)
        ordered = scratch.staged(ordered.withColumn("k", F.monotonically_increasing_id()), "ordered")  # k: of rows alike in doc_id and root
        running = ordered.withColumn("inside", F.sum("n_tokens").over(place) - F.col("n_tokens"))
        running.select("part", "inside", "doc_id", "root", "n_tokens", "names", "sizes").write.parquet(f"{out}/recipes")
        narrow = spark.read.parquet(f"{out}/recipes").select("part", "inside", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "inside")
        manifest = narrow.select("part", "root", "n_tokens").mapInArrow(_roots, "part int, root binary, documents long, n_tokens long").toArrow().sort_by("part")  # one row per part
    rows, start = [], 0
    for p, r, n, k in zip(*(manifest.column(c).to_pylist() for c in ("part", "root", "documents", "n_tokens")), strict=True):
        rows.append((p, r, n, start))
        start += k
    rows.append((-1, merkle_root([r for _, r, *_ in rows]), sum(n for _, _, n, _ in rows), start))
    spark.createDataFrame([(p, bytearray(r), n, s) for p, r, n, s in rows], "part int, root binary, documents long, start long").coalesce(1).write.parquet(f"{out}/manifest")


def read_recipes(spark: SparkSession, out: str) -> DataFrame:
    """part, doc_id, root, start (ids of all documents before it), n_tokens, names, sizes."""
    before = spark.read.parquet(f"{out}/manifest").select("part", F.col("start").alias("before"))  # one row per part
    recipes = spark.read.parquet(f"{out}/recipes").join(F.broadcast(before), "part")
    return recipes.select("part", "doc_id", "root", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "names", "sizes")


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/chunks")


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array): every document rebuilt from its chunks."""
    recipes = read_recipes(spark, out)
    parts = recipes.select("doc_id", "start", "n_tokens", F.posexplode("names").alias("k", "name")).join(read_chunks(spark, out), "name")

    def joined(batches):
        for b in batches:
            ids = []
            for chunks in b.column("chunks").to_pylist():
                ids.append(np.frombuffer(b"".join(unpacked_ids(c["data"], c["wide"]) for c in chunks), "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids"])

    whole = parts.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("k", "data", "wide"))).alias("chunks"))
    return whole.select("doc_id", "start", "n_tokens", "chunks").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids array<long>")


def verified_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified, read back from the files. Chunks are unpacked where they lie and checked against
    their names; documents are put together from the chunks' crcs in recipe order, and their Merkle roots are recomputed."""

    def digested(batches):
        for b in batches:
            raw = [unpacked_ids(d, w) for d, w in zip(b.column("data").to_pylist(), b.column("wide").to_pylist(), strict=True)]
            good = [hashlib.sha256(r).digest() == n for r, n in zip(raw, b.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([len(r) // 4 for r in raw], pa.int32()), pa.array(good)], ["name", "crc", "n", "good"])

    def summed(batches):
        for b in batches:
            rows = []
            for chunks, root, count in zip(b.column("chunks").to_pylist(), b.column("root").to_pylist(), b.column("count").to_pylist(), strict=True):
                crc, n, good = 0, 0, len(chunks) == count and merkle_root([c["name"] for c in chunks]) == root
                for c in chunks:
                    if c["n"] is None:  # its chunk is not in the store
                        good = False
                        continue
                    crc, n, good = crc_joined(crc, c["crc"], 4 * c["n"]), n + c["n"], good and c["good"]
                rows.append((n, crc, good))
            n, crc, good = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    recipes = read_recipes(spark, out)
    chunks = read_chunks(spark, out).select("name", "data", "wide").mapInArrow(digested, "name binary, crc long, n int, good boolean")
    keyed = recipes.select("doc_id", "start", "root", F.size("names").alias("count"), F.posexplode("names").alias("k", "name")).join(chunks, "name", "left")
    lists = keyed.groupBy("start", "doc_id", "root", "count").agg(F.sort_array(F.collect_list(F.struct("k", "name", "crc", "n", "good"))).alias("chunks"))
    return lists.select("doc_id", "start", "root", "count", "chunks").mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")
