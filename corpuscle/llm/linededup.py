"""Line dedup: near-equal lines by MinHash over character shingles; one line of each component stays.

A line is what stands between newlines. It is compared in lower case, without white space at its ends. Lines without a word are
never duplicates. Lines shorter than a shingle equal only their copies. Copies of a line are one node, signed once a task; nodes that
share a band are verified by the exact Jaccard similarity of their shingle sets, and linked nodes form components (union-find).
Of a component's lines the first stays: by doc_id (nulls last), then by a hash of the document's row, then by place.

Null and empty texts have no lines and stay as they are. Rows equal in doc_id and text are one document: they keep the same
lines. Other columns pass through, whatever their names, except for n_chars, which follows the text if it is there. A document whose
lines all go keeps its row, with an empty text. Lines are compared whole, however long. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.cluster import Scratch, checkpointed, small_side
from corpuscle.llm.linkage import Seen, linked_groups, set_jaccard
from corpuscle.llm.neardup import blocks, mixed
from corpuscle.llm.worker import release

#: Short enough that one changed character leaves a line of 59 characters or more at the threshold, and long enough that long lines of
#: one language share few: with 5 characters half of the candidates of a corpus of 400,000 lines had nothing in common, and their number grew
#: with the square of the lines; with 6 one in twenty has.
SHINGLE, THRESHOLD = 6, 0.8
#: At the threshold 0.981 of all pairs share a band, at 0.85 0.997; of lines that share a thirtieth of their shingles four pairs in ten million do.
BANDS, ROWS = 10, 5
#: MinHash values by which pairs are passed over that are far below the threshold.
SKETCH = 64
#: Characters that are hashed at once, and shingles of a matrix; the latter small enough for a processor's cache.
BLOCK, MATRIX = 1 << 19, 1 << 17
_ODD = (mixed(np.arange(1, 513, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mixed(np.arange(1001, 1513, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def line_key(line: str) -> str:
    """What lines are compared by; empty for a line without a word."""
    return line.strip().lower()


def _shingle_hashes(cps: np.ndarray) -> np.ndarray:
    """Hashes of the SHINGLE characters from each place on."""
    n = max(0, len(cps) - SHINGLE + 1)
    h, work = np.zeros(n, np.uint32), np.empty(n, np.uint32)
    for k in range(SHINGLE):
        np.multiply(cps[k : k + n], _ODD[-1 - k], out=work)
        h += work
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):  # a finaliser of 32-bit hashes
        np.right_shift(h, np.uint32(shift), out=work)
        h ^= work
        h *= np.uint32(odd)
    return h


def line_signatures(lines: list[str], m: int) -> np.ndarray:
    """m MinHash values of each line; every line is at least SHINGLE characters long. Lines of about one length are taken together, as rows of a matrix."""
    cps = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    g = _shingle_hashes(cps)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    start, n = np.cumsum(sizes) - sizes, sizes - SHINGLE + 1
    order = np.argsort(n, kind="stable")
    out = np.empty((len(lines), m), np.uint32)
    i = 0
    while i < len(order):
        longest = int(n[order[i]]) * 9 // 8 + 4
        j = min(int(np.searchsorted(n[order], longest, side="right")), i + max(1, MATRIX // longest))
        rows = order[i:j]
        at = start[rows, None] + np.minimum(np.arange(n[rows[-1]]), n[rows, None] - 1)  # the last shingle fills a row up
        block = g[at]
        work = np.empty_like(block)
        for k in range(m):
            np.multiply(block, _ODD[k], out=work)
            work += _ADD[k]
            out[rows, k] = work.min(1)
        i = j
    return out


def line_band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for r in range(rows):
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return h.view(np.int64)


def _signed(bands: int, rows: int):
    def run(batches):
        release()
        for b in batches:
            owner, place, keys = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, line in enumerate(t.split("\n") if t else ()):
                    if s := line_key(line):
                        owner.append(i)
                        place.append(k)
                        keys.append(s)
            nodes = [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s in keys]
            ids = np.frombuffer(b"".join(nodes), ">i8")[::2].astype(np.int64)
            seen: dict[bytes, int] = {}
            fresh = [k for k, (s, x) in enumerate(zip(keys, nodes, strict=True)) if len(s) >= SHINGLE and seen.setdefault(x, k) == k]
            band = np.zeros((len(fresh), bands), np.int64)
            lines = [keys[k] for k in fresh]
            for i, j in blocks(lines, BLOCK):
                band[i:j] = line_band_keys(line_signatures(lines[i:j], bands * rows), bands, rows)
            lists = [b""] * len(keys)
            for k, x in zip(fresh, band, strict=True):
                lists[k] = x.tobytes()
            lists = pa.array(lists, pa.binary())
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("row").take(at), pa.array(place, pa.int32()), pa.array(nodes, pa.binary()), pa.array(ids), lists], ["doc_id", "row", "line", "node", "id", "keys"])

    return run


def _sketch(lines: list[str]) -> np.ndarray:
    return line_signatures(lines, SKETCH)


def _lines_at(out):
    """Of (d, r, text, wanted: places, ids, heads, salts): what out makes of those lines. Of rows that repeat a task takes one."""

    def run(batches):
        seen = Seen()
        for b in batches:
            ids, nodes, keys, heads, salts = [], [], [], [], []
            for d, r, t, wanted in zip(*(b.column(n).to_pylist() for n in ("d", "r", "text", "wanted")), strict=True):
                if seen.again((d, r)):
                    continue
                lines = t.split("\n")
                for w in wanted:
                    keys.append(s := line_key(lines[w["line"]]))
                    ids.append(w["id"])
                    heads.append(w["heads"])
                    salts.append(w["salts"])
                    nodes.append(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")))
            yield out(ids, nodes, keys, heads, salts)

    return run


def _shingles(line: str) -> frozenset:
    return frozenset(line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


def _codes(line: str) -> tuple[np.ndarray | None, str]:
    """The shingles as numbers in order, if all characters are among the first (1024 for six of them in 64 bits)."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = 64 // SHINGLE
    if len(c) < SHINGLE or int(c.max()) >> bits:
        return None, line
    n, wide = len(c) - SHINGLE + 1, c.astype(np.uint64)
    out = wide[:n].copy()
    for k in range(1, SHINGLE):
        out <<= np.uint64(bits)
        out |= wide[k : k + n]
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]], line


def codes_jaccard(x: tuple[np.ndarray | None, str], y: tuple[np.ndarray | None, str], threshold: float) -> float:
    """set_jaccard() of two lines' shingles."""
    (a, s), (b, t) = x, y
    if a is None or b is None:
        return set_jaccard(_shingles(s), _shingles(t), threshold)
    n = len(a) + len(b)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    both = int((both[1:] == both[:-1]).sum())
    return both / (n - both)


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, places in zip(texts, gone, strict=True):
        if t is not None and places is not None:
            drop = set(places.tolist())
            t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop)
        out.append(t)
    return pd.Series(out, dtype="object")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, row): each row of docs as a struct, so that no name of its columns can clash, with a hash of doc_id and text."""
    return docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row"))


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The lines that go: doc_id, row (a hash of doc_id and text), lines (places from 0), for each document that loses any."""
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    with Scratch(docs.sparkSession, "lines") as scratch:
        lines = scratch.staged(keyed.mapInArrow(_signed(bands, rows), "doc_id long, row long, line int, node binary, id long, keys binary"), "lines")

        def fetch(wanted: DataFrame, out, schema: str) -> DataFrame:
            # Any copy of a line will do; of equal ids every node is fetched.
            at = lines.select("id", "node", "doc_id", "row", "line").join(small_side(wanted.select("id")), "id", "left_semi").dropDuplicates(["node"])
            at = at.join(wanted, "id").groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("line", "id", "heads", "salts")).alias("wanted"))
            at = small_side(scratch.staged(at, "at"))
            found = keyed.join(at, keyed["doc_id"].eqNullSafe(F.col("d")) & (keyed["row"] == F.col("r")))
            return found.select("d", "r", "text", "wanted").mapInArrow(_lines_at(out), schema)

        groups = linked_groups(lines.where(F.octet_length("keys") > 0), fetch, _codes, codes_jaccard, threshold, scratch, _sketch)
        # Only lines that are repeated or linked are looked at again.
        roots = groups.select("root").distinct().select(F.col("root").alias("node"), "root")
        linked = scratch.staged(groups.union(roots), "linked")
        repeated = lines.groupBy("node").count().where("count > 1").select("node")
        several = scratch.staged(repeated.join(linked, "node", "full_outer").select("node", F.coalesce("root", "node").alias("root")), "several")
        places = scratch.staged(lines.select("doc_id", "row", "line", "node").join(small_side(several), "node").select("root", "doc_id", "row", "line"), "places")
        scratch.drop(lines)
        place = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "line")
        heads = scratch.staged(places.groupBy("root").agg(F.min(place).alias("head")), "heads")
        gone = places.join(small_side(heads), "root").where(~place.eqNullSafe(F.col("head")))
        return checkpointed(gone.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines")))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the lines that repeat an earlier one."""
    gone = repeated_lines(docs, threshold).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("lines").alias("gone"))
    joined = _keyed(docs).join(small_side(gone), F.col("doc.doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    loses = F.col("gone").isNotNull()
    text = F.when(loses, _without(F.when(loses, F.col("doc.text")), F.col("gone"))).otherwise(F.col("doc.text"))
    joined = joined.select("doc", "gone", text.alias("kept"))
    own = {"text": F.col("kept"), "n_chars": F.when(loses, F.length("kept").cast("long")).otherwise(F.col("doc")["n_chars"]) if "n_chars" in docs.columns else None}
    return joined.select(*[(F.col("doc")[c] if own.get(c) is None else own[c]).alias(c) for c in docs.columns])
