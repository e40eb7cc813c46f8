"""Source divergence audit: how far the sources of a language are from each other, and from the language, in the terms they use.

Tasks cut texts into terms and sum occurrences by language, source and term before anything is shuffled, so that a hot source or term
sends one row a block. Rows are then dealt to shards by a hash of language and term. In each shard DuckDB sums counts and document
frequencies and keeps the frequent terms, a row each with its sources; from these rows it then makes, in blocks, partial sums of
pairs and the best terms of each source. Spark adds up the partial sums and ranks.

A pair's sum runs over all kept terms. Where both sources lack a term its value is the same for each such term, and where one lacks it, it
depends on the other's share alone. So a block sums, over pairs of sources that share a term, what differs from that; shares are counted
for each source, and a join of these counts with the other sources of the language adds the rest. Work follows the pairs that
occur, not terms times pairs. All arithmetic is on whole numbers, so the result doesn't depend on how rows are dealt.

Null text, language and source are ''. Each row is a document, repeated rows too. A very long text is a block of its own. A group without
terms has the shares of one that lacks all; a language without kept terms gives pairs of value 0 and no terms. Ties go to the smaller
item by its bytes. An empty table gives no rows. Columns other than the three aren't read, whatever their names.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.cluster import BROADCAST_BYTES, Scratch, byte_size, checkpointed
from corpuscle.llm.words import blocks, byte_class, cut, raw
from corpuscle.llm.worker import release

#: Documents of a language that a kept term is in, at least; the scale of shares; terms reported of a group.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Rows of counts that a task sums before it sends them on; rows of a block of kept terms.
HELD, ROWS = 1_000_000, 200_000
#: Memory of DuckDB in a task, beyond which it spills.
MEMORY = "400MB"

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": tempfile.mkdtemp(prefix="duckdb-"), "preserve_insertion_order": False})


def _block_counts(t: pa.Table, table: np.ndarray) -> pa.Table:
    """(lang, source, term, n, docs) of a block of documents."""
    words, before, _ = cut(*raw(t.column("text").combine_chunks()), table)
    coded = words.dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    k = max(1, len(terms))
    keys, n = np.unique(np.repeat(np.arange(t.num_rows, dtype=np.int64), np.diff(before)) * k + codes, return_counts=True)
    named = pa.array([repr(x) for x in zip(t.column("lang").to_pylist(), t.column("source").to_pylist(), strict=True)]).dictionary_encode()
    group = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, which = np.unique(group[keys // k] * k + keys % k, return_inverse=True)
    of_row = np.zeros(len(named.dictionary), np.int64)
    of_row[group[::-1]] = np.arange(t.num_rows)[::-1]  # a row of each group
    rows = pa.array(of_row[keys // k])
    sums = [pa.array(np.bincount(which, weights, len(keys)).astype(np.int64)) for weights in (n, None)]
    return pa.Table.from_arrays([t.column("lang").take(rows), t.column("source").take(rows), terms.take(pa.array(keys % k)), *sums], schema=_COUNTS)


def _counted(batches):
    release()
    table, held, n = byte_class(digits=False), [], 0
    joined = lambda parts: pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_COUNTS.names).cast(_COUNTS)
    for t in blocks(batches, ["lang", "source", "text"], "text"):
        held.append(_block_counts(t, table))
        n += held[-1].num_rows
        if n >= HELD:
            held = [joined(held)]
            n = held[0].num_rows
            if n >= HELD // 2:
                yield from held[0].to_batches(50_000)
                held, n = [], 0
    if held:
        yield from joined(held).to_batches(50_000)


_KEPT = "lang string, term string, entries array<struct<source: string, n: bigint>>"


def _kept(least: int):
    """Of a shard's counts: kept terms, each with its sources."""

    def run(batches):
        release()
        con = _connection()
        rows = pa.RecordBatchReader.from_batches(_COUNTS, (b.cast(_COUNTS) for b in batches))
        con.register("counts", rows)
        found = con.sql(
            f"""WITH c AS (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counts GROUP BY ALL)
            SELECT lang, term, list({{'source': source, 'n': n}}) AS entries FROM c GROUP BY lang, term HAVING sum(docs) >= {int(least)}"""
        )
        yield from found.to_arrow_reader(20_000)
        con.close()

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """A term's share, in parts of SCALE, of a group with so many occurrences of kept terms; exact at any count."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms)) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


_ENTRIES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64()), ("q", pa.int64())])
_PARTS = "kind string, lang string, source string, item string, p long, value decimal(38,0)"
_PART_SQL = """
WITH f AS (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q, a.p0, b.p0 AS q0 FROM e a JOIN e b ON a.t = b.t AND a.source <> b.source)
SELECT 'pair' AS kind, lang, source, item, NULL::BIGINT AS p,
       sum((p - q) * (p - q) // q - (p - q0) * (p - q0) // q0 - (p0 - q) * (p0 - q) // q + (p0 - q0) * (p0 - q0) // q0)::DECIMAL(38, 0) AS value FROM f GROUP BY ALL
UNION ALL
SELECT 'share', lang, source, NULL, p, count(*)::DECIMAL(38, 0) FROM e GROUP BY ALL
UNION ALL
(SELECT 'term', lang, source, t, NULL, ((p - q) * (p - q) // q)::DECIMAL(38, 0) AS value FROM e WHERE p > q
 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, r) <= {top})
"""


def _partial(top: int):
    """Partial results of blocks of whole terms: sums of pairs that share a term, terms by share, the best terms of each source."""

    def block(con, t: pa.Table):
        langs, terms, sources = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        # Codes for names: the join and the sums are over whole numbers.
        term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = terms.dictionary.cast(pa.binary()).to_pylist()
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        e = pa.table({"lang": lang, "t": lang * len(names) + term, "r": rank[term], "source": sources.indices.cast(pa.int64()), **{c: t.column(c) for c in ("p", "p0", "q")}})
        con.register("e", e)
        out = con.sql(_PART_SQL.format(top=int(top))).to_arrow_table().combine_chunks()
        con.unregister("e")
        kind = np.array(out.column("kind").to_pylist())
        item, is_term = out.column("item").to_numpy(), kind == "term"
        item = np.where(np.isnan(item), 0, item).astype(np.int64)
        names_of = [pa.array(terms.dictionary.take(pa.array(item[is_term] % max(1, len(names)))).to_pylist(), pa.string()), sources.dictionary.take(pa.array(np.where(is_term, 0, item)))]
        which = np.where(is_term, np.cumsum(is_term) - 1, np.count_nonzero(is_term) + np.arange(len(item)))
        items = pa.concat_arrays(names_of).take(pa.array(which, mask=kind == "share"))
        columns = [out.column("kind"), langs.dictionary.take(out.column("lang")), sources.dictionary.take(out.column("source")), items, out.column("p"), out.column("value")]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["kind", "lang", "source", "item", "p", "value"])

    def run(batches):
        release()
        con, held, n = _connection(), [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]).cast(_ENTRIES))
            n += b.num_rows
            if n >= ROWS:
                t = pa.concat_tables(held).combine_chunks()
                last = [t.column(c)[-1] for c in ("lang", "term")]
                end = n
                while end and [t.column(c)[end - 1] for c in ("lang", "term")] == last:
                    end -= 1
                if end:  # the last term may go on in the next batch
                    yield from block(con, t.slice(0, end)).to_batches()
                held, n = [t.slice(end)], n - end
        if n:
            yield from block(con, pa.concat_tables(held).combine_chunks()).to_batches()
        con.close()

    return run


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): of each group, part "pair" has every other source of its language, part "term" its best terms."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    with Scratch(docs.sparkSession, "divergence") as scratch:
        counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        kept = scratch.staged(counts.repartition("lang", "term").mapInArrow(_kept(least_docs), _KEPT), "kept")
        entries = kept.select("lang", "term", F.explode("entries").alias("e")).select("lang", "term", "e.source", "e.n")
        totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda x, e: x + e["n"])).alias("of_lang"))
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = scratch.staged(groups.fillna(0, ["total", "terms", "of_lang"]).withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))), "groups")
        # Shares beside each entry. A term's rows stand together; if groups are too many to be sent to all tasks, they are brought together again.
        whole = F.aggregate("entries", F.lit(0).cast("long"), lambda x, e: x + e["n"])
        flat = kept.select("lang", "term", whole.alias("in_lang"), F.explode("entries").alias("e")).select("lang", "term", "in_lang", "e.source", "e.n")
        small = byte_size(groups) <= BROADCAST_BYTES
        flat = flat.join(F.broadcast(groups) if small else groups, ["lang", "source"])
        if not small:
            flat = flat.repartition("lang", "term").sortWithinPartitions("lang", "term")
        flat = flat.select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", share(F.col("in_lang"), F.col("of_lang"), F.col("terms")).alias("q"))
        parts = scratch.staged(flat.mapInArrow(_partial(top), _PARTS), "parts")

        of = lambda name: groups.select("lang", F.col("source").alias(name), F.col("p0").alias(f"{name}_p0"), "terms")
        wide = lambda c: c.cast("decimal(38,0)")
        pairs = of("source").join(of("item").drop("terms"), "lang").where("source <> item")  # as many as the result has
        base = pairs.select("lang", "source", "item", wide(F.coalesce(F.col("terms") * distance(F.col("source_p0"), F.col("item_p0")), F.lit(0))).alias("value"))
        shares = parts.where("kind = 'share'").groupBy("lang", "source", "p").agg(F.sum("value").alias("n"))
        met = shares.join(of("source").drop("terms"), ["lang", "source"]).join(of("item").drop("terms"), "lang").where("source <> item")
        p, own, other = F.col("p"), F.col("source_p0"), F.col("item_p0")
        one_way = met.select("lang", "source", "item", (F.col("n") * wide(distance(p, other) - distance(own, other))).alias("value"))
        back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * wide(distance(other, p) - distance(other, own))).alias("value"))
        shared = parts.where("kind = 'pair'").select("lang", "source", "item", "value")
        total = base.union(one_way).union(back).union(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        by_pair = total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
        terms = parts.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"))
        by_term = terms.withColumn("rank", rank).where(F.col("rank") <= top)
        return checkpointed(by_pair.union(by_term))
