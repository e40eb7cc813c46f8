"""Distributed union-find: connected components of a table of links.

Links point from a node to a lesser one. A round brings the links of each node together and unites what a task holds, so that a node
has one link, to the least it is known to be linked with; then links whose end has links of its own follow them, by a join. Rounds go
on until no end has a link, or until one task can unite the links that are left (UNITE_AT_ONCE, a bound on its memory): each node then
points to the least of its component. Rows are gathered by the node that a link starts
from, which a task's forest holds once, so a hub gathers as many rows as there are tasks; the links that end at a hub meet only in
the join, where adaptive execution splits a key's rows. Each round is written to the shared folder, and the one before is dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch

#: Links that a task unites before it emits their forest.
UNITE_AT_ONCE = 500_000


def _united(batches):
    parent: dict = {}

    def root(x):
        up = parent[x]
        while up != x:
            parent[x] = x = parent[up]
            up = parent[x]
        return x

    def forest(schema):
        rows = [(x, root(x)) for x in parent]
        rows = [(x, r) for x, r in rows if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], schema.field(0).type), pa.array([r for _, r in rows], schema.field(1).type)], ["u", "v"])

    schema, n = None, 0
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = root(x) if x in parent else parent.setdefault(x, x)
            y = root(y) if y in parent else parent.setdefault(y, y)
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y
        n += b.num_rows
        if n >= UNITE_AT_ONCE:
            n = 0
            yield forest(schema)
    if schema is not None:
        yield forest(schema)


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is linked to another and isn't itself the root; root is the least node of its component. Nulls and self-links are left out."""
    kind = dict(links.dtypes)[a]
    out = f"u {kind}, v {kind}"
    e = scratch.staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_united, out).distinct(), "links")
    while e.count() > UNITE_AT_ONCE:
        met = scratch.staged(e.select("u", "v").repartition("u").mapInArrow(_united, out), "met")
        scratch.drop(e)
        up = met.select(F.col("u").alias("k"), F.col("v").alias("w"))
        e = scratch.staged(met.join(up, met["v"] == up["k"], "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")).distinct(), "links")
        scratch.drop(met)
        if e.where("moved").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    whole = scratch.staged(e.select("u", "v").coalesce(1).mapInArrow(_united, out), "whole")
    scratch.drop(e)
    return whole.select(F.col("u").alias("node"), F.col("v").alias("root"))
