"""Vocabularies in SQL: functions and table functions that a session can call by name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.patterns import BASE
from corpuscle.operators import surface
from corpuscle.operators.bpe import BYTES, Merge, encode_arrays, encoder


class _Encoder:
    """Tokens of texts as little-endian 32-bit bytes. Each distinct chunk is encoded once while it is kept; few are kept, so that a task's memory has a bound."""

    KEPT = 200_000
    #: Characters of a chunk that is kept.
    LONG = 64

    def __init__(self, merges: list[Merge], pattern: str):
        self.merges, self.pattern = merges, pattern
        self.forced = any(m.forced for m in merges)
        self.find, self.own, self.one = None, {}, encoder(merges) if self.forced else None

    def __getstate__(self):
        return self.merges, self.pattern  # patterns are compiled where they are used

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def packed(self, texts: list[str | None]) -> list[bytes | None]:
        """Null for null."""
        if self.find is None:
            self.find = regex.compile(self.pattern).findall
        if len(self.own) > self.KEPT:
            self.own = {}
        lists = [self.find(t) if t else [] for t in texts]
        new = list({c: None for x in lists for c in x if c not in self.own})
        own = self.own
        if self.forced:
            own.update((c, np.array(self.one(c), "<i4").tobytes()) for c in new)
        elif new:
            data = [c.encode() for c in new]
            ids, sizes = encode_arrays(np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data)), self.merges)
            raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            own.update(zip(new, (raw[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))
        out = [None if t is None else b"".join(map(own.__getitem__, x)) for t, x in zip(texts, lists, strict=True)]
        for c in new:
            if len(c) > self.LONG:
                del own[c]
        return out


def register_vocabulary(spark: SparkSession, merges: list[Merge], name: str = "bpe", pattern: str = BASE) -> None:
    """Registers, for a vocabulary: <name>_encode(text) -> array<int>, <name>_count(text) -> int, <name>_decode(ids) -> string (null if the bytes are no text),
    <name>_piece(id) -> binary, and the table function <name>_tokens(text) -> (pos, id, bytes). Null gives null, or no rows."""
    own = _Encoder(merges, pattern)
    whole = {i: bytes((i,)) for i in range(BYTES)} | {m.id: m.bytes for m in merges}
    names = pa.array([whole.get(i) for i in range(max(whole) + 1)], pa.binary())

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        found = own.packed(texts.to_pylist())
        ends = np.cumsum([0] + [len(x or b"") // 4 for x in found]).astype(np.int32)
        ids = np.frombuffer(b"".join(x or b"" for x in found), "<i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()), mask=pc.is_null(texts))

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else len(x) // 4 for x in own.packed(texts.to_pylist())], pa.int32())

    @F.arrow_udf("binary")
    def piece(ids: pa.Array) -> pa.Array:
        return names.take(ids)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        def text(x):
            try:
                return None if x is None else b"".join(whole[int(i)] for i in x).decode()
            except (UnicodeDecodeError, KeyError):
                return None

        return pd.Series([text(x) for x in ids], dtype=object)

    for kind, f in (("encode", encode), ("count", count), ("decode", decode), ("piece", piece)):
        spark.udf.register(f"{name}_{kind}", f)
    # In SQL, so that texts are encoded by batches and Spark makes the rows.
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_tokens(text STRING) RETURNS TABLE (pos INT, id INT, bytes BINARY)
        RETURN SELECT t.pos, t.id, {name}_piece(t.id) FROM posexplode({name}_encode(text)) AS t(pos, id)""")


def register_stream(spark: SparkSession, codec: surface.SurfaceCodec, name: str = "surface") -> None:
    """Registers, for a dual stream: the table function <name>_stream(text) -> (pos, base, space, caps), a row for each token with its bits, and
    <name>_round_trip(text) -> boolean."""

    class Stream:
        def eval(self, text: str) -> Iterator[tuple[int, int, int, list[int]]]:
            if text:
                for k, t in enumerate(codec.encode(text)):
                    yield k, int(t[0]), int(t[1]), [int(x) for x in t[2]]

    @F.pandas_udf("boolean")
    def round_trip(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else codec.decode(codec.encode(t)) == t for t in texts], dtype="boolean")

    spark.udtf.register(f"{name}_stream", F.udtf(Stream, returnType="pos int, base int, space int, caps array<int>"))
    spark.udf.register(f"{name}_round_trip", round_trip)
