"""Online decoding: streams of token rows become text as they arrive, with at most one unfinished character kept for each document."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuscle.operators.bpe import BYTES, Merge


def decoded(rows: DataFrame, merges: list[Merge], key: str = "doc_id", pos: str = "pos", id: str = "id") -> DataFrame:
    """(key, pos, text): pieces of each document's text in order, each with the place of the last token it is made of. rows: (key, pos, id), of which a
    document's may come in many batches, earlier places in earlier ones; id may be an array, of a run of tokens. Ids that the vocabulary lacks, and bytes that are no text, become U+FFFD.

    The state of a document is the bytes of its last, unfinished character (at most three); what a document ends with, if unfinished, never comes out.
    """
    whole = {i: bytes((i,)) for i in range(BYTES)} | {m.id: m.bytes for m in merges}
    kind, unknown = rows.schema[key].dataType.simpleString(), "\ufffd".encode()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        if state.exists:
            decoder.setstate((bytes(state.get[0]), 0))
        own = pd.concat(list(frames)).sort_values("_pos")
        text = "".join(decoder.decode(b"".join(whole.get(i, unknown) for i in x.tolist())) for x in own["_ids"])
        state.update((decoder.getstate()[0],))
        if text:
            yield pd.DataFrame({key: [keys[0]], pos: [int(own["_pos"].iloc[-1])], "text": [text]})

    ids = rows[id] if rows.schema[id].dataType.typeName() == "array" else F.array(rows[id])
    named = rows.select(key, rows[pos].cast("long").alias("_pos"), ids.cast("array<int>").alias("_ids"))
    return named.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{pos}` long, text string", "pending binary", "append", GroupStateTimeout.NoTimeout)
