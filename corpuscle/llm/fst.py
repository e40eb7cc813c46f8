"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A token sequence is the BPE encoding of its bytes exactly if each token encodes to itself and each two neighbours encode to
themselves, so the merges compile into two relations: tokens that can occur, and pairs that can stand together. The transducer
reads bytes and follows, as its hypotheses, every way to part what it has read into tokens that satisfy both, the last one
perhaps unfinished. There is one hypothesis for each start of an unfinished token, so lookahead is bounded by the longest token. What all
hypotheses share is emitted. States (the last emitted token and the hypotheses beyond it) and moves are made when they are needed
a second time, and kept in a bounded table; until then the hypotheses themselves are followed.

Texts are split by a pattern first, and each match is encoded separately; a match that is a token is that token. Encodings of
recurring pieces between spaces are kept. Null texts count as empty and have no tokens. Rows are encoded one by one; other
columns pass through. Texts of any length are encoded and decoded whole. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.encoding import is_plain
from corpuscle.llm.worker import held

#: Bounds of the tables; each starts anew beyond it.
KEPT_STATES, KEPT_PIECES, KEPT_PAIRS = 300_000, 450_000, 500_000
LONG_PIECE = 64
_BYTES = [bytes((b,)) for b in range(256)]
#: Ids that the streaming decoder takes at once.
DECODE_AT_ONCE = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BpeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.open = {b[:k] for b in ranks for k in range(1, len(b))}  # beginnings of longer tokens
        self.alone: dict[int, bool] = {}
        self.together: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.number = {(-1, (((), b""),)): 0}
        self.states = [(-1, (((), b""),))]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.once: set[int] = set()

    def _merged(self, text: bytes, stop: int = 1) -> list[int]:
        """The merges applied by rank: the relation that the transducer is compiled from."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > stop:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _can_follow(self, last: int, token: int) -> bool:
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self._merged(self.bytes_of[token]) == [token]
        if len(self.together) > KEPT_PAIRS:
            self.together.clear()
        ok = self.together[last, token] = ok and (last < 0 or self._stay_apart(last, token))
        return ok

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.split:
            text = self.bytes_of[token]
            self.split[token] = None if len(text) == 1 else tuple(self._merged(text, 2))
        return self.split[token]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before the merges that make a and b. Their last merges are undone, latest first; tokens
        that then meet at the border must not merge earlier than what was just undone (at the same rank the left merge comes first)."""
        before = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) < before:
                return False
            left, right = self._halves(a), self._halves(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, hypotheses = self.states[state]
        out, step, opened, rank_of, together = [], _BYTES[byte], self.open, self.ranks.get, self.together
        for pending, begun in hypotheses:
            begun += step
            if begun in opened:
                out.append((pending, begun))
            token = rank_of(begun)
            if token is not None:
                before = pending[-1] if pending else last
                ok = together.get((before, token))
                if ok or (ok is None and self._can_follow(before, token)):
                    out.append(((*pending, token), b""))
        emitted = out[0][0]
        if len(out) > 1:
            for pending, _ in out:
                if pending[: len(emitted)] != emitted:
                    shared = 0
                    while shared < len(pending) and shared < len(emitted) and pending[shared] == emitted[shared]:
                        shared += 1
                    emitted = emitted[:shared]
                    if not shared:
                        break
        if n := len(emitted):
            key = (emitted[-1], tuple([(p[n:], b) for p, b in out]))
        else:
            key = (last, tuple(out))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = (to, emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > KEPT_STATES or len(self.once) > 4 * KEPT_STATES:
            self._restart()
        out: list[int] = []
        state, moves, once = 0, self.moves, self.once
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in once:  # a move is made when it is needed a second time
                    once.add(key)
                    return out + self._followed(state, piece[i:])
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = next((p for p, b in self.states[state][1] if not b), ())
        out += end
        return out

    def _followed(self, state: int, rest: bytes) -> list[int]:
        """What the hypotheses of a state give for the rest of a piece, without making states."""
        last, hypotheses = self.states[state]
        opened, rank_of, together = self.open, self.ranks.get, self.together
        for byte in rest:
            step, out = _BYTES[byte], []
            for pending, begun in hypotheses:
                begun += step
                if begun in opened:
                    out.append((pending, begun))
                token = rank_of(begun)
                if token is not None:
                    before = pending[-1] if pending else last
                    ok = together.get((before, token))
                    if ok or (ok is None and self._can_follow(before, token)):
                        out.append(((*pending, token), b""))
            hypotheses = out
        return list(next(p for p, b in hypotheses if not b))


class Utf8Stream:
    """Decodes bytes that come in parts: holds back an unfinished character until its other bytes come."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes of a character at the end that still lacks some."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self._unfinished(data)
        self.held = data[len(data) - n :] if n else b""
        return (data[: len(data) - n] if n else data).decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Encoder:
    """Pattern and transducer; keeps the ids of the pieces between spaces and newlines, where this pattern parts a text with no other white space."""

    def __init__(self, path: str, pattern: str):
        import regex

        gc.set_threshold(500_000, 20, 100)  # the tables hold many tuples and no cycles
        self.fst = BpeTransducer(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.splits = pattern.endswith(r"|\s+(?!\S)|\s+") and r"| ?\p{L}+|" in pattern and r"| ?[^\s\p{L}\p{N}]+|" in pattern
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        ids: list[int] = []
        for m in self.find(text):
            ids += self.fst.encode(m.encode())
        return array("I", ids).tobytes()

    def _learned(self, piece: str) -> bytes:
        """Ids of a piece and the space (or newline) before it. Letters, and letters with one mark after them, need no search."""
        got = self.old.get(piece)
        if got is None:
            if piece.isalpha():
                got = array("I", self.fst.encode(b" " + piece.encode())).tobytes()
            elif piece[-1:] in (",", ".") and piece[:-1].isalpha():
                got = (self.new.get(piece[:-1]) or self._learned(piece[:-1])) + array("I", self.fst.encode(piece[-1].encode())).tobytes()
            else:
                got = self._ids(piece if piece[:1] == "\n" else " " + piece)
        if len(piece) <= LONG_PIECE:
            if len(self.new) > KEPT_PIECES:
                self.old, self.new = self.new, {}
            self.new[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not self.splits:
            return self._ids(text)
        pieces = text.replace("\n", " \n").split(" ") if is_plain(text) else re.split(r" (?=\S)", text)
        learned, out = self._learned, [self._ids(pieces[0])]
        for p in pieces[1:]:
            out.append(self.new.get(p) or learned(p))
        return b"".join(out)


def decoded(ids: list[int], bytes_of: list[bytes]):
    """Yields (bytes, text) for runs of ids."""
    stream = Utf8Stream()
    for i in range(0, len(ids), DECODE_AT_ONCE):
        raw = b"".join([bytes_of[k] for k in ids[i : i + DECODE_AT_ONCE]])
        yield raw, stream.feed(raw)
    yield b"", stream.finish()


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker."""
    return held(("fst", path, pattern), lambda: Encoder(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of ids."""
    import pandas as pd

    def of_text(texts):
        e = encoder(path, pattern)
        return pd.Series([np.frombuffer(e.encode(t or ""), "<u4").astype(np.int32) for t in texts])

    return docs.withColumn(ids, F.pandas_udf(of_text, "array<int>", F.PandasUDFType.SCALAR)(F.col(text)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and whether the decoded text is the text. Ids aren't sent back to the JVM."""

    def run(batches):
        e = encoder(path, pattern)
        names = list(map(str, range(len(e.fst.bytes_of))))
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                t = t or ""
                ids = np.frombuffer(e.encode(t), "<u4").tolist()
                h, chars = hashlib.sha256(), []
                for raw, chunk in decoded(ids, e.fst.bytes_of):
                    h.update(raw)
                    chars.append(chunk)
                out.append((len(ids), hashlib.sha256(" ".join([names[k] for k in ids]).encode()).hexdigest(), h.hexdigest(), "".join(chars) == t))
            n, i, d, same = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
