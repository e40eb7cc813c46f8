"""Token ids by the tokenizers library, with each distinct piece of a block of texts looked up or encoded once.

Both vocabularies split text before any merge, also at a space or newline between two other characters, so a text whose white
space is single spaces and newlines has the ids of its pieces, one after another. (With the byte-level one a space goes to the
piece behind it, a newline stands alone.) Pieces recur; a bounded table keeps their ids, and pieces that it lacks are encoded
in one call for a block of texts. Other texts are split only at a space that a non-space follows. Texts that hold an added token
(such as an end mark) are encoded whole, as the library finds these before it splits.

The byte-level pattern also splits letters from the marks behind them, so a piece of Latin letters with marks is looked up by its letters, and new
letters go to the library's model many at once without being split by the pattern, which would leave them whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuscle.llm.worker import held

#: Pieces whose ids are kept; of a full table the half goes that wasn't seen for longest.
KEPT_PIECES = 700_000
#: Pieces of more bytes than this go first.
LONG_PIECE = 64
#: Pieces of letters that are encoded in one text; of the byte-level vocabulary, where shorter texts cost less.
TOGETHER = 500
TOGETHER_LEADING = 100
#: A piece of Latin letters and the ASCII marks behind them, but no apostrophe, which may take letters along.
LETTERS = r"^(?P<core>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
#: Marks that often stand behind letters.
MARKS = (",", ".")


def is_latin(text: str) -> bool:
    """Whether all characters are among the first 256: none composes with another, and each has a lower case of its own."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def other_space(text: str) -> bool:
    """Whether there is white space other than spaces and newlines."""
    if any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
        return True
    if text.isascii():
        return False
    return "\x85" in text or "\xa0" in text or (not is_latin(text) and _WIDE_SPACE.search(text) is not None)


_WIDE_SPACE = re.compile("[\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def is_plain(text: str) -> bool:
    """Whether the white space of a text is single spaces and newlines between other characters. A piece behind a newline starts with it."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(x in text for x in ("  ", " \n", "\n ", "\n\n")) and not other_space(text)


class PieceTable:
    """Ids of texts. leading: whether the space before a piece belongs to it (byte-level) or is dropped (word-level)."""

    def __init__(self, path: str, leading: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added_folded = tuple(x.lower() for x in self.added)
        self.leading = leading
        self.names = pa.array([], pa.string())
        self.at: dict[str, int] = {}  # in place of names, if leading: where each stands
        self.at_bytes = 0
        self.lists = pa.array([], pa.list_(pa.uint32()))  # ids of each name
        self.used = np.zeros(0, np.int64)  # when it was last seen
        self.clock = 0
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)  # tokens that end a unit
        if leading:
            self.last[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
            self.unsplit, self.byte_names = self._without_pattern()
        else:
            self.last[[i for t, i in names.items() if t.endswith("</w>")]] = True

    def _without_pattern(self):
        """(the same model behind a split at newlines alone, the character that it has for each byte); none if the tokenizer isn't plainly byte-level."""
        from tokenizers import Tokenizer, pre_tokenizers

        own = self.tokenizer.pre_tokenizer
        if type(own) is not pre_tokenizers.ByteLevel or own.add_prefix_space or not own.use_regex or self.tokenizer.normalizer is not None:
            return None, {}
        bare, names = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
        for text in map(chr, range(256)):
            names.update(zip(text.encode(), bare.pre_tokenize_str(text)[0][0], strict=True))
        names.update({b: "\ufffd" for b in range(256) if b not in names})  # begins no character under 256
        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = pre_tokenizers.Split(names[10], "isolated")
        return out, names

    def _latin(self, units: list[str]) -> pa.ListArray:
        """Ids of runs of Latin letters with a space before each; a newline's token tells where each ends."""
        if self.unsplit is None:
            return self._letters(units)
        texts = ["\n ".join(units[i : i + TOGETHER_LEADING]) for i in range(0, len(units), TOGETHER_LEADING)]
        texts = [f" {t}\n".encode().decode("latin-1").translate(self.byte_names) for t in texts]
        found = [np.array(self.unsplit.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        last = self.last[ids]
        ends = np.cumsum(~last)[last]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids[~last]))

    def _encode(self, texts: list[str]) -> pa.ListArray:
        return pa.array([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else [], pa.list_(pa.uint32()))

    def _spaced(self, pieces: list[str]) -> pa.ListArray:
        return self._encode([p if p[:1] == "\n" else " " + p for p in pieces] if self.leading else pieces)

    def _letters(self, units: list[str]) -> pa.ListArray:
        """Ids of runs of letters, encoded many at once: a token (a newline, or one that ends a word) tells where each ends."""
        out = [pa.array([], pa.list_(pa.uint32()))]
        for i in range(0, len(units), TOGETHER):
            some = units[i : i + TOGETHER]
            text = " " + "\n ".join(some) + "\n" if self.leading else " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            last = self.last[ids]
            ends = np.cumsum(~last)[last] if self.leading else np.flatnonzero(last) + 1
            whole = len(ends) == len(some)
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids[~last] if self.leading else ids)) if whole else self._spaced(some))
        return pa.concat_arrays(out)

    def _holds_added(self, text: str) -> bool:
        """Whether the library may find an added token in the text, which it looks for before it splits, or would in lower case."""
        return any(x in text for x in self.added) or (not self.leading and any(x in low for low in (text.lower(),) for x in self.added_folded))

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts, one text behind another, and where each text's begin (and the last one's end). The first piece of a text has no space before it."""
        plain, others = [], {}
        for i, t in enumerate(texts):
            if self._holds_added(t):
                others[i] = [t]
            elif not self.leading:
                plain.append((t.lower() if is_latin(t) else t).replace("\n", " "))  # as the tokenizer would; fewer distinct pieces
            elif is_plain(t):
                plain.append(t.replace("\n", " \n"))
            else:
                others[i] = re.split(r" (?=\S)", t)
        lists = pc.split_pattern(pa.array(plain, pa.string()), " ")
        sizes = np.empty(len(texts), np.int64)
        is_plain_one = np.ones(len(texts), bool)
        is_plain_one[list(others)] = False
        sizes[is_plain_one] = np.diff(lists.offsets.to_numpy())
        for i, p in others.items():
            sizes[i] = len(p)
        starts = np.r_[0, np.cumsum(sizes)]
        flat = lists.flatten()
        if others:
            rest = pa.array([x for i in sorted(others) for x in others[i]], pa.string())
            flat = pa.concat_arrays([flat, rest])
            order = np.argsort(np.repeat(np.r_[np.flatnonzero(is_plain_one), np.array(sorted(others), np.int64)], np.r_[sizes[is_plain_one], sizes[sorted(others)]]), kind="stable")
            flat = flat.take(pa.array(order))
        return flat, starts

    def _learned(self, pieces: list[str], cores: dict[str, int]) -> tuple[list[str], pa.ListArray, pa.ListArray]:
        """Ids of pieces that the table lacks; before them, names and ids of letters that came with a mark alone. cores: where letters before a mark
        stand in the table. Letters with one mark behind them are the letters' ids and the mark's."""
        letters, others, plan = {}, [], []
        for p in pieces:
            if p.isalpha():
                plan.append((letters.setdefault(p, len(letters)), -1))
            elif p[-1:] in MARKS and p[:-1].isalpha():
                plan.append((letters.setdefault(p[:-1], len(letters)), MARKS.index(p[-1])))
            else:
                plan.append((-1 - len(others), -1))
                others.append(p)
        units = list(letters)
        at = np.fromiter((cores.get(u, -1) for u in units), np.int64, len(units))
        lacking = at < 0
        fresh = [u for u, x in zip(units, lacking.tolist(), strict=True) if x]
        known = self.lists.take(pa.array(at[~lacking]))
        table = pa.concat_arrays([known, self._letters(fresh), self._spaced(others), self._encode(list(MARKS))])
        place = np.empty(len(units), np.int64)
        place[~lacking], place[lacking] = np.arange(len(known)), len(known) + np.arange(len(fresh))
        plan = np.array(plan, np.int64).reshape(-1, 2)
        first = np.where(plan[:, 0] >= 0, place[np.maximum(plan[:, 0], 0)] if len(place) else 0, len(known) + len(fresh) - 1 - plan[:, 0])
        marked = plan[:, 1] >= 0
        parts = np.repeat(first, 1 + marked)
        ends = np.cumsum(1 + marked)
        parts[ends[marked] - 1] = len(table) - len(MARKS) + plan[marked, 1]
        taken = table.take(pa.array(parts))
        offsets = taken.offsets.to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(offsets[np.r_[0, ends]].astype(np.int32)), taken.values)
        return fresh, table.slice(len(known), len(fresh)), lists

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand in the table; those that it lacks are learned."""
        self.clock += 1
        marked = pc.or_(pc.ends_with(pieces, MARKS[0]), pc.ends_with(pieces, MARKS[1]))
        cores = pc.utf8_slice_codeunits(pieces.filter(marked), 0, -1)
        found = pc.index_in(pa.concat_arrays([pieces, cores]), value_set=self.names)
        at, of_cores = found.slice(0, len(pieces)), found.slice(len(pieces))
        out = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if at.null_count:
            lacking = pc.is_null(at)
            new = pieces.filter(lacking)
            there = pc.and_(pc.is_valid(of_cores), pc.is_null(at.filter(marked)))
            known = dict(zip(cores.filter(there).to_pylist(), of_cores.filter(there).to_pylist(), strict=True))
            more, more_lists, lists = self._learned(new.to_pylist(), known)
            more = pa.array(more, pa.string())
            other = pc.invert(pc.is_in(more, value_set=new))  # letters that came with a mark alone
            more, more_lists = more.filter(other), more_lists.filter(other)
            out[lacking.to_numpy(zero_copy_only=False)] = len(self.names) + len(more) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, more, new])
            self.lists = pa.concat_arrays([self.lists, more_lists, lists])
            self.used = np.r_[self.used, np.full(len(more) + len(new), self.clock)]
        self.used[out] = self.clock
        return out

    def _spaced_lists(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of distinct pieces with a space or newline before each: those of Latin letters are the letters' ids and the marks'; what the table lacks is learned."""
        self.clock += 1
        found = pc.extract_regex(pieces, LETTERS)
        there = found.is_valid()
        core, tail = (found.field(k).filter(there) for k in (0, 1))
        units = pa.concat_arrays([core, pieces.filter(pc.invert(there))]).dictionary_encode()
        which, keys = units.indices.to_numpy(zero_copy_only=False), units.dictionary.to_numpy(zero_copy_only=False).tolist()
        n_cores = int(which[: len(core)].max(initial=-1)) + 1  # they come first
        at = np.fromiter((self.at.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            n_new = int(np.searchsorted(new, n_cores))
            names = [keys[k] for k in new.tolist()]
            at[new] = len(self.lists) + np.arange(len(new))
            self.lists = pa.concat_arrays([self.lists, self._latin(names[:n_new]), self._spaced(names[n_new:])])
            self.at.update(zip(names, at[new].tolist(), strict=True))
            self.at_bytes += sum(map(len, names))
            self.used = np.r_[self.used, np.full(len(new), self.clock)]
        self.used[at] = self.clock
        tails = pa.concat_arrays([pa.array([""], pa.string()), tail]).dictionary_encode()
        table = pa.concat_arrays([self.lists, self._encode(tails.dictionary.to_pylist())])
        parts = np.full((len(pieces), 2), len(self.lists), np.int64)  # of two lists each; the second may be that of no marks
        there = there.to_numpy(zero_copy_only=False)
        parts[there, 0], parts[~there, 0] = at[which[: len(core)]], at[which[len(core) :]]
        parts[there, 1] += tails.indices.to_numpy(zero_copy_only=False)[1:]
        taken = table.take(pa.array(parts.ravel()))
        return pa.ListArray.from_arrays(taken.offsets.take(pa.array(np.arange(0, 2 * len(pieces) + 1, 2))), taken.values)

    def _forget(self) -> None:
        """Keeps the half of a full table that was seen last."""
        if self.leading:
            if len(self.at) > KEPT_PIECES or self.at_bytes > 64 * KEPT_PIECES:
                names = list(self.at)  # in the order of their places
                keep = [k for k in np.sort(np.argsort(self.used, kind="stable")[-KEPT_PIECES // 2 :]).tolist() if len(names[k]) <= LONG_PIECE]
                self.lists, self.used = self.lists.take(pa.array(keep, pa.int64())), self.used[keep]
                self.at = {names[k]: i for i, k in enumerate(keep)}
                self.at_bytes = sum(map(len, self.at))
            return
        if len(self.names) > KEPT_PIECES or self.names.nbytes > 64 * KEPT_PIECES:
            keep = np.sort(np.argsort(self.used, kind="stable")[-KEPT_PIECES // 2 :])
            keep = keep[pc.binary_length(self.names).to_numpy(zero_copy_only=False)[keep] <= LONG_PIECE]
            self.names, self.lists, self.used = self.names.take(pa.array(keep)), self.lists.take(pa.array(keep)), self.used[keep]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text behind another, and where each text's begin (and the last one's end). Give it texts of some million characters at most."""
        pieces, starts = self._split(texts)
        coded = pieces.dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self._forget()
        if self.leading:  # what no space stands before is a piece of its own kind
            at = starts[:-1][np.diff(starts) > 0]
            firsts, which = np.unique(codes[at], return_inverse=True)
            bare = self._encode(names.take(pa.array(firsts)).to_pylist())
            codes[at] = len(names) + which
            used = np.zeros(len(names), bool)
            used[codes[codes < len(names)]] = True
            spaced = self._spaced_lists(names.filter(pa.array(used)))
            place = np.cumsum(used) - 1
            place = np.r_[place, len(spaced) + np.arange(len(bare))]
            table = pa.concat_arrays([spaced, bare])
        else:
            place = self._places(names)
            table = self.lists
        at = place[codes]
        offsets = table.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)[at]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = table.values.to_numpy(zero_copy_only=False)[np.repeat(offsets[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[starts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, as little-endian 32-bit bytes."""
        ids, at = self.flat(texts)
        return [ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def piece_table(path: str, leading: bool) -> PieceTable:
    """The table of this worker."""
    return held(("pieces", path, leading), lambda: PieceTable(path, leading))


def default_path(name: str) -> str:
    """Where the installed vocabulary files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
