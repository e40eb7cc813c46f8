"""Chat formatting: a finite-state machine over roles validates the order of turns; a declarative template gives text segments with loss flags.

Turns of a conversation are taken by turn, then role, then text (nulls first); null texts and roles are empty. Every conversation is formatted,
also one whose order the machine rejects: it is marked by valid = false and the index of the first bad turn. Roles that the
template doesn't know are written like the others and bear no loss. Rows with a null conv_id form one conversation. Control
strings inside texts and roles are escaped, so the formatted text can be read back without doubt. Rows that repeat are turns of their
own. Other columns are not read; an empty table gives no segments. Segments stream: a conversation of any length is never
held in memory whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles bear loss, and which role may follow which ("" is the start)."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = CONTROL

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted({ESCAPE, *self.control, self.before_role.strip(), self.after_text.strip()} - {""}, key=len, reverse=True))))


def escaped(text: str, pattern: re.Pattern) -> str:
    """The escape character is doubled; a control string is broken after its first character."""
    return pattern.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0][0]}{ESCAPE}.{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return re.sub(f"{ESCAPE}(.)", lambda m: {ESCAPE: ESCAPE, "n": "\n"}.get(m[1], ""), text, flags=re.S)


SEGMENTS = "conv_id long, seq long, text string, loss boolean, kind string, valid boolean"


def _formatted(template: Template):
    pattern = template.pattern()

    def run(batches):
        now, state, seq, ok = object(), "", 0, True
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                role, text = role or "", text or ""
                if conv != now:
                    now, state, seq, ok = conv, "", 0, True
                ok = ok and role in template.order.get(state, ())
                # The role is on a line of its own, so a line's end in it is escaped as well.
                name = escaped(role, pattern).replace("\n", f"{ESCAPE}n")
                for kind, part in (("mark", template.before_role), ("role", name), ("mark", template.after_role), ("text", escaped(text, pattern)), ("mark", template.after_text)):
                    rows.append((conv, seq, part, kind == "text" and role in template.loss_roles, kind, ok))
                    seq += 1
                state = role
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "seq", "text", "loss", "kind", "valid"])

    return run


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Of turns (conv_id, turn, role, text): segments in order within each conversation, conversations whole within a partition."""
    t = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.select("conv_id", "role", "text").mapInArrow(_formatted(template or Template()), SEGMENTS)


def _read_back(template: Template):
    pattern = re.compile(re.escape(template.before_role) + "(.*?)" + re.escape(template.after_role) + "(.*?)" + re.escape(template.after_text), re.S)

    def run(batches):
        schema = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, held, any_yet = None, "", False
        turns = loss = hashlib.sha256()
        n = chars = formatted = 0
        valid, last = True, ""

        def row():
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, valid and last in template.final)

        for b in batches:
            rows = []
            for conv, text, lossy, ok in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if not any_yet or conv != now:
                    if any_yet:
                        rows.append(row())
                    any_yet, now, held, turns, loss, n, chars, formatted, valid, last = True, conv, "", hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, ""
                formatted += len(text)
                valid = valid and ok
                if lossy:
                    plain = unescaped(text)
                    chars += len(plain)
                    loss.update(plain.encode())
                held += text
                if text == template.after_text and (m := pattern.fullmatch(held)):  # the formatted text itself is parsed for turns
                    last = unescaped(m[1])
                    turns.update(f"{last}\n{unescaped(m[2])}\n".encode())
                    n, held = n + 1, ""
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema)
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), kinds, strict=True)], schema)

    return run


def digests(segmented: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per conversation, from its segments alone. segmented: the result of segments(), whose order within partitions it needs."""
    return segmented.mapInArrow(_read_back(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
