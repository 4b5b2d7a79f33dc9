"""Chat formatting (operator 10): a finite-state machine over roles checks the
order of turns and emits text segments with a loss flag each, from a
declarative template.

The template gives each role an opening and a closing marker and says whether
its text counts for the loss.  Control strings inside texts are escaped, and
reading back undoes it exactly: a backslash is doubled, and a backslash is put
after the first character of every control string.

A conversation streams through a task turn by turn, sorted by turn, so a task
holds one batch, however long the conversation.

Nulls: a null text or role is empty; a null turn sorts first; a null conv_id is
a conversation of its own.  Ties of turn go by role, then text; repeated rows
are repeated turns.  A role outside the template is written under the
``other`` markers with its name, and never counts for the loss.  Turns out of
order are formatted all the same; ``valid`` says that the machine refused
them.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers by role, who counts for the loss, and the allowed moves of the
    role machine (state '' is the start)."""

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        parts = [m.strip() for pair in self.markers.values() for m in pair] + list(self.other)
        return sorted({"<s>", "</s>", *parts}, key=len, reverse=True)


def _codec(template: Template):
    controls = re.compile("|".join(map(re.escape, template.controls())))
    escaped = re.compile(r"\\(.)", re.S)

    def escape(text: str) -> str:
        return controls.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    def unescape(text: str) -> str:
        return escaped.sub(r"\1", text)

    return escape, unescape


SEGMENTS = "conv_id long, turn_no long, segment_no int, segment string, loss boolean, turn_ok boolean"


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments in reading order: opening marker, text, closing marker per
    turn.  Rows of one conversation lie together and in order."""
    template = template or Template()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape, _ = _codec(template)
        now, state, turn_no = object(), "", 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    now, state, turn_no = conv, "", 0
                ok = role in template.moves.get(state, ())
                if role in template.markers:
                    left, right = template.markers[role]
                else:
                    left, right = template.other[0] + escape(role) + template.other[1], template.other[2]
                body = escape(text)
                loss = role in template.loss_roles
                out += [(conv, turn_no, 0, left, False, ok), (conv, turn_no, 1, body, loss, ok),
                        (conv, turn_no, 2, right, False, ok)]
                state, turn_no = role, turn_no + 1
            yield _batch(out, segments_schema)

    segments_schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int32()),
                                 ("segment", pa.string()), ("loss", pa.bool_()), ("turn_ok", pa.bool_())])
    return ordered.mapInArrow(emit, SEGMENTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, valid boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse formatted segments (as ``format_turns`` lays them out) into one
    digest row per conversation: the turns by their markers, the loss text by
    the loss mask."""
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("valid", pa.bool_())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unescape = _codec(template)
        forms = [(role, left, right) for role, (left, right) in template.markers.items()]
        named = re.compile(re.escape(template.other[0]) + "(.*?)" + re.escape(template.other[1]) + "(.*)"
                           + re.escape(template.other[2]), re.S)

        def turn_of(chunk: str) -> tuple[str, str]:
            for role, left, right in forms:
                if chunk.startswith(left) and chunk.endswith(right):
                    return role, unescape(chunk[len(left):len(chunk) - len(right)])
            m = named.fullmatch(chunk)
            if not m:
                raise ValueError(f"no marker opens this turn: {chunk[:60]!r}")
            return unescape(m[1]), unescape(m[2])

        def fresh(conv):
            return {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(),
                    "all": 0, "ok": True, "role": ""}

        def closed(s) -> tuple:
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"],
                    s["ok"] and s["role"] in template.final)

        s, chunk = None, []
        for batch in batches:
            out = []
            for conv, no, text, loss, ok in zip(*(batch.column(c).to_pylist() for c in
                                                  ("conv_id", "segment_no", "segment", "loss", "turn_ok"))):
                if s is None or conv != s["conv"]:
                    if s is not None:
                        out.append(closed(s))
                    s = fresh(conv)
                s["all"] += len(text)
                s["ok"] &= ok
                if loss:
                    plain = unescape(text)
                    s["chars"] += len(plain)
                    s["loss"].update(plain.encode())
                chunk.append(text)
                if no == 2:
                    role, body = turn_of("".join(chunk))
                    s["turns"].update(f"{role}\n{body}\n".encode())
                    s["n"], s["role"], chunk = s["n"] + 1, role, []
            yield _batch(out, schema)
        if s is not None:
            yield _batch([closed(s)], schema)

    return segments.mapInArrow(parse, DIGEST)
