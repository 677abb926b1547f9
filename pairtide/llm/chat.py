"""Chat formatting that is proved by a grammar round trip.

A turn is rendered as ``<s>[INST]role`` newline ``text[/INST]</s>``, the model's own turns
with ``[OUT]`` for ``[INST]``; a conversation is its turns back to back.  The
deterministic parser reads such text turn by turn and refuses control strings inside a turn.  Each turn is rendered as it
is, parsed, and compared with its source; where they differ the conflicting field is
escaped (a backslash is put into each control string) until the parser gives
the source back.  Escaping is undone by the parser, so it is reversible.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_ROLE = "assistant"
_CONTROL = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|OUT\]|/OUT\]|NL\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|OUT\]|/OUT\]|NL\])")
_BARE = re.compile(r"[<\[](?:s>|/s>|INST\]|/INST\]|OUT\]|/OUT\]|NL\])")
_TURN = re.compile(r"<s>\[(INST|OUT)\]([^\n]*)\n(.*?)\[/\1\]</s>", re.DOTALL)
SEGMENTS = "conv_id long, turn long, role string, segment string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, with the span of the text as rendered; ValueError if it isn't a conversation."""
    out, at = [], 0
    while at < len(rendered):
        turn = _TURN.match(rendered, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        if _BARE.search(turn[2].replace("[NL]", " ")) or _BARE.search(turn[3]):
            raise ValueError(f"a control string inside the turn at {at}")
        role = unescape(turn[2].replace("[NL]", "\n"))
        if (turn[1] == "OUT") != (role == MODEL_ROLE):
            raise ValueError(f"role and mark differ at {at}")
        out.append((role, unescape(turn[3]), turn.start(3), turn.end(3)))
        at = turn.end()
    return out


def render(role: str, text: str) -> str:
    """The shortest rendering of a turn that parses back to exactly this turn."""
    mark = "OUT" if role == MODEL_ROLE else "INST"

    def attempt(role_as: str, text_as: str) -> str | None:
        segment = f"<s>[{mark}]{role_as}\n{text_as}[/{mark}]</s>"
        try:
            turns = parse(segment)
        except ValueError:
            return None
        return segment if [t[:2] for t in turns] == [(role, text)] else None

    plain, safe = role.replace("\n", "[NL]"), escape(role).replace("\n", "[NL]")
    for role_as, text_as in ((plain, text), (plain, escape(text)), (safe, text), (safe, escape(text))):
        if (segment := attempt(role_as, text_as)) is not None:
            return segment
    raise AssertionError("an escaped turn always parses back")


def segments(conversations: DataFrame) -> DataFrame:
    """One row per turn: its rendering and the span in it (code points) that the loss counts, empty for other roles than the model's.

    Needs conv_id, turn, role, text; other columns are ignored.  A null role or text is
    empty.  Rows are rendered one by one, so repeated rows and repeated turn numbers stay."""

    def run(batches):
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            done = [render(r, t or "") for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
            spans = [parse(s)[0][2:] if r == MODEL_ROLE else (0, 0) for r, s in zip(roles, done, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(done, pa.string()), pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32())],
                names=["conv_id", "turn", "role", "segment", "loss_start", "loss_end"],
            )

    picked = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return picked.mapInArrow(run, SEGMENTS)


def in_order(turns: DataFrame) -> DataFrame:
    """Each conversation's segments together in one partition, in order; equal turn numbers are ordered by their rendering."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted (the whole rendering), loss_spans (start and end in it)."""

    def run(batches):
        key, parts, spans, size, some = None, [], [], 0, False

        def row():
            return pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([key], pa.int64()), "n_turns": pa.array([len(parts)], pa.int64()), "formatted": ["".join(parts)], "loss_spans": pa.array([spans], pa.list_(pa.list_(pa.int64())))}
            )

        for batch in batches:
            for r in batch.to_pylist():
                if some and r["conv_id"] != key:
                    yield row()
                    parts, spans, size = [], [], 0
                key, some = r["conv_id"], True
                if r["role"] == MODEL_ROLE:
                    spans.append([size + r["loss_start"], size + r["loss_end"]])
                parts.append(r["segment"])
                size += len(r["segment"])
        if some:
            yield row()

    return in_order(segments(conversations)).mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<array<long>>")


def digests(turns: DataFrame) -> DataFrame:
    """What the rendered turns of each conversation say when they are read back.

    Segments stream through in order and only running hashes are kept, so a
    conversation of any length takes constant memory."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        key, state = None, None
        done = []

        def close():
            done.append((key, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        def flush():
            out = pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], pa.string() if n.endswith("sha256") else pa.int64()) for i, n in enumerate(names)})
            done.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")]
            for conv, segment, start, end in zip(*columns, strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                for role, text, _, _ in parse(segment):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = unescape(segment[start:end])
                state["loss"].update(under.encode("utf-8", "surrogatepass"))
                state["chars"] += len(under)
                state["size"] += len(segment)
            if done:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return in_order(turns).mapInArrow(run, schema)
