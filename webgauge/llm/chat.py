"""Chat formatting at token level.

Every segment (a turn's header and its text) is encoded by itself; reserved ids, which no text encodes to, are spliced in as the
turn marks.  The loss mask covers the tokens of assistant texts; it is the prefix sum of +1 at their start and -1 at their
end.  In the formatted text the same marks are control strings, so control strings and backslashes that occur in contents
are escaped: a backslash goes after a control string's first character and before each backslash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, default_vocabulary, load
from .common import bounds, slices

#: The control strings of the template.
BEGIN, BODY, END = "<turn>", "<text>", "</turn>"
HEADINGS = ["### System:", "### User:", "### Assistant:"]
CONTROL = re.compile("|".join(map(re.escape, [BEGIN, BODY, END, *HEADINGS, "<|endoftext|>"])))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marks(bpe: Bpe) -> dict[str, int]:
    """Ids beyond the vocabulary."""
    return {BEGIN: bpe.size, BODY: bpe.size + 1, END: bpe.size + 2}


def assemble(bpe: Bpe, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all turns end to end, the loss mask, and each turn's offsets."""
    n = len(roles)
    segments, at = bpe.encode_batch([escape(x) for pair in zip(roles, texts) for x in pair], special=False)
    lens = np.diff(at)
    own = marks(bpe)
    turn_at = bounds(lens[0::2] + lens[1::2] + 3)
    out = np.zeros(turn_at[-1], np.int64)
    body, end = turn_at[:-1] + 1 + lens[0::2], turn_at[1:] - 1
    fixed = np.ones(len(out), bool)
    for place, mark in ((turn_at[:-1], own[BEGIN]), (body, own[BODY]), (end, own[END])):
        out[place] = mark
        fixed[place] = False
    out[fixed] = segments
    loss = np.fromiter((r == LOSS_ROLE for r in roles), bool, n)
    step = np.zeros(len(out) + 1, np.int64)
    np.add.at(step, body[loss] + 1, 1)
    np.add.at(step, end[loss], -1)
    return out, np.cumsum(step[:-1]).astype(bool), turn_at


def text_of(bpe: Bpe, ids: np.ndarray) -> str:
    """The formatted text of ids, marks as control strings."""
    own = {v: k for k, v in marks(bpe).items()}
    cut = np.flatnonzero(ids >= bpe.size)
    out, start = [], 0
    for c in cut:
        out += [bpe.decode(ids[start:c]).decode("utf-8", "replace"), own[int(ids[c])]]
        start = c + 1
    return "".join([*out, bpe.decode(ids[start:]).decode("utf-8", "replace")])


def read_back(bpe: Bpe, ids: np.ndarray) -> list[tuple[str, str]]:
    """Roles and texts out of ids."""
    own, turns = marks(bpe), []
    plain = lambda x: unescape(bpe.decode(x).decode("utf-8", "replace"))
    begins, bodies, ends = (np.flatnonzero(ids == own[m]) for m in (BEGIN, BODY, END))
    for a, b, c in zip(begins, bodies, ends):
        turns.append((plain(ids[a + 1 : b]), plain(ids[b + 1 : c])))
    return turns


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(conv, turn, ids array<int>, loss array<boolean>, formatted string) of each turn; a conversation is its turns in order.

    A null role or text is empty.  Repeated rows stay.  Texts of any length are formatted whole.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            ids, loss, at = assemble(bpe, batch.column("role").to_pylist(), batch.column("text").to_pylist())
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "conv": batch.column("conv"), "turn": batch.column("turn"),
                "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), "loss": pa.ListArray.from_arrays(offsets, pa.array(loss)),
                "formatted": pa.array([text_of(bpe, ids[a:b]) for a, b in zip(at, at[1:])]),
            })

    text = lambda c: F.coalesce(df[c], F.lit(""))
    turns = df.select(df[conv_col].alias("conv"), df[turn_col].alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    return turns.mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, ids array<int>, loss array<boolean>, formatted string")


def conversation_digests(formatted: DataFrame, conv_col: str = "conv_id", vocabulary: str | None = None) -> DataFrame:
    """One row for each conversation, read back from format_turns' output.

    Turns are ordered by number, then formatted text.  Conversations are spread by id and stream through sorted partitions,
    turn by turn: a task holds one turn and running digests, never a whole conversation.  A digest needs all turns of its
    conversation one after the other, so one conversation is one task's.  Turns under a null id make a conversation.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        state: list = []

        def flush() -> pa.RecordBatch:
            conv, n, turns, chars, loss, formatted = state
            return pa.RecordBatch.from_pydict({"conv": pa.array([conv], kind), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [formatted]})

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, ids, mask, formatted in zip(batch.column("conv").to_pylist(), batch.column("ids"), batch.column("loss"), batch.column("formatted").to_pylist()):
                if not state or state[0] != conv:
                    if state:
                        yield flush()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = ids.values.to_numpy().astype(np.int64)
                for role, text in read_back(bpe, ids):
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[1] += 1
                masked = unescape(bpe.decode(ids[mask.values.to_numpy(zero_copy_only=False)]).decode("utf-8", "replace"))
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(formatted)
        if state:
            yield flush()

    conv = formatted.schema["conv"].dataType.simpleString()
    ordered = formatted.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    schema = f"conv {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)
