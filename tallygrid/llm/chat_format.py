"""Chat formatting by token-level assembly.

Every turn is encoded by itself: role and text become ids of a byte-level BPE, and ids above the
vocabulary, reserved for control strings, are spliced between them:

    <|turn|> role <|says|> text <|end|>

The loss mask comes from prefix sums over segment borders: +1 where the text of an assistant
begins, -1 where it ends. Control strings occurring in roles and texts are escaped: a backslash goes
between ``<`` and ``|``, behind any that stand there already (``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|``), so taking one away again restores the text, and no content looks like control.

Turns are encoded row by row before conversations meet, and each says by itself which turn it is, so a conversation is
its formatted turns in order: by turn, ties by role, then text. ``ordered_turns`` keeps them as rows, sorted and never collected;
``fold_conversations`` reads these rows back one after the other with the memory of a batch, however long a conversation is.

Defined cases: a null text or role is the empty text; null turns come first; rows with the null
conversation id form one conversation; repeated rows are repeated turns; an empty table
gives an empty result; other columns are ignored. ``assemble_conversations`` puts the ids of one conversation into one value, as a
trainer wants them; a value holds at most 2 GB, about 500 million ids, and its task needs several times its size. Longer
conversations stay rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.llm.byte_bpe import decode_ids, encode_text, encoding_of, read_ranks
from tallygrid.llm.common import by_batch

# fixed values: the template's control strings, in the order of their reserved ids
CONTROLS = ("<|turn|>", "<|says|>", "<|end|>")
TURN, SAYS, END = range(3)
LOSS_ROLES = ("assistant",)

_TO_ESCAPE = re.compile(r"<(\\*)\|")
_TO_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text with nothing in it that looks like a control string."""
    return _TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The text before ``escape``."""
    return _TO_UNESCAPE.sub(r"<\1|", text)


def assemble(segments: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and their loss mask by prefix sums over segment borders."""
    lengths = np.array([len(ids) for ids, _ in segments], dtype=np.int64)
    ends = np.cumsum(lengths)
    ids = np.fromiter((i for part, _ in segments for i in part), dtype=np.uint32, count=int(ends[-1]) if len(ends) else 0)
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    marked = np.array([loss for _, loss in segments], dtype=bool)
    np.add.at(steps, (ends - lengths)[marked], 1)
    np.add.at(steps, ends[marked], -1)
    return ids, np.cumsum(steps[:-1]) > 0


def format_turns(rows: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each row encoded by itself: ``conv_id``, ``turn``, ``role``, ``text``, ``ids`` (binary, little-endian
    unsigned 32-bit integers) and ``mask`` (binary, one byte for each id)."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("ids", pa.binary()), ("mask", pa.binary())])

    def encode(columns: dict[str, list]) -> dict[str, list]:
        encoding = encoding_of(ranks.value, pattern)
        first = encoding.n_vocab
        made = []
        for role, text in zip(columns["role"], columns["text"]):
            segments = [
                ([first + TURN], False), (encode_text(encoding, escape(role)), False), ([first + SAYS], False),
                (encode_text(encoding, escape(text)), role in LOSS_ROLES), ([first + END], False),
            ]
            made.append(assemble(segments))
        return columns | {"ids": [ids.astype("<u4").tobytes() for ids, _ in made], "mask": [mask.astype(np.uint8).tobytes() for _, mask in made]}

    source = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return source.mapInArrow(by_batch(encode, schema), "conv_id long, turn long, role string, text string, ids binary, mask binary")


def assemble_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``ids`` and ``mask`` of whole conversations."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "ids", "mask", F.row_number().over(order).alias("place"))
    join = lambda part: F.expr(f"listagg({part}, X'') WITHIN GROUP (ORDER BY place)").alias(part)
    return placed.groupBy("conv_id").agg(join("ids"), join("mask"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Formatted turns as rows: those of a conversation in one partition, in order. Sorting spills, nothing is collected."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")


def parse(encoding, ids: np.ndarray, mask: np.ndarray) -> tuple[str, list[tuple[str, str]], list[str]]:
    """What a formatted conversation says: its text with control strings, its turns, and the texts under the loss mask."""
    first = encoding.n_vocab
    control = ids >= first
    borders = np.concatenate(([0], np.flatnonzero(np.diff(control) | control[1:]) + 1, [len(ids)])) if len(ids) else np.zeros(1, np.int64)
    shown, turns, lost, stretch = [], [], [], []
    for start, end in zip(borders[:-1], borders[1:]):
        if control[start]:
            kind = int(ids[start]) - first
            shown.append(CONTROLS[kind])
            if kind == SAYS:
                role, stretch = "".join(stretch), []
            elif kind == END:
                turns.append((unescape(role), unescape("".join(stretch))))
                stretch = []
        else:
            text = decode_ids(encoding, ids[start:end].tolist()).decode()
            shown.append(text)
            stretch.append(text)
            if mask[start:end].all():
                lost.append(unescape(text))
    return "".join(shown), turns, lost


def read_back(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """Formatted conversations decoded: ``conv_id``, ``formatted``, ``turns`` and ``loss_texts``."""
    ranks = conversations.sparkSession.sparkContext.broadcast(read_ranks(path))
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(turn)), ("loss_texts", pa.list_(pa.string()))])

    def decode(columns: dict[str, list]) -> dict[str, list]:
        encoding = encoding_of(ranks.value, pattern)
        made = [parse(encoding, np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(m, np.uint8).astype(bool)) for i, m in zip(columns["ids"], columns["mask"])]
        return {
            "conv_id": columns["conv_id"], "formatted": [m[0] for m in made],
            "turns": [[{"role": r, "text": t} for r, t in m[1]] for m in made], "loss_texts": [m[2] for m in made],
        }

    ddl = "conv_id long, formatted string, turns array<struct<role: string, text: string>>, loss_texts array<string>"
    return conversations.select("conv_id", "ids", "mask").mapInArrow(by_batch(decode, schema), ddl)


class Digest:
    """What the turns of one conversation say, in order, without keeping them."""

    def __init__(self):
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_ids = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, turns: list[tuple[str, str]], lost: list[str], n_ids: int) -> None:
        self.n_turns += len(turns)
        self.n_ids += n_ids
        self.formatted_chars += len(formatted)
        for role, text in turns:
            self.said.update(f"{role}\n{text}\n".encode())
        for text in lost:
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_ids


def fold_conversations(ordered: DataFrame, path: str, pattern: str) -> DataFrame:
    """``ordered_turns`` decoded and folded: ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed per turn),
    ``loss_chars`` and ``loss_sha256`` (all text under the mask), ``formatted_chars`` and ``n_ids``."""
    ranks = ordered.sparkSession.sparkContext.broadcast(read_ranks(path))
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_ids", pa.int64())]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(columns, kinds)], schema=pa.schema(kinds))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(ranks.value, pattern)
        current, digest = None, None
        for batch in batches:
            done = []
            for conv_id, ids, mask in zip(*(batch.column(name) for name in ("conv_id", "ids", "mask"))):
                if digest is None or conv_id.as_py() != current:
                    if digest is not None:
                        done.append(digest.row(current))
                    current, digest = conv_id.as_py(), Digest()
                turn = np.frombuffer(ids.as_buffer(), "<u4").astype(np.int64)
                digest.add(*parse(encoding, turn, np.frombuffer(mask.as_buffer(), np.uint8).astype(bool)), len(turn))
            yield table(done)
        if digest is not None:
            yield table([digest.row(current)])

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"
    return ordered.select("conv_id", "ids", "mask").mapInArrow(fold, ddl)
