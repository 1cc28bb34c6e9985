"""Cost-balanced packing of token sequences.

Attention inside a piece costs its length plus a share of its square. Pieces are taken in descending order and
each goes to the sequence of least cost so far that still has room for it. A group of pieces with t tokens in all gets
t // capacity full sequences, and one for each power of two in the rest, so every sequence is
filled exactly and nothing is padded (a sequence whose length is a power of two stays as it is). A
piece that fits nowhere whole is cut at the room of the roomiest sequence; its rest goes on.

Tokenising and packing run where the rows are, without a shuffle: a task packs its rows in groups
of ``GROUP_TOKENS`` tokens or the next row's end. Longer documents give full pieces at once. A sequence's id is made of the
task's partition and a running number.

Words are tokenised once while they are held: white space and the pattern of the tokenizer's
pre-tokenizer separate words, so that a text's ids are those of its words in order. Words of plain
Latin letters, digits and signs go to the library's model directly, any other stretch between
blanks goes through its whole pipeline.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; equal costs go to the first
sequence, equal lengths to the first row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2_048
END_ID = 1
#: cost of a piece of n tokens: n + n * n / QUADRATIC
QUADRATIC = 1_024
GROUP_TOKENS = 1_000_000
#: words and stretches whose ids a task holds, and the longest that it holds
HELD, HELD_CHARS = 500_000, 64

# what needs no normal form but lower case, and is split by SPLIT as by the tokenizer's own pattern
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
LETTER = "a-zß-öø-ÿ"
SPLIT = re.compile(rf"[{LETTER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{LETTER}0-9]+")
BLANKS = re.compile(r"[ \t\n\r]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Ids (little-endian unsigned 32-bit) of words, and of stretches that are not plain, while they are held."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= HELD:
            self.clear()
        if PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        made = np.array(ids, dtype="<u4").tobytes()
        if len(word) <= HELD_CHARS:
            self[word] = made
        return made

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))
        parts = []
        for stretch in BLANKS.split(text):
            if PLAIN.fullmatch(stretch):
                parts += map(self.__getitem__, SPLIT.findall(stretch.lower()))
            else:
                parts.append(self[stretch])
        return b"".join(parts)


@lru_cache(maxsize=2)
def words_of(definition: bytes) -> Words:
    return Words(definition)


def cost(length: int) -> float:
    """Linear plus quadratic attention cost of a piece."""
    return length + length * length / QUADRATIC


def rooms(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the sequences for so many tokens: full ones, then powers of two, largest first."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill ``rooms`` exactly."""
    sizes = np.array(rooms(sum(lengths), capacity), dtype=np.int64)
    room, spent = sizes.copy(), np.zeros(len(sizes))
    queue = sorted(((-n, doc, 0) for doc, n in enumerate(lengths) if n), reverse=True)
    waiting: dict[int, list[tuple[int, int]]] = {}
    for negative, doc, start in reversed(queue):
        waiting.setdefault(-negative, []).append((doc, start))
    made = []

    def place(doc: int, start: int, length: int, sequence: int) -> None:
        made.append((doc, start, length, sequence, int(sizes[sequence] - room[sequence])))
        room[sequence] -= length
        spent[sequence] += cost(length)

    for length in range(max(waiting, default=0), 0, -1):  # rests are shorter than what they are cut from
        for doc, start in waiting.pop(length, ()):
            fits = room >= length
            if fits.any():
                place(doc, start, length, int(np.argmin(np.where(fits, spent, np.inf))))
            else:
                roomiest = int(np.argmax(room))
                part = int(room[roomiest])
                place(doc, start, part, roomiest)
                waiting.setdefault(length - part, []).append((doc, start + part))
    return made


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``;
    with ``with_ids`` also ``ids`` (binary, little-endian unsigned 32-bit integers)."""
    with open(path, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())] * with_ids)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(definition.value)
        next_id = TaskContext.get().partitionId() << 40
        group: list[tuple[int, int, memoryview, int]] = []  # doc_id, start, ids, tokens of the document
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal next_id, group, held
            rows = []
            used = 0
            for index, start, length, sequence, offset in pack([len(g[2]) // 4 for g in group], capacity):
                doc_id, before, ids, doc_tokens = group[index]
                piece = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, before + start, length, zlib.crc32(piece), doc_tokens, next_id + sequence, offset) + ((bytes(piece),) if with_ids else ()))
                used = max(used, sequence + 1)
            next_id += used
            group, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(*batch.to_pydict().values()):
                ids = memoryview(words.encode(text or "") + end)
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    group.append((doc_id, start, ids[4 * start : 4 * (start + capacity)], tokens))
                    held += len(group[-1][2]) // 4
                    if held >= group_tokens:
                        yield packed()
        if group:
            yield packed()
        words.clear()  # the worker goes on to other tasks

    ddl = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)
