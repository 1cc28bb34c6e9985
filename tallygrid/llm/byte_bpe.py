"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, at places where the pattern cannot match across: after a
character that is no white space and before a blank or line end. No alternative of the pattern goes
from one to the other, and its only look-ahead concerns white space, so the matches on both sides
stay what they were. Within a stretch without such a place, long runs of white space (which exhaust
the stack of the pattern's engine) are matched by rule: the run but its last character, then the
rest. Decoding joins raw bytes, so it also returns bytes that are no text on their own.

Defined cases: a null text is the empty text, which has no tokens; repeated rows and ties are encoded each
by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.common import by_batch

#: texts are encoded in parts of about so many characters
PART_CHARS = 65_536
#: runs of white space of at least this length are matched by rule
LONG_RUN = 1_000

# fixed value: the characters with the Unicode property White_Space
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# other engines also count these as white space, so no cut follows them
DOUBTFUL = r"\x1c-\x1f\u180e\u200b\ufeff"
SAFE_CUT = re.compile(f"[^{SPACES}{DOUBTFUL}](?=[ \n])")
SPACE_RUN = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")


def parts(text: str, size: int = PART_CHARS):
    """Parts of the text, cut only at safe places at or after each ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size - 1)
        if cut is None or cut.end() >= len(text):
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


def encode_text(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text."""
    ids: list[int] = []
    for part in parts(text):
        start = 0
        for run in SPACE_RUN.finditer(part) if len(part) >= LONG_RUN else ():
            ids += encoding.encode_ordinary(part[start : run.start()])
            start = run.end() if run.end() == len(part) else run.end() - 1
            ids += encoding._core_bpe.encode_single_piece(part[run.start() : start].encode())
        ids += encoding.encode_ordinary(part[start:] if start else part)
    return ids


def decode_ids(encoding: tiktoken.Encoding, ids: list[int]) -> bytes:
    return encoding.decode_bytes(ids)


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; the driver reads them and sends them to the tasks."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def encoding_of(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _run(docs: DataFrame, column: str, path: str, pattern: str, function, schema: pa.Schema, ddl: str, id_col: str) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def rows(columns: dict[str, list]) -> dict[str, list]:
        encoding = encoding_of(ranks.value, pattern)
        made = [function(encoding, value) for value in columns["_value"]]
        return {"doc_id": columns["doc_id"]} | {name: [m[i] for m in made] for i, name in enumerate(schema.names[1:])}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).alias("_value")).mapInArrow(by_batch(rows, schema), ddl)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every text."""

    def one(encoding, text):
        ids = encode_text(encoding, text or "")
        return len(ids), np.array(ids, dtype="<u4").tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return _run(docs, text_col, path, pattern, one, schema, "doc_id long, n_tokens long, ids binary", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded``, the raw bytes of every row of ids; null ids give no bytes."""

    def one(encoding, ids):
        return (decode_ids(encoding, np.frombuffer(ids or b"", dtype="<u4").tolist()),)

    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])
    return _run(encoded, ids_col, path, pattern, one, schema, "doc_id long, decoded binary", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: ``n_tokens``, and the SHA-256 of the ids and of the decoded bytes."""

    def one(encoding, text):
        ids = encode_text(encoding, text or "")
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        return len(ids), digest, hashlib.sha256(decode_ids(encoding, ids)).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _run(docs, text_col, path, pattern, one, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col)
