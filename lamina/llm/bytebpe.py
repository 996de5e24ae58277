"""Byte-level BPE through sentencepiece.

A rank vocabulary becomes a sentencepiece BPE model: every token's bytes are mapped to characters one
to one, the score of a piece is its negative rank and normalisation is the identity, so that the
merges sentencepiece prefers are those of lowest rank, leftmost first. A text is cut into pre-tokens
by the vocabulary's pattern, each is encoded alone. Ids are decoded through the model: their pieces are joined and
the characters mapped back to bytes.

Defined cases: a null or empty text has no ids; a text of any length is encoded whole; repeated rows
and equal texts get equal results, with whatever doc_id; an empty table gives no rows; columns beyond the id and the
text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from lamina.llm._common import batch, map_batches

#: Chunks that a Python worker remembers before it starts afresh.
CACHE_CHUNKS = 300_000
#: Longer chunks are not remembered.
CACHE_LENGTH = 64
#: Code points that are encoded together.
GROUP = 1_000_000
#: Unicode's white space, as the class that \s stands for in a pattern.
WHITE = r"\t-\r \x85\xa0  -     　"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"

_TO_CHARACTER = {i: chr(0x100 + i) for i in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """One protocol-buffer field: bytes are length-delimited, an int is a varint."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def mapped(data: bytes) -> str:
    """Bytes as characters, one for each byte, none of which is white space."""
    return data.decode("latin-1").translate(_TO_CHARACTER)


def unmapped(text: str) -> bytes:
    """The bytes that `mapped` makes the text of: each character's low byte, as the others have one high byte."""
    return text.encode("utf-16-le")[::2]


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks, which must run from 0 without gaps.

    The piece for unknown characters follows the last rank; it never occurs, as all bytes have ranks.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind))

    pieces = [piece(mapped(token), -rank, normal) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(2, _field(3, bpe))
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join([*pieces, piece("<unk>", 0.0, unknown), trainer, normaliser])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _loose(chunk: str) -> bool:
    """Whether the chunk is empty or has white space beside the spaces that it was cut at."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class Codec:
    """Encodes and decodes by the ranks of a vocabulary and the pattern of its pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.characters = self.model.id_to_piece([*range(len(ranks))])
        self.cache: dict[str, bytes] = {}

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, each match of the pattern encoded separately."""
        found = [self.pattern.findall(x) for x in texts]
        ids = iter(self.model.encode([mapped(x.encode("utf-8", "surrogatepass")) for row in found for x in row], num_threads=1))
        return [np.array([i for _ in row for i in next(ids)], dtype="<u4").tobytes() for row in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A text splits before its spaces without a change of the pre-tokens if no space touches other
        white space, as a space then belongs to what follows; chunks seen before are looked up. Other
        texts are matched as a whole.
        """
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache = self.cache
        rows = [[parts[0], *(" " + x for x in parts[1:])] if not any(map(_loose, {*(parts := text.split(" "))})) else [text] for text in texts]
        if new := [*set().union(*rows).difference(cache)]:
            cache.update(zip(new, self.pieces(new), strict=True))
        out = [b"".join(map(cache.__getitem__, row)) for row in rows]
        for x in new:
            if len(x) > CACHE_LENGTH:
                del cache[x]
        return out

    def decode(self, ids: bytes) -> bytes:
        return unmapped("".join(map(self.characters.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _encoded(own: Codec, column: pa.Array) -> Iterator[bytes]:
    """Packed ids of the texts of a column, a few texts at a time."""
    group: list[str] = []
    size = 0
    for text in column.to_pylist():
        group.append(text or "")
        size += len(group[-1])
        if size > GROUP:
            yield from own.encode(group)
            group, size = [], 0
    yield from own.encode(group)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) and decoded bytes of every text."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path, pattern)
        ids = [*_encoded(own, rows.column("text"))]
        return batch(doc_id=rows.column("doc_id"), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()), decoded=pa.array([own.decode(x) for x in ids], pa.binary()))

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As `round_trip`, with SHA-256 digests in place of the ids and bytes, made where they are."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        own, n, first, second = codec(path, pattern), [], [], []
        for ids in _encoded(own, rows.column("text")):
            n.append(len(ids) // 4)
            first.append(hashlib.sha256(ids).hexdigest())
            second.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return batch(doc_id=rows.column("doc_id"), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(first, pa.string()), decoded_sha256=pa.array(second, pa.string()))

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
