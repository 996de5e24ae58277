"""Best-fit packing, planned over a histogram of lengths.

Documents become token sequences that are cut at the capacity. Best-fit decreasing runs over the
counts of the lengths, not over documents: sequences with the same free space are runs of ids, and one
step places many pieces of a length. A length's step takes whole runs, splits at most one and opens at
most one, and a run that is taken loses at least half of its free space, so the plan has at most
`capacity * 3 * (log2(capacity) + 1)` rows whatever the number of documents. Pieces then take the
planned slots by their rank within their length. Ranks come from counts by (length, bucket), so that a
length that most pieces share is dealt over as many buckets as it needs: buckets hold the larger of `RANKED`
pieces and the square root of the length's, so that there are as few buckets to sum up as pieces to rank in one.

Ids are those of the plain library call: a special token's string in a text is its id. With `literal` such strings
are ordinary text, as text that is not trusted needs it.

Defined cases: a null or empty text is the closing id alone; a text longer than the capacity is cut,
the last piece may be shorter; equal rows are packed each on its own, and rows of one doc_id, or of none, need not be
equal; an empty table gives no rows; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm._common import batch, cut, map_batches, utf8

CAPACITY = 2048
#: The id that closes each document.
CLOSING = b"\0\0\0\0"
#: Chunks that a Python worker remembers before it starts afresh.
CACHE_CHUNKS = 300_000
#: Longer chunks are not remembered.
CACHE_LENGTH = 96
#: Bytes of text that are encoded together.
GROUP = 1_000_000
#: Ends a pre-token inside the engine; texts that have it go to the tokenizer.
MARK = "\u07ff"
#: The parts of a tokenizer file that this encoder stands in for.
SUFFIX = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_PRE_TOKEN = regex.compile(PATTERN.replace(r"\s", r"\t-\r \x85\xa0"))
#: Characters whose normalisation is left to the tokenizer.
_OTHER = regex.compile("[^\\x00-\u012f\u0131-\u017f]")
#: Pieces of one length that are ranked together, on average, at least.
RANKED = 500


class _Encoder:
    """Ids of chunks between ASCII white space, which no pre-token of the tokenizer crosses.

    Chunks of the characters below U+0180 are normalised and cut here and merged by a byte-pair engine that
    picks a pair by the rank of its concatenation. That equals the tokenizer's merges, which go by pairs,
    if the tokenizer makes every token of the vocabulary from its own characters; this is checked, and
    otherwise, as for other characters, the tokenizer itself is asked.
    """

    def __init__(self, path: str, literal: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.cache: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [a + b for a, b in (x if isinstance(x, list) else x.split(" ") for x in merges)]
        self.engine = None
        added = [] if literal else [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = re.compile("|".join(added) or r"(?!)")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            return
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or spec["model"]["end_of_word_suffix"] != SUFFIX:
            return
        if any([x.id for x in self.tokenizer.model.tokenize(token.removesuffix(SUFFIX))] != [vocabulary[token]] for token in merges if token.endswith(SUFFIX)):
            return
        to_byte = {c: b for b, c in enumerate(_byte_characters())}

        def raw(token: str) -> bytes:
            core = token.removesuffix(SUFFIX)
            return bytes(to_byte[c] for c in core) + MARK.encode() * (core != token)

        characters = _byte_characters()
        order = [*characters, None, *(c + SUFFIX for c in characters), *merges]
        ranks = {MARK.encode() if token is None else raw(token): i for i, token in enumerate(order)}
        if len(ranks) != len(order) or any(token not in vocabulary for token in order if token):
            return
        self.ids = np.array([0 if token is None else vocabulary[token] for token in order], dtype="<u4")
        self.engine = tiktoken.Encoding("words", pat_str=f"[^ {MARK}]+{MARK}| ", mergeable_ranks=ranks, special_tokens={})

    def chunks(self, new: list[bytes]) -> list[bytes]:
        """Packed ids of each chunk."""
        texts = [x.decode() for x in new]
        out: list[bytes] = [b""] * len(new)
        plain = [i for i, x in enumerate(texts) if self.engine and not _OTHER.search(x) and not self.special.search(x)]
        if plain:
            marked = (x + MARK if (x := texts[i].lower()).isalpha() else "".join(y + MARK for y in _PRE_TOKEN.findall(x)) for i in plain)
            ranks = np.array(self.engine.encode_ordinary(" ".join(marked)), dtype=np.int64)
            packed, ends = self.ids[ranks].tobytes(), [*np.flatnonzero(ranks == ord(" ")).tolist(), len(ranks)]
            at = 0
            for i, end in zip(plain, ends, strict=True):
                out[i] = packed[4 * at : 4 * end]
                at = end + 1
        if len(plain) < len(new):
            done = {*plain}
            rest = [i for i in range(len(new)) if i not in done]
            for i, found in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each UTF-8 text, without the closing id."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache, rows = self.cache, [text.split() for text in texts]
        if new := [*set().union(*rows).difference(cache)]:
            cache.update(zip(new, self.chunks(new), strict=True))
        out = [b"".join(map(cache.__getitem__, row)) for row in rows]
        for x in new:
            if len(x) > CACHE_LENGTH:
                del cache[x]
        return out


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next above U+00FF."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + others.index(b)) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str, literal: bool = False) -> _Encoder:
    return _Encoder(path, literal)


def _encoded(own: _Encoder, texts: list[bytes]) -> Iterator[bytes]:
    """Packed ids of the texts, a few at a time."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > GROUP:
            yield from own.encode(group)
            group, size = [], 0
    yield from own.encode(group)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, literal: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids with the closing id, cut at `capacity`."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int, int]] = []
        for doc, found in zip(rows.column("doc_id").to_pylist(), _encoded(encoder(path, literal), utf8(rows.column("text"))), strict=True):
            ids = found + CLOSING
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        doc, k, start, length, crc = zip(*out, strict=True)
        return batch(doc_id=pa.array(doc, pa.int64()), piece=pa.array(k, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over the counts of the lengths (1 to `capacity`).

    Rows (length, first rank, sequence, pieces per sequence, offset), ordered by length and rank: the
    piece of that length and rank r goes to `sequence + (r - first) // per`, at `offset + (r - first) %
    per * length`.
    """
    runs: dict[int, list[list[int]]] = {}  # free space: runs of sequences, as [first, how many]
    spaces: list[int] = []  # the free spaces there are, ascending
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in runs:
                runs[space] = []
                insort(spaces, space)
            runs[space].append([first, many])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    del spaces[at]
            else:
                space = capacity
                first, many = opened, -(-left // (space // length))
                opened += many
            per = space // length
            whole = min(many, left // per)
            used = whole * per
            if whole:
                rows.append((length, rank, first, per, capacity - space))
                put(space - per * length, first, whole)
            if whole < many and used < left:  # the rest goes to one more sequence
                rest = left - used
                rows.append((length, rank + used, first + whole, rest, capacity - space))
                put(space - rest * length, first + whole, 1)
                used, whole = left, whole + 1
            put(space, first + whole, many - whole)
            rank, left = rank + used, left - used
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, literal: bool = False) -> DataFrame:
    """Every piece of every text with its sequence and its offset there."""
    all_pieces = cut(pieces(docs, path, capacity, literal))
    counts = {r["length"]: r["n"] for r in all_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(counts, capacity)
    buckets = docs.sparkSession.createDataFrame([(length, -(-n // max(RANKED, math.isqrt(n)))) for length, n in counts.items()], "length long, _buckets long")
    dealt = all_pieces.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_buckets"))).drop("_buckets")
    per_bucket = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_within", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_within")).cast("long").alias("_rank"))
    keys = slots[:, 0] << 44 | slots[:, 1]

    def place(rows: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = rows.column("length").to_numpy(), rows.column("_rank").to_numpy()
        slot = slots[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
        nth = rank - slot[:, 1]
        return batch(**{n: rows.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}, sequence_id=slot[:, 2] + nth // slot[:, 3], offset=slot[:, 4] + nth % slot[:, 3] * length)

    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
