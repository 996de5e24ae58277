"""Document fingerprints by spot signatures.

An anchor is a common word. Each anchor starts a chain: the anchor and the next content words (those
that are no anchors), `CHAIN` of them or as many as are left, at least one. A text's fingerprint is the
set of its hashed chains, in a text form that is equal for equal sets. Likeness is the Jaccard
coefficient of two sets; the sizes bound it, so pairs whose sizes differ too much are given up before the
sets are compared, and near pairs are sought only between partitions of near set lengths.

Where no anchor is within `SPARSE` words on either side (tables, junk, unknown languages) every word is
an anchor; the rule is local, so an edit changes signatures near it alone. A text without any chain has one signature
of the whole text. An empty text has the empty fingerprint; two empty fingerprints have likeness 1, an
empty and another 0.

`compare` returns the exact coefficient of each text with its edited form and with the next text, which are two
comparisons a row; the search by partitions and prefixes is `near_pairs`.

Defined cases: a null text is empty; texts of any length count whole; repeated rows have equal
fingerprints and follow each other; rows are ordered by doc_id, nulls first, then by a hash of the text, so that very
many rows of one doc_id, or of none, are parted as well; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import batch, cut, map_batches, mix, ship, tidy, word_hashes

CHAIN = 3
SPARSE = 12
#: Rows of a part when documents are put in order, on average, and parts at most; larger tables have larger parts.
ORDERED = 8_000
PARTS = 1 << 15
#: Counters of how many sets have a signature, whatever the input.
SKETCH = 1 << 16
#: Common words that may start a chain.
ANCHORS = (
    "a an and are be by for from had has he in is it of on that the this to was with "
    "als auf aus das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al con del el las lo los no para por se su una y"
).split()

_ANCHORS = np.unique(word_hashes([x.encode() for x in ANCHORS]))
#: Bytes that end words: ASCII other than letters and digits.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def signatures(text: str) -> np.ndarray:
    """The sorted distinct 32-bit signatures of a text."""
    words = word_hashes(text.lower().encode("utf-8", "replace").translate(_WORDS).split())
    if not text:
        return np.empty(0, dtype=np.uint32)
    at = np.searchsorted(_ANCHORS, words)
    anchor = _ANCHORS[np.minimum(at, len(_ANCHORS) - 1)] == words
    before = np.concatenate(([0], np.cumsum(anchor)))
    place = np.arange(len(words))
    near = before[np.minimum(place + SPARSE + 1, len(words))] - before[np.maximum(place - SPARSE, 0)]
    start = anchor | (near == 0)
    content = np.flatnonzero(~anchor)
    starts = np.flatnonzero(start)
    first = np.searchsorted(content, starts, side="right")
    starts, first = starts[first < len(content)], first[first < len(content)]
    if not len(starts):
        return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 32], dtype=np.uint32)
    chain = words[starts]
    padded = np.concatenate((words[content], np.zeros(CHAIN, dtype=np.uint64)))
    for i in range(CHAIN):
        chain = mix(chain + padded[first + i] * np.uint64(2 * i + 1))
    return np.unique((chain >> np.uint64(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    """The set as text: eight hexadecimal digits for every signature, in ascending order."""
    return found.astype(">u4").tobytes().hex()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def likeness(one: np.ndarray, other: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard coefficient of two sorted sets; 0 if the sizes alone put it below `least`."""
    small, large = sorted((len(one), len(other)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (small + large - both)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many code points of the following text."""
    many = len(text) // 4
    return text[: len(text) - many] + following[:many]


@dataclass
class _Parts:
    """Which part a row of (id, hash) falls in: by bounds of ids, and where one id fills several parts, by its hash."""

    bounds: np.ndarray
    shares: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, quantiles: list[int]) -> _Parts:
        """An id that is several quantiles gets a range of its own, of as many parts as it has quantiles, and one."""
        many = Counter(quantiles)
        bounds = np.array(sorted({*many, *(x + 1 for x, n in many.items() if n > 1)}), dtype=np.int64)
        shares = np.ones(len(bounds) + 1, dtype=np.int64)
        for x, n in many.items():
            if n > 1:
                shares[np.searchsorted(bounds, x, side="right")] = n + 1
        return cls(bounds, shares, np.concatenate(([0], np.cumsum(shares))))

    def part(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, ids, side="right")
        place = (hashes.astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of the signed hash
        return self.before[at] + (place.astype(np.int64) * self.shares[at] >> 32)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, _part, _extra: parts of rows in the order of doc_id, each followed by the rows that the
    next part (after the last, the first) begins with, marked as extra. Rows of a part are together and sorted.

    The driver holds a bound and the first row's doc_id and hash for each part, of which there are about `PARTS` at most.
    """
    low = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(low)).alias("_id")).withColumn("_hash", F.xxhash64("text"))
    parts = min(PARTS, max(1, -(-rows.count() // ORDERED)))
    quantiles = [int(x) for x in rows.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    own = _Parts.of([min(x, (1 << 63) - 2) for x in quantiles])

    @F.pandas_udf("int")
    def part(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(own.part(ids.to_numpy(), hashes.to_numpy()))

    firsts = sorted((r["part"], r["first"]["_id"], r["first"]["_hash"]) for r in rows.select("_id", "_hash").groupBy(part("_id", "_hash").alias("part")).agg(F.min(F.struct("_id", "_hash")).alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, *first) in enumerate(firsts) for first in [tuple(first)]}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Twice the part, and for a first row also twice the part before it and one."""
        at = own.part(ids.to_numpy(), hashes.to_numpy()).tolist()
        return pd.Series([[2 * p, 2 * before[x] + 1] if x in before else [2 * p] for p, x in zip(at, zip(ids.tolist(), hashes.tolist(), strict=True), strict=True)])

    dealt = rows.withColumn("_to", F.explode(places("_id", "_hash"))).select("doc_id", "text", "_id", "_hash", F.shiftright("_to", 1).alias("_part"), (F.col("_to") % 2).alias("_extra"))
    return dealt.repartitionById(int(own.before[-1]), F.col("_part")).sortWithinPartitions("_part", "_extra", "_id", "_hash", "text").select("doc_id", "text", "_part", "_extra")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """Each document of the batches with the text of the next."""
    last, closed = None, None
    for rows in batches:
        for doc, text, part, extra in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
            if last is not None and last[2] == part and closed != part:
                yield last[0], last[1], text
            closed = part if extra else closed
            last = (doc, text, part)


def compare(docs: DataFrame) -> DataFrame:
    """For every text its fingerprint, its edited text's, and its likeness to that and to the next text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, ahead = [], 0, (None, None)
        for doc, text, following in _pairs(batches):
            own = ahead[1] if ahead[0] == text else signatures(text)
            ahead = (following, signatures(following))
            new = edited(text, following)
            changed = signatures(new)
            out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, ahead[1])))
            size += len(text)
            if size > 4_000_000:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)
        tidy()

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc, n, digest, own, changed, near, following = zip(*out, strict=True)
    return batch(
        doc_id=pa.array(doc, pa.int64()), n_chars=pa.array(n, pa.int64()), edited_sha256=pa.array(digest, pa.string()), fingerprint=pa.array(own, pa.string()),
        edited_fingerprint=pa.array(changed, pa.string()), near_edited=pa.array(near, pa.float64()), near_next=pa.array(following, pa.float64()),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_signatures, fingerprint of every text."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [signatures(x or "") for x in rows.column("text").to_pylist()]
        return batch(doc_id=rows.column("doc_id"), n_signatures=pa.array(map(len, found), pa.int64()), fingerprint=pa.array(map(fingerprint, found), pa.string()))

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_signatures long, fingerprint string")


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b, likeness: representatives (the smallest doc_id of each fingerprint) whose likeness is `least` or more.

    Lengths fall into partitions whose bounds grow by the factor 1 / least, so that the partner of a set
    is in its own or a neighbouring partition. Within two such partitions, sets are joined on the
    signatures of a prefix that near sets must share, in one order for all: rare signatures first, by a sketch of how
    many sets have them, so that what very many share is not posted. Join the result to
    `fingerprints` on the fingerprint for the copies of each representative. Empty texts and rows without a doc_id take
    no part. All pairs of a group of like texts are returned, so their number grows with its square.
    """
    own = cut(fingerprints(docs.filter(F.col("doc_id").isNotNull())).filter("n_signatures > 0"))
    firsts = own.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("n_signatures").alias("n"))
    step = float(np.log(1 / least))
    sized = firsts.withColumn("_class", F.floor(F.log(F.col("n")) / step).cast("int"))

    def sketched(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(x) for x in rows.column("fingerprint").to_pylist()]
        counts = np.bincount(np.concatenate(found) % SKETCH, minlength=SKETCH)
        return batch(counter=np.flatnonzero(counts), n=counts[np.flatnonzero(counts)])

    common = np.zeros(SKETCH, dtype=np.int64)
    for r in map_batches(sized.select("fingerprint"), sketched, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():  # SKETCH rows at most
        common[r["counter"]] = r["n"]

    def posted(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, ns, classes = [], [], [], []
        for doc, text, n, kind in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
            found = parse(text)
            prefix = found[np.lexsort((found, common[found % SKETCH]))][: n - int(np.ceil(least * n - 1e-9)) + 1]
            ids += [doc] * len(prefix)
            keys += prefix.tolist()
            ns += [n] * len(prefix)
            classes += [kind] * len(prefix)
        return batch(id=pa.array(ids, pa.int64()), key=pa.array(keys, pa.int64()), n=pa.array(ns, pa.int64()), kind=pa.array(classes, pa.int32()))

    posts = cut(map_batches(sized.select("id", "fingerprint", "n", "_class"), posted, "id long, key long, n long, kind int"))
    one, other = posts.select(F.col("id").alias("a"), "key", F.col("n").alias("n_a"), F.col("kind").alias("_to")), posts.select(F.col("id").alias("b"), "key", F.col("n").alias("n_b"), F.explode(F.array("kind", F.col("kind") + 1)).alias("_to"))
    pairs = one.join(other, ["key", "_to"]).filter((F.col("a") != F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")))
    distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = firsts.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa")), firsts.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb"))

    def compared(rows: pa.RecordBatch) -> pa.RecordBatch:
        near = [likeness(parse(x), parse(y), least) for x, y in zip(rows.column("fa").to_pylist(), rows.column("fb").to_pylist(), strict=True)]
        keep = pa.array([x >= least for x in near], pa.bool_())
        return batch(a=rows.column("a").filter(keep), b=rows.column("b").filter(keep), likeness=pa.array(near, pa.float64()).filter(keep))

    return map_batches(distinct.join(left, "a").join(right, "b").select("a", "b", "fa", "fb"), compared, "a long, b long, likeness double")
