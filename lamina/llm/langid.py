"""Language ID by bit-sliced Bloom filters.

One table of bit masks holds a Bloom filter for every language: bit l of a row belongs to language l, so
that the conjunction of the rows at an n-gram's hash positions has a bit for each language that
contains it. A text's distinct n-grams (a phrase that is repeated a thousand times counts once) are counted
for every language at once; each count is corrected for the false positives that the fill of the
language's bits predicts, n-grams of few languages weigh more, and the largest corrected share decides.

The filters hold, for every language, all n-grams of its sample that no other language has `RATIO` times as often;
`fit` can be told another ratio, or to hold the most frequent ones alone (whole frequencies, `grams` n-grams at
most). Their effect on held-out documents is in the README. The sample is bounded: `FIT_ROWS` labelled rows, about,
are picked by a hash of doc_id, so what is fitted does not grow with the input. Prediction covers every whole text
and sees the text alone.

Defined cases: `und` with score 0 for a null text, a text without letters, or if nothing was learned; a text with
letters of whose n-grams no filter has any gets the language whose name sorts first, with score 0; rows without a
lang teach nothing, nor do rows without a doc_id, which cannot be told to be no held-out ones; equal texts get
equal results; an empty table gives no rows; other columns are ignored or, by `keep`, passed on. Equal shares go to
the language whose name sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import ALL_ROWS, batch, cut, map_batches, mix

#: Labelled rows to fit on, at most, but for the chance of the sampling hash.
FIT_ROWS = 20_000
#: A language does not hold what another has this many times as often.
RATIO = 4
#: Rows of the table at least, rows for each held n-gram of a language, and hash positions of an n-gram.
ROWS = 1 << 18
SPACE = 16
HASHES = 3
#: Bytes in an n-gram.
WIDTH = 4
#: Bytes of text that are counted together.
GROUP = 1 << 19
UNKNOWN = "und"
#: Texts whose best language has a smaller share are taken for no language by `keep`.
LEAST_SCORE = 0.3

_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become spaces.
_CLEAN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_END = b"\x01"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, lower-cased and with single spaces around words, and the text each is from."""
    joined = _END.join(b" " + x.lower().encode("utf-8", "replace").translate(_CLEAN) + b" " for x in texts)
    data = np.frombuffer(joined + _END, dtype=np.uint8)
    data = data[np.concatenate(([True], (data[1:] != 0x20) | (data[:-1] != 0x20)))].astype(np.uint32)
    ends = data == 1
    text = np.cumsum(ends)
    n = len(data) - WIDTH + 1
    grams, bad = np.zeros(max(n, 0), dtype=np.uint32), np.zeros(max(n, 0), dtype=bool)
    for i in range(WIDTH if n > 0 else 0):
        grams = grams << np.uint32(8) | data[i : i + n]
        bad |= ends[i : i + n]
    both = np.unique(text[: max(n, 0)][~bad].astype(np.uint64) << np.uint64(32) | grams[~bad])
    return both.astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for x in texts:
        group.append(x or "")
        size += len(group[-1])
        if size > GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


@dataclass
class Filters:
    """The bit-sliced filters: masks of as many rows, a power of two, and a word for every 64 languages."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray

    @staticmethod
    def positions(grams: np.ndarray, rows: int) -> list[np.ndarray]:
        mixed = mix(grams.astype(np.uint64) + np.uint64(1))
        return [((mixed >> np.uint64(20 * i)) & np.uint64(rows - 1)).astype(np.int64) for i in range(HASHES)]

    @classmethod
    def build(cls, held: dict[str, np.ndarray]) -> Filters:
        languages = sorted(held)
        rows = max(ROWS, 1 << (SPACE * max(map(len, held.values()), default=0) - 1).bit_length())
        masks = np.zeros((max(1, -(-len(languages) // 64)), rows), dtype=np.uint64)
        for i, name in enumerate(languages):
            for at in cls.positions(held[name], rows):
                masks[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
        filled = [np.count_nonzero(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / rows for i in range(len(languages))]
        if len(languages) <= 8:
            masks = masks.astype(np.uint8)
        return cls(languages, masks, np.array(filled) ** HASHES)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each text's n-grams, and of those that each language contains, corrected for false positives.

        An n-gram that m of L languages contain weighs (L - m) / (L - 1): what all contain says nothing.
        """
        grams, text = _grams(texts)
        at = self.positions(grams, self.masks.shape[1])
        found = [rows[at[0]] & rows[at[1]] & rows[at[2]] for rows in self.masks]
        many = len(self.languages)
        holders = np.sum([np.bitwise_count(x) for x in found], axis=0, dtype=np.int64)
        weight = (many - holders) / (many - 1) if many > 1 else np.ones(len(grams))
        total = np.bincount(text, weights=weight, minlength=len(texts))
        out = np.zeros((len(texts), many))
        for i in range(many):
            held = found[i // 64]
            hits = (held >> held.dtype.type(i % 64) & held.dtype.type(1)).astype(bool)
            out[:, i] = np.bincount(text[hits], weights=weight[hits], minlength=len(texts))
        return total, np.maximum(0, (out - total[:, None] * self.false) / (1 - self.false))


def fit(docs: DataFrame, rows: int = FIT_ROWS, grams: int | None = None, ratio: float = RATIO) -> Filters:
    """Filters from the rows of `docs` (doc_id, text, lang) that are not held out and have a lang.

    The driver gets the totals of the languages, their frequencies of n-grams and the n-grams that are held, all of
    them of the sample.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    n = known.count()
    parts = 1 << 62
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < min(parts, parts * rows // max(n, 1)))

    def run(batch_rows: pa.RecordBatch) -> pa.RecordBatch:
        names, found_grams, counts = [], [], []
        langs = np.array(batch_rows.column("lang").to_pylist())
        for name in sorted(set(langs.tolist())):
            own = batch_rows.column("text").filter(pa.array(langs == name)).to_pylist()
            found, many = np.unique(np.concatenate([_grams(group)[0] for group in _groups(own)]), return_counts=True)
            names += [name] * len(found)
            found_grams.append(found.astype(np.int64))
            counts.append(many)
        return batch(lang=names, gram=np.concatenate(found_grams), n=np.concatenate(counts))

    counted = cut(map_batches(sample.select("lang", "text"), run, "lang string, gram long, n long", ALL_ROWS).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    spark = docs.sparkSession
    totals = spark.createDataFrame([(r["lang"], r["total"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()], "lang string, total long")
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("share"))  # totals has a row for each language of the sample
    most = counted.join(F.broadcast(totals), "lang").groupBy("gram").agg(F.max(F.col("n") / F.col("total")).alias("most"))
    typical = cut(shares.join(most, "gram").filter(F.col("share") * ratio > F.col("most")).select("lang", "gram", "n"))
    least: dict[str, int] = {}
    if grams is not None:
        seen: dict[str, int] = {}
        for r in typical.groupBy("lang", "n").agg(F.count("*").alias("many")).orderBy("lang", F.desc("n")).toLocalIterator():
            seen[r["lang"]] = seen.get(r["lang"], 0) + r["many"]
            if seen[r["lang"]] <= grams:
                least[r["lang"]] = r["n"]
        bounds = spark.createDataFrame([*least.items()], "lang string, least long")
        typical = typical.join(F.broadcast(bounds), "lang").filter("n >= least")  # a row for each language
    held: dict[str, list[int]] = {}
    for row in typical.select("lang", "gram").toLocalIterator():
        held.setdefault(row["lang"], []).append(row["gram"])
    return Filters.build({name: np.array(found, dtype=np.uint32) for name, found in held.items()})


def _judged(filters: Filters, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for group in _groups(texts):
        if filters.languages:
            _, counts = filters.counts(group)
            best, sums = counts.argmax(axis=1), counts.sum(axis=1)
        for i, text in enumerate(group):
            if not filters.languages or not _LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                names.append(filters.languages[best[i]])
                scores.append(float(counts[i, best[i]] / sums[i]) if sums[i] else 0.0)
    return names, scores


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every text."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = _judged(filters, rows.column("text").to_pylist())
        return batch(doc_id=rows.column("doc_id"), lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, filters: Filters, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, in all their columns, whose text has a language with a score of `least` or more."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = _judged(filters, rows.column("text").to_pylist())
        return rows.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: filters fitted on the rows that are not held out, applied to all."""
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
