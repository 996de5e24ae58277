"""Quality rules with cross-document line frequency.

Base rules look at one text: too few words, or too many words in repeated three-word windows. The line
rule looks across documents: normalised lines are hashed, each line's distinct documents are counted
per host (the source), lines above the host's limit are removed, and a document that loses too much is
rejected.

Which documents are distinct is a parameter. By default (`equal_texts_once`) those of one host with equal texts count
once, so that copies of a clean document do not make its lines look like boilerplate; leaving one copy is
deduplication's work. Otherwise every row counts.

The limit is the larger of `LEAST` documents and `GROWTH` times the square root of the host's documents, so that it
grows slowly: a line in 150 of 2,000 documents is above it, as is one in a ten-thousandth of 10**9. A document is
depleted if less than `REMAINS` of its words are left.

Defined cases: a null text has no words and fails; a null source is a host of its own; a text of any
length counts whole; lines without a word are neither counted nor removed; rows are judged each on its own, whatever
their doc_id, so repeated rows get equal results and come out as often as they went in; a null doc_id is one more
value; an empty table gives no rows; other columns are ignored or, by `clean`, passed on, but for names that start
with two underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm._common import batch, cut, map_batches, salted_join, shingles, utf8, word_hashes

LEAST_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
LEAST = 20
GROWTH = 2
REMAINS = 0.3

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normalised(line: bytes) -> bytes:
    """A line without its case (of ASCII letters) and with single spaces between its words."""
    return b" ".join(line.lower().split())


def _line_hash(line: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(line)
    return value - (1 << 64) if value >> 63 else value


def repeated(words: list[bytes]) -> int:
    """Words inside windows of three that the text has twice or more."""
    windows = shingles(word_hashes(words), WINDOW)
    if len(windows) < 2:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    often = counts[back] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(WINDOW):
        covered[i : i + len(often)] |= often
    return int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, host, text_key, the base statistics, and the distinct normalised lines of every
    row with their words. Cut it before it is used more than once: the numbers are given anew each time."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        stats, lines, counts = [], [], []
        for text in utf8(rows.column("text")):
            words = text.split()
            seen: set[bytes] = set()
            dup, own = 0, {}
            for line in text.split(b"\n"):
                parts = line.lower().split()
                if parts:
                    dup += line in seen
                    seen.add(line)
                    key = _line_hash(b" ".join(parts))
                    own[key] = own.get(key, 0) + len(parts)
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            characters = len(b"".join(words).decode("utf-8", "replace"))
            stats.append((len(words), characters, symbols, dup, repeated(words)))
            lines.append([*own])
            counts.append([*own.values()])
        columns = {name: pa.array(x, pa.int64()) for name, x in zip(STATS, zip(*stats, strict=True), strict=True)}
        kept = {name: rows.column(name) for name in ("doc_id", "host", "text_key")}
        return batch(**kept, **columns, lines=pa.array(lines, pa.list_(pa.int64())), line_words=pa.array(counts, pa.list_(pa.int64())))

    schema = "doc_id long, host long, text_key long, " + ", ".join(f"{x} long" for x in STATS) + ", lines array<long>, line_words array<long>"
    rows = docs.select("doc_id", F.xxhash64("source").alias("host"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(rows, run, schema).withColumn("row", F.monotonically_increasing_id())


def frequent_lines(measured: DataFrame, least: int = LEAST, growth: int = GROWTH, equal_texts_once: bool = True) -> DataFrame:
    """place (of host and line): the lines above the host's limit of distinct documents."""
    if equal_texts_once:
        firsts = measured.groupBy("host", "text_key").agg(F.min("row").alias("row"))
        sizes = firsts.groupBy("host").agg(F.count("*").alias("n"))
        once = measured.join(firsts.select("row"), "row", "left_semi")
    else:
        sizes, once = measured.groupBy("host").agg(F.count("*").alias("n")), measured
    counted = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    return counted.filter(F.col("docs") > least).join(sizes, "host").filter(F.col("docs") * F.col("docs") > growth * growth * F.col("n")).select(place())


def place() -> Column:
    """A line on its host, as one number."""
    return F.xxhash64("host", "line").alias("place")


def judge(measured: DataFrame, equal_texts_once: bool = True) -> DataFrame:
    """The rows of `measure` without their lines, with base_failed, kept and the lines to remove (null if none)."""
    frequent = cut(frequent_lines(measured, equal_texts_once=equal_texts_once))
    each = measured.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    met = salted_join(each.select("row", "line", "words", place()), frequent, "place", "row", "left_semi")
    removed = met.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = measured.drop("lines", "line_words").join(removed, "row", "left").withColumn("base_failed", failed)
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return out.withColumn("kept", ~F.col("base_failed") & (left >= REMAINS * F.col("n_words")))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept."""
    return judge(cut(measure(docs))).select("doc_id", *STATS, "base_failed", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The rows that are kept, in all their columns, without the lines above the limit.

    Rows meet their verdict by doc_id, source and text, of which equal rows have one verdict.
    """
    verdicts = judge(cut(measure(docs))).filter("kept").select(F.coalesce("doc_id", F.lit(0)).alias("__doc"), F.col("doc_id").isNull().alias("__none"), F.col("host").alias("__host"), F.col("text_key").alias("__text"), F.col("removed_lines").alias("__lines"))
    keys = ["__doc", "__none", "__host", "__text"]
    once = verdicts.groupBy(*keys).agg(F.first("__lines").alias("__lines"))
    keyed = docs.withColumns({"__doc": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__host": F.xxhash64("source"), "__text": F.xxhash64("text")})
    joined = keyed.join(once, keys).select(*docs.columns, "__lines")
    names = docs.columns
    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema.fields])

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts, n = [], []
        for text, removed in zip(utf8(rows.column("text")), rows.column("__lines").to_pylist(), strict=True):
            if removed:
                drop = {*removed}
                text = b"\n".join(x for x in text.split(b"\n") if not x.split() or _line_hash(normalised(x)) not in drop)
            texts.append(text.decode())
            n.append(len(texts[-1]))
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(n, pa.int64())}
        return batch(**{name: new.get(name, rows.column(name)) for name in names})

    return map_batches(joined, run, schema)
