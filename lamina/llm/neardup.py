"""Near-duplicate documents by an inverted join of MinHash coordinates.

A document's set is its distinct five-word shingles. Equal sets form a class, which is a node with the number and the
text of its smallest doc_id (where texts share a doc_id, all nodes are numbered anew). Copies tend to be younger than
what they were made from, so that node is like more others than one picked at random. Every node has a signature of `COORDINATES` minima. A pair of signatures that agree in at least
m coordinates (`MATCHES`) must agree in one of the `COORDINATES - m + 1` rarest of either, for any
fixed order of the values, so a node is posted under these coordinate-value pairs alone (prefix); the
order puts values that many nodes share last, so that what long lists would add is skipped and only
counted on the signatures. Pairs with enough matches are confirmed on the full sets, exactly, with
integers.

Work on dense groups stays linear: the first round pairs each list's smallest node with the others and
joins what is confirmed into components. The second round looks only at lists that still hold several
components and pairs every two nodes of different ones that have not been compared yet, in blocks of
`BLOCK` nodes, or less where sets are large; it leaves no candidate out. Sizes and signatures rule out pairs there. In lists of over `DENSE` nodes,
where most candidates of a group of loose copies would just miss the threshold, nodes bring their sets along, as
32-bit hashes, and a pair leaves the block only if these sets do not rule it out (two shingles with one hash can
only make sets look more alike than they are, which is allowed for). So what is joined with texts and confirmed is
little more than the links.

What is known of a list (its smallest node, its labels, its length) is aggregated and joined back, so no list
has to fit a task; joins on keys that may be hot (a list, the smallest node of many lists, a class, a component) are
salted.

`MATCHES` has a number for each threshold, 85 percent (op8) and 80 (the pipeline). A pair at exactly the
threshold has fewer equal coordinates of 64 with a probability below 1e-6, and less above it.

Defined cases: ASCII capitals are lowered, words end at ASCII white space; fewer than five words form
one shingle; no words, or a null text, form an empty set, which is linked with nothing; repeated rows
are equal sets, each with its own row in the result; rows that share a doc_id but not the set are documents of their
own, each in its component; rows without a doc_id get component_id null and kept null; an empty table gives no rows;
other columns, whatever their names, are ignored or, by `keep_first`, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import ALL_ROWS, batch, cut, map_batches, mix, salted_join, ship, shingles, tidy, utf8, word_hashes

WIDTH = 5
COORDINATES = 64
#: Similar if 100 * intersection >= percent * union.
PERCENT = 85
#: Equal coordinates that are asked of a candidate, by percent.
MATCHES = {PERCENT: 38, 80: 34}
#: Counters of the sketch that orders values by how many nodes share them; its size is fixed.
COUNTERS = 1 << 16
#: Nodes of a list that are compared with as many others in one task.
BLOCK = 2000
#: In longer lists, pairs are held against the nodes' sets before they are made.
DENSE = 64
#: Bytes of sets that such a block has on average at most, so that a task's memory does not follow the texts' lengths.
BLOCK_BYTES = 32_000_000
#: Pairs whose signatures are compared at once.
COMPARED = 20_000

_XORS = np.frombuffer(xxhash.xxh3_128_digest(b"xor") * 64, dtype="<u4")[:COORDINATES] ^ (np.arange(COORDINATES, dtype=np.uint32) * np.uint32(0x9E3779B1))
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)

#: What undoes the factors, modulo 2**32.
_INVERSES = np.array([pow(int(x), -1, 1 << 32) for x in _FACTORS], dtype=np.uint32)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    hashes = word_hashes(text.lower().split())
    if not len(hashes):
        return hashes
    return np.unique(shingles(hashes, min(width, len(hashes))))


def signature(found: np.ndarray) -> bytes:
    """For each of the hash functions, 32 bits of the shingle whose value is smallest.

    The functions are bijections, so the shingle's bits follow from the value. Unlike the smallest values,
    which crowd near zero, they are spread evenly, so few nodes meet by chance.
    """
    low = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    short = found.astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, ((short[at : at + 4096, None] ^ _XORS) * _FACTORS).min(axis=0), out=low)
    return ((low * _INVERSES) ^ _XORS).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, the 128-bit hash (k1, k2) of the set, sig (empty for an empty set)."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, first, second, sigs = [], [], [], []
        for text in utf8(rows.column("text")):
            found = shingle_set(text)
            key = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype="<i8")
            n.append(len(found))
            first.append(int(key[0]))
            second.append(int(key[1]))
            sigs.append(signature(found) if len(found) else b"")
        return batch(doc_id=rows.column("doc_id"), text_key=rows.column("text_key"), n_shingles=pa.array(n, pa.int64()), k1=pa.array(first, pa.int64()), k2=pa.array(second, pa.int64()), sig=pa.array(sigs, pa.binary()))

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig binary")


def _values(sigs: list[bytes]) -> np.ndarray:
    """A 64-bit key of every coordinate-value pair: the coordinate above the value."""
    values = np.frombuffer(b"".join(sigs), dtype="<u4").reshape(-1, COORDINATES).astype(np.uint64)
    return values | np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)


def _shared(nodes: DataFrame) -> np.ndarray:
    """A sketch of how many nodes have a coordinate-value pair: `COUNTERS` sums."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.bincount((mix(_values(rows.column("sig").to_pylist())) % np.uint64(COUNTERS)).astype(np.int64).ravel(), minlength=COUNTERS)
        there = np.flatnonzero(counts)
        return batch(counter=there, n=counts[there])

    out = np.zeros(COUNTERS, dtype=np.int64)
    for row in map_batches(nodes.select("sig"), run, "counter long, n long", ALL_ROWS).groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["counter"]] = row["n"]
    return out


def _prefix(keys: np.ndarray, shared: np.ndarray, matches: int) -> np.ndarray:
    """The coordinates of each row's rarest coordinate-value pairs."""
    mixed = mix(keys)
    return np.lexsort((mixed, shared[(mixed % np.uint64(COUNTERS)).astype(np.int64)]))[:, : COORDINATES - matches + 1]


def postings(nodes: DataFrame, shared: np.ndarray, matches: int) -> DataFrame:
    """key, node, shingles: every node under its rarest coordinate-value pairs, with the size of its set."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys = _values(rows.column("sig").to_pylist())
        order = _prefix(keys, shared, matches)
        keys = np.take_along_axis(keys, order, axis=1)
        node, size = (np.repeat(rows.column(x).to_numpy(), order.shape[1]) for x in ("node", "n"))
        return batch(key=keys.ravel().astype(np.int64), node=node, shingles=size)

    return map_batches(nodes.select("node", "sig", "n"), run, "key long, node long, shingles long", ALL_ROWS)


def _weights(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.count("*").alias("n"))


def _matching(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """The pairs whose signatures agree in enough coordinates."""
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        equal = (_values(rows.column("sig_a").to_pylist()) == _values(rows.column("sig_b").to_pylist())).sum(axis=1)
        keep = pa.array(equal >= matches)
        return batch(a=rows.column("a").filter(keep), b=rows.column("b").filter(keep))

    return map_batches(salted_join(pairs.join(right, "b"), left, "a", "b", weights=_weights(pairs)), run, "a long, b long")


def similar(one: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets; the sizes decide first."""
    if 100 * min(len(one), len(other)) < percent * max(len(one), len(other)):
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs, which are cut, whose full sets are similar."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, one = [], None, None
        for a, text, other in zip(rows.column("a").to_pylist(), utf8(rows.column("text_a")), utf8(rows.column("text_b")), strict=True):
            if a != last:
                last, one = a, shingle_set(text)
            keep.append(similar(one, shingle_set(other), percent))
        return batch(a=rows.column("a").filter(pa.array(keep)), b=rows.column("b").filter(pa.array(keep)))

    return map_batches(salted_join(pairs.join(right, "b"), left, "a", "b", weights=_weights(pairs)), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component, for all nodes with a link.

    Every round hooks each node to its smallest neighbour, follows the hooks to their ends and keeps the
    links between different ends, so the number of nodes that are left at least halves.
    """
    labels, edges = None, links.select("a", "b").distinct()
    while True:
        both = edges.union(edges.select("b", "a"))
        parents = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
        while True:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("next"))
            step = cut(parents.join(up, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
            moved = not step.filter("moved").isEmpty()
            parents = step.select("node", "label")
            if not moved:
                break
        if labels is None:
            labels = parents
        else:
            ends = parents.select(F.col("node").alias("label"), F.col("label").alias("end"))
            labels = cut(labels.join(ends, "label", "left").select("node", F.coalesce("end", "label").alias("label")))
        one, other = parents.select(F.col("node").alias("a"), F.col("label").alias("la")), parents.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = cut(edges.join(one, "a").join(other, "b").filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        if edges.isEmpty():
            return labels


def _short(found: np.ndarray) -> bytes:
    """A set as distinct 32-bit hashes."""
    return np.unique(found.astype(np.uint32)).tobytes()


def _may_link(one: tuple[np.ndarray, int], other: tuple[np.ndarray, int], percent: int) -> bool:
    """False only if sets of the given sizes, with these 32-bit hashes, cannot be similar."""
    (a, n), (b, m) = one, other
    both = len(np.intersect1d(a, b, assume_unique=True)) + min(n - len(a), m - len(b))
    return 100 * both >= percent * (n + m - both)


def _compared(rows: pa.Table, shared: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one group (key, _one, _two) with different labels, enough matches and, if sets are there, these.

    Rows are sorted by group. All groups advance together: step d compares each row with the d-th after it.
    A pair meets in every list that posts both; it is returned in that of the smallest coordinate alone. Sets stay
    where the rows have them, and pairs are handed on as they are found.
    """
    key, one, two, own, node, label, size = (rows.column(x).to_numpy() for x in ("key", "_one", "_two", "_own", "node", "label", "n"))
    n = len(key)
    begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
    ends = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    keys = _values(rows.column("sig").to_pylist())
    sets = [(np.frombuffer(x.as_buffer(), dtype=np.uint32), m) if x.is_valid else None for x, m in zip(rows.column("set"), size.tolist(), strict=True)]
    posted = np.zeros((n, COORDINATES), dtype=bool)
    np.put_along_axis(posted, _prefix(keys, shared, MATCHES[percent]), True, axis=1)
    values, coordinate = keys.astype(np.uint32), key.astype(np.uint64) >> np.uint64(32)
    active, d = np.arange(n), 1
    while len(active := active[active + d < ends[active]]):
        after = active + d
        small, large = np.minimum(size[active], size[after]), np.maximum(size[active], size[after])
        pick = active[(label[active] != label[after]) & ((one[active] == two[active]) | (own[active] != own[after])) & (100 * small >= percent * large)]
        for at in range(0, len(pick), COMPARED):
            i = pick[at : at + COMPARED]
            j = i + d
            equal = values[i] == values[j]
            first = (equal & posted[i] & posted[j]).argmax(axis=1)
            keep = (equal.sum(axis=1) >= MATCHES[percent]) & (first == coordinate[i])
            i, j = i[keep], j[keep]
            kept = np.fromiter((sets[x] is None or _may_link(sets[x], sets[y], percent) for x, y in zip(i.tolist(), j.tolist(), strict=True)), dtype=bool, count=len(i))
            if kept.any():
                a, b = node[i[kept]], node[j[kept]]
                yield batch(a=np.minimum(a, b), b=np.maximum(a, b))
        d += 1


def _sets(dense: DataFrame, texts: DataFrame) -> DataFrame:
    """node, set of the `dense` nodes."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        return batch(node=rows.column("node"), set=pa.array([_short(shingle_set(x)) for x in utf8(rows.column("text"))], pa.binary()))

    return map_batches(texts.join(dense, "node", "left_semi").select("node", "text"), run, "node long, set binary")


def _crossing(lists: DataFrame, nodes: DataFrame, texts: DataFrame, shared: np.ndarray, percent: int) -> DataFrame:
    """Pairs a < b with enough matches of nodes that share a list of `lists` (key, node, shingles, label) under different labels."""
    sized = lists.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("n"), F.sum("shingles").alias("_shingles"))
    by_bytes = F.when(F.col("n") > DENSE, F.ceil(4 * F.col("_shingles") / BLOCK_BYTES))
    sized = cut(sized.filter("_low != _high").select("key", "n", F.greatest(F.ceil(F.col("n") / BLOCK), by_bytes).cast("int").alias("_blocks")))
    mixed = cut(salted_join(lists.drop("shingles"), sized.withColumnRenamed("n", "_size"), "key", "node", weights=sized))
    sets = cut(_sets(mixed.filter(F.col("_size") > DENSE).select("node").distinct(), texts))
    blocks = mixed.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("key", "node", "label", "_size", "_own", F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"))
    facts = nodes.select("node", "sig", "n").join(sets, "node", "left")
    brought = F.when(F.col("_size") > DENSE, F.col("set")).alias("set")
    with_sig = dealt.join(facts, "node").select("key", "_one", "_two", "_own", "node", "label", "n", "sig", brought).repartition("key", "_one", "_two").sortWithinPartitions("key", "_one", "_two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            rows = pa.Table.from_batches([rows])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            keys = [rows.column(x).to_numpy() for x in ("key", "_one", "_two")]
            begins = np.flatnonzero(np.any([x[:-1] != x[1:] for x in keys], axis=0)) + 1
            whole = int(begins[-1]) if len(begins) else 0  # the last group may go on
            held = rows.slice(whole)
            if whole:
                yield from _compared(rows.slice(0, whole), shared, percent)
        if held is not None and len(held):
            yield from _compared(held, shared, percent)
        tidy()

    return with_sig.mapInArrow(run, "a long, b long")


def _assigned(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles of every row, with first_id and first_key: the smallest document of its component.

    Both are null for rows without a doc_id; a document with an empty set is its own.
    """
    ship(docs.sparkSession)
    sigs = cut(signatures(docs))
    full = sigs.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    by_set = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = cut(by_set.select(F.monotonically_increasing_id().alias("number"), "k1", "k2", "first", "sig", "n"))
    unique = classes.groupBy("first.doc_id").count().filter("count > 1").isEmpty()
    nodes = classes.withColumn("node", F.col("first.doc_id") if unique else F.col("number"))
    shared = _shared(nodes)
    posted = postings(nodes, shared, MATCHES[percent])
    hubs = cut(posted.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_high"), F.count("*").alias("n")).filter("hub != _high").select("key", "hub", "n"))
    lists = cut(salted_join(posted, hubs.select("key", "hub"), "key", "node", weights=hubs.select("key", "n")))
    first = cut(lists.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    places = nodes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.text_key")
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(places, ["doc_id", "text_key"])
    texts = cut(whole.groupBy("doc_id", "text_key").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"))
    links = cut(confirm(cut(_matching(first, nodes, MATCHES[percent])), texts, percent))
    labels = components(links)
    named = lists.select("key", "node", "shingles").join(labels, "node", "left").select("key", "node", "shingles", F.coalesce("label", "node").alias("label"))
    second = cut(_crossing(named, nodes, texts, shared, percent).join(first, ["a", "b"], "left_anti"))
    more = cut(confirm(second, texts, percent))
    if not more.isEmpty():
        one, other = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        joined = more.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        ends = components(joined).select(F.col("node").alias("label"), F.col("label").alias("end"))
        everyone = cut(labels.union(joined.select("a", "a")).union(joined.select("b", "b")).distinct())
        labels = cut(salted_join(everyone, ends, "label", "node", "left").select("node", F.coalesce("end", "label").alias("label")))
    named_sets = cut(nodes.join(labels, "node", "left").select("k1", "k2", "first", F.coalesce("label", "node").alias("label")))
    firsts = named_sets.groupBy("label").agg(F.min("first").alias("_first"))
    by_class = salted_join(named_sets.select("k1", "k2", "label"), firsts, "label", "k1").select("k1", "k2", "_first")
    out = salted_join(sigs.select("doc_id", "text_key", "n_shingles", "k1", "k2"), by_class, ["k1", "k2"], "doc_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("_first")).otherwise(F.struct("doc_id", "text_key"))
    known = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "text_key", "n_shingles", known["doc_id"].alias("first_id"), known["text_key"].alias("first_key"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id is that)."""
    return _assigned(docs, percent).select("doc_id", "n_shingles", F.col("first_id").alias("component_id"), (F.col("doc_id") == F.col("first_id")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows, in all their columns, without the documents of each component that are not its smallest doc_id.

    One row of a component stays: of rows that are equal in doc_id and text one does, and of texts under its smallest
    doc_id that with the smallest hash. Documents with an empty set stay, and rows without a doc_id stay as they are.
    """
    keys = ["doc_id", "__key"]
    found = cut(_assigned(docs, percent).withColumnRenamed("text_key", "__key").filter(F.col("doc_id").isNotNull()))
    dropped = found.filter((F.col("doc_id") != F.col("first_id")) | (F.col("__key") != F.col("first_key"))).select(keys).distinct()
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    out = keyed.join(dropped, keys, "left_anti")
    twice = cut(found.groupBy(keys).agg(F.count("*").alias("n")).filter("n > 1").select(keys))
    if not twice.isEmpty():
        out = out.join(twice, keys, "left_anti").unionByName(out.join(twice, keys, "left_semi").dropDuplicates(keys))
    return out.select(*docs.columns)
