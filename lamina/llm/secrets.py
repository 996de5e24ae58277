"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its content. A ledger says which rule versions
have seen which blob, and what they found; only pairs of a blob and a rule version that it lacks are
scanned, each blob once however many paths hold it, and findings are joined back to all paths. A text that
no rule's hint is in travels without its content. Paths of a blob that very many share are dealt over several
tasks.

Spans come from two views of one pattern: the pieces between its matches and the matches themselves
alternate, so that running lengths give the code points where each match starts and ends. Lengths are
summed in blocks of matches, so that a text of many findings costs little more for each. No pattern has a run
that a later start would read again to its end, so the time is linear in the text, and none repeats a group
without bound, which would cost stack.

Defined cases: a null text is the empty blob; texts of any length are scanned whole; repeated rows
share a blob and each gets its findings; rows whose text has no finding get empty spans; spans of different rules
may overlap and are ordered by start, then by rule; an empty table gives no rows; other columns are ignored or, by
`redact`, passed on, but for names that start with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm._common import cut, salted_join


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters.

    The span is the match or, with `tail`, the group, which must then end the match. A text without a match of
    `hint` (if empty, of the pattern) has no finding.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str = ""
    tail: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values. The first three are the base rules; kinds at one place are ordered as here. The label of a private
#: key has up to 64 characters.
RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, hint=r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, hint="[0-9a-f]{24}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,64}PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}", hint="xox[abeprs]-"),
    Rule("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, hint="eyJ", tail=True),
)
BASE = tuple(rule.kind for rule in RULES[:3])
MASK = "[secret]"
#: Matches whose places are summed together.
BLOCK = 256

SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def hints(rules: tuple[Rule, ...]) -> str:
    """A pattern that is in every text with a finding of any of the rules; a cheap test before the exact ones."""
    return "|".join(rule.hint or rule.pattern for rule in rules)


def _blocks(items: Column) -> Column:
    """An array as an array of arrays of `BLOCK` items. The array is bound first: what a lambda names it makes anew each time."""

    def cut_up(whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(whole)), F.lit(BLOCK)), lambda at: F.slice(whole, at, BLOCK))

    return F.transform(F.array(items), cut_up)[0]


def spans(text: Column, rule: Rule, place: int) -> Column:
    """The matches of a rule, leftmost and without overlaps, as structs ordered by start."""
    pieces = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        first = end - F.length(x["group"]) if rule.tail else start
        one = F.array(F.struct(first.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        keep = F.coalesce(F.length(x["group"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    def join(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), x["place"].alias("place"), (x["end"] + state["at"]).alias("end"), x["kind"].alias("kind")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], moved).alias("out"))

    zipped = F.arrays_zip(pieces.alias("piece"), found.alias("found"), groups.alias("group"))
    summed = F.transform(_blocks(zipped), lambda block: F.aggregate(block, begin, step))
    return F.aggregate(summed, begin, join, lambda state: state["out"])


def blobs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with text made whole and `blob`, its content address."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for what `ledger` lacks: blob, rules (those run now) and spans (what they found).

    `ledger` has the same columns; append the result to it. Blobs that all rules have seen are neither
    scanned nor returned.
    """
    hinted = F.when(F.col("text").rlike(hints(rules)), F.col("text")).alias("text")
    once = blobs(docs).select("blob", hinted).groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(rule.key) for rule in rules])
    if ledger is None:
        todo = once.withColumn("rules", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
        todo = once.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("_seen", F.array().cast("array<string>")))).filter(F.size("rules") > 0)
    todo = todo.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    parts = [F.when(F.array_contains("rules", rule.key), spans(F.col("text"), rule, place)).otherwise(F.array().cast(SPAN)) for place, rule in enumerate(rules)]
    return todo.select("blob", "rules", F.when(F.col("text").isNotNull(), F.array_sort(F.concat(*parts))).otherwise(F.array().cast(SPAN)).alias("spans"))


def _in_order(found: Column) -> Column:
    """Spans in order, equal ones once; an array of structs is compared with all by array_distinct."""

    def once(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (ordered[F.greatest(i - 1, F.lit(0))] != x))

    return F.transform(F.array(F.array_sort(found)), once)[0]


def _found(ledger: DataFrame) -> DataFrame:
    """blob, spans: the blobs with a finding, once each."""
    return ledger.filter(F.size("spans") > 0).groupBy("blob").agg(_in_order(F.flatten(F.collect_list("spans"))).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, blob, spans: what the ledger has on every path's blob, null if nothing was found."""
    paths = cut(blobs(docs).select("doc_id", "blob"))
    return salted_join(paths, _found(ledger), "blob", "doc_id", "left").select("doc_id", "blob", "spans")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _equals(value: int) -> Callable[[Column], Column]:
    return lambda x: x == value


def report(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and all spans, for every path."""
    rows = findings(docs, ledger).withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    counts = [F.size(F.filter(F.transform("spans", lambda x: x["place"]), _equals(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    base = _joined(F.filter("spans", lambda x: x["place"] < len(BASE)))
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _masked(text: Column, found: Column, mask: str) -> Column:
    """The text with every span replaced.

    Overlapping spans become one. The text is taken apart by blocks of about the square root of their number
    first, since to find a place in a string is to read up to it.
    """
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        """The gaps before the spans that start at or after the end of those before them."""
        gap = F.array(F.struct(state["at"].alias("from"), x["start"].alias("to")))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(x["start"] >= state["at"], F.concat(state["out"], gap)).otherwise(state["out"]).alias("out"))

    def join(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], inner["out"]).alias("out"))

    def part(gaps: Column, at: Column, many: Column) -> Column:
        """The text of some gaps, joined; `bound` holds what is used more than once, so that it is made once."""
        own = F.slice(gaps, at, many)
        low, high = F.element_at(own, 1)["from"], F.element_at(own, -1)["to"]
        bound = F.array(F.struct(F.substring(text, low + 1, high - low).alias("text"), low.alias("low"), own.alias("own")))
        return F.transform(bound, lambda b: F.array_join(F.transform(b["own"], lambda g: F.substring(b["text"], g["from"] - b["low"] + 1, g["to"] - g["from"])), mask))[0]

    def whole(gaps: Column) -> Column:
        many = F.ceil(F.sqrt(F.size(gaps))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(gaps), many), lambda at: part(gaps, at, many)), mask)

    gaps = F.aggregate(_blocks(found), begin, join, lambda s: F.concat(s["out"], F.array(F.struct(s["at"].alias("from"), F.length(text).alias("to")))))
    return F.transform(F.array(gaps), whole)[0]


def redact(docs: DataFrame, ledger: DataFrame | None = None, mask: str = MASK, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, in all their columns, with every found span replaced by `mask` and n_chars renewed.

    `ledger`, if given, may hold findings of the rules run before; texts without any of the rules' hints stay
    where they are, the others meet their findings by blob.
    """
    hinted = F.coalesce(F.col("text").rlike(hints(rules)), F.lit(False))
    suspect = cut(docs.filter(hinted).withColumn("__blob", F.sha2(F.col("text").cast("binary"), 256)).withColumn("__deal", F.monotonically_increasing_id()))
    new = scan(suspect.select("doc_id", "text"), ledger, rules)
    whole = new if ledger is None else ledger.unionByName(new)
    found = _found(whole).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    rows = salted_join(suspect, found, "__blob", "__deal", "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col("__spans"), mask)))
    out = docs.filter(~hinted).union(rows.select(*docs.columns))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
