"""What the first review found missing."""

import random
import re

import pytest

import corpus_pipeline
from lamina.llm import licenses, neardup, quality, queries, secrets
from tests.llm.test_llm import SMALL, WORD, by_id, check_packing, frame, spans, words


def firsts_by_brute_force(rows, percent):
    """The smallest doc_id of every component at `percent`."""
    sets = {}
    for doc, text in rows:
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} - {()}
    label = {d: d for d in sets}
    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return label


# the pipeline's near-dedup


def changed(r, text, places):
    own = text.split()
    for i in places:
        own[i] = words(r, 1, "xyz") + "q"
    return " ".join(own)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_at_either_threshold(spark, monkeypatch, percent):
    monkeypatch.setattr(neardup, "DENSE", 5)
    r = random.Random(21)
    rows = []
    for _ in range(12):  # pairs with 5, 10, ... shingles of 204 lost
        base = words(r, 204)
        for n in (3, 4, 5):
            rows += [(len(rows) + i, text) for i, text in enumerate((f"{base} {words(r, 60)}", changed(r, base, range(20, 20 + 20 * n, 20)), base))]
        base = words(r, 150)
        rows += [(len(rows) + i, changed(r, base, [r.randrange(150)])) for i in range(8)]
    r.shuffle(rows)
    got = {d: x["component_id"] for d, x in by_id(neardup.near_duplicates(frame(spark, rows), percent)).items()}
    assert got == firsts_by_brute_force(rows, percent)
    assert got != firsts_by_brute_force(rows, 165 - percent)


def test_pipeline_stage_links_from_80_percent(spark):
    r = random.Random(22)
    base = words(r, 204)
    rows = [(1, base), (2, changed(r, base, [30, 80, 130, 180])), (3, words(r, 204))]  # 180 of 220 shingles: 0.818
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, frame(spark, rows), SMALL).collect()} == {1, 3}
    assert {x["doc_id"] for x in neardup.near_duplicates(frame(spark, rows)).filter("kept").collect()} == {1, 2, 3}


def test_pipeline_keeps_firsts_at_80_percent(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {x["doc_id"] for x in quality.assess(docs).filter("kept").collect()}
    label = firsts_by_brute_force([(x["doc_id"], x["text"]) for x in docs.collect() if x["doc_id"] in kept], 80)
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, SMALL).collect()} == {d for d, x in label.items() if d == x}


def test_pipeline_masks_and_packs_what_stays_at_80_percent(spark):
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = {x["doc_id"] for x in quality.assess(spark.read.parquet(f"{SMALL}/documents.parquet")).filter("kept").collect()}
    label = firsts_by_brute_force([(d, docs[d]) for d in sorted(kept)], 80)
    masked = []
    for d in sorted(d for d, x in label.items() if d == x):
        at, out = 0, ""
        for _, start, end in (x.split(":") for x in spans(docs[d]).split(",") if x):
            out += docs[d][at : int(start)] + secrets.MASK if int(start) >= at else ""
            at = max(at, int(end))
        masked.append((d, out + docs[d][at:]))
    check_packing(masked, corpus_pipeline.run(spark, SMALL).collect())


# short license notices


def test_short_notices(spark):
    r = random.Random(23)
    rows = [(1, "All rights reserved."), (2, f"{words(r, 9)}\n(c) ALL -- Rights\nreserved! {words(r, 7)} all rights reserved"), (3, "all rights"), (4, "small rights reserved"), (5, "all rights reservedly"), (6, None), (7, ""), (8, "All rights reserved."), (8, "All rights reserved."), (9, "all the rights reserved"), (10, "all small rights all rights reserved")]
    got = sorted((x["doc_id"], x["license"], x["containment"], x["n_windows"], x["first_word"]) for x in licenses.scan(frame(spark, rows)).collect())
    name = "All-rights-reserved"
    assert got == [(1, name, 1.0, 1, 0), (2, name, 1.0, 2, 10), (8, name, 1.0, 1, 0), (8, name, 1.0, 1, 0), (10, name, 1.0, 1, 3)]
    two = {x["license"] for x in licenses.scan(frame(spark, rows), notices={"one": "Reserved", "two": "all rights"}).collect()}
    assert two == {"one", "two"} and licenses.scan(frame(spark, rows), notices={}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, rows), notices={"none": "."})


def test_short_notices_of_the_table(spark):
    tokens = {x["doc_id"]: [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (x["text"] or "").lower()) if w] for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    brute = {d for d, own in tokens.items() if any(own[i : i + 3] == ["all", "rights", "reserved"] for i in range(len(own)))}
    assert {x["doc_id"] for x in queries.op3_license_bands(spark, SMALL).filter("license = 'All-rights-reserved'").collect()} == brute and brute
