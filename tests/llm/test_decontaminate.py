"""Decontamination against an aligned comparison without seeds."""

import itertools
import random

from conftest import SMALL

import corpus_pipeline
from tellerlake.llm import decontaminate


def aligned(doc, item, window=20, percent=80):
    """Best count of agreeing words at any shift, or None below the threshold."""
    wide, best = min(len(item), window), 0
    for shift in range(-len(item) + 1, len(doc)):
        bits = [0 <= i + shift < len(doc) and w == doc[i + shift] for i, w in enumerate(item)]
        best = max(best, *(sum(bits[at: at + wide]) for at in range(len(item) - wide + 1)))
    return best if 100 * best >= percent * wide else None


def test_every_accepted_pattern_holds_its_seed():
    """All ways to replace words of an accepted window, at every length."""
    for n in range(1, 21):
        mask = decontaminate.mask(n)
        ones = [i for i, bit in enumerate(mask) if bit == "1"]
        gone = n - -(-n * 80 // 100)
        assert len(mask) <= n and (gone == 0 or "0" in mask)
        spots = [{s + i for i in ones} for s in range(n - len(mask) + 1)]
        for lost in itertools.combinations(range(n), gone):  # 4,845 for 20 words; fewer lost words leave more
            assert any(not spot & set(lost) for spot in spots), (n, lost)
    assert decontaminate.mask(20) == "1000010000100001" == decontaminate.mask(500)


def test_no_accepted_pair_is_missed(spark):
    draw = random.Random(5)
    sizes = [*range(1, 26), 40]
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in sizes}
    docs = {}
    for n, item in items.items():
        wide = min(n, 20)
        for many in range(wide // 5 + 2):
            for _ in range(12 if n > 4 else 2):
                gone = set(draw.sample(range(wide), min(many, wide)))
                body = [f"z{k}" if k in gone or k >= wide else w for k, w in enumerate(item)]
                docs[len(docs)] = ["pre"] * draw.randrange(3) + body + ["post"] * draw.randrange(3)
    # the patterns that the reviewer counted as missed: no four of 13 and five of 20 in a row
    for n, gone in ((13, (6,)), (15, (3, 7, 11)), (20, (4, 8, 12, 16)), (20, (3, 7, 11, 15))):
        docs[len(docs)] = [f"z{k}" if k in gone else w for k, w in enumerate(items[n])]
    # across an edge of the document
    docs[len(docs)] = items[20][4:]
    want = {(d, i): best for d, doc in docs.items() for i, item in items.items()
            if (best := aligned(doc, item)) is not None}
    assert len(want) > 500
    found = decontaminate.contaminated(
        spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.matched for r in found.collect()} == want


def test_stage_judges_each_row(spark):
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    rows = [(None, item), (None, "clean one"), (4, item), (4, "clean two"), (4, "clean two"), (None, None)]
    left = corpus_pipeline.keep_uncontaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert sorted(map(tuple, left), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
