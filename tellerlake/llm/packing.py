"""Conflict-constrained best-fit packing of documents into fixed-length training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollup import PATTERNS

CAPACITY = 2048  # words in one sequence
GROUP = 4096  # documents packed together, about

_OUT = "doc_id long, piece int, start long, n_words long, bin_id long, bin_start long"


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start within it) for every (length, source, cluster), longest placed first.

    Open bins stand in order of what room they have left, each with a bitmap of its sources
    and one of its duplicate clusters. From the tightest bin that has room the search goes on
    to the next until one shares neither source nor cluster with the item; else a new bin opens.
    """
    bit: dict[tuple, int] = {}
    masks: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    placed: list[tuple[int, int]] = [(0, 0)] * len(items)
    for k in sorted(range(len(items)), key=lambda i: -items[i][0]):
        length, source, cluster = items[k]
        mask = 0
        for name in (("source", source), ("cluster", cluster)):
            if name[1] is not None:  # a null conflicts with nothing
                mask |= 1 << bit.setdefault(name, len(bit))
        at = bisect_left(room, (length, -1))
        while at < len(room) and masks[room[at][1]] & mask:
            at += 1
        if at < len(room):
            left, found = room.pop(at)
        else:
            left, found = capacity, len(masks)
            masks.append(0)
        masks[found] |= mask
        placed[k] = (found, capacity - left)
        if left > length:
            insort(room, (left - length, found))
    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, n_words, bin_id, bin_start): every word of every document, once.

    A document is words ``start`` to ``start + n_words`` of its text in pieces of at most
    ``capacity``; piece ``piece`` lies in bin ``bin_id`` from word ``bin_start`` on. No bin
    holds two pieces of one source or of one duplicate cluster (``cluster``; the same text in
    lower case by default), nor more than ``capacity`` words. Only lengths and keys are
    shuffled. Documents are dealt at random into groups of about ``group`` and each group is
    packed by one task, so memory and search are bounded at any size; a full piece is a bin of
    its own at once.

    Texts without a word give one row of 0 words in no bin (null). A null doc_id passes
    through; null sources conflict with nothing; repeated rows are documents of their own and,
    being of one cluster, never share a bin. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cluster = F.xxhash64(F.lower(text)) if cluster is None else cluster.cast("long")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        cluster.alias("cluster"), F.regexp_count(text, F.lit(PATTERNS["words-1"])).cast("long").alias("total"))
    groups = 1 + docs.count() // group
    # by id and text: rows without an id still spread; a task may hold many groups, one at a time
    dealt = slim.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", F.lit("group")), F.lit(groups))).repartition(
        "group").sortWithinPartitions("group", F.desc("total"), "doc_id", "source", "cluster")
    return dealt.mapInArrow(_packer(capacity), _OUT)


def _packer(capacity: int):
    def packed(group: int, rows: list[tuple]) -> pa.RecordBatch:
        pieces, items = [], []
        for doc_id, source, cluster, total in rows:
            for piece, start in enumerate(range(0, max(total, 1), capacity)):
                n = min(capacity, total - start)
                pieces.append((doc_id, piece, start, n))
                items.append((n, source, cluster))
        some = [k for k, p in enumerate(pieces) if p[3]]
        places = dict(zip(some, best_fit([items[k] for k in some], capacity), strict=True))
        out = [(*p, group * (1 << 32) + places[k][0], places[k][1]) if k in places else (*p, None, None)
               for k, p in enumerate(pieces)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
            names=["doc_id", "piece", "start", "n_words", "bin_id", "bin_start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "doc_id", "source", "cluster", "total")]
            for group, *row in zip(*columns, strict=True):
                if group != current and rows:
                    yield packed(current, rows)
                    rows = []
                current = group
                rows.append(tuple(row))
        if rows:
            yield packed(current, rows)
    return run
