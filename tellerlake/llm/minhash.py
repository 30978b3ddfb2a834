"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut
from .shingles import WordHashes, band_keys, set_key, shingle_set, signature

BANDS, ROWS = 28, 4  # a pair at the threshold shares no band in 1 of 2.5 million cases
UNIT = 600_000  # shingles that one verification unit may hold on each side
MEMBERS = 8_192  # and texts, however short: work arrays are as wide as their number

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                     ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text, ...)``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` for the sets of
    their distinct ``size``-word shingles; ``component_id`` is the least doc_id reachable.

    Method: documents with equal sets become one class. Every class gets a circulant MinHash
    signature, its bands name buckets, and buckets with the same members count once. Each
    bucket is verified on the full sets inside one unit by a sparse matrix product; a bucket
    of more than ``unit`` shingles or ``MEMBERS`` texts is dealt out to pairs of blocks, so that neither a task
    nor a row list grows with its square. A unit reports a spanning forest of its links.

    Nulls and texts without a word have an empty set, are linked with nothing and kept. A
    null doc_id gives a null component and is kept. Where rows repeat a doc_id, each takes the
    component of its own text; links hold between texts, and classes with one least doc_id
    are one component. Other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(slim.mapInArrow(_signer(size, bands, rows), "doc_id long, n_shingles long, "
                                 "set_key binary, bands array<long>"), "signed")
    classes = cut(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands")), "classes")

    links = cut(_verified(slim, classes, size, percent, unit), "links")
    roots = components(links)
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"))
    # two classes may hold one doc_id only if ids repeat; the empty set belongs to no class
    found = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, counts, keys, found = WordHashes(), [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), size, known)
                counts.append(len(hashes))
                keys.append(set_key(hashes))
                found.append(band_keys(signature(hashes, bands * rows), bands)
                             if len(hashes) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema=_SIGNED)
    return sign


def _verified(slim: DataFrame, classes: DataFrame, size: int, percent: int, unit: int) -> DataFrame:
    """(a, b): links between class representatives, a spanning forest of each bucket's."""
    each = classes.select("rep", "set_key", "n", F.xxhash64("set_key").alias("tag"), F.explode("bands").alias("bucket"))
    buckets = (each.groupBy("bucket").agg(
        F.count("*").alias("members"), F.sum("n").alias("total"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.bit_xor("tag").alias("x1"), F.bit_xor(F.xxhash64("tag", F.lit(1))).alias("x2")).where("members > 1")
        # a bucket of two whose sizes rule a link out needs no look at the texts
        .where(f"members > 2 OR 100 * low >= {percent} * high"))
    # equal member lists arise in many bands: one bucket of each is enough
    chosen = (buckets.groupBy("members", "total", "x1", "x2").agg(F.min("bucket").alias("bucket"))
              .select("bucket", F.ceil(F.greatest(
                  F.col("total") / unit, F.col("members") / MEMBERS)).cast("int").alias("blocks")))
    member = each.select("rep", "set_key", "bucket").join(chosen, "bucket")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = member.select(
        "rep", "set_key", "bucket", block.alias("block"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
            F.least(block, j).alias("one"), F.greatest(block, j).alias("two")))).alias("pair"))
    texts = slim.withColumnRenamed("doc_id", "rep").join(member.select("rep").distinct(), "rep", "left_semi")
    units = spread.join(texts, "rep").select(
        F.xxhash64("bucket", "pair.one", "pair.two").alias("unit"), "bucket", "pair.one", "pair.two",
        "block", "rep", "set_key", "text")
    dealt = units.repartition("unit").sortWithinPartitions("unit", "bucket", "one", "two")
    return dealt.mapInArrow(_verifier(size, percent), "a long, b long").distinct()


def _verifier(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left, known, out = None, {}, WordHashes(), []
        for batch in batches:
            names = zip(*(batch.column(c).to_pylist()
                          for c in ("bucket", "one", "two", "block", "rep", "set_key")), strict=True)
            for (bucket, one, two, block, rep, key), text in zip(names, batch.column("text"), strict=True):
                if (bucket, one, two) != current:
                    out += linked(left, current, percent)
                    current, left = (bucket, one, two), {}
                hashes = shingle_set(text.as_py(), size, known)
                if set_key(hashes) == key:  # a repeated doc_id brings its other texts along
                    left[rep, key] = (block, hashes)
            if len(known) > 1_000_000:
                known.clear()
            yield _pairs(out)
            out = []
        yield _pairs(linked(left, current, percent))
    return verify


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked(members: dict, unit: tuple | None, percent: int, strip: int = 256) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``{(id, set name): (block, set)}``, on the full sets.

    In a unit of two different blocks only pairs across them count. Intersections of all
    pairs come from one incidence matrix, strip by strip, over the shingles that two or
    more members share.
    """
    if len(members) < 2:
        return []
    named = sorted(members)
    ids = [rep for rep, _ in named]
    blocks = np.array([members[i][0] for i in named])
    sets = [members[i][1] for i in named]
    across = unit is not None and unit[1] != unit[2]
    size = np.array([len(s) for s in sets], np.int64)
    if len(ids) == 2:
        common = np.array([[size[0], np.isin(sets[0], sets[1], assume_unique=True).sum()]] * 2)
        hit = 100 * common[0, 1] >= percent * (size.sum() - common[0, 1])
        return [(ids[0], ids[1])] if hit and (not across or blocks[0] != blocks[1]) else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(ids)), size)
    _, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[where] > 1
    owner, where = owner[keep], where[keep]
    _, where = np.unique(where, return_inverse=True)
    width, parent = int(where.max(initial=-1)) + 1, np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for at in range(0, len(ids), strip):
        rows = min(strip, len(ids) - at)
        common = np.zeros((rows, len(ids)), np.float32)
        for lo in range(0, width, 4096):  # a bounded part of the vocabulary at a time
            part = (where >= lo) & (where < lo + 4096)
            full = np.zeros((len(ids), min(4096, width - lo)), np.float32)
            full[owner[part], where[part] - lo] = 1
            common += full[at: at + rows] @ full.T
        total = size[at: at + rows, None] + size[None, :]
        hit = 100 * common.astype(np.int64) >= percent * (total - common.astype(np.int64))
        if across:
            hit &= blocks[at: at + rows, None] != blocks[None, :]
        for i, j in zip(*np.nonzero(hit), strict=True):
            i = int(i) + at
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[min(i, j)], ids[max(i, j)]))
    return links

