"""Sharding along a Hilbert curve through metadata dimensions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5  # cells per dimension: 2^5


def curve_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points given by one integer array per dimension."""
    x = [np.array(c, np.int64) for c in cells]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            on, swap = (x[i] & q) != 0, (x[0] ^ x[i]) & (q - 1)
            first = np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = np.where(on, x[i], x[i] ^ swap)
            x[0] = first
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (((v ^ turn) >> b) & 1)
    return out


def cells(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``df`` with ``cell_<dimension>``: the share of rows with smaller values, in 2^bits steps.

    Equal values share a cell, nulls come first. Only distinct values with their counts are
    ordered, so a value held by a third of all rows is one row of that.
    """
    total = df.count()
    for name in dimensions:
        counts = df.groupBy(F.col(name).alias("_value")).agg(F.count("*").alias("_n"))
        placed = running(counts, ["_value"], F.col("_n")).select(
            "_value", F.floor(F.col("before") * (1 << bits) / F.lit(max(total, 1))).cast("int").alias(f"cell_{name}"))
        df = df.join(placed, df[name].eqNullSafe(placed["_value"])).drop("_value")
    return df


def shards(docs: DataFrame, count: int = 16, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, cell_...) of every row.

    Each dimension is quantised by rank into 2^bits cells, rows are ordered by the Hilbert
    index of their cells (then by crc32 of the text, so that equal texts lie together, and by
    id), and the order is cut into ``count`` runs whose row counts differ by one at most:
    law ``rows``. ``slot`` counts from 0 within a shard; ``grown_shard`` is null.

    Null dimensions take the first cell, a null text counts one byte and has the crc32 of an
    empty text, null ids come first among equals, repeated rows take neighbouring slots. An
    empty table has no shards. Other columns are ignored.
    """
    @F.pandas_udf("long")
    def along(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_index([c.to_numpy() for c in columns], bits))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), *dimensions)
    placed = cells(slim, dimensions, bits)
    names = [f"cell_{d}" for d in dimensions]
    curve = placed.select("doc_id", "size", "text_crc32", *names).withColumn("curve", along(*names))
    order = running(curve, ["curve", "text_crc32", "doc_id", "size"])
    total = docs.count()
    shard = F.floor(F.col("before") * count / F.lit(max(total, 1)))
    first = F.ceil(shard * total / F.lit(count))
    return order.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("before") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "curve", *names)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write ``docs`` (unique ids) as one folder per shard, rows in slot order."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(placed: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows, bytes and the least and greatest cell of every dimension per shard, for pruning."""
    ends = [f(f"cell_{d}").alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def prune(shard_manifest: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Shards that may hold rows in the given cell range of each named dimension."""
    for name, (low, high) in ranges.items():
        shard_manifest = shard_manifest.where((F.col(f"max_{name}") >= low) & (F.col(f"min_{name}") <= high))
    return shard_manifest


def statement(count: int = 16, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> str:
    """DuckDB SQL for the rows of :func:`shards` over ``documents``."""
    d, steps = range(len(dimensions)), []

    def then(changed: dict[int, str]) -> None:
        columns = ", ".join(f"{changed.get(i, f'x{i}')} AS x{i}" for i in d)
        steps.append(f"s{len(steps) + 1} AS (SELECT * REPLACE ({columns}) FROM s{len(steps)})")

    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in d:
            on, swap = f"x{i} & {q} <> 0", f"xor(x0, x{i}) & {q - 1}"
            then({i: f"CASE WHEN {on} THEN x{i} ELSE xor(x{i}, {swap}) END",
                  0: f"CASE WHEN {on} THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END"})
    for i in d[1:]:
        then({i: f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = f"xor({turn}, CASE WHEN x{d[-1]} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    then({i: f"xor(x{i}, {turn})" for i in d})
    places = [(b, i) for b in range(bits - 1, -1, -1) for i in d]
    curve = " + ".join(f"(((x{i} >> {b}) & 1) << {len(places) - 1 - k})" for k, (b, i) in enumerate(places))
    values = ", ".join(
        f"c{i} AS (SELECT v, (coalesce(sum(n) OVER (ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND "
        f"1 PRECEDING), 0) * {1 << bits} // (SELECT count(*) FROM documents))::INT AS cell "
        f"FROM (SELECT {name} AS v, count(*) AS n FROM documents GROUP BY 1))" for i, name in enumerate(dimensions))
    joins = " ".join(f"JOIN c{i} ON t.{name} IS NOT DISTINCT FROM c{i}.v" for i, name in enumerate(dimensions))
    names = [f"cell_{name}" for name in dimensions]
    out = ", ".join(["doc_id", "size", "text_crc32", "'rows' AS law", "shard::INT AS shard"])
    return f"""
WITH RECURSIVE powers AS (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM powers),
{values},
summed AS (SELECT documents.*, coalesce(text, '') AS body, xor(4294967295, list_reduce([4294967295::BIGINT] ||
    list_transform(range(strlen(coalesce(text, ''))), lambda k: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM documents, crc),
s0 AS (SELECT t.doc_id, (strlen(body) + 1)::BIGINT AS size, text_crc32,
    {", ".join(f"c{i}.cell AS x{i}, c{i}.cell AS {n}" for i, n in enumerate(names))} FROM summed t {joins}),
{", ".join(steps)},
placed AS (SELECT *, ({curve})::BIGINT AS curve FROM s{len(steps)}),
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST, size) - 1 AS r,
    count(*) OVER () AS n FROM placed),
cut AS (SELECT *, r * {count} // n AS shard FROM ranked)
SELECT {out}, (r - (shard * n + {count - 1}) // {count})::BIGINT AS slot, NULL::INT AS grown_shard, curve,
    {", ".join(names)} FROM cut"""
