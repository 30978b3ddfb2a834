"""Benchmark decontamination by spaced seeds that no accepted pair can lack: DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

WINDOW, PERCENT = 20, 80
BROADCAST_ROWS = 2_000_000  # seeds of a benchmark up to 2 million words: about 60 MB


def word_hashes(text: Column) -> Column:
    """Hashes of the words (letters and digits, lower case) of a whole text, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _seeds(words: Column, masks: Sequence[str]) -> Column:
    """For every start, an array of one hash per mask."""
    return bound(words, lambda w: bound(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))),
        lambda pairs: _seeds_of(w, pairs, masks)))


def _seeds_of(words: Column, pairs: Column, masks: Sequence[str]) -> Column:
    """``pairs`` holds a hash of each word with its successor: two ones of a mask in one look-up."""
    def value(mask: str, i: Column) -> Column:
        parts, at = [], 0
        while at < len(mask):
            two = mask[at: at + 2] == "11"
            if mask[at] == "1":
                parts.append(F.get(pairs if two else words, i + at))
            at += 1 + two
        return F.xxhash64(*parts)

    # near the end the longer masks hash fewer words: candidates more, which the comparison drops
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - min(map(len, masks)) + 1, F.lit(0)))
    return F.transform(starts, lambda _, i: F.array(*[value(m, i) for m in masks]))


def mask(words: int, window: int = WINDOW, percent: int = PERCENT) -> str:
    """The seed of items of ``words`` words: which positions count, in a window of them, from one start.

    ``gone`` words of an accepted window may differ. Its positions fall into ``gone + 1`` classes by
    their remainder, so that one class at least is untouched: a seed that takes every
    ``gone + 1``-th word, as often as each class has it, is found in every accepted window. 20
    words with 4 replaced: four words, each five apart, and the four between them ignored.
    """
    wide = min(words, window)
    gone = wide - -(-wide * percent // 100)
    return "1" + ("0" * gone + "1") * (wide // (gone + 1) - 1)


def _exploded(of: DataFrame, keys: Sequence[str], words: Column, masks: Sequence[str]) -> DataFrame:
    """(*keys, at, seeds): for every start one seed per mask, which says the mask that made it."""
    # the outer form keeps Spark from computing the array a second time for a filter
    return of.select(*keys, F.posexplode_outer(_seeds(words, masks)).alias("at", "seeds"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, matched, window): documents that hold a passage of a benchmark item.

    A pair is reported when some ``window`` words in a row (the whole item, if shorter) agree
    in ``percent`` or more with the document's words at one shift, so replaced words are
    tolerated. ``matched`` is the best count of agreeing words. Whatever words are replaced, the
    spaced seed of :func:`mask` is left somewhere: seeds are hashed at every start, in documents and
    items, and equal hashes put a document and an item on a diagonal. There words are compared
    one to one. So no pair is missed.

    Items of any length count, those below five words only word for word: an item of one word is
    held by every text with that word. Null or empty texts match nothing.
    Repeated items are reported each; repeated doc_ids give one row. Rows with a null id are
    left out (nothing could name them). Empty tables give no rows; other columns are ignored.

    The seeds of the benchmark are broadcast only where their count, taken first, is at most
    ``BROADCAST_ROWS``; a larger benchmark is joined by hash partitions.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("item")
                             ).where("item_id IS NOT NULL AND size(item) > 0").distinct()
    kinds = F.element_at(F.array(*[F.lit(mask(n, window, percent)) for n in range(1, window + 1)]),
                         F.least(F.size("item"), F.lit(window)))
    items = items.withColumn("kind", kinds)
    masks = sorted(r.kind for r in items.select("kind").distinct().collect()) or ["1"]  # one a length at most
    own = F.get("seeds", F.array_position(F.array(*map(F.lit, masks)), F.col("kind")).cast("int") - 1)
    item_seeds = _exploded(items, ["item_id", "kind"], F.col("item"), masks).where("seeds IS NOT NULL").select(
        "item_id", F.col("at").alias("item_at"), own.alias("seed")).distinct()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                        ).where("doc_id IS NOT NULL")
    doc_seeds = _exploded(words, ["doc_id"], word_hashes(F.col("text")), masks).select(
        "doc_id", "at", F.explode_outer("seeds").alias("seed"))
    few = item_seeds.count() <= BROADCAST_ROWS
    # stored: both the choice of texts and the comparison read them
    hits = cut(doc_seeds.join(F.broadcast(item_seeds) if few else item_seeds, "seed").select(
        "doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "seed-hits")

    # The words of a text are hashed once, before they meet its hits. How many texts have hits grows with the
    # documents, so these are merged by id at every size and never sent to all tasks.
    texts = words.join(hits.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select(
        "doc_id", word_hashes(F.col("text")).alias("doc"))
    laid = hits.join(texts, "doc_id").join(F.broadcast(items) if few else items, "item_id")
    agree = bound(F.col("doc"), lambda doc: F.transform(F.col("item"), lambda w, i: F.coalesce(
        ((i + F.col("shift")) >= 0) & (w == F.get(doc, i + F.col("shift"))), F.lit(False)).cast("int")))
    wide = F.least(F.size("item"), F.lit(window))
    best = bound(F.col("agree"), lambda bits: F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("item") - wide + 1),
        lambda at: F.aggregate(F.slice(bits, at, wide), F.lit(0), lambda x, y: x + y))))
    scored = laid.select("doc_id", "item_id", "item", agree.alias("agree")).select(
        "doc_id", "item_id", best.alias("matched"), wide.alias("window"))
    return scored.where(F.col("matched") * 100 >= F.col("window") * percent).groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window"))


def statement(window: int = WINDOW, percent: int = PERCENT) -> str:
    """DuckDB SQL for the rows of :func:`contaminated` over ``documents`` and ``benchmark``, by the same seeds."""
    kinds = [mask(n, window, percent) for n in range(1, window + 1)]
    seeds = " UNION ALL ".join(
        f"SELECT id, s AS at, '{m}' AS kind, [" + ", ".join(f"w[s + {i}]" for i, bit in enumerate(m) if bit == "1")
        + f"] AS seed FROM (SELECT id, w, unnest(range(1, len(w) - {len(m)} + 2)) AS s FROM {{0}})" for m in sorted(set(kinds)))
    split = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    return f"""
WITH d AS (SELECT doc_id AS id, {split} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id AS id, {split} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT id, {kinds}[least(len(w), {window})] AS kind FROM b WHERE len(w) > 0),
ds AS ({seeds.format('d')}), bs AS ({seeds.format('b')}),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.at - bs.at AS shift
         FROM ds JOIN bs ON ds.kind = bs.kind AND ds.seed = bs.seed JOIN k ON k.id = bs.id AND k.kind = bs.kind),
laid AS (SELECT doc_id, item_id, least(len(b.w), {window}) AS wide, len(b.w) AS n,
         list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN i + shift >= 1 AND i + shift <= len(d.w)
             AND b.w[i] = d.w[i + shift] THEN 1 ELSE 0 END) AS agree
         FROM hits JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
best AS (SELECT doc_id, item_id, wide, list_max(list_transform(range(1, n - wide + 2),
         lambda s: list_sum(agree[s : s + wide - 1]))) AS matched FROM laid)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(wide)::BIGINT AS "window" FROM best
WHERE matched * 100 >= wide * {percent} GROUP BY doc_id, item_id"""
