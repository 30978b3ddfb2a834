"""Token counts kept as rollups that signed deltas maintain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")

#: Tokenizer versions counted by pattern: white-space words; words, single digits and other signs.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]"}


def count_tokens(text, tokenizer: str):
    """Tokens of a whole text as a column; a null text has none."""
    found = F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(PATTERNS[tokenizer]))
    return found.cast("long")


def inserted(counts: DataFrame) -> DataFrame:
    """Delta of new documents: ``counts(source, lang, tokenizer, tokens)``."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Delta of removed documents, given with the counts they were added with."""
    return inserted(counts).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Delta of documents whose count changes: ``counts(..., old_tokens, tokens)``."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"),
                         (F.col("tokens") - F.col("old_tokens")).cast("long").alias("tokens"))


class Rollup:
    """Additive totals by source, language and tokenizer version below one shared folder.

    Each committed state is one Parquet folder ``v<n>`` with the totals and the ids of all
    batches in it; it counts once its write is complete, so a batch is in it wholly or not at
    all. Committing an id again changes nothing, which makes a retry after a lost driver
    safe. One writer at a time. Totals are summed map-side, so a batch shuffles one row per
    key and task; null keys are keys of their own, null counts add nothing.
    """

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _version(self) -> int:
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return 0
        done = [f.getPath() for f in fs.listStatus(top)]
        return max([0, *(int(p.getName()[1:]) for p in done
                         if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))])

    def _state(self) -> DataFrame:
        n = self._version()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{n}") if n else \
            self.spark.createDataFrame([], self.SCHEMA)

    def committed(self, batch: str) -> bool:
        return bool(self._state().where(F.col("batch") == batch).head(1))

    def commit(self, batch: str, *deltas: DataFrame) -> bool:
        """Apply a batch once; False if it is in the totals already."""
        state = self._state()
        if self.committed(batch):
            return False
        changes = state.where("batch IS NULL").select(*KEYS, "docs", "tokens")
        for delta in deltas:
            changes = changes.unionByName(delta.select(*KEYS, "docs", "tokens"))
        totals = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.coalesce(
            F.sum("tokens"), F.lit(0).cast("long")).alias("tokens")).where("docs <> 0 OR tokens <> 0")
        ids = state.where("batch IS NOT NULL").unionByName(
            self.spark.range(1).select(F.lit(batch).alias("batch")), allowMissingColumns=True)
        whole = totals.unionByName(ids, allowMissingColumns=True)
        whole.write.mode("overwrite").parquet(f"{self.path}/v{self._version() + 1}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens), one row per key with anything in it."""
        return self._state().where("batch IS NULL").select(*KEYS, "docs", "tokens")


def replay(docs: DataFrame, path: str) -> DataFrame:
    """Totals of ``docs(text, lang, source, n_chars, ...)`` after a load, a recount and a clean-up.

    The load inserts every document under every tokenizer version with the provisional count
    ``n_chars``; the recount revises it to the true one; the clean-up deletes documents
    without any word. The recount is sent twice, as after a failure, and counts once.
    """
    rollup = Rollup(docs.sparkSession, path)
    per = docs.select("source", "lang", F.coalesce(F.col("n_chars"), F.lit(0)).cast("long").alias("old_tokens"),
                      F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), count_tokens(F.col("text"), t).alias("tokens"))
                                          for t in PATTERNS])).alias("c")).select(
        "source", "lang", "old_tokens", F.col("c.tokenizer").alias("tokenizer"), F.col("c.tokens").alias("tokens"))
    load = docs.select("source", "lang", F.explode(F.array(*map(F.lit, PATTERNS))).alias("tokenizer"),
                       F.coalesce(F.col("n_chars"), F.lit(0)).cast("long").alias("tokens"))
    rollup.commit("load", inserted(load))
    rollup.commit("recount", revised(per))
    rollup.commit("recount", revised(per))
    empty = docs.where(~F.coalesce(F.col("text").rlike(PATTERNS["words-1"]), F.lit(False)))
    gone = empty.select("source", "lang", F.explode(F.array(*map(F.lit, PATTERNS))).alias("tokenizer"),
                        F.lit(0).cast("long").alias("tokens"))
    rollup.commit("clean-up", deleted(gone))
    return rollup.totals()


STATEMENT = """
SELECT source, lang, t.tokenizer, count(*)::BIGINT AS docs, sum(t.tokens)::BIGINT AS tokens
FROM documents, LATERAL (VALUES
    ('words-1', len(regexp_extract_all(text, '[^ \\x09-\\x0D]+'))),
    ('pieces-1', len(regexp_extract_all(text, '\\p{L}+|\\p{N}|[^\\p{L}\\p{N} \\x09-\\x0D]')))) AS t(tokenizer, tokens)
WHERE regexp_matches(coalesce(text, ''), '[^ \\x09-\\x0D]') GROUP BY ALL"""
