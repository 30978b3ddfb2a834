"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import SAMPLE_ROWS, fold, sample

TOXIC_AT = 0.3
STEMS = (4, 5, 6)  # lengths of word beginnings that may become an entry
SUPPORT = 3  # labelled texts that an entry must explain by itself
REMEMBERED = 200_000  # written words that a task remembers at once

# Look-alike letters of other scripts, and signs written for letters within words.
# Capitals come before lower-casing: there other letters look alike than among small ones.
CAPITALS = str.maketrans("АВЕЅІЈКМНОРСТУХԚԜҮҺΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABESIJKMHOPCTYXQWYHABEZHIKMNOPTYXC")
HOMOGLYPHS = str.maketrans("авекмнтгорсухіїјѕүһԁԛԝӏαβγεικνορτυχωϲɑɡıⅼ", "abekmhtropcyxiijsyhdqwlabyeikvoptuxwcagil")
# Latin letters with a stroke or hook, which no decomposition takes off.
HOMOGLYPHS |= str.maketrans({"ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t", "ƀ": "b", "ɨ": "i", "ʉ": "u", "ß": "ss",
                             "æ": "ae", "œ": "oe", "ð": "d", "ŋ": "n", "ɇ": "e", "ƙ": "k", "ƞ": "n", "ȼ": "c", "ᵽ": "p"})
# Characters of category Cf with the variation selectors, and marks that stand on a Latin letter.
FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064"
                    "\u2066-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000110bd\U000110cd\U00013430-\U0001343f"
                    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f]")
MARKS = re.compile("(?<=[a-z\u00df-\u024f])[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]+")
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")

# Harmless phrases that hold words which may be entries.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "idiot proof", "pathetic fallacy",
              "stupid simple", "loser bracket", "pond scum")


def _plain(text: str) -> str:
    """Lower case without format characters, look-alike letters and marks on Latin letters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", FORMAT.sub("", text)).translate(CAPITALS).lower()
    return unicodedata.normalize("NFC", MARKS.sub("", text.translate(HOMOGLYPHS)))


class FoldedWords(dict):
    """Folded words by written word, remembered while a task works; very long words are not kept."""

    def __missing__(self, word: str) -> list[str]:
        found = _folded(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def _folded(text: str) -> list[str]:
    out = []
    for word in _plain(text).split():
        if not word.isalpha():
            word = word.strip(".,;:?\"'()[]{}*#&%-_…»«")
            if any(c.isalpha() for c in word):
                word = word.rstrip("!|").translate(SUBSTITUTES)
            word = "".join(c if c.isalpha() else " " for c in word)
        out += word.split()
    return out


def folded(text: str | None, known: FoldedWords | None = None) -> list[str]:
    """Words of a whole text with homoglyphs, accents of Latin letters and digit spellings folded.

    No step looks beyond white space, so each written word is folded by itself, and once.
    """
    known = FoldedWords() if known is None else known
    return [w for word in (text or "").split() for w in known[word]]


def entries(word: str) -> list[str]:
    """What a word may be listed as: itself (``word$``) or one of its beginnings."""
    return [f"{word}$", *[word[:n] for n in STEMS if len(word) > n]]


def learn(rows: list[tuple[str, int]], support: int = SUPPORT, purity: float = 0.9) -> dict[str, float]:
    """Weighted lexicon from a bounded list of (text, toxic).

    Among words and beginnings of words found nearly only in toxic texts, the one that
    explains most toxic texts not explained so far is taken again and again, the longer of
    equals. A word that merely stands beside stronger ones explains nothing and stays out.
    Words pure by themselves in a twentieth of the toxic texts (``8`` at least) join them.
    The weight is the smoothed log-odds of an entry against the prior.
    """
    toxic, bad, good, known = [], Counter(), Counter(), FoldedWords()
    for text, y in dict.fromkeys(rows):
        found = {e for w in set(folded(text, known)) for e in entries(w)}
        (bad if y else good).update(found)
        if y:
            toxic.append(found)
    pure = {e for e, n in bad.items() if n >= support and n >= purity * (n + good[e])}
    left = [found & pure for found in toxic]
    counts = Counter(e for found in left for e in found)
    holders: dict[str, list[int]] = {}
    for k, found in enumerate(left):
        for e in found:
            holders.setdefault(e, []).append(k)
    prior = math.log((len(toxic) + 1) / (len(rows) - len(toxic) + 1)) if rows else 0.0

    def weight(entry: str) -> float:
        return math.log((bad[entry] + 0.5) / (good[entry] + 0.5)) - prior

    lexicon: dict[str, float] = {}
    while counts:
        best = max(counts, key=lambda e: (counts[e], len(e), e))
        if counts[best] < support:
            break
        lexicon[best] = weight(best)
        for k in holders[best]:
            counts.subtract(left[k])
            left[k] = set()
        counts = +counts
    often = max(8, len(toxic) / 20)
    return lexicon | {e: weight(e) for e in sorted(pure) if e.endswith("$") and bad[e] >= often}


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    """Aho-Corasick over ``" word"`` beginnings; a whole word ends with a space as well."""
    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        machine.add_word(f" {entry[:-1]} " if entry.endswith("$") else f" {entry}", (len(entry), weight, False))
    for phrase in exceptions:
        text = f" {' '.join(folded(phrase))} "
        machine.add_word(text, (len(text) - 1, 0.0, True))
    machine.make_automaton()
    return machine


def score(text: str | None, machine, known: FoldedWords | None = None) -> float:
    """1 - exp(-x), x: weights of matched words outside exception phrases, normalised by length."""
    found = folded(text, known)
    hits: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight, excuse) in machine.iter(f" {' '.join(found)} "):
        if excuse:
            excused.append((end - size, end - 1))
        else:
            start = end - size  # the space before the word
            hits[start] = max(hits.get(start, 0.0), weight)
    total, reach, spans = 0.0, -1, sorted(excused, reverse=True)
    for at in sorted(hits):  # both lists walked once
        while spans and spans[-1][0] <= at:
            reach = max(reach, spans.pop()[1])
        if at > reach:
            total += hits[at]
    return 1.0 - math.exp(-total / (2.0 + math.log2(1.0 + len(found) / 50)))


def rate(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = SAMPLE_ROWS,
         exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text, ...)``.

    The lexicon is learned from the labels of at most about ``rows`` documents outside the
    held-out fold (crc32 of the id, modulo ``folds``, equal to ``held``); scores use the text
    only. Null and empty texts score 0. A null doc_id is not held out and comes back as null;
    repeated rows get equal scores; other columns are ignored. Without labels all score 0.
    """
    usable = fold(F.col("doc_id"), folds) != held
    lexicon = _learned(sample(docs, labels, "toxic", usable, rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(lexicon, exceptions), FoldedWords()
        for batch in batches:
            found = np.array([score(t.as_py(), machine, known) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(judge, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def _learned(sampled: DataFrame) -> dict[str, float]:
    """The lexicon, learned by one task over the bounded sample; only its entries come back."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("text", "y")), strict=True)
        found = learn(sorted(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["entry", "weight"])

    rows = sampled.repartition(1).mapInArrow(one, "entry string, weight double").collect()
    return {r.entry: r.weight for r in sorted(rows)}
