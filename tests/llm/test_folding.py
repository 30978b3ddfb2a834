"""Spellings that the folding step must undo."""

import math
import random
import sys
import time
import unicodedata

import pytest

from tellerlake.llm import toxicity


@pytest.mark.parametrize("spelling", [
    "ïdiot", "stüpid", "i\u0308diot", "ÍDIÓT",  # accents, composed and not
    "МORON", "ТRASH", "SCUМ", "ТRАЅН", "ΜORON", "SCUΜ",  # capitals of Cyrillic and Greek
    "mоrоn", "тrash", "sсuм", "кiller", "ΚILLER", "ΒIGOΤ", "вigoт", "ΖERO", "ҺERO",  # small and capital letters
    "id\u200biot", "id\u00adiot", "mo\u2060ron", "\ufeffscum", "łoser", "IDІОТ", "idiόt", "НЁRО"])
def test_each_form_folds(spelling):
    plain = {"idiot", "stupid", "moron", "trash", "scum", "killer", "bigot", "zero", "hero", "loser"}
    assert set(toxicity.folded(f"an {spelling}!")) - {"an"} <= plain
    machine = toxicity.automaton({f"{w}$": 8.0 for w in plain})
    assert toxicity.score(f"an {spelling}!", machine) > 0.3


def test_other_words_stay():
    assert toxicity.folded("plain text, 3.5 c4t") == ["plain", "text", "cat"]
    assert toxicity.folded("\u0939\u093f\u0928\u094d\u0926\u0940 \uac00\ub098") != []
    assert toxicity.folded(None) == []


def test_every_format_character_goes():
    left = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf"
            and toxicity.folded(f"id{c}iot") != ["idiot"]]
    assert left == []


def test_words_folded_one_by_one():
    """As when the whole text is folded at once, with any white space and marks between words."""
    text = "́a ́ ïd​iot ΣΑΣ ΟΔΟΣ. ç lœser mor0n! ¨x ﷺ İx ȩ́ 1diot|"
    assert toxicity.folded(text) == toxicity._folded(text)
    rng = random.Random(5)
    signs = "aAzZ oO0$!|.,̧́  ​­ïСсΣς¨İß中\nẞ'-"
    known = toxicity.FoldedWords()
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(40)))
        assert toxicity.folded(text, known) == toxicity._folded(text), ascii(text)


def test_scores_against_plain_matching():
    """Every entry looked for at every word, phrases by comparing words: the same sums."""
    lexicon = {"idiot$": 3.0, "tras": 2.0, "trash$": 4.0, "clow": 1.5, "scum$": 2.5, "fish$": 1.0}
    phrases = ("clown fish", "trash can", "pond scum", "fish trash can")
    machine, rng = toxicity.automaton(lexicon, phrases), random.Random(6)
    vocabulary = "idiot trash trashy can clown fish pond scum a scums".split()
    for _ in range(2000):
        found = rng.choices(vocabulary, k=rng.randrange(30))
        excused = {i + k for p in phrases for i in range(len(found)) for k in range(len(p.split()))
                   if found[i: i + len(p.split())] == p.split()}
        total = sum(max((w for e, w in lexicon.items() if (word == e[:-1] if e.endswith("$") else word.startswith(e))), default=0)
                    for i, word in enumerate(found) if i not in excused)
        plain = 1 - math.exp(-total / (2 + math.log2(1 + len(found) / 50)))
        assert abs(toxicity.score(" ".join(found), machine) - plain) < 1e-9


def test_many_exceptions_take_linear_time():
    machine = toxicity.automaton({"trash$": 4.0})
    begun = time.perf_counter()
    assert toxicity.score("trash can " * 100_000, machine) == 0.0
    assert toxicity.score("x" * 5_000_000, machine) == 0.0
    assert time.perf_counter() - begun < 10
