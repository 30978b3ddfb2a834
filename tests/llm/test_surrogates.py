"""Surrogates where forms run out, and what is found."""

import itertools
import re

from tellerlake.llm import surrogates


def test_small_forms_run_out(spark):
    # "Wu": 105 forms, 90 of them real; given names of two letters: 21; values with nothing to replace
    short = [a + b for a, b in itertools.product("BCDFGHJKLMNPQRSTVWXYZ"[:18], "aeiou")]
    values = [("name", v) for v in short] + [("name", "Øð"), ("email", "-@-.com"), ("secret", "________")]
    values += [("name_f", a + "a") for a in "BCDFGHJKLMNPQRSTVWXYZ"[:15]] + [("name", "Ли"), ("name", "Бо")]
    rows = surrogates.entity_map(spark.createDataFrame(values, "kind string, value string"), "k", rounds=3).collect()
    assert len(rows) == len(values) == len({(r.kind, r.surrogate) for r in rows})
    assert not {(r.kind, r.surrogate) for r in rows} & set(values)
    assert all(r.surrogate.endswith("a") for r in rows if r.kind == "name_f")
    assert all(r.surrogate.isalpha() for r in rows if r.kind.startswith("name"))


def test_secrets_without_letters_or_digits(spark):
    docs = spark.createDataFrame([(1, "password: ________"), (2, 'token = "----------"'), (3, "token=__abcd123")],
                                 "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_replaced) for r in surrogates.pseudonymise(docs).collect()}
    assert out[1] == ("password: ________", 0) and out[2] == ('token = "----------"', 0)
    assert out[3][1] == 1 and out[3][0] != "token=__abcd123"


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.text, r.n_replaced) for r in surrogates.pseudonymise(docs, "k").collect()}


def test_secrets_in_any_case_and_in_json(spark):
    texts = ("Password: hunter2xyz", "API_KEY=abcd1234efgh", "PASSWORD='Abc12345x'", '{"api_key": "abcd1234efgh"}')
    out = replaced(spark, *texts)
    for i, text in enumerate(texts):
        assert out[i][1] == 1 and out[i][0] != text and len(out[i][0]) == len(text)
    assert out[0][0].startswith("Password: ") and out[1][0].startswith("API_KEY=")
    assert re.fullmatch(r"\{\"api_key\": \"[a-z0-9]{12}\"\}", out[3][0]) and out[1][0][8:] == out[3][0][13:25]


def test_further_mentions_and_one_surrogate_a_name(spark):
    out = replaced(spark, "Ms Ada Byron came. Then Byron said: Ada Byron's ada Byronic. Mail byron@Byron.com", "Dr Ada Byron",
                   "Ms Ada", "Byron and Ada without a title")
    m = re.fullmatch(r"Ms (\w+a) (\w+) came\. Then (\w+) said: (\w+) (\w+)'s ada Byronic\. Mail (\S+)", out[0][0])
    assert m and m[2] == m[3] == m[5] != "Byron" and m[1] == m[4] != "Ada" and out[0][1] == 5
    assert out[1][0] == f"Dr {m[1]} {m[2]}" and out[2][0] == f"Ms {m[1]}"
    assert out[3] == ("Byron and Ada without a title", 0)


def test_very_long_words(spark):
    """A long text without a space, in the form of each kind."""
    n = 300_000
    texts = ["Mr A" + "a" * n, "Mr A" + "-a" * (n // 2), "a@b" + ".c" * (n // 2), "a@b" + ".cc" * (n // 3), "a" * n + "@b.com", "a." * (n // 2),
             "password: " + "a" * 20_000, "password: " + "_" * n, "1" * n, "1-" * (n // 2), "1." * (n // 2), "AKIA" + "A" * n, "+1 " + "2 " * (n // 2),
             "Ms " + "Ada " * (n // 4), "Ms Ada" + " " * n + "Ada"]
    out = replaced(spark, *texts)
    assert len(out) == len(texts)
    assert out[6][1] == 1 and len(out[6][0]) == len(texts[6]) and out[6][0] != texts[6]
    assert out[14][1] == 2 and "Ada" not in out[14][0]


def test_names_of_many_parts(spark):
    out = replaced(spark, "Ms Ada Maria Lovelace Byron King went home", "Herr Jean-Luc O'Neill's hat")
    assert out[0][1] == 1 and not {"Ada", "Maria", "Lovelace", "Byron", "King"} & set(out[0][0].split())
    assert re.fullmatch(r"Ms \w+ \w+ \w+ \w+ \w+ went home", out[0][0])
    assert re.fullmatch(r"Herr \w+-\w+ \w'\w+'s hat", out[1][0]) and "Neill" not in out[1][0]
