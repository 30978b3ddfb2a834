"""Odd documents that every operator and stage must stand."""

import pytest

FILLER = "the of and to in a is that it was for on are as with his they at be this from have"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n", None, None), (4, "one", "en", "s"),
        (5, FILLER, "en", "s"), (5, FILLER, "en", "s"), (6, FILLER, "fr", "t"), (None, FILLER, "en", "s"),
        (7, long, "de", "s"), (8, long + " more", "de", "s"), (9, "mail a.b@c.example.com now", "en", "u"),
        (10, "naïve \U0001f600 <b>&amp; \x00 end", "xx", "u"),
    ]
    return spark.createDataFrame(
        [(*r, len(r[1]) if r[1] else None, "extra", True, -1.5, 7) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, "
        "component_id string, kept boolean, score double, bin_id int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(5, None, None), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")
