"""Byte-pair encoding against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from odd_documents import labels, nothing, odd  # noqa: F401

from tellerlake.llm import byte_pairs, catalog, pretokens

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIGNS = list("aabcstremdvl'''  \n\t\r12٣½-.!é中\U0001f600 　́\x1c\x1f​\x00") + [
    "'s", "'re", "'ll", "'ve", " '", "  "]


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_pairs.Encoder(ranks, byte_pairs.Merges(ranks), pretokens.Splitter())


def random_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_random_texts(encoder, library):
    texts = random_texts(4000, 1)
    for text, found in zip(texts, encoder.ids(texts)):
        assert found.tolist() == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_state_is_carried_over_chunks(encoder, chunk):
    joined = "".join(random_texts(60, 2))
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    args = (points, encoder.classes)
    assert encoder.splitter.boundaries(*args, chunk).tolist() == encoder.splitter.boundaries(*args).tolist()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 600 + "'s" * 300, " " * 3000 + "x", "é" * 2000, "\n" * 999,
                                  "qz" * 48, "qz" * 49, "'" * 500, "x'll'llama"])
def test_long_runs(encoder, library, text):
    assert encoder.ids([text])[0].tolist() == library.encode_ordinary(text)


def test_a_megabyte_without_a_boundary(encoder, ranks):
    pieces = {r: t for t, r in ranks.items()}
    text = "qx" * 500_000
    assert b"".join(pieces[i] for i in encoder.ids([text])[0].tolist()) == text.encode()


def test_query_against_the_library(spark, library):
    found = {r.doc_id: r for r in catalog.op11_byte_pairs(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest())
        assert (found[doc_id].n_tokens, found[doc_id].ids_sha256, found[doc_id].decoded_sha256) == want


def test_odd_documents(odd, nothing, library):  # noqa: F811
    tokens = byte_pairs.decode(byte_pairs.encode(odd, PATH), PATH)
    rows = tokens.join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        data = (r.text or "").encode()
        ids, at = np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.offsets, "<i8").tolist()
        assert bytes(r.decoded) == data and ids == library.encode_ordinary(r.text or "")
        assert at == sorted(set(at)) and all(a < len(data) for a in at)
    assert tokens.count() == odd.count()
    assert byte_pairs.digests(byte_pairs.decode(byte_pairs.encode(nothing, PATH), PATH)).count() == 0


def test_wrong_offsets_are_refused(odd):  # noqa: F811
    from pyspark.sql import functions as F

    tokens = byte_pairs.encode(odd.where("doc_id = 5"), PATH).withColumn("offsets", F.col("offsets").substr(9, 1000))
    with pytest.raises(Exception, match="offsets do not belong"):
        byte_pairs.decode(tokens, PATH).collect()
