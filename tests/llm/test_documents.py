"""Registered corpus queries and pipeline stages against brute force, and on odd inputs."""

import collections
import itertools
import re
import zlib

import pytest
from conftest import SMALL
from harness import compare, connect
from odd_documents import labels, nothing, odd  # noqa: F401

import corpus_pipeline
from tellerlake.llm import catalog, decontaminate, hilbert, minhash, packing, quality, rollup, scratch, surrogates, toxicity
from tellerlake.llm.shingles import words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("key", sorted(catalog.STATEMENTS))
def test_query_matches_check(spark, key):
    assert compare(catalog.QUERIES[key](spark, SMALL), connect(SMALL), catalog.STATEMENTS[key]) is None


def groups_by_force(texts, size, percent=80):
    sets = {}
    for i, text in texts.items():
        w = words(text)
        n = min(size, len(w))
        sets[i] = {tuple(w[k: k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in itertools.combinations(sorted(i for i in texts if sets[i]), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    found = minhash.near_duplicates(docs, size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == groups_by_force(texts, size)
    assert len(found) == len(texts)


@pytest.mark.parametrize("members", [3, minhash.MEMBERS])
def test_buckets_dealt_out_in_blocks(docs, texts, members, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", members)
    found = minhash.near_duplicates(docs, 2, unit=300 if members > 3 else minhash.UNIT).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == groups_by_force(texts, 2)


def test_near_duplicates_of_odd_documents(odd, nothing):
    found = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 2).collect()]
    assert sorted(found, key=str) == sorted([
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (5, 5, True), (6, 5, False),
        (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True), (10, 10, True)], key=str)
    assert minhash.near_duplicates(nothing).count() == 0


def test_one_id_with_different_texts(spark):
    """Links are confirmed on each text by itself; each row takes its own text's component."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (6, b + " end"), (7, a + " end"), (3, c), (8, c + " end"), (5, c), (9, None), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for unit in (minhash.UNIT, 100):
        found = [(r.doc_id, r.n_shingles, r.component_id, r.kept)
                 for r in minhash.near_duplicates(docs, 2, unit=unit).collect()]
        assert sorted(found) == sorted([
            (5, 79, 5, True), (5, 79, 5, True), (5, 79, 5, True), (6, 80, 5, False), (7, 80, 5, False),
            (3, 79, 3, True), (8, 80, 3, False), (5, 79, 3, False), (9, 0, 9, True), (9, 79, 3, False)])
    wide = docs.selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    left = corpus_pipeline.keep_first_copies(spark, wide, SMALL).collect()
    # of each group one row: that of the least id; a row without words is in no group
    assert sorted((r.doc_id, r.text) for r in left if r.text) == [(3, c), (5, a), (5, b)] and len(left) == 4


def test_copies_with_equal_or_no_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(5, a)] * 3 + [(None, a)] * 2 + [(None, b)] * 2 + [(None, None), (None, "")]
    docs = spark.createDataFrame([(*r, 77, "mine", i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, row_number long, n_words string, _row int")
    left = corpus_pipeline.keep_first_copies(spark, docs, SMALL).collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.text) == [("5", a), ("None", b)] and len(left) == 4
    assert {(r.row_number, r.n_words) for r in left} == {(77, "mine")}


def test_columns_named_like_internal_ones_keep_their_values(spark):
    text = "the quick brown fox came to see Ms Ada Byron at the old mill and wrote to a.b@c.example.com about it all day"
    values = dict(_row=77, n_words="mine", kept=False, probability="p", _text="t", _new=1, _names="n", _mention="m", n_chars=5)
    docs = spark.createDataFrame([(1, text, *values.values())], "doc_id long, text string, _row long, n_words string, kept boolean, "
                                 "probability string, _text string, _new int, _names string, _mention string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for row in stage(spark, docs, SMALL).collect():
            changed = {"n_chars"} if "pii" in name else set()
            assert {k: row[k] for k in values if k not in changed} == {k: v for k, v in values.items() if k not in changed}
    assert surrogates.pseudonymise(docs).first().n_replaced == 2  # a whole name and an address


def test_replaced_words_are_tolerated(spark):
    item = [f"item{i}" for i in range(30)]
    near = [w if i % 9 else "other" for i, w in enumerate(item)]
    far = [w if i % 3 else "other" for i, w in enumerate(item)]
    rows = [(1, "x y " + " ".join(item)), (2, "a " + " ".join(near).upper() + "!"), (3, " ".join(far)), (4, None),
            (5, ""), (6, " ".join(item[:8])), (1, " ".join(item)), (None, " ".join(item))]
    documents = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(
        [(7, " ".join(item), 1), (8, "short one", 1), (9, None, 1), (None, "x", 1)], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(documents, benchmark).collect()}
    assert found == {(1, 7): 20, (2, 7): 18}
    assert decontaminate.contaminated(documents.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(documents, benchmark.limit(0)).count() == 0


def test_base_counts():
    text = "a b c d e  x\na b c d e\n\nx *# <\nx *# <"
    assert quality.base_counts(text) == (17, 19, 6, 1, 12)
    assert quality.base_counts(None) == quality.base_counts("") == (0, 0, 0, 0, 0)
    assert quality.repeated_words([b"a"] * 7) == 7
    assert quality.repeated_words([b"a"] * 5) == 0


def repeated_by_force(w):
    where = collections.defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i: i + 5])].append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)})


def test_quality_rules(spark, texts):
    rows = {r.doc_id: r for r in catalog.op6_quality_rules(spark, SMALL).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        repeated = repeated_by_force(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w))
        assert not (r.kept and r.base_failed)


def ranked(rows, labels, held):
    """Share of (1, 0) pairs of held-out rows in which the 1 has the higher score; ties half."""
    ones = [r.score for r in rows if held(r) and labels.get(r.doc_id) == 1]
    zeros = [r.score for r in rows if held(r) and labels.get(r.doc_id) == 0]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def accuracy(rows, labels, held, predicted):
    pairs = [(predicted(r), labels[r.doc_id]) for r in rows if r.doc_id in labels and held(r)]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/labels.parquet").collect()
    rows = catalog.op5_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, {r.doc_id: r.quality for r in table}, lambda r: r.held_out, lambda r: r.predicted) > 0.85
    assert ranked(rows, {r.doc_id: r.quality for r in table}, lambda r: r.held_out) > 0.98
    rows = catalog.op7_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.toxic for r in table}
    assert accuracy(rows, truth, lambda r: r.held_out, lambda r: r.predicted) > 0.9
    assert accuracy(rows, truth, lambda r: r.held_out and truth[r.doc_id], lambda r: r.predicted) > 0.6
    assert ranked(rows, truth, lambda r: r.held_out) > 0.8


def test_models_on_odd_documents(odd, nothing, labels):
    for run in (quality.classify, toxicity.rate, quality.rules):
        assert run(odd, labels).count() == odd.count()
        assert run(nothing, labels).count() == 0
        assert run(odd, labels.limit(0)).count() == odd.count()
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in toxicity.rate(odd, labels.limit(0)).collect()} == {0.0}


def test_toxic_spellings_and_exceptions():
    machine = toxicity.automaton({"idiot$": 8.0, "clown$": 8.0, "lowei": 7.0})
    for text in ("an idiot", "an 1d1ot!", "an Іdiоt", "LOWEIHEIT da", "a clown."):
        assert toxicity.score(text, machine) > 0.3, text
    for text in ("idiots", "a clown fish", "slowei", "", None):
        assert toxicity.score(text, machine) == 0.0, text


def test_surrogates(spark):
    rows = [(1, "Ms Ada Byron, Ms. Byron: +1 (743) 555-3824, Ada.B@Mail7.Example.com ADA.B@MAIL7.EXAMPLE.COM"),
            (2, "Herr Karl Byron 10.1.2.3 4111111111111111 743-555-3824 Госпожа Анна Ленина"), (3, None), (4, ""),
            (5, "v4.0. 2.0. 12:30 1990-01-02 no entity")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_replaced string")
    out = {r.doc_id: r.text for r in surrogates.pseudonymise(df, "k").collect()}
    assert (out[3], out[4], out[5]) == (None, "", rows[4][1])
    m = re.fullmatch(r"Ms (\w\w[a]) (\w+), Ms\. (\w+): \+1 \((\d{3})\) (\d{3})-(\d{4}), (\S+@\S+\.com) (\S+)", out[1])
    n = re.fullmatch(r"Herr (\w+l) (\w+) (\d+\.\d+\.\d+\.\d+) (4\d{15}) (\S+) Госпожа ([А-я]+а) ([А-я]+)", out[2])
    assert m and n and m[2] == m[3] == n[2] != "Byron" and m[7].upper() == m[8]
    assert n[5] == f"{m[4]}-{m[5]}-{m[6]}" != "743-555-3824"
    digits = [int(d) for d in n[4]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    again = {r.doc_id: r.text for r in surrogates.pseudonymise(df, "k").collect()}
    assert again == out and surrogates.pseudonymise(df.limit(0)).count() == 0


def test_surrogates_never_collide(spark):
    # two-digit values: nearly all first draws are real values or drawn twice
    values = spark.range(40).selectExpr("'ssn' AS kind", "lpad(CAST(id AS STRING), 2, '0') AS value")
    rows = surrogates.entity_map(values, "k", rounds=200).collect()
    assert len(rows) == len({r.surrogate for r in rows}) == 40
    assert not {r.surrogate for r in rows} & {r.value for r in rows}


def test_surrogates_of_small_tables(docs, texts):
    mail = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]*\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d+\.\d+\.\d+\.\d+|AKIA\w{16}|\d{16}")
    found = {r.doc_id: r.text for r in surrogates.pseudonymise(docs).collect()}
    real = {m for t in texts.values() for m in mail.findall(t)}
    pairs = {(a, b) for i, t in texts.items() for a, b in zip(mail.findall(t), mail.findall(found[i]), strict=True)}
    assert real and not {b for _, b in pairs} & real
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_packing(odd, nothing, docs, texts):
    for table in (docs, odd):
        rows = packing.pack(table, capacity=100, group=50).collect()
        source = {r.doc_id: r.source for r in table.collect()}
        bins = collections.defaultdict(list)
        for r in rows:
            if r.n_words:
                bins[r.bin_id].append(r)
        for inside in bins.values():
            assert sum(r.n_words for r in inside) <= 100
            named = [source[r.doc_id] for r in inside if source[r.doc_id]]
            assert len(named) == len(set(named))
            ends = sorted((r.bin_start, r.bin_start + r.n_words) for r in inside)
            assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends))
    total = collections.Counter()
    for r in packing.pack(docs, capacity=100).collect():
        total[r.doc_id] += r.n_words
    assert total == {i: len(words(t)) for i, t in texts.items()}
    assert packing.pack(nothing).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    items = [(60, "a", 1), (50, "b", 2), (30, "a", 3), (30, "c", 2), (40, "d", 4)]
    # 40 fills the first bin; 30 of "a" goes to the second; 30 of "c" conflicts there by cluster
    assert packing.best_fit(items, 100) == [(0, 0), (1, 0), (1, 50), (2, 0), (0, 60)]


def test_hilbert_neighbours_touch():
    import numpy as np
    axes = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    cells = [a.ravel() for a in axes]
    order = np.argsort(hilbert.curve_index(cells, 3))
    path = np.stack(cells)[:, order]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_shards_of_odd_documents(spark, odd, nothing):
    rows = hilbert.shards(odd, 5).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == odd.count()
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert hilbert.shards(nothing).count() == 0
    placed = hilbert.shards(odd.where("doc_id NOT IN (5)"), 5)
    assert hilbert.prune(hilbert.manifest(placed), source=(0, 31)).count() == 5
    path = scratch.new_path(spark, "shards")
    hilbert.write_shards(odd.where("doc_id NOT IN (5)"), placed, path)
    assert spark.read.parquet(path).count() == odd.where("doc_id NOT IN (5)").count()


def test_rollup_counts_a_batch_once(spark, odd):
    path = scratch.new_path(spark, "rollup")
    rows = spark.createDataFrame([("s", "en", "t", 5), ("s", "en", "t", 7), (None, "en", "t", 1)],
                                 "source string, lang string, tokenizer string, tokens long")
    one = rollup.Rollup(spark, path)
    assert one.totals().count() == 0
    assert one.commit("a", rollup.inserted(rows)) and not one.commit("a", rollup.inserted(rows))
    assert one.commit("b", rollup.revised(rows.withColumn("old_tokens", rows.tokens).withColumn("tokens", rows.tokens + 1)),
                      rollup.deleted(rows.where("source IS NULL").selectExpr("*").withColumn("tokens", rows.tokens + 1)))
    assert [tuple(r) for r in rollup.Rollup(spark, path).totals().collect()] == [("s", "en", "t", 2, 14)]
    assert rollup.replay(odd, scratch.new_path(spark, "rollup")).count() > 0
    assert rollup.replay(odd.limit(0), scratch.new_path(spark, "rollup")).count() == 0


def test_stages_keep_columns_and_stand_odd_documents(spark, odd, nothing):
    for table in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SMALL).columns == odd.columns
            stage(spark, table, SMALL).count()


def test_pipeline(spark, texts):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    judged = {r.doc_id: r.kept for r in catalog.op6_quality_rules(spark, SMALL).collect()}
    left = {i: t for i, t in texts.items() if judged[i]}
    left = {i: left[i] for i, (_, _, kept) in groups_by_force(left, 5).items() if kept}
    leaked = {r.doc_id for r in catalog.op3_contaminated(spark, SMALL).collect()}
    assert leaked and {r.doc_id for r in rows} == left.keys() - leaked
