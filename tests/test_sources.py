"""Malformed records, replacement of tables at once, counts from one read."""

import pytest
from pyspark.sql import functions as F
from tellerlake.operators import cleaning
from tellerlake.schema import ORDINAL, RAW_COLUMNS, TABLE_COLUMNS
from tellerlake.sources import files, store


def test_malformed_records_come_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,w\n1,a,x\n2,b\n3,c,y,more\n4,"d,e",z\n5,,\n\n6\n')
    (tmp_path / "b.csv").write_text('k,v,w\n7,f,g\n"8,h,i\n')
    rows = files.read_by_name(spark, str(tmp_path), ["w", "k"]).collect()
    assert sorted((r.k, r.w) for r in rows if r.k.isdigit()) == [("1", "x"), ("4", "z"), ("5", None), ("7", "g")]
    assert {r.record for r in files.read_malformed(spark, str(tmp_path)).collect()} >= {"2,b", "3,c,y,more", "6"}
    counts = {r.file.split("/")[-1]: r.records for r in files.malformed_counts(spark, str(tmp_path)).collect()}
    assert counts["a.csv"] == 3
    with pytest.raises(ValueError, match="missing columns: z"):
        files.read_by_name(spark, str(tmp_path), ["k", "z"])


def test_a_column_named_like_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,_malformed\n1,a\n2\n")
    assert [tuple(r) for r in files.read_by_name(spark, str(tmp_path), ["_malformed", "k"]).collect()] == [("a", "1")]
    assert files.read_malformed(spark, str(tmp_path)).first().record == "2"


def test_raw_records_cut_short_do_not_become_customers(spark, bank, tmp_path):
    path = str(tmp_path / "raw")
    files.write_csv(bank.select(*RAW_COLUMNS).coalesce(1).limit(5), path)
    part = next((tmp_path / "raw").glob("part-*.csv"))
    lines = part.read_text().splitlines()
    (tmp_path / "raw" / ("." + part.name + ".crc")).unlink(missing_ok=True)
    part.write_text("\n".join([*lines[:4], lines[4].rsplit(",", 3)[0], lines[5] + ",9"]) + "\n")
    assert files.read_raw_csv(spark, path).count() == 3
    assert {r.record for r in files.read_malformed(spark, path).collect()} == {lines[4].rsplit(",", 3)[0], lines[5] + ",9"}


def test_tables_are_replaced_at_once(spark, bank, tmp_path, monkeypatch):
    path = str(tmp_path / "bank")
    with pytest.raises(ValueError, match="no tables"):
        store.open_tables(spark, path)
    store.build_tables(bank, path)
    fewer = bank.limit(7)
    split = store.split_tables

    def failing(df):
        tables = split(df)
        third = list(tables)[2]
        tables[third] = tables[third].withColumn("bad", F.raise_error(F.lit("lost")))
        return tables
    monkeypatch.setattr(store, "split_tables", failing)
    with pytest.raises(Exception, match="lost"):
        store.build_tables(fewer, path)
    monkeypatch.undo()
    old = store.open_tables(spark, path)
    assert {n: t.count() for n, t in old.items()} == dict.fromkeys(TABLE_COLUMNS, bank.count())
    assert spark.sql("SELECT count(*) FROM loans JOIN customers USING (Customer_ID)").first()[0] == bank.count()
    for n in (7, 6, 5):
        store.build_tables(bank.limit(n), path)
    assert {n: t.count() for n, t in store.open_tables(spark, path).items()} == dict.fromkeys(TABLE_COLUMNS, 5)
    assert len(list((tmp_path / "bank" / "current").glob("0*"))) == 2


def test_stage_report_reads_raw_rows_once(spark, bank, tmp_path):
    from tellerlake.sources import star

    raw = star.with_defects(bank)
    seen = raw.count()
    report = {r.stage: r.rows for r in cleaning.stage_report(raw).collect()}
    assert report["raw"] == seen > report["dedup"] == raw.select("Customer_ID").distinct().count() >= report["final"] > 0
    empty = {r.stage: r.rows for r in cleaning.stage_report(raw.limit(0)).collect()}
    assert empty == {"raw": 0, "dedup": 0, "final": 0}
    counted = cleaning.first_rows_counted(raw, "_copies")
    assert counted.drop("_copies").exceptAll(cleaning.drop_repeats(raw).select(*raw.columns)).count() == 0
    assert ORDINAL in counted.columns
