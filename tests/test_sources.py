"""Readers and writers on files."""
import os

import pytest
from pyspark.sql import functions as F

from panelspark.plans import reports as R
from panelspark.sources import io as S
from panelspark.sources.stage import stage


def test_wide_panel_finds_the_date_column_and_drops_bad_numbers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,Date,aaa, bbb \n1,2024-01-02,10,\n2,2024-01-03,x,5.5\n")
    rows = S.read_wide_panel(spark, str(tmp_path / "p.csv")).where("key <> 'ID'").collect()
    assert {(r.key, str(r.date), r.price) for r in rows} == {("AAA", "2024-01-02", 10.0), ("BBB", "2024-01-03", 5.5)}


def test_required_column(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Name\nx\n")
    with pytest.raises(ValueError, match="Ticker"):
        S.read_universe(spark, str(tmp_path / "u.csv"))


def test_duplicate_rate_month_raises(spark, tmp_path):
    (tmp_path / "r.csv").write_text("observation_date,X\n2024-01-01,5.0\n2024-01-15,5.1\n2024-02-01,.\n")
    with pytest.raises(Exception, match="duplicate month"):
        S.read_rate(spark, str(tmp_path / "r.csv"), "X").collect()


def test_delimited_text(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('﻿a,b\r\n"x ""q"", y",2\r\n"two\r\nlines",3\r\n'.encode())
    d = S.read_delimited(spark, str(tmp_path / "t.csv"))
    assert [r[0] for r in d.collect()][0] == 'x "q", y' and d.count() == 2


def test_bundle_refuses_bad_records_and_overwrites(spark, tmp_path):
    rec = spark.createDataFrame([("g", "FAIL", "PASS", "PASS")], "gate string, mechanical string, composition string, label string")
    data = spark.range(3)
    prov = S.provenance(data, "p", "id", "src")
    out = str(tmp_path / "b")
    with pytest.raises(ValueError, match="inconsistent"):
        S.write_bundle({"t": data}, rec, out, prov)
    good = rec.withColumn("label", F.lit("FAIL"))
    with pytest.raises(ValueError, match="provenance"):
        S.write_bundle({"t": data}, good, out, None)
    assert not (tmp_path / "b").exists()
    S.write_bundle({"t": data}, good, out, prov)
    with pytest.raises(Exception):
        S.write_bundle({"t": data}, good, out, prov)


def test_stage_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = len(os.listdir(shared))
    assert stage(spark.range(5)).count() == 5
    assert len(os.listdir(shared)) == before + 1


def test_correction_rules(spark):
    s = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", 2.0), ("a", "m3", 3.0)], "series_id string, month string, ret double")
    c = spark.createDataFrame([("a", "m1", 1.0, 9.0), ("a", "m2", 7.0, 8.0)], "series_id string, month string, bad double, good double")
    got = {r.month: (r.action, r.ret) for r in R.apply_corrections(s, c).collect()}
    assert got == {"m1": ("replaced", 9.0), "m2": ("dropped", None), "m3": ("kept", 3.0)}
