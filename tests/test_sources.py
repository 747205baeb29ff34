import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tidewright.sources import scan_csv, scan_parquet, sink_csv

TEXTS = ["plain", "two\nlines", 'quote " and, comma', "back\\slash", "\\n is no line break", "a\r\nb", "\\\\n\n", "end\\", " spaces ", "", None]


@pytest.mark.parametrize("option", ["multiline", "one_line"])
def test_csv_keeps_line_breaks(spark, tmp_path, option):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    path = sink_csv(df, str(tmp_path / option), one_line=option == "one_line")
    got = scan_csv(spark, path, "id long, text string", **{option: True}).collect()
    assert {r["id"]: r["text"] for r in got} == {i: t or None for i, t in enumerate(TEXTS)}


def test_csv_refuses_broken_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "two\nlines")], "id long, text string")
    path = sink_csv(df, str(tmp_path / "plain"))
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_csv(spark, path, "id long, text string").select("id").collect()
    assert scan_csv(spark, path, "id long, text string", strict=False).count() == 2


def test_parquet_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "prices")
    spark.createDataFrame([(1, 2.5), (2, float("nan"))], "id long, price double").write.parquet(path)
    out = io.StringIO()
    with redirect_stdout(out):
        scan_parquet(spark, path).filter(F.col("price") > 2.0).explain("formatted")
    assert "GreaterThan(price,2.0)" in out.getvalue()
    assert scan_parquet(spark, path, nan_columns=["price"]).filter("price is null").count() == 1
