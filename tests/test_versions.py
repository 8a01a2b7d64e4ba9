"""Stored tables: versions, migration, failed writes, reset."""

import pytest
from pyspark.sql import functions as F

from tallywright.operators import store
from tallywright.operators.versions import Store


def test_versions(spark, tmp_path):
    tables = Store(spark, f"file://{tmp_path}/tables")
    assert tables.names() == [] and tables.versions("docs") == []
    with pytest.raises(KeyError):
        tables.table("docs")
    assert tables.create("docs", "id string, text string") == 1 and tables.table("docs").count() == 0
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    assert tables.write("docs", store.upsert(tables.table("docs"), new, ["id"])) == 2
    changed = spark.createDataFrame([("b", "z"), ("c", "w")], "id string, text string")
    assert tables.write("docs", store.upsert(tables.table("docs"), changed, ["id"])) == 3  # read from what it replaces
    assert sorted(map(tuple, tables.table("docs").collect())) == [("a", "x"), ("b", "z"), ("c", "w")]
    assert sorted(map(tuple, tables.table("docs", 2).collect())) == [("a", "x"), ("b", "y")]
    assert [r.text for r in tables.lookup("docs", id="c").collect()] == ["w"] and tables.lookup("docs", id="q").isEmpty()
    # a column is added once, others stay
    assert tables.create("docs", "id string, kind int") == 4 and tables.create("docs", "id string, kind int") == 4
    assert tables.table("docs").columns == ["id", "text", "kind"] and tables.table("docs").where("kind IS NULL").count() == 3
    with pytest.raises(ValueError):
        tables.create("docs", "id int")
    # a write that fails leaves the version before it
    bad = tables.table("docs").withColumn("kind", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        tables.write("docs", bad)
    assert tables.versions("docs") == [1, 2, 3, 4] and tables.table("docs").count() == 3
    assert tables.write("docs", tables.table("docs")) == 6
    tables.keep("docs", 2)
    assert tables.versions("docs") == [4, 6]
    tables.create("other", "k int")
    assert tables.names() == ["docs", "other"] and tables.reset("docs", "none") == ["docs"] and tables.reset() == ["other"] and tables.names() == []
