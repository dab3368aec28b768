"""Tables with a change log against a plain dictionary, versions, compaction and two writers at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from boxtally.operators import tables
from boxtally.session import scratch_path
from boxtally.sources.change_log import LoggedTable, Outdated

SCHEMA = "id string, month string, status string, n int"


def new_table(spark, by_month=True, **kw):
    return LoggedTable(spark, scratch_path(spark, "logged"), SCHEMA, ["id"], part=(lambda: F.col("month")) if by_month else None, **kw)


def rows_of(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("by_month", [True, False])
def test_changes_equal_a_dictionary(spark, by_month):
    rng = random.Random(7)
    table = new_table(spark, by_month, buckets=5)
    want = {str(i): (f"1995-{i % 6:02d}", "new", i) for i in range(40)}
    table.create(spark.createDataFrame([(k, *v) for k, v in want.items()], SCHEMA))
    versions = {table.version(): dict(want)}
    for step in range(9 if by_month else 5):
        ids = [str(rng.randrange(60)) for _ in range(8)]
        keys = spark.createDataFrame([(i,) for i in ids], "id string")
        kind = step % 4
        if kind == 0:
            batch = [(i, f"1995-{int(i) % 6:02d}", "inserted", step) for i in ids]
            table.insert_if_absent(spark.createDataFrame(batch, SCHEMA), ["n"])
            for b in batch:
                want.setdefault(b[0], b[1:])
        elif kind == 1:
            table.update(keys, lambda df, step=step: df.withColumns({"status": F.lit(f"s{step}"), "n": F.lit(step)}))
            want |= {i: (want[i][0], f"s{step}", step) for i in ids if i in want}
        elif kind == 2:
            table.delete(keys)
            want = {k: v for k, v in want.items() if k not in ids}
        else:
            table.compact(None if step > 4 else ["1995-01", "1995-02", "0001", "0003"])
        versions[table.version()] = dict(want)
        assert rows_of(table.read()) == want
        assert rows_of(table.current(keys)) == {i: want[i] for i in ids if i in want}
    for version in list(versions)[1::3]:
        assert rows_of(table.read(version)) == versions[version]
    table.compact()
    assert not table._state()["log"]
    table.clean()
    assert rows_of(table.read()) == want


def test_only_touched_parts_are_rewritten(spark):
    table = new_table(spark)
    table.create(spark.createDataFrame([(str(i), f"1995-{i % 4:02d}", "new", i) for i in range(20)], SCHEMA))
    before = table._state()["base"]
    table.update(spark.createDataFrame([("1",), ("5",)], "id string"), lambda df: df.withColumn("status", F.lit("x")))
    assert table._state()["base"] == before and table._busy(table._state()) == {"1995-01"}
    table.compact()
    after = table._state()["base"]
    assert {p for p in after if after[p] != before[p]} == {"1995-01"}


def test_of_two_writers_the_later_is_refused(spark):
    table = new_table(spark)
    table.create(spark.createDataFrame([("a", "1995-01", "new", 1)], SCHEMA))
    state = table._state()
    row = spark.createDataFrame([("b", "1995-01", "new", 2)], SCHEMA).withColumn("_gone", F.lit(False))
    table._append(state, row)
    with pytest.raises(Outdated):
        table._append(state, row.withColumn("id", F.lit("c")))
    assert set(rows_of(table.read())) == {"a", "b"}


def test_deleting_all_rows_and_empty_changes(spark):
    table = new_table(spark)
    assert table.read().count() == 0
    table.create(spark.createDataFrame([("a", "1995-01", "new", 1), ("b", None, "new", 2)], SCHEMA))
    none = spark.createDataFrame([], "id string")
    version = table.version()
    table.delete(none)
    table.update(none, lambda df: df)
    assert table.version() == version
    table.delete_where("status", spark.createDataFrame([("new",)], "s string"))
    assert table.read().count() == 0
    table.compact()
    assert table.read().count() == 0
    table.put(spark.createDataFrame([("a", "1995-01", "again", 3)], SCHEMA))
    assert rows_of(table.read()) == {"a": ("1995-01", "again", 3)}


def test_operations_are_the_same_on_touched_rows(spark):
    """The pure operations act on the rows of the named keys alone."""
    table = LoggedTable(spark, scratch_path(spark, "logged"), "id string, status string, error_code string, error_message string, processed_at long", ["id"])
    table.create(spark.createDataFrame([(str(i), "pending", None, None, 0) for i in range(30)], table.schema))
    failed = spark.createDataFrame([("3", "E", "x" * 700), ("99", "E", "y")], "id string, error_class string, error_text string")
    table.update(failed, lambda df: tables.apply_failure(df, failed, F.lit(5).cast("long")))
    got = rows_of(table.read())
    assert len(got) == 30 and got["3"] == ("failed", "E", "x" * 500, 5) and got["4"] == ("pending", None, None, 0)
