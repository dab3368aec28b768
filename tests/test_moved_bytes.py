"""What reads and deletes of a logged table move: the columns their reader takes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from boxtally.session import scratch_path
from boxtally.sources.change_log import LoggedTable


def columns_read(df):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString())
    return {c.split(":")[0] for s in schemas for c in s.split(",")}


def test_a_logged_table_moves_only_what_is_read(spark):
    """A mark that a row is gone holds its key; reading one column reads no other, of log or base."""
    table = LoggedTable(spark, scratch_path(spark, "logged"), "id string, month string, status string, note string", ["id"],
                        part=lambda: F.col("month"))
    table.create(spark.createDataFrame([(str(i), f"1995-{i % 3:02d}", "new", f"note {i}") for i in range(30)], table.schema))
    keys = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    table.update(keys, lambda df: df.withColumn("status", F.lit("x")))
    table.update(keys.filter("id < '5'"), lambda df: df.withColumn("status", F.lit("y")))
    table.delete(keys.filter("id = '3'"))
    table.delete_where("status", spark.createDataFrame([("y",)], "s string"))
    marks = table._log(table._state()).filter("_gone").collect()
    assert {r.id for r in marks} == {"0", "1", "2", "3", "4"}
    assert all(r.status is r.note is r.month is None and r._part.startswith("1995-") for r in marks)
    read = table.read().select("id", "status")
    assert columns_read(read) == {"id", "status", "_seq", "_gone"}
    want = {str(i): "x" if i < 10 else "new" for i in range(5, 30)}
    assert {r.id: r.status for r in read.collect()} == want
    table.compact()
    assert {r.id: (r.status, r.note) for r in table.read().collect()} == {i: (s, f"note {i}") for i, s in want.items()}
