"""The table function of ``udf_table`` on rows of its own."""

from tidemark.queries.relational import QUERIES


def test_one_file_is_dealt_out(spark, tmp_path):
    names = {1: "one two", 2: None, 3: "", 4: " a  b "}
    rows = [*names.items(), (None, "x y"), (1, "one two")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["udf_table"](spark, str(tmp_path))
    want = [(key, place, word) for key, name in rows for place, word in enumerate((name or "").split(" "))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().executedPlan().toString()
