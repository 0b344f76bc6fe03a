from lumenfold.operators import relations as rel


def test_hotspots_without_churn(spark):
    symbols = spark.createDataFrame([("a", "a", "x.py", 10), ("b", "b", "y.py", 5)], "key string, name string, file_path string, complexity int")
    fan_in, fan_out = spark.createDataFrame([("a", 2)], "key string, fan_in int"), spark.createDataFrame([("b", 3)], "key string, fan_out int")
    dup = spark.createDataFrame([("x.py", 4)], "file_path string, duplication int")
    got = rel.hotspots(symbols, fan_in, fan_out, dup, None, 5).collect()
    assert [(r.key, r.score) for r in got] == [("a", 80.0), ("b", 37.5)]
