from tablespark.functions.columns import looks_identifier


def test_whole_cell_must_be_an_identifier(spark):
    cells = ["name", "Unit price (net)", "a/b-c.d", "_x1", "编号", "foo@bar", "naïve", "été", "1st", "42", "", "a=b"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select("c", looks_identifier(df["c"]).alias("ok")).collect() if r["ok"]] == cells[:5]
