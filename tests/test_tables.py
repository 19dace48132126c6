from ledgerline.functions.tables import small


def test_only_small_tables_are_sent_to_all_tasks(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    table = spark.range(10)
    assert hinted(small(table)) and hinted(small(table, 10)) and not hinted(small(table, 9))
    assert small(table, 9).count() == 10
