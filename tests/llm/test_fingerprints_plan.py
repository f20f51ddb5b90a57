from featsel.llm import fingerprints as f


def test_the_plan_holds_the_unicode_tables_a_few_times_only(spark):
    """The driver keeps the plans of every stage: each used to hold some fifteen copies of the tables (330,000 characters)."""
    df = spark.createDataFrame([(1, "x")], "i int, t string").select(f.canonical(f.folded(f.F.col("t"))).alias("c"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 100_000
