"""What the library checks compute, and where: texts are measured in their rows."""

from pyspark.sql import functions as F

from lectern.operators import library
from lectern.plans import inputs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reference_texts_are_not_broadcast(spark, sf):
    """The texts beside a router grow with the input; a join of them by broadcast ended the run at 60,000 files."""
    plan = plan_of(library.reference_violations(inputs.libraries(spark, sf)))
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ", Inner," in x]


def test_titles(spark):
    texts = ["", "## A\nb", "x\n##  Mental Model \ny\n### no\n##\tKey\n", "##no\n## ", "a\n## One\n## Two"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select(library.titles(F.col("text")).alias("got"), F.transform(library.sections(F.col("text")), lambda s: F.lower(s["title"])).alias("want")).collect():
        assert r.got == r.want


def test_frameworks_tokens(spark):
    """As the plain pattern has it."""
    from lectern.functions.text import estimate_tokens

    texts = ["", "## Frameworks\nabcd", "x\n##  Frameworks & Structure\nab\n### in\n##no\ncd\n## Next\nno", "##  Frameworksx\na\n## Frameworks\nab\n##\tEnd", "a\n## Frameworks", "\n## Frameworks\n## B\n## Frameworks\nlong enough", "## Frameworks 漢字\r\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    plain = F.regexp_extract(F.concat(F.lit("\n"), F.col("text")), r"(?s)\n(##\s+Frameworks\b.*?(?=\n##\s|\z))", 1)
    for r in df.select(library.frameworks_tokens(F.col("text")).alias("got"), estimate_tokens(plain).alias("want")).collect():
        assert r.got == r.want


def test_reference_files_are_made_over_all_cores(spark, sf):
    """One small file of suppliers stands for texts a thousand times its size."""
    assert library.reference_files(inputs.libraries(spark, sf)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_density_looks_once(spark, sf):
    """What density filters by isn't written out again for each row that it names."""
    assert plan_of(library.density(inputs.libraries(spark, sf))).count("Frameworks\\b") == 1


def test_budget_report_looks_once(spark, sf):
    """Neither are reference files or routers measured again for the state that is reported."""
    plan = plan_of(library.budget_report(inputs.libraries(spark, sf)))
    assert plan.count("Frameworks\\b") <= 1 and plan.count("Capability\\b") == 1
