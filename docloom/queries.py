"""All queries of the reference's operators, and the flagship query."""

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import aggregates, corpus, enrich, incremental, judging, matching, pages, ranking, relational, scalars, search, stateful, summaries  # noqa: F401  (modules register their queries)
from docloom.registry import ORACLE_SQL, QUERIES  # noqa: F401


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["W02_stratified_sample"](spark, "/root/testdata/sf0.001")
