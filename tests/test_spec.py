"""A second data set through the same operators: the pipeline is not tied to students."""

from pyspark.sql import functions as F

from tollgate.functions import rules as R
from tollgate.plans.pipeline import outcome
from tollgate.plans.spec import DataSpec, FieldSpec

SF = "/root/testdata/sf0.001"

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_RULES = (
    R.Rule("Segment is required", lambda raw, n: F.length(n) == 0),
    R.Rule("Segment is unknown", lambda raw, n: ~n.isin(*SEGMENTS)),
)
BALANCE_RULES = (
    R.Rule("Balance must be a number", lambda raw, n: n.try_cast("double").isNull()),
    R.Rule("Balance must not be negative", lambda raw, n: n.try_cast("double") < 0),
)
CUSTOMERS = DataSpec("customers", (
    FieldSpec("name", "c_name", R.norm_trim, (R.Rule("Name is required", lambda raw, n: F.length(n) == 0),), "BAD_NAME"),
    FieldSpec("segment", "c_mktsegment", R.norm_trim, SEGMENT_RULES, "BAD_SEGMENT"),
    FieldSpec("balance", "c_acctbal", R.norm_trim, BALANCE_RULES, "BAD_BALANCE", typed=lambda n: n.try_cast("double")),
), key="name")


def test_customer_spec(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet").withColumn("line_number", F.col("c_custkey") + 2)
    out = outcome(c, spark.createDataFrame([], "email string"), batch_size=100, spec=CUSTOMERS)
    got = {r["status"]: r["count"] for r in out.groupBy("status").count().collect()}
    neg = c.where(F.col("c_acctbal") < 0).count()
    assert got.get("invalid", 0) == neg
    assert got.get("unique", 0) == c.count() - neg  # customer names are unique
    msgs = {r[0] for r in out.where(F.col("status") == "invalid").select(F.explode("violations.message")).collect()}
    assert msgs <= {"Balance must not be negative"}
