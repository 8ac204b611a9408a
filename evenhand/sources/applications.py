"""The ``applications`` table: one row per loan application.

Over the order tables at hand it is a view: an order is an application, its customer's market
segment, nation and region are the applicant's groups, and integer arithmetic on the keys stands
in for everything the order tables lack, so that results are repeatable on any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from evenhand.functions.lending import BiasRoles, age_band, approval_score, biased_probability
from evenhand.session import pin_utc

ROLES = BiasRoles(female=("F",), minority=("BUILDING", "FURNITURE"), redlined=("AFRICA", "ASIA"))
PROTECTED = ("race", "gender", "age_group", "region")
NUMERIC = (
    "age",
    "annual_income",
    "credit_score",
    "employment_years",
    "debt_to_income",
    "existing_loans",
    "previous_defaults",
    "loan_amount",
    "loan_term_months",
)
CATEGORICAL = ("race", "gender", "age_group", "region", "loan_type", "urban_rural")

_S, _I, _D = StringType(), IntegerType(), DoubleType()
APPLICATION_SCHEMA = StructType(
    [
        StructField("application_id", LongType()),
        StructField("application_date", TimestampType()),
        *[StructField(c, _S) for c in ("race", "gender")],
        StructField("age", _I),
        *[StructField(c, _S) for c in ("age_group", "region", "zip_code", "urban_rural")],
        StructField("annual_income", _D),
        StructField("credit_score", _I),
        StructField("employment_years", _I),
        StructField("debt_to_income", _D),
        StructField("existing_loans", _I),
        StructField("previous_defaults", _I),
        StructField("loan_type", _S),
        StructField("loan_amount", _D),
        StructField("loan_term_months", _I),
        StructField("interest_rate_requested", _D),
        StructField("predicted_probability", _D),
        StructField("predicted", _I),
        StructField("approval_probability", _D),
        StructField("approved", _I),
        StructField("approved_amount", _D),
        StructField("approved_interest_rate", _D),
    ]
)


# Schemas of the tables read, so that no job has to look them up.
TABLE_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def star_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    reader = pin_utc(spark).read.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{base.rstrip('/')}/{name}.parquet")


def applications(spark: SparkSession, base: str) -> DataFrame:
    """The view over the order tables in ``base``."""
    names = ("orders", "customer", "nation", "region")
    return applications_from(*(star_table(spark, base, n) for n in names))


def applications_from(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """The view over given tables; ``orders`` may be a stream.

    No join is hinted: Spark broadcasts a side whose stored size is below its threshold (nation
    and region always, customer only while it is small) and otherwise sorts and merges, splitting
    skewed customers.
    """
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    third = cust % 3
    base_columns = joined.select(
        order.alias("application_id"),
        F.col("o_orderdate").cast("timestamp").alias("application_date"),
        F.col("c_mktsegment").alias("race"),
        F.col("o_orderstatus").alias("gender"),
        (F.lit(18) + (cust * 13 + 7) % 62).cast("int").alias("age"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("zip_code"),
        F.when(third == 0, "Urban").when(third == 1, "Suburban").otherwise("Rural").alias("urban_rural"),
        (F.lit(15000) + (cust * 7919) % 185001).cast("double").alias("annual_income"),
        (F.lit(300) + (order * 37 + cust * 101) % 551).cast("int").alias("credit_score"),
        ((order * 31) % 800 / F.lit(1000.0)).alias("debt_to_income"),
        (order % 5).cast("int").alias("existing_loans"),
        F.when((order * 17) % 10 == 0, 1).otherwise(0).alias("previous_defaults"),
        F.col("o_orderpriority").alias("loan_type"),
        F.col("o_totalprice").alias("loan_amount"),
        (F.lit(12) * (order % 3 + 1)).cast("int").alias("loan_term_months"),
        (F.lit(3.0) + (order * 53) % 1200 / F.lit(100.0)).alias("interest_rate_requested"),
        ((order * 7919 + cust * 104729) % 1000 / F.lit(1000.0)).alias("draw"),
        (F.lit(0.8) + (order * 13) % 200 / F.lit(1000.0)).alias("granted_share"),
    )
    scored = base_columns.withColumns(
        {
            "age_group": age_band(F.col("age")),
            "employment_years": F.greatest(
                F.lit(0), F.col("age") - 18 - (F.col("application_id") % 5).cast("int")
            ),
            "predicted_probability": approval_score(F.col("credit_score"), F.col("debt_to_income")),
        }
    ).withColumns(
        {
            "predicted": F.when(F.col("predicted_probability") > 0.5, 1).otherwise(0),
            "approval_probability": biased_probability(F.col("predicted_probability"), roles=ROLES),
        }
    )
    decided = scored.withColumn(
        "approved", F.when(F.col("draw") < F.col("approval_probability"), 1).otherwise(0)
    )
    granted = F.col("approved") == 1
    minority = F.when(F.col("race").isin(*ROLES.minority), F.lit(0.5)).otherwise(F.lit(0.0))
    female = F.when(F.col("gender").isin(*ROLES.female), F.lit(0.3)).otherwise(F.lit(0.0))
    rate = F.lit(5.0) + (F.lit(850) - F.col("credit_score")) / F.lit(100.0) + minority + female
    priced = decided.withColumns(
        {
            "approved_amount": F.when(granted, F.col("loan_amount") * F.col("granted_share")).otherwise(0.0),
            "approved_interest_rate": F.when(granted, rate).otherwise(0.0),
        }
    )
    return priced.select(*APPLICATION_SCHEMA.fieldNames())


def store_applications(table: DataFrame, path: str) -> str:
    """Write applications partitioned by month, so that audits of a period read only its files.

    Rows are ranged by month and key: a month of any size is written by as many tasks as it needs,
    and small months do not scatter over all of them.
    """
    dated = table.withColumn("application_month", F.date_format("application_date", "yyyy-MM"))
    ranged = dated.repartitionByRange("application_month", "application_id")
    ranged.write.mode("overwrite").partitionBy("application_month").parquet(path)
    return path
