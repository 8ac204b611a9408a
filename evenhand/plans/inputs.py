"""Tables and parameters the registered queries share, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from evenhand.operators.drift import with_window
from evenhand.operators.models import LinearScore
from evenhand.sources.applications import applications, star_table

SCORE = LinearScore(
    -4.0,
    {
        "credit_score": 0.008,
        "debt_to_income": -2.0,
        "annual_income": 4e-06,
        "loan_amount": -1e-06,
        "age": 0.005,
    },
)
EXPLAINED_SCORE = LinearScore(
    SCORE.intercept,
    {**SCORE.weights, "race_BUILDING": -0.4, "gender_F": -0.2, "region_AFRICA": -0.15},
)
POLICY = {
    "credit_score": {"type": "threshold", "value": 650, "direction": "increase"},
    "annual_income": {"type": "threshold", "value": 50000, "direction": "increase"},
}
STEPS = {"credit_score": (0, 1, 2), "debt_to_income": (0, -1, -2), "annual_income": (0, 1, 2)}
CUTOFFS = (0.3, 0.4, 0.5, 0.6, 0.7)
RULES = {
    "low_score": [("credit_score", "<=", 500.0)],
    "high_score_low_debt": [("credit_score", ">", 700.0), ("debt_to_income", "<=", 0.2)],
    "middle_income": [("annual_income", ">", 60000.0), ("annual_income", "<=", 120000.0)],
}
CHECK_RANGES = {"age": (18, 100), "credit_score": (300, 850), "debt_to_income": (0, 2)}
CHECK_DOMAINS = {
    "race": ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "gender": ("F", "O"),
    "loan_type": ("1-URGENT", "2-HIGH", "3-MEDIUM"),
}


def explained_applications(spark: SparkSession, base: str) -> DataFrame:
    """Applications with the 0/1 columns the explained score reads."""
    dummies = (("race", "BUILDING"), ("gender", "F"), ("region", "AFRICA"))
    return applications(spark, base).withColumns(
        {f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for c, v in dummies}
    )


def flawed_applications(spark: SparkSession, base: str) -> DataFrame:
    """Applications with planted defects: gaps, values out of range, broken rules, repeated rows."""
    key = F.col("application_id")

    def every(n: int):
        return key % n == 0

    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    table = applications(spark, base).select(
        "application_id",
        F.when(every(79), none_text).otherwise(F.col("race")).alias("race"),
        "gender",
        F.when(every(101), none_int).when(every(97), 17).otherwise(F.col("age")).alias("age"),
        "annual_income",
        F.when(every(89), 900).otherwise(F.col("credit_score")).alias("credit_score"),
        F.when(every(73), F.col("age")).otherwise(F.col("employment_years")).alias("employment_years"),
        F.when(every(83), 2.5).otherwise(F.col("debt_to_income")).alias("debt_to_income"),
        "loan_type",
        "loan_amount",
        "approved",
        F.when(every(71), F.col("loan_amount") * 1.1)
        .when(every(67), 0.0)
        .otherwise(F.col("approved_amount"))
        .alias("approved_amount"),
    )
    copies = F.array_repeat(F.lit(1), F.when(every(61), 2).otherwise(1))
    return table.withColumn("copy", F.explode(copies)).drop("copy")


def located_applications(spark: SparkSession, base: str) -> DataFrame:
    """Applications with a finer location than the nation: nation and kind of settlement."""
    tract = F.concat_ws("/", "zip_code", "urban_rural")
    return applications(spark, base).withColumn("tract", tract)


def demographics(spark: SparkSession, base: str) -> DataFrame:
    """Side table of locations: every kind of settlement of every nation outside Europe."""
    nation, region = star_table(spark, base, "nation"), star_table(spark, base, "region")
    kinds = F.array(F.lit("Urban"), F.lit("Suburban"), F.lit("Rural"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name") != "EUROPE")
    return places.withColumn("kind", F.explode(kinds)).select(
        F.concat_ws("/", "n_name", "kind").alias("tract"), F.col("r_name").alias("area")
    )


def windowed_applications(spark: SparkSession, base: str, width: str = "30 days") -> DataFrame:
    return with_window(applications(spark, base), "application_date", width)


def timed_events(spark: SparkSession, base: str) -> DataFrame:
    """Events with a zoned event time and the outcome the monitoring queries count."""
    return as_timed(star_table(spark, base, "events"))


def as_timed(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.when(F.col("value") > 50, 1).otherwise(0).alias("large"),
    )


def day(column: str):
    """Timestamp as ``yyyy-MM-dd`` text."""
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def second(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def listed(column: str, order: bool = False):
    """Array of text as one comma-separated text."""
    value = F.array_sort(column) if order else F.col(column)
    return F.array_join(value, ",").alias(column)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that engines can be compared by value; nested columns are refused."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ArrayType, StructType)) and not isinstance(f.dataType, StringType):
            raise TypeError(f"flatten column {f.name} before comparing")
        if isinstance(f.dataType, DoubleType):
            # Adding zero turns a rounded -0.0 into 0.0.
            columns.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        else:
            columns.append(F.col(f"`{f.name}`"))
    return df.select(*columns)
