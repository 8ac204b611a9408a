"""Data-quality checks, each a handful of counters over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from evenhand.functions.joins import join_small

# Repeated row hashes (8 bytes each) that are broadcast at most.
REPEATED_HASHES = 1_000_000

# Required and numeric columns, accepted ranges and accepted categories.
REQUIRED = (
    "application_id",
    "race",
    "gender",
    "age",
    "annual_income",
    "credit_score",
    "loan_amount",
    "approved",
)
NUMERIC = (
    "age",
    "annual_income",
    "credit_score",
    "employment_years",
    "debt_to_income",
    "loan_amount",
    "loan_term_months",
)
RANGES = {"age": (18, 100), "credit_score": (300, 850), "debt_to_income": (0, 2)}
DOMAINS = {
    "race": ("White", "Black", "Hispanic", "Asian", "Other"),
    "gender": ("Male", "Female", "Non-binary"),
    "loan_type": ("Personal", "Auto", "Mortgage", "Student", "Business"),
}
# Business rules: name, columns it reads, level. The conditions are in ``_broken``.
BUSINESS_RULES = (
    ("approved_amount_exceeds_loan", ("approved_amount", "loan_amount"), "error"),
    ("approved_without_amount", ("approved", "approved_amount"), "warning"),
    ("implausible_employment", ("employment_years", "age"), "warning"),
)


def _broken(rule: str) -> Column:
    if rule == "approved_amount_exceeds_loan":
        return F.col("approved_amount") > F.col("loan_amount")
    if rule == "approved_without_amount":
        return (F.col("approved") == 1) & (F.col("approved_amount") <= 0)
    return F.col("employment_years") > F.col("age") - 16


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _counted_rows(df: DataFrame, entries: Sequence[tuple[Mapping[str, str | None], Column]]) -> DataFrame:
    """One aggregate of all counts, turned into one row per count with the given labels."""
    aggregates = [c.alias(f"count_{i}") for i, (_, c) in enumerate(entries)]
    rows = [
        F.struct(
            *[F.lit(v).cast("string").alias(k) for k, v in labels.items()],
            F.col(f"count_{i}").alias("violations"),
        )
        for i, (labels, _) in enumerate(entries)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _range_counts(df: DataFrame, ranges: Mapping[str, tuple]) -> dict[str, Column]:
    counts = {}
    for c, (low, high) in ranges.items():
        if c in df.columns:
            x = F.col(c).cast("double")
            counts[c] = F.count_if(~F.isnan(x) & ((x < low) | (x > high)))
    return counts


def _rule_counts(df: DataFrame) -> dict[tuple[str, str], Column]:
    present = set(df.columns)
    return {(n, level): F.count_if(_broken(n)) for n, needs, level in BUSINESS_RULES if set(needs) <= present}


def _missing_cells(df: DataFrame) -> Column:
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + _missing(df, c).cast("int")
    return F.coalesce(F.sum(cells), F.lit(0))


def range_checks(df: DataFrame, ranges: Mapping[str, tuple] = RANGES) -> DataFrame:
    """Values outside the accepted range, per column; NULL and NaN are not counted."""
    return _counted_rows(df, [({"column": c}, n) for c, n in _range_counts(df, ranges).items()])


def domain_checks(df: DataFrame, domains: Mapping[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """Distinct unexpected values per column with their counts; NULL is unexpected.

    All columns are counted in one pass; accepted values are removed before anything is exchanged.
    """
    checks = []
    for c, accepted in domains.items():
        if c in df.columns:
            value = F.col(c).cast("string")
            unexpected = value.isNull() | ~value.isin(*accepted)
            checks.append(F.struct(F.when(unexpected, F.lit(c)).alias("column"), value.alias("value")))
    return (
        df.select(F.inline(F.array(*checks)))
        .where(F.col("column").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def business_rules(df: DataFrame) -> DataFrame:
    """Number of rows breaking each rule whose columns are present."""
    return _counted_rows(df, [({"rule": r, "level": lv}, n) for (r, lv), n in _rule_counts(df).items()])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows, as one row ``(duplicate_rows)``.

    A first pass exchanges only an 8-byte hash per row and keeps the hashes seen more than once;
    whole rows are compared only within those, so the count stays exact under hash collisions.
    While such hashes are few they are broadcast and no other row is exchanged at all.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.select(F.struct(*names).alias("row"), F.xxhash64(*names).alias("hash"))
    repeated = (
        hashed.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("seen"))
        .where(F.col("seen") > 1)
        .select("hash")
    )
    kept = join_small(hashed, repeated, ["hash"], "left_semi", max_rows=REPEATED_HASHES)
    suspects = kept.groupBy("hash", "row").count()
    return suspects.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows."""
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), _missing_cells(df).alias("missing_values"))
    return counts.select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        "missing_values",
        duplicate_rows(df).scalar().alias("duplicate_rows"),
    )


def schema_findings(df: DataFrame, required: Sequence[str] = REQUIRED, numeric: Sequence[str] = NUMERIC):
    """Findings that need no data: missing required columns and non-numeric numeric columns."""
    found = [("missing_column", c, 1, "error") for c in required if c not in df.columns]
    for c in numeric:
        if c in df.columns and not isinstance(df.schema[c].dataType, NumericType):
            found.append(("not_numeric", c, 1, "warning"))
    return found


def quality_findings(
    df: DataFrame,
    required: Sequence[str] = REQUIRED,
    numeric: Sequence[str] = NUMERIC,
    ranges: Mapping[str, tuple] = RANGES,
    domains: Mapping[str, Sequence[str]] = DOMAINS,
) -> DataFrame:
    """Every check that found something: (check, column, violations, level, is_valid).

    All counters share one scan; unexpected values and repeated rows need an exchange of their own.
    ``is_valid`` is the table-wide verdict, false only if a required column is missing. For domain
    checks ``violations`` is the number of distinct unexpected values.
    """
    def label(check: str, column: str | None, level: str) -> dict[str, str | None]:
        return {"check": check, "column": column, "level": level}

    counters = [
        (label("range", c, "warning"), n)
        for c, n in _range_counts(df, {c: r for c, r in ranges.items() if c in numeric}).items()
    ]
    counters += [(label("business_rule", r, level), n) for (r, level), n in _rule_counts(df).items()]
    counters.append((label("missing_values", None, "recommendation"), _missing_cells(df)))
    columns = ("check", "column", "violations", "level")
    parts = [_counted_rows(df, counters).select(*columns)]
    if set(domains) & set(df.columns):
        unexpected = domain_checks(df, domains).groupBy("column").agg(F.count(F.lit(1)).alias("violations"))
        parts.append(unexpected.withColumns({"check": F.lit("domain"), "level": F.lit("warning")}).select(*columns))
    repeated = duplicate_rows(df).select(
        F.lit("duplicate_rows").alias("check"),
        F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rows").alias("violations"),
        F.lit("recommendation").alias("level"),
    )
    parts.append(repeated)
    static = schema_findings(df, required, numeric)
    if static:
        schema = "check string, column string, violations bigint, level string"
        parts.append(df.sparkSession.createDataFrame(static, schema))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    is_valid = not any(check == "missing_column" for check, *_ in static)
    return result.where(F.col("violations") > 0).withColumn("is_valid", F.lit(is_valid))
