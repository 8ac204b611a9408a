"""Feature preparation: fit on one table, apply to any.

Fitting brings a few numbers per column to the driver (medians, modes, means, categories);
applying them is a projection without any exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from evenhand.functions.stats import HASH_MODULUS, key_hash
from evenhand.operators.quantiles import exact_medians

MAX_CATEGORIES = 2_000


def columns_of_type(df: DataFrame, kind: type, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind) and f.name not in exclude]


@dataclass(frozen=True)
class Imputer:
    """Training median per numeric column, training mode per categorical column."""

    medians: Mapping[str, float | None]
    modes: Mapping[str, str | None]

    @staticmethod
    def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Imputer:
        return Imputer(exact_medians(df, numeric) if numeric else {}, _modes(df, categorical))

    def transform(self, df: DataFrame) -> DataFrame:
        filled = {}
        for c, median in self.medians.items():
            if c in df.columns:
                x = F.col(c).cast("double")
                filled[c] = F.coalesce(F.when(~F.isnan(x), x), F.lit(median).cast("double"))
        for c, mode in self.modes.items():
            if c in df.columns:
                filled[c] = F.coalesce(F.col(c), F.lit(mode).cast("string"))
        return df.withColumns(filled) if filled else df


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest on ties; one row per column is collected."""
    if not columns:
        return {}
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("key"), "value"))["value"].alias("value"))
    found = {row["feature"]: row["value"] for row in best.collect()}
    return {c: found.get(c) for c in columns}


@dataclass(frozen=True)
class OneHot:
    """0/1 column ``column_value`` per category seen in training."""

    categories: Mapping[str, Sequence[str]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> OneHot:
        """Categories per column; refuses a table too wide for one column per category."""
        if not columns:
            return OneHot({})
        pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
        values = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
        rows = values.limit(max_categories + 1).collect()
        if len(rows) > max_categories:
            raise ValueError(
                f"more than {max_categories} categories in {list(columns)}: encode such columns as a "
                "vector with pyspark.ml's StringIndexer and OneHotEncoder, or raise max_categories"
            )
        seen = {c: sorted(r["value"] for r in rows if r["feature"] == c) for c in columns}
        return OneHot(seen)

    @property
    def features(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.categories.items() for v in values]

    def transform(self, df: DataFrame) -> DataFrame:
        """Unseen categories get no column; a missing column or NULL counts as none of them."""
        dummies = []
        for c, values in self.categories.items():
            for v in values:
                hit = F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) if c in df.columns else F.lit(0)
                dummies.append(hit.alias(f"{c}_{v}"))
        kept = [c for c in df.columns if c not in self.categories]
        return df.select(*[F.col(f"`{c}`") for c in kept], *dummies)


@dataclass(frozen=True)
class Standardiser:
    """Zero mean and unit population deviation; a constant column is only centred."""

    moments: Mapping[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> Standardiser:
        if not columns:
            return Standardiser({})
        row = df.agg(
            *[F.avg(F.col(c).cast("double")).alias(f"mean_{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"std_{i}") for i, c in enumerate(columns)],
        ).first()
        return Standardiser({c: (row[f"mean_{i}"], row[f"std_{i}"] or 1.0) for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {
            c: (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)
            for c, (mean, std) in self.moments.items()
            if c in df.columns and mean is not None
        }
        return df.withColumns(scaled) if scaled else df


@dataclass(frozen=True)
class MinMax:
    """Scaling to [0, 1] by the training range; values beyond it are clipped, constants give 0."""

    ranges: Mapping[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> MinMax:
        row = df.agg(
            *[F.min(F.col(c).cast("double")).alias(f"low_{i}") for i, c in enumerate(columns)],
            *[F.max(F.col(c).cast("double")).alias(f"high_{i}") for i, c in enumerate(columns)],
        ).first()
        return MinMax({c: (row[f"low_{i}"], row[f"high_{i}"]) for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {}
        for c, (low, high) in self.ranges.items():
            if low is None or c not in df.columns:
                continue
            x = F.col(c).cast("double")
            if high > low:
                unit = (x - F.lit(low)) / F.lit(high - low)
                scaled[c] = F.when(x.isNotNull(), F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)))
            else:
                scaled[c] = F.when(x.isNotNull(), F.lit(0.0))
        return df.withColumns(scaled) if scaled else df


@dataclass
class Preparation:
    """Impute, one-hot encode and standardise, leaving out target and identifiers.

    Dates are neither scaled nor encoded and pass through.
    """

    target: str = "approved"
    identifiers: Sequence[str] = ("application_id",)
    max_categories: int = MAX_CATEGORIES
    imputer: Imputer | None = field(default=None, init=False)
    encoder: OneHot | None = field(default=None, init=False)
    scaler: Standardiser | None = field(default=None, init=False)

    def _features(self, df: DataFrame) -> DataFrame:
        return df.drop(self.target, *self.identifiers)

    def fit(self, df: DataFrame) -> Preparation:
        features = self._features(df)
        numeric = columns_of_type(features, NumericType)
        categorical = columns_of_type(features, StringType)
        # Medians, modes, categories and moments read these columns several times; what they are joined from is read once.
        features = features.select(*[F.col(f"`{c}`") for c in [*numeric, *categorical]]).persist()
        try:
            self.imputer = Imputer.fit(features, numeric, categorical)
            filled = self.imputer.transform(features)
            self.encoder = OneHot.fit(filled, categorical, self.max_categories)
            self.scaler = Standardiser.fit(filled, numeric)
        finally:
            features.unpersist()
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Prepared features; ``keep`` carries identifiers or the target along untouched."""
        if self.scaler is None:
            raise ValueError("preparation must be fitted before transform")
        carried = [F.col(c).alias(f"kept__{c}") for c in keep]
        features = [c for c in df.columns if c != self.target and c not in self.identifiers]
        table = df.select(*[F.col(f"`{c}`") for c in features], *carried)
        prepared = self.encoder.transform(self.scaler.transform(self.imputer.transform(table)))
        return prepared.withColumnsRenamed({f"kept__{c}": c for c in keep})

    def fit_transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.fit(df).transform(df, keep)

    @property
    def feature_names(self) -> list[str]:
        if self.scaler is None:
            raise ValueError("preparation must be fitted first")
        return [*self.scaler.moments, *self.encoder.features]


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable (train, test) split by a hash of the key; no exchange, no row order involved."""
    in_test = key_hash(F.col(key), seed) < int(test_share * HASH_MODULUS)
    return df.where(~in_test), df.where(in_test)
