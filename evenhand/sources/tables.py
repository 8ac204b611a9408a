"""Reading, writing and sampling tables by file name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenhand.functions.stats import HASH_MODULUS, key_hash

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
SEARCH_FOLDERS = ("raw", "processed", "synthetic")
OVERSAMPLE = 20.0


def _format_of(name: str) -> str:
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format: {suffix or name!r}")
    return FORMATS[suffix]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path) and file_system.getFileStatus(hadoop_path).isDirectory()


def find_table(spark: SparkSession, base: str, name: str) -> str:
    """Path of ``name`` below ``base`` or one of the standard sub-folders."""
    base = base.rstrip("/")
    candidates = [f"{base}/{name}", *(f"{base}/{sub}/{name}" for sub in SEARCH_FOLDERS)]
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"data file not found: {name}")


def load_table(
    spark: SparkSession, base: str, name: str, schema: StructType | str | None = None, **options
) -> DataFrame:
    """Read a csv, json (one object per line) or parquet table, choosing the format by suffix.

    Pass ``schema`` for csv and json: without it Spark reads the whole input once more to infer it.
    """
    path = find_table(spark, base, name)
    fmt = _format_of(name)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def save_table(
    df: DataFrame,
    base: str,
    name: str,
    subdir: str = "processed",
    partition_by: tuple[str, ...] = (),
    **options,
) -> str:
    """Write ``df`` below ``base/subdir`` in the format named by the suffix; returns the path."""
    fmt = _format_of(name)
    path = f"{base.rstrip('/')}/{subdir}/{name}"
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def sample_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """min(n, count) rows, the same ones on every run: the n smallest hashes of the key.

    Left alone, the final merge would see n rows from every task. The hash is uniform, so rows above
    a cutoff that should keep twenty times n rows are filtered out first; the cutoff is lifted if
    it kept fewer than n, which makes the result exact for any keys. The two counts read the key only.
    """
    hashed = key_hash(F.col(key))
    total = df.agg(F.count(F.lit(1))).scalar()
    low = hashed <= F.try_divide(F.lit(OVERSAMPLE * n * float(HASH_MODULUS)), total)
    enough = df.agg(F.count_if(low) >= n).scalar()
    return df.where(low | ~enough).orderBy(hashed, F.col(key)).limit(n)


def sample_by(df: DataFrame, n: int, key: str, by: Sequence[str], salts: int = 64) -> DataFrame:
    """min(n, count) rows of each segment, the same ones on every run: the n smallest hashes of the key.

    Bottom-n lists merge: the least n of a segment are among the least n of each of its parts. A segment is cut into ``salts`` parts by the key,
    and tasks hand on at most n rows of each part (Spark limits ranked groups before it moves them, for n up to its threshold), so
    no task sees a whole segment. One pass; null segments are segments, rows alike in key are ordered by it alone.
    """
    hashed = key_hash(F.col(key))
    salted = df.withColumns({"_hash": hashed, "_salt": F.pmod(F.xxhash64(key), F.lit(salts))})
    part = Window.partitionBy(*by, "_salt").orderBy("_hash", key)
    least = salted.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= n)
    whole = Window.partitionBy(*by).orderBy("_hash", key)
    return least.withColumn("_place", F.row_number().over(whole)).where(F.col("_place") <= n).drop("_hash", "_salt", "_place")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Quick approximate sample without a sort."""
    return df.sample(fraction=fraction, seed=seed)


def load_sample(
    spark: SparkSession, base: str, name: str, schema: StructType, n: int = 1000, key: str = "application_id"
) -> DataFrame:
    """Sample of a stored table; an empty frame of the given schema where it does not exist."""
    try:
        table = load_table(spark, base, name, schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    return sample_rows(table, n, key)
