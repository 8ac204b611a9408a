"""Scoring models: linear scores as expressions, logistic regression and forests through Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from evenhand.functions.stats import HASH_MODULUS, key_hash, logistic, ratio
from evenhand.operators.forest import areas, as_arrays, grown_forest
from evenhand.operators.prep import OneHot, Standardiser
from evenhand.session import work_dir

DECISION_ABOVE = 0.5
# Default forest settings and the full tuning grid (0 stands for unlimited depth).
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "seed": 42}
TUNING_GRID = {"numTrees": (50, 100, 200), "maxDepth": (5, 10, 15, 0), "minInstancesPerNode": (1, 2, 4)}
DEEPEST_TREE = 30
# Trees up to this depth are sent to the tasks again at every level; below it tasks keep the node of every row instead.
SHALLOW_TREE = 8
# Rows of the training table that one task of a fit reads at most, on average.
ROWS_A_TASK = 25_000
# A search over more rows than this grows its forests a tree per task (forest.py) instead of by Spark, a histogram per node.
SPARK_GROWS = 25_000
# Result lengths of the feature rankings.
TOP_FEATURES = 10


@dataclass(frozen=True)
class LinearScore:
    """Logistic score 1 / (1 + exp(-(b + sum of weight * feature))) as a column expression."""

    intercept: float
    weights: Mapping[str, float] = field(default_factory=dict)
    cutoff: float = DECISION_ABOVE

    def probability(self, features: Mapping[str, Column] | None = None) -> Column:
        features = features or {}
        z = F.lit(float(self.intercept))
        for name, weight in self.weights.items():
            x = features.get(name, F.col(f"`{name}`"))
            z = z + F.lit(float(weight)) * x.cast("double")
        return logistic(z)

    def decision(self, features: Mapping[str, Column] | None = None) -> Column:
        return (self.probability(features) > self.cutoff).cast("int")

    @staticmethod
    def from_table(coefficients: DataFrame) -> LinearScore:
        """From rows (feature, weight), one per feature, with the constant named ``intercept``."""
        weights = {r["feature"]: r["weight"] for r in coefficients.collect()}
        return LinearScore(weights.pop("intercept", 0.0), weights)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [("intercept", float(self.intercept)), *((f, float(w)) for f, w in self.weights.items())]
        return spark.createDataFrame(rows, "feature string, weight double")


Model = LinearScore | Transformer


def linear_score(df: DataFrame, model: LinearScore) -> DataFrame:
    """Adds ``probability`` and the decision ``flag``."""
    return df.withColumn("probability", model.probability()).withColumn(
        "flag", (F.col("probability") > model.cutoff).cast("int")
    )


def decide(df: DataFrame, model: Model, decision: str, probability: str | None = None) -> DataFrame:
    """Adds the model's decision (and probability) for either kind of model."""
    if isinstance(model, LinearScore):
        added = {decision: model.decision()}
        if probability is not None:
            added[probability] = model.probability()
        return df.withColumns(added)
    scored = model.transform(df)
    added = {decision: F.col("prediction").cast("int")}
    if probability is not None:
        added[probability] = vector_to_array("probability")[1]
    return scored.withColumns(added).select(*[f"`{c}`" for c in df.columns], *added)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _feature_stage(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool
) -> tuple[SQLTransformer, list[str]]:
    """Encoding and scaling as one projection that is saved with the model."""
    encoder = OneHot.fit(df, categorical)
    expressions = {c: f"CAST(`{c}` AS DOUBLE)" for c in numeric}
    for c, values in encoder.categories.items():
        for v in values:
            expressions[f"{c}_{v}"] = f"CASE WHEN `{c}` = '{_quoted(v)}' THEN 1D ELSE 0D END"
    if scale:
        encoded = df.select(*[F.expr(e).alias(n) for n, e in expressions.items()])
        moments = Standardiser.fit(encoded, list(expressions)).moments
        expressions = {n: f"({e} - {moments[n][0]!r}D) / {moments[n][1]!r}D" for n, e in expressions.items()}
    names = [f"f__{i}" for i in range(len(expressions))]
    columns = ", ".join(f"{e} AS {n}" for e, n in zip(expressions.values(), names, strict=True))
    stage = SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")
    return stage, list(expressions)


def _assembler(count: int) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"f__{i}" for i in range(count)], outputCol="features", handleInvalid="skip")


def _training_rows(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Only the columns training needs; rows without label are left out."""
    known = df.where(F.col(label).isNotNull())
    return known.select(*dict.fromkeys(columns), F.col(label).cast("double").alias("label"))


@contextmanager
def _held(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows``, kept while a fit reads them several times, so that what they are joined from is read once."""
    rows = rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


@contextmanager
def _spread(rows: DataFrame, by: str, rows_a_task: int = ROWS_A_TASK) -> Iterator[DataFrame]:
    """``rows``, kept; a table that was read in fewer tasks than its size asks for is first dealt out by ``by``.

    A compressed file may hold millions of rows and still be read by one task, in which every pass of every fit would stay.
    Dealt rows are sorted within their task, as bagging draws by position: reruns see the same bags.
    """
    with _held(rows) as kept:
        placed = kept.select(F.spark_partition_id().alias("part"))
        count, parts = placed.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
        needed = -(-count // rows_a_task)
        if needed <= parts:
            yield kept
        else:
            with _held(kept.repartition(needed, by).sortWithinPartitions(by, *[c for c in kept.columns if c != by])) as dealt:
                yield dealt


def logistic_fit(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    label: str = "approved",
    weight: str | None = None,
    c: float = 1.0,
    max_iter: int = 1000,
) -> PipelineModel:
    """L2-regularised logistic regression on standardised features.

    ``c`` is the inverse regularisation strength of the summed loss; Spark averages the loss, hence
    the division by the total weight.
    """
    extra = [weight] if weight else []
    with _held(_training_rows(df, label, [*numeric, *categorical, *extra])) as rows:
        stage, names = _feature_stage(rows, numeric, categorical, scale=True)
        total = rows.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
        regression = LogisticRegression(
            maxIter=max_iter, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False
        )
        if weight:
            regression.setWeightCol(weight)
        assembler = _assembler(len(names))
        fitted = regression.fit(assembler.transform(stage.transform(rows)))
    return PipelineModel([stage, assembler, fitted])


def forest_fit(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    label: str = "approved",
    **settings,
) -> tuple[PipelineModel, list[str]]:
    """Random forest and the names of its features, in vector order."""
    with _held(_training_rows(df, label, [*numeric, *categorical])) as rows:
        stage, names = _feature_stage(rows, numeric, categorical, scale=False)
        assembler = _assembler(len(names))
        forest = RandomForestClassifier(**{**FOREST, **settings})
        fitted = forest.fit(assembler.transform(stage.transform(rows)))
    return PipelineModel([stage, assembler, fitted]), names


def tune(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    label: str = "approved",
    grid: Mapping[str, Sequence[int]] = TUNING_GRID,
    folds: int = 5,
    parallelism: int = 4,
) -> tuple[PipelineModel, DataFrame]:
    """Grid search over forest settings by cross-validated area under the ROC curve.

    Returns the best model, refitted on all rows, and one row per setting with its mean score.
    """
    rows = _training_rows(df, label, [*numeric, *categorical])
    stage, names = _feature_stage(rows, numeric, categorical, scale=False)
    assembler = _assembler(len(names))
    forest = RandomForestClassifier(seed=FOREST["seed"])
    builder = ParamGridBuilder()
    for name, values in grid.items():
        if name == "maxDepth":
            values = [v or DEEPEST_TREE for v in values]
        builder = builder.addGrid(forest.getParam(name), list(values))
    settings = builder.build()
    search = CrossValidator(
        estimator=forest,
        estimatorParamMaps=settings,
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
        numFolds=folds,
        parallelism=parallelism,
        seed=FOREST["seed"],
    )
    fitted = search.fit(assembler.transform(stage.transform(rows)).select("features", "label"))
    scores = [
        (*[int(s[forest.getParam(n)]) for n in grid], float(score))
        for s, score in zip(settings, fitted.avgMetrics, strict=True)
    ]
    schema = ", ".join([*[f"{n} int" for n in grid], "area_under_roc double"])
    best = PipelineModel([stage, assembler, fitted.bestModel])
    return best, df.sparkSession.createDataFrame(scores, schema)


def tune_by_halving(
    df: DataFrame,
    numeric: Sequence[str],
    key: str,
    categorical: Sequence[str] = (),
    label: str = "approved",
    grid: Mapping[str, Sequence[int]] = TUNING_GRID,
    shares: Sequence[float] = (1 / 9, 1 / 3, 1.0),
    keep: float = 1 / 3,
    test_share: float = 0.2,
    parallelism: int = 4,
) -> tuple[PipelineModel, DataFrame]:
    """Search of the whole grid at a fraction of its cost: all settings on a small share of the rows, the best of them on a larger one, and so on.

    Shares are nested and, like the test rows, chosen by a hash of ``key``, so reruns see the same rows. Each rung keeps the share ``keep`` of its
    settings, at least one, by area under the ROC curve on the test rows, ties by the grid's order. With the
    defaults the rows fitted come to shares[i] * keep^i of a full search each, a ninth of it per rung. Tables of more than ``SPARK_GROWS`` rows
    get forests of the same kind grown a tree per task, whose draws depend on the tree's number only.
    Returns the best setting's model, refitted on all rows, and one row per rung and setting: rung, share, settings, area_under_roc, kept.
    """
    known = _training_rows(df.withColumn("_at", key_hash(F.col(key), FOREST["seed"])), label, [*numeric, *categorical, "_at"])
    with _held(known) as kept, nullcontext(kept) if (by_tree := _by_tree(kept, grid)) else _spread(kept, "_at") as rows:
        stage, names = _feature_stage(rows, numeric, categorical, scale=False)
        assembler = _assembler(len(names))
        ready = assembler.transform(stage.transform(rows)).select("features", "label", "_at")
        cut = int(test_share * HASH_MODULUS)
        test, train = ready.where(F.col("_at") < cut), ready.where(F.col("_at") >= cut)
        left = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
        table, best = [], left[0]
        with _dealt(ready, cut) if by_tree else nullcontext() as told:
            for rung, share in enumerate(shares):
                end = cut + int(share * (HASH_MODULUS - cut))
                if by_tree:
                    scores = areas(told.where(F.col("test") | (F.col("_at") < end)), len(names), [_forest_of(s) for s in left])
                else:
                    scores = _areas(train.where(F.col("_at") < end), test, left, parallelism)
                order = sorted(range(len(left)), key=lambda i: (-scores[i], i))
                stay = order[: max(1, round(len(left) * keep))] if rung + 1 < len(shares) else order[:1]
                table += [(rung, float(share), *left[i].values(), float(scores[i]), i in stay) for i in range(len(left))]
                left = [left[i] for i in sorted(stay)]
                best = left[0]
            fitted = grown_forest(told, len(names), _forest_of(best)) if by_tree else _forest_of(best).fit(ready)
    schema = ", ".join(["rung int, share double", *[f"{n} int" for n in grid], "area_under_roc double, kept boolean"])
    return PipelineModel([stage, assembler, fitted]), df.sparkSession.createDataFrame(table, schema)


def _by_tree(rows: DataFrame, grid: Mapping[str, Sequence[int]]) -> bool:
    """Whether a search grows its forests a tree per task: many rows, of the labels 0 and 1."""
    if not set(grid) <= set(TUNING_GRID):
        return False
    count, *of_label = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col("label") == y) for y in (0, 1)]).first()
    return count > SPARK_GROWS and sum(of_label) == count and all(of_label)


@contextmanager
def _dealt(ready: DataFrame, cut: int) -> Iterator[DataFrame]:
    """The rows to fit and ``test`` on, dealt out by what is in them: they meet the same others in any layout of the table, and so give the same bins and bags."""
    rows = as_arrays(ready)
    with _held(rows.repartition(-(-rows.count() // ROWS_A_TASK), "_at", "x").withColumn("test", F.col("_at") < cut)) as told:
        yield told


def _areas(train: DataFrame, test: DataFrame, settings: Sequence[Mapping[str, int]], parallelism: int) -> list[float]:
    """The area under the ROC curve that Spark's forest of each setting, fitted on ``train``, has on ``test``."""
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")

    def score(setting: Mapping[str, int]) -> float:
        return evaluator.evaluate(_forest_of(setting).fit(train).transform(test))

    # The longest fits begin first and one at a time, so that none is left to run alone after the others.
    longest = sorted(range(len(settings)), key=lambda i: -_work(settings[i]))
    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(train.sparkSession)(score), [settings[i] for i in longest], chunksize=1)
    return [s for _, s in sorted(zip(longest, found, strict=True))]


def _forest_of(setting: Mapping[str, int]) -> RandomForestClassifier:
    """The forest of a setting. Keeping the node of every row changes no tree; without it all trees grown so far go to all tasks at every level."""
    values = {n: (v or DEEPEST_TREE) if n == "maxDepth" else v for n, v in setting.items()}
    forest = RandomForestClassifier(seed=FOREST["seed"], **values)
    return forest.setCacheNodeIds(forest.getMaxDepth() > SHALLOW_TREE)


def _work(setting: Mapping[str, int]) -> int:
    """Levels of trees that a fit grows at most, to compare settings by."""
    forest = _forest_of(setting)
    return forest.getNumTrees() * forest.getMaxDepth()


def forest_importance(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Importance of each feature, one row per feature of the model."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_features(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The n most important features, ties by name."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def forest_rules(
    model: RandomForestClassificationModel, names: Sequence[str], trees: int = 3, max_depth: int = 3
) -> dict[str, list[tuple[str, str, float]]]:
    """Paths to the leaves of the first trees, at most ``max_depth`` conditions long.

    Paths that go deeper are left out. Only the numeric split of each inner node is read.
    """
    rules: dict[str, list[tuple[str, str, float]]] = {}
    for t, tree in enumerate(model.trees[:trees], 1):
        frontier = [(tree._java_obj.rootNode(), ())]
        leaf = 0
        while frontier:
            node, path = frontier.pop()
            if node.subtreeDepth() == 0:
                leaf += 1
                rules[f"tree_{t}_leaf_{leaf}"] = list(path)
            elif len(path) < max_depth:
                split = node.split()
                feature, cut = names[split.featureIndex()], float(split.threshold())
                frontier.append((node.rightChild(), (*path, (feature, ">", cut))))
                frontier.append((node.leftChild(), (*path, (feature, "<=", cut))))
    return rules


def tree_nodes(model: RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """The nodes of all trees as rows: tree, id (in preorder, the root 0), left, right (null at a leaf), feature, cut."""
    path = work_dir(spark, "forest")
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(inner, node["split"]["leftCategoriesOrThreshold"][0]).alias("cut"),
    )


def leaf_rules(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rule of every leaf of every tree, however deep: tree, leaf (from the left, from 0), conditions.

    conditions is an array of (feature, op, cut), from the root down. Paths grow by a recursive query, a level of all trees at a time.
    Splits are numeric, as the features of :func:`forest_fit` are.
    """
    spark = nodes.sparkSession
    features = F.array(*[F.lit(n) for n in names])
    named = nodes.withColumn("feature", F.get(features, F.col("feature")))
    paths = spark.sql(
        """
        WITH RECURSIVE path AS (
            SELECT tree, id, left, right, feature, cut, CAST(array() AS ARRAY<STRUCT<feature: STRING, op: STRING, cut: DOUBLE>>) AS conditions
            FROM {nodes} WHERE id = 0
            UNION ALL
            SELECT n.tree, n.id, n.left, n.right, n.feature, n.cut,
                concat(p.conditions, array(named_struct('feature', p.feature, 'op', CASE WHEN n.id = p.left THEN '<=' ELSE '>' END, 'cut', p.cut)))
            FROM path p JOIN {nodes} n ON n.tree = p.tree AND (n.id = p.left OR n.id = p.right)
        )
        SELECT tree, id, conditions FROM path WHERE left IS NULL
        """,
        nodes=named,
    )
    from_left = Window.partitionBy("tree").orderBy("id")
    return paths.select("tree", (F.row_number().over(from_left) - 1).cast("int").alias("leaf"), "conditions")


def leaf_support(df: DataFrame, model: PipelineModel, names: Sequence[str], outcome: str = "approved") -> DataFrame:
    """Every leaf rule of a forest with the rows that fall into it: tree, leaf, rule, samples, prediction, confidence.

    The model itself says into which leaf of each tree a row falls, so all rules of all trees are counted in one scan, added up per task
    before anything moves. Rows with a missing feature or outcome belong to no leaf. A tree's samples add up to all others.
    """
    spark = df.sparkSession
    forest = model.stages[-1].copy()
    forest.setLeafCol("_leaves")
    known = df.where(F.col(outcome).isNotNull()).withColumn("_y", F.col(outcome).cast("int"))
    placed = PipelineModel([*model.stages[:-1], forest]).transform(known)
    fallen = placed.select("_y", F.posexplode(vector_to_array("_leaves")).alias("tree", "_leaf"))
    counted = fallen.groupBy("tree", F.col("_leaf").cast("int").alias("leaf")).agg(F.count(F.lit(1)).alias("samples"), F.sum("_y").alias("approvals"))
    rules = leaf_rules(tree_nodes(model.stages[-1], spark), names)
    text = F.array_join(F.transform("conditions", lambda c: F.concat_ws(" ", c["feature"], c["op"], c["cut"].cast("string"))), " AND ")
    approved = F.coalesce("approvals", F.lit(0))
    samples = F.coalesce("samples", F.lit(0))
    rejected = samples - approved
    return rules.join(counted, ["tree", "leaf"], "left").select(
        (F.col("tree") + 1).alias("tree"),
        "leaf",
        F.size("conditions").alias("depth"),
        text.alias("rule"),
        samples.alias("samples"),
        F.when(approved > rejected, "Approved").otherwise("Rejected").alias("prediction"),
        ratio(F.greatest(approved, rejected), samples).alias("confidence"),
    )


def rule_support(
    df: DataFrame, rules: Mapping[str, Sequence[tuple[str, str, float]]], outcome: str = "approved"
) -> DataFrame:
    """Per rule (a conjunction of conditions) the matching rows and the share of their majority class.

    All rules are counted in one scan.
    """
    y = F.col(outcome).cast("int")
    aggregates, rows = [], []
    for i, (name, conditions) in enumerate(rules.items()):
        match = F.col(outcome).isNotNull()
        for feature, op, value in conditions:
            x = F.col(f"`{feature}`")
            if op not in ("<=", ">"):
                raise ValueError(f"unknown operator in rule {name!r}: {op!r}")
            match = match & (x <= value if op == "<=" else x > value)
        aggregates += [
            F.count_if(match).alias(f"n_{i}"),
            F.coalesce(F.sum(F.when(match, y)), F.lit(0)).alias(f"y_{i}"),
        ]
        n, approved = F.col(f"n_{i}"), F.col(f"y_{i}")
        rejected = n - approved
        rows.append(
            F.struct(
                F.lit(name).alias("rule"),
                n.alias("samples"),
                F.when(approved > rejected, "Approved").otherwise("Rejected").alias("prediction"),
                F.try_divide(F.greatest(approved, rejected).cast("double"), n.cast("double")).alias("confidence"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def performance(
    scored: DataFrame, label: str = "approved", prediction: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1; F1 is NULL where precision and recall are both 0."""
    return performance_from_counts(confusion_counts(scored, label, prediction, by), by)


def confusion_columns(label: str, prediction: str) -> dict[str, Column]:
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return {
        "tp": F.when((y == 1) & (p == 1), 1).otherwise(0),
        "fp": F.when((y == 0) & (p == 1), 1).otherwise(0),
        "fn": F.when((y == 1) & (p == 0), 1).otherwise(0),
        "tn": F.when((y == 0) & (p == 0), 1).otherwise(0),
    }


def confusion_counts(scored: DataFrame, label: str, prediction: str, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in confusion_columns(label, prediction).items()]
    )


def performance_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    values = performance_columns()
    return counts.select(*by, *[c.alias(n) for n, c in values.items()])


def performance_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1_score": F.try_divide(precision * recall * 2.0, precision + recall),
    }


def auc(scored: DataFrame, label: str = "approved", score: str = "predicted_probability") -> float:
    """Exact area under the ROC curve.

    Equal scores are counted together first; Spark then sorts the distinct scores across the cluster.
    """
    evaluator = BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="score", weightCol="weight", metricName="areaUnderROC", numBins=0
    )
    rows = scored.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score"))
    counted = rows.dropna().groupBy("label", "score").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return evaluator.evaluate(counted)


RANGES = 64


def auc_by(
    scored: DataFrame, by: Sequence[str], label: str = "approved", score: str = "predicted_probability", ranges: int = RANGES
) -> DataFrame:
    """Exact area under the ROC curve of each segment: by, n, positives, area_under_roc (null where a segment has one class only).

    Equal scores of a segment are counted together per task before anything moves. The distinct scores are dealt in ranges of (segment, score),
    so a segment that holds a third of all rows lies in about a third of the ranges; a range's rows are ranked within it, and what
    the ranges before it hold is added from one row per segment and range. Ties count half. Rows without a label or score do not count;
    a null segment is a segment.
    """
    by = list(by)
    y, s = F.col(label).cast("int"), F.col(score).cast("double")
    counted = (
        scored.where(y.isNotNull() & s.isNotNull() & ~F.isnan(s))
        .groupBy(*by, s.alias("_score"))
        .agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("_pos"), F.sum(F.when(y == 1, 0).otherwise(1)).alias("_neg"))
    )
    dealt = counted.repartitionByRange(ranges, *by, "_score").withColumn("_range", F.spark_partition_id())
    # Which range a row is in must not change between the two readers of the table, so it is stored.
    path = work_dir(scored.sparkSession, "auc-ranges")
    dealt.write.mode("overwrite").parquet(path)
    dealt = scored.sparkSession.read.schema(dealt.schema).parquet(path)
    per_range = dealt.groupBy(*by, "_range").agg(F.sum("_neg").alias("_held"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.withColumn("_below", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    keys = [*by, "_range"]
    renamed = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_below")
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & dealt[k].eqNullSafe(renamed[f"_o{i}"])
    within = Window.partitionBy(*by, "_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    whole = "decimal(38,0)"
    ranked = (
        dealt.withColumn("_inside", F.coalesce(F.sum("_neg").over(within), F.lit(0)))
        .join(renamed, condition)
        # Twice the pairs won, so that halves for ties stay whole numbers.
        .withColumn("_won", F.col("_pos").cast("decimal(19,0)") * (2 * (F.col("_below") + F.col("_inside")) + F.col("_neg")).cast("decimal(19,0)"))
    )
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("_won").cast(whole)).alias("_won"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("_negatives")
    )
    pairs = 2.0 * F.col("positives").cast("double") * F.col("_negatives").cast("double")
    return sums.select(
        *by,
        (F.col("positives") + F.col("_negatives")).alias("n"),
        "positives",
        F.try_divide(F.col("_won").cast("double"), pairs).alias("area_under_roc"),
    )
