"""Boosted-tree classifiers of alert, need and item, trained and evaluated on Spark.

Labels are rules over the same features, so a high accuracy says little about the machines.
"""

from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrowatch import schemas
from ferrowatch.functions.expressions import safe_div
from ferrowatch.operators import encoding
from ferrowatch.operators.boosting import Forest, Node, boost

KEY = ["equipment_id", "timestamp"]


@dataclass(frozen=True)
class Job:
    """What a model learns, from which features, and how many of them its report lists."""

    label: str
    features: list[str]
    classes: list[str]
    top: int


JOBS = {
    "alert": Job("alert", schemas.ALERT_FEATURES, schemas.ALERT_LEVELS, 10),
    "need": Job("maintenance_needed", schemas.NEED_FEATURES, [schemas.NOT_REQUIRED, schemas.REQUIRED], 5),
    "item": Job("maintenance_item", schemas.ITEM_FEATURES, schemas.MAINTENANCE_ITEMS, 5),
}


NODE_SCHEMA = "round int, klass int, node int, depth int, feature int, split double, left int, right int, value double"


@dataclass(frozen=True)
class BoostedClassifier:
    """Labels by code, features by number, and the node table of one tree per round and class."""

    labels: list[str]
    features: list[str]
    nodes: list[Node]

    def node_table(self, spark: SparkSession) -> DataFrame:
        """The nodes as rows; their number is bounded by rounds, classes and depth."""
        return spark.createDataFrame([tuple(asdict(node).values()) for node in self.nodes], NODE_SCHEMA)


def maintenance_encoded(df: DataFrame) -> DataFrame:
    """Add 1 for rows that require maintenance, else 0."""
    required = F.col("maintenance_needed") == schemas.REQUIRED
    return df.withColumn("maintenance_encoded", F.when(required, 1).otherwise(0))


def select_features(df: DataFrame, job: Job) -> DataFrame:
    """Key, label and features of a job; the item job's need flag is derived if absent."""
    if "maintenance_encoded" in job.features and "maintenance_encoded" not in df.columns:
        df = maintenance_encoded(df)
    return df.select(*KEY, job.label, *job.features)


def complete_rows(df: DataFrame, job: Job) -> DataFrame:
    """The rows that can be learned from: with a label and every feature. A share of a limit of zero,
    for one, is NULL."""
    return df.na.drop(subset=[job.label, *job.features])


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the feature vector; a NULL feature is an error."""
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(df)


def label_codes(df: DataFrame, name: str) -> DataFrame:
    """(code, label): the labels of a column by falling frequency, ties by label."""
    return encoding.label_mapping(df.select(name), [name]).select("code", "label")


def index_label(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """Add `label`, the code of the text label by falling frequency; also the labels in code order.

    The labels are the classes of a model, so they are few. Rows without a label are left out.
    """
    labels = [row["label"] for row in label_codes(df, name).orderBy("code").collect()]
    code = F.array_position(F.array(*map(F.lit, labels)), F.col(name)) - 1 if labels else F.lit(0)
    return df.filter(F.col(name).isNotNull()).withColumn("label", code.cast("double")), labels


def split_bucket(seed: int) -> Column:
    """A number from 0 to 999 from the row's key: the first 28 bits of an MD5 digest.

    Any engine can repeat it: the digest is of machine, time and seed as text.
    """
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    parts = [F.coalesce(F.col("equipment_id").cast("string"), F.lit("")), F.coalesce(time, F.lit(""))]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % 1000


def is_test(test_share: float = 0.2, seed: int = 42) -> Column:
    return split_bucket(seed) < round(test_share * 1000)


def split(df: DataFrame, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a digest of the key: the same rows however the frame is partitioned."""
    return df.filter(~is_test(test_share, seed)), df.filter(is_test(test_share, seed))


def split_sizes(df: DataFrame, name: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """(label, train, test): the rows of each label on either side of the split."""
    side = df.select(F.col(name).alias("label"), is_test(test_share, seed).alias("test"))
    return side.groupBy("label").agg(F.count_if(~F.col("test")).alias("train"), F.count_if("test").alias("test"))


def checksum(df: DataFrame, job: Job) -> tuple:
    """(rows, sum of their hashes) of a job's key, label and features: equal for equal rows."""
    row_hash = F.xxhash64(*KEY, job.label, *job.features).cast("decimal(20,0)")
    return tuple(df.agg(F.count("*"), F.sum(row_hash)).first())


def train_classifier(
    train: DataFrame,
    labels: list[str],
    features: list[str],
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.3,
) -> BoostedClassifier:
    """Boost on the vector `features` and the code `label`, all classes at once; see boosting."""
    rows = train.select("label", vector_to_array("features").alias("x"))
    return BoostedClassifier(labels, features, boost(rows, len(labels), len(features), rounds, depth, step))


def predict(model: BoostedClassifier, df: DataFrame) -> DataFrame:
    """Add probabilities (by label code), prediction (the likeliest code) and predicted_label.

    Of equally likely classes the first by code is predicted. The node table, whose size is the
    model's, goes to the tasks.
    """
    forest = df.sparkSession.sparkContext.broadcast(Forest(model.nodes, len(model.labels)))

    @F.arrow_udf("array<double>")
    def chances(vectors: pa.Array) -> pa.Array:
        known = forest.value
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        found = known.probabilities(flat.reshape(len(vectors), -1))
        offsets = pa.array(range(0, found.size + 1, known.n_classes), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    scored = df.withColumn("probabilities", chances(vector_to_array("features")))
    return _with_prediction(scored, model.labels)


def _with_prediction(scored: DataFrame, labels: list[str]) -> DataFrame:
    position = F.array_position("probabilities", F.array_max("probabilities"))
    return scored.withColumns(
        {
            "prediction": (position - 1).cast("double"),
            "predicted_label": F.element_at(F.array(*map(F.lit, labels)), position.cast("int")),
        }
    )


def predict_by_nodes(
    nodes: DataFrame, df: DataFrame, key: list[str], features: list[str], labels: list[str]
) -> DataFrame:
    """key, probabilities, prediction and predicted_label, by walking a node table with joins.

    Each row starts at the root of every tree and goes down one level a join, until it is at a leaf;
    the leaves' values are added up by row and class. Gives what predict gives, for any engine that
    has joins; predict is the faster way. key must tell rows apart. A model without trees finds all
    labels equally likely. The node table, whose size is the model's, is broadcast: joined by a shuffle,
    all rows would meet in the few partitions of the roots. A node's place among all nodes is one number,
    by which Spark finds it much faster than by three columns; a leaf leads to itself.
    """
    numbers = F.array(*[F.col(name).cast("double") for name in features])
    size = nodes.agg(F.max("depth"), F.max("round"), F.max("node")).first()
    depth, rounds, width = (0, 0, 1) if size[0] is None else (size[0], size[1] + 1, size[2] + 1)
    trees = F.sequence(F.lit(0), F.lit(rounds * len(labels) - 1)) if rounds else F.array(F.lit(None).cast("int"))
    root = (F.col("round").cast("long") * len(labels) + F.col("klass")) * width
    leaf = F.col("feature") < 0
    nodes = F.broadcast(
        # Trees of further classes would have the places of the next round's.
        nodes.filter(F.col("klass").between(0, len(labels) - 1)).select(
            (root + F.col("node")).alias("place"),
            F.when(leaf, 1).otherwise(F.col("feature") + 1).alias("number"),
            "split",
            (root + F.when(leaf, F.col("node")).otherwise(F.col("left"))).alias("low"),
            (root + F.when(leaf, F.col("node")).otherwise(F.col("right"))).alias("high"),
            "value",
        )
    )
    at = df.select(*key, numbers.alias("x"), F.explode(trees).alias("tree")).select(
        *key, "x", (F.col("tree") % len(labels)).alias("klass"), (F.col("tree").cast("long") * width).alias("place")
    )
    for _ in range(depth):
        is_low = F.element_at("x", F.col("number")) <= F.col("split")
        child = F.when(is_low, F.col("low")).otherwise(F.col("high"))
        at = at.join(nodes, "place", "left").select(*key, "x", "klass", child.alias("place"))
    at = at.join(nodes, "place", "left")
    at = at.select(*key, F.col("klass").alias("at_klass"), F.col("value").alias("at_value"))
    sums = [F.sum(F.when(F.col("at_klass") == k, F.col("at_value"))) for k in range(len(labels))]
    margins = at.groupBy(*key).agg(F.array(*[F.coalesce(total, F.lit(0.0)) for total in sums]).alias("margins"))
    powers = margins.withColumn("powers", F.transform("margins", lambda m: F.exp(m - F.array_max("margins"))))
    total = F.aggregate("powers", F.lit(0.0), lambda a, b: a + b)
    chances = powers.withColumn("total", total).withColumn("probabilities", F.transform("powers", lambda p: p / F.col("total")))
    return _with_prediction(chances.select(*key, "probabilities"), labels)


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count), the codes as text."""
    return df.groupBy(
        F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")
    ).agg(F.count("*").alias("count"))


def confusion_matrix(
    df: DataFrame, classes: list, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows by label, one column of counts per predicted class."""
    return (
        confusion_counts(df, label, prediction)
        .groupBy("label")
        .pivot("prediction", [str(c) for c in classes])
        .sum("count")
        .na.fill(0)
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) per class, with accuracy and both averages.

    An undefined measure is 0. The accuracy row carries its value in every measure.
    """
    cells = confusion_counts(df, label, prediction)
    rows, none = F.col("count"), F.lit(0).cast("long")
    hits = F.when(F.col("label") == F.col("prediction"), rows).otherwise(0)

    def side(name, actual, predicted, hits):
        return F.struct(
            F.col(name).alias("class"), actual.alias("actual"), predicted.alias("predicted"), hits.alias("hits")
        )

    sides = F.array(side("label", rows, none, hits), side("prediction", none, rows, none))
    totals = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(name).alias(name) for name in ("actual", "predicted", "hits")])
    )
    measured = totals.select(
        "class",
        _ratio("hits", "predicted").alias("precision"),
        _ratio("hits", "actual").alias("recall"),
        F.coalesce(
            safe_div(2.0 * F.col("hits"), F.col("predicted") + F.col("actual")), F.lit(0.0)
        ).alias("f1"),
        F.col("actual").alias("support"),
        "hits",
    )
    return measured.drop("hits").unionByName(_averages(measured))


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(safe_div(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def _averages(measured: DataFrame) -> DataFrame:
    support = F.sum("support")
    accuracy = safe_div(F.sum("hits").cast("double"), support)
    measures = ("precision", "recall", "f1")

    def row(name, values):
        return F.struct(
            F.lit(name).alias("class"),
            *[value.alias(measure) for measure, value in zip(measures, values)],
            support.alias("support"),
        )

    weighted = [safe_div(F.sum(F.col(m) * F.col("support")), support) for m in measures]
    rows = F.array(
        row("accuracy", [accuracy] * 3),
        row("macro avg", [F.avg(m) for m in measures]),
        row("weighted avg", weighted),
    )
    return measured.agg(rows.alias("rows")).select(F.inline("rows"))


def save_model(model: BoostedClassifier, spark: SparkSession, path: str) -> None:
    """Overwrite the model at a path: its node table, and labels and features beside it."""
    about = [(model.labels, model.features)]
    about = spark.createDataFrame(about, "labels array<string>, features array<string>")
    about.write.mode("overwrite").parquet(f"{path}/description")
    model.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


def load_model(spark: SparkSession, path: str) -> BoostedClassifier:
    about = spark.read.parquet(f"{path}/description").first()
    rows = spark.read.parquet(f"{path}/nodes").orderBy("round", "klass", "node").collect()
    return BoostedClassifier(list(about["labels"]), list(about["features"]), [Node(*row) for row in rows])


def feature_importance(model: BoostedClassifier, spark: SparkSession, top: int = 10) -> DataFrame:
    """(feature, splits): the features most often split on, counted in the node table."""
    names = F.array(*map(F.lit, model.features))
    inner = model.node_table(spark).filter(F.col("feature") >= 0)
    counts = inner.groupBy(F.element_at(names, F.col("feature") + 1).alias("feature")).agg(F.count("*").alias("splits"))
    return counts.orderBy(F.desc("splits"), "feature").limit(top)


def score_sample(model: BoostedClassifier, df: DataFrame, key: dict) -> DataFrame:
    """Label, probabilities, prediction and features of the rows with the given key values."""
    rows = df
    for name, value in key.items():
        rows = rows.filter(F.col(name) == value)
    return predict(model, rows).select(
        *key, "label", "probabilities", "prediction", "predicted_label", *model.features
    )
