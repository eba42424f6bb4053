"""A document classifier: words to a class, trained where it is used, with the usual figures."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.texts import bare_words

#: At most this many labelled rows are trained on, chosen by hash; every row is classified.
TRAINING_ROWS = 20_000
BUCKETS = 1 << 12


def word_sets(frame: DataFrame, text: str) -> DataFrame:
    """``frame`` with ``words``: the distinct bare words, sorted, so that the order never depends on chance."""
    words = F.sort_array(F.array_distinct(F.split(bare_words(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")))
    return frame.withColumn("words", F.filter(words, lambda w: w != ""))


def padded(words, n: int = 30):
    """The first ``n`` words, filled up with '' on the left."""
    some = F.slice(words, 1, n)
    return F.concat(F.array_repeat(F.lit(""), F.lit(n) - F.size(some)), some)


def train(frame: DataFrame, text: str, label: str, row: str, rows: int = TRAINING_ROWS) -> PipelineModel:
    """Multinomial logistic regression over hashed words; rows without a label are left out."""
    labelled = word_sets(frame.filter(F.col(label).isNotNull()), text).select("words", F.col(label).alias("label_text"), F.xxhash64(row).alias("h"))
    sample = labelled.orderBy("h").limit(rows)
    index = StringIndexer(inputCol="label_text", outputCol="label", handleInvalid="skip").fit(sample)
    stages = [HashingTF(inputCol="words", outputCol="features", numFeatures=BUCKETS, binary=True), index, LogisticRegression(maxIter=15, regParam=0.01), IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]
    return Pipeline(stages=stages).fit(sample)


def classify(frame: DataFrame, model: PipelineModel, row: str, text: str) -> DataFrame:
    """(row, predicted)."""
    out = word_sets(frame.select(row, text), text)
    for stage in (model.stages[0], model.stages[2], model.stages[3]):
        out = stage.transform(out)
    return out.select(row, "predicted")


def confusion(pairs: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, cnt)."""
    return pairs.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("cnt"))


def figures(counts: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over the classes that occur; from the confusion counts alone."""
    true = counts.groupBy(F.col(label).alias("c")).agg(F.sum("cnt").alias("t"))
    made = counts.groupBy(F.col(predicted).alias("c")).agg(F.sum("cnt").alias("m"))
    hit = counts.filter(F.col(label) == F.col(predicted)).select(F.col(label).alias("c"), F.col("cnt").alias("h"))
    per = true.join(made, "c", "full").join(hit, "c", "left").na.fill(0)
    precision, recall = (F.when(F.col(x) > 0, F.col("h") / F.col(x)).otherwise(0.0) for x in ("m", "t"))
    per = per.select("t", "h", precision.alias("p"), recall.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return per.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"))


def rmse(counts: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: the root of the mean square of the difference of class numbers (classes in alphabetical order), from the confusion counts alone."""
    classes = counts.select(F.explode(F.array(label, predicted)).alias("c")).distinct()
    order = classes.agg(F.sort_array(F.collect_list("c")).alias("order"))  # as many as there are classes
    both = counts.crossJoin(F.broadcast(order))  # one row
    number = lambda c: F.array_position("order", F.col(c))
    square = F.pow(number(label) - number(predicted), F.lit(2.0))
    return both.agg(F.sqrt(F.sum(square * F.col("cnt")) / F.sum("cnt")).alias("rmse"))


def roc_auc(frame: DataFrame, score: str, positive: str, cells: int = 1000) -> DataFrame:
    """One row: the share of pairs of a positive and a negative row whose scores are in order, ties counting half. Null without both kinds.

    Rows are counted by score first; scores are then added up within cells of ``1 / cells`` and the cells, which are few, among themselves.
    """
    hit = F.col(positive).cast("int")
    per = frame.groupBy(F.col(score).alias("s")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")).withColumn("cell", F.floor(F.col("s") * cells))
    totals = per.groupBy("cell").agg(F.sum("neg").alias("n"))
    before = totals.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("before"))
    inner = F.sum("neg").over(Window.partitionBy("cell").orderBy("s")) - F.col("neg")
    ranked = per.withColumn("within", inner).join(before, "cell")
    pairs = F.sum(F.col("pos") * (F.col("before") + F.col("within") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(pairs, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def one_hot(label: Column, classes: list[str]) -> Column:
    """An array with 1.0 in the place of the class, all 0.0 for unknown ones."""
    return F.array(*(F.coalesce((label == c).cast("double"), F.lit(0.0)) for c in classes))


def argmax(values: Column, classes: list[str]) -> Column:
    """The class in the place of the greatest value, the first of equals."""
    return F.element_at(F.array(*(F.lit(c) for c in classes)), F.array_position(values, F.array_max(values)).cast("int"))
