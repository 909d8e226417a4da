"""Classification, entity and training measures, and reshapes of metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binary_measures(df: DataFrame, truth: Column, predicted: Column, loss: Column | None = None) -> DataFrame:
    """One row: precision, recall, F1 and loss a row of a two-class prediction; a share of nothing is 0."""
    counts = df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"),
                    F.avg(loss if loss is not None else F.lit(0.0)).alias("loss"))
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of columns tp, fp and fn."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def entity_spans(tags: Column) -> Column:
    """array<struct<start, end, kind>> of the entities in an array of B-, I- and O tags; an I after another kind begins an entity."""
    prefix = lambda t: F.substring(t, 1, 1)
    kind = lambda t: F.substring(t, 3, 50)
    before = lambda i: F.coalesce(F.get(tags, i - 1), F.lit("O"))
    begins = F.filter(F.transform(tags, lambda t, i: F.when((t != "O") & ((prefix(t) == "B") | (before(i) == "O") | (kind(before(i)) != kind(t))), i)), lambda i: i.isNotNull())
    ends = F.transform(begins, lambda b: F.aggregate(
        F.sequence(b, F.size(tags) - 1), F.struct(b.alias("end"), F.lit(True).alias("open")), lambda s, i: F.struct(
            F.when(s["open"] & ((i == b) | (F.get(tags, i) == F.concat(F.lit("I-"), kind(F.get(tags, b))))), i).otherwise(s["end"]).alias("end"),
            (s["open"] & ((i == b) | (F.get(tags, i) == F.concat(F.lit("I-"), kind(F.get(tags, b)))))).alias("open")), lambda s: s["end"]))
    return F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda z: F.struct(z["b"].alias("start"), z["e"].alias("end"), kind(F.get(tags, z["b"])).alias("kind")))


def entity_measures(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: precision, recall and F1 of whole entities in two columns of tag arrays."""
    spans = df.select(entity_spans(F.col(truth)).alias("t"), entity_spans(F.col(predicted)).alias("p"))
    hit = F.size(F.array_intersect("t", "p"))
    return with_scores(spans.agg(F.coalesce(F.sum(hit), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size("p") - hit), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.size("t") - hit), F.lit(0)).alias("fn")))


def best_rows(df: DataFrame, group: list[str], metric: str, ties: list[Column]) -> DataFrame:
    """The row of the largest metric in each group, the first by ``ties`` of equals."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct((-F.col(metric)).alias("m"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])
    return df.groupBy(*group).agg(F.min_by(row, rank).alias("__row")).select("__row.*")


def best_model(df: DataFrame, metric: str, loss: str = "loss") -> DataFrame:
    """The one row of the largest metric, then the least loss."""
    return df.orderBy(F.col(metric).desc(), F.col(loss)).limit(1)


def metrics_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Columns such as train_f1 as rows (keys, dataset, metric columns)."""
    long = df.unpivot(keys, metrics, "name", "value")
    parts = F.split("name", "_", 2)
    kinds = sorted({m.split("_", 1)[1] for m in metrics})
    long = long.select(*keys, parts[0].alias("dataset"), parts[1].alias("metric"), "value")
    return long.groupBy(*keys, "dataset").pivot("metric", kinds).agg(F.first("value"))


def value_order(df: DataFrame, value: str, column: str = "position") -> DataFrame:
    """With the dense rank of a value, for ordered display of a few groups; only the different values are ordered in one place."""
    ranks = df.select(value).distinct().withColumn(column, F.row_number().over(Window.orderBy(value)).cast("int"))
    return df.join(ranks.select(F.col(value).alias("__value"), column), F.col(value).eqNullSafe(F.col("__value"))).drop("__value")


def beside(validation: DataFrame, test: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """The measures of two data sets of each model of both, as columns val_ and test_."""
    named = lambda df, prefix: df.select(key, *[F.col(m).alias(f"{prefix}_{m}") for m in metrics])
    return named(validation, "val").join(named(test, "test"), key)
