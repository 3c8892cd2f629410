"""Evaluation: span metrics, confusion metrics, threshold sweeps, error mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import greedy_match


def _share(num: Column, den: Column, empty) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, 0.0 where undefined, unrounded."""
    p, r = _share(tp, tp + fp, 0.0), _share(tp, tp + fn, 0.0)
    return [p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r, 0.0).alias("f1")]


def prf_or_null(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """The same rounded to 4 places, null where undefined; f1 is null where precision or recall is null or 0."""
    p, r = _share(tp, tp + fp, None), _share(tp, tp + fn, None)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 4)).alias("f1")]


def matched(rows: DataFrame, predicted: str = "predicted", gold: str = "gold", typed: bool = True) -> DataFrame:
    """Adds taken: for each prediction the gold span it takes, -1 for none (greedy, one to one)."""
    return rows.withColumn("taken", greedy_match(F.col(predicted), F.col(gold), typed))


def overall(rows: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """One row of tp, fp, fn, precision, recall, f1 over rows with `taken`."""
    hits = F.size(F.filter("taken", lambda i: i >= 0))
    sums = rows.agg(F.coalesce(F.sum(hits), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size(predicted) - hits), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.size(gold) - hits), F.lit(0)).alias("fn"))
    return sums.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def _span_rows(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    said = rows.select(F.explode(F.zip_with(predicted, "taken", lambda p, t: F.struct(p["entity_type"].alias("entity_type"), (t >= 0).alias("hit")))).alias("x")).select("x.entity_type", F.col("x.hit").cast("int").alias("tp"), (~F.col("x.hit")).cast("int").alias("fp"), F.lit(0).alias("fn"))
    missed = rows.select("taken", F.posexplode(gold).alias("i", "g")).where(~F.array_contains("taken", F.col("i"))).select("g.entity_type", F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    return said.unionAll(missed)


def per_entity(rows: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """tp and fp by the predicted type, fn by the gold type."""
    sums = _span_rows(rows, predicted, gold).groupBy("entity_type").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return sums.select("entity_type", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def per_label(rows: DataFrame, gold: str = "gold") -> DataFrame:
    """tp, fn and recall by the gold spans' native label and type."""
    found = rows.select("taken", F.posexplode(gold).alias("i", "g")).select("g.label", F.col("g.entity_type").alias("entity_type"), F.array_contains("taken", F.col("i")).alias("hit"))
    sums = found.groupBy("label", "entity_type").agg(F.count(F.when(F.col("hit"), 1)).alias("tp"), F.count(F.when(~F.col("hit"), 1)).alias("fn"))
    return sums.withColumn("recall", _share(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))


def confusion(rows: DataFrame, label: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with accuracy, precision, recall and f1 rounded to 6 places (0.0 where undefined); by groups if given."""
    cell = lambda y, p: F.count(F.when((label == y) & (said == p), 1))
    aggs = [cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(False, False).alias("tn")]
    sums = (rows.groupBy(*by) if by else rows).agg(*aggs)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    p, r = _share(tp, tp + fp, 0.0), _share(tp, tp + fn, 0.0)
    return sums.select(
        *(by or []), "tp", "fp", "fn", "tn", F.round(_share(tp + tn, tp + fp + fn + tn, 0.0), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_share(2 * p * r, p + r, 0.0), 6).alias("f1")
    )


def action_accuracy(rows: DataFrame, action: str = "action", expected: str = "expected_action") -> DataFrame:
    """Share of rows with an expected action that got it; null if none has one."""
    return rows.agg(F.round(F.avg(F.when(F.col(expected).isNotNull(), (F.col(action) == F.col(expected)).cast("double"))), 6).alias("action_accuracy"))


def threshold_sweep(rows: DataFrame, step: float = 0.05, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts at score >= t for a grid of thresholds (rounded to 4 places) and every observed score rounded to 6 places.

    The scores themselves aren't rounded.  Rows are counted by rounded score first, of which there are a million and one at most, and
    whether the score reaches it; a threshold then sums over all larger rounded scores and its own.
    """
    spark = rows.sparkSession
    grid = spark.range(int(1 / step) + 1).select(F.round(F.col("id") * step, 4).alias("t"))
    seen = rows.select(F.round(F.col(score), 6).alias("t"), (F.col(score) >= F.round(F.col(score), 6)).alias("reached"), (F.col(label) == 1).alias("pos"), (F.col(label) == 0).alias("neg"))
    count = lambda cond: F.count(F.when(cond, 1))
    by = seen.groupBy("t").agg(
        count(F.col("pos")).alias("pos"), count(F.col("neg")).alias("neg"), count(F.col("pos") & ~F.col("reached")).alias("pos_below"), count(F.col("neg") & ~F.col("reached")).alias("neg_below")
    )
    none = F.lit(0).cast("long")
    by = by.unionAll(grid.select("t", none, none, none, none)).groupBy("t").agg(*[F.sum(k).alias(k) for k in ("pos", "neg", "pos_below", "neg_below")])
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    reach = lambda k: (F.sum(k).over(down) - F.col(f"{k}_below"))
    counts = by.select(F.col("t").alias("threshold"), reach("pos").alias("tp"), reach("neg").alias("fp"), F.sum("pos").over(every).alias("all_pos"), F.sum("neg").over(every).alias("all_neg"))
    counts = counts.select("threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), _share(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    f1 = _share(2 * p * r, p + r, 0.0)
    return counts.select("threshold", "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest f1, then precision, then the lowest threshold."""
    return sweep.agg(F.max_by(F.struct("*"), F.struct("f1", "precision", -F.col("threshold"))).alias("b")).select("b.*")


def mine_span_errors(rows: DataFrame, kind: str, predicted: str = "predicted", gold: str = "gold", keys: tuple[str, ...] = ("entity_type", "text"), top: int = 20, context: int = 20, text: str = "text") -> DataFrame:
    """The most frequent false positives ('fp') or misses ('fn') by keys, with one example and its surroundings."""
    if kind == "fp":
        errors = rows.select(text, F.explode(F.filter(F.zip_with(predicted, "taken", lambda p, t: F.struct(p.alias("s"), t.alias("t"))), lambda x: x["t"] < 0)).alias("x")).select(F.col(text).alias("_text"), "x.s.*")
    else:
        errors = rows.select(text, "taken", F.posexplode(gold).alias("i", "g")).where(~F.array_contains("taken", F.col("i"))).select(F.col(text).alias("_text"), "g.*")
    around = F.concat(F.expr(f"substring(_text, greatest(start - {context}, 0) + 1, least(start, {context}))"), F.lit("["), F.expr("substring(_text, start + 1, end - start)"), F.lit("]"), F.expr(f"substring(_text, end + 1, {context})"))
    counted = errors.withColumn("text", F.expr("substring(_text, start + 1, end - start)")).groupBy(*keys).agg(F.count("*").alias("n"), F.min(around).alias("example"))
    return counted.orderBy(F.desc("n"), *keys).limit(top)


def mine_label_errors(rows: DataFrame, label: Column, said: Column, keys: str, top: int = 20) -> DataFrame:
    """Errors of a classifier by the names in an array column; rows with no name count as 'none'."""
    names = F.explode(F.when(F.size(keys) > 0, F.col(keys)).otherwise(F.array(F.lit("none")))).alias("name")
    kind = F.when(said & ~label, "fp").when(~said & label, "fn")
    errors = rows.withColumn("error", kind).where("error is not null").select("error", names)
    return errors.groupBy("error", "name").agg(F.count("*").alias("n")).orderBy("error", F.desc("n"), "name").limit(top)
