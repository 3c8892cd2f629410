"""Profiling and sampling: counts, exact percentiles of three kinds, crosstabs, deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges into which distinct values are dealt before they are ranked; how good they are never changes a result.
RANGES = 64


def _ranked(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Values with counts and how many values are no larger, by group: one row for each distinct value.

    Values are dealt into ranges, ranked within each range, and the ranges' totals are added: no task sorts all values of a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = counts.agg(F.percentile_approx("v", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(1000)).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q <= F.col("v"))) if cuts else F.lit(0)
    counts = counts.withColumn("b", bucket)
    totals = counts.groupBy(*by, "b").agg(F.sum("c").alias("bc"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = totals.withColumn("before", F.sum("bc").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bc")).withColumn("n", F.sum("bc").over(whole))
    own = Window.partitionBy(*by, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(own)).alias("x")
    same = F.col("x.b") == F.col("t.b")
    for k in by:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"t.{k}"))
    return ranked.join(totals.alias("t"), same).select(*[F.col(f"x.{k}").alias(k) for k in by], "v", "c", (F.col("upto") + F.col("before")).alias("upto"), "n")


def _at(index: Column) -> Column:
    """The value at a 0-based place of the sorted values, from ranked distinct values."""
    return F.min(F.when(F.col("upto") > index, F.col("v")))


def number_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, min, median, mean (2 places), max, p90, p99 and total; percentiles by nearest rank (banker's rounding of f (n - 1))."""
    by = by or []
    rank = lambda f: F.bround(f * (F.col("n") - 1))
    middle = (_at(F.floor((F.col("n") - 1) / 2)) + _at(F.floor(F.col("n") / 2))) / 2
    total = F.sum(F.col("v") * F.col("c"))
    return _ranked(rows, value, by).groupBy(*by).agg(
        F.max("n").alias("count"), F.min("v").alias("min"), middle.alias("median"), F.round(total / F.max("n"), 2).alias("mean"), F.max("v").alias("max"), _at(rank(0.9)).alias("p90"), _at(rank(0.99)).alias("p99"), total.alias("total")
    )


def length_buckets(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, p50 (x[n // 2]), p90 (x[int(0.9 n)]) and max."""
    by = by or []
    return _ranked(rows, value, by).groupBy(*by).agg(F.max("n").alias("count"), F.min("v").alias("min"), _at(F.floor(F.col("n") / 2)).alias("p50"), _at(F.floor(F.col("n") * 9 / 10)).alias("p90"), F.max("v").alias("max"))


def describe(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact percentiles with linear interpolation."""

    def point(share: float) -> Column:
        at = share * (F.col("n") - 1)
        low, high = _at(F.floor(at)), _at(F.ceil(at))
        return low + (high - low) * F.max(at - F.floor(at))

    points = [point(x).alias(f"p{round(x * 100)}") for x in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)]
    mean = F.sum(F.col("v") * F.col("c")) / F.max("n")
    return _ranked(rows, value, by).groupBy(*by).agg(F.max("n").alias("count"), mean.alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), *points)


def value_share(rows: DataFrame, column: str, places: int = 4) -> DataFrame:
    """Counts of values and their share of all rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("all"), places).alias("share"))


def most_common(rows: DataFrame, column: str, k: int, place: str) -> DataFrame:
    """The k most frequent values; ties by where a value was first seen."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(place).alias("first")).orderBy(F.desc("n"), "first").limit(k).drop("first")


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column values (fixed, so that no extra job looks for them), with the total."""
    table = rows.groupBy(row).pivot(column, values).count().na.fill(0)
    total = F.lit(0)
    for v in values:
        total = total + F.col(f"`{v}`")
    return table.withColumn("total", total)


def label_breakdown(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every mapped label with its type and count, absent ones with 0."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return mapping.join(counts, "label", "left").select("label", "entity_type", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("present"))


def mapped_counts(labels: DataFrame, mapping: DataFrame, unmapped: str = "UNMAPPED") -> DataFrame:
    """Counts by entity type; labels without a type count as unmapped."""
    return labels.join(mapping, "label", "left").groupBy(F.coalesce("entity_type", F.lit(unmapped)).alias("entity_type")).agg(F.count("*").alias("n"))


def true_counts(rows: DataFrame, json: str) -> DataFrame:
    """How often each key of a JSON object of booleans is true; text that is no such object counts nothing."""
    flags = rows.select(F.explode(F.from_json(json, "map<string,boolean>")).alias("key", "value"))
    return flags.groupBy("key").agg(F.count(F.when(F.col("value"), 1)).alias("n_true"), F.count("*").alias("n"))


def element_profile(rows: DataFrame, json: str) -> DataFrame:
    """Profile of JSON lists of elements by base key (copy digits off)."""
    kind = "array<struct<key:string,value:string,visible:boolean,clipped:boolean,element_type:string>>"
    e = rows.select(F.explode(F.from_json(json, kind)).alias("e")).select("e.*")
    base = F.when(F.col("key") == "PII_CARD_LAST4", F.col("key")).otherwise(F.regexp_replace("key", r"\d+$", ""))
    yes = lambda c: F.count(F.when(c, 1))
    return e.groupBy(base.alias("base_key")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), yes(F.col("visible")).alias("visible"), yes(F.col("clipped")).alias("clipped"), yes(F.coalesce(F.trim("value"), F.lit("")) == "").alias("empty"))


# ---------------------------------------------------------------- samples


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def sample_ids(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n ids, the same for the same seed; all of a smaller table."""
    if n <= 0:
        raise ValueError("a sample needs a positive size")
    return rows.select(id_col).orderBy(hash_order(id_col, seed), id_col).limit(n)


#: Named sample sizes (fixed values).
TIERS = {"train_dev_5k": 5000, "llm_smoke_50": 50, "llm_iter_300": 300, "llm_ab_500": 500, "llm_final_1000": 1000}


def parse_tiers(specs: list[str]) -> dict[str, int]:
    """Sizes of samples given as NAME:SIZE; without any, the fixed tiers."""
    out = {}
    for spec in specs:
        name, _, size = (x.strip() for x in spec.partition(":"))
        if not name or not size.isdigit() or int(size) <= 0:
            raise ValueError(f"a sample is NAME:SIZE with a positive size, not {spec!r}")
        out[name] = int(size)
    return out or dict(TIERS)


def tiered_samples(rows: DataFrame, id_col: str, tiers: dict[str, int], seed: int = 42) -> DataFrame:
    """Rows (tier, id): nested samples, as all take the first ids in one hash order; the table is sorted once for the largest."""
    most = sample_ids(rows, id_col, max(tiers.values()), seed)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_order(id_col, seed), id_col))  # over the largest sample only
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(v).alias("size")) for k, v in tiers.items()])).alias("t")
    return most.withColumn("place", place).select(id_col, "place", sizes).where("place <= t.size").select("t.tier", id_col)


def capped_mix(rows: DataFrame, source: str, id_col: str, caps: dict[str, int], most: int = 10_000, group: str | None = None, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """A mix of sources under caps (sources without one give nothing) and `most` rows in all, with a split by group that keeps a
    group's rows together: the hash of the group falls into the shares' ranges."""
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(source)]
    turn = F.row_number().over(Window.partitionBy(source).orderBy(hash_order(id_col, seed), id_col))
    picked = rows.withColumn("_n", turn).where(F.col("_n") <= limit).orderBy("_n", hash_order(id_col, seed), id_col).limit(most).drop("_n")
    at = F.conv(F.substring(hash_order(group or id_col, seed), 1, 8), 16, 10).cast("long") / (1 << 32)
    part, below = F.lit(None).cast("string"), 0.0
    for name, share in (shares or {"train": 0.8, "val": 0.1, "test": 0.1}).items():
        below += share
        part = F.coalesce(part, F.when(at < below, F.lit(name)))
    return picked.withColumn("part", F.coalesce(part, F.lit(name)))


def unique_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the first."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order and c in rows.columns])).alias("_r")).select(key, "_r.*").select(*rows.columns)


def split(rows: DataFrame, id_col: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds part: the first names take max(1, round(n share)) rows each in hash order, the last name the rest.

    The cut points are two order statistics of the hash, found by a bounded top-k; no single task sorts all rows.  Rows of one id
    stay together.
    """
    names = list(shares)
    n = rows.count()
    keyed = rows.withColumn("_h", hash_order(id_col, seed))
    at, part = 0, F.lit(names[-1])
    for name in names[:-1]:
        size = max(1, round(n * shares[name]))
        lo = _nth(keyed, id_col, at)
        at += size
        hi = _nth(keyed, id_col, at)
        key = F.struct(F.col("_h"), F.col(id_col).cast("string"))
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (key >= F.struct(F.lit(lo[0]), F.lit(lo[1])))
        if hi is not None:
            inside = inside & (key < F.struct(F.lit(hi[0]), F.lit(hi[1])))
        part = F.when(inside, name).otherwise(part)
    return keyed.withColumn("part", part).drop("_h")


def _nth(keyed: DataFrame, id_col: str, k: int) -> tuple[str, str] | None:
    """The k-th (0-based) key in hash order: hash prefixes are refined until few rows share one, and only those are sorted."""
    if k <= 0:
        return None
    prefix = ""
    while True:
        size = min(32, len(prefix) + 3)
        own = keyed.where(F.col("_h").startswith(prefix)) if prefix else keyed
        for row in own.groupBy(F.substring("_h", 1, size).alias("b")).count().orderBy("b").collect():  # 4096 rows at most
            if k < row["count"]:
                break
            k -= row["count"]
        else:
            return None
        prefix = row["b"]
        if size >= 32:  # rows of one id
            return prefix, keyed.where(F.col("_h") == prefix).agg(F.min(F.col(id_col).cast("string"))).first()[0]
        if row["count"] <= 10_000:
            found = keyed.where(F.col("_h").startswith(prefix)).select("_h", F.col(id_col).cast("string").alias("i")).orderBy("_h", "i").limit(k + 1).collect()[-1]
            return found["_h"], found["i"]


def n_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows, one of each group in turn (groups in order of their first row), with the turn and place."""
    w = Window.partitionBy(group).orderBy(order)
    turns = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).withColumn("_first", F.min(order).over(Window.partitionBy(group)))
    return turns.orderBy("turn", "_first").limit(n).drop("_first")


def balanced_set(gold: DataFrame, weak: DataFrame, id_col: str, label: str, seed: int = 42, extra: int | None = None) -> DataFrame:
    """All gold rows, and as many weak negatives in hash order as positives outnumber negatives (or `extra`)."""
    sizes = gold.agg(F.count(F.when(F.col(label), 1)).alias("p"), F.count(F.when(~F.col(label), 1)).alias("n")).first()
    k = max(0, sizes["p"] - sizes["n"]) if extra is None else extra
    picked = weak.orderBy(hash_order(id_col, seed), id_col).limit(k)
    return gold.withColumn("gold", F.lit(True)).unionByName(picked.withColumn("gold", F.lit(False)), allowMissingColumns=True)


def in_manifest_order(rows: DataFrame, id_col: str, ids: list[str]) -> DataFrame:
    """The rows that a manifest names, in its order; repeated ids count once, where they first stand."""
    first = list(dict.fromkeys(ids))
    wanted = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(first)], f"{id_col} string, place int")
    return rows.join(wanted, id_col).orderBy("place")
