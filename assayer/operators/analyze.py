"""Marketing analytics: segments, baskets, sequences, experiments, controls."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import linear_quantiles


def rfm_base(df: DataFrame, customer: str, ts: str, amount: str, as_of: str) -> DataFrame:
    """recency (days to as_of), frequency and monetary per customer."""
    return df.groupBy(F.col(customer).alias("customer_id")).agg(F.datediff(F.lit(as_of).cast("date"), F.max(F.col(ts).cast("date"))).cast("long").alias("recency"), F.count(F.lit(1)).alias("frequency"), F.round(F.sum(amount), 2).alias("monetary"))


def bin_score(df: DataFrame, columns, bins: int) -> dict[str, Column]:
    """1 + number of distinct linear-percentile edges below the value, at most bins come from bracketing scans."""
    edges = linear_quantiles(df, columns, [i / bins for i in range(1, bins)])
    return {c: F.least(F.lit(bins), 1 + reduce(lambda a, b: a + b, [(F.col(c) > e).cast("int") for e in sorted({x for x in edges[c] if x is not None})], F.lit(0))).cast("long") for c in columns}


def rfm_scores(df: DataFrame, customer: str, ts: str, amount: str, as_of: str, bins: int = 5, weights=(33, 33, 34)) -> DataFrame:
    # one row per customer, which the scans for the edges and the scores all read: kept, and made anew where it is lost
    base = rfm_base(df, customer, ts, amount, as_of).persist()
    s = bin_score(base, ["recency", "frequency", "monetary"], bins)
    out = base.select("customer_id", "recency", "frequency", "monetary", (bins + 1 - s["recency"]).alias("r"), s["frequency"].alias("f"), s["monetary"].alias("m"))
    blend = (weights[0] * F.col("r") + weights[1] * F.col("f") + weights[2] * F.col("m")) / sum(weights)
    return out.withColumn("rfm", F.round((blend - 1) / (bins - 1) * 100, 4))


def segment_summary(scored: DataFrame, score: str, value: str, segments: int) -> DataFrame:
    """Customers, value and value share per segment, 1 the best."""
    bucket = bin_score(scored, [score], segments)[score]
    total = scored.agg(F.sum(value)).first()[0]
    return scored.groupBy((segments + 1 - bucket).alias("segment_id")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum(value), 2).alias("value"), F.round(100 * F.sum(value) / total, 4).alias("value_share"))


def basket_rules(df: DataFrame, basket: str, item: str, support: float, confidence: float, lift: float) -> DataFrame:
    """Rules a -> b over items of a basket. Items below the support go first; pairs form inside one basket's item set."""
    items = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    n = items.agg(F.count_distinct("basket")).first()[0]
    singles = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support * n)
    sets = items.join(singles.select("item"), "item", "left_semi").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counts = sets.where(F.size("s") > 1).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support * n)
    both = counts.unionByName(counts.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    x, y = singles.select(F.col("item").alias("a"), F.col("n").alias("na")), singles.select(F.col("item").alias("b"), F.col("n").alias("nb"))
    rules = both.join(x, "a").join(y, "b").select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), F.col("n").alias("together"), (F.col("n") / n).alias("support"), (F.col("n") / F.col("na")).alias("confidence"), (F.col("n") * n / (F.col("na") * F.col("nb"))).alias("lift"))
    kept = rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    return kept.select("antecedent", "consequent", "together", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


def basket_triple_rules(df: DataFrame, basket: str, item: str, support: float, confidence: float) -> DataFrame:
    """Rules {a, b} -> c over frequent sets of three items. Items below the support go first, as no frequent set holds
    them; triples form inside one basket, whose size bounds them, and are counted before they are dealt out."""
    items = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    n = items.agg(F.count_distinct("basket")).first()[0]
    singles = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support * n)
    sets = items.join(singles.select("item"), "item", "left_semi").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("s"))

    def rest(i):
        return F.slice("s", i + 2, F.size("s"))

    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(rest(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs_after = lambda a, i: F.flatten(F.transform(rest(i), lambda b, j: F.transform(F.slice("s", i + j + 3, F.size("s")), lambda c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))))
    two = sets.where(F.size("s") > 1).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n2"))
    three = sets.where(F.size("s") > 2).select(F.inline(F.flatten(F.transform("s", pairs_after)))).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support * n)
    turns = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("consequent")) for x, y, z in ("abc", "acb", "bca")])
    rules = three.select("n", F.inline(turns)).join(two, ["a", "b"]).withColumn("confidence", F.col("n") / F.col("n2"))
    return rules.where(F.col("confidence") >= confidence).select("a", "b", "consequent", F.col("n").alias("together"), F.round(F.col("n") / n, 6).alias("support"), F.round("confidence", 6).alias("confidence"))


def sequence_steps(df: DataFrame, customer: str, ts: str, order: str, item: str, gap_days: int = 14) -> DataFrame:
    """(previous, following) items of a customer's consecutive orders at most gap_days apart."""
    w = W.partitionBy(customer).orderBy(ts, order)
    step = df.select(F.col(item).alias("previous"), F.lead(item).over(w).alias("following"), F.datediff(F.lead(ts).over(w), F.col(ts)).alias("gap"))
    return step.where((F.col("gap") <= gap_days) & F.col("following").isNotNull())


def sequence_rules(steps: DataFrame) -> DataFrame:
    c = steps.groupBy("previous", "following").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 4).alias("avg_gap"))
    return c.select("previous", "following", "n", "avg_gap", F.round(F.col("n") / F.sum("n").over(W.partitionBy("previous")), 6).alias("confidence"))


def did_lift(df: DataFrame, treated: Column, after: Column, amount: str) -> DataFrame:
    """Difference in differences of mean amounts."""
    cell = lambda t, a: F.avg(F.when((treated == t) & (after == a), F.col(amount)))
    wide = df.agg(cell(True, False).alias("t0"), cell(True, True).alias("t1"), cell(False, False).alias("c0"), cell(False, True).alias("c1"))
    return wide.select(*[F.round(c, 4).alias(c) for c in ("t0", "t1", "c0", "c1")], F.round((F.col("t1") - F.col("t0")) - (F.col("c1") - F.col("c0")), 4).alias("did"))


def sample_size(p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8, least: int = 30) -> Column:
    """Units per arm for two proportions."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.greatest(F.lit(least), F.ceil(z * z * (p1 * (1 - p1) + p2 * (1 - p2)) / F.pow(p1 - p2, 2))).cast("long")


def holdout_plan(segments: DataFrame, rate: str, lift: str, traffic: str, share: float = 0.1) -> DataFrame:
    """Per segment: size per arm, total with imbalance, holdout, days."""
    p1 = F.col(rate)
    n = sample_size(p1, p1 * (1 + F.col(lift)))
    total = 2 * n * (1 / F.lit(share) + 1 / F.lit(1 - share)) / 4
    return segments.withColumn("n_per_arm", n).withColumn("total", F.round(total, 4)).withColumn("holdout", F.round(total * share, 4)).withColumn("days", F.round(total / F.col(traffic), 4)).withColumn("underpowered", total * share < n)


def with_labels(df: DataFrame, key: str, labels: dict, name: str = "label") -> DataFrame:
    """df with the label of each key: a map literal instead of a join, as labels are few; unknown keys get null."""
    cells = [F.lit(x) for kv in labels.items() for x in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*cells), F.col(key)) if cells else F.lit(None).cast("string"))


def in_window(df: DataFrame, ts: str, end: str, kind: str = "last_365", start: str | None = None) -> DataFrame:
    """Rows of the days up to end, included: of the 365 days before it, of its year so far, or from a custom start on. The
    bounds are literals, so that they reach the scan. Rows without a day go."""
    last = F.lit(end).cast("date")
    first = {"last_365": F.date_sub(last, 365), "year_to_date": F.trunc(last, "year"), "custom": F.lit(start or end).cast("date")}[kind]
    return df.where(F.col(ts).cast("date").between(first, last))


def daily(df: DataFrame, ts: str, amount: str, customer: str) -> DataFrame:
    """day, revenue and distinct customers of each day."""
    return df.groupBy(F.col(ts).cast("date").alias("day")).agg(F.round(F.sum(amount), 2).alias("revenue"), F.count_distinct(customer).alias("customers"))


def top_rules(rules: DataFrame, k: int) -> DataFrame:
    """The k best rules by lift, confidence and support, ties by name: each task keeps k."""
    return rules.orderBy(*[F.col(c).desc() for c in ("lift", "confidence", "support")], "antecedent", "consequent").limit(k)


def frequent_sets(df: DataFrame, basket: str, item: str, support: float, most: int = 4) -> DataFrame:
    """(items, together, support) of every set of 1..most items that stands in a share `support` of the baskets.

    Level by level: a basket is spelled out only into sets that extend a frequent one by a greater item, so the rows of a
    level are bounded by the frequent sets its baskets hold. One count reaches the driver.
    """
    items = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    n = items.agg(F.count_distinct("basket")).first()[0]
    count = lambda rows: rows.groupBy("items").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= support * n)
    sets = items.select("basket", F.array("item").alias("items"))
    found = count(sets)
    single = items.join(found.select(F.col("items")[0].alias("item")), "item", "left_semi")
    levels = [found]
    for _ in range(most - 1):
        sets = sets.join(found.select("items"), "items", "left_semi")
        sets = sets.join(single, "basket").where(F.col("item") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("item")).alias("items"))
        found = count(sets)
        levels.append(found)
    return reduce(DataFrame.unionByName, levels).select("items", "together", F.round(F.try_divide(F.col("together"), F.lit(n)), 6).alias("support"))
