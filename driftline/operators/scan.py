"""Prefix scans of long segments in many tasks.

A window over a key sorts all of the key's rows in one task.  Here a key's rows
are cut into spans of their (numeric) order.  Each span is scanned by itself;
what it passes on (its sums, its last values) is one row, and the spans' rows
are scanned in order; then each row takes what the spans before it pass on.  So
a key with all rows is shared by as many tasks as it has spans.  Rows are
shuffled once, by key and span; the spans' rows join them where they are.

Order values must be whole numbers that tell a key's rows apart; rows with a
null order stand before all others, in a span of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(rows: DataFrame, key: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None, span: int = 50_000) -> DataFrame:
    """``rows`` with new columns, each over the key's rows in order: ``sums``
    up to a row (nulls add nothing; null before the first value), ``lasts`` (the
    newest value up to a row that is not null), ``lags`` (the value of the row
    before, null for the first) and ``firsts`` (the value of the first row)."""
    sums, lasts, lags, firsts = (x or {} for x in (sums, lasts, lags, firsts))
    cut = rows.withColumn("_span", F.coalesce(F.floor(F.col(order) / span).cast("long"), F.lit(-(2**62))))
    for name, c in (sums | lasts | lags | firsts).items():
        cut = cut.withColumn(f"_of_{name}", c)
    within = Window.partitionBy(*key, "_span").orderBy(F.col(order).asc_nulls_first())
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    # what each span passes on: combined before the shuffle
    newest = lambda c: F.max_by(F.struct(c), F.struct(F.col(order).isNotNull(), order))
    passed = [F.sum(f"_of_{n}").alias(f"_s_{n}") for n in sums]
    passed += [F.max_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), F.struct(F.col(order).isNotNull(), order))).alias(f"_l_{n}") for n in lasts]
    passed += [newest(f"_of_{n}").alias(f"_g_{n}") for n in lags]
    passed += [F.min_by(F.struct(f"_of_{n}"), F.struct(F.col(order).isNotNull(), order)).alias(f"_f_{n}") for n in firsts]
    spans = cut.groupBy(*key, "_span").agg(*passed)
    before = Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = [F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums]
    taken += [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in lasts]
    taken += [F.last(f"_g_{n}").over(before).alias(f"_g_{n}") for n in lags]
    taken += [F.first(f"_f_{n}").over(whole).alias(f"_f_{n}") for n in firsts]
    spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_span").alias("_at"), *taken)
    own = cut
    for n in sums:
        own = own.withColumn(f"_w_{n}", F.sum(f"_of_{n}").over(upto))
    for n in lasts:
        own = own.withColumn(f"_w_{n}", F.last(f"_of_{n}", ignorenulls=True).over(upto))
    for n in lags:
        own = own.withColumn(f"_w_{n}", F.lag(F.struct(f"_of_{n}")).over(within))
    same = F.col("_span") == F.col("_at")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = own.join(spans, same)
    new = [F.when(F.col(f"_w_{n}").isNull() & F.col(f"_s_{n}").isNull(), None).otherwise(F.coalesce(F.col(f"_w_{n}"), F.lit(0)) + F.coalesce(F.col(f"_s_{n}"), F.lit(0))).alias(n) for n in sums]
    new += [F.coalesce(f"_w_{n}", f"_l_{n}").alias(n) for n in lasts]
    new += [F.coalesce(f"_w_{n}", f"_g_{n}")[f"_of_{n}"].alias(n) for n in lags]
    new += [F.col(f"_f_{n}")[f"_of_{n}"].alias(n) for n in firsts]
    return both.select(*rows.columns, *new)
