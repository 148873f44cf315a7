"""Differences between two copies of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_form(value: Column) -> Column:
    """One text for a number, or for text that holds one in uneven form (blanks, leading zeros, a
    decimal point); empty text and null are no value. Text that is no number stands for itself,
    without outer blanks, so it differs from no value and from every number."""
    text = F.trim(value.cast("string"))
    return F.coalesce(text.try_cast("double").cast("string"), F.nullif(text, F.lit("")))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per key whose rows differ: the keys, `presence` ('only_left', 'only_right', 'both'),
    `n_left` and `n_right`, how many rows of the key either side has, and `differences`, an array
    of (field, left_value, right_value) with values as text.

    `fields` names each compared field and its normalised expression on either side; normalised
    values compare null-safely, so null equals null and differs from anything else. Keys compare
    null-safely too. Repeated rows of a side that agree after normalisation count once; where one
    side holds several rows of a key, the greatest normalised row stands for it, whatever the
    order of the rows. Equal rows give nothing; an empty side makes every key one-sided. Columns
    that are neither key nor field are never read, so they may clash.
    """
    names = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, which: int, tag: str) -> DataFrame:
        row = F.struct(F.lit(0).alias("_"), *[e[which].alias(f) for f, e in fields.items()])
        picked = df.select(*[F.col(f"`{k}`").alias(f"{tag}{n}") for k, n in zip(keys, names, strict=True)], row.alias("row"))
        return picked.groupBy(*[f"{tag}{n}" for n in names]).agg(F.max("row").alias(f"{tag}row"), F.count(F.lit(1)).alias(f"{tag}n"))

    a, b = side(left, 0, "l"), side(right, 1, "r")
    on = reduce(lambda x, y: x & y, [F.col(f"l{n}").eqNullSafe(F.col(f"r{n}")) for n in names])
    both = a.join(b, on, "full_outer")
    presence = F.when(F.col("rrow").isNull(), "only_left").when(F.col("lrow").isNull(), "only_right").otherwise("both")
    text = lambda side, f: F.col(f"{side}row.`{f}`").cast("string")
    cells = F.array(
        *[
            F.when(
                ~F.col(f"lrow.`{f}`").eqNullSafe(F.col(f"rrow.`{f}`")),
                F.struct(F.lit(f).alias("field"), text("l", f).alias("left_value"), text("r", f).alias("right_value")),
            )
            for f in fields
        ]
    )
    out = both.select(
        *[F.when(F.col("lrow").isNotNull(), F.col(f"l{n}")).otherwise(F.col(f"r{n}")).alias(k) for k, n in zip(keys, names, strict=True)],
        presence.alias("presence"),
        F.coalesce("ln", F.lit(0)).alias("n_left"),
        F.coalesce("rn", F.lit(0)).alias("n_right"),
        F.when(presence == "both", F.filter(cells, lambda c: c.isNotNull())).otherwise(F.filter(cells, lambda c: F.lit(False))).alias("differences"),
    )
    return out.where((F.col("presence") != "both") | (F.size("differences") > 0))
