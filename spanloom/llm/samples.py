"""Samples of labelled rows, bounded for every class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Classes that a classifier may have.
CLASSES = 1000


def quotas(counts: dict, total: int) -> dict:
    """At most `total` rows shared out: classes with fewer than an equal share leave the rest to others."""
    out, left = {}, total
    for i, (c, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        out[c] = min(n, left // (len(counts) - i))
        left -= out[c]
    return out


def draw(rows: DataFrame, total: int) -> tuple[DataFrame, dict, dict]:
    """(text, cls) of at most `total` rows of (doc_id, text, cls), the numbers of different rows
    of each class, and of the ones that are drawn.

    Rows are drawn by a hash of id and text, so a row that repeats counts once, however often it
    occurs, and different texts of one id are different rows. No row passes through the driver.
    """
    keyed = rows.withColumn("k", F.xxhash64(F.lit("sample"), "doc_id", "text"))
    keys = keyed.select("cls", "k").distinct()
    counts = {r["cls"]: r["n"] for r in keys.groupBy("cls").agg(F.count("*").alias("n")).limit(CLASSES + 1).collect()}
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    if not counts:
        return rows.select("text", "cls").limit(0), {}, {}
    quota = quotas(counts, total)
    # A share of the keys that is some more than the quota, then the least of them: the window
    # sorts about a quota of keys for each class.
    unit = (F.col("k").bitwiseAND((1 << 52) - 1)).cast("double") / float(1 << 52)
    table = lambda f: F.element_at(F.create_map(*[F.lit(x) for c in counts for x in (c, f(c))]), F.col("cls"))
    some = keys.filter(unit < table(lambda c: min(1.0, (quota[c] + 4 * quota[c] ** 0.5 + 10) / counts[c])))
    rank = F.row_number().over(W.partitionBy("cls").orderBy(unit, "k"))
    picked = some.withColumn("r", rank).filter(F.col("r") <= table(lambda c: quota[c])).select("cls", "k")
    drawn = keyed.join(F.broadcast(picked), ["cls", "k"])  # at most `total` keys
    return drawn.groupBy("cls", "k").agg(F.first("text").alias("text")).select("text", "cls"), counts, quota
