"""Insert-if-absent, upsert and reference lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row per key. Every map task keeps one row per key before the shuffle
    (WindowGroupLimit), so any number of copies of one key stays cheap. Rows are sorted as
    they are: pass narrow ones and fetch the rest by place (`late`)."""
    window = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def absent(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not stored yet. `batch` must be unique on the key."""
    return batch.join(stored.select(key), key, "left_anti")


def insert_if_absent(batch: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows to append, first come first kept."""
    return absent(keep_first(batch, key, order), stored, key)


def stored_matches(stored: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a big stored table whose key occurs in a batch.

    The stored table is read one or two columns wide. Keys are texts of any length, so it is left
    to AQE to broadcast them by their measured size in bytes.
    """
    return stored.select(*columns).join(keys.select(key).distinct(), key, "left_semi")


def canonical_ids(first: DataFrame, matches: DataFrame) -> DataFrame:
    """Id under which a delivery is stored: the stored one, else the first of the batch."""
    known = matches.select("delivery_key", F.col("id").alias("_stored"))
    return first.join(known, "delivery_key", "left").select(
        "delivery_key", F.coalesce("_stored", "id").alias("canonical_id")
    )


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without the new keys, plus the new rows."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent ids that children refer to but that do not exist, with the child count.

    Children are counted per parent id first: what is joined has one row per id, however
    many children one parent has.
    """
    counts = (
        children.filter("notification_id IS NOT NULL")
        .groupBy("notification_id")
        .agg(F.count("*").alias("children"))
    )
    ids = parents.select(F.col("id").alias("notification_id"))
    return counts.join(ids, "notification_id", "left_anti")


def detach(children: DataFrame, expired: DataFrame) -> DataFrame:
    """Set `notification_id` to null where the parent is among the expired ones.

    The expired ids are unique, so the join adds no rows; AQE broadcasts them when they turn
    out small and splits a skewed parent id otherwise. Rows without a parent, which may be
    most of an old table, are dealt out by their own id instead of meeting in one task.
    """
    gone = expired.select(F.col("id").alias("_gone")).distinct()
    parent = F.coalesce("notification_id", F.concat(F.lit("\0"), "id"))
    joined = children.withColumn("_parent", parent).join(gone, F.col("_parent") == gone["_gone"], "left")
    kept = F.when(F.col("_gone").isNull(), F.col("notification_id"))
    return joined.withColumn("notification_id", kept).select(*children.columns)
