"""Which delivery keys and event ids are stored: an append-only index beside the tables.

Asking the history tables would read their key columns, all of them, for every micro-batch.
The ledger has one short row per stored key: two hashes, and for a delivery the id it is
stored under. Rows are dealt into fixed buckets by hash; each batch adds one part per bucket,
sorted by hash, and a Bloom filter for it, kept as rows of 64-bit blocks. A lookup joins
the batch's keys with the filter blocks they hash to, reads the parts that may hold one of
them, and compares both hashes (124 bits). New keys mostly touch no part at all.

Ingest writes a part before it stores rows and names it in `ledger_files` after: a part
without a name is not looked at. In between its name stands in `ledger_open`; what a batch
that was never finished has left there is compared with the tables by the next one. A lookup
leaves out its own batch, so a repeated batch plans the same rows as its first try. Merging
names the merged part before it drops the old ones, so a key may be listed twice for a
while, which changes nothing. Retention drops the entries of rows it has deleted.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import retention
from ..schemas import TABLES
from ..sources.tables import Tables

BUCKETS = 16
#: Keys per filter block, and bits a key sets in it: about two false positives in ten thousand.
KEYS_PER_BLOCK, BITS_SET = 2, 6
#: Parts of the ledger beyond which small ones are merged.
MOST_PARTS = 32

#: kind of key: (table, key column, time column by which retention drops the row)
KINDS = {
    "notes": ("webhook_notifications", "delivery_key", "received_at_ms"),
    "face": ("face_events", "event_id", "seen_at_ms"),
    "vehicle": ("vehicle_events", "event_id", "seen_at_ms"),
}


def hashes(kind: Column, key: Column) -> dict[str, Column]:
    """`digest` and `check` of a key, and its bucket."""
    digest = F.xxhash64(kind, key)
    check = F.conv(F.substring(F.md5(F.concat_ws("\n", kind, key)), 1, 15), 16, 10).cast("long")
    return {"digest": digest, "check": check, "bucket": F.pmod(digest, F.lit(BUCKETS)).cast("int")}


def _block(blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned("digest", 8), blocks)


def _bits() -> Column:
    one = F.lit(1).cast("long")
    places = [F.shiftrightunsigned("check", 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_SET)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, p) for p in places])


def entries(rows: DataFrame, kind: str) -> DataFrame:
    """Ledger rows of stored rows of one kind."""
    _, key, at_ms = KINDS[kind]
    name = F.lit(kind)
    ref = F.col("id") if kind == "notes" else F.lit(None).cast("string")
    found = rows.filter(F.col(key).isNotNull()).withColumns(hashes(name, F.col(key)))
    return found.select(
        "digest", "check", ref.alias("ref"), F.col(at_ms).alias("at_ms"), name.alias("kind"), "bucket"
    )


def _write_part(tables: Tables, rows: DataFrame, part: str) -> list[tuple]:
    """Rows of a part and their filter; returns the files' names, not written yet."""
    tables.replace_days(rows.withColumn("part", F.lit(part)), "key_ledger")
    written = tables.only_where("key_ledger", F.col("part") == part)
    sizes = written.groupBy("bucket").agg(F.count("*").alias("keys")).collect()
    files = [(r.bucket, r["keys"], max(1, r["keys"] // KEYS_PER_BLOCK), part) for r in sizes]
    blocks = F.lit(1).cast("long")
    for bucket, _, n, _ in files:
        blocks = F.when(F.col("bucket") == bucket, F.lit(n).cast("long")).otherwise(blocks)
    filters = written.groupBy("bucket", _block(blocks).alias("block")).agg(F.bit_or(_bits()).alias("bits"))
    tables.replace_days(filters.withColumn("part", F.lit(part)), "key_filters")
    return files


def _name(tables: Tables, files: list[tuple]) -> None:
    tables.replace_days(tables.spark.createDataFrame(files, TABLES["ledger_files"]), "ledger_files")


def add(tables: Tables, new: dict[str, DataFrame], part: str) -> list[tuple]:
    """Write the keys of rows about to be stored; repeating it replaces the same part."""
    tables.replace_days(tables.spark.createDataFrame([(0, part)], TABLES["ledger_open"]), "ledger_open")
    rows = reduce(DataFrame.unionByName, [entries(new[k], k) for k in KINDS])
    return _write_part(tables, rows, part)


def commit(tables: Tables, files: list[tuple], part: str) -> None:
    """Name a part whose rows are stored."""
    _name(tables, files)
    tables.clear("ledger_open", [f"part={part}"])


def recover(tables: Tables, part: str) -> list[str]:
    """List what is stored of the batches that were never finished, but for the one named `part`; returns their names."""
    open_parts = tables.read("ledger_open").filter(F.col("part") != part).select("part").distinct()
    names = [r.part for r in open_parts.collect()]
    for name in names:
        with tables.staging():
            rows = tables.only_where("key_ledger", F.col("part") == name).drop("part")
            found = []
            for kind, (table, key, _) in KINDS.items():
                stored = tables.read(table).withColumns(hashes(F.lit(kind), F.col(key))).select("digest", "check")
                found.append(rows.filter(F.col("kind") == kind).join(stored, ["digest", "check"], "left_semi"))
            kept = tables.staged(reduce(DataFrame.unionByName, found), "recovered-keys")
            tables.clear("key_ledger", [f"part={name}"])
            tables.clear("key_filters", [f"part={name}"])
            commit(tables, _write_part(tables, kept, name), name)
    return names


def ensure(tables: Tables) -> None:
    """Build the ledger of a store that was filled without one."""
    if tables.read("ledger_files").isEmpty():
        stored = {k: tables.read(table) for k, (table, _, _) in KINDS.items()}
        if any(not df.isEmpty() for df in stored.values()):
            commit(tables, add(tables, stored, "history"), "history")


def parts_to_read(tables: Tables, keys: DataFrame, own: str = "") -> tuple[DataFrame, list]:
    """(keys that may be listed, the (bucket, part) they may be in). `keys`: kind, key.

    The list is no longer than the names of the files, `BUCKETS` x `MOST_PARTS`.
    """
    hashed = keys.distinct().withColumns(hashes(F.col("kind"), F.col("key")))
    files = tables.read("ledger_files").filter(F.col("part") != own)
    probes = hashed.join(files.select("bucket", "part", "blocks"), "bucket")
    probes = probes.withColumns({"block": _block(F.col("blocks")), "mask": _bits()})
    hits = probes.join(tables.read("key_filters"), ["bucket", "part", "block"])
    hits = hits.filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    hits = tables.staged(hits.select("kind", "key", "digest", "check", "bucket", "part"), "ledger-hits")
    return hits, hits.select("bucket", "part").distinct().collect()


def known(tables: Tables, keys: DataFrame, own: str = "") -> DataFrame:
    """`keys` (kind, key) that are listed, but for the part `own`, with the id of a delivery (`ref`)."""
    none = keys.select("kind", "key", F.lit(None).cast("string").alias("ref")).limit(0)
    # a ledger without other parts lists nothing, whatever the keys: they are not read
    if tables.read("ledger_files").filter(F.col("part") != own).isEmpty():
        return none
    hits, places = parts_to_read(tables, keys, own)
    if not places:
        return none
    wanted = reduce(
        Column.__or__,
        [
            (F.col("part") == part) & F.col("bucket").isin([p.bucket for p in places if p.part == part])
            for part in sorted({p.part for p in places})
        ],
    )
    listed = tables.only_where("key_ledger", wanted)
    listed = listed.select("digest", "check", "kind", "ref", "bucket").distinct()
    asked = hits.select("kind", "key", "digest", "check", "bucket").distinct()
    return asked.join(listed, ["bucket", "digest", "check", "kind"]).select("kind", "key", "ref")


def merge_parts(tables: Tables, most: int = MOST_PARTS) -> list[str]:
    """Merge the smallest parts into one once there are more than `most`; returns their names.

    Half of the places stay free, and large parts are left alone, so a key is rewritten a
    few times in its life.
    """
    files = tables.read("ledger_files").groupBy("part").agg(F.sum("keys").alias("keys"))
    parts = sorted(files.collect(), key=lambda r: (r["keys"], r.part))
    if len(parts) <= most:
        return []
    small = [r.part for r in parts[: len(parts) - most // 2]]
    merged = f"merged-{zlib.crc32(chr(10).join(sorted(small)).encode()):08x}"
    rows = tables.only_where("key_ledger", F.col("part").isin(small)).drop("part").distinct()
    with tables.staging():
        _name(tables, _write_part(tables, tables.staged(rows, "merged-keys"), merged))
    gone = [p for p in small if p != merged]
    for table in ("ledger_files", "key_filters", "key_ledger"):
        tables.clear(table, [f"part={p}" for p in gone])
    return gone


def drop_expired(tables: Tables, now_ms: int) -> None:
    """After retention: unlist the keys of rows it has deleted. Filters may keep their bits."""
    raw_cutoff, row_cutoff = retention.cutoffs(now_ms)
    expired = F.col("at_ms") < F.when(F.col("kind") == "notes", raw_cutoff).otherwise(row_cutoff)
    ledger = tables.read("key_ledger")
    places = [(r.part, r.bucket) for r in ledger.filter(expired).select("part", "bucket").distinct().collect()]
    if not places:
        return
    touched = reduce(Column.__or__, [(F.col("part") == p) & (F.col("bucket") == b) for p, b in places])
    with tables.staging():
        kept = tables.staged(tables.only_where("key_ledger", touched).filter(~expired), "kept-keys")
        left = {(r.part, r.bucket) for r in kept.select("part", "bucket").distinct().collect()}
        tables.replace_days(kept, "key_ledger")
    tables.clear("key_ledger", [f"part={p}/bucket={b}" for p, b in places if (p, b) not in left])
