"""Tables of a store as a base and changes upon it (merge on read).

A base is a whole table, range-partitioned and sorted by its key (links by source, so that a
node's links lie together), with Bloom filters on the columns that lookups name. A change is a
small table of the rows that were written and the ids that were deleted, with its version as
sequence number. Reading takes the base's rows that no change names, and of the others the
last. When changes have grown to a part of the base, or to many files, the next version is a
base again. Nothing is ever written into an older version, so readers of it are not disturbed.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A base is written when changed rows exceed this part of the base's (and ``LEAST``), or changes this number.
PART, LEAST, MOST = 0.25, 1000, 24
#: Order of a base, and columns with Bloom filters.
ORDER = {"nodes": ("id",), "links": ("source_id", "id"), "sessions": ("id",)}
FILTERED = {"nodes": ("id",), "links": ("id", "source_id", "target_id"), "sessions": ("id",)}
ROW_GROUP = 32 << 20


@dataclass
class Stored:
    """One table: its base, the rows of that, and changes as (folder, rows), oldest first."""

    base: str
    rows: int
    changes: list[tuple[str, int]] = field(default_factory=list)


def to_json(layout: dict[str, Stored]) -> str:
    return json.dumps({k: asdict(v) for k, v in layout.items()})


def from_json(text: str) -> dict[str, Stored]:
    return {k: Stored(v["base"], v["rows"], [tuple(c) for c in v["changes"]]) for k, v in json.loads(text).items()}


def _changed(schema: T.StructType) -> T.StructType:
    plain = [T.StructField(f.name, f.dataType, True) for f in schema]
    return T.StructType([*plain, T.StructField("_deleted", T.BooleanType()), T.StructField("_seq", T.LongType())])


def read(spark: SparkSession, path: str, stored: Stored, schema: T.StructType) -> DataFrame:
    """The table; filters on the key reach the scans of base and changes."""
    base = spark.read.schema(schema).parquet(f"{path}/{stored.base}")
    if not stored.changes:
        return base
    changes = spark.read.schema(_changed(schema)).parquet(*[f"{path}/{c}" for c, _ in stored.changes])
    last = changes.groupBy("id").agg(*[F.max_by(c, "_seq").alias(c) for c in changes.columns if c not in ("id", "_seq")])
    kept = base.join(changes.select("id").distinct(), "id", "left_anti").select(*schema.fieldNames())
    return kept.unionByName(last.where("NOT _deleted").select(*schema.fieldNames()))


def write_base(table: DataFrame, path: str, at: str, name: str) -> Stored:
    order = ORDER[name]
    writer = table.repartitionByRange(*order).sortWithinPartitions(*order).write
    writer = writer.option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in FILTERED[name]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(f"{path}/{at}")
    return Stored(at, table.sparkSession.read.parquet(f"{path}/{at}").count())


def _digest(table: DataFrame, name: str) -> DataFrame:
    """Digests of each row and of its text, which is read for both once."""
    text = F.sha2("content", 256) if "content" in table.columns else F.lit(None).cast("string")
    rest = F.to_json(F.struct(*sorted(c for c in table.columns if c != "content")))
    return table.select(F.col("id").alias(f"{name}_id"), text.alias(f"{name}_text"), F.sha2(rest, 256).alias(name))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, gone, text) of the rows that differ: whether ``new`` lacks them, and whether their texts do."""
    both = _digest(old, "a").join(_digest(new, "b"), F.col("a_id") == F.col("b_id"), "full")
    alike = F.col("a_text").eqNullSafe(F.col("b_text"))
    both = both.where(~F.col("a").eqNullSafe(F.col("b")) | ~alike)
    text = F.col("a").isNull() | F.col("b").isNull() | ~alike
    return both.select(F.coalesce("b_id", "a_id").alias("id"), F.col("b").isNull().alias("gone"), text.alias("text"))


def changed_rows(old: DataFrame, new: DataFrame, touched: Column | DataFrame | None) -> DataFrame:
    """Rows that ``new`` writes over ``old``, and ids that it lacks with ``_deleted``.

    ``touched`` names the rows that may differ, so that only these are read, or is the tables'
    :func:`differences`; without it these are worked out.
    """
    if isinstance(touched, Column):
        after, gone = new.where(touched), old.where(touched).select("id").join(new.where(touched).select("id"), "id", "left_anti")
    else:
        differ = differences(old, new) if touched is None else touched
        after = new.join(differ.where("NOT gone").select("id"), "id", "left_semi")
        gone = differ.where("gone").select("id")
    rows = after.select(*new.columns, F.lit(False).alias("_deleted"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema if f.name != "id"]
    return rows.unionByName(gone.select("id", *missing, F.lit(True).alias("_deleted")))


def write(new: DataFrame, old: DataFrame | None, stored: Stored | None, path: str, draft: str, at: str, name: str, seq: int, touched) -> Stored:
    """The table's part of a version, below ``draft``, which is to become ``at``: a base where
    there is none or changes have grown too many, else a change, or nothing (``touched`` False)."""
    if stored is not None and touched is False:
        return stored
    if stored is not None:
        rows = changed_rows(old, new, touched).withColumn("_seq", F.lit(seq).cast("long"))
        rows.repartition("id").write.parquet(f"{path}/{draft}/{name}-changes")  # few rows: adaptive execution makes few files
        n = new.sparkSession.read.schema(_changed(new.schema)).parquet(f"{path}/{draft}/{name}-changes").count()
        if not n:
            return stored
        if len(stored.changes) < MOST and sum(c for _, c in stored.changes) + n <= max(LEAST, PART * stored.rows):
            return Stored(stored.base, stored.rows, [*stored.changes, (f"{at}/{name}-changes", n)])
    made = write_base(new, path, f"{draft}/{name}", name)
    return Stored(f"{at}/{name}", made.rows)
