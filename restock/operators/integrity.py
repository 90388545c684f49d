"""Validated loads: key, reference and range checks, name-to-id mapping, appends and patches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restock.operators.relational import strict_map
from restock.schemas import CORE_TABLES, CoreTable
from restock.session import cut_lineage

VIOLATION = "rule STRING, key STRING, rows BIGINT"


def batch_or_none(batch: DataFrame) -> DataFrame | None:
    """None for an empty batch, so the caller skips the load."""
    return None if batch.isEmpty() else batch


def _key_text(columns: Sequence[str]):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns]
    return F.concat_ws("|", *parts)


def duplicate_keys(batch: DataFrame, table: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Keys that repeat inside the batch or already exist in the table.

    Counts are combined before the shuffle, so one key repeated many times costs nothing extra. The
    stored table, whose keys are unique, is only asked for the keys of the batch: a small batch is
    broadcast and the table is not shuffled.
    """
    key = list(key)
    counts = batch.groupBy(*key).agg(F.count("*").alias("rows"))
    if table is not None:
        hits = table.select(*key).join(counts.select(*key), key, "left_semi")
        counts = counts.join(hits.withColumn("_stored", F.lit(1)), key, "left").withColumn(
            "rows", F.col("rows") + F.coalesce("_stored", F.lit(0))
        )
    return counts.filter("rows > 1").select(
        F.lit("unique").alias("rule"), _key_text(key).alias("key"), "rows"
    )


def missing_references(batch: DataFrame, column: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Values of ``column`` without a parent row."""
    values = batch.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_col).alias(column))
    return values.join(known, column, "left_anti").select(
        F.lit(f"reference {column}").alias("rule"), F.col(column).cast("string").alias("key"), "rows"
    )


def range_violations(batch: DataFrame, checks: Mapping[str, str], key: Sequence[str]) -> DataFrame:
    """Rows that break a value check, for all checks in one pass over the batch."""
    broken = F.filter(
        F.array(*[F.when(~F.expr(rule), F.lit(f"check {name}")) for name, rule in checks.items()]),
        lambda x: x.isNotNull(),
    )
    return (
        batch.select(F.explode(broken).alias("rule"), _key_text(key).alias("key"))
        .groupBy("rule", "key")
        .agg(F.count("*").alias("rows"))
    )


def violations(
    batch: DataFrame, spec: CoreTable, table: DataFrame | None, parents: Mapping[str, DataFrame]
) -> DataFrame:
    """Every broken rule of a batch as (rule, key, rows)."""
    rules = {f"required {c}": f"{c} IS NOT NULL" for c in spec.required if c in batch.columns}
    rules.update(spec.checks)
    found = [
        duplicate_keys(batch, table, spec.unique),
        range_violations(batch, rules, spec.unique),
    ]
    for column, (parent, parent_col) in spec.references.items():
        found.append(missing_references(batch, column, parents[parent], parent_col))
    return reduce(lambda a, b: a.unionByName(b), found)


def assign_ids(batch: DataFrame, id_col: str, last_id: int) -> DataFrame:
    """Consecutive ids after ``last_id``: partition sizes give offsets, no sort of the rows.

    ``batch`` must be read from files (see ``cut_lineage``), so that both passes see the same
    partitions.
    """
    fixed = batch.withColumn("_part", F.spark_partition_id()).withColumn(
        "_seq", F.monotonically_increasing_id()
    )
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    # this window sees one row per partition of the batch, never the batch itself
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    new_id = F.lit(last_id) + 1 + F.col("_before") + F.col("_seq") - F.col("_first")
    return (
        fixed.join(offsets, "_part")
        .withColumn(id_col, new_id.cast("long"))
        .drop("_part", "_seq", "_first", "_before")
    )


@dataclass
class LoadResult:
    """``ids`` holds the new ids of a written batch, ``violations`` the reasons of a refused one."""

    written: bool
    ids: DataFrame | None = None
    violations: DataFrame | None = None


class CoreStore:
    """Core tables as parquet below ``root/<table>/v<N>``.

    A patch writes a whole new version and readers take the newest finished one, so a job that
    fails half-way leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _version(self, name: str) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v*/_SUCCESS")
        found = [status.getPath().getParent().getName() for status in files.globStatus(done)]
        return max((int(v[1:]) for v in found), default=None)

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def table(self, name: str) -> DataFrame:
        """Every stored row, with the declared schema."""
        struct = CORE_TABLES[name].struct
        version = self._version(name)
        if version is None:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(self._path(name, version))

    def append(self, name: str, batch: DataFrame) -> LoadResult:
        """All-or-nothing append: any violation leaves the table as it was.

        An empty batch is rejected. Missing optional columns become NULL or their default, ids
        continue after the largest stored id. The batch is computed once and staged.
        """
        spec = CORE_TABLES[name]
        shaped = cut_lineage(_shape(batch, spec))
        if shaped.isEmpty():
            raise ValueError(f"no {name} provided")
        stored = self.table(name)
        parents = {parent: self.table(parent) for parent, _ in spec.references.values()}
        broken = violations(shaped, spec, stored, parents)
        if not broken.isEmpty():
            return LoadResult(False, violations=broken)
        last = stored.agg(F.max(spec.id_col)).first()[0] or 0
        numbered = assign_ids(shaped.drop(spec.id_col), spec.id_col, last)
        path = self._path(name, self._version(name) or 0)
        numbered.select(*spec.columns).write.mode("append").option("compression", "zstd").parquet(path)
        return LoadResult(True, ids=self.table(name).filter(F.col(spec.id_col) > last).select(spec.id_col))

    def append_once(self, name: str, batch: Callable[[], DataFrame], run: str) -> LoadResult:
        """:meth:`append` for a run that may be started again: what it finished is not loaded twice.

        A mark with the largest stored id is written before the rows, another one after them. If a run stopped in
        between, rows beyond that id are taken back first. ``batch`` is only made if it is still to be loaded.
        """
        id_col = CORE_TABLES[name].id_col
        marks = self._marks(name, run)
        if "done" in marks:
            return LoadResult(True)
        started = [int(m.split("-")[1]) for m in marks if m.startswith("started-")]
        if started:
            self._take_back(name, started[0])
        else:
            last = self.table(name).agg(F.max(id_col)).first()[0] or 0
            self._mark(name, run, f"started-{last}")
        result = self.append(name, batch())
        if result.written:
            self._mark(name, run, "done")
        return result

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self, name: str, run: str) -> list[str]:
        folder, files = self._files(f"{self.root}/_runs/{run}/{name}")
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def _mark(self, name: str, run: str, mark: str) -> None:
        path, files = self._files(f"{self.root}/_runs/{run}/{name}/{mark}")
        files.create(path).close()

    def _take_back(self, name: str, last: int) -> None:
        """Leave the rows up to the id ``last``: in a new version, or none of a table's first, unfinished version."""
        version = self._version(name)
        if version is None:
            folder, files = self._files(self._path(name, 0))
            files.delete(folder, True)
            return
        stored = self.table(name)
        id_col = F.col(CORE_TABLES[name].id_col)
        if not stored.where(id_col > last).isEmpty():
            kept = stored.where(id_col <= last)
            kept.write.option("compression", "zstd").parquet(self._path(name, version + 1))

    def patch(self, name: str, changes: DataFrame) -> DataFrame:
        """Apply partial updates by id, all or nothing; returns the ids that do not exist.

        ``changes`` holds the id and the columns to change; NULL keeps the stored value. An id may
        occur once in it. Only the changed rows are checked: for their own values, and for keys that
        another row has as well.
        """
        spec = CORE_TABLES[name]
        stored = self.table(name)
        changes = cut_lineage(changes)
        twice = changes.groupBy(spec.id_col).count().filter("count > 1").select(spec.id_col).first()
        if twice:
            raise ValueError(f"{name}: update names id {twice[0]} more than once")
        unknown = cut_lineage(
            changes.select(spec.id_col).join(stored.select(spec.id_col), spec.id_col, "left_anti")
        )
        patched = cut_lineage(patched_table(stored, changes, spec.id_col))
        parents = {parent: self.table(parent) for parent, _ in spec.references.values()}
        touched = patched.join(changes.select(spec.id_col), spec.id_col, "left_semi")
        others = patched.join(changes.select(spec.id_col), spec.id_col, "left_anti")
        broken = violations(touched, spec, others, parents)
        if not broken.isEmpty():
            raise ValueError(f"{name}: update breaks {broken.first().asDict()}")
        path = self._path(name, (self._version(name) or 0) + 1)
        patched.write.option("compression", "zstd").parquet(path)
        return unknown


def _shape(batch: DataFrame, spec: CoreTable) -> DataFrame:
    """Cast to the declared columns, adding NULLs and defaults for absent ones."""
    columns = []
    for f in spec.struct:
        value = F.col(f.name) if f.name in batch.columns else F.lit(spec.defaults.get(f.name))
        columns.append(value.cast(f.dataType).alias(f.name))
    return batch.select(*columns)


def patched_table(stored: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """``stored`` with the non-NULL values of ``changes`` taken over by id."""
    fields = [c for c in changes.columns if c != id_col]
    renamed = changes.select(id_col, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return stored.join(renamed, id_col, "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in stored.columns]
    )


def map_batch(
    batch: DataFrame, mappers: Mapping[str, tuple[DataFrame, str, str]], renames: Mapping[str, str]
) -> DataFrame:
    """Turn the name columns of a landing batch into ids and rename them."""
    for column, (table, name_col, id_col) in mappers.items():
        batch = strict_map(batch, column, table, name_col, id_col)
    return batch.withColumnsRenamed(dict(renames))
