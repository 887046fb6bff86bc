"""Reading and writing the campaign tables as partitioned Parquet.

One number orders all writes: an import takes the next one, writes its rows with that number wherever they belong, and
becomes visible, in all tables at once, when the file `_commits/<number>.done` is created. Readers leave out rows whose
number has no such file, so nothing is renamed or taken back, whenever a driver dies.

* Log tables are split by version and day; `batch_no` is a column.
* Users and players are a base, split by a hash of their key, and one folder of changed rows for each import. The
  newest row of a key wins at read; `compact` folds the changes into the buckets that they touch.
* Keys that were stored once are kept in an index, split by version and by a hash of the key, so that a small batch is
  checked against the few splits that its keys can be in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from threading import RLock
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlake import schemas
from campaignlake.functions.variants import VARIANT_COLUMN, payload_variant
from campaignlake.operators.keys import touched
from campaignlake.operators.predicates import has_prefix

# Append-only tables and the time whose day splits them; without one it is the day of the write.
LOG_TABLES = {"events": "occurred_at", "answers": "occurred_at", "transactions": "occurred_at", "rewards": "granted_at", "typed_skipped": None, "event_sketches": "occurred_at"}
# Upserted tables: the key of a row, and the part of it whose hash is the bucket.
MERGED_TABLES = {"users": "email", "players": "user_id"}
MERGE_KEYS = {"users": ["email"], "players": ["version_id", "user_id"]}
# Tables whose rows are stored once for each key: the columns that make the key.
INDEXED_TABLES = {"events": ["dedup_key"], "transactions": ["dedup_key"], "rewards": ["dedup_key"], "answers": ["player_id", "question_id"]}
# State logs: one small file a write, folded into a last-state table from time to time.
STATE_LOGS = {"import_log": "import_id", "export_log": "export_id"}
DEFAULT_BUCKETS = 64
# Folders of changes, commit files and files of a state log beyond which they are folded.
MAX_CHANGES, MAX_COMMITS, MAX_LOG_FILES = 32, 256, 64

KEYS_SCHEMA = T.StructType(
    [T.StructField("dedup_key", T.StringType()), T.StructField("batch_no", T.LongType()), T.StructField("version_id", T.LongType()), T.StructField("split", T.IntegerType())]
)


def live_versions(versions: DataFrame, with_trashed: bool = False) -> DataFrame:
    """Versions without the soft-deleted ones, unless asked for."""
    return versions if with_trashed else versions.where(F.col("deleted_at").isNull())


def version_by_uuid(versions: DataFrame, uuid: str) -> DataFrame:
    """At most one live version with this public id."""
    return live_versions(versions).where(F.col("uuid") == uuid).select("id")


def for_version(table: DataFrame, version_id: int) -> DataFrame:
    return table.where(F.col("version_id") == version_id)


def natural_key(table: str) -> Column:
    """The text that an indexed table stores once; null for rows that may repeat."""
    return F.concat_ws("/", *[F.col(c).cast("string") for c in INDEXED_TABLES[table]]) if len(INDEXED_TABLES[table]) > 1 else F.col(*INDEXED_TABLES[table])


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty frame that Spark knows to be empty: what it is joined to is neither shuffled nor read."""
    return spark.range(1).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def latest(log: DataFrame, key: str) -> DataFrame:
    """Newest state of every job."""
    fields = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*fields), "seq").alias("_last")).select(key, "_last.*")


class HadoopPath:
    """A path on whatever file system the cluster uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def size(self) -> int:
        return self.fs.getContentSummary(self.path).getLength() if self.exists() else 0

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def names(self) -> list[str]:
        """Names in this folder; none when it is absent."""
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path)) if self.exists() else []

    def read_text(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, text: str) -> None:
        """Create the file; fails when it is there already."""
        stream = self.fs.create(self.path, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()


@dataclass(frozen=True)
class Snapshot:
    """The writes that a reader sees: numbers up to the last committed one, without those that never committed, and in
    log tables without those that a replay has replaced."""

    last: int = 0
    withdrawn: tuple[int, ...] = ()
    replaced: tuple[int, ...] = ()

    def sees(self, number: int) -> bool:
        return number <= self.last and number not in self.withdrawn

    def without(self, number: int) -> Snapshot:
        return replace(self, replaced=(*self.replaced, number))

    def visible(self, rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("batch_no") <= self.last)
        gone = (*self.withdrawn, *self.replaced)
        return rows.where(~F.col("batch_no").isin(*gone)) if gone else rows


class Commits:
    """Numbers of writes. `<number>.begun` reserves one, `<number>.done` makes its rows visible, and
    `<number>.done-<other>` does so in place of another's log rows; creating a file that is there fails, so no two writers
    share a number. Old files are folded into one that names the numbers that are not to be seen."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/_commits"

    def _file(self, name: str) -> HadoopPath:
        return HadoopPath(self.spark, f"{self.root}/{name}")

    def _listed(self) -> tuple[int, dict[str, Any], set[int], dict[int, str], dict[int, int]]:
        """(number up to which files were folded, what they said, begun numbers, done numbers with their files, numbers
        that replaced others by those others)."""
        through, begun, done, by = 0, set(), {}, {}
        for name in HadoopPath(self.spark, self.root).names():
            number, _, kind = name.partition(".")
            kind, _, other = kind.partition("-")
            if kind == "through":
                through = max(through, int(number))
            elif kind == "begun":
                begun.add(int(number))
            elif kind == "done":
                done[int(number)] = name
                if other:
                    by[int(other)] = int(number)
        said = json.loads(self._file(f"{through:012d}.through").read_text()) if through else {"withdrawn": [], "replaced": {}}
        by = {**{int(old): new for old, new in said["replaced"].items()}, **by}
        return through, said, {n for n in begun if n > through}, {n: f for n, f in done.items() if n > through}, by

    def snapshot(self) -> Snapshot:
        through, said, _, done, by = self._listed()
        last = max(done, default=through)
        missing = [n for n in range(through + 1, last) if n not in done]
        return Snapshot(last, (*said["withdrawn"], *missing), tuple(sorted(by)))

    def newest(self, number: int) -> int:
        """The number that holds what `number` wrote, after any replays."""
        by = self._listed()[-1]
        while number in by:
            number = by[number]
        return number

    def begin(self, name: str) -> int:
        through, _, begun, done, _ = self._listed()
        number = max([through, *begun, *done]) + 1
        self._file(f"{number:012d}.begun").write_new(name)
        return number

    def done(self, number: int) -> dict[str, Any] | None:
        """What the commit recorded; null without a commit. Asked for recent numbers only."""
        name = self._listed()[3].get(number)
        return json.loads(self._file(name).read_text()) if name else None

    def commit(self, number: int, record: dict[str, Any], replaces: int | None = None) -> None:
        kind = "done" if replaces is None else f"done-{replaces:012d}"
        self._file(f"{number:012d}.{kind}").write_new(json.dumps(record, default=str))

    def fold(self) -> None:
        """Fold all but the newest commit files when there are many. Files go only after the new one stands."""
        through, _, begun, done, by = self._listed()
        if len(begun) + len(done) < MAX_COMMITS:
            return
        upto = max(done) - 1
        kept = {
            "withdrawn": [n for n in self.snapshot().withdrawn if n <= upto],
            "replaced": {old: new for old, new in by.items() if new <= upto},
        }
        self._file(f"{upto:012d}.through").write_new(json.dumps(kept))
        for name in HadoopPath(self.spark, self.root).names():
            if int(name.partition(".")[0]) <= upto and name != f"{upto:012d}.through":
                self._file(name).delete()


class CampaignStore:
    """Tables under one root. One driver application writes a store at a time; `lock` orders
    the jobs inside it.

    The bucket count, and whether payloads are kept as variants too, are part of the layout: the first write stores
    them under the root, and a store that is opened with others is refused.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, variants: bool | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self._layout = HadoopPath(spark, f"{self.root}/_buckets")
        stored = int(self._layout.read_text()) if self._layout.exists() else None
        if stored is not None and buckets not in (None, stored):
            raise ValueError(f"the store at {root} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or DEFAULT_BUCKETS
        self._keeps = HadoopPath(spark, f"{self.root}/_variants")
        keeps = self._keeps.exists()
        if stored is not None and variants not in (None, keeps):
            raise ValueError(f"the store at {root} {'keeps' if keeps else 'does not keep'} payloads as variants")
        self.variants = keeps if stored is not None else bool(variants)
        self.commits = Commits(spark, self.root)
        self.lock = RLock()

    def keep_layout(self) -> None:
        """Store the layout before anything depends on it; the bucket count comes last and stands for all of it."""
        if not self._layout.exists():
            if self.variants and not self._keeps.exists():
                self._keeps.write_new("")
            if not self.variants:
                self._keeps.delete()
            self._layout.write_new(str(self.buckets))

    def begin(self, name: str) -> int:
        """The number of a write that starts now."""
        self.keep_layout()
        return self.commits.begin(name)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def rank_path(self, version_id: int) -> str:
        """Where a version's player ranges are kept; they go with the version's players."""
        return f"{self.root}/_ranks/players/version_id={version_id}"

    def _exists(self, path: str) -> bool:
        return HadoopPath(self.spark, path).exists()

    # --- layout

    def _partitions(self, table: str) -> list[str]:
        if table in LOG_TABLES:
            return ["version_id", "day"]
        return {"users": ["bucket"], "players": ["version_id", "bucket"]}.get(table, [])

    def _schema(self, table: str) -> T.StructType:
        fields = schemas.TABLES[table]
        names = fields.fieldNames()
        extra = [T.StructField("batch_id", T.StringType()), T.StructField("batch_no", T.LongType())] if table in LOG_TABLES else []
        if table == "events" and self.variants:
            extra.append(T.StructField(VARIANT_COLUMN, T.VariantType()))
        kinds = {"day": T.DateType(), "bucket": T.IntegerType()}
        return T.StructType(fields.fields + extra + [T.StructField(p, kinds[p]) for p in self._partitions(table) if p not in names])

    def bucket_of(self, table: str) -> Column:
        return self._split_of(F.col(MERGED_TABLES[table]))

    def _split_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _splits(self, keys: DataFrame, split: Column) -> list[int]:
        """The splits that hold any of the keys; at most as many as the layout has."""
        return sorted(r[0] for r in keys.select(split.alias("s")).where("s is not null").distinct().collect())

    # --- reading

    def snapshot(self) -> Snapshot:
        return self.commits.snapshot()

    def _files(self, root: str, schema: T.StructType, versions: Sequence[int] | None) -> DataFrame:
        """Parquet files under a root; with `versions` only their directories are listed."""
        paths = [root] if versions is None else [f"{root}/version_id={v}" for v in versions]
        paths = [p for p in paths if self._exists(p)]
        if not paths:
            return no_rows(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*schema.fieldNames())

    def read(self, table: str, versions: Sequence[int] | None = None, at: Snapshot | None = None) -> DataFrame:
        """The table with its fixed schema as the snapshot `at` (now) shows it; an empty frame before the first write.

        With `versions`, only their directories are listed and read.
        """
        schema, root = self._schema(table), self.path(table)
        if table in LOG_TABLES:
            rows = (at or self.snapshot()).visible(self._files(root, schema, versions))
            return rows.drop("batch_no", "day")
        if table in MERGED_TABLES:
            return self._merged(table, versions, at or self.snapshot())
        if table in STATE_LOGS:
            return self._state_log(table)
        rows = self._files(root, schema, None)
        return rows.where(F.col("version_id").isin(*versions)) if versions is not None and "version_id" in schema.fieldNames() else rows

    def tables(self, versions: Sequence[int] | None = None) -> Mapping[str, DataFrame]:
        """All tables as one snapshot shows them; take them again after a write."""
        at = self.snapshot()
        return LazyTables(schemas.TABLES, lambda name: self.read(name, versions, at))

    # --- log tables

    def append_log(self, rows: DataFrame, table: str, batch_id: str, number: int) -> None:
        """Add a batch's rows, and the keys that they are found by, under a number that is not committed yet."""
        time = LOG_TABLES[table]
        schema = self._schema(table)
        stamped = rows.withColumns(
            {"batch_id": F.lit(batch_id), "batch_no": F.lit(number).cast("long"), "day": F.to_date(time) if time else F.current_date()}
        )
        if VARIANT_COLUMN in schema.fieldNames():
            stamped = stamped.withColumn(VARIANT_COLUMN, payload_variant(F.col("payload")))
        self._append(stamped.select(*schema.fieldNames()), self.path(table), self._partitions(table))
        if table in INDEXED_TABLES:
            keys = rows.select(natural_key(table).alias("dedup_key"), F.lit(number).cast("long").alias("batch_no"), "version_id")
            keys = keys.where("dedup_key is not null").withColumn("split", self._split_of(F.col("dedup_key")))
            self._append(keys, self.path(f"keys/{table}"), ["version_id", "split"])

    def rows_of_write(self, table: str, number: int, versions: Sequence[int] | None) -> DataFrame:
        """What one write put into a log table, seen or not."""
        rows = self._files(self.path(table), self._schema(table), versions).where(F.col("batch_no") == number)
        return rows.select(*schemas.TABLES[table].fieldNames())

    def stored_keys(self, table: str, wanted: DataFrame, versions: Sequence[int] | None, at: Snapshot | None = None) -> DataFrame:
        """(version_id, dedup_key) of stored rows, from the index's splits that can hold a wanted key and no others."""
        splits = self._splits(wanted, self._split_of(F.col("dedup_key")))
        index = self._files(self.path(f"keys/{table}"), KEYS_SCHEMA, versions).where(F.col("split").isin(*splits) if splits else F.lit(False))
        return (at or self.snapshot()).visible(index).select("version_id", "dedup_key")

    def write_batch(self, rows: DataFrame, table: str, batch_id: str) -> DataFrame:
        """Write and commit one batch of a log table beside the imports; returns the stored rows."""
        with self.lock:
            number = self.begin(batch_id)
            self.append_log(rows, table, batch_id, number)
            self.commits.commit(number, {"load": table})
            return self.read(table).where(F.col("batch_id") == batch_id)

    # --- merged tables

    def _changes_path(self, table: str) -> str:
        return self.path(f"_changes/{table}")

    def _change_numbers(self, table: str) -> list[int]:
        return [int(n.partition("=")[2]) for n in HadoopPath(self.spark, self._changes_path(table)).names() if n.startswith("batch_no=")]

    def write_changes(self, rows: DataFrame, table: str, number: int) -> None:
        """Add changed and new rows of a merged table under a number that is not committed yet. Only these rows are
        written, into as few files as they fill."""
        # Split like the base by version, so that a pruned read prunes both.
        self._write(rows.select(*schemas.TABLES[table].fieldNames()), f"{self._changes_path(table)}/batch_no={number}", self._partitions(table)[:-1], "overwrite")

    def _changed(self, table: str, at: Snapshot) -> DataFrame | None:
        """All rows of visible changes with the number of their write; None without any."""
        root = self._changes_path(table)
        paths = [f"{root}/batch_no={n}" for n in self._change_numbers(table) if at.sees(n)]
        if not paths:
            return None
        schema = T.StructType([*schemas.TABLES[table].fields, T.StructField("batch_no", T.LongType())])
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def _newest(self, table: str, rows: DataFrame) -> DataFrame:
        """The row of the newest write of every key."""
        keys = MERGE_KEYS[table]
        rest = [c for c in schemas.TABLES[table].fieldNames() if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_no").alias("_row"))
        return newest.select(*keys, "_row.*").withColumn("bucket", self.bucket_of(table)).select(*self._schema(table).fieldNames())

    def changes(self, table: str, at: Snapshot, wanted: DataFrame | None = None) -> DataFrame | None:
        """The newest row of every key (of every one among `wanted`) that visible changes hold; None without any."""
        rows = self._changed(table, at)
        if rows is None:
            return None
        return self._newest(table, rows if wanted is None else touched(rows, wanted, MERGE_KEYS[table]))

    def _merged(self, table: str, versions: Sequence[int] | None, at: Snapshot, splits: Sequence[int] | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """Base rows that no change replaces, and the changes. The changes are few, since compaction bounds them, so Spark
        leaves the base where it is. With `wanted` only rows of its keys: base and changes are cut to them at once and the
        newest row of each is taken, so that neither the changes nor the wanted keys are computed twice."""
        base = self._files(self.path(table), self._schema(table), versions if table == "players" else None)
        changed = self._changed(table, at)
        scoped = lambda rows: rows if versions is None or table != "players" else rows.where(F.col("version_id").isin(*versions))
        held = lambda rows: rows if splits is None else rows.where(F.col("bucket").isin(*splits) if splits else F.lit(False))
        base, keys = held(base), MERGE_KEYS[table]
        if wanted is not None and changed is not None:
            every = base.drop("bucket").withColumn("batch_no", F.lit(-1).cast("long")).unionByName(scoped(changed))
            return self._newest(table, touched(every, wanted, keys))
        if wanted is not None:
            return touched(base, wanted, keys)
        if changed is None:
            return base
        fresh = held(scoped(self._newest(table, changed)))
        return base.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns).unionByName(fresh)

    def matching(self, table: str, keys: DataFrame, versions: Sequence[int] | None = None, at: Snapshot | None = None) -> DataFrame:
        """Rows of a merged table whose key is among `keys`, read from the buckets that can hold one."""
        splits = self._splits(keys, self.bucket_of(table))
        return self._merged(table, versions, at or self.snapshot(), splits, keys).drop("bucket")

    def in_buckets_of(self, table: str, keys: DataFrame, at: Snapshot | None = None) -> DataFrame:
        """The table cut down to the buckets that can hold the keys (only the bucket column is needed)."""
        return self._merged(table, None, at or self.snapshot(), self._splits(keys, self.bucket_of(table))).drop("bucket")

    def replace_buckets(self, rows: DataFrame, table: str) -> None:
        """Load whole buckets of a merged table, in place of what they held."""
        with self.lock:
            self.compact(table)
            self._swap(rows.withColumn("bucket", self.bucket_of(table)).select(*self._schema(table).fieldNames()), table)

    def compact(self, table: str) -> int:
        """Fold the visible changes of a merged table into the buckets that they touch, and rewrite no other; returns
        how many folders of changes went. A change that is read beside the bucket it was folded into changes nothing."""
        with self.lock:
            self.finish_swaps()
            at, numbers = self.snapshot(), self._change_numbers(table)
            fresh = self.changes(table, at)
            if fresh is not None:
                # Asked for once: the directories that the changes touch, by version (users have none).
                touched_in: dict[int | None, set[int]] = {}
                for place in fresh.select(*self._partitions(table)).distinct().collect():
                    touched_in.setdefault(place["version_id"] if table == "players" else None, set()).add(place["bucket"])
                versions = sorted(touched_in) if table == "players" else None
                hit = self._merged(table, versions, at, sorted(set().union(*touched_in.values())))
                if versions is not None:
                    alike: dict[frozenset[int], list[int]] = {}
                    for version, buckets in touched_in.items():
                        alike.setdefault(frozenset(buckets), []).append(version)
                    own = [F.col("version_id").isin(*v) & F.col("bucket").isin(*sorted(b)) for b, v in alike.items()]
                    hit = hit.where(reduce(Column.__or__, own)) if own else hit.where("false")
                self._swap(hit.select(*self._schema(table).fieldNames()), table)
            gone = [n for n in numbers if n <= at.last]
            for number in gone:
                HadoopPath(self.spark, f"{self._changes_path(table)}/batch_no={number}").delete()
            return len(gone)

    def compact_log(self, table: str, versions: Sequence[int], first_day: str, last_day: str) -> None:
        """Rewrite the days of a log table, typically past ones, into few files without rows that never committed."""
        with self.lock:
            self.finish_swaps()
            rows = self.snapshot().visible(self._files(self.path(table), self._schema(table), versions))
            self._swap(rows.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))), table)

    def tidy(self) -> None:
        """Keep reads short: fold changes and commit files when there are many."""
        for table in MERGED_TABLES:
            if len(self._change_numbers(table)) > MAX_CHANGES:
                self.compact(table)
        self.commits.fold()

    # --- swaps of whole directories

    def _swap(self, rows: DataFrame, table: str) -> None:
        """Replace the directories that `rows` fall into. The rows are staged whole and the swap is noted first, so one
        that was cut short is done again from the staged rows; until then a reader may miss the directory."""
        self.keep_layout()
        name = f"swap-{uuid.uuid4()}"
        self.stage(rows, table, name)
        HadoopPath(self.spark, f"{self.root}/_swaps/{name}").write_new(table)
        self.finish_swaps()

    def finish_swaps(self) -> None:
        for name in HadoopPath(self.spark, f"{self.root}/_swaps").names():
            if not name.startswith("swap-"):
                continue
            note = HadoopPath(self.spark, f"{self.root}/_swaps/{name}")
            table = note.read_text()
            rows = self.spark.read.schema(self._schema(table)).parquet(f"{self.root}/_staging/{name}/{table}")
            self._write(rows, self.path(table), self._partitions(table), "overwrite")
            note.delete()
            self.drop_stage(name)

    # --- small tables and state logs

    def append(self, rows: DataFrame, table: str) -> None:
        rows = rows.select(*schemas.TABLES[table].fieldNames())
        if table in STATE_LOGS:
            self._fold_state(table)
            rows.write.mode("append").parquet(f"{self.path(table)}/gen={self._generation(table):06d}")
        else:
            rows.write.mode("append").parquet(self.path(table))

    def _folded(self, table: str) -> int:
        """The last generation of a state log that is folded into its last-state table."""
        found = [int(n.partition("=")[2]) for n in HadoopPath(self.spark, self.path(f"_state/{table}")).names() if n.startswith("gen=")]
        return max((g for g in found if self._exists(self.path(f"_state/{table}/gen={g:06d}/_SUCCESS"))), default=0)

    def _generation(self, table: str) -> int:
        return self._folded(table) + 1

    def log_paths(self, table: str) -> list[str]:
        """What a state log is read from: its last-state table and the generation that is being written."""
        folded = self._folded(table)
        paths = [self.path(f"_state/{table}/gen={folded:06d}"), f"{self.path(table)}/gen={folded + 1:06d}"]
        return [p for p in paths if self._exists(p)]

    def _state_log(self, table: str) -> DataFrame:
        schema, paths = schemas.TABLES[table], self.log_paths(table)
        return self.spark.read.schema(schema).parquet(*paths) if paths else no_rows(self.spark, schema)

    def _fold_state(self, table: str) -> None:
        """When a generation has many files, the newest state of every job becomes the new last-state table; the
        generation's files stay as history and are not read again."""
        generation = self._generation(table)
        files = [n for n in HadoopPath(self.spark, f"{self.path(table)}/gen={generation:06d}").names() if n.endswith(".parquet")]
        if len(files) >= MAX_LOG_FILES:
            state = latest(self._state_log(table), STATE_LOGS[table]).select(*schemas.TABLES[table].fieldNames())
            state.hint("rebalance").sortWithinPartitions(STATE_LOGS[table]).write.mode("overwrite").parquet(self.path(f"_state/{table}/gen={generation:06d}"))
            if generation > 1:
                HadoopPath(self.spark, self.path(f"_state/{table}/gen={generation - 1:06d}")).delete()

    # --- staging and whole versions

    def stage(self, rows: DataFrame, name: str, attempt: str) -> DataFrame:
        """Materialise a frame for one attempt of a batch. Nothing of another attempt is reused, since the
        tables and the batch's rows may have changed in between."""
        path = f"{self.root}/_staging/{attempt}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop_stage(self, attempt: str) -> None:
        HadoopPath(self.spark, f"{self.root}/_staging/{attempt}").delete()

    def drop_version(self, table: str, version_id: int) -> None:
        """Remove one version's rows of a table, to rebuild them."""
        if table in MERGED_TABLES:
            self.compact(table)
        if "version_id" in self._partitions(table):
            for root in (self.path(table), self.path(f"keys/{table}"), self.path(f"_ranks/{table}")):
                HadoopPath(self.spark, f"{root}/version_id={version_id}").delete()
        else:
            self.keep_only(table, F.col("version_id") != version_id)

    def keep_only(self, table: str, condition: Column) -> None:
        """Remove the rows that fail the condition. Of a table with buckets only those that hold such a row are
        rewritten, a small dimension is rewritten whole."""
        keep = F.coalesce(condition, F.lit(True))
        name = f"keep-{uuid.uuid4()}"
        if table in MERGED_TABLES:
            self.compact(table)
            rows = self._files(self.path(table), self._schema(table), None)
            places = self._partitions(table)
            hit = rows.where(~keep).select(*places).distinct().collect()
            if not hit:
                return
            held = [c for c in places if c != "bucket"]
            kept = self.stage(rows.where(F.col("bucket").isin(*{r["bucket"] for r in hit}) & keep), table, name)
            left = {tuple(r) for r in kept.select(*places).distinct().collect()}
            self._swap(kept, table)
            for r in hit:
                if tuple(r) not in left:
                    folder = "/".join(f"{c}={r[c]}" for c in [*held, "bucket"])
                    HadoopPath(self.spark, f"{self.path(table)}/{folder}").delete()
        else:
            kept = self.stage(self.read(table).where(keep), table, name)
            kept.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path(table))
        self.drop_stage(name)

    def wipe_version(self, version_id: int, email_prefix: str | None = None) -> None:
        """Empty one version, children before parents; users only by an e-mail prefix, because
        versions share them. The version row itself stays."""
        with self.lock:
            for table in ("answers", "transactions", "rewards", "typed_skipped", "event_sketches", "events", "players"):
                self.drop_version(table, version_id)
            if email_prefix:
                self.keep_only("users", ~has_prefix(F.col("email"), email_prefix))
            for table in ("answer_options", "questions"):
                self.drop_version(table, version_id)

    # Rows of one directory meet in few tasks, so no task opens a file in every directory;
    # AQE splits a directory that is large and merges those that are small.

    def _append(self, rows: DataFrame, path: str, keys: list[str]) -> None:
        self._write(rows, path, keys, "append")

    def _write(self, rows: DataFrame, path: str, keys: list[str], mode: str) -> None:
        writer = rows.hint("rebalance", *keys).write.mode(mode)
        (writer.partitionBy(*keys) if keys else writer).option("partitionOverwriteMode", "dynamic").parquet(path)


class LazyTables(Mapping):
    """Tables by name, each opened once and only when used."""

    def __init__(self, names: Iterable[str], open_table: Callable[[str], DataFrame]):
        self._names, self._open = tuple(names), open_table
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)
