"""Epoch tables in Parquet beside a log of versions: writing whole epochs, reading complete ones while others are written."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.operators.recovery import KEY
from tallybook.sources.schemas import EPOCH_TABLES

#: Tables that may stay empty for a whole commit.
MAY_BE_EMPTY = ("raw_epochs_bad", "handoffs")
#: Tables whose latest row per key is kept as well: table -> (key, order).
LATEST = {"source_tips": ("source_id", "last_seq"), "epoch_chain": ("aggregator_id", "sequence")}
MARKERS = "epoch_done"
#: Folders of one level that are merged into one of the next, and bytes beyond which a folder is merged no more.
FAN_IN, MERGED_BYTES = 8, 256 << 20
#: Bytes of a file that merging writes, about.
FILE_BYTES = 128 << 20
#: Tasks over the keys of a commit's epochs.
KEY_TASKS = 8
#: How long folders and versions that nothing refers to any more stay for readers that have begun with them.
GRACE_MS = 600_000


def _state(table: str) -> str:
    return f"{table}_now"


#: Tables of few rows, without folders by type and aggregator.
UNPARTITIONED = (*MAY_BE_EMPTY, *map(_state, LATEST))


class EpochStore:
    """Tables below one folder; an epoch counts once its completion marker is written, which comes last.

    Each commit is an attempt with a name of its own: its rows go to folders of their own, and its markers make the next
    version of the log, one small file that names all folders that count, with schemas. Readers take the newest version
    and read just what it names, so they never look at what is being written or was left by attempts that failed, which
    `sweep` deletes. One process writes a store; any number may read it meanwhile.

    Small folders are merged level by level (`compact`), so that a version names some FAN_IN folders a level and table
    however many commits there were. Where a table is asked for its latest row per key (`latest`), merging keeps just
    that row: reading how things stand costs what there is of keys, not of history.
    """

    def __init__(self, spark: SparkSession, path: str, grace_ms: int = GRACE_MS):
        self.spark, self.path, self.grace_ms = spark, path.rstrip("/"), grace_ms
        self._schemas: dict[str, str] = {}  # of what this process has written and not yet marked
        self._own: tuple[str, int] | None = None  # the attempt whose epochs are known to be new, and the last of them

    # --- files ------------------------------------------------------------------------------------------------------
    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _folder(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, name: str) -> list[tuple[str, int]]:
        """(name, time of change) of what is in a folder; none if it isn't there."""
        files, at = self._folder(name)
        if not files.exists(at):
            return []
        return [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(at)]

    def _bytes(self, name: str) -> int | None:
        files, at = self._folder(name)
        return files.getContentSummary(at).getLength() if files.exists(at) else None

    # --- versions ---------------------------------------------------------------------------------------------------
    def version(self) -> dict:
        """The newest version of the log: {"n", "tables": {name: {"schema", "folders"}}, "gone": [[folder, since when]]}."""
        for _ in range(100):
            names = sorted(n for n, _ in self._listed("_log") if n.startswith("v") and n.endswith(".json"))
            if not names:
                return {"n": 0, "tables": {}, "gone": []}
            files, at = self._folder(f"_log/{names[-1]}")
            try:
                stream = files.open(at)
            except Exception as e:  # deleted since it was listed: there is a newer one
                if "FileNotFound" not in str(e):
                    raise
                continue
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        raise OSError(f"no version of {self.path} stays long enough to be read")

    def _publish(self, version: dict) -> None:
        """Writes the next version: whole, under another name first, so that readers see it whole or not at all."""
        n, now = version["n"] + 1, int(time.time() * 1000)
        gone = [g for g in version["gone"] if now - g[1] < self.grace_ms or self._bytes(g[0]) is not None]
        name = f"_log/v{n:012d}.json"
        files, at = self._folder(name)
        if files.exists(at):
            raise OSError(f"{name} is there already: another process writes this store")
        _, part = self._folder(f"_log/_{uuid.uuid4().hex}")
        out = files.create(part)
        out.write(bytearray(json.dumps(version | {"n": n, "gone": gone}).encode()))
        out.close()
        if not files.rename(part, at):
            raise OSError(f"{name} can't be written")

    def _rows(self, table: str, folders: list[dict], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not folders:
            return self.spark.createDataFrame([], kind)
        # what is in the path is a column, under the type that was written
        return self.spark.read.schema(kind).option("basePath", self._at(table)).parquet(*(self._at(f["path"]) for f in folders)).select(kind.names)

    def _marked(self, table: str, version: dict | None = None, since: int | None = None) -> DataFrame:
        held = (version or self.version())["tables"].get(table)
        if held is None:
            raise ValueError(f"{table}: nothing is marked in {self.path}")
        return self._rows(table, [f for f in held["folders"] if since is None or f["hi"] is None or f["hi"] >= since], held["schema"])

    # --- reading ----------------------------------------------------------------------------------------------------
    def exists(self, table: str) -> bool:
        """Whether a marked attempt has written the table, be it without rows."""
        return table in self.version()["tables"]

    def all_rows(self, table: str) -> DataFrame:
        """Rows of marked attempts and of others that lie there: for the writer and for audits, not beside a writer."""
        version = self.version()
        held = version["tables"].get(table, {"folders": [], "schema": self._schemas.get(table)})
        known = {f["path"] for f in held["folders"]} | {g[0] for g in version["gone"]}
        others = [{"path": f"{table}/{n}"} for n, _ in self._listed(table) if n.startswith("attempt=") and f"{table}/{n}" not in known]
        if held["schema"] is None:
            return self.spark.read.parquet(self._at(table))
        return self._rows(table, [*held["folders"], *others], held["schema"])

    def done(self, since: int | None = None) -> DataFrame:
        """One marker for each complete epoch: KEY, attempt, completed_at_ms. Of several attempts that were marked the first counts.

        since: epochs from this sequence on are enough, so that folders of older ones aren't read.
        """
        version = self.version()
        rows = self._marked(MARKERS, version, since)
        if not any(f["unsure"] for f in version["tables"][MARKERS]["folders"]):
            return rows
        first = F.min_by(F.struct("attempt", "completed_at_ms"), F.struct("completed_at_ms", "attempt"))
        return rows.groupBy(*KEY).agg(first.alias("m")).select(*KEY, "m.*")

    def read(self, table: str, epoch_type: str | None = None) -> DataFrame:
        """Rows of complete epochs (of one type, so that other folders aren't read); tables that aren't by epoch type as they are."""
        version = self.version()
        rows = self._marked(table, version)
        if table == MARKERS or not set(KEY) <= set(rows.columns):
            return rows
        rows = rows if epoch_type is None else rows.where(F.col("epoch_type") == epoch_type)
        # an epoch that two attempts were marked for is read from one of them
        if any(f["unsure"] for f in version["tables"][table]["folders"]):
            rows = rows.join(self.done().select(*KEY, "attempt"), [*KEY, "attempt"], "left_semi")
        return rows.drop("attempt")

    def latest(self, table: str) -> DataFrame:
        """The latest row per key of a table of LATEST, as of now; null-free keys, no history read."""
        return _last(self._marked(_state(table)).drop("attempt"), table)

    def views(self, prefix: str = "") -> list[str]:
        """Registers the tables that are there as temporary views, for SQL; prefix: before their names, to keep them apart from a session's own."""
        version = self.version()
        found = [t for t in EPOCH_TABLES if t in version["tables"]]
        for t in found:
            self.read(t).createOrReplaceTempView(f"{prefix}{t}")
        return found

    # --- writing ----------------------------------------------------------------------------------------------------
    def append(self, table: str, rows: DataFrame, partitioned: bool = True) -> None:
        """Adds rows: of epochs, which count once their attempt is marked; markers; or of a table that isn't by epoch, which count at once."""
        if table == MARKERS:
            self._mark(rows)
            return
        by_epoch = set(KEY) <= set(rows.columns)
        if "attempt" not in rows.columns:
            rows = rows.withColumn("attempt", F.lit("none" if by_epoch else f"a{uuid.uuid4().hex}"))
        parts = [c for c in ("attempt", *(("epoch_type", "aggregator_id") if partitioned else ())) if c in rows.columns]
        self._schemas[table] = rows.schema.json()
        if by_epoch:
            rows.write.mode("append").partitionBy(*parts).parquet(self._at(table))
            return
        name = f"{table}/attempt=a{uuid.uuid4().hex}"
        rows.drop("attempt").write.parquet(self._at(name))
        version = self.version()
        self._registered(version, table, name)
        self._publish(version)

    def _registered(self, version: dict, table: str, name: str, level: int = 0, unsure: bool = False, hi: int | None = None) -> None:
        held = version["tables"].setdefault(table, {"folders": []})
        held["schema"] = self._schemas.get(table) or held.get("schema") or self.spark.read.option("basePath", self._at(table)).parquet(self._at(name)).schema.json()
        size = self._bytes(name)
        if size is not None:  # an attempt without rows has no folder
            held["folders"].append({"path": name, "level": level, "bytes": size, "unsure": unsure, "hi": hi})

    def _mark(self, rows: DataFrame) -> None:
        """The next version, with markers(KEY, attempt, completed_at_ms) and all folders of their attempts."""
        rows = rows.select("epoch_type", F.col("aggregator_id").cast("long").alias("aggregator_id"), F.col("sequence").cast("long").alias("sequence"), "attempt", F.col("completed_at_ms").cast("long").alias("completed_at_ms"))
        version, again = self.version(), False
        if self._own:
            (attempt, hi), self._own = self._own, None
            attempts = [attempt]
        else:
            facts = rows.agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.collect_set("attempt").alias("attempts")).first()
            attempts, hi = facts["attempts"], facts["hi"]
            if not attempts:
                return
            again = MARKERS in version["tables"] and not rows.join(self.done(facts["lo"]).select(*KEY), KEY, "left_semi").isEmpty()
        name = f"{MARKERS}/c{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(self._at(name))  # one small row for each epoch of a commit
        self._schemas[MARKERS] = rows.schema.json()
        for table in sorted({*_names(version), *self._schemas} - {MARKERS}):
            for attempt in attempts:
                at = f"{table}/attempt={attempt}"
                if table in self._schemas or self._bytes(at) is not None:
                    self._registered(version, table, at, unsure=again, hi=hi)
        self._registered(version, MARKERS, name, unsure=again, hi=hi)
        self._publish(version)
        self._schemas.clear()

    def commit(self, epoch_type: str, tables: dict[str, DataFrame], completed_at_ms: int | None = None) -> None:
        """Writes an epoch type's bodies, then its header, then the markers; epochs already marked, and rows of epochs without header, are left out."""
        attempt = f"a{uuid.uuid4().hex}"
        self._schemas.clear()  # of attempts that failed
        self._own = None
        typed = {n: t.withColumn("epoch_type", F.lit(epoch_type)) if "epoch_type" not in t.columns else t for n, t in tables.items()}
        typed["epoch_header"] = typed["epoch_header"].persist()  # one row an epoch, asked for twice
        head = typed["epoch_header"]
        keys = head.select("epoch_type", F.col("aggregator_id").cast("long").alias("aggregator_id"), F.col("sequence").cast("long").alias("sequence"))
        epochs = keys.distinct().coalesce(KEY_TASKS).persist()  # each table is joined with them
        new = epochs
        try:
            lo, hi = epochs.agg(F.min("sequence"), F.max("sequence")).first()
            if lo is not None and self.exists(MARKERS):
                new = epochs.join(self.done(lo).select(*KEY), KEY, "left_anti").persist()
                hi = new.agg(F.max("sequence")).first()[0]
            if hi is None:
                return  # no new epoch
            typed = {n: t.join(new, KEY, "left_semi") for n, t in typed.items()}
            typed |= {_state(n): _last(typed[n], n) for n in LATEST if n in typed}
            for name in sorted(typed, key=lambda n: n == "epoch_header"):
                self.append(name, typed[name].withColumn("attempt", F.lit(attempt)), partitioned=name not in UNPARTITIONED)
            now = F.lit(completed_at_ms) if completed_at_ms is not None else F.unix_millis(F.current_timestamp())
            self._own = attempt, hi
            self.append(MARKERS, new.withColumn("attempt", F.lit(attempt)).withColumn("completed_at_ms", now.cast("long")), partitioned=False)
        finally:
            for held in (new, epochs, head):
                held.unpersist()

    def compact(self) -> int:
        """Merges folders of one level where there are FAN_IN of them, and says how many; the state of LATEST by keeping the latest rows."""
        version, merged, now = self.version(), 0, int(time.time() * 1000)
        for table, held in version["tables"].items():
            levels: dict[int, list[dict]] = {}
            for f in held["folders"]:
                if not f["unsure"] and f["bytes"] <= MERGED_BYTES:
                    levels.setdefault(f["level"], []).append(f)
            for level, folders in sorted(levels.items()):
                if len(folders) < FAN_IN:
                    continue
                rows = self._rows(table, folders, held["schema"])
                name = f"{table}/c{uuid.uuid4().hex}" if table == MARKERS else f"{table}/attempt=m{uuid.uuid4().hex}"
                kept = rows if table == MARKERS else rows.drop("attempt")
                of = next((t for t in LATEST if _state(t) == table), None)
                if of:
                    kept = _last(kept, of)
                parts = [] if table in (MARKERS, *UNPARTITIONED) or not set(KEY) <= set(kept.columns) else ["epoch_type", "aggregator_id"]
                if parts:
                    kept.repartition(*parts).write.partitionBy(*parts).parquet(self._at(name))
                else:
                    kept.coalesce(1 + sum(f["bytes"] for f in folders) // FILE_BYTES).write.parquet(self._at(name))
                hi = max((f["hi"] for f in folders if f["hi"] is not None), default=None)
                paths = {f["path"] for f in folders}
                held["folders"] = [f for f in held["folders"] if f["path"] not in paths]
                self._registered(version, table, name, level + 1, hi=hi)
                version["gone"] += [[p, now] for p in sorted(paths)]
                merged += len(folders)
        if merged:
            self._publish(version)
        return merged

    def sweep(self) -> int:
        """Deletes what attempts without any marker wrote, and says how many folders; for use before writing, by the one writer.

        Merged and retired folders, and versions of the log, go once no reader can still be at them.
        """
        version, now = self.version(), int(time.time() * 1000)
        known = {f["path"] for held in version["tables"].values() for f in held["folders"]} | {g[0] for g in version["gone"]}
        for path, since in version["gone"]:
            if now - since >= self.grace_ms:
                self._delete(path)
        names = sorted(self._listed("_log"))
        for name, changed in names[:-1]:
            if now - changed >= self.grace_ms:
                self._delete(f"_log/{name}")
        left = [f"{t}/{n}" for t in _names(version) for n, _ in self._listed(t) if n.startswith("c" if t == MARKERS else "attempt=") and f"{t}/{n}" not in known]
        for path in left:
            self._delete(path)
        return len(left)

    def _delete(self, name: str) -> None:
        files, at = self._folder(name)
        files.delete(at, True)

    def retire(self, table: str, epochs: DataFrame) -> int:
        """Takes the folders of a table out all of whose epochs are among epochs(aggregator_id, sequence), as recovery.droppable names them, and says how many."""
        version = self.version()
        held = version["tables"].get(table)
        if held is None or not held["folders"]:
            return 0
        there = self._rows(table, held["folders"], held["schema"]).select("attempt", "aggregator_id", "sequence").distinct()
        rest = there.join(epochs.select("aggregator_id", "sequence"), ["aggregator_id", "sequence"], "left_anti").select("attempt")
        # as many names as folders, which merging keeps few
        out = {f"{table}/attempt={r['attempt']}" for r in there.select("attempt").distinct().join(rest, "attempt", "left_anti").collect()}
        held["folders"] = [f for f in held["folders"] if f["path"] not in out]
        version["gone"] += [[p, int(time.time() * 1000)] for p in sorted(out)]
        if out:
            self._publish(version)
        return len(out)

    def publish_checkpoints(self, rows: DataFrame) -> None:
        """Appends checkpoints whose leaf isn't there yet."""
        if self.exists("checkpoints"):
            rows = rows.join(self._marked("checkpoints").select("leaf_hash"), "leaf_hash", "left_anti").select(*rows.columns)
        self.append("checkpoints", rows)


def _names(version: dict) -> list[str]:
    """The tables that a store may hold."""
    return sorted({*EPOCH_TABLES, *MAY_BE_EMPTY, *map(_state, LATEST), *version["tables"]})


def _last(rows: DataFrame, table: str) -> DataFrame:
    """The latest row per key of a table of LATEST, combined before the shuffle."""
    by, order = LATEST[table]
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("last")).select(by, "last.*").select(rows.columns)
