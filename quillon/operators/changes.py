"""Applying a feed of inserts, updates and deletes: a log-structured merge of change records.

Every delivered batch of records is folded to one record per key and stored as a run: a Parquet folder that is
bucketed by id and sorted by key and sequence. Reading merges the runs bucket by bucket, the highest sequence of a key
first, and drops tombstones; as all runs share the bucketing, the merge needs no shuffle, however many runs there
are. Runs have levels: where a level has too many of them, they are merged into one of the next level, so a record is
written again as often as there are levels, not as often as there are appends.

The state of a store is a manifest, a file for each version. Writers publish the next version and try again if another
was faster. A frame, once made, names the files it reads: later appends and merges don't change it, as files
that were replaced stay for ``retention`` seconds. Beyond that it fails as a file is missing; it never reads less.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.errors import Busy, Corrupted
from quillon.plans.workspace import estimated_bytes, filesystem, remove, scratch_path

KEY = ("tbl", "external")
#: Runs are bucketed by the id alone, so that a lookup of one id reads one bucket.
BUCKET, ORDER = "external", ("external", "tbl", "seq")
#: Bytes of input that one bucket is made for.
BUCKET_BYTES, BUCKETS, MAX_BUCKETS = 64 << 20, 4, 4096
_TRIES, _LISTINGS = 200, 6
# The id of the write in the name of a file that Spark made.
_WRITE = re.compile(r"part-\d+-([0-9a-f-]{36})")
_EDGE_SPACE = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
_NO_SEQ = -(2**63)


def trimmed_id(value: Column) -> Column:
    """An id without surrounding Unicode white space, otherwise unchanged."""
    return F.regexp_replace(value, _EDGE_SPACE, "")


def is_declaration(declared: Column) -> Column:
    return F.coalesce(F.size(declared) > 0, F.lit(False))


def document_changes(feed: DataFrame) -> DataFrame:
    """The records of a feed that change a document, cleaned.

    Declarations (a non-empty ``declared``) change none. ``external`` loses surrounding white space; a null or
    blank id names no document, so such a record changes nothing. A null ``deleted`` is false. A record without
    ``seq`` has no place in the log and counts as earlier than all others.
    """
    return (
        feed.where(~is_declaration(F.col("declared")))
        .select(
            "tbl",
            trimmed_id(F.col("external")).alias("external"),
            F.coalesce(F.col("seq"), F.lit(_NO_SEQ)).alias("seq"),
            F.coalesce(F.col("deleted"), F.lit(False)).alias("deleted"),
            F.col("doc_fields"),
            F.col("received_at"),
        )
        .where(F.coalesce(F.col("external") != "", F.lit(False)) & F.col("tbl").isNotNull())
    )


def _newest(columns: list[str]) -> Column:
    """The record of the highest ``seq``; among records of one ``seq``, which are one change, a deletion first."""
    return F.max_by(F.struct(*columns), F.struct("seq", "deleted", F.size("doc_fields"), F.xxhash64(F.map_entries("doc_fields"))))


def buckets_for(size: int | None, least: int = BUCKETS) -> int:
    """Buckets for records of so many bytes, ``least`` where the size is not known."""
    return max(least, min(MAX_BUCKETS, -(-(size or 0) // BUCKET_BYTES)))


@dataclass
class ChangeStore:
    """A log-structured store of change records at ``path``.

    A bucket is what one task merges. New runs get ``buckets`` of them, a number that the first append and each full
    compaction make fit the size; runs of different numbers are merged with a shuffle. A hot key is no hot bucket: a
    run holds one record per key, folded before the shuffle.
    """

    spark: SparkSession
    path: str
    buckets: int

    #: A level with more runs is merged into one run of the next level.
    fan_in: int = 16
    #: Seconds that replaced runs and former manifests stay, for frames that read them.
    retention: float = 3600.0
    #: Seconds that a write may take, from its numbers to its version.
    patience: float = 86_400.0

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None, meta: dict | None = None) -> ChangeStore:
        """The store at ``path``, made with ``meta`` if there is none."""
        store = cls(spark, path, buckets or BUCKETS)
        if store._latest() is None:
            store._publish({"version": 0, "buckets": store.buckets, "next_seq": 1, "runs": {}, "retired": {}, "meta": meta or {}})
        store.buckets = store.state()["buckets"]
        return store

    # --- writing ---

    def append(
        self,
        feed: DataFrame,
        run: Column | None = None,
        observed: dict[str, Column] | None = None,
        check: Callable[[dict], None] | None = None,
        meta: Callable[[dict, dict], dict] | None = None,
        only_if: Callable[[dict], None] | None = None,
    ) -> ChangeStore:
        """Adds records as one run, or as one run per value of ``run`` (a string, such as the day of arrival).

        Repeated and late records are allowed, in the same run or a later one. A run becomes visible when a
        manifest names it; files of an append that failed are never read. ``check`` gets the values of the aggregates
        ``observed`` over the feed and may refuse it by an error; ``meta`` gives the store's metadata in the same
        version, from those before and what was observed; ``only_if`` may refuse the state that the version is made from.
        """
        label = uuid.uuid4().hex[:12]
        data = f"{self.path}/data-{label}"
        now = self.state()
        self.buckets = now["buckets"] if now["runs"] else buckets_for(estimated_bytes(feed), now["buckets"])
        counted = Observation()
        aggregates = {"records": F.count(F.lit(1)), "low": F.min("seq"), "high": F.max("seq")} | (observed or {})
        seen = feed.observe(counted, *(a.alias(n) for n, a in aggregates.items()))
        named = F.concat_ws("-", F.lit(label), run if run is not None else F.lit("0"))
        self._write(self._fold(document_changes(seen).withColumn("run", named), ["run"]), data)
        facts = counted.get
        try:
            if check is not None:
                check(facts)
            names = self._runs_in(data)
            new = {n: r | {"level": 0, "records": 0 if k else facts["records"], "low": facts["low"], "high": facts["high"]} for k, (n, r) in enumerate(names.items())}

            def add(state: dict) -> dict:
                if only_if is not None:
                    only_if(state)
                more = meta(state["meta"], facts) if meta is not None else state["meta"]
                return state | {"runs": state["runs"] | new, "meta": more, "buckets": state["buckets"] if state["runs"] else self.buckets}

            self.commit(add)
        except Exception:
            remove(self.spark, data)
            raise
        self._settle()
        return self

    def reserve(self, n: int) -> int:
        """The first of ``n`` sequence numbers that no other writer gets; those that are not used stay gaps.

        They are to be published within ``patience`` seconds: ``horizon`` relies on it.
        """

        def give(state: dict) -> dict:
            now, marks = time.time(), state.get("marks", [])
            if not marks or now - marks[-1][0] > self.patience / 4:
                marks = [*marks[-7:], [now, state["next_seq"]]]
            return state | {"next_seq": state["next_seq"] + n, "marks": marks}

        return self.commit(give)["next_seq"] - n

    def horizon(self) -> int:
        """A number below which all reserved ones were given out ``patience`` seconds ago or more, so none is still to come."""
        before = time.time() - self.patience
        return max((seq for at, seq in self.state().get("marks", []) if at <= before), default=0)

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Publishes ``change(state)`` as the next version; from the newest state, as often as other writers were faster."""
        for attempt in range(_TRIES):
            state = self.state()
            changed = change(state)
            if changed == state:
                return state
            changed["version"] = state["version"] + 1
            if self._publish(changed):
                return changed
            time.sleep(min(0.5, 0.01 * attempt))
        raise Busy(f"other writers of {self.path} were faster {_TRIES} times")

    def compact(self, forget_before: int | None = None) -> ChangeStore:
        """Merges all runs into one.

        Tombstones stay, as a late record with a lower ``seq`` must not revive its document;
        ``forget_before`` names a ``seq`` below which none can still arrive, so their tombstones can go.
        """
        runs = self.state()["runs"]
        if runs:
            fs = filesystem(self.spark, self.path)[0]
            size = sum(fs.getContentSummary(filesystem(self.spark, r["place"])[1]).getLength() for r in runs.values())
            self._merge(list(runs), max(r["level"] for r in runs.values()) + 1, forget_before, buckets_for(size, self.buckets))
        return self

    def vacuum(self, retention: float | None = None) -> ChangeStore:
        """Removes runs that were replaced and manifests older than ``retention`` seconds, and what failed writes left.

        Files that no manifest names may be those of a write under way, so they stay for ``patience`` seconds, or for
        ``retention`` where it is given.
        """
        before = time.time() - (self.retention if retention is None else retention)
        abandoned = time.time() - (self.patience if retention is None else retention)
        gone = {p for p, at in self.state()["retired"].items() if at <= before}
        if gone:
            self.commit(lambda state: state | {"retired": {p: at for p, at in state["retired"].items() if p not in gone}})
        state = self.state()
        for place in gone:
            remove(self.spark, place)
        emptied = {p.rpartition("/")[0] for p in gone}
        kept = {p.rpartition("/")[0] for p in (*(r["place"] for r in state["runs"].values()), *state["retired"])}
        fs, root = filesystem(self.spark, self.path)
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("data-") and f"{self.path}/{name}" not in kept and (s.getModificationTime() / 1000 <= abandoned or f"{self.path}/{name}" in emptied):
                fs.delete(s.getPath(), True)
        for s in fs.listStatus(filesystem(self.spark, f"{self.path}/manifest")[1]):
            if s.getPath().getName() != _file_of(state["version"]) and s.getModificationTime() / 1000 <= before:
                fs.delete(s.getPath(), False)
        return self

    def _settle(self) -> None:
        """Merges levels that have too many runs."""
        while True:
            levels: dict[int, list[str]] = {}
            for name, r in self.state()["runs"].items():
                levels.setdefault(r["level"], []).append(name)
            crowded = [k for k, names in sorted(levels.items()) if len(names) > self.fan_in]
            if not crowded or not self._merge(levels[crowded[0]], crowded[0] + 1):
                return

    def _merge(self, names: list[str], level: int, forget_before: int | None = None, buckets: int | None = None) -> bool:
        """Replaces runs by one of ``level``; False if another writer replaced some of them meanwhile."""
        self.buckets = buckets or self.state()["buckets"]
        old = {n: r for n, r in self.state()["runs"].items() if n in names}
        label = uuid.uuid4().hex[:12]
        data, run = f"{self.path}/data-{label}", f"{label}-level{level}"
        merged = self._fold(self._records(old), [])
        if forget_before is not None:
            merged = merged.where(~(F.col("deleted") & (F.col("seq") < forget_before)))
        counted = Observation()
        self._write(merged.withColumn("run", F.lit(run)).observe(counted, F.count(F.lit(1)).alias("records"), F.min("seq").alias("low"), F.max("seq").alias("high")), data)
        new = {n: r | counted.get | {"level": level} for n, r in self._runs_in(data).items()}

        def replace(state: dict) -> dict:
            if not old.keys() <= state["runs"].keys():
                return state
            now = time.time()
            return state | {"buckets": self.buckets, "runs": {n: r for n, r in state["runs"].items() if n not in old} | new, "retired": state["retired"] | {r["place"]: now for r in old.values()}}

        if not (new.keys() <= self.commit(replace)["runs"].keys()):
            remove(self.spark, data)
            return False
        self.vacuum()
        return True

    # --- reading ---

    def live(self) -> DataFrame:
        """One row per live document: ``tbl, external, seq, doc_fields``; no rows for an empty store."""
        return _shown(self.newest().where(~F.col("deleted"))).drop("deleted")

    def newest(self, since: int | None = None) -> DataFrame:
        """The newest record of each key, tombstones too; with ``since`` only of keys with records from this ``seq`` on."""
        runs = self.state()["runs"]
        if since is not None:
            runs = {n: r for n, r in runs.items() if r["high"] is not None and r["high"] >= since}
        records = self._records(runs)
        return self._fold(records if since is None else records.where(F.col("seq") >= since), [])

    def records(self) -> int:
        return sum(r["records"] for r in self.state()["runs"].values())

    def stats(self) -> dict:
        return self.state()

    def state(self) -> dict:
        """The manifest of the highest version: a complete file by the step that published it."""
        while True:
            latest = self._latest()
            if latest is None:
                raise Corrupted(f"{self.path} has no manifest")
            fs, path = filesystem(self.spark, f"{self.path}/manifest/{latest}")
            try:
                stream = fs.open(path)
            except Exception as e:  # removed as a newer one is there
                if self._latest() == latest:
                    raise Corrupted(f"the manifest {latest} of {self.path} can't be opened: {e}") from e
                continue
            try:
                return json.loads(bytes(stream.readAllBytes()))
            except Exception as e:
                raise Corrupted(f"the manifest {latest} of {self.path} can't be read: {e}") from e
            finally:
                stream.close()

    def _fold(self, changes: DataFrame, more_keys: list[str]) -> DataFrame:
        keys = [*more_keys, *KEY]
        return changes.groupBy(*keys).agg(_newest(["seq", "deleted", "doc_fields"]).alias("r")).select(*keys, "r.seq", "r.deleted", "r.doc_fields")

    def _write(self, records: DataFrame, data: str) -> None:
        name = f"quillon_run_{uuid.uuid4().hex}"
        try:
            (
                records.select(*KEY, "seq", "deleted", "doc_fields", "run")
                .repartition(self.buckets, BUCKET)
                .write.partitionBy("run")
                .bucketBy(self.buckets, BUCKET)
                .sortBy(*ORDER)
                .option("path", data)
                .saveAsTable(name)
            )
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _records(self, runs: dict[str, dict]) -> DataFrame:
        """The records of runs. Those of one number of buckets are one bucketed scan: grouping them by key needs no shuffle."""
        by_buckets: dict[int, list[dict]] = {}
        for r in runs.values():
            by_buckets.setdefault(r["buckets"], []).append(r)
        frames = [self._scan(buckets, some) for buckets, some in sorted(by_buckets.items())]
        return reduce(DataFrame.unionByName, frames) if frames else self._empty()

    def _scan(self, buckets: int, runs: list[dict]) -> DataFrame:
        """Runs as one frame that names their files, each known by the write that its name bears.

        The catalog entry lives just long enough to say how the files are bucketed. (A union of a scan for each run
        would not do: Spark 4.1 takes the union of bucketed columnar scans for partitioned, but doesn't align them.)
        """
        writes = ",".join(sorted({r["write"] for r in runs}))
        frame = self._listed(
            "(tbl STRING, external STRING, seq BIGINT, deleted BOOLEAN, doc_fields MAP<STRING, STRING>) "
            f"USING parquet OPTIONS (recursiveFileLookup 'true', pathGlobFilter '*-{{{writes}}}_*') "
            f"CLUSTERED BY ({BUCKET}) SORTED BY ({', '.join(ORDER)}) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        files, wanted = len(frame.inputFiles()), sum(r["files"] for r in runs)
        if files != wanted:
            raise Corrupted(f"{self.path} has {files} of {wanted} files that its manifest names")
        return frame

    def _listed(self, definition: str) -> DataFrame:
        """The frame of a table; its files are listed now. That fails where another writer just removed a folder that no
        manifest names, as of a write that was refused, and is tried again."""
        name = f"quillon_log_{uuid.uuid4().hex}"
        for attempt in range(_LISTINGS):
            try:
                self.spark.sql(f"CREATE TABLE {name} {definition}")
                return self.spark.table(name)
            except Exception:
                if attempt == _LISTINGS - 1:
                    raise
                time.sleep(0.05 * (attempt + 1))
            finally:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise AssertionError

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "tbl STRING, external STRING, seq BIGINT, deleted BOOLEAN, doc_fields MAP<STRING, STRING>")

    def _runs_in(self, data: str) -> dict[str, dict]:
        """The runs that a write left in a folder: their places, files, and the id of the write; none for a write without records."""
        fs, path = filesystem(self.spark, data)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        runs = {}
        for name in sorted(n for n in names if n.startswith("run=")):
            files = [f for s in fs.listStatus(filesystem(self.spark, f"{data}/{name}")[1]) if (f := s.getPath().getName()).endswith(".parquet")]
            runs[name.removeprefix("run=")] = {"place": f"{data}/{name}", "files": len(files), "write": _WRITE.search(files[0])[1], "buckets": self.buckets}
        return runs

    def _latest(self) -> str | None:
        fs, path = filesystem(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((n for n in names if n.startswith("v")), default=None)

    def _publish(self, state: dict) -> bool:
        """Puts a version in place in one step that fails if it is there already; whether it did."""
        return publish(self.spark, f"{self.path}/manifest", _file_of(state["version"]), json.dumps(state))


def _file_of(version: int) -> str:
    return f"v{version:012d}"


def publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Makes the file ``name`` with ``text``, whole and only if there is none: by a hard link on a local file system, by
    a rename elsewhere (one that refuses an existing target, as that of HDFS does)."""
    fs, draft = filesystem(spark, f"{folder}/draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    final = filesystem(spark, f"{folder}/{name}")[1]
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        return not fs.exists(final) and fs.rename(draft, final)
    except FileExistsError:
        return False
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)


def _shown(records: DataFrame) -> DataFrame:
    seq = F.when(F.col("seq") != _NO_SEQ, F.col("seq"))
    return records.select("tbl", "external", seq.alias("seq"), "deleted", "doc_fields")


def current_documents(feed: DataFrame, path: str | None = None, run: Column | None = None) -> DataFrame:
    """The live documents that a whole feed leaves: ``tbl, external, seq, doc_fields``.

    The feed is stored as runs under ``path`` (default: a fresh folder in the shared workspace), by default one for
    each day of the week that records arrived on, and merged on read. Extra columns are ignored, an empty feed leaves
    no documents.
    """
    spark = feed.sparkSession
    arrival = run if run is not None else F.coalesce(F.dayofweek("received_at").cast("string"), F.lit("undated"))
    return ChangeStore.open(spark, path or scratch_path(spark, "changes"), spark.sparkContext.defaultParallelism).append(feed, arrival).live()
