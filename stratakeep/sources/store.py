"""A keyed store: Parquet versions of a change log and a manifest file for each.

A version is a directory of Parquet files that becomes part of the log when its manifest appears,
whole and under a number that nobody has taken. Files without a manifest do not exist for readers,
so a torn write needs no repair. Every version is atomic: its entries carry no transaction markers.
A compaction publishes a *base* version that replaces all earlier ones; reading starts at the newest.

Each row has a checksum and each manifest the number of rows and the XOR of their checksums. A base's
manifest also remembers the batches that have been written, so that they stay known after a vacuum.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Closed, CommitUncertain, ConditionFailed, Corrupt, InvalidCondition, KeyExists, StoreError, VersionConflict, VersionNotFound
from ..functions import expires_at, pack_position
from ..operators import digest as digests
from ..operators.query import Indexes, Result, for_each, get_value, multi_get
from ..operators.transaction import Transaction
from ..plans.changelog import COLUMNS, DELETE, PUT, entry_at, log_schema, segment, violations
from ..plans.links import broken_links, link_duplicates
from ..plans.replay import compacted, latest, latest_over, reclaim, settled
from .files import Files, WriterLock


class Store:
    """Opened by :meth:`open`; also a context manager."""

    def __init__(self, spark: SparkSession, files: Files, value: T.DataType, dedup: bool, clock: Callable[[], int], lock: WriterLock | None, cache: int = 0, options: dict[str, str] | None = None):
        self.spark, self.files, self.value_type, self.dedup, self.clock = spark, files, value, dedup, clock
        self.indexes = Indexes()
        self._lock, self._closed = lock, False
        self._manifests: dict[int, dict] = {}
        self._row = T.StructType([*log_schema(value).fields, T.StructField("check", T.LongType())])
        self._options = options or {}
        self._cache, self._cache_size, self._cached_at = OrderedDict(), cache, 0
        self._compactor: tuple[threading.Thread, threading.Event] | None = None

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, value: T.DataType | str = "string", dedup: bool = False, clock: Callable[[], int] = time.time_ns, readonly: bool = False,
        cache: int = 0, rows_per_file: int = 0, bloom_keys: int | None = None,
    ) -> Store:
        """Open or create a store; values have one type, a Spark type or its DDL.

        ``cache``: so many values that :meth:`get` has read are kept until the next version. ``rows_per_file``: files of
        a version are cut at so many rows (0: not at all). ``bloom_keys``: the keys that the bloom filter of a row
        group is sized for; 0 writes none.
        """
        value = T._parse_datatype_string(value) if isinstance(value, str) else value
        files = Files(spark, path)
        files.make("_log")
        # Parquet bloom filters on the key let point reads skip row groups
        options = {"compression": "zstd", "parquet.bloom.filter.enabled#key": str(bloom_keys != 0).lower()}
        if bloom_keys:
            options["parquet.bloom.filter.expected.ndv#key"] = str(bloom_keys)
        if rows_per_file:
            options["maxRecordsPerFile"] = str(rows_per_file)
        store = cls(spark, files, value, dedup, clock, None if readonly else WriterLock(files), cache, options)
        store.refresh()
        return store

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.stop_compactor()
        if self._lock:
            self._lock.release()
        self._closed = True

    # versions

    def refresh(self) -> int:
        """See versions that others have published; returns the newest."""
        if self._closed:
            raise Closed(self.files.root)
        for name in self.files.names("_log"):
            if name.endswith(".json") and int(name[:-5]) not in self._manifests:
                self._manifests[int(name[:-5])] = json.loads(self.files.read(f"_log/{name}"))
        return self.version

    @property
    def version(self) -> int:
        return max(self._manifests, default=0)

    def _live_manifests(self, version: int | None = None) -> list[dict]:
        """Manifests of the newest base and what follows it; for an older version those that it was made of."""
        if version is not None and version not in self._manifests and not (version == 0 and (1 in self._manifests or not self._manifests)):
            raise VersionNotFound(f"version {version}; there are {min(self._manifests, default=0)} to {self.version}")
        upto = [m for v, m in sorted(self._manifests.items()) if version is None or v <= version]
        base = max((i for i, m in enumerate(upto) if m["kind"] == "base"), default=0)
        return upto[base:]

    def _read(self, manifests: list[dict]) -> DataFrame:
        if self._closed:
            raise Closed(self.files.root)
        folders = [f"{self.files.root}/data/{m['dir']}" for m in manifests if m["rows"]]
        rows = self.spark.read.schema(self._row).parquet(*folders) if folders else self.spark.createDataFrame([], self._row)
        return rows.select(*COLUMNS)

    def log(self, version: int | None = None) -> DataFrame:
        """The change log as of a version (the newest known one by default), read from its newest base on.

        A version that does not exist, or that a vacuum has taken the entries of, raises VersionNotFound.
        """
        return self._read(self._live_manifests(version))

    def version_log(self, version: int) -> DataFrame:
        """The entries of one version alone in order of position; those of a base keep the positions of the versions that it replaces."""
        self._live_manifests(version)
        return self._read([m for m in (self._manifests.get(version),) if m]).orderBy("pos")

    def entry(self, pos: int) -> DataFrame:
        """The entry at a position, as far as the log still holds it; without a base only one version is read."""
        live = self._live_manifests()
        own = [m for m in live if m["kind"] == "base" or m["version"] == pos >> 32]
        return entry_at(self._read(own), pos)

    def segment(self, number: int) -> DataFrame:
        """The entries that were written as one version, as far as the log still holds them."""
        live = self._live_manifests()
        return segment(self._read([m for m in live if m["kind"] == "base" or m["version"] == number]), number)

    def state(self, now_ns: int | None = None, include_expired: bool = False, version: int | None = None) -> DataFrame:
        """(key, value, expires_at_ns, pos) of live keys; one clock reading serves the whole plan.

        Behind a base only the versions after it are aggregated; a lone base is read as it is.
        """
        live = self._live_manifests(version)
        log, behind = self._read(live), [m for m in live[1:] if m["rows"]]
        depth = 2 if self.dedup else 0
        if live and live[0]["kind"] == "base":
            base = self._read(live[:1])
            entries, depth = (latest_over(base, self._read(behind), transactions=False), depth) if behind else (base, 0)  # a base has no links
        else:
            entries = latest(log, transactions=False)  # a version is atomic by itself
        return settled(entries, log, self.clock() if now_ns is None else now_ns, include_expired, depth)

    # writing

    def _publish(self, rows: DataFrame, base: int, kind: str = "append", tag: str | None = None) -> int:
        version, folder = base + 1, f"v{base + 1:012d}-{uuid.uuid4().hex}"
        where = f"{self.files.root}/data/{folder}"
        # counted on the way to the files, which need not be read again
        seen = Observation()
        rows = rows.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("check")).observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor("check"), F.lit(0)).alias("x"))
        rows.write.options(**self._options).parquet(where)
        manifest = {"version": version, "kind": kind, "dir": folder, "rows": seen.get["n"], "checks": seen.get["x"], "at_ns": self.clock(), "tag": tag}
        if kind == "base":
            manifest["done"] = self._done()
        try:
            self.files.publish(f"_log/{version:020d}.json", json.dumps(manifest))
        except VersionConflict:
            self.files.delete(f"data/{folder}")
            raise
        except Exception as e:
            raise CommitUncertain(f"version {version}") from e
        self._manifests[version] = manifest
        return version

    def _done(self) -> dict[str, int | None]:
        """Batches in the log: of tags like ``name/number`` the last number of each name, other tags as they are."""
        done: dict[str, int | None] = {}
        for m in self._manifests.values():
            marks = list(m.get("done", {}).items())
            if m.get("tag") is not None:
                name, slash, number = m["tag"].rpartition("/")
                marks.append((name, int(number)) if slash and number.isdecimal() else (m["tag"], None))
            for name, number in marks:
                last = done.get(name)
                done[name] = number if last is None else last if number is None else max(last, number)
        return done

    def _is_done(self, tag: str) -> bool:
        done = self._done()
        name, slash, number = tag.rpartition("/")
        if slash and number.isdecimal():
            return done.get(name) is not None and int(number) <= done[name]
        return tag in done

    def _linked(self, rows: DataFrame, version: int) -> DataFrame:
        """The new rows with links for values that the log holds; of the old ones only those whose value may be among the new take part."""
        if not self.dedup:
            return rows
        fresh = rows.where((F.col("type") == PUT) & F.col("value").isNotNull()).select(F.xxhash64("value").alias("_hash")).distinct()
        old = self.log(version - 1).where((F.col("type") == PUT) & F.col("value").isNotNull())
        old = old.join(fresh, F.xxhash64("value") == F.col("_hash"), "left_semi")
        return link_duplicates(old.unionByName(rows)).where(F.col("pos") >= F.lit(version << 32))

    def _append_rows(self, ops: list[tuple[int, str, object, int]], now_ns: int, base: int) -> int:
        """Publish buffered operations (type, key, value, ttl_ns) in order as version base + 1."""
        version = base + 1
        rows = [((version << 32) + i, t, 0, k, v, None, now_ns + ttl if ttl > 0 and t == PUT else 0) for i, (t, k, v, ttl) in enumerate(ops)]
        return self._publish(self._linked(self.spark.createDataFrame(rows, log_schema(self.value_type)), version), base)

    def put(self, key: str, value, ttl_ns: int = 0) -> int:
        return self._retry(lambda now, base: self._append_rows([(PUT, key, value, ttl_ns)], now, base))

    def delete(self, key: str) -> int:
        """Append a tombstone, also for a key that is not there."""
        return self._retry(lambda now, base: self._append_rows([(DELETE, key, None, 0)], now, base))

    def put_if_absent(self, key: str, value, ttl_ns: int = 0) -> int:
        try:
            return self.put_if(key, value, "not found", ttl_ns)
        except ConditionFailed:
            raise KeyExists(key) from None

    def put_if(self, key: str, value, condition: Column | str | None, ttl_ns: int = 0) -> int:
        """Put if the condition over (current, found) is true; else raise and write nothing."""
        return self._conditional((PUT, key, value, ttl_ns), condition)

    def delete_if(self, key: str, condition: Column | str | None) -> int:
        """Delete if the condition is true; it may be true of a missing key, too."""
        return self._conditional((DELETE, key, None, 0), condition)

    def _conditional(self, op, condition) -> int:
        if condition is None:
            raise InvalidCondition("a condition is needed")
        tx = self.begin()
        tx.require(op[1], condition)
        tx._ops.append(op)
        return tx.commit()

    def _retry(self, write: Callable[[int, int], int], attempts: int = 16) -> int:
        for attempt in range(attempts):
            try:
                return write(self.clock(), self.refresh())
            except VersionConflict:
                if attempt + 1 == attempts:
                    raise
        raise VersionConflict("no attempt is left")

    def write(self, batch: DataFrame, delete: bool = False, tag: str | None = None) -> int:
        """Append a batch of any size as one version: (key, value) and perhaps ttl_ns and ord.

        ``ord`` (unique, 0 to 2**32 - 1) orders operations on the same key; without it each key must
        occur once. ``tag`` names the batch: one whose tag is in the log already is not written again, compacted or
        not. Batches of tags like ``name/number`` come in order, so a number up to the last one counts as written.
        """
        base = self.refresh()
        if tag is not None and self._is_done(tag):
            return base
        ttl = F.coalesce(F.col("ttl_ns"), F.lit(0)) if "ttl_ns" in batch.columns else F.lit(0)
        value = F.lit(None).cast(self.value_type) if delete else F.col("value").cast(self.value_type)
        staged = None
        if "ord" in batch.columns:
            place = F.col("ord").cast("long")
        else:  # dense numbers: rows before a part, plus the place in it, fixed by writing the parts first
            staged = f"data/.staged-{uuid.uuid4().hex}"
            batch.withColumn("_id", F.monotonically_increasing_id()).write.parquet(f"{self.files.root}/{staged}")
            batch = self.spark.read.parquet(f"{self.files.root}/{staged}").withColumn("_part", F.shiftrightunsigned("_id", 33))
            sizes = batch.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
            starts, total = [], 0
            for s in sizes:  # a row a task of the batch
                starts.append(Row(_p=s["_part"], _start=total))
                total += s["n"]
            parts = self.spark.createDataFrame(starts, "_p long, _start long")
            batch = batch.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
            place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))

        def rows(now: int, at: int) -> DataFrame:
            return batch.select(
                pack_position(F.lit(at + 1), place).alias("pos"), F.lit(DELETE if delete else PUT).alias("type"), F.lit(0).cast("long").alias("tx_id"), "key",
                value.alias("value"), F.lit(None).cast("long").alias("link_pos"), (F.lit(0).cast("long") if delete else expires_at(now, ttl)).alias("expires_at_ns"),
            )

        try:
            return self._retry(lambda now, at: self._publish(self._linked(rows(now, at), at + 1), at, tag=tag))
        finally:
            if staged:
                self.files.delete(staged)

    def begin(self) -> Transaction:
        if self._closed:
            raise Closed(self.files.root)
        return Transaction(self)

    # reading

    def get(self, key: str):
        """The live value of a key; one that the cache holds for the newest known version costs no job."""
        if self._closed:
            raise Closed(self.files.root)
        if self._cached_at != self.version:
            self._cache.clear()
            self._cached_at = self.version
        now, row = self.clock(), self._cache.get(key)
        if row is None or 0 < row["expires_at_ns"] <= now:
            row = get_value(self.state(now), key)
        if self._cache_size:
            self._cache[key] = row
            self._cache.move_to_end(key)
            while len(self._cache) > self._cache_size:
                self._cache.popitem(last=False)
        return row["value"]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return multi_get(self.state(), keys)

    def keys(self) -> DataFrame:
        return self.state().select("key")

    def for_each(self, f) -> None:
        for_each(self.state(), f)

    def add_index(self, name: str, extractor: Column | str) -> None:
        """Index by an expression over (key, value)."""
        self.indexes.add(name, extractor)

    def get_by_index(self, name: str, value: str) -> Result:
        return self.indexes.lookup(self.state(), name, value)

    def scan(self) -> Result:
        return Result(self.state())

    def digest(self, now_ns: int | None = None, include_expired: bool = False) -> str:
        """Digest of the state; of a large one by levels, see :func:`~stratakeep.operators.digest.sized_root`."""
        now = self.clock() if now_ns is None else now_ns
        return digests.sized_root(digests.leaves(self.state(now, include_expired))).first()["root"]

    # upkeep

    def compact(self) -> int:
        """Publish a base version of plain puts; digests and states do not change. No-op on a lone base."""
        base = self.refresh()
        live = self._live_manifests()
        if not live or (len(live) == 1 and live[0]["kind"] == "base"):
            return base
        return self._publish(compacted(self.log(base), 2 if self.dedup else 0, transactions=False), base, "base")

    def start_compactor(self, every_s: float, versions: int = 2) -> None:
        """Compact and vacuum in the background whenever so many versions have piled up, looking every so many seconds.

        A failed attempt changes nothing and is made again at the next look. A vacuum takes older versions from
        readers, as always. Ends with :meth:`stop_compactor` or :meth:`close`.
        """
        self.stop_compactor()
        end = threading.Event()

        def run() -> None:
            while not end.wait(every_s):
                try:
                    self.refresh()
                    if len(self._live_manifests()) >= versions:
                        self.compact()
                        self.vacuum()
                except StoreError:  # another writer came first, or the store has been closed
                    continue

        thread = threading.Thread(target=run, name="compactor", daemon=True)
        self._compactor = thread, end
        thread.start()

    def stop_compactor(self) -> None:
        if self._compactor:
            thread, end = self._compactor
            end.set()
            thread.join()
            self._compactor = None

    def reclaimable(self) -> DataFrame:
        return reclaim(self.log(), F.length(F.to_json(F.struct("key", "value"))) + 37, transactions=False)

    def vacuum(self) -> list[str]:
        """Delete what no version from the newest base on needs, oldest first; returns the folders' names.

        Readers of older versions and writers at work must be done.
        """
        self.refresh()
        live = {m["dir"] for m in self._live_manifests()}
        first = min((m["version"] for m in self._live_manifests()), default=0)
        for v in sorted(v for v in self._manifests if v < first):
            self.files.delete(f"_log/{v:020d}.json")
            del self._manifests[v]
        gone = [d for d in self.files.names("data") if d not in live]
        for d in gone:
            self.files.delete(f"data/{d}")
        return gone

    def stats(self) -> list[dict]:
        """Version, kind, rows and time of each version that reading uses; the last one is the active one."""
        return [{k: m[k] for k in ("version", "kind", "rows", "at_ns")} for m in self._live_manifests()]

    def verify(self) -> None:
        """Check every row and manifest; raise Corrupt at the first version that does not hold."""
        bad = ~F.xxhash64(*COLUMNS).eqNullSafe(F.col("check"))
        for m in self._live_manifests():
            if not m["rows"]:
                continue
            where = f"{self.files.root}/data/{m['dir']}"
            try:
                rows = self.spark.read.schema(self._row).parquet(where)
                seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("check"), F.lit(0)).alias("x"), F.count(F.when(bad, 1)).alias("bad"), F.min(F.when(bad, F.col("pos"))).alias("first")).first()
            except PySparkException as e:
                raise Corrupt(f"version {m['version']} cannot be read") from e
            if (seen["n"], seen["x"], seen["bad"]) != (m["rows"], m["checks"], 0):
                where = "" if seen["first"] is None else f", the first at position {seen['first']}"
                raise Corrupt(f"version {m['version']}: {seen['n']} of {m['rows']} rows, {seen['bad']} bad{where}")
        log = self.log()
        broken = violations(log).take(1) or broken_links(log).take(1)
        if broken:
            raise Corrupt(str(broken[0]))
