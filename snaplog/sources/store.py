"""A version log on disk: Parquet files, and manifests that say which of them count.

``data/<id>/`` holds the files of one commit or run; ``manifest/<number>.json`` lists all that make
up the log, with the range of sequence numbers of each, the last sequence number given out, and the
last batch of each stream. A manifest appears whole and exclusively: of two writers of one number the second
loses, reads again and tries again. Files that no manifest lists don't exist for readers, whatever
left them there; a manifest that is not whole (its checksum tells) is passed over. So a commit is
atomic, readers never wait, and a DataFrame of an old manifest stays readable until ``vacuum``.

An entry also has the least and greatest key (their first EDGE bytes) and the bytes of its rows, so
that reads of a key or range open only files that can hold it, and commits are rolled up by
themselves once they have ``flush`` bytes.

A held snapshot is a small file in ``holds/``, so compaction by any process respects it until it is
released, or ``lease`` ms old (its process is taken to be gone then). Durability is that of the file
system's close. The file system must not rename onto a file, or be local (then manifests get their
names by hard links).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entry_bytes
from ..operators import versions, writes
from ..schema import LATEST, LOG, WRITES, as_log, as_writes, key_bytes, violations
from .files import Files

COMMIT, RUN = "commit", "run"
ATTEMPTS = 50
#: Bytes of a least or greatest key that a manifest keeps; manifests that vacuum leaves; bytes of commits that become a run; a hold's lease.
EDGE, MANIFESTS, FLUSH, LEASE_MS = 64, 10, 4 << 20, 7 * 24 * 3600 * 1000


class TransactionConflict(Exception):
    """A key that the transaction wrote has a newer version."""


@dataclass
class Manifest:
    number: int = 0
    last_seq: int = 0
    files: list[dict] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        body = json.dumps({"number": self.number, "last_seq": self.last_seq, "files": self.files, "streams": self.streams}, sort_keys=True)
        return f"{body}\n{zlib.crc32(body.encode())}\n"

    @classmethod
    def parse(cls, text: str) -> Manifest | None:
        body, _, rest = text.partition("\n")
        if rest.strip() != str(zlib.crc32(body.encode())):
            return None
        return cls(**json.loads(body))


class Store:
    """One log. All methods that write return after their manifest is published."""

    def __init__(self, spark: SparkSession, path: str, flush: int = FLUSH, lease_ms: int = LEASE_MS):
        self.spark, self.path, self.flush, self.lease_ms = spark, path.rstrip("/"), flush, lease_ms
        self.files = Files(spark, self.path)
        self.files.make("manifest")
        self.held: dict[int, list[str]] = {}

    # -- manifests

    def manifest(self) -> Manifest:
        """The newest whole manifest."""
        for name in reversed([n for n in self.files.names("manifest") if n.endswith(".json") and n[:-5].isdigit()]):
            if found := Manifest.parse(self.files.read(f"manifest/{name}")):
                return found
        return Manifest()

    def _publish(self, new: Manifest) -> bool:
        names = [int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json") and n[:-5].isdigit()]
        # a manifest that isn't whole keeps its number
        number = max([new.number, *names], default=0) + 1
        if any(n > new.number and Manifest.parse(self.files.read(f"manifest/{n:020d}.json")) for n in names):
            return False
        new.number = number
        return self.files.create(f"manifest/{number:020d}.json", new.text())

    @property
    def last_seq(self) -> int:
        return self.manifest().last_seq

    # -- files

    def _write(self, rows: DataFrame, kind: str) -> dict:
        """Writes log rows in run order and gives the manifest's entry for them."""
        name = f"data/{uuid.uuid4().hex}"
        ordered = (rows.repartitionByRange("key") if kind == RUN else rows).sortWithinPartitions("key", F.col("seq").desc())
        # adaptive: of filters of 512 bytes to 1 MB, a file gets the smallest that fits its keys
        bloom = {"enabled#key": "true", "adaptive.enabled": "true", "candidates.number#key": "12"}
        as_log(ordered).write.options(**{f"parquet.bloom.filter.{k}": v for k, v in bloom.items()}).parquet(f"{self.path}/{name}")
        edge = F.substring("key", 1, EDGE)
        found = self.spark.read.schema(LOG).parquet(f"{self.path}/{name}").agg(
            F.count(F.lit(1)).alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high"),
            F.hex(F.min(edge)).alias("min_key"), F.hex(F.max(edge)).alias("max_key"), F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("bytes"),
        ).first()
        entry = {"path": name, "kind": kind, "rows": found["rows"], "bytes": found["bytes"] or 0, "min_seq": found["low"] or 0, "max_seq": found["high"] or 0}
        return entry | {"min_key": found["min_key"] or "", "max_key": found["max_key"] or ""}

    def log(self, manifest: Manifest | None = None, above: int = 0, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """The log as a DataFrame; ``above`` leaves out files without a newer sequence number, ``low`` and ``high`` those without such keys."""
        found = manifest or self.manifest()
        files = [f for f in found.files if f["max_seq"] > above and f["rows"] and _can_hold(f, low, high)]
        paths = [f["path"] if f["path"].startswith(("/", "file:")) or "://" in f["path"] else f"{self.path}/{f['path']}" for f in files]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def branch(self, path: str, **options) -> Store:
        """A new store that begins with this one's log, without copying it. This one's ``vacuum`` must not run while the branch needs its files."""
        now, new = self.manifest(), Store(self.spark, path, **options)
        files = [f | {"path": f["path"] if "/" in f["path"].removeprefix("data/") else f"{self.path}/{f['path']}"} for f in now.files]
        if not new._publish(Manifest(0, now.last_seq, files, dict(now.streams))):
            raise ValueError(f"{path} has a store already")
        return new

    # -- reads

    def live(self, snapshot: int = LATEST) -> DataFrame:
        return versions.live(self.log(), snapshot)

    def get(self, key: bytes | str, snapshot: int = LATEST, manifest: Manifest | None = None) -> bytes | None:
        found = versions.get(self.log(manifest, low=key_bytes(key), high=key_bytes(key)), key, snapshot).first()
        return None if found is None else bytes(found["value"])

    def multi_get(self, keys: DataFrame, snapshot: int = LATEST, manifest: Manifest | None = None) -> DataFrame:
        return versions.multi_get(self.log(manifest), keys, snapshot)

    def range(self, low: bytes | str, high: bytes | str, limit: int = 0, snapshot: int = LATEST) -> DataFrame:
        return versions.range_scan(self.log(low=key_bytes(low), high=key_bytes(high)), low, high, limit, snapshot)

    # -- writes

    def _commit(self, build: Callable[[Manifest], DataFrame | None], stream: str | None = None, batch: int = -1) -> int:
        """Publishes what ``build`` makes of the current manifest; None or no rows: nothing, and no sequence number is used.

        Gives the last sequence number. Losing a race builds anew, since what is live may have changed.
        With ``stream``, a batch number that the stream has reached already publishes nothing, so it never goes back.
        """
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if stream is not None and now.streams.get(stream, -1) >= batch:
                return now.last_seq
            rows = build(now)
            entry = None if rows is None else self._write(rows, COMMIT)
            if (entry is None or not entry["rows"]) and stream is None:
                if entry:
                    self.files.remove(entry["path"])
                return now.last_seq
            files = [*now.files, entry] if entry and entry["rows"] else now.files
            last = max(now.last_seq, entry["max_seq"] if entry else 0)
            streams = now.streams if stream is None else {**now.streams, stream: batch}
            if self._publish(Manifest(now.number, last, files, streams)):
                if sum(f["bytes"] for f in files if f["kind"] == COMMIT) >= self.flush:
                    self.roll_up(self.flush)
                return last
            if entry:
                self.files.remove(entry["path"])
        raise RuntimeError("the store is too busy")

    def write(self, batch: DataFrame) -> int:
        """An atomic batch (ord, key, kind, value): one sequence number, the last write of a key counts."""
        own = writes.last_writes(as_writes(batch))
        if not violations(writes.stamp_batch(own, 0)).isEmpty():
            raise ValueError("a batch holds rows that aren't writes")
        return self._commit(lambda now: writes.stamp_batch(own, now.last_seq))

    def put(self, pairs: DataFrame) -> int:
        """(key, value) pairs as one atomic batch; ValueError if a key stands in it twice, since pairs have no order."""
        if not pairs.groupBy("key").count().where(F.col("count") > 1).isEmpty():
            raise ValueError("a key stands more than once in a batch of pairs")
        return self.write(pairs.select(F.lit(0).alias("ord"), "key", F.lit(0).alias("kind"), "value"))

    def set(self, key: bytes | str, value: bytes | str) -> int:
        return self.write(self.spark.createDataFrame([(0, key_bytes(key), 0, key_bytes(value))], WRITES))

    def delete(self, keys: DataFrame | list) -> int:
        """Deletes those of the keys that exist, atomically; gives how many did. A repeated key counts once."""
        wanted = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(key_bytes(k),) for k in keys], "key binary")
        count = 0

        def build(now: Manifest) -> DataFrame | None:
            nonlocal count
            found = writes.delete_set(self.log(now), wanted, now.last_seq)
            count = found.count()
            return writes.stamp_batch(writes.tombstones(found), now.last_seq) if count else None

        self._commit(build)
        return count

    def apply_ordered(self, commands: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Ordered single writes (ord, key, kind, value), each with a sequence number of its own.

        A delete of a key that doesn't exist at that point writes a tombstone all the same; reads can't tell.
        With ``stream``, a batch number that was applied already is passed over.
        """
        own = as_writes(commands)
        return self._commit(lambda now: writes.stamp_each(own, now.last_seq), stream, -1 if batch is None else batch)

    def commit_writes(self, batch: DataFrame, read_seq: int) -> int:
        """A transaction's writes: raises TransactionConflict if a written key is newer than ``read_seq``."""
        own = writes.last_writes(as_writes(batch))

        def build(now: Manifest) -> DataFrame:
            if not writes.conflicts(self.log(now, above=read_seq), own, read_seq).isEmpty():
                raise TransactionConflict("transaction conflict: a written key has a newer version")
            return writes.stamp_batch(own, now.last_seq)

        return self._commit(build)

    # -- snapshots

    def hold(self, seq: int | None = None) -> int:
        """Keeps a snapshot readable through compaction, by whatever process, until released as often as held."""
        seq = self.last_seq if seq is None else seq
        name = f"holds/{seq:020d}-{uuid.uuid4().hex}"
        self.files.create(name, "")
        self.held.setdefault(seq, []).append(name)
        return seq

    def release(self, seq: int) -> None:
        names = self.held.get(seq, [])
        if names:
            self.files.remove(names.pop())
        if not names:
            self.held.pop(seq, None)

    def oldest_held(self) -> int:
        """The least snapshot that some process holds, or the last sequence number."""
        names = [n for n in self.files.names("holds") if n[:20].isdigit() and self.files.age_ms(f"holds/{n}") < self.lease_ms]
        return min([self.last_seq, *(int(n[:20]) for n in names)])

    @contextmanager
    def snapshot(self):
        seq = self.hold()
        try:
            yield seq
        finally:
            self.release(seq)

    # -- upkeep

    def compact(self) -> Manifest:
        """All files become one run without the versions that no held snapshot needs."""
        for _ in range(ATTEMPTS):
            now = self.manifest()
            boundary = min(now.last_seq, self.oldest_held())
            entry = self._write(versions.retain(self.log(now), boundary), RUN)
            new = Manifest(now.number, now.last_seq, [entry] if entry["rows"] else [], now.streams)
            if self._publish(new):
                return new
            self.files.remove(entry["path"])
        raise RuntimeError("the store is too busy")

    def roll_up(self, least: int = 4 << 20) -> Manifest:
        """Commits become one run, all versions kept, once their keys and values have ``least`` bytes."""
        for _ in range(ATTEMPTS):
            now = self.manifest()
            tail = [f for f in now.files if f["kind"] == COMMIT]
            part = self.log(Manifest(files=tail))
            if not tail or versions.tail_bytes(part).first()["bytes"] < least:
                return now
            entry = self._write(part, RUN)
            new = Manifest(now.number, now.last_seq, [*(f for f in now.files if f["kind"] != COMMIT), entry], now.streams)
            if self._publish(new):
                return new
            self.files.remove(entry["path"])
        raise RuntimeError("the store is too busy")

    def vacuum(self, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Removes files that no kept manifest lists, and all but the last manifests, if old enough for no reader or writer to need them."""
        names = [n for n in self.files.names("manifest") if n.endswith(".json") and n[:-5].isdigit()]
        old = [n for n in names[:-MANIFESTS] if self.files.age_ms(f"manifest/{n}") >= older_than_ms]
        listed = {f["path"] for f in self.manifest().files}
        gone = [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in listed and self.files.age_ms(f"data/{n}") >= older_than_ms]
        for name in [*gone, *(f"manifest/{n}" for n in old)]:
            self.files.remove(name)
        return gone


def _can_hold(entry: dict, low: bytes | None, high: bytes | None) -> bool:
    """Whether a file's range of keys, known by first bytes only, can meet low .. high."""
    least, most = bytes.fromhex(entry["min_key"]), bytes.fromhex(entry["max_key"])
    return (high is None or least <= high) and (low is None or low[:EDGE] <= most)
