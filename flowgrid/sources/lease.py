"""A folder's single writer: a lease in the file system that holds the folder.

Leases of a folder are numbered files; the highest number is the writer. A number is taken by
creating its file, which succeeds once. A lease that is over, or whose owner hasn't renewed it in
time, gives way to the next number; an owner that was slow finds a higher one and stops.
"""

from __future__ import annotations

import json
import socket
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

FOLDER = "_lease"
SECONDS = 600


class LeaseHeld(RuntimeError):
    """Another writer has the folder."""


class LeaseLost(RuntimeError):
    """The folder has been given to another writer."""


def _open(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, body: str = "") -> bool:
    """Whether this call made the file. Of several at once, one does."""
    p, fs = _open(spark, path)
    if fs.getScheme() == "file":  # Hadoop's local file system checks first and creates then; Java's does both at once
        fs.mkdirs(p.getParent())
        if not spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).createNewFile():
            return False
        out = fs.create(p, True)
    else:
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise e
    out.write(bytearray(body.encode()))
    out.close()
    return True


def _files(spark: SparkSession, folder: str) -> dict[str, tuple[str, float]]:
    """Name to path and time of change."""
    p, fs = _open(spark, f"{folder.rstrip('/')}/{FOLDER}")
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): (s.getPath().toString(), s.getModificationTime() / 1000) for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")}


def _read(spark: SparkSession, path: str) -> str:
    p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def holder(spark: SparkSession, folder: str) -> dict | None:
    """The last lease of a folder: its number, owner, end in seconds, and whether it was given back."""
    files = _files(spark, folder)
    numbers = [int(n[:9]) for n in files if n.endswith(".lease")]
    if not numbers:
        return None
    name = f"{max(numbers):09d}"
    path, changed = files[f"{name}.lease"]
    body = _read(spark, path)
    said = json.loads(body) if body else {"owner": None, "until": changed + SECONDS}
    until = max([said["until"], *[int(n.split(".")[2]) / 1000 for n in files if n.startswith(f"{name}.until.")]])
    return {"number": max(numbers), "owner": said["owner"], "until": until, "done": f"{name}.done" in files}


@dataclass
class Lease:
    """Use as a context: the lease is renewed beside the work and given back after it."""

    spark: SparkSession
    folder: str
    number: int
    owner: str
    seconds: float
    until: float
    _stop: threading.Event = field(default_factory=threading.Event)

    @property
    def _at(self) -> str:
        return f"{self.folder.rstrip('/')}/{FOLDER}/{self.number:09d}"

    def check(self) -> None:
        """Fails if the folder isn't this owner's any more."""
        last = holder(self.spark, self.folder)
        if last is None or last["number"] != self.number or last["done"] or last["until"] < time.time():
            raise LeaseLost(f"{self.folder} is now of {last and last['owner']}")

    def renew(self) -> None:
        self.check()
        self.until = time.time() + self.seconds
        _create(self.spark, f"{self._at}.until.{int(self.until * 1000)}")

    def release(self) -> None:
        self._stop.set()
        _create(self.spark, f"{self._at}.done")

    def __enter__(self) -> Lease:
        def keep() -> None:
            while not self._stop.wait(self.seconds / 3):
                try:
                    self.renew()
                except LeaseLost:
                    return

        threading.Thread(target=keep, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def acquire(spark: SparkSession, folder: str, seconds: float = SECONDS, owner: str | None = None) -> Lease:
    """The lease of a folder, or LeaseHeld if another writer has it."""
    owner = owner or f"{socket.gethostname()}:{spark.sparkContext.applicationId}:{uuid.uuid4().hex[:8]}"
    last = holder(spark, folder)
    if last and not last["done"] and last["until"] >= time.time():
        raise LeaseHeld(f"{folder} is being written by {last['owner']}")
    lease = Lease(spark, folder, (last["number"] if last else 0) + 1, owner, seconds, time.time() + seconds)
    if not _create(spark, f"{lease._at}.lease", json.dumps({"owner": owner, "until": lease.until})):
        raise LeaseHeld(f"{folder} has just been taken by another writer")
    return lease
