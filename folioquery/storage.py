"""Folders that several machines share: the session's shared folder, and commits by one exclusive rename."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

STAGE, BASE, BEGUN = "_stage-", "-base", "_begun"
#: Hours after which what a base covers is removed, so that running readers finish; and days that a used number stays taken after that.
GRACE_HOURS, TAKEN_DAYS = 24.0, 7.0
# Stores that rename by copying, so that two writers could both succeed.
COPYING_SCHEMES = frozenset("s3 s3a s3n gs oss cosn swift wasb wasbs".split())


class WriteConflict(RuntimeError):
    """Another writer has committed under the same name first; read again and redo."""


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Only a local session may go without: it gets a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="folioquery-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Each query in here removes its shuffle files when it ends; otherwise they stay until the driver happens to collect garbage. The setting is the session's, and is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Folder:
    """A folder of committed sub-folders; unfinished work lies beside them under ``_stage-`` names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.getUri().getScheme() in COPYING_SCHEMES:
            raise ValueError(f"{self.root}: this store copies to rename, so commits to it are not exclusive")

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def create(self) -> None:
        self._fs.mkdirs(self._at(""))

    def mark(self, name: str) -> None:
        """Create an empty file unless it is there."""
        self._fs.createNewFile(self._at(name))

    def names(self) -> list[str]:
        """Names in the folder, sorted; none where it does not exist."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at("")))

    def commit(self, stage: str, name: str) -> None:
        """Rename a stage to its name; WriteConflict if the name is taken. (A plain rename would move the stage inside the other's folder.)"""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._at(stage)), self._fs.makeQualified(self._at(name)), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self._fs.exists(self._at(name)):
                raise WriteConflict(f"{self.root}/{name} was committed by another writer") from None
            raise

    def bytes(self, names: list[str]) -> int:
        """Size of the files below these names."""
        return sum(self._fs.getContentSummary(self._at(n)).getLength() for n in names)

    def stamp(self) -> str:
        """Size and time of the last change of the file or folder itself."""
        of = self._fs.getFileStatus(self._at(""))
        return f"{self._fs.getContentSummary(self._at('')).getLength()} {of.getModificationTime()}"

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def older(self, names: list[str], hours: float) -> list[str]:
        """Those of the names without a change for so many hours."""
        limit = (time.time() - 3600 * hours) * 1000
        return [n for n in names if self._fs.getFileStatus(self._at(n)).getModificationTime() <= limit]

    def begin(self) -> str:
        """A new stage. It must not have been swept by the time that it is committed."""
        stage = f"{STAGE}{uuid.uuid4().hex}"
        self._fs.mkdirs(self._at(stage))
        self._fs.create(self._at(f"{stage}/{BEGUN}")).close()
        return stage

    def begun(self, names: list[str]) -> list[str]:
        """Those of the names that still have what was written there."""
        return [n for n in names if self._fs.exists(self._at(f"{n}/{BEGUN}"))]

    def finish(self, stage: str, name: str) -> None:
        """Commit a stage of ``begin``."""
        if not self._fs.exists(self._at(f"{stage}/{BEGUN}")):
            raise WriteConflict(f"{self.root}/{stage} was swept while it was being written")
        self.commit(stage, name)

    def clear(self, name: str) -> None:
        """Remove what a name holds; the name itself stays taken."""
        self._fs.delete(self._at(f"{name}/{BEGUN}"), False)
        for x in self._fs.listStatus(self._at(name)):
            self._fs.delete(x.getPath(), True)

    def sweep(self, hours: float = 24.0) -> list[str]:
        """Remove stages of writers that died: those without a change for ``hours``; returns their names."""
        if not self._fs.exists(self._at("")):
            return []
        limit = (time.time() - 3600 * hours) * 1000
        old = [x.getPath().getName() for x in self._fs.listStatus(self._at("")) if x.getModificationTime() < limit]
        gone = sorted(n for n in old if n.startswith(STAGE))
        for n in gone:
            self.delete(n)
        return gone


@dataclass
class Writing:
    """A commit that is being made: where to write, under which number it will be, and the names that were live when it began."""

    path: str
    number: int
    live: list[str]
    wanted: bool = True  # if not, the stage is dropped


class Log(Folder):
    """Numbered commits: parts, and bases that stand for all up to their number.

    A commit takes the number after the newest one by an exclusive rename, so of two writers that began from the same state one gets WriteConflict.
    A number is never free again while a writer that began before could still ask for it: what a base covers is emptied after ``GRACE_HOURS``, so that
    readers which have planned those files finish, but its name stays for ``TAKEN_DAYS`` more; and a stage that old has been swept, and cannot be committed.
    """

    @staticmethod
    def number(name: str) -> int:
        return int(name.removesuffix(BASE))

    def live(self) -> list[str]:
        """The newest base, if there is one, and the parts after it."""
        names = [n for n in self.names() if n[:1].isdigit()]
        base = max((n for n in names if n.endswith(BASE)), default="")
        return [base] * bool(base) + [n for n in names if not n.endswith(BASE) and n > base.removesuffix(BASE)]

    @contextmanager
    def part(self, anywhere: bool = False) -> Iterator[Writing]:
        """Write the next part. ``anywhere``: what is written does not depend on what was live, so it may as well come after another writer's part."""
        stage, live = self.begin(), self.live()
        at = Writing(f"{self.root}/{stage}", self.number(live[-1]) + 1 if live else 1, live)
        try:
            yield at
            if not at.wanted:
                self.delete(stage)
            while at.wanted:
                try:
                    self.finish(stage, f"{at.number:012d}")
                    break
                except WriteConflict:
                    if not anywhere or not self.begun([stage]):
                        raise
                    live = self.live()
                    at.number = max(at.number, self.number(live[-1]) if live else 0) + 1
        except BaseException:
            self.delete(stage)
            raise

    @contextmanager
    def base(self) -> Iterator[Writing]:
        """Write a base for what is live now; older bases and the parts it stands for are emptied later."""
        stage, live = self.begin(), self.live()
        at = Writing(f"{self.root}/{stage}", self.number(live[-1]) if live else 0, live)
        try:
            yield at
            self.finish(stage, f"{at.number:012d}{BASE}")
        except BaseException:
            self.delete(stage)
            raise
        self.clean()

    def clean(self, hours: float | None = None, days: float | None = None) -> None:
        """Empty what has been covered for the grace period, and forget numbers once no writer can ask for them."""
        hours, days = GRACE_HOURS if hours is None else hours, TAKEN_DAYS if days is None else days
        names, live = [n for n in self.names() if n[:1].isdigit()], self.live()
        if not live or not live[0].endswith(BASE):
            return
        covered = [n for n in names if n not in live and self.number(n) <= self.number(live[0])]
        if covered and self.older([live[0]], hours):
            for n in self.begun(covered):
                self.clear(n)
        self.sweep()
        emptied = [n for n in covered if n not in self.begun(covered)]
        for n in self.older(emptied, 24 * days):
            self.delete(n)


def again(work: Callable[[], object], attempts: int = 5):
    """The result of ``work``; after a WriteConflict it is done again from what the other writer left."""
    for left in reversed(range(attempts)):
        try:
            return work()
        except WriteConflict:
            if not left:
                raise
            time.sleep(0.05)
    raise ValueError("attempts must be at least 1")
