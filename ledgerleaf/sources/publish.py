"""Publishing: a data sink that writes files aside and puts all of them in place in one commit.

    spark.dataSource.register(publish.FileSink)
    files.write.format("published_files").mode("overwrite").save(target)   # (path, content)

Tasks write their rows as files into one staging tree and send back how many there were
and a digest that doesn't depend on order. The commit, in the driver, compares the sum
of the digests with the one of the last commit: equal outputs change nothing; else the
staging tree takes the target's place by renaming, with the old one back if that fails.
A failed task aborts the write, and the target stays as it was. A task that runs twice
writes the same files again. Arrow's file systems open the paths; where a store has no
renaming of folders, the swap is a copy and not atomic.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerleaf.sources import shared
from ledgerleaf.sources.paged import file_system

if TYPE_CHECKING:
    from pyarrow import fs

DIGEST = ".digest"


@dataclass
class _Written(WriterCommitMessage):
    rows: int
    digest: int


def _safe(path: str | None) -> bool:
    parts = (path or "").split("/")
    return bool(path) and "\\" not in path and not path.startswith(("/", ".digest")) and not {"", ".", ".."} & set(parts)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.target, self.dry_run, self.job = options["path"].rstrip("/"), options.get("dryrun", "false") == "true", uuid.uuid4().hex
        system, staged = self._place("staged")
        system.create_dir(f"{staged}.parts", recursive=True)  # once, before all tasks: one that lags behind an abort must not make it again

    def _place(self, name: str) -> tuple[fs.FileSystem, str]:
        system, path = file_system(self.target)
        parent, _, own = path.rpartition("/")
        return system, f"{parent}/.{own}-{name}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, staged = self._place("staged")
        rows = total = 0
        made: set[str] = set()
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if not _safe(path):
                    raise ValueError(f"not a path for output: {path}")
                data = content.encode() if isinstance(content, str) else bytes(content or b"")
                aside, final = f"{staged}.parts/{uuid.uuid4().hex}", f"{staged}/{path}"
                with system.open_output_stream(aside) as out:  # fails once the write is aborted, as its folder is gone
                    out.write(data)
                folder = final.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.clear() if len(made) >= 10_000 else None
                    made.add(folder)
                system.move(aside, final)
                rows += 1
                total += int.from_bytes(hashlib.sha256(path.encode() + b"\0" + hashlib.sha256(data).digest()).digest()[:16])
        return _Written(rows, total)

    def commit(self, messages: list[_Written | None]) -> None:
        system, staged = self._place("staged")
        _, target = file_system(self.target)
        found = [m for m in messages if m is not None]
        digest = json.dumps({"files": sum(m.rows for m in found), "digest": f"{sum(m.digest for m in found) % (1 << 128):032x}"})
        try:
            if self.dry_run or _digest(system, target) == digest:
                return
            system.create_dir(staged, recursive=True)
            with system.open_output_stream(f"{staged}/{DIGEST}") as out:
                out.write(digest.encode())
            self._swap(system, staged, target)
        finally:
            self._clean(system, staged)

    def _swap(self, system: fs.FileSystem, staged: str, target: str) -> None:
        _, old = self._place("previous")
        there = system.get_file_info(target).type.name != "NotFound"
        if there:
            system.move(target, old)
        try:
            system.move(staged, target)
        except Exception:
            if there:
                system.move(old, target)
            raise
        if there:
            system.delete_dir(old)

    def _clean(self, system: fs.FileSystem, staged: str) -> None:
        for path in (staged, f"{staged}.parts"):
            if system.get_file_info(path).type.name == "Directory":
                system.delete_dir(path)

    def abort(self, messages: list[_Written | None]) -> None:
        system, staged = self._place("staged")
        self._clean(system, staged)


def _digest(system: fs.FileSystem, target: str) -> str | None:
    path = f"{target}/{DIGEST}"
    if not system.get_file_info(path).is_file:
        return None
    with system.open_input_stream(path) as stream:
        return stream.read().decode()


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def publish(outputs: dict[str, DataFrame], target: str, check: Callable[[dict[str, DataFrame]], None] | None = None, dry_run: bool = False) -> bool:
    """Writes all outputs of (path, content), each in a folder of its name below ``target``, in one commit; false if nothing changed or on a dry run.

    ``check`` may raise on the outputs first; paths must be distinct within an output.
    """
    if check:
        check(outputs)
    files = None
    for name, df in outputs.items():
        repeated = df.groupBy("path").count().where("count > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"{name} has several files at " + ", ".join(str(r.path) for r in repeated))
        own = df.select(F.concat(F.lit(f"{name}/"), "path").alias("path"), F.col("content").cast("string").alias("content"))
        files = own if files is None else files.unionByName(own)
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    system, there = file_system(target)
    before = _digest(system, there.rstrip("/"))
    files.write.format("published_files").option("dryRun", str(dry_run).lower()).mode("append").save(target)
    return not dry_run and _digest(system, there.rstrip("/")) != before


#: So many files are read by a task, and so many bytes of them handed on at once.
TASK_FILES, SLICE = 5_000, 4_000_000


def _listed(target: str):
    """In: folders below ``target``; out: (path, folder) of what each holds."""

    def run(batches):
        from pyarrow import fs  # here, as it starts threads and Spark's daemon forks

        system, root = file_system(target)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/")))
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{x.base_name}".lstrip("/") for x in part], "folder": [x.type == fs.FileType.Directory for x in part]})

    return run


def _contents(target: str):
    def run(batches):
        system, root = file_system(target)
        for batch in batches:
            paths, texts, size = [], [], 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                with system.open_input_stream(f"{root}/{path}") as stream:
                    data = stream.read()
                paths.append(path)
                texts.append(data.decode(errors="replace"))
                size += len(data)
                if size >= SLICE or i == len(batch) - 1:
                    yield pa.RecordBatch.from_pydict({"path": paths, "content": texts}, pa.schema([("path", pa.string()), ("content", pa.string())]))
                    paths, texts, size = [], [], 0

    return run


def published(spark, target: str) -> DataFrame:
    """(path, content) of what is published at ``target``, empty files too; tasks list its folders, level by level, and read its files."""
    target = target.rstrip("/")
    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = shared.stage(level.mapInArrow(_listed(target), "path string, folder boolean"), "published")
        levels.append(listed.where("not folder").select("path"))
        level = listed.where("folder").select("path")
        if level.isEmpty():
            break
    files = functools.reduce(DataFrame.unionByName, levels).where(F.col("path") != DIGEST)
    shared.small_batches(spark)
    return files.repartition(files.count() // TASK_FILES + 1, "path").mapInArrow(_contents(target), "path string, content string")
