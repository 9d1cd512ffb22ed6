"""Flat little-endian int32 token files (``.bin``) as a Spark data source.

Reader: a Python ``DataSource`` whose input partitions are ranges of whole chunks, so a large file
is read by many tasks in parallel; each task reads its byte range a chunk at a time and emits
``(shard, chunk_id, start, ids)`` rows aligned on ``chunk_size`` tokens.

There are two stored forms. ``write_parts`` gives a folder of part files with a list of them; each
task writes runs of tokens that follow one another to files of its own, and the list, written when
the job commits, names those of the attempts that counted. It works on every file system that
``sources.files`` opens, and the parts in the list's order, put end to end, are the flat file.
``write_bin`` gives one flat file, for readers that map it: each task writes its chunks into one
hidden file beside the target at byte offset ``start * 4``, and the commit renames it. That needs
positional writes, so the target must be on a mount that executors share. Either way nothing
passes through the driver, a retried task is harmless, and a failed job leaves no target.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import islice, takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.sources import files

SCHEMA = "shard string, chunk_id bigint, start bigint, ids array<int>"
DEFAULT_CHUNK = 4096
CHUNKS_PER_PARTITION = 256
#: The list of a folder's part files.
PARTS = "_parts.json"


class _Range(InputPartition):
    """Chunks ``first`` to ``last`` and the part files (path, first token, tokens) that hold them."""

    def __init__(self, parts: list[tuple[str, int, int]], shard: str, first_chunk: int, last_chunk: int):
        super().__init__((shard, first_chunk))
        self.parts, self.shard, self.first, self.last = parts, shard, first_chunk, last_chunk


def _stored(path: str) -> list[tuple[str, int, int]] | None:
    """(path, first token, tokens) of a flat file or of the parts in a folder; None without either."""
    size = files.length(path)
    if size is not None:
        return [(path, 0, size // 4)]
    if files.length(f"{path}/{PARTS}") is None:
        return None
    return [(f"{path}/{name}", start, n) for start, n, name in json.loads(files.read_all(f"{path}/{PARTS}"))]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.shard = options.get("shard") or self.path.rsplit("/", 1)[-1].removesuffix(".bin")
        self.chunk = int(options.get("chunk_size", DEFAULT_CHUNK))
        self.per_part = int(options.get("chunks_per_partition", CHUNKS_PER_PARTITION))

    def partitions(self):
        parts = _stored(self.path)
        if parts is None:
            raise FileNotFoundError(self.path)
        n_tokens = max((start + n for _, start, n in parts), default=0)
        n_chunks = (n_tokens + self.chunk - 1) // self.chunk
        out, k = [], 0
        for a in range(0, n_chunks, self.per_part):
            lo, hi = a * self.chunk, (a + self.per_part) * self.chunk
            while parts[k][1] + parts[k][2] <= lo:
                k += 1
            inside = list(takewhile(lambda part: part[1] < hi, islice(parts, k, None)))
            out.append(_Range(inside, self.shard, a, min(n_chunks, a + self.per_part) - 1))
        return out or [_Range([], self.shard, 0, -1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import numpy as np
        for c in range(partition.first, partition.last + 1):
            lo, hi = c * self.chunk, (c + 1) * self.chunk
            data = b"".join(files.read_range(path, 4 * (max(lo, start) - start), 4 * (min(hi, start + n) - max(lo, start)))
                            for path, start, n in partition.parts if start < hi and start + n > lo)
            yield (partition.shard, c, lo, np.frombuffer(data, "<i4").tolist())


class _Commit(WriterCommitMessage):
    def __init__(self, tokens: int):
        self.tokens = tokens


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.target = options["path"]
        folder, name = os.path.split(self.target)
        self.partial = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")

    def write(self, rows) -> _Commit:
        import numpy as np
        d = os.path.dirname(self.target)
        if d:
            os.makedirs(d, exist_ok=True)
        fd = os.open(self.partial, os.O_WRONLY | os.O_CREAT, 0o644)
        n = 0
        try:
            for r in rows:
                buf = np.asarray(r["ids"], dtype="<i4").tobytes()
                os.pwrite(fd, buf, int(r["start"]) * 4)
                n += len(buf) // 4
        finally:
            os.close(fd)
        return _Commit(n)

    def commit(self, messages) -> None:
        os.rename(self.partial, self.target)

    def abort(self, messages) -> None:
        if os.path.exists(self.partial):
            os.remove(self.partial)


class _PartsCommit(WriterCommitMessage):
    def __init__(self, parts: list[tuple[int, int, str]]):
        self.parts = parts


class _PartsWriter(DataSourceWriter):
    """Part files named by their first token and attempt; rows come sorted by ``start``."""

    def __init__(self, options: dict):
        self.target = options["path"].rstrip("/")

    def write(self, rows) -> _PartsCommit:
        import numpy as np
        files.make_folder(self.target)
        system, folder = files.locate(self.target)
        parts, out, end = [], None, None
        for r in rows:
            if out is None or r["start"] != end:
                if out:
                    out.close()
                end = int(r["start"])
                parts.append([end, 0, f"part-{end:020d}-{uuid.uuid4().hex}.bin"])
                out = system.open_output_stream(f"{folder}/{parts[-1][2]}")
            out.write(np.asarray(r["ids"], dtype="<i4").tobytes())
            end += len(r["ids"])
            parts[-1][1] += len(r["ids"])
        if out:
            out.close()
        return _PartsCommit([tuple(x) for x in parts])

    def commit(self, messages) -> None:
        files.make_folder(self.target)
        parts = sorted(x for m in messages if m for x in m.parts)
        files.write_all(f"{self.target}/{PARTS}", json.dumps(parts).encode())

    def abort(self, messages) -> None:
        for m in messages:
            for _, _, name in m.parts if m else ():
                files.remove(f"{self.target}/{name}")


class TokenBinSource(DataSource):
    """``spark.read.format("tokenbin").option("path", f).load()`` / ``df.write.format("tokenbin")``."""

    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PartsWriter(self.options) if self.options.get("parts") == "true" else _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenBinSource)


def read_bin(spark: SparkSession, path: str, shard: str | None = None, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Chunk rows of a flat int32 file."""
    register(spark)
    r = spark.read.format("tokenbin").option("path", path).option("chunk_size", str(chunk_size))
    if shard:
        r = r.option("shard", shard)
    return r.load()


def write_bin(chunks: DataFrame, target: str) -> None:
    """One shard's chunks as a flat little-endian int32 file (size = 4 x tokens) on a shared mount.
    Refuses an existing target (write guard); chunks may arrive in any partitioning."""
    if _stored(target) is not None:
        raise FileExistsError(f"{target} already exists")
    register(chunks.sparkSession)
    chunks.select("start", "ids").write.format("tokenbin").mode("append").option("path", target).save()


def write_parts(chunks: DataFrame, target: str) -> None:
    """One shard's chunks as a folder of part files, on any file system. Refuses an existing target."""
    if _stored(target) is not None:
        raise FileExistsError(f"{target} already exists")
    register(chunks.sparkSession)
    ranges = chunks.select("start", "ids").repartitionByRange("start").sortWithinPartitions("start")
    ranges.write.format("tokenbin").mode("append").option("path", target).option("parts", "true").save()


def meta_from_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(shard, tokens, dtype)`` from file sizes (no token is read); missing files are
    skipped."""
    stored = [(shard, _stored(path)) for shard, path in paths.items()]
    rows = [(shard, 4 * sum(n for _, _, n in parts)) for shard, parts in stored if parts is not None]
    return spark.createDataFrame(rows, "shard string, length bigint").select(
        "shard", T.tokens_from_bytes("length").alias("tokens"), F.lit("int32").alias("dtype"))
