"""Block files: newline-delimited JSON records, read strictly and written in batches."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import with_error
from tidelog.model import EXTENSION, LOG_SCHEMA

#: Bytes of blocks that one task writes or reads, about, where blocks are smaller.
TASK_BYTES = 16 << 20
#: Most blocks that are named one by one to a reader.
NAMED = 32
#: A file's status as Hadoop prints it.
STATUS = re.compile(r"\w+\{path=(.*); isDirectory=(true|false)(?:; length=(\d+))?;.*")
#: A file of Spark's writer: its task, and its number in the task.
PART = re.compile(r"part-(\d+)-.*?(?:-c(\d+))?(?:\.\w+)*")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, hadoop.Path


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of a directory's own files.  The JVM is asked once for all of them, and for
    each apart only where what it prints is of another form."""
    fs, at, _ = _fs(spark, path)
    found = fs.listStatus(at)
    n, jvm, gateway = len(found), spark.sparkContext._jvm, spark.sparkContext._gateway
    objects = gateway.new_array(jvm.java.lang.Object, n)
    jvm.java.lang.System.arraycopy(found, 0, objects, 0, n)
    lines = jvm.org.apache.commons.lang3.StringUtils.join(objects, "\n").split("\n") if n else []
    read = [STATUS.fullmatch(x) for x in lines]
    if len(read) == n and all(m and (m[2] == "true" or m[3]) for m in read):
        return [(m[1].rpartition("/")[2], int(m[3])) for m in read if m[2] == "false"]
    return [(s.getPath().getName(), s.getLen()) for s in found if s.isFile()]


def each(f: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
    """f of each item, in order, several at once: calls of a file system mostly wait."""
    items = list(items)
    if len(items) < 2:
        return [f(x) for x in items]
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(f, items))


def ensure_dir(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    if not fs.exists(at):
        fs.mkdirs(at)
    elif not fs.getFileStatus(at).isDirectory():
        raise NotADirectoryError(f"Path is not a directory: {path}")


def ensure_file(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    if not fs.exists(at):
        fs.create(at, False).close()
    elif not fs.getFileStatus(at).isFile():
        raise IsADirectoryError(f"Path is not a file: {path}")


def list_files(spark: SparkSession, path: str, extension: str = EXTENSION) -> list[str]:
    """Names of the directory's own files with the extension, in order."""
    return sorted(n for n, _ in listed(spark, path) if n.endswith(extension))


def rename_block(spark: SparkSession, path: str, old: str, new: str) -> None:
    fs, _, make = _fs(spark, path)
    if not fs.rename(make(f"{path}/{old}"), make(f"{path}/{new}")):
        raise OSError(f"{path}/{old} can't be renamed to {new}")


def delete_block(spark: SparkSession, path: str, bid: str) -> None:
    fs, _, make = _fs(spark, path)
    fs.delete(make(f"{path}/{bid}"), False)


def block_stats(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """bid and size in bytes of each block file (of `names` alone, if given), from one listing."""
    wanted = None if names is None else set(names)
    rows = sorted((n, size) for n, size in listed(spark, path) if (n.endswith(EXTENSION) if wanted is None else n in wanted))
    return spark.createDataFrame(rows, "bid string, size long")


def number_lines(texts: DataFrame, text: str, separator: str = "\n", name: str | None = None) -> DataFrame:
    """Columns of `texts` but its text, with line_no (from 1) and line.

    With `name`, texts are files: what follows the last separator is an unfinished line
    and is dropped, and an empty line is an error that names the file."""
    cut = F.split(F.col(text), re.escape(separator), -1)
    if name:  # the tail goes before there are rows, so no later check can meet it
        cut = F.slice(cut, F.lit(1), F.size(cut) - 1)
    rest = [c for c in texts.columns if c != text]
    rows = texts.select(*rest, F.posexplode(cut).alias("_pos", "line"))
    if name:
        empty = F.raise_error(F.concat(F.lit("Empty line in file:"), F.col(name), F.lit(" at line:"), F.col("_pos").cast("string")))
        rows = rows.withColumn("line", F.when(F.col("line") == "", empty).otherwise(F.col("line")))
    return rows.select(*rest, (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str, separator: str = "\n", extension: str = EXTENSION, names: list[str] | None = None) -> DataFrame:
    """bid, line_no, line of the block files of a directory (of `names` alone, if given).  A file
    is read by one task: files are blocks, and blocks are bounded in size."""
    names = list_files(spark, path, extension) if names is None else names
    if not names:
        return spark.createDataFrame([], "bid string, line_no long, line string")
    bid = F.col("_metadata.file_name")
    found, least, most = {}, min(names), max(names)
    if len(names) > NAMED:
        found = {n: size for n, size in listed(spark, path) if least <= n <= most and n.endswith(extension)}
    others = sorted(found.keys() - set(names))
    if len(names) <= NAMED or len(others) > NAMED or len(found) - len(others) < len(set(names)) or any(n[0] in "_." for n in names):
        files = spark.read.text([f"{path}/{n}" for n in names], wholetext=True).select(bid.alias("bid"), "value")
    else:  # the directory is listed once; its files are chosen by the ends of the names, and few by name
        chosen = bid.between(least, most) & ~bid.isin(others) if others else bid.between(least, most)
        files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{extension}").where(chosen).select(bid.alias("bid"), "value")
        files = files.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(sum(found.values()) / TASK_BYTES)))
    return number_lines(files, "value", separator, "bid")


def parse_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """LOG_SCHEMA of bid, line_no, line; a line that is no record fails the query, or, if not
    `strict`, has its fault as `error`."""
    found = with_error(lines.select("bid", "line_no", "line"))
    message = F.concat(F.lit("Invalid JSON entry in "), F.col("bid"), F.lit(" at lineNo:"), F.col("line_no").cast("string"), F.lit(": "), F.col("error"))
    id_ = F.try_variant_get("_value", "$.id", "string")
    if strict:
        id_ = F.when(F.col("error").isNull(), id_).otherwise(F.raise_error(message).cast("string"))
    numbers = [F.try_variant_get("_value", f"$.{n}", "double").cast(k).alias(n) for n, k in (("_oid", "int"), ("_rid", "long"), ("_seq", "long"))]
    return found.select(id_.alias("id"), *numbers, "bid", "line_no", F.col("line").alias("record"), *([] if strict else [F.when(F.col("error").isNotNull(), message).alias("error")]))


def load(spark: SparkSession, path: str, names: list[str] | None = None, strict: bool = True) -> DataFrame:
    """All lines of all blocks as records.  Repeated keys of an object: the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    names = list_files(spark, path) if names is None else names
    if not names:
        return spark.createDataFrame([], LOG_SCHEMA if strict else f"{LOG_SCHEMA}, error string")
    return parse_lines(read_lines(spark, path, names=names), strict)


def append(records: DataFrame, path: str, first: int, files: int = 1, tag: str = "") -> list[str]:
    """Writes rows (_seq, record) as new block files in _seq order; returns their names.

    Each batch has files of its own, written aside and renamed when all are whole, so a
    line that a crash has cut off is never continued.  Where blocks are small, a task writes several."""
    spark = records.sparkSession
    aside = f"{path}/_writing-{uuid.uuid4().hex}"
    ordered, rows = records.select("_seq", "record"), 0
    tasks = min(files, spark.sparkContext.defaultParallelism)
    if tasks < files:
        found = ordered.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("record") + 1), F.lit(0)).alias("bytes")).first()
        tasks, rows = min(files, max(tasks, math.ceil(found["bytes"] / TASK_BYTES))), found["n"]
    ordered = ordered.repartitionByRange(tasks, "_seq") if tasks > 1 else ordered.coalesce(1)
    most = math.ceil(rows / files) if tasks < files else 0  # 0: a task's rows are one file
    ordered.sortWithinPartitions("_seq").select("record").write.option("maxRecordsPerFile", most).text(aside, lineSep="\n")
    fs, at, make = _fs(spark, aside)
    found = [(m, n) for n, size in listed(spark, aside) if size and (m := PART.fullmatch(n))]
    parts = [n for *_, n in sorted((int(m[1]), int(m[2] or 0), n) for m, n in found)]
    names = [block_name(first, f"{tag}{i:05d}") for i in range(len(parts))]

    def move(pair: tuple[str, str]) -> None:
        if not fs.rename(make(f"{aside}/{pair[0]}"), make(f"{path}/{pair[1]}")):
            raise OSError(f"{aside}/{pair[0]} can't be renamed to {pair[1]}")

    each(move, zip(parts, names, strict=True))
    fs.delete(at, True)
    return names


def block_name(first: int, tag: str) -> str:
    """Blocks of later numbers sort later."""
    return f"b{first:018d}-{tag}{EXTENSION}"


class LineWriter:
    """An open block file that takes lines one at a time."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        fs, _, make = _fs(spark, path)
        if hasattr(fs, "getRawFileSystem"):  # a checksummed local file shows what was flushed only when it is closed
            fs = fs.getRawFileSystem()
        self.name, self.size = name, 0
        self.out = fs.create(make(f"{path}/{name}"), False)

    def write(self, line: str) -> None:
        data = f"{line}\n".encode()
        self.out.write(bytearray(data))
        self.out.hflush()
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
