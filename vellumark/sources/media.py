"""Files beside the tables: listings without content, images stored under names that don't change, and zip bundles made by tasks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.sources import sinks


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it."""
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path if "://" in path else f"file://{path}")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``folder, name, size, modified`` of all files below ``path``: folder is the first name below it (null for files right there). Content is not read. Empty files are passed over, as by all of Spark's file sources."""
    if not sinks.exists(spark, path):
        return spark.createDataFrame([], "folder string, name string, size long, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    root = path.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/").rsplit("/", 1)[-1]
    below = F.substring_index("path", f"/{root}/", -1)
    parts = F.split(below, "/")
    return files.select(F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Tasks that list folders.
LISTERS = 64


def _visible(fs: pafs.FileSystem, at: str) -> list[pafs.FileInfo]:
    """A folder's entries but for hidden ones, as Spark's file sources see them."""
    return [f for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if not f.base_name.startswith((".", "_"))]


def list_folders(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """``name, files, size, modified`` of the folders right below ``path`` with files at any depth; ``empty``: files without content count too.

    Tasks list the folders, one listing at a time, and give a row a folder; the driver sees no file.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            fs, root = filesystem(path)
            yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in _visible(fs, root) if f.type == pafs.FileType.Directory], pa.string())], ["name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files = size = modified = 0
                left = [f"{root}/{name}"]
                while left:
                    for f in _visible(fs, left.pop()):
                        if f.type == pafs.FileType.Directory:
                            left.append(f.path)
                        elif f.size or empty:
                            files, size, modified = files + 1, size + f.size, max(modified, f.mtime_ns or 0)
                if files:
                    columns = zip((name, files, size, modified // 1000), (pa.string(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC")), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], ["name", "files", "size", "modified"])

    folders = spark.range(1, numPartitions=1).mapInArrow(names, "name string").repartition(LISTERS)
    return folders.mapInArrow(run, "name string, files long, size long, modified timestamp").withColumn("modified", F.col("modified").cast("timestamp_ntz"))


#: Extensions by what a content type holds, the first that fits; others are PNG.
EXTENSIONS = (("jpeg", ".jpg"), ("jpg", ".jpg"), ("gif", ".gif"), ("svg", ".svg"), ("webp", ".webp"))


def image_name(article: Column, url: Column, content_type: Column) -> Column:
    """Twelve hexadecimal digits of article and address, and an extension: the same name for each attempt."""
    ext = F.lit(".png")
    for part, name in reversed(EXTENSIONS):
        ext = F.when(F.contains(F.coalesce(content_type, F.lit("")), F.lit(part)), name).otherwise(ext)
    return F.concat(F.left(F.sha2(F.concat_ws("\u0001", article, url), 256), F.lit(12)), ext)


def _write_whole(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """A file appears whole or not at all; a second attempt replaces it by the same bytes."""
    part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)


def store_images(images: DataFrame, path: str) -> DataFrame:
    """Writes ``article_id, original_url, content_type, content`` as files ``<article>/<name>``; gives ``article_id, original_url, filename, file_size_bytes``.

    Each image of an article is written once, by the task that holds it. The result is read once, to write it: reading it again writes the same files again.
    """
    named = images.where("content is not null").dropDuplicates(["article_id", "original_url"]).withColumn("filename", image_name(F.col("article_id"), F.col("original_url"), F.col("content_type")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        made: set[str] = set()
        for batch in batches:
            for article, name, content in zip(*(batch.column(k).to_pylist() for k in ("article_id", "filename", "content")), strict=True):
                if article not in made:
                    fs.create_dir(f"{root}/{article}", recursive=True)
                    made.add(article)
                _write_whole(fs, f"{root}/{article}/{name}", content)
            sizes = pa.array([len(c) for c in batch.column("content").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), batch.column("original_url"), batch.column("filename"), sizes], ["article_id", "original_url", "filename", "file_size_bytes"])

    return named.select("article_id", "original_url", "filename", "content").mapInArrow(run, "article_id string, original_url string, filename string, file_size_bytes long")


# Bundles. Signatures and versions of the zip format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_TOP, _DATE = 0xFFFFFFFF, (1980 - 1980) << 9 | 1 << 5 | 1
_ENTRIES = "part string, number int, name string, crc long, packed long, plain long, at long"


def _pack_entries(folder: str):
    """Deflated entries of a partition, in a file of its own; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, at, rows = uuid.uuid4().hex, 0, []
        with fs.open_output_stream(f"{root}/{part}") as out:
            for batch in batches:
                for number, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
                    data = deflate.compress(content) + deflate.flush()
                    encoded, crc = name.encode(), zlib.crc32(content)
                    head = struct.pack("<IHHHHHIIIHH", _LOCAL, 20, 1 << 11, 8, 0, _DATE, crc, len(data), len(content), len(encoded), 0) + encoded
                    out.write(head + data)
                    rows.append({"part": part, "number": number, "name": name, "crc": crc, "packed": len(data), "plain": len(content), "at": at})
                    at += len(head) + len(data)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.string()), ("number", pa.int32()), ("name", pa.string())] + [(c, pa.int64()) for c in ("crc", "packed", "plain", "at")]))

    return run


def _directory(entries: list[dict], starts: dict[str, int], size: int) -> bytes:
    """The central directory and its end, with 64-bit records where numbers need them."""
    out = bytearray()
    for e in entries:
        at, name = starts[e["part"]] + e["at"], e["name"].encode()
        extra = struct.pack("<HHQ", 1, 8, at) if at >= _TOP else b""
        out += struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if extra else 20, 1 << 11, 8, 0, _DATE, e["crc"], e["packed"], e["plain"], len(name), len(extra), 0, 0, 0, 0, min(at, _TOP)) + name + extra
    n, length = len(entries), len(out)
    if n >= 0xFFFF or size >= _TOP or length >= _TOP:
        out += struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, length, size) + struct.pack("<IIQI", _LOCATOR, 0, size + length, 1)
    return bytes(out + struct.pack("<IHHHHIIH", _END, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, _TOP), min(size, _TOP), 0))


def _join_parts(folder: str, path: str):
    """One task copies the parts behind each other, a block at a time, and writes the directory: it holds a row an entry, no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [r for b in batches for r in b.to_pylist()]
        fs, target = filesystem(path)
        source, root = filesystem(folder)
        entries.sort(key=lambda e: e["number"])
        starts: dict[str, int] = {}
        at, part = 0, f"{target}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for e in entries:
                if e["part"] not in starts:
                    starts[e["part"]] = at
                    with source.open_input_stream(f"{root}/{e['part']}") as data:
                        while block := data.read(1 << 20):
                            out.write(block)
                            at += len(block)
            out.write(_directory(entries, starts, at))
        fs.move(part, target)
        yield pa.RecordBatch.from_arrays([pa.array([len(entries)], pa.int64()), pa.array([at], pa.int64())], ["entries", "size"])

    return run


def zip_bundle(entries: DataFrame, path: str) -> int:
    """Writes ``number, name, content`` (binary) as a zip, in the order of ``number``; how many entries. Tasks deflate, one more joins what they wrote."""
    spark = entries.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    rows = entries.select(F.col("number").cast("int"), "name", "content").repartitionByRange("number").sortWithinPartitions("number")
    packed = rows.mapInArrow(_pack_entries(folder), _ENTRIES)
    try:
        done = packed.coalesce(1) if packed.rdd.getNumPartitions() == 1 else packed.repartition(1)
        return done.mapInArrow(_join_parts(folder, path), "entries long, size long").first()["entries"]
    finally:
        sinks.remove(spark, folder)


def media_files(spark: SparkSession, path: str, articles: DataFrame) -> DataFrame:
    """``name, content`` of the articles' (id) stored images, named as in a bundle."""
    if not sinks.exists(spark, path):
        return spark.createDataFrame([], "name string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    files = files.withColumns({"article": F.element_at(parts, -2), "file": F.element_at(parts, -1)})
    kept = files.join(articles.select(F.col("id").alias("article")).distinct(), "article", "left_semi")
    return kept.select(F.concat(F.lit("images/"), "article", F.lit("/"), "file").alias("name"), "content")

