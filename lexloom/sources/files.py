"""Reading document files and writing results."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.text import extension, normalize_newlines, normalize_text
from ..session import materialize

LISTED = "path string, modificationTime timestamp, length long"
BINARY_SCHEMA = f"{LISTED}, content binary"
#: Rows and bytes of files that a task holds at a time.
HELD_ROWS, HELD_BYTES = 1000, 8 << 20


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as rows. A glob limits listing, and the content is only read for
    rows and plans that use it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _split(address: str) -> tuple[str, str]:
    """Scheme and host of an address, empty for local files, and the path from its slash on."""
    scheme, colon, rest = address.partition(":")
    if not colon or scheme == "file":
        return "", "/" + (rest if colon else address).lstrip("/")
    host, _, path = rest.lstrip("/").partition("/")
    return f"{scheme}://{host}", f"/{path}"


def _store(host: str):
    """The file system of a scheme and host, and what its paths begin with there."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if not host:
        return LocalFileSystem(), ""
    store, root = FileSystem.from_uri(host)
    return store, root.rstrip("/")


def _entries(folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """(name, time in milliseconds, bytes, whether it is a folder) of what a folder holds, one by
    one where its storage allows. Names that Spark's readers leave out are left out."""
    import os

    from pyarrow.fs import FileSelector, FileType

    host, path = _split(folder)
    if not host:
        with os.scandir(path) as found:
            for entry in found:
                try:
                    at = entry.stat()
                except FileNotFoundError:                            # gone since, or a link to nothing
                    continue
                yield entry.name, at.st_mtime_ns // 1_000_000, at.st_size, entry.is_dir()
        return
    store, root = _store(host)
    for entry in store.get_file_info(FileSelector(root + path)):
        yield (entry.base_name, (entry.mtime_ns or 0) // 1_000_000, entry.size or 0,
               entry.type == FileType.Directory)


def _hidden(name: str) -> bool:
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _list_folders(batches):
    """What the folders of a batch of rows hold, as rows of the same kind."""
    import pyarrow as pa

    kind = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")),
                      ("length", pa.int64()), ("folder", pa.bool_())])

    def batch(rows):
        path, time, length, folder = zip(*rows)
        times = pa.array([1000 * t for t in time], pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(path), times, pa.array(length), pa.array(folder)], schema=kind)

    rows = []
    for given in batches:
        for parent in given.column("path").to_pylist():
            for name, time, length, folder in _entries(parent):
                if not _hidden(name):
                    rows.append((f"{parent.rstrip('/')}/{name}", time, length, folder))
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder (or those that a pattern
    names), like `scan_files` without content, which leaves empty files out. The folders of one depth are listed by the
    tasks of one job, so the driver holds no list, however many files there are."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    roots = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root)
    if not roots:
        raise FileNotFoundError(path)
    given = [(f.getPath().toString(), f.getModificationTime(), f.getLen(), f.isDirectory()) for f in roots
             if f.getPath().getName() == root.getName() or not _hidden(f.getPath().getName())]
    kind = "path string, at long, length long, folder boolean"
    level = spark.createDataFrame(given, kind).select(
        "path", F.timestamp_millis("at").alias("modificationTime"), "length", "folder")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = level.where(~F.col("folder"))
    while not (folders := level.where("folder")).isEmpty():
        level = materialize(folders.repartition(parts, "path").mapInArrow(
            _list_folders, f"{LISTED}, folder boolean"))
        found = found.unionByName(level.where(~F.col("folder")))
    return found.drop("folder")


def _read_files(batches):
    """The content of each listed file, a few files at a time."""
    import pyarrow as pa

    def batch(rows, content):
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(content, pa.binary())],
                                          names=[*rows.schema.names, "content"])

    stores = {}
    for given in batches:
        first, content, held = 0, [], 0
        for i, address in enumerate(given.column("path").to_pylist()):
            host, path = _split(address)
            if host not in stores:
                stores[host] = _store(host)
            store, root = stores[host]
            with store.open_input_stream(root + path) as file:
                content.append(file.read())
            held += len(content[-1])
            if held >= HELD_BYTES or len(content) >= HELD_ROWS:
                yield batch(given.slice(first, len(content)), content)
                first, content, held = i + 1, [], 0
        if content:
            yield batch(given.slice(first), content)


def read_contents(listed: DataFrame) -> DataFrame:
    """Add the `content` of listed files. They are dealt over all tasks by their path."""
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.repartition(parts, "path").mapInArrow(_read_files, f"{kind}, content binary")


def accept_files(files: DataFrame, max_bytes: int = fv.MAX_FILE_BYTES):
    """(accepted, rejected): the extension and size gates. Rejected files keep
    a reason and drop their content."""
    named = files.withColumn("extension", extension(F.col("path")))
    known = F.col("extension").isin(fv.ACCEPTED_EXTENSIONS)
    # A plain comparison on the length reaches the source, which then does not
    # even open the larger files.
    accepted = named.where((F.col("length") <= max_bytes) & known)
    rejected = named.drop("content").where(~known | (F.col("length") > max_bytes))
    return accepted, rejected.withColumn(
        "reason", F.when(~known, "unsupported_extension").otherwise("too_large"))


def assign_keys(files: DataFrame, by_content: bool = False) -> DataFrame:
    """Add `document_id`, `filename` and `stored_name`. The id is a hash of
    path and content, so a file delivered twice keeps its id; by content alone,
    one that comes again under another name does too. The time in the stored
    name is UTC, whatever the session's time zone."""
    name = F.substring_index("path", "/", -1)
    utc = F.to_utc_timestamp("modificationTime", F.current_timezone())
    digest = F.sha2("content", 256)
    digest = digest if by_content else F.sha2(F.concat_ws("|", "path", digest), 256)
    return (files.withColumn("document_id", digest).withColumn("filename", name)
            .withColumn("stored_name", F.concat_ws(
                "_", F.date_format(utc, fv.STORED_NAME_TIME_FORMAT), name)))


def decode_text(content: Column) -> Column:
    """UTF-8 when the bytes are valid, else Latin-1; line ends become LF."""
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return normalize_newlines(text)


def extract_text(files: DataFrame) -> DataFrame:
    """Add `text` and `status` for text files. Other accepted types need a
    parser that delivers pages or paragraphs: their text is NULL and the status
    says so, so that no error message is ever taken for content."""
    is_text = F.col("extension").isin(fv.TEXT_EXTENSIONS)
    return (files.withColumn("text", F.when(is_text, decode_text(F.col("content"))))
            .withColumn("status", F.when(is_text, "ok").otherwise("needs_parser")))


def read_text_files(spark: SparkSession, path: str, max_bytes: int = fv.MAX_FILE_BYTES,
                    listed: DataFrame | None = None) -> DataFrame:
    """(path, text, ...) of the text files under a folder, in any mixture of upper
    and lower case in their extensions. `unread_files` has all the others. A list of
    the files that is there already spares another."""
    accepted, _ = accept_files(list_files(spark, path) if listed is None else listed, max_bytes)
    texts = accepted.where(F.col("extension").isin(fv.TEXT_EXTENSIONS))
    return extract_text(read_contents(texts)).drop("content")


def unread_files(spark: SparkSession, path: str, max_bytes: int = fv.MAX_FILE_BYTES,
                 listed: DataFrame | None = None) -> DataFrame:
    """(path, length, reason) of the files under a folder that `read_text_files`
    leaves out: unsupported, too large, or in need of a parser."""
    accepted, rejected = accept_files(list_files(spark, path) if listed is None else listed, max_bytes)
    parsed = accepted.where(~F.col("extension").isin(fv.TEXT_EXTENSIONS))
    return rejected.select("path", "length", "reason").unionByName(
        parsed.select("path", "length", F.lit("needs_parser").alias("reason")))


def to_documents(files: DataFrame, by_content: bool = False) -> DataFrame:
    """Accepted files as rows of the document table, text normalised, with the
    status of the extraction. Times come from the file, so that a repeated delivery
    gives the same rows."""
    rows = extract_text(assign_keys(files, by_content))
    return rows.select(
        "document_id", "filename", F.col("path").alias("filepath"),
        F.when(F.col("text").isNotNull(), normalize_text(F.col("text"))).alias("text"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("modificationTime").alias("created_at"),
        F.col("modificationTime").alias("updated_at"), "status")


def file_outcomes(files: DataFrame, max_bytes: int = fv.MAX_FILE_BYTES, by_content: bool = False) -> DataFrame:
    """Every file as a document row. Rejected ones have no text, the reason as their
    status, and an id of path, size and time, since their content is not opened. Files that
    are only listed are read here."""
    accepted, rejected = accept_files(files, max_bytes)
    if "content" not in files.columns:
        accepted = read_contents(accepted)
    time = F.col("modificationTime")
    others = rejected.select(
        F.sha2(F.concat_ws("|", "path", "length", F.unix_micros(time)), 256).alias("document_id"),
        F.substring_index("path", "/", -1).alias("filename"), F.col("path").alias("filepath"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("metadata"),
        time.alias("created_at"), time.alias("updated_at"), F.col("reason").alias("status"))
    return to_documents(accepted, by_content).unionByName(others)


def write_files(files: DataFrame, folder: str) -> None:
    """Write (path, content) rows as one file each below a shared folder, whatever
    storage its address names; a path's leading slash is dropped. Each file is moved
    into place when it is whole, so a repeated task leaves the same files and a reader
    never meets half of one."""
    def run(rows):
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        made = set()
        for row in rows:
            path = f"{root}/{row.path.lstrip('/')}"
            parent, name = path.rsplit("/", 1)
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(f"{parent}/_{name}.part") as out:
                out.write(bytes(row.content))
            store.move(f"{parent}/_{name}.part", path)
    files.select("path", "content").foreachPartition(run)


def write_markdown(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per document, key and Markdown."""
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, from a `json` column."""
    df.select(F.col("json").alias("value")).write.mode(mode).text(path)
