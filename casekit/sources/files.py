"""Reading and writing tables: Parquet, CSV, header and cell sanitising, previews, staging."""

from __future__ import annotations

import csv
import itertools
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import sanitized_text

CORRUPT_COLUMN = "_corrupt_record"
SEPARATORS = (",", ";", "\t", "|")
FALLBACK_ENCODING = "ISO-8859-1"
ONE_FILE_A_TASK = str(1 << 40)  # bytes a task may read and what opening a file counts for
WORD_CHARACTERS = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")

_marked: set[str] = set()


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


@dataclass(frozen=True)
class CsvShape:
    """What files must share to be read together."""

    names: tuple[str, ...]
    sep: str
    encoding: str


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Data files under a path or pattern."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(pattern) or []:
        walk = files.listFiles(status.getPath(), True)
        while walk.hasNext():
            file = walk.next().getPath()
            if not file.getName().startswith(("_", ".")):
                found.append(file.toString())
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def _same(path: str) -> str:
    """A path with one slash after the scheme of local files, however many it was named with."""
    return re.sub(r"^file:/+|^/+", "file:/", path)


def _first_line(batches):
    """First line of the file that a task reads; the rest of the file is never fetched."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def _heads(spark: SparkSession, paths: list[str]) -> dict[str, bytes]:
    """First lines of all files from one job: one file a task, each task ends after its first line."""
    apart = spark.newSession()
    for setting in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        apart.conf.set(setting, ONE_FILE_A_TASK)
    apart.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    lines = apart.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )
    firsts = lines.mapInArrow(_first_line, lines.schema).where("start = 0")
    return {_same(unquote(r["file"])): bytes(r["line"]) for r in firsts.collect()}


def _not_utf8(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files with bytes that are no UTF-8 anywhere: one scan of the text."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8("value")).alias("odd"))
    return {_same(unquote(r["file"])) for r in lines.where("odd").select("file").distinct().collect()}


def guess_separator(header: str) -> str:
    """The sign of `,` `;` tab and `|` that cuts a header into most parts; quoted parts count as one."""
    return max(SEPARATORS, key=lambda sign: len(next(csv.reader([header], delimiter=sign), [])))


def csv_shapes(spark: SparkSession, paths: Sequence[str], sep: str | None, encoding: str | None) -> dict[CsvShape, list[str]]:
    """Files by header, separator and encoding, from one job over first lines and, with no encoding given, a scan."""
    files = [f for p in paths for f in _listed(spark, p)]
    odd = _not_utf8(spark, files) if encoding is None else set()
    heads = _heads(spark, files)
    shapes: dict[CsvShape, list[str]] = {}
    for file in files:
        own = encoding or (FALLBACK_ENCODING if _same(file) in odd else "UTF-8")
        header = heads.get(_same(file), b"").decode(own, "replace").removeprefix("\ufeff")
        sign = sep or guess_separator(header)
        names = tuple(unique_names(next(csv.reader([header], delimiter=sign), [])))
        if names:  # an empty file has no header and no rows
            shapes.setdefault(CsvShape(names, sign, own), []).append(file)
    return shapes


def scan_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str | None = None,
    sep: str | None = ",",
    encoding: str | None = "UTF-8",
    keep_bad_rows: bool = False,
    multi_line: bool = False,
    drop_bad_rows: bool = False,
) -> DataFrame:
    """CSV files with a header; files may differ in columns and their order, and are united by column name.

    Files are read together by header: one scan for each distinct header, however many files there are. With
    `sep=None` or `encoding=None` each file's own is found: the separator from its header, the encoding by whether
    all of it is UTF-8 (else Latin-1). Doubled quotes within quotes are one quote; with `multi_line` quoted
    line breaks are part of a cell, and a file is then read by one task.

    Rows are never dropped unless asked for: a cell that does not fit the schema is null, a short row is filled
    with nulls. `keep_bad_rows` adds the text of rows that do not fit as `_corrupt_record`, to be counted;
    `drop_bad_rows` leaves such rows out, whatever columns are asked for later.
    Without a schema every column is read as text; types come from profiling. Listing files and the job that
    reads first lines happen at once; what the driver holds is a path and a header for each file.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parts = []
    for shape, files in csv_shapes(spark, [paths] if isinstance(paths, str) else paths, sep, encoding).items():
        types = {f.name: f.dataType for f in wanted.fields} if wanted is not None else {}
        fields = [T.StructField(n, types.get(n, T.StringType())) for n in shape.names]
        if keep_bad_rows or drop_bad_rows:
            fields.append(T.StructField(CORRUPT_COLUMN, T.StringType()))
        reader = spark.read.schema(T.StructType(fields)).options(
            header=True, sep=shape.sep, encoding=shape.encoding, multiLine=multi_line, quote='"', escape='"',
            mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT_COLUMN, enforceSchema=True,
            columnPruning=not (keep_bad_rows or drop_bad_rows),
        )
        rows = reader.csv(files)
        parts.append(rows.where(~is_bad(rows)).drop(CORRUPT_COLUMN) if drop_bad_rows else rows)
    if not parts:
        return spark.createDataFrame([], wanted or T.StructType())
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if wanted is None:
        return united
    extra = [CORRUPT_COLUMN] if keep_bad_rows else []
    missing = {f.name: F.lit(None).cast(f.dataType) for f in wanted.fields if f.name not in united.columns}
    return united.withColumns(missing).select(*[f"`{f.name}`" for f in wanted.fields], *extra)


def is_bad(marked: DataFrame) -> Column:
    """Whether a row of a scan that kept bad rows did not fit.

    A row is only parsed as far as columns are asked for, so the test names every column.
    """
    cells = F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in marked.columns if c != CORRUPT_COLUMN])
    return F.col(CORRUPT_COLUMN).isNotNull() & (F.length(cells) >= 0)


def bad_rows(marked: DataFrame) -> DataFrame:
    """Number of bad rows in a scan that kept them."""
    return marked.agg(F.count_if(is_bad(marked)).alias("bad_rows"))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Zstd Parquet; statistics and dictionaries are the writer's defaults."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_clustered(
    df: DataFrame, path: str, by: Sequence[str], keys: Sequence[str] = (), mode: str = "errorifexists",
    row_group_bytes: int = 32 << 20,
) -> None:
    """Parquet in which rows with near values of `by` lie together, for tables that are filtered by these columns.

    Texts in `by` are trimmed, so that `filters` may compare them as they are (`trimmed=True`) and skip the row
    groups whose least and largest values leave out what is asked for. `keys` get Bloom filters, for lookups of single
    values. Rows that agree in all of `by` are parted by a hash of the row, so a hot place does not end in one task.
    """
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    clean = df.withColumns({c: F.trim(f"`{c}`") for c in by if c in texts}) if texts & set(by) else df
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    order = [F.col(f"`{c}`") for c in by]
    spread = clean.repartitionByRange(*order, F.xxhash64(*hashed)).sortWithinPartitions(*order)
    writer = spread.write.mode(mode).options(**{"compression": "zstd", "parquet.block.size": str(row_group_bytes)})
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV export with a header, written in parallel; nested columns become JSON text."""
    cells = [
        F.to_json(f"`{f.name}`").alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*cells).write.mode(mode).option("header", True).csv(path)


def unique_names(names: Sequence[str]) -> list[str]:
    """The names, with a number after those that an earlier one already has, capitals aside."""
    taken: set[str] = set()
    out = []
    for name in names:
        free = name if name.lower() not in taken else next(
            f"{name}_{k}" for k in itertools.count(2)
            if f"{name}_{k}".lower() not in taken and f"{name}_{k}".lower() not in {n.lower() for n in names}
        )
        taken.add(free.lower())
        out.append(free)
    return out


def sanitize_names(names: Sequence[str]) -> list[str]:
    """Names of letters, digits and underscores that do not begin with a digit and differ, also without capitals."""
    plain = []
    for raw in names:
        words = [w for w in WORD_CHARACTERS.findall(str(raw)) if w]
        joined = "_".join(words) if words else "column"
        plain.append(f"_{joined}" if joined[:1].isdigit() else joined)
    return unique_names(plain)


def sanitize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_names(df.columns))


def sanitize_cells(df: DataFrame) -> DataFrame:
    """Text columns trimmed with placeholders null and whole floats written as integers."""
    return df.select(
        *[
            sanitized_text(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.StringType, T.NullType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def preview(df: DataFrame, order_by: Sequence[str], rows: int) -> DataFrame:
    return df.orderBy(*order_by).limit(rows)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder, else the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staging"


def staging_path(spark: SparkSession, name: str) -> str:
    """A new place in this application's staging folder, which goes when the application ends."""
    folder = f"{shared_folder(spark)}/casekit-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later operators become column-pruned scans of the written table."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Stages an aggregate that several later steps start from: a job that runs while the plan is built.

    It is then computed once, survives lost executors, and keeps later plans short.
    """
    return stage(df, name)
