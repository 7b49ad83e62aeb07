"""Delimited extracts: typed reading, legacy code pages, control-character separators."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An unquoted empty field is NULL and a quoted one is the empty text.  The reader can
# tell them apart only through a marker that no extract contains.
_EMPTY = "\u0001\u0002empty\u0002\u0001"


def _options(sep: str, quote: str, escape: str, header: bool, date_format: str, timestamp_format: str) -> dict:
    return {
        "sep": sep,
        "quote": quote,
        "escape": escape,
        "header": header,
        "dateFormat": date_format,
        "timestampFormat": timestamp_format,
        "timestampNTZFormat": timestamp_format,
    }


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def data_schema(schema: T.StructType) -> T.StructType:
    """Columns of an extract: the table's in order, without the load number."""
    return T.StructType([f for f in schema.fields if f.name != "_load_id"])


def code_page_name(encoding: str) -> str:
    """The codec behind a name as databases and editors spell it: ``UTF8``, ``WIN1250``, ``LATIN2``; an unknown one is an error."""
    name = encoding.strip().lower().replace("_", "-")
    if re.fullmatch(r"win-?\d+", name):
        name = f"windows-{name[3:].lstrip('-')}"
    return codecs.lookup(name).name


def _read_by_spark(encoding: str) -> bool:
    """Whether Spark reads the encoding itself; other code pages must have one byte per letter."""
    if encoding in SPARK_READS:
        return True
    for lead in range(128, 256):
        if not bytes([lead]).decode(encoding, "ignore") and any(
            len(bytes([lead, after]).decode(encoding, "ignore")) == 1 and bytes([lead, after]).decode(encoding, "ignore") != bytes([after]).decode(encoding, "ignore")
            for after in (0x41, 0xA1, 0xB0)
        ):
            raise ValueError(f"{encoding} has letters of several bytes; write the extract in UTF-8")
    return False


#: Codecs that Spark's reader has itself, and what it calls them.
SPARK_READS = {
    "utf-8": "UTF-8", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32": "UTF-32", "ascii": "US-ASCII",
    "iso8859-1": "ISO-8859-1",
}


def read_extract(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ";",
    encoding: str = "UTF-8",
    null: str = "",
    header: bool = True,
    date_format: str = "dd.MM.yyyy",
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    quote: str = '"',
    escape: str = '"',
    multi_line: bool = False,
) -> DataFrame:
    """Typed rows of a delimited extract; a row that does not fit the schema fails the job.

    ``multi_line`` is needed only for line ends inside quotes and stops files from being split.
    """
    encoding = code_page_name(encoding)
    single_byte = not _read_by_spark(encoding)
    df = (
        spark.read.schema(data_schema(schema))
        .options(**_options(sep, quote, escape, header, date_format, timestamp_format))
        .option("encoding", SPARK_READS.get(encoding, "ISO-8859-1"))
        .option("nullValue", null)
        .option("emptyValue", _EMPTY)
        .option("mode", "FAILFAST")
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
        .csv(path)
    )
    fixed = {c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)) for c in _strings(df)}
    if single_byte:
        fixed = {c: decoded(v, encoding) for c, v in fixed.items()}
    return df.withColumns(fixed) if fixed else df


def write_extract(
    df: DataFrame,
    path: str,
    sep: str = ";",
    encoding: str = "UTF-8",
    header: bool = True,
    date_format: str = "dd.MM.yyyy",
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    quote: str = '"',
    escape: str = '"',
    mode: str = "error",
) -> None:
    """The writing side of ``read_extract``."""
    encoding = code_page_name(encoding)
    single_byte = not _read_by_spark(encoding)
    if single_byte:
        df = df.withColumns({c: encoded(F.col(c), encoding) for c in _strings(df)})
    (
        df.write.options(**_options(sep, quote, escape, header, date_format, timestamp_format))
        .option("encoding", SPARK_READS.get(encoding, "ISO-8859-1"))
        .option("nullValue", "")
        .option("emptyValue", quote + quote)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode(mode)
        .csv(path)
    )


def code_page(encoding: str) -> tuple[str, str]:
    """Characters 80..FF as Latin-1 and as the given single-byte code page, where they differ."""
    latin, native = [], []
    for byte in range(0x80, 0x100):
        try:
            there = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            continue
        if there != chr(byte):
            latin.append(chr(byte))
            native.append(there)
    return "".join(latin), "".join(native)


def decoded(c: Column, encoding: str) -> Column:
    """Text that was read byte for byte, put into its real code page; stays in the JVM."""
    latin, native = code_page(encoding)
    return F.translate(c, latin, native)


def encoded(c: Column, encoding: str) -> Column:
    latin, native = code_page(encoding)
    return F.translate(c, native, latin)


BEL, BS = "\x07", "\x08"


def read_control_dsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows separated by BEL and quoted by BS, so that text may hold any printable character."""
    return read_extract(spark, path, schema, sep=BEL, quote=BS, escape=BS, header=False, date_format="yyyy-MM-dd")


def write_control_dsv(df: DataFrame, path: str) -> None:
    write_extract(df, path, sep=BEL, quote=BS, escape=BS, header=False, date_format="yyyy-MM-dd")


def lookup_values(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """An inline code list."""
    return spark.createDataFrame(rows, ddl)


def list_columns(df: DataFrame, left_out: tuple[str, ...] = ("_load_id",)) -> DataFrame:
    """Ordered column names with nullability, without technical ones."""
    kept = [f for f in df.schema.fields if f.name not in left_out]
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(kept, start=1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean")
