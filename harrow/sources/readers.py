"""Readers of delimited files, text trees, spreadsheets and requests.

Encoding and separator are probed on the first bytes of one file through Spark's
own readers, so that any store works; the data are read by the executors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE_BYTES, PROBE_LINES = 2 << 20, 30
ENCODINGS = ("utf-8-sig", "utf-8", "cp1254", "iso-8859-9", "latin-1")
SEPARATORS = (",", ";", "\t", "|")
_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", encoding: str = "UTF-8", line_breaks: bool = True) -> DataFrame:
    """Delimited text with a header, quoted line breaks and doubled quotes; typed by schema or inferred.

    A file that may have line breaks within quotes is read by one task; without
    ``line_breaks`` large files are split.
    """
    reader = spark.read.options(header=True, multiLine=line_breaks, quote='"', escape='"', sep=sep, encoding=encoding)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str], sep: str = ",", encoding: str = "UTF-8", line_breaks: bool = True) -> DataFrame:
    """All columns as text, bad rows dropped, empty fields as empty text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.options(header=True, multiLine=line_breaks, quote='"', escape='"', sep=sep, encoding=encoding, mode="DROPMALFORMED", enforceSchema=True).schema(schema).csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _first_file(spark: SparkSession, path: str) -> tuple:
    """(file system, path, length) of a file, or of the first one by name below a folder."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return fs, p, 0
    found, files = fs.listFiles(p, True), []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            files.append((status.getPath().toString(), status))
    if not files:
        return fs, p, 0
    first = min(files, key=lambda x: x[0])[1]
    return fs, first.getPath(), first.getLen()


def read_bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """The first ``most`` bytes of a file (all, if none is given), read from its store by the driver; no more is loaded."""
    fs, p, length = _first_file(spark, path)
    n = length if most is None else min(length, most)
    jvm, out, stream = spark.sparkContext._jvm, bytearray(), fs.open(p) if n else None
    try:
        while len(out) < n:
            out += jvm.org.apache.commons.io.IOUtils.readFully(stream, min(1 << 20, n - len(out)))
    finally:
        if stream:
            stream.close()
    return bytes(out)


def _head(spark: SparkSession, path: str) -> bytes:
    return read_bytes(spark, path, PROBE_BYTES)


def detect_encoding(head: bytes) -> str:
    """The first encoding that reads the start of a file."""
    for name in ENCODINGS:
        try:
            head.decode(name)
        except UnicodeDecodeError as e:
            if e.start >= len(head) - 4 and e.reason == "unexpected end of data":  # a character cut at the end
                return name
            continue
        return name
    return "latin-1"


def detect_separator(head: bytes, encoding: str) -> str:
    """The separator that gives the most columns in the first lines; the first of equals."""
    import csv

    lines = head.decode(encoding, "ignore").splitlines()[:PROBE_LINES]
    return max(SEPARATORS, key=lambda s: max((len(r) for r in csv.reader(lines, delimiter=s)), default=0))


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first encoding that reads every line of all files at or below a path; the executors look.

    The first bytes do not tell: a first file may be a header alone, and a letter may come late.
    """
    raw = spark.read.text(path).select(F.is_valid_utf8("value").alias("utf8"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("letters"))
    none = "".join(chr(b) for b in range(128, 160) if bytes([b]).decode("cp1254", "replace") == "\ufffd")
    row = raw.agg(F.min("utf8").alias("utf8"), F.max(F.col("letters").rlike(f"[{none}]")).alias("none")).first()
    if row["utf8"] is not False:
        return "utf-8-sig" if read_bytes(spark, path, 3) == b"\xef\xbb\xbf" else "utf-8"
    return "iso-8859-9" if row["none"] else "cp1254"


def read_csv_flexible(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text of unknown encoding and separator."""
    head = _head(spark, path)
    encoding = encoding_of(spark, path)
    return recoded(read_csv(spark, path, sep=detect_separator(head, encoding), encoding=_SPARK_NAMES.get(encoding, "ISO-8859-1")), encoding)


def recoded(df: DataFrame, encoding: str) -> DataFrame:
    """A frame that was read as Latin-1, its names and texts in another single-byte encoding.

    Spark's reader takes few encodings; single-byte ones differ from Latin-1 letter by letter.
    """
    if encoding in (*_SPARK_NAMES, "latin-1"):
        return df
    pairs = [(chr(b), bytes([b]).decode(encoding, "replace")) for b in range(128, 256)]
    pairs = [(a, b) for a, b in pairs if a != b and b != "\ufffd"]
    wrong, right = ("".join(x) for x in zip(*pairs, strict=True))
    named = df.toDF(*[c.translate(str.maketrans(wrong, right)) for c in df.columns])
    return named.withColumns({c: F.translate(F.col(f"`{c}`"), wrong, right) for c, kind in named.dtypes if kind == "string"})


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An empty frame if there is no file."""
    return read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def find_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, depth) of files below a folder, by name; the shallowest or largest is one sort away."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root).select("path", "length")
    return files.withColumn("depth", F.size(F.split("path", "/"))).where(~F.col("path").rlike(r"/~\$[^/]*$"))


def largest_file(spark: SparkSession, root: str, pattern: str = "*.csv") -> str | None:
    row = find_files(spark, root, pattern).orderBy(F.col("length").desc(), "path").first()
    return row["path"] if row else None


def shallowest_file(spark: SparkSession, root: str, name: str) -> str | None:
    row = find_files(spark, root, name).orderBy("depth", "path").first()
    return row["path"] if row else None


def decoded(c: str = "content"):
    """Bytes as text in the first encoding that reads them."""

    @F.pandas_udf(T.StringType())
    def decode(content: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for name in ("utf-8-sig", "utf-8", "cp1254"):
                try:
                    return None if b is None else b.decode(name)
                except UnicodeDecodeError:
                    continue
            return b.decode("latin-1")

        return content.map(one)

    return decode(F.col(c))


def read_text_tree(spark: SparkSession, root: str, least_files: int = 0) -> DataFrame:
    """(path, category, name, text) of text files below ``root``; the first folder is the category."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.txt").load(root)
    if least_files and files.select("path").count() <= least_files:
        raise ValueError(f"{root} holds no more than {least_files} text files")
    base = root.split("://")[-1].rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^.*?" + base.replace(".", r"\.") + "/", "")
    return files.select(relative.alias("path"), F.split(relative, "/")[0].alias("category"), F.regexp_extract(relative, r"([^/]+)\.txt$", 1).alias("name"), decoded().alias("text"))


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet, read whole by the driver, all cells as text; needs a spreadsheet engine for pandas.

    An empty sheet gives its columns without rows.
    """
    import io

    cells = pd.read_excel(io.BytesIO(read_bytes(spark, path)), dtype=str).fillna("")
    return spark.createDataFrame(cells.astype(str).values.tolist(), T.StructType([T.StructField(str(c), T.StringType()) for c in cells.columns]))


#: What a row of Spark may hold; larger files are hashed as streams.
MOST_ROW_BYTES = 1 << 30


def file_digest(spark: SparkSession, path: str, pattern: str = "*", most: int = MOST_ROW_BYTES) -> DataFrame:
    """(path, sha256) of the files at or below a path; those of more than ``most`` bytes are streamed through the driver."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    jvm = spark.sparkContext._jvm
    large = []
    for row in files.where(F.col("length") > most).select("path").collect():
        fs, p = _file_system(spark, row["path"])
        stream = fs.open(p)
        try:
            large.append((row["path"], jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    small = files.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("sha256"))
    return small.unionByName(spark.createDataFrame(large, "path string, sha256 string")) if large else small


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """``df`` numbered from 1 by a key, part by part."""
    from harrow.operators.dedup import numbered_keys

    return numbered_keys(df, [F.col(c) for c in order], None, name)


def labelled_dataset(df: DataFrame, renames: dict[str, str], labels: dict[int, str], label: str = "label") -> DataFrame:
    """A downloaded set under the library's column names, its numeric labels as names."""
    from harrow.functions.records import mapped_or_fail

    out = df.withColumnsRenamed(renames)
    return out.withColumn(label, mapped_or_fail(F.col(label).cast("int"), labels))
