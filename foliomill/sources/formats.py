"""Book files of any registered format: routed by extension, read where they lie.

A format is a function from files (path, content) to blocks. Files are read by Spark's own binary source, so any file system that Spark knows will do; each format
gets the files with its extension, and files without a format become error rows. A new format is registered, nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import file_extension
from foliomill.sources import html_blocks

#: path, seq (order in the file), type, text.
Reader = Callable[[DataFrame], DataFrame]
COLUMNS = ("path", "seq", "type", "text")


class Formats:
    """Readers by extension (lower case, with its dot), each with the name of its parser."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, Reader]] = {}

    def register(self, extension: str, parser: str, reader: Reader) -> Formats:
        self._known[extension.lower()] = (parser, reader)
        return self

    def parser_of(self, path: Column) -> Column:
        """Name of the parser for a file, null if its format is unknown."""
        ext, out = file_extension(F.element_at(F.split(path, "/"), -1)), F.lit(None).cast("string")
        for known, (parser, _) in self._known.items():
            out = F.when(ext == known, parser).otherwise(out)
        return out

    def route(self, files: DataFrame, path: str = "path") -> DataFrame:
        """Adds extension, parser and error: `unsupported format: .x` where there is no parser."""
        name = F.element_at(F.split(F.coalesce(F.col(path), F.lit("")), "/"), -1)
        routed = files.withColumns({"extension": file_extension(name), "parser": self.parser_of(F.coalesce(F.col(path), F.lit("")))})
        return routed.withColumn("error", F.when(F.col("parser").isNull(), F.concat(F.lit("unsupported format: "), F.col("extension"))))

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        """Blocks of all files below a folder: path, seq, type, text, error. A file that no reader takes is one row with an error."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
        routed = self.route(files)
        out = routed.where("parser IS NULL").select("path", F.lit(0).alias("seq"), F.lit("error").alias("type"), F.lit("").alias("text"), "error")
        for extension, (_, reader) in self._known.items():
            blocks = reader(routed.where(F.col("extension") == extension).select("path", "content"))
            out = out.unionByName(blocks.select(*COLUMNS).withColumn("error", F.lit(None).cast("string")))
        return out


def plain_text(files: DataFrame) -> DataFrame:
    """One paragraph for each run of lines between blank ones."""
    body = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    parts = F.filter(F.transform(F.split(body, r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return files.select("path", F.posexplode(parts).alias("seq", "text"), F.lit("paragraph").alias("type"))


def xhtml(files: DataFrame) -> DataFrame:
    keyed = files.select("path", F.xxhash64("path").alias("doc_key"), F.decode("content", "UTF-8").alias("html"))
    return html_blocks.blocks(keyed, "doc_key").join(keyed.select("doc_key", "path"), "doc_key").select(*COLUMNS)


def default_formats() -> Formats:
    return Formats().register(".txt", "text", plain_text).register(".html", "xhtml", xhtml).register(".xhtml", "xhtml", xhtml)


def settings(spark: SparkSession, folder: str, prefix: str = "spark.foliomill.") -> DataFrame:
    """Settings and prompt files as rows (name, value): `name = value` lines of *.conf, whole *.txt files by their name, and settings of the session, which win."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.conf").text(folder)
    pair = F.regexp_extract("value", r"^\s*([A-Za-z0-9_.-]+)\s*=\s*(.*?)\s*$", 1), F.regexp_extract("value", r"^\s*([A-Za-z0-9_.-]+)\s*=\s*(.*?)\s*$", 2)
    named = lines.select(pair[0].alias("name"), pair[1].alias("value"), F.lit(0).alias("rank")).where("name <> ''")
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    prompts = texts.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), "value", F.lit(1).alias("rank"))
    own = [(k.removeprefix(prefix), v, 2) for k, v in spark.conf.getAll.items() if k.startswith(prefix)]
    session = spark.createDataFrame(own, "name string, value string, rank int")
    return named.unionByName(prompts).unionByName(session).groupBy("name").agg(F.max_by("value", F.struct("rank", "value")).alias("value"))


def stamped(df: DataFrame, column: str = "updated_at", now: Column | None = None) -> DataFrame:
    """df with the time of the query (the same for all its rows) as `yyyy-MM-dd HH:mm:ss`; a given time for tests and replays."""
    return df.withColumn(column, F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd HH:mm:ss"))
