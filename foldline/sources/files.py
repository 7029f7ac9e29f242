"""Files of a folder as rows, with glob filters and an incremental cursor."""

from __future__ import annotations

import mimetypes
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schema of Spark's reader of whole files, which a stream must be told.
FILE_SCHEMA = StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")


def glob_pattern(glob: str) -> str:
    """Regular expression for a relative path: ``*``, ``?`` and ``[..]`` stay inside one component, and the glob matches from the right."""
    def part(piece: str) -> str:
        if piece in ("*", "?"):
            return "[^/]*" if piece == "*" else "[^/]"
        if len(piece) < 3:
            return re.escape(piece)
        inside = piece[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
        return f"(?!/)[{'^' + inside[1:] if inside[0] == '!' else inside.replace('^', chr(92) + '^')}]"

    return rf"(^|/){''.join(part(x) for x in re.findall(r'\[!?[^\]]+\]|.', glob.strip('/')))}\z"


def matches(path: Column, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> Column:
    """Column: no exclude glob matches and at least one include glob does."""
    hit = lambda globs: F.greatest(F.lit(False), F.lit(False), *[path.rlike(glob_pattern(g)) for g in globs])
    return ~hit(exclude) & hit(include)


def raw_documents(files: DataFrame, base_dir: str, source_name: str = "local", include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source_ref, url, title, content_type, updated_at, content) of rows of FILE_SCHEMA; also works on a stream.

    ``base_dir`` is the folder as paths report it, see ``resolved_dir``. The id depends on the relative path alone. Types come from the file name's ending, else octet-stream.
    """
    types = dict(mimetypes.types_map) | {".pdf": "application/pdf", ".md": "text/markdown"}
    table = F.create_map(*[F.lit(x) for kv in sorted(types.items()) for x in kv])
    inner = re.sub(r"\A[a-z0-9+.-]+:/*", "/", base_dir.rstrip("/")) + "/"  # without the scheme, which has one slash or three
    at = F.instr("path", inner) + len(inner)
    ref = F.expr("substring(path, _at)")
    rows = files.withColumn("_at", at).withColumn("source_ref", ref).where(matches(F.col("source_ref"), include, exclude))
    ending = F.lower(F.regexp_extract("source_ref", r"\.[^./]+\z", 0))
    return rows.select(
        F.substring(F.sha2(F.concat(F.lit("local:"), "source_ref"), 256), 1, 32).alias("doc_id"), "source_ref", F.col("path").alias("url"),
        F.regexp_extract("source_ref", r"[^/]+\z", 0).alias("title"), F.coalesce(F.try_element_at(table, ending), F.lit("application/octet-stream")).alias("content_type"),
        F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("updated_at"), F.lit(source_name).alias("source_name"), "modificationTime", "content",
    )


def resolved_dir(spark: SparkSession, base_dir: str) -> str:
    """The full path of a folder in its store, as Spark reports paths of files in it; raises ValueError if it is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base_dir)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(at) or not store.getFileStatus(at).isDirectory():
        raise ValueError(f"not a folder: {base_dir}")
    return store.resolvePath(at).toString()


def read_files(spark: SparkSession, base_dir: str, *, cursor: datetime | None = None, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = (), source_name: str = "local") -> DataFrame:
    """All files below ``base_dir`` that pass the globs and are at least as new as ``cursor``; corrupt ones are skipped. ``base_dir`` must be a folder."""
    base_dir = resolved_dir(spark, base_dir)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(base_dir)
    if cursor is not None:
        files = files.where(F.col("modificationTime") >= F.lit(cursor))
    return raw_documents(files, base_dir, source_name, include, exclude)


def high_water_mark(rows: DataFrame) -> datetime | None:
    """The newest modification time: the cursor of the next run."""
    return rows.agg(F.max("modificationTime")).first()[0]


def text_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_idx, text): pages of ``text`` split at form feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("page_idx", "text"))


def pdf_documents(files: DataFrame) -> DataFrame:
    """(doc_id, path, content): the PDF files among (path, content), named by the digest of their bytes; equal files are one document, at the first path."""
    rows = files.where(F.lower("path").endswith(".pdf")).withColumn("doc_id", F.concat(F.lit("pdf_"), F.substring(F.sha2("content", 256), 1, 16)))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("path", "content"), "path").alias("f")).select("doc_id", "f.path", "f.content")
