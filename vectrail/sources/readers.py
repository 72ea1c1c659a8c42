"""Readers: inline items, files of several formats, documents as bytes, JSON lines with deduplication."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "id string, text string, metadata string"
#: Formats by suffix; fixed values.
DOCUMENT_FORMATS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "html": "html", "htm": "html",
    "md": "markdown", "txt": "text", "csv": "csv", "json": "json", "xml": "xml",
}
#: First bytes of file kinds, as hex; fixed values.
SIGNATURES = {
    "pdf": "25504446", "png": "89504E47", "jpeg": "FFD8FF", "tiff": "49492A00", "tiff_be": "4D4D002A",
    "gif": "47494638", "bmp": "424D", "riff": "52494646", "flac": "664C6143", "mp3": "494433", "ogg": "4F676753",
}


def inline_items(spark: SparkSession, items: list | str) -> DataFrame:
    """Rows from a list of texts or of maps with id, text and metadata; an empty list raises."""
    if isinstance(items, str):
        items = [items]
    if not items:
        raise ValueError("no items")
    rows = []
    for x in items:
        if isinstance(x, str):
            rows.append((None, x, None))
        elif isinstance(x, dict):
            rows.append((x.get("id"), x.get("text"), x.get("metadata")))
        else:
            raise TypeError(f"an item is a text or a map, not {type(x).__name__}")
    return spark.createDataFrame(rows, ITEM)


def read_path(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """parquet, json, csv, orc, text or binaryFile, in any store that Spark reads."""
    if kind not in ("parquet", "json", "csv", "orc", "text", "binaryFile"):
        raise ValueError(f"unknown format: {kind}")
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def uploaded_path(uri: str, store: str) -> str:
    """Where a file of the upload store, such as ``upload://file-1``, lies below the store's folder; it has no connection."""
    address = urlsplit(uri)
    if address.scheme != "upload":
        raise ValueError(f"not in the upload store: {uri!r}")
    name = address.netloc + address.path
    if not name.strip("/") or ".." in name.split("/"):
        raise ValueError(f"no file in {uri!r}")
    return f"{store.rstrip('/')}/{name.strip('/')}"


def document_format(path: Column) -> Column:
    """Format by the lower-cased suffix; null if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in DOCUMENT_FORMATS.items() for x in pair))
    return F.try_element_at(table, suffix)


def content_kind(content: Column) -> Column:
    """Kind by the first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for kind, sign in SIGNATURES.items():
        out = F.when(F.startswith(head, F.lit(sign)), kind.split("_")[0]).otherwise(out)
    return out


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delimited_lookup(spark: SparkSession, path: str, separator: str = " : ") -> DataFrame:
    """(key, value) of lines, split once; blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    parts = F.split("value", separator, 2)
    return lines.select(F.trim(parts[0]).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))


def permissive_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): what the schema fits, and the text of what it does not."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json("value", schema + ", _bad string", options)
    whole = spark.read.text(path).where(F.trim("value") != "").select("value", parsed.alias("row"))
    good = whole.where("row._bad IS NULL").select("row.*").drop("_bad")
    return good, whole.where("row._bad IS NOT NULL").select(F.col("value").alias("_bad"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below ``path`` whose names fit a glob; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def techniques(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """(technique_id, name, description) of the attack patterns in threat bundles, by id.

    The id is that of the first reference that begins with T and digits; patterns
    without one are left out, and with ``active_only`` the revoked and deprecated.
    """
    kind = "type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,external_references:array<struct<external_id:string>>"
    bundle = spark.read.schema(f"objects array<struct<{kind}>>").option("multiLine", True).json(path)
    found = bundle.select(F.inline("objects")).where("type = 'attack-pattern'")
    ids = F.filter("external_references", lambda r: r["external_id"].rlike("^T[0-9]+"))
    found = found.withColumn("technique_id", F.get(ids, F.lit(0))["external_id"]).where("technique_id IS NOT NULL")
    if active_only:
        found = found.where("NOT coalesce(revoked, false) AND NOT coalesce(x_mitre_deprecated, false)")
    return found.select("technique_id", "name", "description").orderBy("technique_id")
