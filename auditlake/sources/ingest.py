"""Corpus inventory, decoding and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import constants as K
from auditlake.functions.text import strip



def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """File inventory with content and route; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumn("route", route(F.col("path")))


def route(path: Column) -> Column:
    """Loader by lower-case suffix; anything unknown is read as text."""
    suffix = F.regexp_extract(F.lower(path), r"[^/]\.([^./]+)$", 1)
    return (
        F.when(suffix == "pdf", "pdf").when(suffix == "docx", "docx")
        .when(suffix.isin("png", "jpg", "jpeg"), "image").otherwise("txt")
    )


def latin2_table() -> tuple[str, str]:
    """Characters at which Latin-1 and Latin-2 differ, by rule from the two encodings."""
    pairs = [(bytes([i]).decode("latin-1"), bytes([i]).decode("iso8859-2")) for i in range(0xA0, 0x100)]
    differ = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in differ), "".join(b for _, b in differ)


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-2 (single bytes, so nothing is lost)."""
    as_latin1 = F.decode(content, "ISO-8859-1")
    source, target = latin2_table()
    return F.when(F.is_valid_utf8(content), content.cast("string")).otherwise(F.translate(as_latin1, source, target))


def triage_page(native: Column, ocr: Column, minimum: int = K.SCANNED_MIN_CHARS) -> Column:
    """Struct (text, is_scanned, origin): native text if long enough, else OCR, else whatever there is."""
    n, o = strip(F.coalesce(native, F.lit(""))), F.coalesce(ocr, F.lit(""))

    def pack(text, scanned, origin):
        return F.struct(text.alias("text"), F.lit(scanned).alias("is_scanned"), F.lit(origin).alias("origin"))

    return (
        F.when(F.length(n) >= minimum, pack(n, False, "native")).when(F.length(o) >= minimum, pack(o, False, "ocr"))
        .otherwise(pack(F.when(n != "", n).otherwise(o), True, "scan"))
    )


def assemble_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_no, text, is_scanned) to one text per document.

    The pages of one document are gathered because they are one value of it.
    """
    joined = F.array_join(
        F.transform(F.filter(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"] != ""), lambda p: p["text"]), "\n\n")
    return pages.groupBy(*keys).agg(joined.alias("full_text"), F.bool_or("is_scanned").alias("is_scanned"), F.count(F.lit(1)).alias("page_count"))


def table_markdown(rows: DataFrame, keys: list[str], widest: bool = False, cell_chars: int | None = None) -> DataFrame:
    """(keys, row_no, cells) to Markdown; rows keep the header's width, or the widest row's.

    Cells are cleaned row by row before the rows of a table meet, and cut to
    ``cell_chars`` characters if that is given.
    """
    clean = rows.withColumn("cells", F.transform("cells", lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))).filter(
        F.exists("cells", lambda c: c != ""))
    width = F.max(F.size("cells")) if widest else F.min_by(F.size("cells"), "row_no")
    shape = clean.groupBy(*keys).agg(width.alias("n_cols"), F.min("row_no").alias("header_no"))

    def line(cells):
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("n_cols"))), F.lit(1), F.col("n_cols"))
    text = line(padded if cell_chars is None else F.transform(padded, lambda c: F.substring(c, 1, cell_chars)))
    rule = line(F.array_repeat(F.lit("---"), F.col("n_cols")))
    lines = clean.join(shape, keys).select(*keys, "row_no", F.when(F.col("row_no") == F.col("header_no"), F.concat(text, F.lit("\n"), rule)).otherwise(text).alias("line"))
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"]), "\n").alias("markdown"))


def reference_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, countries) of a sanctions file or of a folder of them; an empty or missing one gives empty lists."""
    schema = "entities array<struct<name:string,country:string,type:string>>, high_risk_countries array<string>"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    else:
        raw = spark.createDataFrame([], schema)
    return raw.select(F.inline("entities")), raw.select(F.explode("high_risk_countries").alias("country"))
