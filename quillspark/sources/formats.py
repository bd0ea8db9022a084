"""Document formats and MIME types as dimension tables, and routing as joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OOXML = "application/vnd.openxmlformats-officedocument."
#: format, family, primary MIME type
FORMATS = [
    ("docx", "office", OOXML + "wordprocessingml.document"), ("xlsx", "office", OOXML + "spreadsheetml.sheet"), ("pptx", "office", OOXML + "presentationml.presentation"),
    ("doc", "legacy", "application/msword"), ("xls", "legacy", "application/vnd.ms-excel"), ("ppt", "legacy", "application/vnd.ms-powerpoint"),
    ("rtf", "legacy", "application/rtf"), ("pps", "legacy", "application/vnd.ms-powerpoint.slideshow"), ("pdf", "pdf", "application/pdf"),
    ("txt", "text", "text/plain"), ("csv", "text", "text/csv"), ("tsv", "text", "text/tab-separated-values"), ("json", "text", "application/json"), ("jsonl", "text", "application/x-ndjson"),
    ("html", "markup", "text/html"), ("xml", "markup", "text/xml"), ("md", "markup", "text/markdown"), ("eml", "mail", "message/rfc822"),
    ("png", "image", "image/png"), ("jpg", "image", "image/jpeg"), ("jpeg", "image", "image/jpeg"), ("webp", "image", "image/webp"), ("tiff", "image", "image/tiff"), ("tif", "image", "image/tiff"),
    ("bmp", "image", "image/bmp"), ("gif", "image", "image/gif"), ("heic", "image", "image/heic"), ("heif", "image", "image/heif"), ("avif", "image", "image/avif"),
]
ALIASES = [("markdown", "md"), ("htm", "html")]
#: MIME types beyond the primary ones that are looked up; OpenDocument is known but has no parser.
OTHER_MIMES = [
    ("application/vnd.oasis.opendocument.text", "docx"), ("application/vnd.oasis.opendocument.spreadsheet", "xlsx"), ("application/vnd.oasis.opendocument.presentation", "pptx"),
    ("application/vnd.ms-word", "doc"), ("text/rtf", "rtf"), ("application/x-pdf", "pdf"), ("application/acrobat", "pdf"), ("application/csv", "csv"), ("text/tsv", "tsv"),
    ("application/jsonlines", "jsonl"), ("application/json-lines", "jsonl"), ("application/xhtml+xml", "html"), ("application/xml", "xml"), ("text/x-markdown", "md"), ("image/jpg", "jpg"), ("image/x-ms-bmp", "bmp"),
]
#: Known only from a format to its MIME types, not the other way round.
REVERSE_ONLY = [("csv", "text/comma-separated-values"), ("tsv", "application/tab-separated-values"), ("jsonl", "text/x-ndjson"), ("md", "text/plain"), ("heic", "image/x-heic"), ("heif", "image/x-heif"), ("avif", "image/x-avif")]
UNPARSED = ("application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet", "application/vnd.oasis.opendocument.presentation")

MIMES = [(m, f) for f, _, m in FORMATS if f not in ("jpeg", "tif")] + OTHER_MIMES


def formats(spark: SparkSession) -> DataFrame:
    """``ext, format, family, mime``: every extension that routes, aliases included."""
    known = {f: (f, fam, mime) for f, fam, mime in FORMATS}
    return spark.createDataFrame([(f, *known[f]) for f in known] + [(a, *known[f]) for a, f in ALIASES], "ext string, format string, family string, mime string")


def mime_types(spark: SparkSession, extra: list[tuple[str, str]] = (), without: list[str] = ()) -> DataFrame:
    """``mime, format``, with registered additions and removals."""
    table = dict(MIMES) | {m.lower(): f for m, f in extra}
    return spark.createDataFrame([(m, f) for m, f in table.items() if m not in without], "mime string, format string")


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the last path segment; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def route(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``ext, format, family, supported`` by extension. The dimension has some 30 rows, so it is broadcast."""
    spark = files.sparkSession
    keyed = files.withColumn("ext", extension(F.col(path_col)))
    return keyed.join(F.broadcast(formats(spark).drop("mime")), "ext", "left").withColumn("supported", F.col("format").isNotNull())


def normalize_mime(mime: Column) -> Column:
    return F.trim(F.split_part(F.lower(mime), F.lit(";"), F.lit(1)))


def format_of_mime(rows: DataFrame, mime_col: str = "mime", **registry) -> DataFrame:
    """Add ``normalized`` and ``format`` (null where the type isn't known)."""
    types = mime_types(rows.sparkSession, **registry).withColumnRenamed("mime", "normalized")
    return rows.withColumn("normalized", normalize_mime(F.col(mime_col))).join(F.broadcast(types), "normalized", "left")


def suggest_format(rows: DataFrame, mime_col: str = "mime") -> DataFrame:
    """Add ``suggested``: the known format, else one by the type's category, else null."""
    known = format_of_mime(rows, mime_col)
    n = F.col("normalized")
    image = F.lit("png")
    for part, fmt in reversed([("png", "png"), ("jpg", "jpg"), ("jpeg", "jpg"), ("webp", "webp"), ("tif", "tiff"), ("bmp", "bmp"), ("gif", "gif"), ("heic", "heic"), ("heif", "heif"), ("avif", "avif")]):
        image = F.when(n.contains(part), fmt).otherwise(image)
    app = F.when(n.contains("json"), "json").when(n.contains("xml"), "xml").when(n.contains("pdf"), "pdf")
    guess = F.when(n.startswith("text/"), "txt").when(n.startswith("image/"), image).when(n.startswith("application/"), app)
    return known.withColumn("suggested", F.coalesce("format", guess))


def mimes_of_format(spark: SparkSession) -> DataFrame:
    """``format, mimes``: all MIME types of each format in order."""
    primary = [(f, m) for f, _, m in FORMATS]
    more = [(f, m) for m, f in OTHER_MIMES if m not in UNPARSED]
    return spark.createDataFrame(sorted({*primary, *more, *REVERSE_ONLY}), "format string, mime string").groupBy("format").agg(F.array_sort(F.collect_set("mime")).alias("mimes"))


MAGIC = [
    ("png", "89504E470D0A1A0A", 0), ("jpeg", "FFD8FF", 0), ("gif", "474946383761", 0), ("gif", "474946383961", 0), ("tiff", "49492A00", 0), ("tiff", "4D4D002A", 0), ("bmp", "424D", 0), ("ico", "00000100", 0),
    ("emf", "01000000", 0), ("wmf", "D7CDC69A", 0),
]


def image_kind(content: Column) -> Column:
    """Image format by leading bytes; under 12 bytes it is unknown."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F.lit("unknown")
    brand = F.substring(head, 17, 8)
    for name, brands in (("avif", ("61766966", "61766973")), ("heif", ("6D696631", "6D736631")), ("heic", ("68656963", "68656978", "68657663", "68657678"))):
        kind = F.when((F.substring(head, 9, 8) == "66747970") & brand.isin(*brands), name).otherwise(kind)
    kind = F.when((F.substring(head, 1, 8) == "52494646") & (brand == "57454250"), "webp").otherwise(kind)
    for name, lead, _ in reversed(MAGIC):
        kind = F.when(head.startswith(lead), name).otherwise(kind)
    return F.when(F.octet_length(content) < 12, "unknown").otherwise(kind)
