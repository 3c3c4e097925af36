"""Which importer reads a file, what reads it if that fails, and bounded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels of support in their order; the extensions that a type of file stands for; types that are texts, whose own extension may decide.
LEVELS = ("native_structured", "native_text", "optional_advanced", "fallback_only", "unsupported")
EXTENSIONS = {
    "text": (".txt", ".log"), "markdown": (".md", ".markdown"), "rst": (".rst",), "org": (".org",), "latex": (".tex", ".latex"), "yaml": (".yaml", ".yml"), "csv": (".csv",), "tsv": (".tsv",),
    "json": (".json",), "jsonl": (".jsonl",), "ipynb": (".ipynb",), "xml": (".xml",), "html": (".html", ".htm", ".xhtml"), "srt": (".srt",), "vtt": (".vtt",), "python": (".py",), "javascript": (".js",),
    "typescript": (".ts",), "java": (".java",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".hpp"), "rust": (".rs",), "go": (".go",), "sql": (".sql",), "shell": (".sh",), "powershell": (".ps1",),
    "docx": (".docx",), "pptx": (".pptx",), "xlsx": (".xlsx",), "epub": (".epub",), "pdf": (".pdf",), "zip": (".zip",),
}
TEXTS = ("text", "markdown", "rst", "org", "latex", "yaml", "csv", "tsv", "jsonl", "xml", "html", "srt", "vtt", "python", "javascript", "typescript", "java", "c", "cpp", "rust", "go", "sql", "shell", "powershell")


def capabilities(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """importer, level, extensions, fallbacks, available: the table of importers, in their order (level, name)."""
    table = spark.createDataFrame(rows, "importer string, level string, extensions array<string>, fallbacks array<string>, available boolean")
    return table.withColumn("place", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))).orderBy("place", "importer")


def choose(files: DataFrame, table: DataFrame) -> DataFrame:
    """Add importer, used and error to files (file_id, file_type, extension, wanted, failed, fallback).

    An importer fits if it knows an extension of the file's type, or, for texts, the file's own; native ones are tried by
    fit, level and name, unavailable ones skipped. A wanted one must fit, too. Where it has `failed`, the fallback reads the
    file, if the importer lists it and it fits. Errors: unknown_importer, importer_does_not_support_type,
    optional_importer_unavailable, unsupported_type, fallback_not_allowed, import_failed.
    """
    known = F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    table = F.broadcast(table.select("importer", "level", "place", "extensions", "fallbacks", "available"))  # a row an importer
    listed = table.agg(F.sort_array(F.collect_list(F.struct("place", "importer", "level", "extensions", "fallbacks", "available"))).alias("_all"))
    own = F.coalesce(F.element_at(known, F.col("file_type")), F.when(F.coalesce("extension", F.lit("")) != "", F.array("extension")), F.array().cast("array<string>"))
    rows = files.withColumn("_own", own).join(F.broadcast(listed))  # one row

    def fit(c, explicit: bool):  # noqa: ANN001, ANN202
        text = F.col("file_type").isin(*TEXTS) & F.array_contains(c["extensions"], F.col("extension")) & (F.lit(True) if explicit else c["level"] == "native_text")
        return F.when(F.arrays_overlap(c["extensions"], F.col("_own")), 1).when(text, F.when(F.col("file_type") == "text", 0).otherwise(2))

    def asked(name):  # noqa: ANN001, ANN202
        return F.get(F.filter("_all", lambda c: c["importer"] == name), 0)

    def wanted_error(c):  # noqa: ANN001, ANN202
        return F.when(c.isNull(), "unknown_importer").when(c["level"] == "unsupported", "unsupported_type").when(fit(c, True).isNull(), "importer_does_not_support_type").when(~c["available"], "optional_importer_unavailable")

    native = F.filter("_all", lambda c: c["level"].isin("native_structured", "native_text") & c["available"] & fit(c, False).isNotNull())
    best = F.get(F.sort_array(F.transform(native, lambda c: F.struct(fit(c, False).alias("fit"), c["place"].alias("place"), c["importer"].alias("importer")))), 0)["importer"]
    rows = rows.withColumns({"_best": best, "_wanted": asked(F.col("wanted"))})
    error = F.when(F.col("wanted").isNotNull(), wanted_error(F.col("_wanted"))).when(F.col("_best").isNull(), "unsupported_type")
    rows = rows.withColumn("error", error).withColumn("importer", F.when(F.col("error").isNull(), F.coalesce("wanted", "_best")))
    other, first = asked(F.col("fallback")), asked(F.col("importer"))
    rows = rows.withColumns({"_first": first, "_other": other})
    later = F.when(F.col("fallback").isNull(), "import_failed").when(~F.array_contains(F.col("_first.fallbacks"), F.col("fallback")), "fallback_not_allowed").otherwise(wanted_error(F.col("_other")))
    rows = rows.withColumn("_later", F.when(F.col("failed") & F.col("importer").isNotNull(), later))
    used = F.when(F.col("failed"), F.when(F.col("_later").isNull(), F.col("fallback"))).otherwise(F.col("importer"))
    return rows.withColumns({"used": F.when(F.col("importer").isNotNull(), used), "error": F.coalesce("error", "_later")}).drop("_own", "_all", "_best", "_wanted", "_first", "_other", "_later")


def read_text(files: DataFrame, content: str, most_bytes: int = 5 << 20, most_chars: int = 5_000_000) -> DataFrame:
    """Add text, encoding and error: the text of each file's bytes by its mark, with \\n as the only line end.

    Errors: empty_file (no bytes, or blank), file_too_large, binary_file (not in its encoding), document_too_complex.
    """
    data = F.col(content)
    starts = lambda h: F.hex(F.substring(data, 1, len(h) // 2)) == h
    n = F.octet_length(data)
    kind = F.when(starts("FFFE0000"), "utf-32-le").when(starts("0000FEFF"), "utf-32-be").when(starts("EFBBBF"), "utf-8-sig").when(starts("FFFE"), "utf-16-le").when(starts("FEFF"), "utf-16-be").otherwise("utf-8")
    rows = files.withColumn("encoding", kind)
    rest = lambda k: F.substring(data, k + 1, 1 << 30)
    e = F.col("encoding")
    # try_* functions and checks of length, so that no row's bytes fail the job
    wide = lambda name, k, unit: F.when((n - k) % unit == 0, F.decode(rest(k), name))
    text = F.when(e == "utf-8", F.try_validate_utf8(data.cast("string"))).when(e == "utf-8-sig", F.try_validate_utf8(rest(3).cast("string"))).when(e == "utf-16-le", wide("UTF-16LE", 2, 2)).when(e == "utf-16-be", wide("UTF-16BE", 2, 2)).when(e == "utf-32-le", wide("UTF-32", 0, 4)).otherwise(wide("UTF-32", 0, 4))
    small = F.coalesce(n, F.lit(0)).between(1, most_bytes)
    rows = rows.withColumn("text", F.when(small, F.regexp_replace(text, r"\r\n?", "\n")))
    error = F.when(F.coalesce(n, F.lit(0)) == 0, "empty_file").when(n > most_bytes, "file_too_large").when(F.col("text").isNull(), "binary_file").when(~F.col("text").rlike(r"(?U)\S"), "empty_file").when(F.length("text") > most_chars, "document_too_complex")
    rows = rows.withColumn("error", error)
    return rows.withColumns({"text": F.when(F.col("error").isNull(), F.col("text")), "encoding": F.when(F.col("error").isNull(), F.col("encoding"))})
