"""Source files that do not parse, per file and as rates per repository and language (problem 6)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import curly, parsers, sql_parser

# Spellings of the languages in source types and file extensions.
SPELLINGS = {
    "python": "python python3 py pyi", "java": "java", "javascript": "javascript js mjs cjs ecmascript", "sql": "sql psql pgsql plpgsql postgres postgresql ddl",
    "yaml": "yaml yml", "xml": "xml spring-xml xsd xsl pom",
}
PARSERS = {
    "python": parsers.parse_python, "java": curly.parse_java, "javascript": curly.parse_javascript, "sql": sql_parser.parse_sql,
    "yaml": parsers.parse_yaml, "xml": parsers.parse_xml,
}


def faults(text: str, language: str) -> list[parsers.Fault]:
    """All syntax errors of a text in order; none for a text that parses. An empty file is valid Python,
    Java, JavaScript, SQL and YAML, but not XML."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(1_000_000)  # frames of Python code lie on the heap; parsers.MAX_DEPTH bounds them
    try:
        return PARSERS[language](text)
    except RecursionError:
        return [parsers.Fault(1, "nested too deeply")]
    finally:
        sys.setrecursionlimit(limit)


def language_of(source_type: Column, path: Column) -> Column:
    """Language by source type in any spelling; where that is null or blank, by the path's extension.
    Null if neither names one of the six."""

    def named(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for language, words in SPELLINGS.items():
            out = F.when(word.isin(*words.split()), language).otherwise(out)
        return out

    word = F.regexp_replace(F.lower(F.trim(source_type)), r"[\s_.]+", "-")
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(F.coalesce(word, F.lit("")) == "", named(extension)).otherwise(named(word))


def syntax_report(files: DataFrame, sources: DataFrame) -> DataFrame:
    """path, repository, language, n_errors, cause (first message), line and errors (all of them): a row
    per file.

    The type of a path that was taken in several times is that of its latest row with a type. Files
    whose language is unknown have null n_errors; null contents count as empty. Paths that occur in no
    source are judged by extension. Rows of files that repeat a path give rows of their own. Contents
    are shuffled once, only where the join needs it; null paths stay, without a source.
    """
    typed = sources.filter("path IS NOT NULL").groupBy("path").agg(F.max_by("source_type", F.when(F.col("source_type").isNotNull(), F.col("ingested_at"))).alias("source_type"))
    rows = files.select("path", "repository", F.coalesce("content", F.lit("")).alias("content")).join(typed, "path", "left")
    rows = rows.select("path", "repository", language_of(F.col("source_type"), F.col("path")).alias("language"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))
        for batch in batches:
            found = [faults(t, x) if x in PARSERS else None for t, x in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([None if f is None else [{"line": x.line, "message": x.message.encode("utf-8", "replace").decode()} for x in f] for f in found], error)],
                names=["path", "repository", "language", "errors"],
            )

    parsed = rows.mapInArrow(run, "path string, repository string, language string, errors array<struct<line:int,message:string>>")
    first = F.get("errors", F.lit(0))
    return parsed.select("path", "repository", "language", F.when(F.col("errors").isNotNull(), F.size("errors")).alias("n_errors"), first["message"].alias("cause"), first["line"].alias("line"), "errors")


def syntax_rates(report: DataFrame) -> DataFrame:
    """Files, broken files and their share per repository and language."""
    return report.groupBy("repository", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count(F.when(F.col("n_errors") > 0, 1)).alias("n_broken"),
        F.round(F.avg(F.when(F.col("n_errors") > 0, 1.0).when(F.col("n_errors") == 0, 0.0)), 6).alias("broken_share"),
    )
