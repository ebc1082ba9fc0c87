"""Files to records: discovery, dispatch by path and content, parsing on the executors, typed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources import build, code, documents, wiring
from loomspan.sources.documents import Record, as_json

Parser = Callable[[str, str], Iterator[Record]]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].lower()


def _configures(path: str) -> bool:
    return _name(path).startswith(("application", "bootstrap")) or "resources" in path.lower().split("/")[:-1]


def _policy(text: str) -> bool:
    return "definition:" in text and "metadata:" in text


#: Parsers in the order in which they are asked: name, whether it reads a path and text, what it does.
REGISTRY: list[tuple[str, Callable[[str, str], bool], Parser]] = [
    ("maven", lambda p, t: _name(p) == "pom.xml", build.maven),
    ("gradle", lambda p, t: _name(p).endswith((".gradle", ".gradle.kts")), build.gradle),
    ("markdown", lambda p, t: p.endswith((".md", ".markdown")), documents.markdown),
    ("python", lambda p, t: p.endswith((".py", ".pyi")), code.python),
    ("java", lambda p, t: p.endswith(".java"), code.java),
    ("javascript", lambda p, t: p.endswith((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")), code.javascript),
    ("sql", lambda p, t: p.endswith(".sql"), code.sql),
    ("stylesheet", lambda p, t: p.endswith((".css", ".scss", ".less")), documents.stylesheet),
    ("mybatis", lambda p, t: p.endswith(".xml") and wiring.root_tag(t) == "mapper", wiring.mapper_xml),
    ("camel-xml", lambda p, t: p.endswith(".xml") and wiring.root_tag(t) in ("routes", "route", "camelContext", "routeContext"), wiring.camel_xml),
    ("spring-xml", lambda p, t: p.endswith(".xml") and wiring.root_tag(t) in ("beans", "blueprint"), wiring.spring_xml),
    ("camel-yaml", lambda p, t: p.endswith((".yaml", ".yml")) and wiring.is_camel_yaml(t), wiring.camel_yaml),
    ("config", lambda p, t: p.endswith(".properties") or (p.endswith((".yaml", ".yml")) and _configures(p) and not _policy(t)), documents.config_file),
    ("yaml", lambda p, t: p.endswith((".yaml", ".yml")), documents.yaml_file),
]


def parser_for(path: str, text: str) -> tuple[str, Parser] | None:
    return next(((name, parse) for name, reads, parse in REGISTRY if reads(path, text)), None)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, content (text) and content_hash of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def parse(files: DataFrame) -> DataFrame:
    """path, parser, tag, key, record (JSON) and error of files (path, content).

    Every file is read by the first parser of REGISTRY that takes it; files of none give no rows. An
    error is a row of tag "error" and stops no other file; null contents count as empty, null paths
    drop out. Other columns don't travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("path", "parser", "tag", "key", "record", "error")}
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parser_for(path, text or "")
                if not found:
                    continue
                name, read = found
                try:
                    rows = [(path, name, tag, str(r.get("qualified_name") or r.get("id") or r.get("path") or ""), as_json(r), None) for tag, r in read(path, text or "")]
                except Exception as e:  # noqa: BLE001 - one file's error is a row
                    rows = [(path, name, "error", "", None, f"{type(e).__name__}: {e}"[:500])]
                for row in rows:
                    for field, value in zip(out, row, strict=True):
                        out[field].append(value.encode("utf-8", "replace").decode() if isinstance(value, str) else value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in out.values()], names=list(out))

    return files.filter("path IS NOT NULL").select("path", "content").mapInArrow(run, "path string, parser string, tag string, key string, record string, error string")


SCHEMAS = {
    "section": "id string, title string, level int, breadcrumb string, section_order int, parent_id string",
    "chunk": "id string, section_id string, chunk_order int, text string, token_count int, content_hash string",
    "entity": """qualified_name string, name string, kind string, language string, file_path string, start_line int, end_line int, signature string, docstring string, parent_qualified_name string, synthetic boolean,
        embed_text string, calls array<string>, imports array<string>, extends array<string>, implements array<string>, renders array<string>, reads array<string>, writes array<string>, trigger_table string, return_type string,
        parameter_types array<string>, parameter_names array<string>""",
    "annotation": "id string, owner string, target string, name string, fqn string, attributes string, line int",
    "field": "qualified_name string, owner string, name string, type string, type_fqn string, final boolean, initialised boolean, line int",
    "type_binding": "type string, base string, arguments array<string>",
    "policy": "id string, name string, category string, severity string, guideline string, provider string, file_path string, resource_types array<string>, embed_text string",
    "db_table": "qualified_name string, name string, schema_name string, file_path string, ref_tables array<string>, embed_text string",
    "db_column": "qualified_name string, table string, name string, data_type string, nullable boolean, default string, primary_key boolean",
    "db_reference": "src string, src_column string, dst string, dst_column string",
    "db_view": "qualified_name string, name string, schema_name string, file_path string, materialized boolean, depends_on array<string>",
    "db_index": "qualified_name string, name string, table string, columns array<string>, unique boolean, file_path string",
    "config_file": "path string, format string",
    "config_property": "id string, file_path string, profile string, key string, value string, line int, refs array<string>",
    "module": "path string, build string, group_id string, artifact_id string, version string, packages array<string>, modules array<string>, source_roots array<string>",
    "dependency": "module string, gav string, group_id string, artifact_id string, scope string",
    "xml_bean": "id string, file_path string, bean_id string, names array<string>, class_name string, scope string, primary boolean, abstract boolean, parent string, refs array<struct<ref:string,via:string,property:string,multiplicity:string>>, placeholders array<string>",
    "component_scan": "file_path string, package string",
    "context_import": "file_path string, resource string",
    "sql_statement": "id string, mapper string, statement_id string, kind string, origin string, text string, file_path string, tables array<struct<name:string,mode:string>>",
    "route": "id string, route_id string, file_path string, from_uri string, steps array<struct<index:int,kind:string,uri:string,ref:string,predicate:string,conditional:boolean>>, to_uris array<struct<uri:string,conditional:boolean>>",
    "message_site": "id string, member string, kind string, broker string, name string, file_path string",
    "source_import": "src string, order int, dst string",
}


def records(parsed: DataFrame, tag: str, source: str | None = None) -> DataFrame:
    """The typed table of one tag, with the path it came from, unless the record has a path of its own.
    source: a name for the path it came from, which is there in any case then."""
    names = field_names(tag)
    own = [F.col("path").alias(source)] if source else [] if "path" in names else ["path"]
    return parsed.filter(F.col("tag") == tag).select("path", F.from_json("record", SCHEMAS[tag]).alias("r")).select(*own, *(F.col(f"r.{n}") for n in names))


def field_names(tag: str) -> list[str]:
    return [f.split()[0] for f in _fields(SCHEMAS[tag])]


def _fields(schema: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]
