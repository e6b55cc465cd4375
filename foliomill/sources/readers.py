"""Readers of text data."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.llm_json import ENTITY_TYPES
from ..functions.text import chapter_body, chapter_number, section_title

#: Groups whose rows are listed a second time.
OUTER_DEITY_GROUPS = ["goo", "fod", "ta"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '//')")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, number: str | None = None) -> DataFrame:
    """JSON lines; blank lines and // lines are no data. Strict raises on a bad line, else it is dropped, as are rows whose field ``number`` is none."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    rows = _lines(spark, path).select(F.from_json("value", schema if strict else f"{schema}, _bad string", {"mode": mode, "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    if strict:
        return rows.select("r.*")
    rows = rows.filter("r._bad is null")
    if number:
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), f"$.{number}", "variant"))
        rows = rows.filter(F.col(f"r.{number}").isNotNull() & kind.isNotNull() & (kind != "STRING"))
    return rows.select("r.*").drop("_bad")


def jsonl_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't JSON of the schema."""
    return _lines(spark, path).withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})).filter("r._bad is not null").select("value")


ENTITY = "struct<canonical_name:string,entity_type:string,aliases:array<string>,is_spoiler:int,meta:string>"


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON document {"entities": [...]}; meta stays JSON text. A bad document, entity or repeated canonical_name raises."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"entities array<{ENTITY}>", {"mode": "FAILFAST"}).alias("d"))
    rows = text.select(F.explode("d.entities").alias("e")).select("e.*").withColumn("meta", F.coalesce("meta", F.lit("{}")))
    blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    bad = blank(F.col("canonical_name")) | ~F.coalesce(F.col("entity_type").isin(ENTITY_TYPES), F.lit(False)) | ~F.coalesce(F.col("is_spoiler").isin(0, 1), F.lit(False))
    bad = bad | F.col("aliases").isNull() | F.exists("aliases", blank) | ~F.startswith(F.col("meta"), F.lit("{"))
    if wrong := rows.filter(F.coalesce(bad, F.lit(True))).limit(1).collect():
        raise ValueError(f"{wrong[0]['canonical_name']} isn't an entity")
    if twice := rows.groupBy("canonical_name").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"{twice[0]['canonical_name']} is there twice")
    return rows


_documents: dict[tuple[str, str, str], tuple[int, DataFrame]] = {}


def _changed(spark: SparkSession, path: str) -> int:
    """When what is at path was last changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return max([s.getModificationTime() for s in [fs.getFileStatus(p), *fs.listStatus(p)]])


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON document, read once by a session and kept in memory until reset_documents() or until the document changes."""
    key, now = (spark.sparkContext.applicationId, path, schema), _changed(spark, path)
    if key in _documents and _documents[key][0] == now:
        return _documents[key][1]
    if key in _documents:
        _documents.pop(key)[1].unpersist()
    for k in [k for k in _documents if k[0] != key[0]]:
        del _documents[k]  # of a session that has ended
    _documents[key] = now, spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).cache()
    return _documents[key][1]


def reset_documents() -> None:
    """Forget all documents that are kept."""
    while _documents:
        _documents.popitem()[1][1].unpersist()


def _sections(data: bytes) -> list[str]:
    """The HTML sections of an EPUB archive, in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tag = lambda e: e.tag.rpartition("}")[2]
        package = next(e.attrib["full-path"] for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if tag(e) == "rootfile")
        root, folder = ElementTree.fromstring(z.read(package)), posixpath.dirname(package)
        files = {e.attrib["id"]: unquote(e.attrib["href"]) for e in root.iter() if tag(e) == "item"}
        return [z.read(posixpath.normpath(posixpath.join(folder, files[e.attrib["idref"]]))).decode("utf-8", "replace") for e in root.iter() if tag(e) == "itemref"]


def read_epub(spark: SparkSession, path: str, book_id: str) -> DataFrame:
    """(book_id, pos, html) of every section of the EPUB archives under path; extract_chapters() takes them."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                html = _sections(data)
                yield pa.RecordBatch.from_arrays([pa.array([book_id] * len(html), pa.string()), pa.array(range(len(html)), pa.int64()), pa.array(html, pa.string())], ["book_id", "pos", "html"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "book_id string, pos long, html string")


def extract_chapters(sections: DataFrame, check: bool = True) -> DataFrame:
    """(book_id, chapter_num, chapter_title, raw_text) of sections (book_id, html) that are chapters; repeats and gaps raise."""
    title = section_title(F.col("html"))
    rows = sections.select("book_id", chapter_number(title).alias("chapter_num"), title.alias("chapter_title"), chapter_body(F.col("html"), title).alias("raw_text")).filter("chapter_num is not null")
    if check:
        bad = rows.groupBy("book_id").agg(F.count("*").alias("n"), F.count_distinct("chapter_num").alias("d"), F.min("chapter_num").alias("lo"), F.max("chapter_num").alias("hi")).filter("n <> d or lo <> 1 or hi <> n").limit(1).collect()
        if bad:
            raise ValueError(f"chapters of {bad[0]['book_id']} repeat or leave gaps")
    return rows


def probe_sections(sections: DataFrame, expected: int) -> DataFrame:
    """Sections, those with a chapter title, and whether that is within 2 % of what is expected."""
    hit = F.count_if(chapter_number(section_title(F.col("html"))).isNotNull())
    return sections.agg(F.count("*").alias("sections"), hit.alias("chapters")).withColumn("within", F.abs(F.col("chapters") - expected) <= expected * 0.02)


def template_calls(text: str, name: str) -> list[list[str]]:
    """Top-level arguments of each balanced {{name ...}}."""
    out, at = [], 0
    while (start := text.find("{{" + name, at)) >= 0:
        depth, cut, parts = 0, start + 2 + len(name), []
        for m in re.finditer(r"\{\{|\}\}|\|", text[start:]):
            token, pos = m[0], start + m.start()
            depth += (token == "{{") - (token == "}}")
            if token == "|" and depth == 1 or depth == 0:
                parts.append(text[cut:pos].strip())
                cut = pos + 1
            if depth == 0:
                at = pos + 2
                break
        else:
            break
        out.append([p for p in parts if p])
    return out


def parse_pathways(text: str, overrides: dict[str, dict[str, str]] | None = None, outer: list[str] = OUTER_DEITY_GROUPS) -> list[dict]:
    """Rows of the two charts; a group's Great Old One is carried from its first row, rows of odd size are skipped."""
    name = lambda cell: (m[1].strip() if (m := re.search(r"\{\{Seq\|([^}|]+)", cell)) else "")
    charts = re.split(r"(?i)=+\s*Chart of Non-?Standard Sequences\s*=+", text)
    out, carried = [], {}
    for chart, category in zip(charts[:2], ("standard", "non-standard"), strict=False):
        for parts in template_calls(chart, "SequenceChart/mid"):
            group = next((p[6:].strip() for p in parts if p.startswith("group=")), None)
            cells = [p for p in parts if not p.startswith("group=") and not re.match(r"(?i)rowspan\s*=", p)]
            if group is None or len(cells) not in (10, 11):
                continue
            titles = [name(c) for c in cells]
            if category == "standard":
                if len(titles) == 11:
                    carried[group] = titles[10]
                old = carried.get(group, "")
            else:
                old = titles[10] if len(titles) == 11 else titles[9]
            row = {"pathway": titles[9], "category": category, "true_god": titles[9], "great_old_one": old, **(overrides or {}).get(group, {}), "sequences": [{"tier": 9 - i, "title": t} for i, t in enumerate(titles[:10])]}
            out.append(row)
            if category == "standard" and group in outer:
                out.append({**row, "category": "outer-deity"})
    return out


PATHWAY = "pathway string, category string, true_god string, great_old_one string, sequences array<struct<tier:int,title:string>>, pos long"


def read_pathways(spark: SparkSession, path: str) -> DataFrame:
    """Pathways of wikitext documents, one row each, with their place in the document."""

    def run(batches):
        for b in batches:
            rows = [{**r, "pos": i} for t in b.column(0).to_pylist() for i, r in enumerate(parse_pathways(t or ""))]
            kind = pa.schema([("pathway", pa.string()), ("category", pa.string()), ("true_god", pa.string()), ("great_old_one", pa.string()), ("sequences", pa.list_(pa.struct([("tier", pa.int32()), ("title", pa.string())]))), ("pos", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, kind)

    return spark.read.text(path, wholetext=True).mapInArrow(run, PATHWAY)


def find_pathway(pathways: DataFrame, name: str) -> DataFrame:
    """The first pathway, in document order, that has the name or a title of it, without case."""
    low = F.lower(F.lit(name.strip()))
    hit = (F.lower("pathway") == low) | (F.lower("true_god") == low) | (F.lower("great_old_one") == low) | F.exists("sequences", lambda s: F.lower(s["title"]) == low)
    return pathways.filter(hit).orderBy("pos").limit(1)


def list_pathways(pathways: DataFrame, category: str | None = None) -> DataFrame:
    return (pathways if category is None else pathways.filter(F.col("category") == category)).select("pathway", "category")


def resolve_section(sections: DataFrame, wanted: str | int | None, regex: bool = False) -> tuple[str | None, bool]:
    """(index, found) of a page section: numbers stand for themselves, names match without case or as a pattern."""
    if wanted is None:
        return None, True
    if isinstance(wanted, int) or wanted.isdigit():
        return str(wanted), True
    hit = F.regexp_like("line", F.lit(wanted)) if regex else F.lower("line") == wanted.lower()
    first = sections.filter(hit).orderBy("byteoffset").limit(1).collect()
    return (first[0]["index"], True) if first else (None, False)


def page_body(pages: DataFrame, full: bool = False, most: int = 8000) -> DataFrame:
    """Add body and truncated."""
    text = F.col("text")
    return pages.withColumn("body", text if full else F.substring(text, 1, most)).withColumn("truncated", F.lit(False) if full else F.length(text) > most)


def member_type(ns: F.col) -> F.col:
    return F.when(ns == 14, "subcat").when(ns == 6, "file").otherwise("page")


def volume_timeline(pages: DataFrame, sections: DataFrame, volume: int) -> DataFrame:
    """(title, section, body, truncated, section_found): the timeline section of a volume's page, or else the whole page.

    pages (title, text), sections (title, line, index, byteoffset, text); a volume without a page raises.
    """
    page = pages.filter(F.regexp_like("title", F.lit(rf"(?i)^Volume[_ ]{volume}:"))).orderBy("title").limit(1)
    if page.isEmpty():
        raise ValueError(f"there is no page of volume {volume}")
    title = page.first()["title"]
    own = sections.filter((F.col("title") == title) & F.regexp_like("line", F.lit("(?i)timeline"))).orderBy("byteoffset").limit(1)
    found = page_body(own).select("title", F.col("index").alias("section"), "body", "truncated", F.lit(True).alias("section_found"))
    whole = page_body(page).select("title", F.lit(None).cast("string").alias("section"), "body", "truncated", F.lit(False).alias("section_found"))
    return whole if found.isEmpty() else found
