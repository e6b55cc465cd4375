"""Chapters to arcs to volumes to series: interval lookup, targets, planner, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

LEVELS = ["chapter", "arc", "volume", "series"]
BIN = 512


def _bin(number: Column, width: int) -> Column:
    return F.floor(number / width).cast("long")


def binned(ranges: DataFrame, width: int) -> DataFrame:
    """Each range once for each bin of numbers that it touches: (of_book, _bin, lo, hi, other columns)."""
    own = [c for c in ranges.columns if c not in ("book_id", "range_start", "range_end")]
    bins = F.when(F.col("range_start") <= F.col("range_end"), F.sequence(_bin(F.col("range_start"), width), _bin(F.col("range_end"), width))).otherwise(F.array().cast("array<bigint>"))
    return ranges.select(F.col("book_id").alias("of_book"), F.explode_outer(bins).alias("_bin"), F.col("range_start").alias("lo"), F.col("range_end").alias("hi"), *own)


def assign_ranges(chapters: DataFrame, ranges: DataFrame, strict: bool = False) -> DataFrame:
    """Chapters with the columns of the range that holds their number (ranges: a few disjoint ones per book).

    An equi join on the book (a null book is a book) and a bin of numbers, with the bounds as its residual: a chapter meets the ranges of
    its bin only, and a large book is as many keys as it has bins. With strict, a chapter in no range raises, whatever is selected or filtered
    afterwards: each of the range's columns is guarded, since a filter on a plain one would make the join an inner one, and so is the row.
    """
    own = [c for c in ranges.columns if c not in ("book_id", "range_start", "range_end")]
    bounds = binned(ranges, BIN).filter("_bin is not null").withColumnRenamed("_bin", "of_bin").withColumn("in_range", F.lit(True))
    holds = F.col("book_id").eqNullSafe(F.col("of_book")) & (_bin(F.col("chapter_num"), BIN) == F.col("of_bin")) & F.col("chapter_num").between(F.col("lo"), F.col("hi"))
    out = chapters.join(bounds, holds, "left" if strict else "inner")
    if strict:
        outside = F.raise_error(F.concat(F.lit("no range holds chapter "), F.col("chapter_num").cast("string")))
        out = out.filter(F.when(F.col("in_range"), F.lit(True)).otherwise(outside)).withColumns({c: F.when(F.col("in_range"), F.col(c)).otherwise(outside) for c in own})
    return out.drop("of_book", "of_bin", "lo", "hi", "in_range")


def gaps(chapters: DataFrame) -> DataFrame:
    """Numbers after which a book isn't contiguous or that repeat: (book_id, chapter_num, next_num)."""
    w = Window.partitionBy("book_id").orderBy("chapter_num")
    return chapters.withColumn("next_num", F.lead("chapter_num").over(w)).filter("next_num is not null and next_num <> chapter_num + 1").select("book_id", "chapter_num", "next_num")


def prefixes(chunks: DataFrame) -> DataFrame:
    """Each chapter's prefixes in chunk order, joined by a blank line."""
    items = F.array_sort(F.collect_list(F.struct("chunk_index", "contextual_prefix")))
    return chunks.groupBy("book_id", "chapter_id").agg(F.array_join(F.transform(items, lambda x: x["contextual_prefix"]), "\n\n").alias("prefixes"))


def chapter_targets(chunks: DataFrame) -> DataFrame:
    """One target a chapter: its number as range, "Chapter n: title" as label, its prefixes in chunk order; other columns from its first chunk."""
    own = [c for c in ("volume", "volume_name", "arc", "arc_name", "content_kind") if c in chunks.columns]
    items = F.array_sort(F.collect_list(F.struct("chunk_index", "contextual_prefix")))
    first = F.min_by(F.struct("chapter_num", "chapter_title", *own), "chunk_index")
    rows = chunks.groupBy("book_id", "chapter_id").agg(first.alias("x"), F.transform(items, lambda i: i["contextual_prefix"]).alias("contextual_prefixes"))
    label = F.concat(F.lit("Chapter "), F.col("x.chapter_num"), F.lit(": "), F.col("x.chapter_title"))
    return rows.select("book_id", "chapter_id", F.col("x.chapter_num").alias("range_start"), F.col("x.chapter_num").alias("range_end"), label.alias("label"), *[F.col(f"x.{c}").alias(c) for c in own], "contextual_prefixes")


def _rolled(summaries: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """Range, number of inputs and label of each group; with texts (label, content), the inputs too, in reading order."""
    sums = [F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"), F.count("*").alias("inputs")]
    if {"label", "content"} <= set(summaries.columns):
        items = F.array_sort(F.collect_list(F.struct("range_start", "range_end", "label", "content")))
        sums.append(F.transform(items, lambda i: F.struct(i["label"].alias("label"), i["content"].alias("content"))).alias("children"))
    return summaries.groupBy(*keys).agg(*sums).withColumn("label", label)


def arc_targets(summaries: DataFrame) -> DataFrame:
    """Chapter summaries by arc, side stories too; the label is the volume's and the arc's name."""
    return _rolled(summaries, ["book_id", "volume", "volume_name", "arc", "arc_name", "content_kind"], F.concat("volume_name", F.lit(" - "), "arc_name"))


def volume_targets(arcs: DataFrame) -> DataFrame:
    """Main arcs by volume; volume 0 isn't one. The label is "Volume n: name"."""
    rows = arcs.filter("content_kind = 'main' and volume > 0")
    return _rolled(rows, ["book_id", "volume", "volume_name"], F.concat(F.lit("Volume "), F.col("volume"), F.lit(": "), F.col("volume_name")))


def series_targets(volumes: DataFrame, titles: DataFrame) -> DataFrame:
    """One target a book, labelled by its title or else its id; titles are small enough for Spark to choose the join."""
    return _rolled(volumes, ["book_id"], F.col("book_id")).join(titles, "book_id", "left").withColumn("label", F.coalesce("title", "label")).drop("title")


#: Word budgets and the layout of prompts.
MAX_WORDS = {"chapter": 200, "arc": 400, "volume": 400, "series": 600}
SYSTEM = [
    "Summarize only the supplied range.",
    "Do not include future events, later identities, or canon not present in the supplied input.",
    "Write concise narrative prose.",
    "Preserve concrete names, events, and causes when supplied.",
]


def numbered(items: Column) -> Column:
    """Lines "1. x", "2. y"."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def prompts(targets: DataFrame, level: str) -> DataFrame:
    """Targets of a level with system, user and max_words of what a model is asked."""
    line = lambda name, *parts: F.concat(F.lit(f"{name}: "), *parts)
    if level == "chapter":
        named = lambda n: F.concat(F.col(n).cast("string"), F.lit(" - "), F.col(f"{n}_name"))
        body = [line("Volume", named("volume")), line("Arc", named("arc")), line("Content kind", "content_kind"), F.lit(""), F.lit("Contextual prefixes:"), numbered(F.col("contextual_prefixes"))]
    else:
        kind = F.col("content_kind") if level == "arc" else F.lit("main")
        lines = F.transform("children", lambda c: F.concat(c["label"], F.lit(": "), c["content"]))
        body = [line("Level", F.lit(level)), line("Content kind", kind), F.lit(""), F.lit("Input summaries:"), numbered(lines)]
    user = F.concat_ws("\n", line("Target", "label"), line("Book", "book_id"), *body)
    return targets.withColumns({"system": F.lit(" ".join(SYSTEM)), "user": user, "max_words": F.lit(MAX_WORDS[level])})


def reading_order(rows: DataFrame) -> DataFrame:
    """By book, range and label, names in the order of the Unicode collation."""
    return rows.orderBy(F.collate("book_id", "UNICODE"), "range_start", "range_end", F.collate("label", "UNICODE"))


def logical_key(level: Column) -> Column:
    return F.concat_ws("|", level, "book_id", "range_start", "range_end", "label")


def plan_next(targets: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """Missing targets (level, key) of the first level that misses any."""
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    missing = targets.join(existing.select("key"), "key", "left_anti").withColumn("place", place)
    first = missing.agg(F.min("place").alias("first"))
    out = missing.join(F.broadcast(first), F.col("place") == F.col("first")).select("level", "key")
    return out if limit is None else out.orderBy("key").limit(limit)


def summary_metadata(summaries: DataFrame, chapters: DataFrame) -> DataFrame:
    """Counts of the distinct volumes, arcs, their names and kinds of the chapters in each summary's range, and meta: JSON that depends on the level."""
    own = ["volume", "volume_name", "arc", "arc_name", "content_kind"]
    spans = binned(summaries, BIN)
    held = chapters.select("book_id", _bin(F.col("chapter_num"), BIN).alias("in_bin"), "chapter_num", *own)
    met = spans.join(held, F.col("book_id").eqNullSafe(F.col("of_book")) & (F.col("in_bin") == F.col("_bin")) & F.col("chapter_num").between(F.col("lo"), F.col("hi")), "left")
    met = met.drop("book_id").withColumnsRenamed({"of_book": "book_id", "lo": "range_start", "hi": "range_end"})
    main = (F.col("content_kind") == "main") & (F.col("volume") > 0)
    size = lambda c, when=None: F.size(F.collect_set(F.col(c) if when is None else F.when(when, F.col(c)))).cast("long")  # noqa: E731  bounded: numbers and names of volumes, arcs and kinds
    keys = [c for c in ("book_id", "level", "range_start", "range_end", "label", "content") if c in summaries.columns]
    rows = met.groupBy(*keys).agg(
        *[size(c).alias(f"{c}_count") for c in own],
        *[size(c, main).alias(f"main_{c}_count") for c in own[:2]],
        *[F.min(c).alias(c) for c in own],
        *[F.min(F.when(main, F.col(c))).alias(f"main_{c}") for c in own[:2]],
    )
    every = F.to_json(F.struct("volume", F.col("volume_name").alias("volumeName"), "arc", F.col("arc_name").alias("arcName"), F.col("content_kind").alias("contentKind")))
    volume = F.to_json(F.struct(F.col("main_volume").alias("volume"), F.col("main_volume_name").alias("volumeName"), F.lit("main").alias("contentKind")))
    meta = F.when(F.col("level").isin("chapter", "arc"), every).when(F.col("level") == "volume", volume).otherwise(F.to_json(F.struct(F.lit("main").alias("contentKind"))))
    return rows.withColumn("meta", meta).drop(*own, "main_volume", "main_volume_name")


def mixed(meta: DataFrame) -> DataFrame:
    """Add valid: one volume, arc, name of each and kind for chapters and arcs; one main volume and name for volumes."""
    one = lambda *names: F.forall(F.array(*[F.col(f"{n}_count") for n in names]), lambda n: n == 1)
    ok = F.when(F.col("level").isin("chapter", "arc"), one("volume", "volume_name", "arc", "arc_name", "content_kind")).when(F.col("level") == "volume", one("main_volume", "main_volume_name")).otherwise(True)
    return meta.withColumn("valid", ok)


def validated(meta: DataFrame) -> DataFrame:
    """Summaries with their meta; one of mixed metadata raises."""
    why = F.concat(F.lit("a summary has mixed metadata: "), F.concat_ws(" ", "level", "book_id", "range_start", "range_end"))
    return mixed(meta).withColumn("meta", F.when(F.col("valid"), F.col("meta")).otherwise(F.raise_error(why))).drop("valid")


def first_summaries(summaries: DataFrame, order: str) -> DataFrame:
    """One summary of each logical key: that of the smallest order."""
    keys = ["level", "book_id", "range_start", "range_end", "label"]
    rest = [c for c in summaries.columns if c not in keys]
    return summaries.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def missing_chapters(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, chapter_num) without a chunk, from chapters (chapter_id, book_id, chapter_num) and chunks (chapter_id)."""
    return chapters.join(chunks.select("chapter_id"), "chapter_id", "left_anti").select("book_id", "chapter_num").orderBy("book_id", "chapter_num")


def chunk_coverage(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chapters of each book, those with chunks and those without."""
    done = chunks.select("chapter_id").distinct().withColumn("done", F.lit(1))
    rows = chapters.join(done, "chapter_id", "left").groupBy("book_id").agg(F.count("*").alias("total"), F.count("done").alias("chunked"))
    return rows.withColumn("missing", F.col("total") - F.col("chunked"))


def assert_coverage(chapters: DataFrame, chunks: DataFrame) -> None:
    """Raises unless every chapter has a chunk."""
    for r in chunk_coverage(chapters, chunks).filter("missing > 0").limit(1).collect():
        raise ValueError(f"chunk coverage incomplete for {r['book_id']}: {r['chunked']}/{r['total']} chapters have chunks")


def first_groups(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """The n largest groups of one kind, then by first chapter: main groups only, if there is any."""
    sizes = rows.groupBy(*group, "content_kind").agg(F.count("*").alias("n"), F.min("chapter_num").alias("first"))
    kinds = sizes.agg(F.max((F.col("content_kind") == "main").cast("int")).alias("has_main"))  # one row
    rows = sizes.join(F.broadcast(kinds), (F.col("has_main") == 0) | (F.col("content_kind") == "main") | F.col("has_main").isNull()).drop("has_main")
    return rows.orderBy(F.desc("n"), "first", *group).limit(max(n, 0))


def smallest(rows: DataFrame, group: list[str], n: int, by: str = "chapter_num") -> DataFrame:
    """The n rows of each group that come first; none if n isn't positive."""
    if n <= 0:
        return rows.limit(0)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(by))).filter(F.col("place") <= n).drop("place")


def cap_rows(rows: DataFrame, cap: int, by: list[str]) -> DataFrame:
    """The first cap rows in the order of by; a negative cap is none. The rows are ranked where they lie: neither the cap nor the table meets in one task."""
    return rows if cap < 0 else ranks.first_rows(rows, cap, by)
