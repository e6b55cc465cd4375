"""Source divergence audit: which sources of a language use its words unlike the others, and by which words.

Terms are runs of A-Z, a-z and characters beyond ASCII, only A-Z lower-cased. A language keeps the ``V`` terms that stand
in at least ``MIN_DOCS`` of its documents. A group is a (lang, source) of the table. With N the sum of a group's
counts over the kept terms, p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), and two probabilities diverge by
f = floor((p - q)^2 / (p + q)).

Count columns are deduplicated: kept terms with the same counts in the same sources, a sparse vector, are one column with a
multiplicity, and all that depends on counts is evaluated once for a column. The sum over all terms for a pair of
sources needs no zeros. With x and y the counts of a term in the two,

    f(x, y) = f(0, 0) + [f(x, 0) - f(0, 0)] + [f(0, y) - f(0, 0)] + [f(x, y) - f(x, 0) - f(0, y) + f(0, 0)]:

the first part is V * f(0, 0), the next two need the distinct counts of a source with how many terms have them, and the last one
is nought but for columns that both sources have. All are integers, so that the sum is exact.
Terms are ranked through columns as well: a group's ten best terms are in its ten best columns (by value, then by their
first term), and only the terms of those are fetched.

Scale: documents are counted in Arrow batches, and a task emits a term once for about ``HELD`` distinct ones, so that neither a
frequent term nor a large source makes many rows for one key. A column is as wide as the sources of its
language that have the term. Pairs of sources are what the audit returns: its rows grow with the square of a language's sources.
Windows rank the pairs of a source, or ten terms of each task (a limit goes before the shuffle).
Only the table of groups is broadcast, where its names take ``SENT`` bytes at most; all other joins merge. Files of vectors are a small part of
what they are in memory, so that Spark, which goes by the size of files, would broadcast tables of hundreds of MB.

Defined cases: null text, lang and source are ''. Each row counts as a document, equal ones too; doc_id isn't read. A language
without kept terms has pairs of value 0. A group without terms has p from its zeros. Ties go to the item that is first
in UTF-8. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import as_bytes, release
from .workspace import Workspace, small_batches

MIN_DOCS = 10
TOP = 10
SCALE, PRIOR = 1_000_000_000, 2
HELD = 400_000
SENT = 4 << 20
SAFE = 9_000_000_000  # counts below it keep SCALE * count within 64 bits
#: A-Z lower-cased, a-z and bytes of characters beyond ASCII as they are, all else a space.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _flush(groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> pa.RecordBatch:
    rows = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in groups.items() for term, n in counts.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    text = lambda c: pa.array(c, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*map(text, columns[:3]), *[pa.array(c, pa.int64()) for c in columns[3:]]], ["lang", "source", "term", "n", "docs"])


def _count(most: int):
    def run(batches):
        """Occurrences and documents of each term of each group, summed over as many documents as memory takes."""
        groups, held = {}, 0
        for b in batches:
            for lang, source, text in zip(*map(as_bytes, b.columns), strict=True):
                words = text.translate(LETTERS).split()
                if not words:
                    continue
                counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                counts.update(words)
                docs.update(set(words))
                held += len(counts) - before
                if held >= most:
                    yield _flush(groups)
                    groups, held = {}, 0
        if groups:
            yield _flush(groups)
        release()

    return run


def share(n: str, total: str) -> str:
    """SQL of p for a count in a group whose N + PRIOR * V is total; counts beyond 64 bits go by decimals, and without kept terms there is none."""
    wide = f"cast({SCALE} as decimal(18, 0)) * cast({n} + {PRIOR} as decimal(19, 0)) div cast(nullif({total}, 0) as decimal(19, 0))"
    return f"(1 + if({n} < {SAFE}, {SCALE} * ({n} + {PRIOR}) div nullif({total}, 0), {wide}))"


def apart(p: str, q: str) -> str:
    """SQL of f for two probabilities."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _first(rows: DataFrame, value: str, item: str, n: int | None = None) -> DataFrame:
    """Rows with their rank in their group; with n only the first n, of which each task sends n at most."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc(value), item)))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def _how(groups: DataFrame) -> str:
    """How a table of one row for each group, or fewer, is joined with others."""
    n = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0]
    return "broadcast" if (n or 0) <= SENT else "merge"


def _pairs(entries: DataFrame, ladder: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, both ways."""
    other = groups.selectExpr("lang", "source item", "p0 q0").hint(how)
    both = groups.join(other, "lang").filter("source <> item").selectExpr("lang", "source", "item", f"coalesce(v * {apart('p0', 'q0')}, 0) value")
    steps = ladder.join(groups.hint(how), ["lang", "source"]).selectExpr("lang", "source", "m", "p0", f"{share('n', 'total')} p")
    one = steps.join(other, "lang").filter("source <> item").selectExpr("lang", "source", "item", f"m * ({apart('p', 'q0')} - {apart('p0', 'q0')}) value")
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    a, b = entries.select("cid", "lang", "source", "m", "p", "p0"), entries.selectExpr("cid", "source item", "p q", "p0 q0")
    inner = f"m * ({apart('p', 'q')} - {apart('p', 'q0')} - {apart('p0', 'q')} + {apart('p0', 'q0')}) value"
    two = a.join(b.hint("merge"), "cid").filter("source < item").selectExpr("lang", "source", "item", inner).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    back = lambda d: d.selectExpr("lang", "item source", "source item", "value")
    parts = both.unionByName(one).unionByName(back(one)).unionByName(two).unionByName(back(two))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources of its language (part ``pair``) and the top terms
    that it has more of than its language (part ``term``), the most divergent first."""
    small_batches(spark)
    ws = Workspace(spark, "audit")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count(held), COUNTS)
    sums = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    kept = ws.write(terms.filter(F.col("docs") >= min_docs).select("lang", "term", "vec"), "kept")
    columns = kept.groupBy("lang", "vec").agg(F.count("*").alias("m"), F.min("term").alias("first")).withColumn("cid", F.monotonically_increasing_id())
    columns = ws.write(columns, "columns")  # written, so that cid stays
    cells = columns.select("cid", "lang", "m", "first", F.expr("aggregate(vec, 0L, (s, e) -> s + e.n)").alias("n_lang"), F.inline("vec"))
    ladder = ws.write(cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")), "ladder")
    vocabulary = columns.groupBy("lang").agg(F.sum("m").alias("v"))
    sizes = ladder.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("size"))
    groups = docs.select(text("lang"), text("source")).distinct().join(sizes.hint("merge"), ["lang", "source"], "left").join(vocabulary.hint("merge"), "lang", "left").fillna(0, ["size", "v"])
    groups = groups.withColumn("total", F.col("size") + PRIOR * F.col("v"))
    groups = ws.write(groups.withColumn("p0", F.expr(share("0L", "total"))), "groups")
    how = _how(groups)
    langs = groups.groupBy("lang").agg((F.sum("size") + PRIOR * F.max("v")).alias("total_lang"))
    entries = cells.join(groups.hint(how), ["lang", "source"]).join(langs.hint(how), "lang")
    entries = ws.write(entries.selectExpr("cid", "lang", "source", "m", "first", "p0", f"{share('n', 'total')} p", f"{share('n_lang', 'total_lang')} q"), "entries")
    more = entries.filter("p > q").selectExpr("lang", "source", "cid", "first", f"{apart('p', 'q')} value")
    best = _first(more, "value", "first", top).drop("rank", "first").join(columns.select("cid", "vec").hint("merge"), "cid")
    named = _first(kept.join(best.hint("merge"), ["lang", "vec"]).selectExpr("lang", "source", "term item", "value"), "value", "item", top)
    pairs = _first(_pairs(entries, ladder, groups, how), "value", "item")
    out = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(named, "term"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    p = lambda n, total: f"1 + {SCALE}::HUGEINT * ({n} + {PRIOR}) // nullif({total}, 0)"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
    rank = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY 1, 2),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(size, 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p('coalesce(c.n, 0)', '(g.size + 2 * g.v)')} AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, sum(size) AS size, max(v) AS v FROM g GROUP BY 1),
q AS (SELECT lang, term, {p('sum(n)', '(any_value(l.size) + 2 * any_value(l.v))')} AS q FROM c JOIN l USING (lang) GROUP BY 1, 2),
x AS (SELECT a.lang, a.source, b.source AS item, sum({f('a.p', 'b.p')}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, term AS item, {f('p', 'q')}::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {rank} FROM y
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {rank} FROM z) WHERE rank <= {TOP}
"""


OP11_SQL = _sql()
