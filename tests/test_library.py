"""Functions, sources and streaming on literal inputs."""

import pytest
from pyspark.sql import functions as F

from foliomill.functions import aliases, chunking, llm_json, models, text
from foliomill.operators import accounting, extraction, maintain, quality, retrieval, rollup
from foliomill.plans import queries
from foliomill.sources import readers, sinks
from foliomill.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("title", "n"), [("Chapter 12: x", 12), ("  chapter 3", 3), ("Chapter 4 - 5: t", 4), ("第 7 章 x", 7), ("Preface", None), ("", None)])
def test_chapter_number(spark, title, n):
    assert one(spark, title, text.chapter_number) == n


@pytest.mark.parametrize(
    ("html", "title", "body"),
    [
        ("<h1>T</h1><p>x</p>", None, "T\n\nx"),
        ("<h1>T</h1><p>T</p><p>x</p>", "T", "x"),
        ("<p>a</p><p>b</p>", "T", "a\n\nb"),
        ("<p>a\r\nb</p>", "T", "a b"),
        ("<p>   </p><p>x</p><p>   </p>", "T", "x"),
        ("a&nbsp;b", "T", "a b"),
        ("<p>x T y</p>", "T", "x T y"),
        ("A<br>B<br/>C", "T", "A\nB\nC"),
        ("&amp;lt;", "", "<"),
        ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", None, "a\n\nb"),
        ("<p>a\u3000\u2003b</p>", None, "a b"),
    ],
)
def test_chapter_body(spark, html, title, body):
    got = one(spark, html, lambda x: text.chapter_body(x, None if title is None else F.lit(title)))
    assert got == body


def test_section_title(spark):
    assert one(spark, "<div><h2 class='a'>Chapter <b>1</b>:\n &amp; more</h2>x</div>", text.section_title) == "Chapter 1 : & more"
    assert len(one(spark, "<p>" + "y" * 300 + "</p>", text.section_title)) == 160


def test_query_tokens(spark):
    assert one(spark, "Who is the Fool of the FOOL club, a b 12?", text.tsquery) == "fool | club | 12"
    assert one(spark, "what is the", text.tsquery) is None


def test_gates(spark):
    assert one(spark, "the Battleship", text.keyword_gate) and not one(spark, "calm", text.keyword_gate) and one(spark, None, text.keyword_gate) is False
    assert one(spark, "“Good evening” he said", text.dialogue_gate)
    assert one(spark, "a  “b”\nc", lambda x: text.verbatim(F.lit('a "b" c'), x))
    assert one(spark, "in old Backlund town", lambda x: text.longest_span(F.lit("The old Backlund"), x)) == "old Backlund"
    assert one(spark, "the end", lambda x: text.longest_span(F.lit("The"), x)) is None


def paragraph(n, mark):
    return " ".join([mark] * n)


def test_chunker():
    a, b = paragraph(453, "a"), paragraph(453, "b")
    assert [c for c, _ in chunking.chunk_chapter(f"{a}\n\n{b}")] == [a, a, f"{a}\n\n{b}", b]
    assert chunking.chunk_chapter("") == [] and chunking.chunk_chapter("one") == [("one", 2)]
    long = " ".join(["word"] * 400 + ["end."] + ["word"] * 300 + ["stop."] + ["rest"])
    got = chunking.chunk_chapter("small one\n\n" + long)
    assert got[-1][0] == "small one" and len(got) == 3 and not any("rest" in c for c, _ in got)


def test_dictionary():
    d = aliases.Dictionary([("A B", 1), ("B C D", 2), ("B", 3), ("b", 4)])
    assert sorted(d.spans("A B C D and B, AB")) == [(2, 7, 2), (12, 13, 3)]
    assert aliases.session("above the Grey Fog")[0] and aliases.session("The Fool met Mr. World")[0]
    assert aliases.session("Miss Justice") == (False, ["1-codename-in-use"]) and aliases.session("a gathering") == (False, ["gathering-mention"])
    assert aliases.session("Justice, Justice")[0]


def test_model_json(spark):
    raw = '<thinking>[1]</thinking>```json\n[{"entity_canonical_name":"K","event_type":"death","snippet":"he died","extra":{"a":1}},{"entity_canonical_name":"K","event_type":"odd","snippet":"he died"},{"entity_canonical_name":"K","event_type":"battle","snippet":"not there","extra":[]}]\n```'
    got = one(spark, raw, lambda x: llm_json.parse_events(x, F.lit("and he  died.")))
    assert [(e["event_type"], e["extra"]) for e in got] == [("death", '{"a":1}')]
    assert one(spark, "no", lambda x: llm_json.parse_events(x, F.lit("y"))) == [] and one(spark, "[bad", llm_json.parse_mentions) == []
    got = one(spark, '```json\n[{"entity_name":" K ","role":"Speaker"},{"entity_name":"L","entity_type":"Location ","role":"odd"},{"entity_name":""},5,"x",{"entity_name":7},{"name":"M"}]\n```', llm_json.parse_mentions)
    assert [tuple(m) for m in got] == [("K", "character", "speaker"), ("L", "location", None)]
    padded = '[{"entity_canonical_name":" K ","event_type":" death ","snippet":" he died "},"odd",[1]]'
    assert [tuple(e) for e in one(spark, padded, lambda x: llm_json.parse_events(x, F.lit("he died")))] == [("K", "death", "he died", "{}")]
    assert one(spark, "meeting", lambda x: llm_json.allowed(x, F.lit("organization"))) and not one(spark, "death", lambda x: llm_json.allowed(x, F.lit("organization")))


def test_models(spark):
    v = one(spark, "some words here", models.embed)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == one(spark, "some words here", models.embed)
    assert one(spark, "  ", models.generate) == "(none)" and one(spark, "a b", models.generate) == "a b"


def test_quotas():
    assert quality.quotas([8, 8, 4, 4, 2], 26) == [8, 8, 4, 4, 2]
    assert sum(quality.quotas([8, 8, 4, 4, 2], 13)) == 13 and min(quality.quotas([100, 1], 5)) == 1


def test_maintenance(spark):
    e = spark.createDataFrame([(1, "A"), (2, "B")], "entity_id long, canonical_name string")
    names = spark.createDataFrame([("A",), ("C",), (" D ",), ("",), ("C",)], "name string")
    got = {r["canonical_name"]: r["entity_id"] for r in maintain.get_or_create(e, names).collect()}
    assert got["A"] == 1 and sorted([got["C"], got["D"]]) == [3, 4] and len(got) == 3
    dry = {r["canonical_name"]: r["entity_id"] for r in maintain.get_or_create(e, names, dry_run=True).collect()}
    assert dry["A"] == 1 and sorted([dry["C"], dry["D"]]) == [-2, -1]
    many = spark.range(3000).selectExpr("concat('n', id) name")
    made = maintain.get_or_create(e, many)
    ids = [r["entity_id"] for r in made.orderBy("canonical_name").collect()]
    assert sorted(ids) == list(range(3, 3003)) and ids == [r["entity_id"] for r in maintain.get_or_create(e, many.repartition(7)).orderBy("canonical_name").collect()]
    ev = spark.createDataFrame([(1, '{"identity":"Sherlock M"}'), (2, "{}")], "id long, extra string")
    new = spark.createDataFrame([(3, "{}")], "id long, extra string")
    assert maintain.guarded_insert(ev, new, "identity", "Sherlock%").count() == 2 and maintain.guarded_insert(ev, new, "identity", "Other%").count() == 3
    kept, gone = maintain.delete_returning(ev, F.col("id") < 5, spark.createDataFrame([(1,)], "id long"), "id")
    assert [r["id"] for r in kept.collect()] == [2] and [r["id"] for r in gone.collect()] == [1]
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "chunk_id long, names array<string>")
    assert sorted((r["chunk_id"], r["names"], r["patched"]) for r in maintain.patch_lists(lists, "chunk_id", "names", {1: lambda c: F.array_remove(c, "a"), 2: lambda c: F.array_union(c, F.array(F.lit("a")))}).collect()) == [(1, ["b"], True), (2, ["a"], False)]
    gold = spark.createDataFrame([(1, [], "EMPTY_OK"), (2, [], None), (3, ["x"], None)], "id long, gold_mentions array<string>, notes string")
    assert sorted(r["id"] for r in maintain.labelled(gold).collect()) == [1, 3]


def test_strict_ranges(spark):
    c = spark.createDataFrame([("b", 1), ("b", 9)], "book_id string, chapter_num long")
    r = spark.createDataFrame([("b", 1, 5, 1)], "book_id string, range_start long, range_end long, arc long")
    assert rollup.assign_ranges(c, r).count() == 1
    with pytest.raises(Exception, match="no range holds chapter 9"):
        rollup.assign_ranges(c, r, strict=True).collect()


def test_strict_ranges_under_a_filter(spark):
    c = spark.createDataFrame([("b", 1), ("b", 9)], "book_id string, chapter_num long")
    r = spark.createDataFrame([("b", 1, 5, 1, 1)], "book_id string, range_start long, range_end long, volume long, arc long")
    with pytest.raises(Exception, match="no range holds chapter 9"):
        rollup.assign_ranges(c, r, strict=True).filter("volume > 0").collect()


def test_no_chapter_is_dropped(spark, tmp_path):
    docs = spark.range(5004).selectExpr("id doc_id", "CASE WHEN id < 5002 THEN 'src0' WHEN id = 5002 THEN 'src1' END source", "'en' lang", "10L n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: queries.QUERIES[n](spark, str(tmp_path)).collect() for n in ("arc_assign", "range_join_rollup_meta", "rollup_targets_arc", "rollup_targets_volume", "rollup_targets_series", "plan_next_level")}
    assert sorted(r["chapter_id"] for r in got["arc_assign"]) == list(range(5004))
    assert [(r["volume"], r["arc"]) for r in got["arc_assign"] if r["chapter_num"] > 5000] == [(3, 6)] * 2
    assert {(r["book_id"], r["range_end"], r["arc_count"]) for r in got["range_join_rollup_meta"] if r["range_start"] == 501 and r["level"] == "arc"} == {("src0", 5002, 1)}
    assert sum(r["inputs"] for r in got["rollup_targets_arc"]) == 5004
    assert {(r["book_id"], r["volume"], r["range_end"]) for r in got["rollup_targets_volume"] if r["volume"] == 3} == {("src0", 3, 5002)}
    assert {(r["book_id"], r["range_end"]) for r in got["rollup_targets_series"]} == {("src0", 5002), ("src1", 1), (None, 1)}
    assert "volume|src0|101|5002|Volume 3: Dusk" in {r["key"] for r in got["plan_next_level"]}


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, "b", 3, "fool club", [1.0, 0.0]), (2, "b", 9, "fool fool", [0.0, 1.0]), (3, "c", 1, "x", [1.0, 1.0])], "chunk_id long, book_id string, chapter_num long, content string, embedding array<float>")
    top = [r["chunk_id"] for r in retrieval.hybrid(rows, [1.0, 0.0], "the fool", {"b": 5, "c": None}).collect()]
    assert top == [1]
    assert retrieval.sparse(rows, []).count() == 0
    a, b = retrieval.dense(rows, [1.0, 0.0]), retrieval.dense(rows, [0.0, 1.0])
    assert retrieval.divergence(a, b).first()["diverges"] and not retrieval.divergence(a, a).first()["diverges"]
    assert spark.range(1).select(retrieval.recall(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).first()[0] == 0.5


WIKI = """{{SequenceChart/start}}
{{SequenceChart/mid|group=goo|rowspan = 2
| """ + " | ".join(f"{{{{Language|{{{{Seq|S{i}}}}}|x|4}}}}" for i in [*range(9, -1, -1), "old"]) + """
}}
{{SequenceChart/mid|group=goo
| """ + " | ".join(f"{{{{Seq|R{i}}}}}" for i in range(9, -1, -1)) + """
}}
{{SequenceChart/mid|group=lom| {{Seq|only}} }}
== Chart of Non-Standard Sequences ==
{{SequenceChart/mid|group=n| """ + " | ".join(f"{{{{Seq|N{i}}}}}" for i in range(9, -1, -1)) + " }}"  # fmt: skip


def test_lore(spark, tmp_path):
    (tmp_path / "w.txt").write_text(WIKI)
    rows = readers.read_pathways(spark, str(tmp_path / "w.txt"))
    got = [(r["pathway"], r["category"], r["great_old_one"]) for r in rows.orderBy("pos").collect()]
    assert got == [("S0", "standard", "Sold"), ("S0", "outer-deity", "Sold"), ("R0", "standard", "Sold"), ("R0", "outer-deity", "Sold"), ("N0", "non-standard", "N0")]
    assert readers.find_pathway(rows, "r5").first()["pathway"] == "R0" and readers.find_pathway(rows, "zz").count() == 0
    assert readers.list_pathways(rows, "standard").count() == 2
    s = spark.createDataFrame([("Plot", "1", 10), ("plot two", "2", 20)], "line string, index string, byteoffset int")
    assert [readers.resolve_section(s, x) for x in (None, 4, "7", "PLOT", "none")] == [(None, True), ("4", True), ("7", True), ("1", True), (None, False)]
    assert readers.resolve_section(s, "two$", regex=True) == ("2", True)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('// note\n\n{"id": 1}\nbad\n')
    assert [r["id"] for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long", strict=False).collect()] == [1]
    assert readers.jsonl_errors(spark, str(tmp_path / "a.jsonl"), "id long").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long").collect()
    entity = '{"canonical_name":"%s","entity_type":"%s","aliases":["a"],"is_spoiler":0,"meta":{"k":[1]}}'
    write = lambda *e: (tmp_path / "e.json").write_text('{"entities":[' + ",".join(e) + "]}")
    write(entity % ("A", "artifact"), entity % ("A", "character"))
    with pytest.raises(ValueError, match="twice"):
        readers.read_entities(spark, str(tmp_path / "e.json"))
    write(entity % ("A", "item"))
    with pytest.raises(ValueError, match="isn't an entity"):
        readers.read_entities(spark, str(tmp_path / "e.json"))
    write(entity % ("A", "artifact"), entity % ("B", "character"))
    assert sorted((r["canonical_name"], r["meta"]) for r in readers.read_entities(spark, str(tmp_path / "e.json")).collect()) == [("A", '{"k":[1]}'), ("B", '{"k":[1]}')]
    (tmp_path / "n.jsonl").write_text('{"chunk_id": 1}\n{"chunk_id": "2"}\n{"other": 3}\n{bad\n')
    assert [r["chunk_id"] for r in readers.read_jsonl(spark, str(tmp_path / "n.jsonl"), "chunk_id long", strict=False, number="chunk_id").collect()] == [1]
    (tmp_path / "doc.json").write_text('[{"a": 1}]')
    kept = readers.read_document(spark, str(tmp_path / "doc.json"), "a int")
    assert readers.read_document(spark, str(tmp_path / "doc.json"), "a int") is kept and kept.first()["a"] == 1
    readers.reset_documents()
    assert readers.read_document(spark, str(tmp_path / "doc.json"), "a int") is not kept
    gap = spark.createDataFrame([("b", "<h1>Chapter 1</h1>x"), ("b", "<h1>Chapter 3</h1>x")], "book_id string, html string")
    with pytest.raises(ValueError, match="gaps"):
        readers.extract_chapters(gap)


def test_incremental(spark, tmp_path):
    src, sink, check = (str(tmp_path / x) for x in ("src", "sink", "check"))
    spark.range(5).write.parquet(src)
    go = lambda: incremental.run_available(spark, src, "id long", sink, check, "id", lambda d: d.filter("id % 2 = 0"))
    go()
    spark.range(3, 8).write.mode("append").parquet(src)
    go()
    assert sorted(r["id"] for r in spark.read.parquet(f"{sink}/rows").collect()) == [0, 2, 4, 6]
    assert incremental.coverage(spark.read.parquet(f"{sink}/marks"), spark.range(10), "id").first().asDict() == {"total": 10, "done": 8}


@pytest.mark.parametrize("lost", ["commit", "marks"])
def test_incremental_retry(spark, tmp_path, lost):
    src, sink, check = (str(tmp_path / x) for x in ("src", "sink", "check"))
    spark.range(6).write.parquet(src)
    broken = [lost == "marks"]

    def step(d):
        return d

    def go():
        incremental.run_available(spark, src, "id long", sink, check, "id", step)

    if broken[0]:  # fails between the writes of rows and marks
        (tmp_path / "sink").mkdir()
        (tmp_path / "sink" / "marks").mkdir()
        (tmp_path / "sink" / "marks" / "batch=0").write_text("in the way")
        with pytest.raises(Exception):  # noqa: B017
            go()
        (tmp_path / "sink" / "marks" / "batch=0").unlink()
        (tmp_path / "sink" / "marks").rmdir()
    else:
        go()
        for f in (tmp_path / "check" / "commits").iterdir():
            f.unlink()
    go()
    assert sorted(r["id"] for r in spark.read.parquet(f"{sink}/rows").collect()) == list(range(6))
    assert spark.read.parquet(f"{sink}/marks").count() == 6


def test_epub(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/a.opf"/></rootfiles></container>')
        z.writestr("OEBPS/a.opf", '<package xmlns="urn:o"><manifest><item id="x" href="two%20b.html"/><item id="y" href="one.html"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>')
        z.writestr("OEBPS/one.html", "<h1>Chapter 1: A</h1><p>first</p>")
        z.writestr("OEBPS/two b.html", "<h1>Chapter 2: B</h1><p>second</p>")
    rows = readers.read_epub(spark, str(tmp_path / "b.epub"), "b")
    assert [(r["pos"], "first" in r["html"]) for r in rows.orderBy("pos").collect()] == [(0, True), (1, False)]
    assert [(r["chapter_num"], r["raw_text"]) for r in readers.extract_chapters(rows).orderBy("chapter_num").collect()] == [(1, "first"), (2, "second")]


def test_sinks(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "book_id string, n long")
    assert sinks.refresh(rows, at("t"), "book_id") == 3
    assert sinks.refresh(spark.createDataFrame([("a", 9)], "book_id string, n long"), at("t"), "book_id") == 1
    assert sorted((r["book_id"], r["n"]) for r in sinks.refreshed(spark, at("t"), "book_id").collect()) == [("a", 9), ("b", 3)]
    sinks.append(rows, at("u"))
    sinks.append(rows, at("u"))
    assert spark.read.parquet(at("u")).count() == 6
    sinks.write_batch(rows, at("w"), "1")
    sinks.write_batch(rows, at("w"), "1")
    assert spark.read.parquet(at("w")).count() == 3
    assert sinks.swap(rows, at("v")) == 0 and sinks.swap(sinks.current(spark, at("v")).filter("n > 1"), at("v")) == 1
    assert sinks.current(spark, at("v")).count() == 2 and sinks.versions(spark, at("v")) == [0, 1]
    sinks.write_jsonl(rows, at("j"))
    sinks.write_jsonl(rows.limit(1), at("j"))
    assert spark.read.json(at("j")).count() == 1 and spark.read.json(at("j.bak")).count() == 3
    assert sinks.pretty_json(rows.limit(1)) == '[\n  {\n    "book_id": "a",\n    "n": 1\n  }\n]\n'
    with pytest.raises(ValueError, match="no document"):
        sinks.pretty_json(rows, most=2)
    labels = spark.createDataFrame([(1, "text", ["x", "y"], ["y"]), (2, "t", ["x"], ["x"])], "id long, content string, gold array<string>, got array<string>")
    out = sinks.cards(labels, F.concat(F.lit("chunk "), "id"), F.col("content"), F.col("gold"), F.col("got")).collect()
    assert len(out) == 1 and "## chunk 1" in out[0]["card"] and "Missing: x" in out[0]["card"] and "Extra: none" in out[0]["card"]


def test_gold(spark):
    e = spark.createDataFrame([(1, "Klein Moretti", ["Sherlock"], "character"), (2, "Other", ["klein moretti"], "character")], "entity_id long, canonical_name string, aliases array<string>, entity_type string")
    rows = [
        (1, 0, "Klein", "speaker", "Klein spoke", "..."),  # in the chunk
        (1, 1, "Audrey", None, "Klein spoke", "Audrey came"),  # in the chapter
        (1, 2, "Sherlock", None, "Klein spoke", "Klein Moretti came"),  # a form in the chapter: the name stays
        (1, 3, "Mr Klein X", "speaker", "Klein spoke", "none"),  # a span, equal to the first row then
        (1, 4, "Nobody", None, "Klein spoke", "none"),
    ]
    gold = spark.createDataFrame(rows, "chunk_id long, place long, name string, role string, content string, chapter_text string")
    got = sorted((r["name"], r["role"], r["action"]) for r in quality.normalise_gold(gold, e).collect())
    assert got == [("Audrey", None, "keep"), ("Klein", "speaker", "keep"), ("Sherlock", None, "alias")]
    audit = {r["name"]: (r["audit"], r["alias"], r["suggested"]) for r in quality.audit_gold(gold, e).collect()}
    assert audit == {"Sherlock": ("alias", "Klein Moretti", None), "Mr Klein X": ("absent", None, None), "Nobody": ("absent", None, None)}


def test_extraction(spark):
    e = spark.createDataFrame([(1, "Klein", ["Fool"], "character"), (2, "Fool", [], "organization"), (3, "City", [], "location")], "entity_id long, canonical_name string, aliases array<string>, entity_type string")
    first = {r["key"]: r["entity_id"] for r in extraction.names_of(e).collect()}
    last = {r["key"]: r["entity_id"] for r in extraction.names_of(e, last=True).collect()}
    assert (first["fool"], last["fool"]) == (1, 2)
    ev = spark.createDataFrame([(" fool ", "death"), ("City", "battle"), ("x", "death")], "entity_canonical_name string, event_type string")
    assert [(r["entity_id"], r["event_type"]) for r in extraction.resolve_events(ev, e).collect()] == [(1, "death")]
    answered = spark.createDataFrame([(1, 1, "addressee"), (1, 1, "speaker"), (1, 2, None)], "chunk_id long, entity_id long, role string")
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "chunk_id long, entity_id long")
    assert sorted((r["entity_id"], r["role"]) for r in extraction.merge_mentions(answered, hits).collect()) == [(1, "speaker"), (2, None), (3, "mentioned")]
    m = spark.createDataFrame([(1, 10), (3, 10), (3, 11), (2, 12)], "entity_id long, chunk_id long")
    types = extraction.entity_types(m, e)
    assert {r["chunk_id"]: r["types"] for r in types.collect()} == {10: ["character", "location"], 11: ["location"], 12: ["organization"]}
    c = spark.createDataFrame([(10, "he was killed"), (11, "he was killed"), (12, "above the grey fog"), (13, "killed")], "chunk_id long, content string")
    assert sorted(r["chunk_id"] for r in extraction.event_gate(c, types).collect()) == [10, 12]
    assert [r["chunk_id"] for r in extraction.gated_pool(c, types, seed=1).collect()] == [10]
    said = extraction.answered_mentions(c, hits.withColumn("chunk_id", F.lit(10).cast("long")), e, lambda texts: ['[{"entity_name":"FOOL","role":"speaker"}]' for _ in texts])
    assert sorted((r["chunk_id"], r["entity_id"], r["role"]) for r in said.collect()) == [(11, 2, "speaker"), (12, 2, "speaker"), (13, 2, "speaker")]
    chunks = c.withColumns({"book_id": F.lit("b"), "chapter_num": F.col("chunk_id"), "chunk_index": F.lit(0)})
    anchors = spark.createDataFrame([("x", "b", 11, 20, "KILLED")], "anchor_id string, book_id string, lo long, hi long, needle string")
    assert [r["chunk_id"] for r in extraction.first_match(chunks, anchors).collect()] == [11]


def test_rollup(spark):
    rows = [("b", n, v, f"V{v}", a, f"A{a}", k) for n, v, a, k in [(1, 1, 1, "main"), (2, 1, 1, "main"), (3, 1, 2, "side_story"), (4, 0, 3, "main")]]
    c = spark.createDataFrame(rows, "book_id string, chapter_num long, volume long, volume_name string, arc long, arc_name string, content_kind string")
    s = c.withColumns({"range_start": F.col("chapter_num"), "range_end": F.col("chapter_num"), "label": F.concat(F.lit("c"), "chapter_num"), "content": F.concat(F.lit("t"), "chapter_num")})
    arcs = rollup.arc_targets(s)
    assert sorted((r["label"], r["range_start"], r["range_end"], r["content_kind"]) for r in arcs.collect()) == [("V0 - A3", 4, 4, "main"), ("V1 - A1", 1, 2, "main"), ("V1 - A2", 3, 3, "side_story")]
    vols = rollup.volume_targets(arcs.withColumn("content", F.lit("sum")))
    assert [(r["label"], r["range_start"], r["range_end"]) for r in vols.collect()] == [("Volume 1: V1", 1, 2)]
    p = rollup.prompts(arcs, "arc").filter("arc = 1").first()
    assert p["user"] == "Target: V1 - A1\nBook: b\nLevel: arc\nContent kind: main\n\nInput summaries:\n1. c1: t1\n2. c2: t2" and p["max_words"] == 400
    sums = spark.createDataFrame([("arc", "b", 1, 2, "x"), ("arc", "b", 1, 3, "y"), ("volume", "b", 1, 4, "z")], "level string, book_id string, range_start long, range_end long, label string")
    meta = rollup.summary_metadata(sums, c)
    got = {r["label"]: (r["valid"], r["meta"]) for r in rollup.mixed(meta).collect()}
    assert got["x"] == (True, '{"volume":1,"volumeName":"V1","arc":1,"arcName":"A1","contentKind":"main"}') and not got["y"][0]
    assert got["z"] == (True, '{"volume":1,"volumeName":"V1","contentKind":"main"}')
    with pytest.raises(Exception, match="mixed metadata"):
        rollup.validated(meta).collect()
    assert rollup.validated(meta.filter("label <> 'y'")).count() == 2
    assert [r["arc"] for r in rollup.first_groups(c, ["arc"], 5).collect()] == [1, 3]
    assert [r["arc"] for r in rollup.first_groups(c.filter("content_kind <> 'main'"), ["arc"], 5).collect()] == [2]
    assert rollup.first_groups(c, ["arc"], 0).count() == 0 and rollup.smallest(c, ["volume"], 0).count() == 0
    assert sorted(r["chapter_num"] for r in rollup.smallest(c, ["volume"], 2).collect()) == [1, 2, 4]
    ch = c.withColumn("chapter_id", F.col("chapter_num"))
    done = spark.createDataFrame([(1,), (1,), (2,), (4,)], "chapter_id long")
    assert [r["chapter_num"] for r in rollup.missing_chapters(ch, done).collect()] == [3]
    with pytest.raises(ValueError, match="3/4"):
        rollup.assert_coverage(ch, done)
    rollup.assert_coverage(ch.filter("chapter_num <> 3"), done)
    twice = spark.createDataFrame([("arc", "b", 1, 2, "x", "old", 1), ("arc", "b", 1, 2, "x", "new", 2)], "level string, book_id string, range_start long, range_end long, label string, content string, id long")
    assert [r["content"] for r in rollup.first_summaries(twice, "id").collect()] == ["old"]
    assert [r["label"] for r in rollup.reading_order(sums).collect()] == ["x", "y", "z"]


def test_accounting(spark):
    assert spark.range(1).select(accounting.no_cache_tokens(F.lit(None).cast("int"), F.lit(10), F.lit(4), F.lit(8))).first()[0] == 0
    assert spark.range(1).select(accounting.no_cache_tokens(F.lit(3), F.lit(10), F.lit(4), F.lit(8))).first()[0] == 3
    r = spark.createDataFrame([(1, "speaker"), (1, None), (1, "mentioned"), (2, None)], "k long, role string")
    assert {x["k"]: x["role"] for x in accounting.max_by_rank(r, ["k"], "role", accounting.ROLE_RANKS).collect()} == {1: "speaker", 2: None}
    assert accounting.exists(r) and not accounting.exists(r.limit(0))


def test_search_and_pages(spark):
    rows = spark.createDataFrame([(1, "b", 3, "the fool joined the club"), (2, "b", 9, "fool fool club"), (3, "c", 1, "x")], "chunk_id long, book_id string, chapter_num long, content string")
    rows = rows.withColumn("embedding", models.embed(F.col("content")))
    assert [r["chunk_id"] for r in retrieval.search_book(rows, "the fool club", ["b"], {"b": 5, "c": 5}).collect()] == [1]
    with pytest.raises(ValueError):
        retrieval.search_book(rows, "ab", ["b"], {"b": 5})
    bare = rows.withColumn("embedding", F.when(F.col("chunk_id") == 1, F.col("embedding")))
    assert [r["chunk_id"] for r in retrieval.sparse(bare, ["fool"]).collect()] == [2, 1] and retrieval.dense(bare, [1.0] * 64).count() == 1
    e = spark.createDataFrame([(1, "Klein", ["Fool"])], "entity_id long, canonical_name string, aliases array<string>")
    m = spark.createDataFrame([(1, 1, "b", 3), (2, 1, "b", 9)], "mention_id long, entity_id long, book_id string, chapter_num long")
    known, unknown = retrieval.lookup_result(e, m, "fool", {"b": 5}).first(), retrieval.lookup_result(e, m, "x", {"b": 5}).first()
    assert known["entity"]["entity_id"] == 1 and [x["mention_id"] for x in known["mentions"]] == [1]
    assert unknown["entity"] is None and unknown["mentions"] == []
    pages = spark.createDataFrame([("Volume_1: A", "whole"), ("Volume 12: B", "z" * 9000)], "title string, text string")
    parts = spark.createDataFrame([("Volume_1: A", "Timeline", "2", 5, "when")], "title string, line string, index string, byteoffset long, text string")
    assert readers.volume_timeline(pages, parts, 1).first().asDict() == {"title": "Volume_1: A", "section": "2", "body": "when", "truncated": False, "section_found": True}
    whole = readers.volume_timeline(pages, parts, 12).first()
    assert len(whole["body"]) == 8000 and whole["truncated"] and not whole["section_found"]
    with pytest.raises(ValueError, match="volume 3"):
        readers.volume_timeline(pages, parts, 3)
    ch = rows.withColumn("chapter_id", F.col("chunk_id"))
    assert retrieval.point_lookup(ch, "b", 9).first()["chapter_id"] == 2 and [r["chapter_num"] for r in retrieval.book_scan(ch, "b").collect()] == [3, 9]
