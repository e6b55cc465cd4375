"""Stems of the published examples of the rules, and of every word of a table in two engines."""

import duckdb
from pyspark.sql import functions as F

from foliomill.functions import stem

PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave
knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell
knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit
knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock
ties tie cries cri gas gas gaps gap kiwis kiwi hopping hop hoped hope fizzed fizz luxuriated luxuri agreed agre feed feed by by say say cry cri
generously generous communism communism arsenal arsenal skies sky news news inning inning innings inning dying die only onli
yellow yellow youth youth boyish boyish national nation rational ration digitizer digit operator oper hopefulness hope
relational relat conditional condit electriciti electr electrical electr hopeful hope goodness good rolling roll happy happi toyed toy
nation nation nations nation license licens licenses licens licensed licens token token tokens token tokenization token 1990s 1990s abc123 abc123 a a is is
""".split()


def test_published_examples(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    got = {r["word"]: r["lexeme"] for r in stem.with_stem(spark.createDataFrame(pairs, "word string, want string")).collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)
    c = duckdb.connect()
    c.execute("CREATE TABLE v (word VARCHAR)")
    c.executemany("INSERT INTO v VALUES (?)", [(w,) for w, _ in pairs])
    assert dict(c.sql(stem.stem_sql("SELECT word FROM v")).fetchall()) == dict(pairs)


def test_every_word_of_a_table(spark):
    """Both engines agree on every word of the documents."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).distinct()
    got = dict(map(tuple, stem.with_stem(words).collect()))
    c = duckdb.connect()
    q = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM '/root/testdata/sf0.01/documents.parquet'"
    assert dict(c.sql(stem.stem_sql(q)).fetchall()) == got and len(got) > 10_000
