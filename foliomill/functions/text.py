"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a question.
STOPWORDS = """
a an the
of in on for to and or but with by at from into about across as if so then than also
is are was were be been being
has have had do does did
will would could should can may might
what who whom whose when where why how which
that this these those
he she it they them him his her hers its their theirs
i me my mine we our ours us you your yours
list summarize summarise describe explain tell give show mention name
every any some all each both few many
""".split()

#: Trigger phrases of events, matched anywhere and without case.
EVENT_KEYWORDS = [
    r"Sequence \d", "potion", "advanced to", "ascended to", "promoted to", "became (?:a|an|the) Sequence",
    "digest(?:ed|ing|ion)?", "finished digesting", "fully digested",
    "Tarot Club", "gathered", "convened", "summit", "summoned (?:the|her|his) (?:members|club)",
    "joined", "became a member", "inducted", "admitted (?:to|into)", "accepted into",
    "fought", "battle", "duel", "struck down", "attacked", "confronted", "slew", "defeated", "clashed", "stabbed",
    "slashed", "unleashed", "wounded", "ambushed", "assault", "explosion",
    "killed", "died", "deceased", "slain", "perished", "passed away",
    "posing as", "disguised as", "the alias", "took the (?:name|identity)", "assumed the identity", "called himself",
    "called herself", "new identity", "obtained a new identity", "his present name", "her present name",
    "revealed", "true identity", '"I am [A-Z]', "unmasked",
]
KEYWORD_PATTERN = "(?i)" + "|".join(EVENT_KEYWORDS)

#: Patterns of dialogue, headings, line breaks, block ends and titles, entities in their order, white space.
DIALOGUE_PATTERN = '[“"][^“”"]{8,}[”"]'
CHAPTER_PATTERN = r"(?i)^\s*Chapter\s+(\d+)"
CHINESE_PATTERN = r"^\s*第\s*(\d+)\s*章"
HEADING_PATTERN = r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
BREAK_PATTERN = r"(?i)<br\s*/?>"
BLOCK_END_PATTERN = r"(?i)</(?:p|div|h[1-6]|li|blockquote|tr|section|article)>"
TITLE_WORD_PATTERN = r"(?i)^(The|A|An|Mr\.?|Mrs\.?|Miss|Madam|Old|Lord|Lady|Saint|Sir|Dr\.?)$"
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#xa0;", " "), ("\u00a0", " ")]
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
QUOTES = ("“”‘’", "\"\"''")


def by_first_letter(patterns: list[str]) -> str:
    """One pattern for all: alternatives that begin alike share a branch, so that few are tried at each character."""
    branches: dict[str, list[str]] = {}
    for p in patterns:
        branches.setdefault(p[0].lower(), []).append(p[1:])
    return "(?i)(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in branches.items()) + ")"


def trim(text: Column) -> Column:
    """Without white space at both ends (line ends too)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def query_tokens(text: Column) -> Column:
    """Content tokens of a question: [a-z0-9]+ of two characters or more, no stopwords, first occurrences."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def tsquery(text: Column) -> Column:
    """The tokens joined by " | "; null if there is none."""
    tokens = query_tokens(text)
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " | "))


def chapter_number(title: Column) -> Column:
    """N of "Chapter N..." or of its Chinese form; null for other titles."""
    number, chinese = F.regexp_extract(title, CHAPTER_PATTERN, 1), F.regexp_extract(title, CHINESE_PATTERN, 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(chinese, F.lit(""))).cast("int")


def decode_entities(text: Column) -> Column:
    """Nine entities, in an order that decodes twice-encoded text once more."""
    for name, value in ENTITIES:
        text = F.regexp_replace(text, f"(?i){name}", value)
    return text


def section_title(html: Column) -> Column:
    """First heading, or else the whole text: tags out, entities decoded, spaces collapsed, 160 characters."""
    inner = F.when(F.regexp_like(html, F.lit(HEADING_PATTERN)), F.regexp_extract(html, HEADING_PATTERN, 1)).otherwise(html)
    return F.substring(trim(F.regexp_replace(decode_entities(F.regexp_replace(inner, "<[^>]+>", " ")), rf"{SPACE}+", " ")), 1, 160)


def chapter_body(html: Column, title: Column | None = None) -> Column:
    """Paragraphs of a section as text; repeated leading titles go, an empty title is none."""
    t = F.regexp_replace(html, "\r\n?", "\n")
    t = F.regexp_replace(t, BREAK_PATTERN, "\x01")
    t = F.regexp_replace(t, BLOCK_END_PATTERN, "\x02\x02")
    t = F.regexp_replace(decode_entities(F.regexp_replace(t, "<[^>]+>", "")), rf"{SPACE}+", " ")
    t = F.translate(t, "\x01\x02", "\n\n")
    t = trim(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{2,}", "\n\n"))
    if title is None:
        return t
    plain = F.regexp_replace(title, r"([\\^$.|?*+()\[\]{}])", r"\\$1")  # the title as a pattern of itself
    quoted = F.concat(F.lit("^(?:"), plain, F.lit(rf"{SPACE}*)+"))
    return F.when(F.length(title) > 0, trim(F.regexp_replace(t, quoted, F.lit("")))).otherwise(t)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    return F.ceil(word_count(text) * F.lit(1.3)).cast("long")


def preview(text: Column, n: int = 160) -> Column:
    return F.substring(F.regexp_replace(text, f"{SPACE}+", " "), 1, n)


def embed_text(prefix: Column, content: Column) -> Column:
    """What a chunk is embedded as: its prefix, a blank line, its content."""
    return F.concat(F.coalesce(prefix, F.lit("")), F.lit("\n\n"), content)


def chunk_header(book: Column, number: Column, title: Column) -> Column:
    return F.concat(F.upper(book), F.lit(" Chapter "), number.cast("string"), F.lit(": "), title)


def keyword_gate(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(by_first_letter(EVENT_KEYWORDS))), F.lit(False))


def dialogue_gate(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(DIALOGUE_PATTERN)), F.lit(False))


def entity_type_gate(types: Column) -> Column:
    """Whether a chunk's entity types include a character or an organization."""
    return F.coalesce(F.array_contains(types, "character") | F.array_contains(types, "organization"), F.lit(False))


def model_gate(text: Column, alias_hits: Column) -> Column:
    """Whether a model is asked for mentions: there is dialogue, or no alias was found."""
    return dialogue_gate(text) | (F.coalesce(alias_hits, F.lit(0)) == 0)


def straight(text: Column) -> Column:
    """White space collapsed, curly quotes straightened."""
    return F.translate(F.regexp_replace(text, f"{SPACE}+", " "), *QUOTES)


def verbatim(snippet: Column, text: Column) -> Column:
    return F.contains(straight(text), straight(snippet))


def longest_span(name: Column, text: Column) -> Column:
    """Longest run of the name's words, leftmost first, that the text holds; common titles don't count alone.

    One run is made and looked for at a time, numbered from the longest, until one is found: a fold over the numbers, which
    does nothing once it has an answer.
    """
    words = F.filter(F.split(name, f"{SPACE}+"), lambda w: w != "")

    def look(held: Column, k: Column) -> Column:
        w, n = held["words"], F.size(held["words"])
        d = F.floor((F.sqrt(8 * k + 1) - 1) / 2).cast("int")  # d words less than all: run k is number k - d (d + 1) / 2 of d + 1
        run = F.array_join(F.slice(w, k - F.floor(d * (d + 1) / 2).cast("int") + 1, n - d), " ")
        good = F.contains(held["text"], run) & ~F.regexp_like(run, F.lit(TITLE_WORD_PATTERN))
        found = F.when(held["found"].isNotNull(), held["found"]).when(good, run)
        return F.struct(w.alias("words"), held["text"].alias("text"), found.alias("found"))

    n = F.size(words)
    start = F.struct(words.alias("words"), text.alias("text"), F.lit(None).cast("string").alias("found"))
    numbers = F.sequence(F.lit(0), F.floor(n * (n + 1) / 2).cast("int") - 1)
    return F.when(n > 0, F.aggregate(numbers, start, look, lambda held: held["found"]))
