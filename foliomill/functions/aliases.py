"""Dictionary scan: long names first, an accepted place masks shorter names that overlap it.

All names are looked for in one pass over a text, by an Aho-Corasick automaton that each worker builds once from the names; the mask
follows, on the places found. Names are broadcast in slices of at most ``SLICE_CHARS``: a dictionary of one slice is masked
where it is scanned, a larger one takes a pass for each slice, and the places of a chunk meet before they are masked.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_CHARS = 8 << 20

#: Session cues.
CODENAMES = [
    "Mr. Fool", "The Fool", "Miss Magician", "Mr. Magician", "The Magician", "Miss Justice", "The Justice", "Justice",
    "The Hanged Man", "Mr. Hanged Man", "Mr. World", "The World", "Miss Hermit", "The Hermit", "The Sun", "The Moon",
    "The Star", "Judgment", "Wheel of Fortune", "Death", "Temperance", "The Tower", "The Devil", "Strength",
    "The Lovers", "The Chariot", "The Hierophant", "The Empress", "The Emperor", "The High Priestess",
]
FOG = re.compile(r"above the [Gg]r[ae]y [Ff]og")
CLUB = re.compile("Tarot Club")
GATHERING = re.compile(r"\b(?:today['’]s )?gathering\b", re.I | re.A)
#: Cues, and the suffix of those that count names.
FOG_CUE, CLUB_CUE, GATHERING_CUE, CODENAMES_CUE = "above-the-Grey-Fog", "Tarot-Club-named", "gathering-mention", "codenames-in-use"
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def in_order(names: list[tuple[str, int]], longest_first: bool = True) -> list[tuple[str, int]]:
    """Names by precedence: longest first (or as given), then as loaded; of equal names the first."""
    first: dict[str, int] = {}
    for n, k in sorted(names, key=lambda x: -len(x[0])) if longest_first else names:
        if n:
            first.setdefault(n, k)
    return list(first.items())


class Dictionary:
    """Names in order of precedence; the automaton is built where it is used first, and stays there."""

    def __init__(self, names: list[tuple[str, int]], longest_first: bool = True, start: int = 0):
        self.names, self.start = in_order(names, longest_first), start

    def __getstate__(self) -> dict:
        return {"names": self.names, "start": self.start}

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, (name, _) in enumerate(self.names):
            out.add_word(name, i)
        out.make_automaton()
        return out

    def places(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(precedence, start, end, key) of whole names; places of one name that overlap count from the left."""
        ends: dict[int, int] = {}
        if not self.names:
            return
        for last, i in self.automaton.iter(text):
            start, end = last + 1 - len(self.names[i][0]), last + 1
            if start < ends.get(i, 0) or start and text[start - 1] in WORD or end < len(text) and text[end] in WORD:
                continue
            ends[i] = end
            yield i + self.start, start, end, self.names[i][1]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Accepted (start, end, key); no two overlap."""
        return masked(self.places(text), len(text))


def masked(places, size: int) -> list[tuple[int, int, int]]:
    """Of places (precedence, start, end, key) those that no earlier one overlaps."""
    taken, out = bytearray(size), []
    for _, start, end, key in sorted(places):
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, key))
    return out


_CODES = Dictionary([(n, 0) for n in CODENAMES], longest_first=False)


def session(text: str) -> tuple[bool, list[str]]:
    """Whether a text is set in a session, and the cues for it."""
    hits = len(_CODES.spans(text))
    cues = [name for name, p in ((FOG_CUE, FOG), (CLUB_CUE, CLUB), (GATHERING_CUE, GATHERING)) if p.search(text)]
    if hits:
        cues.append(f"{hits}-{CODENAMES_CUE}" if hits > 1 else f"1-{CODENAMES_CUE.replace('codenames', 'codename')}")
    return hits > 1 or bool({FOG_CUE, CLUB_CUE} & set(cues)), cues


def _sessions(batches):
    for b in batches:
        found = [session(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.list_(pa.string()))], ["chunk_id", "in_session", "cues"])


def detect_sessions(chunks: DataFrame) -> DataFrame:
    """chunk_id, in_session, cues from (chunk_id, content)."""
    return chunks.select("chunk_id", "content").mapInArrow(_sessions, "chunk_id long, in_session boolean, cues array<string>")


HITS = "chunk_id long, entity_id long, n long"


def _tally(keys: list, spans: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    """Accepted places by chunk and key."""
    rows: dict[tuple, int] = {}
    for chunk, own in zip(keys, spans, strict=True):
        for _, _, k in own:
            rows[chunk, k] = rows.get((chunk, k), 0) + 1
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(rows.values(), pa.int64())], ["chunk_id", "entity_id", "n"])


def slices(names: list[tuple[str, int]], most: int) -> list[Dictionary]:
    """The names in order, in dictionaries of at most about that many characters."""
    out, size = [[]], 0
    names = in_order(names)
    for n in names:
        if size + len(n[0]) > most and out[-1]:
            out.append([])
            size = 0
        out[-1].append(n)
        size += len(n[0])
    starts = [sum(map(len, out[:i])) for i in range(len(out))]
    return [Dictionary(x, longest_first=False, start=s) for x, s in zip(out, starts, strict=True)]


def scan_aliases(chunks: DataFrame, names: list[tuple[str, int]], most: int = SLICE_CHARS) -> DataFrame:
    """chunk_id, entity_id, n: how often the names (alias, entity_id) of an entity stand in chunks (chunk_id, content)."""
    sc, parts = chunks.sparkSession.sparkContext, slices(names, most)
    shared = [sc.broadcast(p) for p in parts]
    if len(parts) == 1:

        def scan(batches):
            for b in batches:
                yield _tally(b.column(0).to_pylist(), [shared[0].value.spans(t or "") for t in b.column(1).to_pylist()])

        return chunks.select("chunk_id", "content").mapInArrow(scan, HITS)

    def found(one):
        def run(batches):
            for b in batches:
                rows = [(c, *p) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in one.value.places(t or "")]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5, ["chunk_id", "place", "start", "stop", "entity_id"])

        return run

    def mask(table: pa.Table) -> pa.Table:
        chunk, places = table.column("chunk_id")[0].as_py(), list(zip(*(table.column(c).to_pylist() for c in ("place", "start", "stop", "entity_id")), strict=True))
        return pa.Table.from_batches([_tally([chunk], [masked(places, max(p[2] for p in places))])])

    schema = "chunk_id long, place long, start long, stop long, entity_id long"
    places = functools.reduce(DataFrame.unionAll, [chunks.select("chunk_id", "content").mapInArrow(found(one), schema) for one in shared])
    return places.groupBy("chunk_id").applyInArrow(mask, HITS)  # a group is what one chunk holds
