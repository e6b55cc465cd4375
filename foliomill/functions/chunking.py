"""Overlapping chunks of a chapter, as an Arrow fold: each paragraph's fate depends on the buffer before it."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET, LEAST, MOST, OVERLAP = 500, 400, 600, 100
BATCH_CHARS = 1 << 20
SENTENCE = re.compile(r"[^.!?]+[.!?]+[\"']?\s*")


def tokens(text: str) -> int:
    return math.ceil(len(text.split()) * 1.3)


def sentence_packs(paragraph: str) -> list[str]:
    """Sentences packed up to MOST tokens; text after the last full stop is dropped, none means the paragraph."""
    found = SENTENCE.findall(paragraph)
    if not found:
        return [paragraph]
    packs, pack, size = [], "", 0
    for s in found:
        n = tokens(s)
        if pack and size + n > MOST:
            packs.append(pack)
            pack, size = "", 0
        pack, size = pack + s, size + n
    return packs + [pack] * bool(pack)


def chunk_chapter(text: str) -> list[tuple[str, int]]:
    """(content, estimated tokens) of each chunk, in the order in which they are finished."""
    out: list[tuple[str, int]] = []
    buffer: list[tuple[str, int]] = []
    total = 0

    def flush(carry: bool) -> None:
        nonlocal buffer, total
        if not buffer:
            return
        out.append(("\n\n".join(p for p, _ in buffer), total))
        kept, total = [], 0
        while carry and len(kept) < len(buffer) and total < OVERLAP:
            kept.insert(0, buffer[-1 - len(kept)])
            total += kept[0][1]
        buffer = kept

    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n+", text))):
        n = tokens(p)
        if n > MOST:
            if total >= LEAST:
                flush(False)
            out += [(s, tokens(s)) for s in sentence_packs(p)]
            continue
        if total + n > MOST:
            flush(True)
        buffer.append((p, n))
        total += n
        if total >= TARGET:
            flush(True)
    flush(False)
    return out


def _chunks(batches):
    names = ["chapter_id", "chunk_index", "content", "approx_tokens"]
    for b in batches:
        ids, index, content, size, held = [], [], [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(ids, b.schema.types[0]), pa.array(index, pa.int32()), pa.array(content, pa.string()), pa.array(size, pa.int64())], names)  # noqa: B023, E731
        for key, text in zip(b.column(0), b.column(1), strict=True):  # a chapter at a time becomes Python's
            for i, (c, n) in enumerate(chunk_chapter(text.as_py() or "")):
                ids.append(key.as_py())
                index.append(i)
                content.append(c)
                size.append(n)
                held += len(c)
            if held > BATCH_CHARS:
                yield made()
                ids, index, content, size, held = [], [], [], [], 0
        yield made()


def chunk_chapters(chapters: DataFrame) -> DataFrame:
    """chapter_id, chunk_index, content, approx_tokens from (chapter_id, raw_text)."""
    kind = chapters.schema["chapter_id"].dataType.simpleString()
    return chapters.select("chapter_id", "raw_text").mapInArrow(_chunks, f"chapter_id {kind}, chunk_index int, content string, approx_tokens long")
