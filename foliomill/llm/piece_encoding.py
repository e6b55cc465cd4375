"""SentencePiece encoding and decoding by suffix-array matching.

The batch's text is split where a space follows another character (no piece of the vocabulary spans that), and
its distinct segments are laid end to end. A suffix array to the depth of the longest piece indexes them; every
piece is binary-searched for its range of occurrences; the ranges give edges (end, length, piece), which are
sorted by end position and relaxed from left to right.

The vocabulary is of the BPE kind, so that relaxing doesn't add scores: each position has one best last piece,
the edge that is compatible with the best last piece where it starts. Two neighbours are compatible if
merging by scores never crosses their border, which is decided by undoing their last merges, latest first.
Segments are relaxed side by side in numpy, the j-th position of all at once; a segment of over ``WIDE``
characters is relaxed alone. Characters outside the vocabulary become byte pieces.

Defined cases: null counts as empty text, which has no pieces; U+2581 in a text decodes as a space, as in
the library; equal rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from .words import chunks, release
from .workspace import small_batches

SPACE = "▁"
DEPTH = 16
WIDE = 192
BATCH_CHARS = 1 << 20
INDEX_CHARS = 1 << 18
CACHE_SEGMENTS = 300_000
NEVER = np.int64(1 << 40)
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Tables of a model file, built once and broadcast; their size is bounded by the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.texts: list[bytes] = []
        ids, pieces, scores = [], [], []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.texts.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.texts.append(b"")
            else:
                self.texts.append(p.replace(SPACE, " ").encode())
                ids.append(i)
                pieces.append(p)
                scores.append(sp.get_score(i))
        if max(map(len, pieces)) > DEPTH or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece is longer than the index is deep, or has a space inside")
        index = {p: k for k, p in enumerate(pieces)}
        chars = sorted({c for p in pieces for c in p})
        if any(c not in index for c in chars):
            raise ValueError("a piece has a character that isn't a piece")
        self.ids = np.array(ids, np.int32)
        self.lengths = np.array([*map(len, pieces), 1], np.int64)  # the last stands for a character outside
        self.outside = len(pieces)
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        codes = np.zeros((len(pieces), DEPTH), np.uint64)
        for k, p in enumerate(pieces):
            codes[k, : len(p)] = self.code[[ord(c) for c in p]]
        self.keys = _pack(codes.reshape(-1, DEPTH // 4, 4))
        used = (np.arange(DEPTH)[None, :] < self.lengths[:-1, None]).astype(np.uint64) * np.uint64(0xFFFF)
        self.masks = _pack(used.reshape(-1, DEPTH // 4, 4))
        self.rank = np.append(np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int64), NEVER)
        self.left, self.right = np.arange(len(pieces) + 1), np.arange(len(pieces) + 1)
        self.time = np.full(len(pieces) + 1, -1, np.int64)
        self.reached = np.ones(len(pieces), bool)
        for k in sorted(range(len(pieces)), key=lambda k: len(pieces[k])):
            if len(pieces[k]) > 1:
                self.reached[k] = self._derive(pieces[k], k, index)
        pairs = {}
        for k, p in enumerate(pieces):
            for j in range(1, len(p)):
                a, b = index.get(p[:j]), index.get(p[j:])
                if a is not None and b is not None:
                    pairs[a * (self.outside + 1) + b] = self.rank[k]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[self._slot(self.pair_keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x2545F4914F6CDD1D) >> np.int64(40)) & np.int64((1 << 21) - 1)

    def _derive(self, piece: str, k: int, index: dict[str, int]) -> bool:
        """Merge the piece's characters by score; note the last merge and when it happens."""
        parts, split = list(piece), (0, 0)
        while len(parts) > 1:
            best = min(((self.rank[index[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in index), default=None)
            if best is None:
                return False
            i = best[1]
            split = index[parts[i]], index[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.left[k], self.right[k] = split
        self.time[k] = max(self.rank[k], self.time[split[0]], self.time[split[1]])
        return True

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether no merge crosses their border."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            key = a * np.int64(self.outside + 1) + b
            maybe = np.flatnonzero(self.maybe[self._slot(key)])
            if len(maybe):
                where = np.minimum(np.searchsorted(self.pair_keys, key[maybe]), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[where] == key[maybe], self.pair_ranks[where], NEVER)
                ok[at[maybe[(rank < until_a[maybe]) & (rank <= until_b[maybe])]]] = False
            ta, tb = self.time[a], self.time[b]
            go = np.flatnonzero(ok[at] & (np.maximum(ta, tb) >= 0))
            at, a, b, ta, tb, until_a, until_b = at[go], a[go], b[go], ta[go], tb[go], until_a[go], until_b[go]
            undo = tb >= ta
            until_b, until_a = np.where(undo, tb, until_b), np.where(undo, until_a, ta)
            b, a = np.where(undo, self.left[b], b), np.where(undo, a, self.right[a])
        return ok


def _pack(codes: np.ndarray) -> np.ndarray:
    """Four 16-bit codes in one 64-bit word."""
    c = codes.astype(np.uint64)
    return c[..., 0] << np.uint64(48) | c[..., 1] << np.uint64(32) | c[..., 2] << np.uint64(16) | c[..., 3]


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.uint64)


def suffix_array(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next DEPTH codes, and the next four codes of each position as a word."""
    n = len(code)
    padded = np.concatenate([code, np.zeros(DEPTH + 4, np.uint16)]).astype(np.uint64)
    m = n + DEPTH
    word = _pack(np.stack([padded[i : m + i] for i in range(4)], 1))
    rank, reach = _dense(word), 4
    while reach < DEPTH // 2:
        rank = _dense(rank << np.uint64(32) | np.concatenate([rank[reach:], np.zeros(reach, np.uint64)]))
        reach *= 2
    key = rank << np.uint64(32) | np.concatenate([rank[reach:], np.zeros(reach, np.uint64)])
    return np.argsort(key[:n]), word


def occurrences(v: Vocabulary, order: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range in the suffix array of the positions where each piece occurs."""

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(v.keys), np.int64), np.full(len(v.keys), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for j in range(DEPTH // 4):
                w = word[at + 4 * j] & v.masks[:, j]
                less |= equal & (w < v.keys[:, j])
                equal &= w == v.keys[:, j]
            up = open_ & (less | equal if after else less)
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return lo

    return bound(False), bound(True)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(starts - total[:-1], counts) + np.arange(total[-1])


def encode_segments(v: Vocabulary, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments end to end, and where each begins (one more at the end)."""
    points = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = v.code[points]
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order, word = suffix_array(code)
    lo, hi = occurrences(v, order, word)
    counts = np.where(v.reached, hi - lo, 0)
    piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    end = order[ragged(lo, counts)] + v.lengths[piece]
    by_end = np.argsort(end << 5 | (31 - v.lengths[piece]))
    piece = piece[by_end]
    begin = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=len(code) + 1))])
    last = np.full(len(code) + 1, v.outside, np.int64)
    inner = np.zeros(len(code) + 1, bool)  # positions that aren't the start of a segment
    inner[ragged(first + 1, sizes)] = True
    wide = np.flatnonzero(sizes > WIDE)
    narrow = np.argsort(-np.where(sizes > WIDE, 0, sizes), kind="stable")
    sorted_sizes = np.where(sizes > WIDE, 0, sizes)[narrow]
    for j in range(1, int(sorted_sizes[0]) + 1 if len(narrow) else 0):
        _relax(v, first[narrow[: np.searchsorted(-sorted_sizes, -j, "right")]] + j, begin, piece, last, inner)
    for k in wide:
        _relax_alone(v, int(first[k]), int(sizes[k]), begin, piece, last)
    return _trace(v, first, sizes, last, points)


def _relax(v, at, begin, piece, last, inner) -> None:
    """Settle the best last piece at positions of different segments, trying long edges first."""
    edge, stop = begin[at], begin[at + 1]
    outside = edge == stop
    at, edge, stop = at[~outside], edge[~outside], stop[~outside]
    while len(at):
        if (edge >= stop).any():
            raise AssertionError("a position without a compatible piece")
        p = piece[edge]
        start = at - v.lengths[p]
        ok = np.ones(len(at), bool)
        known = np.flatnonzero(inner[start])
        ok[known] = v.compatible(last[start[known]], p[known])
        last[at[ok]] = p[ok]
        at, edge, stop = at[~ok], edge[~ok] + 1, stop[~ok]


def _relax_alone(v, first: int, size: int, begin, piece, last) -> None:
    known: dict[tuple[int, int], bool] = {}
    for at in range(first + 1, first + size + 1):
        for e in range(int(begin[at]), int(begin[at + 1])):
            p = int(piece[e])
            start = at - int(v.lengths[p])
            pair = int(last[start]), p
            if start > first and pair not in known:
                known[pair] = bool(v.compatible(np.array([pair[0]]), np.array([p]))[0])
            if start == first or known[pair]:
                last[at] = p
                break


def _trace(v, first, sizes, last, points) -> tuple[np.ndarray, np.ndarray]:
    """Follow best last pieces back from the end of every segment."""
    alive, at = np.arange(len(first)), first + sizes
    alive, at = alive[sizes > 0], at[sizes > 0]
    found = []
    while len(alive):
        p = last[at]
        at = at - v.lengths[p]
        found.append((at, p))
        go = at > first[alive]
        alive, at = alive[go], at[go]
    where = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    p = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
    order = np.argsort(where)
    where, p = where[order], p[order]
    out = p == v.outside
    ids = np.zeros(len(p), np.int32)
    ids[~out] = v.ids[p[~out]]
    width = np.ones(len(p), np.int64)
    if out.any():
        kinds, kind = np.unique(points[where[out]], return_inverse=True)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in kinds]
        table = np.zeros((len(kinds), 4), np.int32)
        for i, s in enumerate(spelled):
            table[i, : len(s)] = v.byte_ids[list(s)]
        width[out] = np.array([len(s) for s in spelled])[kind]
        row = np.zeros(len(p), np.int64)
        row[out] = kind
        src = np.repeat(np.arange(len(p)), width)
        nth = ragged(np.zeros(len(p), np.int64), width)
        ids = np.where(out[src], table[row[src], nth], ids[src]).astype(np.int32)
    place = np.concatenate([[0], np.cumsum(width)])
    return ids, np.append(place[np.searchsorted(where, first)], place[-1])


class Encoder:
    """Encodes batches; ids of segments met before are kept while they fit."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.edge = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins (one more at the end)."""
        if len(self.known) > CACHE_SEGMENTS:
            self._reset()
        cut = [SEGMENT.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        known, flat = self.known, list(itertools.chain.from_iterable(cut))
        new = [s for s in dict.fromkeys(flat) if s not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        index = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        if new:  # indexed in slices, as an index takes about 200 bytes a character
            done = [encode_segments(self.v, new[lo:hi]) for lo, hi in chunks(new, INDEX_CHARS)]
            ends = itertools.accumulate((e[-1] for _, e in done), initial=self.edge[-1])
            self.edge = np.concatenate([self.edge, *[e[1:] + at for (_, e), at in zip(done, ends, strict=False)]])
            self.ids = np.concatenate([self.ids, *[ids for ids, _ in done]])
        counts = self.edge[index + 1] - self.edge[index]
        total = np.concatenate([[0], np.cumsum(counts)])
        parts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        return self.ids[ragged(self.edge[index], counts)], total[parts]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids, without the space that encoding puts first."""
        return b"".join(map(self.v.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


_encoders: dict[int, Encoder] = {}


def _encode(shared):
    def run(batches):
        v = shared.value
        if id(v) not in _encoders:  # a worker keeps the encoder of one vocabulary
            _encoders.clear()
            _encoders[id(v)] = Encoder(v)
        encoder = _encoders[id(v)]
        for b in batches:
            sizes, start = pa.compute.fill_null(pa.compute.utf8_length(b.column(1)), 0).to_pylist(), 0
            while start < len(b):
                end, size = start, 0
                while end < len(b) and (size == 0 or size + sizes[end] <= BATCH_CHARS):
                    size += sizes[end]
                    end += 1
                texts = [t or "" for t in b.column(1).slice(start, end - start).to_pylist()]
                ids, edge = encoder.encode(texts)
                same = [encoder.decode(ids[x:y].tolist()) == t.replace(SPACE, " ") for x, y, t in zip(edge, edge[1:], texts, strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(np.diff(edge)), lists, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])
                start = end
        release()

    return run


#: Texts that show a model's normaliser, dummy prefix and treatment of white space.
PROBES = ["", "a", " a", "a  b ", "Hello, World", "\ufb01 \u2460 \uff21", "e\u0301\n\tx", "\u2581 \U0001f600"]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The tables of a model file; a model whose normaliser or kind isn't the one built here raises."""
    import sentencepiece

    v = Vocabulary(path)
    ids, edge = Encoder(v).encode(PROBES)
    if [ids[a:b].tolist() for a, b in itertools.pairwise(edge.tolist())] != sentencepiece.SentencePieceProcessor(model_file=path).encode(PROBES):
        raise ValueError(f"{path} normalises or splits texts in a way that isn't built here")
    return v


def encode_pieces(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids and whether decoding the ids gives the text again, for every row."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(_encode(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, round_trip boolean")


def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
