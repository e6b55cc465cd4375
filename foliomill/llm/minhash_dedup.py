"""Near-duplicates: chosen-path similarity join over minwise tokens.

A document is the set of its distinct k-word shingles. Equal sets are one class, with an id of its own. Its
signature holds the set's smallest value under each of ``COORDINATES`` hashes (its minwise tokens).

The first two branchings are made at once, as nodes of one token would be large in any large table: they deal every
class to ``FIRST`` nodes of two tokens each. A node of over ``SMALL`` classes branches again, by one token, or by two
in a quarter of the nodes; the node's own hash chooses which. So a pair of likeness 0.8 is expected in as many nodes
at each depth as at the one before (1.25 * 0.8 = 1), while less alike ones thin out, and the ``FIRST`` lines of
descent are the independent repetitions: with q(0) = 0 and
q(d) = 0.75 (0.2 + 0.8 q(d - 1)) + 0.25 (0.2 + 0.8 q(d - 1))^2, no node of depth d holds the pair with probability
(0.36 + 0.64 q(d - 2))^FIRST: 3e-11 at depth 2 and 3e-6 at depth 5, where branching ends.

Small nodes are compared exhaustively by sketches of ``SKETCH`` bytes: pairs alike to ``MAYBE``, nearly five standard
deviations below 0.8, are candidates, and only links confirmed on full sets count. Members of one component aren't
compared. So groups of near copies are contracted first: in up to ``ROUNDS`` rounds every class proposes its most
alike neighbour of another component (in large nodes, of a random part of ``SMALL``) and the first class of that
part that it may be linked with, which joins a part of near copies at once; confirmed proposals are merged. Nodes that hold a single component, and small ones without a candidate, are done. Then every remaining candidate
counts: its class of the smaller component asks the other component, whose members all meet the askers on full sets, in
parts of ``PART`` of each. In a large node with few classes outside its largest component, and in what is still large
at the last depth, the classes outside that component meet the whole node, in blocks of ``PART`` of each.

Texts are read again to confirm links. Only those that are asked for are shuffled: their ids are broadcast if there are
``FEW_IDS`` at most (about 50 MB); beyond that all texts are.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; texts with
fewer than k words are one shingle; rows with equal doc_id get a row each, with the size of their own set, and are
one document, which is linked with whatever one of its texts is linked with; rows with a null doc_id are linked with
nothing and have a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import U, Hasher, Words, as_bytes, chunks, mix, release, signed
from .workspace import Workspace, small_batches

SHINGLE = 5
PERCENT = 80
COORDINATES = 128
SKETCH = 256
FIRST = 24
DEPTH = 5
SMALL = 128
MAYBE = 0.68
ROUNDS = 2
PART = 256
FEW_IDS = 1 << 20


@functools.cache
def _hashers() -> tuple[Hasher, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(404)
    return Hasher(404), rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, SKETCH, dtype=np.uint32)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    words = Words(texts, lower=True)
    hashes = _hashers()[0].words(words.buf, words.starts, words.ends)
    wide = _hashers()[0].sequences(hashes, k)
    out = []
    for i in range(len(texts)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= k:
            out.append(np.unique(wide[a : b - k + 1]))
        else:
            out.append(_hashers()[0].sequences(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each hash."""
    _, a, b = _hashers()
    low, x = np.full(len(a), 2**32 - 1, np.uint32), (s >> U(32)).astype(np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(low, (x[i : i + 256, None] * a + b).min(0), out=low)
    return low


def _digest(s: np.ndarray) -> tuple[int, int]:
    return (int(s.sum()), int(mix(s ^ U(0x5555)).sum())) if len(s) else (0, 0)


def _describe(k: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), as_bytes(b.column(1))
            n, d1, d2, paths, sketches = [], [], [], [], []
            for lo, hi in chunks(texts):
                for s in shingle_sets(texts[lo:hi], k):
                    one, two = _digest(s)
                    n.append(len(s))
                    d1.append(one)
                    d2.append(two)
                    if len(s):
                        sig = signature(s)
                        paths.append(sig[:COORDINATES].tobytes())
                        sketches.append((mix(sig.astype(U)) & U(255)).astype(np.uint8).tobytes())
                    else:
                        paths.append(None)
                        sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(signed(np.array(d1, U))), pa.array(signed(np.array(d2, U))), pa.array(paths, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "d1", "d2", "path", "sketch"],
            )
        release()

    return run


def _child(node, coordinate, token) -> np.ndarray:
    return mix(node * U(0x9E3779B97F4A7C15) + coordinate * U(0xC2B2AE3D27D4EB4F) + token)


def _paths(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(U)


def _first(batches):
    """(node, id) at depth 2 of each (id, path)."""
    for b in batches:
        at, path = np.arange(0, 2 * FIRST, 2), _paths(b.column(1))
        nodes = _child(U(1), at.astype(U)[None, :], path[:, at])
        nodes = _child(nodes, at.astype(U)[None, :], path[:, at + 1])
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), FIRST)
        yield pa.RecordBatch.from_arrays([pa.array(signed(nodes.ravel())), pa.array(ids, pa.int64())], ["node", "id"])


def _branch(batches):
    """(node, id, root, own) one step down from each (id, root, own, path, nodes)."""
    for b in batches:
        path, lists = _paths(b.column(3)), b.column(4)
        counts = np.diff(lists.offsets.to_numpy())
        node = mix(lists.flatten().to_numpy(zero_copy_only=False).view(U) ^ U(0xA5A5A5A5))
        row = np.repeat(np.arange(len(b)), counts)
        one = (node % U(COORDINATES)).astype(np.int64)
        step = 1 + ((node >> U(32)) % U(COORDINATES - 1)).astype(np.int64)
        two = (one + step) % COORDINATES  # another one
        forks = np.flatnonzero(node >> U(62) == 0)
        at, row_of, parent = np.concatenate([one, two[forks]]), np.concatenate([row, row[forks]]), np.concatenate([node, node[forks]])
        child = _child(parent, at.astype(U), path[row_of, at])
        rest = [pa.array(b.column(i).to_numpy(zero_copy_only=False)[row_of], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(signed(child)), *rest], ["node", "id", "root", "own"])


def runs(batches, keys: int):
    """Consecutive rows with equal values in the first columns, as tables, across batches."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        change[0] = True
        for k in range(keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if kept and all(kept[-1].column(k)[len(kept[-1]) - 1].as_py() == b.column(k)[0].as_py() for k in range(keys)):
            change[0] = False
        edges = np.flatnonzero(change).tolist()
        if kept and edges:
            yield pa.Table.from_batches([*kept, b.slice(0, edges[0])])
            kept = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield pa.Table.from_batches([b.slice(lo, hi - lo)])
        last = edges[-1] if edges else 0
        kept.append(b.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Likeness of a sketch to each of many, corrected for values that agree by chance."""
    return (np.count_nonzero(x[None, :] == y, axis=1) / len(x) - 1 / 256) / (1 - 1 / 256)


def _block(t: pa.Table, percent: int):
    """Ids, roots and a function that gives the candidates of a row and their likeness; None if the block has one component."""
    ids, roots, sizes = (t[c].to_numpy() for c in ("id", "root", "n"))
    if len(ids) < 2 or (roots == roots[0]).all():
        return None
    sketches = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)

    def near(i: int) -> tuple[np.ndarray, np.ndarray]:
        fits = np.flatnonzero((roots != roots[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        like = alike(sketches[i], sketches[fits])
        return fits[like >= MAYBE], like[like >= MAYBE]

    return ids, roots, near


def _nearest(percent: int):
    """(node, id, root, star, like, other, other_root): the most alike candidate of each member of a block, and its star's first class."""

    def run(batches):
        out: list[tuple] = []
        for t in runs(batches, 2):
            if block := _block(t, percent):
                ids, roots, near = block
                node, free = t["node"][0].as_py(), np.ones(len(ids), bool)
                for i in np.argsort(ids).tolist():
                    at, like = near(i)
                    if not len(at):
                        continue
                    j = at[np.lexsort((ids[at], -like))[0]]
                    out.append((node, ids[i], roots[i], False, like.max(), ids[j], roots[j]))
                    if free[i]:  # the smallest id that is in no star yet
                        own = at[free[at]]
                        out += [(node, ids[j], roots[j], True, 0.0, ids[i], roots[i]) for j in own.tolist()]
                        free[own] = False
                    free[i] = False
            if len(out) > 20_000:
                yield _rows(out, NEAREST)
                out = []
        yield _rows(out, NEAREST)

    return run


def _asks(percent: int):
    """(id, root, other): classes of a block with the components that they may be linked with, from the smaller one's side."""

    def run(batches):
        out: list[tuple] = []
        for t in runs(batches, 2):
            if block := _block(t, percent):
                ids, roots, near = block
                own, found = t["own"].to_numpy(), set()
                for i in np.flatnonzero(t["query"].to_numpy()).tolist():
                    for j in near(i)[0].tolist():
                        x, y = (i, j) if (own[i], -roots[i]) < (own[j], -roots[j]) else (j, i)
                        found.add((int(ids[x]), int(roots[x]), int(roots[y])))
                out += found
            if len(out) > 20_000:
                yield _rows(out, ASK)
                out = []
        yield _rows(out, ASK)

    return run


NEAREST = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("root", pa.int64()), ("star", pa.bool_()), ("like", pa.float64()), ("other", pa.int64()), ("other_root", pa.int64())])
ASK = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("other", pa.int64())])
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class _Askers:
    """Sets that are compared with others one by one, all at once through one sorted list of their shingles."""

    def __init__(self, percent: int):
        self.percent, self.sets, self.roots, self.index = percent, [], [], None

    def add(self, s: np.ndarray, root: int) -> None:
        self.sets.append(s)
        self.roots.append(root)
        self.index = None

    def linked(self, s: np.ndarray) -> list[int]:
        """Roots of those that are linked with s."""
        if self.index is None:
            tokens = np.concatenate(self.sets)
            order = np.argsort(tokens, kind="stable")
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            self.index = tokens[order], owner[order], np.array([len(x) for x in self.sets])
        tokens, owner, sizes = self.index
        lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sizes))
        return [self.roots[i] for i in np.flatnonzero(100 * common >= self.percent * (sizes + len(s) - common))]


def _confirm(k: int, percent: int):
    """(a, b): roots of the askers of a block (place 0, read first) and of the members that they are linked with."""

    def run(batches):
        askers = key = None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            place, n, d1 = b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()
            roots, texts = b.column(3).to_pylist(), as_bytes(b.column(6))
            out = set()
            for lo, hi in chunks(texts):
                for i, s in zip(range(lo, hi), shingle_sets(texts[lo:hi], k), strict=True):
                    if len(s) != n[i] or int(s.sum(dtype=U).view(np.int64)) != d1[i]:
                        continue  # another text of this doc_id
                    if keys[i] != key:
                        askers, key = _Askers(percent), keys[i]
                    if place[i] == 0:
                        askers.add(s, roots[i])
                    elif askers.sets:
                        out |= {(root, roots[i]) for root in askers.linked(s) if root != roots[i]}
            yield _rows(list(out), EDGE)
        release()

    return run


class Join:
    """The steps of one similarity join; classes are (id, doc_id, n, d1, path, sketch), labels (id, root) of components."""

    def __init__(self, ws: Workspace, texts: DataFrame, classes: DataFrame, k: int, percent: int):
        self.ws, self.texts, self.classes, self.k, self.percent = ws, texts, classes, k, percent

    def confirm(self, rows: DataFrame, name: str) -> DataFrame:
        """Distinct edges (a, b) of roots, from rows (key, block, place, root, id): askers have place 0."""
        wanted = self.ws.write(rows.join(self.classes.select("id", "doc_id", "n", "d1"), "id").select("key", "block", "place", "root", "n", "d1", "doc_id"), f"{name}-wanted")
        ids = wanted.select("doc_id").distinct()
        few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
        texts = self.texts.join(F.broadcast(ids), "doc_id", "left_semi") if few else self.texts
        dealt = wanted.join(texts, "doc_id").select("key", "block", "place", "root", "n", "d1", "text")
        dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "place")
        return self.ws.write(dealt.mapInArrow(_confirm(self.k, self.percent), "a long, b long").distinct(), name)

    def proposals(self, pairs: DataFrame, name: str) -> DataFrame:
        """Edges of roots from pairs (pivot, pivot_root, id, root) that are linked."""
        salts = self.ws.write(pairs.groupBy("pivot", "pivot_root").agg(F.ceil(F.count("*") / PART).cast("long").alias("salts")), f"{name}-salts")
        block = F.pmod(F.xxhash64("id"), "salts")
        rows = pairs.join(salts.drop("pivot_root"), "pivot").select(F.col("pivot").alias("key"), block.alias("block"), F.lit(1).alias("place"), "root", "id")
        heads = salts.select(F.col("pivot").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("block"), F.lit(0).alias("place"), F.col("pivot_root").alias("root"), F.col("pivot").alias("id"))
        return self.confirm(rows.unionByName(heads), name)

    def answers(self, asks: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """Edges of roots from asks (id, root, other) whose class is linked with a member of the component other."""
        asked = asks.groupBy(F.col("other").alias("key")).agg(F.greatest(F.ceil(F.count("*") / PART), F.lit(1)).cast("long").alias("asks"))
        asked = self.ws.write(asked, f"{name}-asked")
        joined = labels.join(asked.select(F.col("key").alias("root")), "root", "left_semi").select("id", F.col("root").alias("key"))
        alone = asked.select(F.col("key").alias("id"), "key").join(joined, ["id", "key"], "left_anti")
        members = self.ws.write(joined.unionByName(alone), f"{name}-members")
        sizes = members.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("long").alias("salts")).join(asked, "key")
        sizes = self.ws.write(sizes, f"{name}-sizes")
        block = lambda ask, salt: ask * F.col("salts") + salt
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        own = F.pmod(F.xxhash64("id"), "salts")
        ask = F.pmod(F.xxhash64("id", F.lit(1)), "asks")
        rows = members.join(sizes, "key").select("key", F.explode(F.transform(upto("asks"), lambda a: block(a, own))).alias("block"), F.lit(1).alias("place"), F.col("key").alias("root"), "id")
        heads = asks.withColumnRenamed("other", "key").join(sizes, "key").select("key", F.explode(F.transform(upto("salts"), lambda x: block(ask, x))).alias("block"), F.lit(0).alias("place"), "root", "id")
        return self.confirm(rows.unionByName(heads), name)

    def merge(self, labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """Labels (id, root; an id without one is its own) with the roots at the ends of the edges joined."""
        if edges.isEmpty():
            return labels
        found = components(self.ws, edges, name).select(F.col("id").alias("root"), F.col("root").alias("new"))
        moved = labels.join(found, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
        fresh = found.select(F.col("root").alias("id"), F.col("new").alias("root")).join(labels.select("id"), "id", "left_anti")
        return self.ws.write(moved.unionByName(fresh), f"{name}-labels")

    def mixed(self, members: DataFrame, name: str) -> DataFrame:
        """Members (node, id, root) of nodes with several components, with the node's size."""
        stats = members.groupBy("node").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("node", "size")
        return self.ws.write(members.join(self.ws.write(stats, f"stats-{name}"), "node"), name)

    def compare(self, rows: DataFrame, step, schema: str) -> DataFrame:
        """Blocks (node, block, ...) with sizes and sketches, through a step."""
        names = [c for c in rows.columns if c not in ("node", "block")]
        full = rows.join(self.classes.select("id", "n", "sketch"), "id").select("node", "block", *names, "n", "sketch")
        return full.repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(step, schema)

    def contract(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members (node, id) that may still be linked, and labels, after groups of near copies have been merged."""
        labels = self.ws.spark.createDataFrame([], "id long, root long")
        for i in range(ROUNDS):
            met = self.mixed(members.join(labels, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root")), f"round{i}")
            salts = F.ceil(F.col("size") / SMALL).cast("long")
            rows = met.select("node", F.pmod(F.xxhash64("id", F.lit(i)), salts).alias("block"), "id", "root")
            near = self.ws.write(self.compare(rows, _nearest(self.percent), "node long, id long, root long, star boolean, like double, other long, other_root long"), f"near{i}")
            active = near.select("node").distinct()
            small = met.filter(F.col("size") <= SMALL).select("node", "id").join(active, "node", "left_semi")
            members = self.ws.write(small.unionByName(met.filter(F.col("size") > SMALL).select("node", "id")), f"active{i}")
            first = F.struct("like", (-F.col("other")).alias("order"), "other", "other_root")  # of stars, that with the smallest id
            best = near.groupBy("id", "root", "star").agg(F.max(first).alias("x")).select("id", "root", "x.other", "x.other_root")
            swap = lambda a, b: F.when(F.col("other") < F.col("id"), F.col(a)).otherwise(F.col(b))
            pairs = best.select(swap("other", "id").alias("pivot"), swap("other_root", "root").alias("pivot_root"), swap("id", "other").alias("id"), swap("root", "other_root").alias("root"))
            pairs = self.ws.write(pairs.distinct(), f"pairs{i}")
            found = self.proposals(pairs, f"found{i}")
            if found.isEmpty():
                break
            labels = self.merge(labels, found, f"merge{i}")
        return members, labels

    def asks(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Distinct (id, root, other): classes that may be linked with a component, of members (node, id) at depth 2."""
        own = self.ws.write(labels.groupBy("root").agg(F.count("*").alias("own")), "own")
        known = self.ws.write(labels.join(own, "root").select("id", "root", "own"), "known")
        members = members.join(known, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root"), F.coalesce("own", F.lit(1)).alias("own"))
        found = []
        for depth in range(2, DEPTH + 1):
            met = self.mixed(members, f"met{depth}")
            found.append(met.filter(F.col("size") <= SMALL).select("node", F.lit(0).cast("long").alias("block"), "id", "root", "own", F.lit(True).alias("query")))
            large = met.filter(F.col("size") > SMALL)
            if large.isEmpty():
                break
            here = large.groupBy("node", "root").agg(F.count("*").alias("here"), F.max("size").alias("size"))
            tops = here.groupBy("node").agg(F.max(F.struct("here", F.col("root").alias("top"))).alias("best"), F.max("size").alias("size"))
            tops = self.ws.write(tops.select("node", "best.top", (F.col("size") - F.col("best.here")).alias("rest")), f"tops{depth}")
            done = F.lit(True) if depth == DEPTH else F.col("rest") <= SMALL
            found.append(self.blocks(large.join(tops.filter(done), "node")))
            if depth < DEPTH:
                nodes = large.join(tops.filter(~done).select("node"), "node").groupBy("id", "root", "own").agg(F.collect_list("node").alias("nodes"))
                members = nodes.join(self.classes.select("id", "path"), "id").select("id", "root", "own", "path", "nodes")
                members = self.ws.write(members.mapInArrow(_branch, "node long, id long, root long, own long"), f"members{depth + 1}")
        rows = functools.reduce(DataFrame.unionByName, found)
        return self.ws.write(self.compare(rows, _asks(self.percent), "id long, root long, other long").distinct(), "asks")

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Members (node, id, root, own, size, top, rest) of large nodes in blocks: every class outside the component top meets the whole node."""
        part = lambda n: F.greatest(F.ceil(n / PART), F.lit(1)).cast("long")
        rows = rows.withColumn("asks", part(F.col("rest"))).withColumn("salts", part(F.col("size")))
        mine = F.pmod(F.xxhash64("id"), "salts")
        ask = F.pmod(F.xxhash64("id", F.lit(1)), "asks")
        block = lambda a, s: a * F.col("salts") + s
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        as_row = F.transform(upto("asks"), lambda a: F.struct(block(a, mine).alias("block"), F.lit(False).alias("query")))
        as_query = F.transform(upto("salts"), lambda s: F.struct(block(ask, s).alias("block"), F.lit(True).alias("query")))
        both = F.concat(as_query, F.filter(as_row, lambda x: x["block"] != block(ask, mine)))
        at = F.explode(F.when(F.col("root") == F.col("top"), as_row).otherwise(both)).alias("at")
        return rows.select("node", "id", "root", "own", at).select("node", "at.block", "id", "root", "own", "at.query")


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, root) for every end of the edges (a, b); root is the smallest id of its component.

    Each round hooks every id to the smallest label next to it and jumps over labels; every round is a written table.
    """
    both = ws.write(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = ws.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")), f"{name}-0")
    for i in range(1, 64):
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        own = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hook = own.groupBy(F.col("old").alias("id")).agg(F.min("root").alias("hook"))
        hooked = ws.write(own.join(hook, own["old"] == hook["id"]).select(own["id"], "old", F.least("root", "hook").alias("root")), f"{name}-h{i}")
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = ws.write(hooked.join(up, "root", "left").select("id", "old", F.least("root", F.coalesce("top", "root")).alias("root")), f"{name}-{i}")
        if new.filter("root <> old").isEmpty():
            return labels
        labels = new.select("id", "root")
    raise RuntimeError(f"components of {name} aren't settled after 63 rounds")


def link_components(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    small_batches(spark)
    ws = Workspace(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    all_rows = ws.write(texts.mapInArrow(_describe(k), "doc_id long, n long, d1 long, d2 long, path binary, sketch binary"), "described")
    full = all_rows.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id"), F.min("path").alias("path"), F.min("sketch").alias("sketch"))
    classes = ws.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    join = Join(ws, texts, classes, k, percent)
    first = ws.write(classes.select("id", "path").mapInArrow(_first, "node long, id long"), "first")
    members, labels = join.contract(first)
    linked = join.answers(join.asks(members, labels), labels, "linked")
    keys = all_rows.select("doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "id"), ["d1", "d2", "n"], "left")
    keys = ws.write(keys.select("doc_id", "n", "id"), "keys")
    twice = keys.filter("id is not null and doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("doc_id", "lo")
    same = keys.join(twice, "doc_id").filter("id <> lo").select("lo", "id").distinct()  # the texts of one doc_id
    rooted = same.join(labels.select("id", "root"), "id", "left").select("lo", F.coalesce("root", "id").alias("b"))
    rooted = rooted.join(labels.select(F.col("id").alias("lo"), "root"), "lo", "left").select(F.coalesce("root", "lo").alias("a"), "b").filter("a <> b")
    labels = join.merge(labels, linked.unionByName(rooted), "all")
    smallest = classes.select("id", "doc_id").join(labels, "id").groupBy("root").agg(F.min("doc_id").alias("component"))
    named = ws.write(labels.join(smallest, "root").select("id", "component"), "named")
    out = keys.filter("id is not null").join(classes.select("id", F.col("doc_id").alias("first")), "id").join(named, "id", "left")
    out = out.select("doc_id", "n", F.coalesce("component", "first").alias("component"))
    rest = keys.filter("id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    return out.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
