"""Similarity join of texts by Jaccard over word n-grams.

Rare-first prefix filtering: a text's n-grams are ordered by how often they
occur (a counting sketch of fixed size over all texts, then the hash), and two
texts that reach the threshold must share an n-gram in their prefixes. Texts
with equal sets are one node. Postings that meet at an n-gram go through the
length and positional filters, each pair then once through the suffix filter
(a bound on the Hamming distance from n-gram counts by hash range) and, if it
is left, once through the exact comparison of both sets.

Groups of near copies do not expand into all pairs. A first round compares each
node with one centre: of the smallest and the least edited node of each of its
lists the one that it shares most prefix n-grams with. After it only lists that
hold several components matter, since a pair inside one component changes
nothing; there the nodes outside the list's largest component meet the nodes of
other components, by n-gram and size class. Pairs of the first round are not
compared again.

A crowded list (more than ``CROWD`` nodes outside its largest component, as in
a large family of copies that are just too far apart) would bring all pairs
past these filters. Its nodes are filtered once more, by their difference from
the component's hub z: |a ^ b| = |Da| + |Db| - 2 |Da & Db| for Da = a ^ z, so a
and b reach the threshold only if Da and Db share so many n-grams, and since
one of the two is not linked with z that is at least one. The differences have
rare-first prefixes too, and meet by (z, n-gram) with the positional filter.
This is exact, and no list is too long for it.

Pairs travel as ids; the n-gram sets are computed once for each node that a
pair needs. Postings of an n-gram that the sketch shows to be far above the
mean are dealt over ``SLICES`` tasks.

Definitions: A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a text with
fewer words than ``size`` has its whole sequence as its one n-gram; a text
without words (or null) has none and is linked with nothing. N-grams are held
as 64-bit hashes. A row with null ``doc_id`` links like any other, but gets a
null component. Rows that share a ``doc_id`` are separate texts of one id. Ties
between centres fall by hash and change no result. A very long text is one
piece of work, and its set (8 bytes a distinct n-gram) one value of a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import base, kernels
from quarry.llm.components import connected_components

SIZE = 5
PERCENT = 80
SKETCH_BITS = 20
#: An n-gram whose sketch cell is above HOT times the mean cell and HOT_LEAST has its postings dealt over SLICES tasks.
HOT, HOT_LEAST, SLICES = 8, 1 << 16, 64
#: Sketches that one task adds up.
FAN = 32
#: Distinct sets that a task remembers, to post equal texts once.
SEEN = 1 << 18
#: A list with more nodes than this outside its largest component is filtered by differences.
CROWD = 32
_CHUNKS = 64
_RANGES = 64


def sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    low = kernels.LOWER[data]
    s, e, first = kernels.words(low, off)
    w = kernels.word_hashes(low, s, e)
    g, at = kernels.gram_hashes(w, first, size)
    lo = np.searchsorted(at, first)
    n = np.diff(first)
    whole = kernels.span_hashes(w, first[:-1], first[1:])
    return [np.unique(g[lo[d] : lo[d + 1]]) if n[d] >= size else whole[d : d + 1][: n[d]] for d in range(len(n))]


def node_of(u: np.ndarray) -> int:
    """One signed 64-bit name for a set."""
    with np.errstate(over="ignore"):
        x = kernels.mix(np.array([kernels.mix(u).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64))
    return int(x.view(np.int64)[0])


def _cells(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


PROFILE = "doc_id long, n int, node long, data binary"


def _profile(size: int):
    """A row for each text (its counts by hash range), and the task's part of the sketch as rows with n = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part, data, off in base.pieces(batch, "text"):
                found = sets(data, off, size)
                cell, k = np.unique(_cells(np.concatenate(found)), return_counts=True)
                sketch[cell] += k.astype(np.uint32)
                ranges = [np.minimum(np.bincount((u & np.uint64(_RANGES - 1)).astype(np.int64), minlength=_RANGES), 65535).astype(np.uint16).tobytes() for u in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array([len(u) for u in found], pa.int32()), pa.array([node_of(u) for u in found], pa.int64()), base.binary(ranges)],
                    names=["doc_id", "n", "node", "data"],
                )
        if sketch.any():
            rows = sketch.reshape(_CHUNKS, -1)
            small = np.uint8 if sketch.max() < 1 << 8 else np.uint16 if sketch.max() < 1 << 16 else np.uint32
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(_CHUNKS, pa.int64()), pa.array([-1] * _CHUNKS, pa.int32()), pa.array(range(_CHUNKS), pa.int64()), base.binary([r.astype(small).tobytes() for r in rows])],
                names=["doc_id", "n", "node", "data"],
            )

    return run


def _counts(data: bytes) -> np.ndarray:
    """One chunk of a sketch, whatever the width of its numbers."""
    width = len(data) * _CHUNKS >> SKETCH_BITS
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width]).astype(np.int64)


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // _CHUNKS, np.int64)
    for b in table.column("data").to_pylist():
        total += _counts(b)
    return pa.table({"node": table.column("node").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches parts(node, data), at most FAN rows a task at a time."""
    tasks = -(-parts.count() // _CHUNKS)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.groupBy("node", F.pmod(F.xxhash64(F.rand(5)), F.lit(tasks)).alias("k")).applyInArrow(lambda _, t: _add(t), "node long, data binary")
    out = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.int64)
    for r in parts.groupBy("node").applyInArrow(_add, "node long, data binary").toLocalIterator():  # of fixed size
        out[r.node] = np.frombuffer(r.data, np.int64)
    return out.ravel()


POSTS = "token long, node long, n int, pos int, slice int"


def _postings(size: int, percent: int, sketch, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.frombuffer(sketch.value, np.uint32)
        seen: set[int] = set()  # a set that this task has posted needs no second posting
        for batch in batches:
            for _, data, off in base.pieces(batch, "text"):
                tokens, nodes, ns, cells = [], [], [], []
                for u in sets(data, off, size):
                    n = len(u)
                    if not n or (node := node_of(u)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    c = count[_cells(u)]
                    order = np.lexsort((u, c))[: n - -(-percent * n // 100) + 1]
                    tokens.append(u[order])
                    cells.append(c[order])
                    nodes.append(node)
                    ns.append(n)
                if not tokens:
                    continue
                k = np.array([len(t) for t in tokens])
                pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                node = np.repeat(np.array(nodes, np.int64), k)
                dealt = np.where(np.concatenate(cells) > hot, 1 + (node & (SLICES - 1)), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(node), pa.array(np.repeat(np.array(ns, np.int32), k)), pa.array(pos.astype(np.int32)), pa.array(dealt.astype(np.int32))],
                    names=["token", "node", "n", "pos", "slice"],
                )

    return run


def _suffix_filter(percent: int):
    """Keeps pairs whose Hamming distance, bounded from below by range counts, allows the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(-1, _RANGES).astype(np.int64) for c in ("ha", "hb"))
            na, nb = (base.longs(batch, c) for c in ("na", "nb"))
            need = -(-percent * (na + nb) // (100 + percent))
            ok = np.abs(a - b).sum(1) <= na + nb - 2 * need
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return run


def _set_of(size: int, wanted: bool):
    """(node, grams) of each text with words; with ``wanted`` only of rows whose text has the set of their ``node`` (an id may have several texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in base.pieces(batch, "text"):
                found = [(node_of(u), u) for u in sets(data, off, size) if len(u) or wanted]
                if wanted:
                    found = [x for x, w in zip(found, base.longs(part, "node").tolist()) if x[0] == w and len(x[1])]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), base.binary([u.tobytes() for _, u in found])], names=["node", "grams"])

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = (batch.column(batch.schema.get_field_index(c)) for c in ("ga", "gb"))
            ok = []
            for x, y in zip(xs, ys):
                u, v = (np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y))
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                both = int((v[at] == u).sum())
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


APART = "z long, node long, n int, linked boolean, x long, pos int, size int"


def _apart(percent: int, sketch):
    """For node b and hub a: whether they are linked, and the rare-first prefix of their difference (x, pos) of so many n-grams (size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.frombuffer(sketch.value, np.uint32)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
        up, down = 100 + percent, 100 - percent
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            sides = [batch.column(batch.schema.get_field_index(c)) for c in ("ga", "gb")]
            for z, node, gz, gx in zip(base.longs(batch, "a").tolist(), base.longs(batch, "b").tolist(), *sides):
                u, v = (np.frombuffer(c.as_buffer(), np.uint64) for c in (gz, gx))
                d = np.setxor1d(u, v, True)
                size = len(d)
                linked = up * size <= down * (len(u) + len(v))
                # common n-grams with the difference of a node that may be linked with this one, at least
                if linked:  # the other one is not linked with z
                    need = (up * size - down * (len(v) - len(u))) // (2 * up) + 1
                else:
                    need = -(-(up * size - down * (len(u) + len(v))) // (2 * up))
                d = d[np.lexsort((d, count[_cells(d)]))][: max(0, size - max(1, need) + 1)]
                k = 1 + len(d)  # the first row tells of the link only
                for c, x in zip(cols, ([z] * k, [node] * k, [len(v)] * k, [linked] * k, [None, *d.view(np.int64).tolist()], range(-1, k - 1), [size] * k)):
                    c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["z", "node", "n", "linked", "x", "pos", "size"])

    return run


def _filters(df: DataFrame, percent: int) -> DataFrame:
    """Length and positional filters over (na, pa, nb, pb)."""
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))
    return df.where(F.col("na") * 100 >= F.col("nb") * percent).where(F.col("nb") * 100 >= F.col("na") * percent).where(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)


def _ordered(df: DataFrame) -> DataFrame:
    """(a, b, na, nb) with a < b."""
    up = F.col("a") < F.col("b")
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(up, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("nb"))


class JaccardJoin:
    """The join over docs(doc_id, text); :meth:`components` and :attr:`links` (a, b: nodes) hold its results.

    :meth:`close` deletes its tables from the shared folder.
    """

    def __init__(self, docs: DataFrame, size: int = SIZE, percent: int = PERCENT):
        if not 0 < percent <= 100:
            raise ValueError("percent is above 0 and at most 100")
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        base.ship(self.spark)
        self.docs = docs.select("doc_id", "text")
        self.held: list[DataFrame] = []
        profile = self._keep(self.docs.mapInArrow(_profile(size), PROFILE))
        self.members = profile.where("n >= 0").select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
        count = _sketch(profile.where("n = -1").select("node", "data"))
        self.hot = max(HOT_LEAST, int(HOT * count.mean()))
        self.sketch = self.spark.sparkContext.broadcast(np.minimum(count, 0xFFFFFFFF).astype(np.uint32).tobytes())
        self.nodes = self._keep(profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("data").alias("data")))
        one = self.nodes.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
        self.n_nodes, self.unnamed = one.n, one.ids < one.n
        self.links = self._links()

    def _keep(self, df: DataFrame) -> DataFrame:
        self.held.append(base.materialize(df))
        return self.held[-1]

    def close(self) -> None:
        while self.held:
            base.release(self.held.pop())

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb) that reach the threshold, as (a, b)."""
        h = self.nodes.select("node", "data")
        near = pairs.join(h.select(F.col("node").alias("a"), F.col("data").alias("ha")), "a").join(h.select(F.col("node").alias("b"), F.col("data").alias("hb")), "b")
        near = base.materialize(near.mapInArrow(_suffix_filter(self.percent), "a long, b long"))
        grams = self._grams(near)
        ga, gb = (grams.select(F.col("node").alias(n), F.col("grams").alias(f"g{n}")) for n in "ab")
        out = self._keep(near.join(ga, "a").join(gb, "b").mapInArrow(_compare(self.percent), "a long, b long"))
        for x in (near, grams):
            base.release(x)
        return out

    def _grams(self, pairs: DataFrame) -> DataFrame:
        """(node, grams) of the nodes of pairs(a, b)."""
        want = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        want = base.materialize(want.join(self.nodes, "node").select("node", "doc_id"))
        n = want.count()
        held = self.docs.join(base.small(want.where("doc_id IS NOT NULL"), 48 * n), "doc_id").select("node", "text").mapInArrow(_set_of(self.size, True), "node long, grams binary")
        if self.unnamed:  # sets that only rows with a null id have are found by their node
            null = self.docs.where("doc_id IS NULL").select("text").mapInArrow(_set_of(self.size, False), "node long, grams binary")
            held = held.unionByName(null.join(base.small(want.where("doc_id IS NULL").select("node"), 48 * n), "node"))
        out = base.materialize(held.groupBy("node").agg(F.first("grams").alias("grams")))  # rows of one id may have equal sets
        base.release(want)
        return out

    def _postings(self) -> DataFrame:
        """(token, node, n, pos) of the lists that hold several nodes, a row a node."""
        posts = self.docs.mapInArrow(_postings(self.size, self.percent, self.sketch, self.hot), POSTS).repartition("token", "slice")
        # the sums keep all columns on this side, so that both sides are one exchange
        lists = posts.groupBy("token", "slice").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.sum("n").alias("ns"), F.sum("pos").alias("ps"))
        lists = lists.where("(least <> last OR slice > 0) AND ns + ps > 0").select("token", "slice")
        held = posts.join(lists.hint("shuffle_hash"), ["token", "slice"])
        return base.materialize(held.dropDuplicates(["token", "slice", "node"]).select("token", "node", "n", "pos"))

    def _stars(self, posts: DataFrame) -> DataFrame:
        """(a, b, na, nb): each node with the best of its lists' centres."""
        h = F.xxhash64("node")
        centres = posts.groupBy("token").agg(F.min(F.struct("n", h.alias("h"), "node", "pos")).alias("lo"), F.min(F.struct("pos", h.alias("h"), "node", "n")).alias("hi"))
        fields = lambda c: F.struct(F.col(f"{c}.node").alias("b"), F.col(f"{c}.n").alias("nb"), F.col(f"{c}.pos").alias("pb"))
        met = posts.join(centres.select("token", F.array(fields("lo"), fields("hi")).alias("c")), "token").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.explode("c").alias("c")).select("a", "na", "pa", "c.*").where("a <> b")
        near = _filters(met, self.percent).groupBy("a", "b").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        best = near.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("k", "b")).alias("c")).select("a", "na", "c.b", "c.nb")
        return base.materialize(_ordered(best).distinct())

    def _mixed(self, posts: DataFrame, labels: DataFrame) -> DataFrame:
        """The postings of lists that hold several components, with the list's largest one (main) and how many nodes are outside it."""
        rooted = base.materialize(posts.join(labels, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component"))
        by_root = rooted.groupBy("token", "root").agg(F.count("*").alias("k"))
        main = by_root.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("outside"))
        out = base.materialize(rooted.join(main.where("r0 <> r1").select("token", "main", "outside"), "token"))
        base.release(rooted)
        return out

    def _across(self, mixed: DataFrame) -> DataFrame:
        """(a, b, na, nb) of the lists' nodes in different components, past the length and positional filters."""
        mixed = mixed.where(F.col("outside") <= CROWD)
        # sizes that may meet are in the same or in neighbouring classes
        width = math.log(100 / self.percent) if self.percent < 100 else math.log(2)
        grade = F.floor(F.log("n") / F.lit(width) + F.lit(1e-9)).cast("int")
        x = mixed.where("root <> main").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"), F.explode(F.array(grade - 1, grade, grade + 1)).alias("grade"))
        y = mixed.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"), "main", grade.alias("grade"))
        met = x.join(y, ["token", "grade"]).where("ra <> rb AND (rb = main OR a < b)")
        return _ordered(_filters(met, self.percent)).distinct()

    def _by_difference(self, crowded: DataFrame, links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links of nodes and hubs, pairs (a, b, na, nb) past the filters on their differences from a hub) of crowded lists."""
        ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("k"))
        hubs = ends.join(labels, "node").groupBy(F.col("component").alias("main")).agg(F.max_by("node", F.struct("k", "node")).alias("hub"))
        hubs = base.materialize(hubs.join(crowded.select("main").distinct(), "main"))  # a row a family that crowds some list
        stars = crowded.join(base.small(hubs, 32 * hubs.count()), "main", "left").select(F.coalesce("hub", "main").alias("a"), F.col("node").alias("b"), "root").distinct()
        stars = base.materialize(stars.where("a <> b"))
        grams = self._grams(stars)
        ga, gb = (grams.select(F.col("node").alias(n), F.col("grams").alias(f"g{n}")) for n in "ab")
        apart = stars.select("a", "b").join(ga, "a").join(gb, "b").mapInArrow(_apart(self.percent, self.sketch), APART)
        apart = base.materialize(apart)
        found = self._keep(apart.where("x IS NULL AND linked").select(F.col("z").alias("a"), F.col("node").alias("b")))
        rooted = apart.where("x IS NOT NULL").join(stars.select(F.col("a").alias("z"), F.col("b").alias("node"), "root"), ["z", "node"])
        u, v = (rooted.select("z", "x", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("pos").alias(f"p{c}"), F.col("size").alias(f"s{c}"), F.col("root").alias(f"r{c}"), F.col("linked").alias(f"l{c}")) for c in "ab")
        need = F.col("sa") + F.col("sb") - (F.col("na") + F.col("nb")) * F.lit(100 - self.percent) / F.lit(100 + self.percent)
        met = u.join(v, ["z", "x"]).where("ra <> rb AND a < b AND NOT (la AND lb)").where(2 * F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= need - F.lit(1e-6))
        pairs = base.materialize(met.select("a", "b", "na", "nb").distinct())
        for x in (hubs, stars, grams, apart):
            base.release(x)
        return found, pairs

    def _links(self) -> DataFrame:
        posts = self._postings()
        tried = self._stars(posts)
        links = self._verify(tried)
        labels = connected_components(links, "a", "b")
        mixed = self._mixed(posts, labels)
        base.release(posts)
        across, more = self._across(mixed), []
        crowded = mixed.where(F.col("outside") > CROWD)
        if not crowded.isEmpty():
            found, pairs = self._by_difference(crowded, links, labels)
            across, more = across.unionByName(pairs).distinct(), [found]
        pairs = base.materialize(across.join(tried, ["a", "b"], "left_anti"))
        more.append(self._verify(pairs))
        for x in (mixed, labels, tried, pairs):
            base.release(x)
        for x in more:
            links = links.unionByName(x)
        return links

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id (the least doc_id that links reach; a text without words: its own)."""
        first = self.nodes.select("node", F.col("doc_id").alias("least"))
        labels = connected_components(self.links, "a", "b")
        self.held.append(labels)
        held = labels.join(first, "node")
        roots = held.groupBy("component").agg(F.min("least").alias("root_least"))
        of = first.join(held.select("node", "component").join(roots, "component").select("node", "root_least"), "node", "left").select("node", F.coalesce("root_least", "least").alias("cid"))
        out = self.members.join(base.small(of, 40 * self.n_nodes), "node", "left")
        return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id")).alias("component_id"))


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; the join's tables are deleted, the result stands in the shared folder."""
    join = JaccardJoin(docs, size, percent)
    out = base.materialize(join.components())
    join.close()
    return out


def keep_first(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs without the members of a component other than its least doc_id; of rows that share an id all stay or go."""
    found = components(docs, size, percent)
    gone = base.materialize(found.where("component_id < doc_id").select("doc_id").distinct())
    base.release(found)
    return docs.join(base.small(gone, 24 * gone.count()), "doc_id", "left_anti")
