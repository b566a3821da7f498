"""Graph operators on edges(src, dst[, weight]); iterations write their state to the checkpoint folder every round."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.sampling import global_index
from quarry.operators.state import release, running_sums
from quarry.operators.state import write as _cut


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, once each, without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    o, i = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")), edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return o.join(i, "id", "full").fillna(0)


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, tol: float = 0.0) -> DataFrame:
    """(id, rank): parallel edges count, dangling mass is spread evenly; stops early at an L1 change of tol."""
    v = _cut(vertices(edges))
    n = v.count()
    if not n:
        return v.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count("*").alias("_d"))
    e = _cut(edges.select("src", "dst").join(out, "src"))
    r = state = _cut(v.join(out.withColumnRenamed("src", "id"), "id", "left").withColumn("rank", F.lit(1.0 / n)))
    for _ in range(iterations):
        loose = F.broadcast(r.where("_d IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_l")))  # one row
        got = e.join(r.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("_d")).alias("_g"))
        new = r.join(got, "id", "left").crossJoin(loose).select("id", "_d", F.col("rank").alias("_old"), (F.lit((1 - damping) / n) + damping * (F.coalesce("_g", F.lit(0.0)) + F.col("_l") / n)).alias("rank"))
        new = _cut(new)  # the state is read three times in a round
        release(state)
        state, r = new, new.drop("_old")
        if tol and new.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] < tol:
            break
    release(v)
    release(e)
    return r.select("id", "rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each weak component, by minimum labels with shortcuts."""
    e = _cut(undirected(edges))
    labels = state = _cut(vertices(edges).withColumn("component", F.col("id")))
    while True:
        m = e.join(labels, e.src == labels.id).groupBy(F.col("dst").alias("v")).agg(F.min("component").alias("m"))
        step = labels.join(m, labels.id == m.v, "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("now"))
        up = labels.select(F.col("id").alias("u"), F.col("component").alias("ul"))
        step = _cut(step.join(up, step.now == up.u).select("id", "old", F.least("now", "ul").alias("component")))
        release(state)
        labels, state = step.select("id", "component"), step
        if step.where("old <> component").isEmpty():
            release(e)
            return labels


def bfs(edges: DataFrame, source, directed: bool = True, limit: int | None = None) -> DataFrame:
    """(id, dist) of everything reachable from source; ValueError if ``limit`` rounds do not reach it all."""
    e = edges.select("src", "dst").distinct() if directed else undirected(edges)
    seen = _cut(vertices(edges).where(F.col("id") == source).withColumn("dist", F.lit(0)))
    for d in count(1):
        front = seen.where(F.col("dist") == d - 1)
        new = front.join(e, front.id == e.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("dist", F.lit(d))
        new = _cut(new)
        if new.isEmpty():
            return seen
        if limit is not None and d > limit:
            raise ValueError(f"the graph goes on after {limit} rounds")
        old, seen = seen, _cut(seen.union(new))
        release(old)
        release(new)


def shortest_paths(edges: DataFrame, source, limit: int | None = None) -> DataFrame:
    """(id, dist): least sums of non-negative weights from source (Bellman-Ford on what changed).

    ValueError if distances still fall after ``limit`` rounds.
    """
    best = _cut(vertices(edges).where(F.col("id") == source).withColumn("dist", F.lit(0.0)))
    front = best
    for k in count(1):
        got = front.join(edges, front.id == edges.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("n"))
        better = _cut(got.join(best, "id", "left").where("dist IS NULL OR n < dist").select("id", F.col("n").alias("dist")))
        if better.isEmpty():
            return best
        if limit is not None and k > limit:
            raise ValueError(f"distances still fall after {limit} rounds")
        old, best = best, _cut(best.join(better.select("id"), "id", "left_anti").union(better))
        release(old)
        front = better


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, core): peel what has degree at most k, k rising."""
    e = _cut(undirected(edges))
    out = None
    k = 0
    left = vertices(edges)
    while not left.isEmpty():
        d = left.join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").fillna(0, ["d"])
        low = d.agg(F.min("d")).first()[0]
        k = max(k, low)
        gone = _cut(d.where(F.col("d") <= k).select("id", F.lit(k).alias("core")))
        out = gone if out is None else _cut(out.union(gone))
        left = _cut(left.join(gone.select("id"), "id", "left_anti"))
        ids = gone.select("id")
        e = _cut(e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    return out if out is not None else vertices(edges).withColumn("core", F.lit(0))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles) of every vertex in one: edges point from the lower-degree end, so hubs have few out-edges."""
    e = undirected(edges)
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    a = e.join(d.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    o = _cut(a.where("ds < dd OR (ds = dd AND src < dst)").select("src", "dst"))
    w = o.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(o.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").where("b <> c")
    t = w.join(o.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    return t.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def neighbour_jaccard(edges: DataFrame) -> DataFrame:
    """(a, b, jaccard) of vertices that share a neighbour, a < b."""
    e = undirected(edges)
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("m")), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    r = both.join(d.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    return r.select("a", "b", (F.col("k") / (F.col("da") + F.col("db") - F.col("k"))).alias("jaccard"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given ids."""
    n = nodes.select("id")
    return edges.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def line_graph(edges: DataFrame) -> DataFrame:
    """(i, j): pairs of edge ids i < j with a common end; edges(id, src, dst)."""
    ends = edges.select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("v"))
    return ends.select(F.col("id").alias("i"), "v").join(ends.select(F.col("id").alias("j"), "v"), "v").where("i < j").select("i", "j").distinct()


def line_degrees(edges: DataFrame) -> DataFrame:
    """(id, later): how many edges of :func:`line_graph` go from each edge id to a greater one, without making them.

    Ids at each end are counted by rank; edges that share both ends are counted there twice and taken off once. An id with
    more than two ends counts every set of them with its sign.
    """
    ends = edges.where("id IS NOT NULL").select("id", F.explode(F.array("src", "dst")).alias("v")).where("v IS NOT NULL")
    sets = ends.groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("s"))
    chosen = lambda m: F.filter("s", lambda v, i: F.expr("1") == F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)))
    masks = F.sequence(F.lit(1), F.when(F.size("s") <= 10, F.pow(F.lit(2), F.size("s")).cast("int") - 1).otherwise(F.raise_error(F.lit("an edge id has more than ten ends")).cast("int")))
    parts = _cut(sets.select("id", F.explode(F.transform(masks, chosen)).alias("k"), F.lit(1).alias("one")))
    ranked = running_sums(parts, "id", {"n": "one"}, ["k"], descending=True)
    return ranked.groupBy("id").agg(F.sum(F.when(F.size("k") % 2 == 1, F.col("n") - 1).otherwise(1 - F.col("n"))).alias("later"))


def euler_type(edges: DataFrame) -> str | None:
    """circuit, path or None for an undirected multigraph; isolated vertices do not count."""
    e = edges.where("src <> dst")
    if not e.isEmpty() and connected_components(e).select("component").distinct().count() > 1:
        return None
    odd = e.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("d")).where("d % 2 = 1").count()
    return {0: "circuit", 2: "path"}.get(odd)


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level) of an acyclic graph: the longest path from a source; ValueError on a cycle."""
    v, e = _cut(vertices(edges)), _cut(edges.select("src", "dst").distinct())
    out, level = None, 0
    while not v.isEmpty():
        free = _cut(v.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        out = free if out is None else _cut(out.union(free))
        v = _cut(v.join(free, "id", "left_anti"))
        e = _cut(e.join(free.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"))
        level += 1
    return out if out is not None else vertices(edges).withColumn("level", F.lit(0))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) of a minimum spanning forest (Boruvka; ties by ends)."""
    e = _cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    label = _cut(vertices(edges).withColumn("c", F.col("id")))
    chosen = e.limit(0)
    while True:
        x = e.join(label.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        key = F.struct("weight", "src", "dst", "cs", "cd")
        pick = x.select(F.explode(F.array("cs", "cd")).alias("c"), key.alias("k")).groupBy("c").agg(F.min("k").alias("k")).select("k.*").distinct()
        pick = _cut(pick)
        if pick.isEmpty():
            return chosen
        chosen = _cut(chosen.unionByName(pick.select("src", "dst", "weight")))
        merged = connected_components(pick.select(F.col("cs").alias("src"), F.col("cd").alias("dst")))
        label = _cut(label.join(merged.withColumnRenamed("id", "c"), "c", "left").select("id", F.coalesce("component", "c").alias("c")))


def label_propagation(edges: DataFrame, iterations: int = 5) -> DataFrame:
    """(id, label): each round the most frequent label among neighbours, the least on ties."""
    e = _cut(undirected(edges))
    lab = vertices(edges).withColumn("label", F.col("id"))
    for _ in range(iterations):
        c = e.join(lab, e.src == lab.id).groupBy(F.col("dst").alias("v"), "label").agg(F.count("*").alias("n"))
        best = c.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("v", F.col("b.label").alias("new"))
        lab = lab.join(best, lab.id == best.v, "left").select("id", F.coalesce("new", "label").alias("label"))
        lab = _cut(lab)
    return lab


def eccentricities(edges: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """(id, eccentricity) of the given vertices: the greatest hop distance to what they reach. Diameter and radius are its extremes over all vertices."""
    return hop_distances(edges, sources, directed).groupBy(F.col("source").alias("id")).agg(F.max("dist").alias("eccentricity"))


def hop_distances(edges: DataFrame, sources: DataFrame, directed: bool = True) -> DataFrame:
    """(source, id, dist): breadth-first from every source at once, one join a hop. The result has a row for each source and vertex that it reaches."""
    e = _cut(edges.select("src", "dst").where("src <> dst").distinct() if directed else undirected(edges))
    seen = _cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist")).distinct())
    for d in count(1):
        front = seen.where(F.col("dist") == d - 1)
        new = _cut(front.join(e, front.id == e.src).select("source", F.col("dst").alias("id")).distinct().join(seen, ["source", "id"], "left_anti").withColumn("dist", F.lit(d)))
        if new.isEmpty():
            release(e)
            return seen
        old, seen = seen, _cut(seen.unionByName(new))
        release(old)
        release(new)


def diameter_radius(edges: DataFrame) -> DataFrame:
    """(diameter, radius) of an undirected graph, inside its components: one breadth-first a vertex, so meant for graphs of up to some thousands."""
    return eccentricities(edges, vertices(edges)).agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"))


#: A graph of up to so many edges is read whole by tasks that take a share of the sources each; larger ones are joined level
#: by level. There are up to PARTS tasks, and the copies that they read have up to COPIES edges together.
WHOLE, PARTS, COPIES = 8_000_000, 48, 96_000_000


def _by_source(edges: DataFrame, sources: DataFrame, work, schema: str) -> DataFrame | None:
    """(id, ...): work(graph, numbers of sources) in tasks over ranges of the sources; None if the graph is too large for a task.

    Vertices are numbered in the order of their ids, and edges packed (eight bytes each) before they are copied for the tasks.
    A graph is two lists of neighbours by number, along the edges and against them: (begin, ends).
    """
    e = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    m = e.count()
    if m > WHOLE:
        release(e)
        return None
    v = _cut(global_index(vertices(e), ["id"], "i").select("id", F.col("i").cast("int").alias("i")))
    n = v.count()
    parts = max(1, min(PARTS, COPIES // max(m, 1), n))
    x = e.join(v.select(F.col("id").alias("src"), F.col("i").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("i").alias("b")), "dst")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = (t.column(c).to_numpy() for c in "ab")
            by = np.argsort(a, kind="stable")
            yield pa.RecordBatch.from_pydict({c: [y[by].tobytes()] for c, y in (("begins", a), ("ends", b))})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        mine = np.array([r["mine"] for r in rows if r["mine"] is not None], "int32")
        if not len(mine):
            return
        begins, ends = (np.concatenate([np.frombuffer(r[c], "int32") for r in rows if r["mine"] is None]) for c in ("begins", "ends"))
        degree, ends = np.bincount(begins, minlength=n), ends[np.argsort(begins, kind="stable")]
        against = np.repeat(np.arange(n, dtype="int32"), degree)[np.argsort(ends, kind="stable")]
        begin = lambda d: np.concatenate([[0], np.cumsum(d)])
        yield from work(((begin(degree), ends), (begin(np.bincount(ends, minlength=n)), against)), mine).to_batches()

    copies = x.select("a", "b").mapInArrow(pack, "begins binary, ends binary").select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("int").alias("mine"))
    asked = v.join(sources.select("id").distinct(), "id", "left_semi").select(*(F.lit(None).cast("binary").alias(c) for c in ("begins", "ends")), F.expr(f"cast(i * {parts}L div {max(n, 1)} as int)").alias("part"), F.col("i").alias("mine"))
    return copies.unionByName(asked).repartitionById(parts, F.col("part")).mapInArrow(part, f"i int, {schema}").join(v, "i").drop("i")


def _steps(lists: tuple, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of the front's vertices, each with its vertex's position in the front."""
    begin, ends = lists
    n = begin[front + 1] - begin[front]
    at = np.repeat(begin[front] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return np.repeat(np.arange(len(front)), n), ends[at]


def _levels(graph: tuple, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Breadth-first from s: (front, i, j) of each level, with the edges to the next one as positions in both fronts.

    A level follows the edges out of the front or those into all vertices that are not reached yet, whichever are fewer.
    """
    out, into = graph
    size = len(out[0]) - 1
    new, place, front = np.ones(size, bool), np.full(size, -1, "int32"), np.array([s])
    new[s], left = False, len(out[1]) - (into[0][s + 1] - into[0][s])
    while len(front):
        if (out[0][front + 1] - out[0][front]).sum() <= left:
            i, b = _steps(out, front)
            on = new[b]
            i, b = i[on], b[on]
        else:
            rest = np.flatnonzero(new)
            place[front] = np.arange(len(front))
            b, a = _steps(into, rest)
            i = place[a]
            on = i >= 0
            i, b = i[on], rest[b[on]]
            place[front] = -1
        if 8 * len(b) > size:  # each of b once
            hit = np.zeros(size, bool)
            hit[b] = True
            after = np.flatnonzero(hit)
        else:
            k = np.arange(len(b), dtype="int32")
            place[b] = k
            after = b[place[b] == k]
        place[after] = np.arange(len(after))
        yield front, i, place[b]
        place[after], new[after] = -1, False
        left -= (into[0][after + 1] - into[0][after]).sum()
        front = after


def closeness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, closeness) of the given vertices (of all, the default) along directed edges: reached / total distance, times the share of the other vertices that is reached."""
    sources = vertices(edges) if sources is None else sources

    def work(g: tuple, mine: np.ndarray) -> pa.Table:
        out, into = g
        entered = np.flatnonzero(np.diff(into[0]))
        reached, total = np.zeros(len(mine), "int64"), np.zeros(len(mine), "int64")
        for k in range(0, len(mine), 64):  # so many sources at once, a bit each
            some = slice(k, k + 64)
            bits = np.left_shift(np.uint64(1), np.arange(len(mine[some]), dtype="uint64"))
            front, full, active = np.zeros(len(out[0]) - 1, "uint64"), np.bitwise_or.reduce(bits), mine[some]
            front[active] = bits
            seen = front.copy()
            for d in count(1):
                open_ = seen != full
                if 2 * (out[0][active + 1] - out[0][active]).sum() > len(out[1]):
                    at = entered[open_[entered]]
                else:
                    hit = np.zeros(len(front), bool)
                    hit[_steps(out, active)[1]] = True
                    at = np.flatnonzero(hit & open_)
                if not len(at):
                    break
                n = into[0][at + 1] - into[0][at]
                new = np.bitwise_or.reduceat(front[into[1] if len(at) == len(entered) else _steps(into, at)[1]], np.cumsum(n) - n) & ~seen[at]
                front[active] = 0
                active, new = at[new != 0], new[new != 0]
                front[active] = new
                seen[active] |= new
                each = np.unpackbits(new.astype("<u8").view("uint8"), bitorder="little").reshape(-1, 64).sum(0, dtype="int64")[: len(bits)]
                reached[some], total[some] = reached[some] + each, total[some] + d * each
        return pa.table({"i": mine, "k": reached, "t": total})

    n = vertices(edges).agg(F.count("*").alias("n"))
    k = _by_source(edges, sources, work, "k long, t long")
    if k is None:
        k = hop_distances(edges, sources).groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("k"), F.sum("dist").alias("t"))
    else:
        k = sources.where("id IS NOT NULL").select("id").distinct().join(k, "id", "left").fillna(0, ["k", "t"])  # what is in no edge reaches nothing
    return k.crossJoin(F.broadcast(n)).select("id", F.coalesce(F.try_divide(F.col("k") * F.col("k"), F.col("t") * (F.col("n") - 1)), F.lit(0.0)).alias("closeness"))  # n: one row


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness): dependencies of the given sources summed (of all vertices, the default: the exact betweenness of a directed graph).

    Brandes' recurrence by levels: path counts on the way out, dependencies on the way back.
    """
    sources = vertices(edges) if sources is None else sources

    def work(g: tuple, mine: np.ndarray) -> pa.Table:
        out = np.zeros(len(g[0][0]) - 1)
        for s in mine:
            levels, paths, own = [], [np.ones(1)], out[s]
            for front, i, j in _levels(g, s):
                levels.append((front, i, j))
                paths.append(np.bincount(j, paths[-1][i]))
            share = np.zeros(0)
            for (front, i, j), p in zip(reversed(levels), reversed(paths[:-1])):
                dep = p * np.bincount(i, share[j], len(p))
                share = (1 + dep) / p
                out[front] += dep
            out[s] = own
        at = np.flatnonzero(out)
        return pa.table({"i": at.astype("int32"), "dep": out[at]})

    out = _by_source(edges, sources, work, "dep double")
    got = (_dependencies(edges, sources) if out is None else out).groupBy("id").agg(F.sum("dep").alias("betweenness"))
    return vertices(edges).join(got, "id", "left").fillna(0.0, ["betweenness"])


def _dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, dep) of each source, one join a level."""
    e = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    level = _cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")).distinct())
    levels, seen = [level], level
    for d in count(1):
        got = level.join(e, level.id == e.src).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")).withColumn("dist", F.lit(d))
        level = _cut(got.join(seen, ["source", "id"], "left_anti").select("source", "id", "dist", "paths"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level)
    after, out = None, None
    for level in reversed(levels):
        if after is None:
            now = level.withColumn("dep", F.lit(0.0))
        else:
            up = after.select("source", F.col("id").alias("dst"), (((F.lit(1.0) + F.col("dep"))) / F.col("paths")).alias("share"))
            back = level.join(e, level.id == e.src).join(up, ["source", "dst"]).groupBy("source", "id").agg(F.sum("share").alias("share"))
            now = level.join(back, ["source", "id"], "left").withColumn("dep", F.col("paths") * F.coalesce("share", F.lit(0.0))).drop("share")
        after = _cut(now)
        part = after.where("source <> id").select("id", "dep")
        out = part if out is None else out.unionByName(part)
    return out


def _iterate(edges: DataFrame, start: DataFrame, step, rounds: int) -> DataFrame:
    """start(id, ...) through step(edges, state) so many times, with the state written every round."""
    e, state = _cut(edges.select("src", "dst").distinct()), _cut(start)
    for _ in range(rounds):
        old, state = state, _cut(step(e, state))
        release(old)
    release(e)
    return state


def _normal(df: DataFrame, c: str) -> DataFrame:
    """Column c divided by its Euclidean length."""
    size = F.broadcast(df.agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias("_z")))  # one row
    return df.crossJoin(size).withColumn(c, F.coalesce(F.try_divide(c, "_z"), F.lit(0.0))).drop("_z")


def eigenvector(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, score): power iteration on the undirected graph plus the unit matrix (which also settles on bipartite graphs), of length 1."""
    u = undirected(edges)

    def step(e: DataFrame, x: DataFrame) -> DataFrame:
        got = e.join(x, e.src == x.id).groupBy("dst").agg(F.sum("score").alias("g"))
        return _normal(x.join(got, x.id == got.dst, "left").select("id", (F.col("score") + F.coalesce("g", F.lit(0.0))).alias("score")), "score")

    return _iterate(u, vertices(edges).withColumn("score", F.lit(1.0)), step, rounds)


def hits(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, hub, authority) of length 1 each."""

    def step(e: DataFrame, x: DataFrame) -> DataFrame:
        a = e.join(x, e.src == x.id).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority"))
        a = _cut(_normal(x.select("id").join(a, "id", "left").fillna(0.0, ["authority"]), "authority"))
        h = e.join(a, e.dst == a.id).groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("hub"))
        return _normal(a.join(h, "id", "left").fillna(0.0, ["hub"]).select("id", "hub", "authority"), "hub")

    return _iterate(edges, vertices(edges).select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), step, rounds)


def katz(edges: DataFrame, alpha: float = 0.1, rounds: int = 100) -> DataFrame:
    """(id, katz): 1 + alpha times the sum over in-neighbours, so many rounds from 1."""

    def step(e: DataFrame, x: DataFrame) -> DataFrame:
        got = e.join(x, e.src == x.id).groupBy("dst").agg(F.sum("katz").alias("g"))
        return x.join(got, x.id == got.dst, "left").select("id", (F.lit(1.0) + alpha * F.coalesce("g", F.lit(0.0))).alias("katz"))

    return _iterate(edges, vertices(edges).withColumn("katz", F.lit(1.0)), step, rounds)


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each strong component.

    Each round colours every vertex with the least id that reaches it; what reaches the colour's root inside its colour
    is that root's component, and the rest goes on without it.
    """
    e = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    left, done = _cut(vertices(edges)), None
    while not left.isEmpty():
        colour = _spread(e, left.withColumn("c", F.col("id")), "src", "dst")
        inner = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        inner = _cut(inner)
        back = _spread(inner, colour.select("id", F.when(F.col("id") == F.col("c"), F.col("c")).alias("c")), "dst", "src")
        found = _cut(back.where("c IS NOT NULL").select("id", F.col("c").alias("component")))
        done = found if done is None else _cut(done.unionByName(found))
        old, left = left, _cut(left.join(found, "id", "left_anti"))
        keep = inner.join(left.withColumnRenamed("id", "src"), "src").join(left.withColumnRenamed("id", "dst"), "dst").select("src", "dst")
        e = _cut(keep)
        release(old)
        release(inner)
    return done if done is not None else vertices(edges).withColumn("component", F.col("id"))


def _spread(e: DataFrame, start: DataFrame, a: str, b: str) -> DataFrame:
    """start(id, c) with the least c that comes along edges from a to b, until nothing changes."""
    state = _cut(start)
    while True:
        got = e.join(state, e[a] == state.id).groupBy(F.col(b).alias("v")).agg(F.min("c").alias("m"))
        new = _cut(state.join(got, state.id == got.v, "left").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        if new.where("NOT (old <=> c)").isEmpty():
            return new.select("id", "c")
        release(state)
        state = new


def neighbour_cosine(edges: DataFrame) -> DataFrame:
    """(a, b, cosine) of vertices that share a neighbour, a < b: shared neighbours over the root of the product of degrees."""
    e = undirected(edges)
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("m")), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    r = both.join(d.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    return r.select("a", "b", (F.col("k") / F.sqrt(F.col("da") * F.col("db"))).alias("cosine"))


def edge_subgraph(edges: DataFrame, min_weight: float | None = None, max_weight: float | None = None) -> DataFrame:
    """The edges with a weight inside the bounds."""
    out = edges
    if min_weight is not None:
        out = out.where(F.col("weight") >= min_weight)
    return out if max_weight is None else out.where(F.col("weight") <= max_weight)


def degree_mix(edges: DataFrame) -> DataFrame:
    """(assortativity): correlation of the degrees at both ends of the undirected edges."""
    e = undirected(edges)
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    return e.join(d.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst").agg(F.corr("ds", "dd").alias("assortativity"))
