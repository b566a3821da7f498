"""Substring dedup by fixed-block anchors.

A window of ``window`` words that occurs twice holds, at each of its places,
a whole block of ``window // 2`` words of that text's fixed grid. So:

1. Index: the non-overlapping grid blocks of every text. Probe: every rolling
   window of block length. A grid block is *anchored* if its words occur at
   another place too. Probes are dealt by hash range, each task sending a hash
   at most once, so a frequent block costs at most one entry a task.
2. Extend: a window can be repeated only if all grid blocks inside it are
   anchored. The hashes of these windows, again once a task, meet in their hash
   range; all but the earliest place of each are repeats. Runs of repeated
   windows are the maximal exact repeats.
3. Every word that a repeated window covers goes.

Nulls: a null text has no words; a row with null ``doc_id`` takes no part and
keeps its words. Rows that share a ``doc_id`` are judged as one place: equal
positions of the same id are not earlier than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import base, kernels

WINDOW = 20
#: Words that a task gathers before it sends them.
PACKET_WORDS = 1 << 19
#: Bytes of text for each hash range, at most (there are more ranges where that is less than a partition's share).
RANGE_BYTES = 16 << 20


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length) of runs of consecutive positions; input sorted by (doc, pos)."""
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)])
    return doc[new], pos[new], np.diff(np.r_[new, len(doc)])


def _pack(x: np.ndarray, kind: type, ordered: bool = False) -> bytes:
    """Bytes of x by planes, ascending values as differences: the shuffle's compression drops the empty planes."""
    x = x.astype(kind)
    if ordered:
        x = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpack(b: bytes, kind: type, ordered: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ordered else x


def _blobs(bucket: np.ndarray, columns: list[np.ndarray], kinds: list[type]) -> Iterator[tuple[int, list[bytes]]]:
    """One packed row a bucket; the input is sorted by bucket and by the first column."""
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for s, e in zip(cut, np.r_[cut[1:], len(bucket)]):
        yield int(bucket[s]), [_pack(c[s:e], k, not i) for i, (c, k) in enumerate(zip(columns, kinds))]


def _packets(batches: Iterator[pa.RecordBatch], limit: int):
    """Groups of text slices of about ``limit`` words: (slice, bytes, word hash, starts, first)."""
    held, n = [], 0
    for batch in batches:
        for part, data, off in base.pieces(batch, "text"):
            s, e, first = kernels.words(data, off)
            held.append((part, kernels.word_hashes(data, s, e), first))
            n += len(s)
            if n >= limit:
                yield held
                held, n = [], 0
    if held:
        yield held


PROBES = "bucket int, probes binary, grid binary, doc binary, block binary"


def _probe(buckets: int, size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _packets(batches, limit):
            hs, docs, blocks = [], [], []
            for part, word, first in held:
                g, at = kernels.gram_hashes(word, first, size)
                if not len(g):
                    continue
                d = np.searchsorted(first, at, "right") - 1
                inside = at - first[d]
                hs.append(g)
                on = inside % size == 0
                docs.append(np.where(on, base.longs(part, "doc_id")[d], 0))
                blocks.append(np.where(on, inside // size, -1).astype(np.int32))
            if not hs:
                continue
            h, doc, block = np.concatenate(hs), np.concatenate(docs), np.concatenate(blocks)
            # the bucket by the upper half of the hash, and its lower half, which ascends inside the bucket
            h = ((h >> np.uint64(32)) * np.uint64(buckets) & ~np.uint64(0xFFFFFFFF)) | (h & np.uint64(0xFFFFFFFF))
            order = np.argsort(h, kind="stable")
            h, doc, block = h[order], doc[order], block[order]
            new = np.r_[True, h[1:] != h[:-1]]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            lead = np.flatnonzero(new)
            # a block met twice here is anchored; its hash still probes for the other tasks
            known = many & (block >= 0)
            alone = ~many & (block >= 0)
            to, low = (h >> np.uint64(32)).astype(np.int64), h & np.uint64(0xFFFFFFFF)
            rows = {}
            for b, (p,) in _blobs(to[lead], [low[lead]], [np.uint32]):
                rows[b] = [p, b"", b"", b""]
            for b, (g, d, k) in _blobs(to[alone], [low[alone], doc[alone], block[alone]], [np.uint32, np.int64, np.int32]):
                rows[b][1:] = [g, d, k]
            if known.any():  # known anchors travel as rows without probes, dealt evenly
                d, k = doc[known], block[known]
                for i in range(0, len(d), 1 << 16):
                    rows[-1 - i] = [b"", b"", d[i : i + (1 << 16)].tobytes(), k[i : i + (1 << 16)].astype(np.int32).tobytes()]
            salt = int(h[-1] & np.uint64(0xFFFFFF))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b if b >= 0 else (salt + b) % buckets for b in rows], pa.int32()), *(base.binary([v[i] for v in rows.values()]) for i in range(4))],
                names=["bucket", "probes", "grid", "doc", "block"],
            )

    return run


def _anchored(table: pa.Table) -> pa.Table:
    """Grid blocks of one hash range that occur elsewhere too."""
    docs, blocks, probes, grid, gd, gk = [], [], [], [], [], []
    for p, g, d, k in zip(*(table.column(c).to_pylist() for c in ("probes", "grid", "doc", "block"))):
        if p:
            probes.append(_unpack(p, np.uint32, True))
            grid.append(_unpack(g, np.uint32, True))
            gd.append(_unpack(d, np.int64))
            gk.append(_unpack(k, np.int32))
        else:
            docs.append(np.frombuffer(d, np.int64))
            blocks.append(np.frombuffer(k, np.int32))
    if probes:
        # each task sends a hash once, so a hash that two tasks sent is repeated
        h = np.sort(np.concatenate(probes))
        twice = h[1:][h[1:] == h[:-1]]
        g = np.concatenate(grid)
        i = np.searchsorted(twice, g)
        hit = np.zeros(len(g), bool)
        ok = i < len(twice)
        hit[ok] = twice[i[ok]] == g[ok]
        docs.append(np.concatenate(gd)[hit])
        blocks.append(np.concatenate(gk)[hit])
    return pa.table({"doc_id": np.concatenate(docs), "block": np.concatenate(blocks)}, schema=pa.schema([("doc_id", pa.int64()), ("block", pa.int32())]))


WINDOWS = "bucket int, hash binary, doc binary, pos binary"


def _windows(buckets: int, window: int, size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _packets(batches, limit):
            hs, docs, poss = [], [], []
            for part, word, first in held:
                g, at = kernels.gram_hashes(word, first, window)
                if not len(g):
                    continue
                n_blocks = np.diff(first) // size
                base_of = np.r_[0, np.cumsum(n_blocks)]
                hit = np.zeros(base_of[-1] + 2, bool)
                lists = part.column(part.schema.get_field_index("blocks"))
                lens = np.diff(np.asarray(lists.offsets))
                flat = np.asarray(lists.flatten()).astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), lens)
                hit[base_of[owner] + flat] = True
                d = np.searchsorted(first, at, "right") - 1
                p = at - first[d]
                k = base_of[d] + (p + size - 1) // size
                keep = hit[k]
                two = p % size == 0
                keep[two] &= hit[k[two] + 1]
                hs.append(g[keep])
                docs.append(base.longs(part, "doc_id")[d[keep]])
                poss.append(p[keep].astype(np.int64))
            h, doc, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, docs, poss))
            if not len(h):
                continue
            order = np.lexsort((pos, doc, h))
            h, doc, pos = h[order], doc[order], pos[order]
            new = np.r_[True, h[1:] != h[:-1]]
            lead = np.flatnonzero(new)
            of = lead[np.cumsum(new) - 1]
            late = (doc != doc[of]) | (pos != pos[of])
            rows = [(b, *x) for b, x in _blobs(((h[lead] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), [h[lead], doc[lead], pos[lead]], [np.uint64, np.int64, np.int32])]
            if late.any():  # repeats within this task: known, dealt evenly
                by = np.lexsort((pos[late], doc[late]))
                d, s, n = _runs(doc[late][by], pos[late][by])
                salt = int(h[0] >> np.uint64(40))
                for i in range(0, len(d), 1 << 14):
                    part = slice(i, i + (1 << 14))
                    rows.append(((salt + i) % buckets, b"", d[part].tobytes(), np.stack([s[part], n[part]]).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(base.binary([r[i] for r in rows]) for i in (1, 2, 3))], names=["bucket", "hash", "doc", "pos"])

    return run


SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _repeated(table: pa.Table) -> pa.Table:
    """Windows of one hash range but the earliest place of each, as runs (doc_id, start, n)."""
    out, hs, ds, ps = [], [], [], []
    for h, d, p in zip(*(table.column(c).to_pylist() for c in ("hash", "doc", "pos"))):
        if h:
            hs.append(_unpack(h, np.uint64, True))
            ds.append(_unpack(d, np.int64))
            ps.append(_unpack(p, np.int32))
        else:
            s, n = np.frombuffer(p, np.int32).reshape(2, -1)
            out.append((np.frombuffer(d, np.int64), s, n))
    if hs:
        h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
        order = np.lexsort((p, d, h))
        h, d, p = h[order], d[order], p[order]
        new = np.r_[True, h[1:] != h[:-1]]
        of = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = (d != d[of]) | (p != p[of])
        by = np.lexsort((p[late], d[late]))
        out.append(_runs(d[late][by], p[late][by]))
    cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.Table.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32))], schema=SPANS)


def repeated_spans(docs: DataFrame, window: int = WINDOW, packet_words: int | None = None) -> DataFrame:
    """One row per text with repeats: doc_id, _spans array<struct<start int, n int>> of repeated
    window starts (a window there covers ``window`` words); spans may touch or overlap."""
    if window < 2:
        raise ValueError("a window has two words at least")
    packet_words = packet_words or PACKET_WORDS
    spark = docs.sparkSession
    base.ship(spark)
    size = max(1, window // 2)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(4 * base.shuffle_partitions(spark), -(-size_ // RANGE_BYTES)), 1 << 30)
    anchors = (
        texts.mapInArrow(_probe(buckets, size, packet_words), PROBES)
        .groupBy("bucket")
        .applyInArrow(_anchored, "doc_id long, block int")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("block")).alias("blocks"))  # at most the blocks of one text
    )
    held = texts.join(base.materialize(anchors), "doc_id")  # the anchors grow with the input: no broadcast hint
    return (
        held.mapInArrow(_windows(buckets, window, size, packet_words), WINDOWS)
        .groupBy("bucket")
        .applyInArrow(_repeated, "doc_id long, start int, n int")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "n")).alias("_spans"))  # at most the words of one text
    )


def covered(n_words: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows that start in [start, start + count) cover."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + counts - 1 + window, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def _cut(window: int, names: list[str], types: list[pa.DataType], digest: bool):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("_spans"))
            off, flat = np.asarray(lists.offsets), lists.flatten()
            starts, counts = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            n_words, n_removed, out = [], [], []
            for i, t in enumerate(texts):
                w = [] if t is None else t.split()  # splits bytes at 0x20 and 0x09 to 0x0D
                n_words.append(len(w))
                s, c = starts[off[i] : off[i + 1]], counts[off[i] : off[i + 1]]
                if len(s):
                    gone = covered(len(w), s, c, window)
                    n_removed.append(int(gone.sum()))
                    kept = b" ".join([x for x, g in zip(w, gone.tolist()) if not g])
                else:
                    n_removed.append(0)
                    kept = b" ".join(w) if digest else t
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept)
            cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), *cols, pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                kept_text = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(types[at])
                yield pa.RecordBatch.from_arrays([kept_text if j == at else batch.column(j) for j in range(len(names))] + cols, names=[*names, "_n_words", "_n_removed"])

    return run


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    spans = base.materialize(repeated_spans(docs, window))
    base.tidy(docs.sparkSession)
    return docs.join(spans, "doc_id", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<start:int,n:int>>")))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated words cut from ``text`` (a text that loses nothing stays as it is; others
    are their kept words joined by one space) and ``_n_words``, ``_n_removed`` added, in place of columns of these names."""
    docs = docs.drop("_n_words", "_n_removed", "_spans")
    from pyspark.sql.pandas.types import to_arrow_type

    held = _with_spans(docs, window).select(*(f"`{c}`" for c in docs.columns), "_spans")
    fields = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _n_words long, _n_removed long"
    return held.mapInArrow(_cut(window, docs.columns, [to_arrow_type(f.dataType) for f in fields], False), schema)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    held = _with_spans(docs.select("doc_id", "text"), window).select("doc_id", "text", "_spans")
    return held.mapInArrow(_cut(window, ["doc_id", "text"], [], True), "doc_id long, n_words long, n_removed long, kept_sha256 string")
