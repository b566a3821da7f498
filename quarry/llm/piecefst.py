"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled to a cascade of transducers:

1. the normaliser: the model's character map (a double-array automaton over
   bytes, whose longest match is rewritten; without one every character copies
   itself), white space squeezed and escaped to U+2581, a dummy prefix, all as
   the model says; user-defined pieces pass through as they are;
2. the pieces: a trie whose final states emit ids, with arcs that spell a
   character that is no piece in bytes (or as unknown).

An input is composed with it arc by arc, as the search needs them, and the
shortest path in the tropical semiring (min, +) is its encoding:

- unigram models: a piece weighs the negative of its score, states are
  positions, and the path is found in their order;
- BPE models: states are (position, last piece), and the arc from one piece to
  the next weighs 0 where BPE keeps the two side by side and 1 where it would
  have merged across their border. The search takes states by weight, a level
  after the other. BPE decides each border from the two pieces next to it, so
  its encoding is the path of weight 0.

No piece reaches across a border before white space or around a character
that no longer piece has, so a text falls into short stretches, whose
encodings a worker remembers (a bounded memory of two generations). Equal
weights go to the path whose pieces start first. Rows that share an id are
encoded one by one; a very long text is one piece of work.

A null text has null ids; an empty one none. Decoding joins the pieces, turns
U+2581 to a space and drops the dummy prefix, so only texts with a literal
U+2581 do not come back as they were.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import base

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Stretches of each of two generations, fragments, and pairs of pieces that a worker remembers.
MEMORY = 150_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            c = b[at]
            at += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while at < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, b[at : at + n]
            at += n
        elif kind == 2:
            n = varint()
            yield key >> 3, b[at : at + n]
            at += n
        else:
            raise ValueError("not a model file")


class Rules:
    """A character map: the longest key at a place is rewritten. The map is a double array of 32-bit units over UTF-8 bytes."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units, self.text = array("I", blob[4 : 4 + size]), blob[4 + size :]

    def match(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(end, replacement) of the longest key that starts here."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1, self.text[start : self.text.index(0, start)]
        return found

    def rewrite(self, text: str, keep: re.Pattern | None) -> str:
        """The output for a text; what ``keep`` matches is copied."""
        kept = {len(text[: m.start()].encode()): m.group().encode() for m in keep.finditer(text)} if keep else {}
        data, out, at = text.encode("utf-8", "replace"), bytearray(), 0
        while at < len(data):
            if at in kept:
                out += kept[at]
                at += len(kept[at])
                continue
            hit = self.match(data, at)
            if hit is None:
                end = at + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                hit = end, data[at:end]
            at = hit[0]
            out += hit[1]
        return out.decode("utf-8", "replace")


class Transducer:
    """A compiled model."""

    rules: Rules | None = None
    user: re.Pattern | None = None

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for k, v in _fields(model):  # a message that comes again adds to the first
            if k == 1:
                f = dict(_fields(v))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif k == 2:
                trainer.update(_fields(v))
            elif k == 3:
                normaliser.update(_fields(v))
        self.model_type, self.fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.rules = Rules(normaliser[2]) if normaliser.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(i, 1)) for i in (3, 4, 5))
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError("the model is neither unigram nor BPE")
        self.user_id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == USER}
        if self.user_id:
            self.user = re.compile("(" + "|".join(map(re.escape, sorted(self.user_id, key=len, reverse=True))) + ")")
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes_ = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.fallback else []
        order = {v: i for i, v in enumerate(sorted({self.scores[i] for i in self.id_of.values()}, reverse=True))}
        self.rank = {p: order[self.scores[i]] for p, i in self.id_of.items()}  # pieces of one score share a rank
        #: the two parts of each piece's last merge
        self.split: dict[str, tuple[str, str]] = {}
        # BPE never makes a piece that its own merges do not lead to
        live = [p for p in self.id_of if self.model_type == UNIGRAM or len(self.merged(p)) == 1]
        if self.model_type == UNIGRAM and self.user_id:  # they compete with a score that hardly loses
            top = max((self.scores[i] for i in self.id_of.values()), default=0.0)
            for p, i in self.user_id.items():
                self.scores[i] = len(p.encode()) * top - 0.1
            live, self.id_of = [*live, *self.user_id], {**self.id_of, **self.user_id}
        self.low = min((self.scores[i] for i, k in enumerate(self.kinds) if k == NORMAL), default=0.0) - 10.0
        self.trie: dict = {}
        inner: set[str] = set()
        for p in live:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = self.id_of[p]
            if len(p) > 1:
                inner.update(p)
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        starts_only = not any(SPACE in p.lstrip(SPACE) for p in live)
        cut = re.escape(alone)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if alone else "")) if starts_only else re.compile("(?s).+")
        self.out = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, k in zip(self.pieces, self.kinds)]
        self.out[self.unknown] = " ⁇ ".encode()
        # neighbouring characters that some piece holds: BPE never merges across others
        self.joins = {pair for p in live for pair in zip(p, p[1:])}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fragments: dict[str, list[int]] = {}
        self.borders: dict[int, bool] = {}

    def merged(self, s: str) -> list[str]:
        """BPE of a short string: merge the neighbours with the best-scored piece, leftmost first."""
        parts = list(s)
        while True:
            best = None
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best[0]):
                    best = (self.scores[k], i)
            if best is None:
                return parts
            i = best[1]
            if len(parts) == 2:
                self.split[s] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def border(self, a: int, b: int) -> bool:
        """Does BPE keep these pieces side by side?"""
        key = a * len(self.pieces) + b
        ok = self.borders.get(key)
        if ok is None:
            if len(self.borders) >= MEMORY:
                self.borders.clear()
            ok = self.borders[key] = self.apart(self.pieces[a], self.pieces[b])
        return ok

    def apart(self, x: str, y: str) -> bool:
        """Undo the merges of x and y next to the border, latest first: did a merge across it come before?"""
        rank, split, limit, whole = self.rank, self.split, len(self.pieces) + 1, [x, y]
        while True:
            across = rank.get(x + y, limit + 1)
            rx, ry = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if across == limit or rx == ry >= 0:  # the same merge twice (as in runs): position decides
                return self.merged("".join(whole)) == whole
            if across < limit:
                return False
            if rx > ry:
                limit, x = rx, split[x][1]
            elif ry >= 0:
                limit, y = ry, split[y][0]
            else:
                return True

    def spell(self, c: str) -> tuple[int, ...]:
        """Ids of a character that is no piece."""
        return tuple(self.bytes_[b] for b in c.encode()) if self.fallback else (self.unknown,)

    def arcs(self, s: str, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the pieces that start at i, shortest first; piece -1 spells a character that is no piece."""
        node, out, n, j = self.trie, [], len(s), i
        while j < n:
            node = node.get(s[j])
            if node is None:
                break
            j += 1
            k = node.get("")
            if k is not None:
                out.append((j, k))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, -1))
        return out

    def by_levels(self, s: str) -> list[int]:
        """The shortest path of a BPE stretch: arcs weigh 0 or 1, so states are taken level by level, long pieces first."""
        n, width = len(s), len(self.pieces) + 1
        came: list[tuple[int, int, int]] = [(-1, -1, 0)]  # (state before, piece or -1 for a spelled character, position)
        seen: set[int] = set()
        now: list[tuple[int, int, int, bool]] = [(0, j, k, True) for j, k in self.arcs(s, 0)]
        later: list[tuple[int, int, int, bool]] = []
        while True:
            while now:
                before, j, k, paid = now.pop()
                if j * width + k in seen:
                    continue
                last = came[before][1]
                if not paid and last >= 0 and k >= 0 and not self.border(last, k):
                    later.append((before, j, k, True))  # an arc of weight 1 waits for the next level
                    continue
                seen.add(j * width + k)
                came.append((before, k, j))
                if j == n:
                    return self.labels(s, came)
                at = len(came) - 1
                now += [(at, j2, k2, False) for j2, k2 in self.arcs(s, j)]
            now, later = later[::-1], []

    def labels(self, s: str, came: list[tuple[int, int, int]]) -> list[int]:
        """The outputs along the path to the last state."""
        steps, at = [], len(came) - 1
        while at:
            steps.append((came[at][1], came[at][2]))
            at = came[at][0]
        ids, at = [], 0
        for k, j in reversed(steps):
            if k >= 0:
                ids.append(k)
            else:
                ids.extend(self.spell(s[at:j]))
            at = j
        return ids

    def path(self, s: str) -> list[int]:
        """The shortest path through one stretch, by fragments that no piece joins."""
        if self.model_type != BPE:
            return self.by_positions(s)
        ids: list[int] = []
        joins, at = self.joins, 0
        for i in range(1, len(s) + 1):
            if i == len(s) or (s[i - 1], s[i]) not in joins:
                part = s[at:i]
                got = self.fragments.get(part)
                if got is None:
                    got = self.by_levels(part)
                    if len(part) <= 64:
                        if len(self.fragments) >= MEMORY:
                            self.fragments.clear()
                        self.fragments[part] = got
                ids += got
                at = i
        return ids

    def by_positions(self, s: str) -> list[int]:
        """The shortest path of a unigram stretch, position by position."""
        n = len(s)
        weight = [float("inf")] * (n + 1)
        weight[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # (from, piece; -1: spelled)
        for i in range(n):
            w = weight[i]
            for j, k in self.arcs(s, i):
                v = w - (self.scores[k] if k >= 0 else self.low)
                if v < weight[j]:
                    weight[j], came[j] = v, (i, k)
        ids: list[int] = []
        j = n
        while j:
            i, k = came[j]
            ids.extend([k] if k >= 0 else reversed(self.spell(s[i:j])))
            j = i
        ids.reverse()
        return ids

    def normal(self, text: str) -> str:
        """The normaliser's output."""
        if self.rules:
            text = self.rules.rewrite(text, self.user)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def stretches(self, text: str) -> Iterator[str]:
        """Parts that no piece joins; BPE never merges a user-defined piece."""
        if self.model_type != BPE or not self.user:
            yield from self.stretch.findall(text)
            return
        for i, part in enumerate(self.user.split(text)):
            if i % 2:
                yield part
            else:
                yield from self.stretch.findall(part)

    def encode(self, text: str) -> bytes:
        """int32 ids."""
        memory, out = self.memory, []
        for s in self.stretches(self.normal(text)):
            ids = memory.get(s)
            if ids is None:
                ids = self.older.get(s)
                if ids is None:
                    ids = array("i", [self.user_id[s]] if s in self.user_id else self.path(s)).tobytes()
                if len(memory) >= MEMORY:  # what is not met again in the time of one generation goes
                    self.older, self.memory = memory, {}
                    memory = self.memory
                if len(s) <= 64:
                    memory[s] = ids
            out.append(ids)
        if not self.fallback:  # neighbouring unknowns are one
            ids = np.frombuffer(b"".join(out), np.int32)
            return ids[np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]].tobytes() if len(ids) else b""
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer per model and process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def _model(spark, path: str | None):
    with open(path or default_model(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a model file, whatever the input's size


def _each(model, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model.value)
        for batch in batches:
            for part, data, off in base.pieces(batch, "text"):
                at = part.schema.get_field_index("text")
                there = np.asarray(part.column(at).is_valid())
                texts = part.column(at).to_pylist()
                ids = [b"" if t is None else fst.encode(t) for t in texts]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                if digest:
                    same = [None if t is None else fst.decode(np.frombuffer(x, np.int32).tolist()) == t for t, x in zip(texts, ids)]
                    new = [pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *new], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=pa.array(~there))
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns) if i != at] + [lists], names=[c for i, c in enumerate(part.schema.names) if i != at] + ["ids"])

    return run


def encode(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ids array<int> of each text."""
    base.ship(docs.sparkSession)
    held = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>"
    return held.mapInArrow(_each(_model(docs.sparkSession, model), False), schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of each row of (doc_id, ids)."""
    base.ship(encoded.sparkSession)
    held = _model(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(held.value)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else fst.decode(x) for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32) and round_trip: does decoding give the text back?"""
    base.ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_each(_model(docs.sparkSession, model), True), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
