"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, give_back, shared_dir


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Catalyst may inline a projection into a lambda and so evaluate it once per
    element; a one-element ``transform`` pins the value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def delete(spark, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Table:
    """A DataFrame written once as Parquet in the shared folder; ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest reachable id.

    Smallest-label propagation with pointer jumping. Labels and edges stay
    distributed; each round is a pair of equi-joins whose sides AQE can split,
    and ends in a checkpoint. Self-links, repeated links and nulls are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        told = cut(labels.join(heard, "a").select("a", F.col("label").alias("old"), F.least("label", "m").alias("near")))
        root = told.select(F.col("a").alias("near"), F.col("near").alias("far"))
        labels = cut(told.join(root, "near").select("a", "old", F.col("far").alias("label")))
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
        labels = labels.select("a", "label")


_HELD: dict = {}


def held(key, make=None):
    """A Python worker's tables for ``key``, kept between tasks.

    Workers serve one operator after another; only the last one's tables stay,
    so that memory does not add up along a pipeline. An operator without tables
    names itself to drop the last one's.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make() if make else None
    return _HELD[key]


class Recent(dict):
    """Results of ``make`` by key, in two generations of at most ``size`` entries.

    A full table becomes the old one; what is asked for again moves back, so
    common keys stay. Long keys are not kept. Memory is bounded.
    """

    def __init__(self, make, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


CHUNK = 1 << 16


class Cells:
    """A task's counts of hashes in ``2**bits`` cells, sent in compressed chunks."""

    def __init__(self, bits: int):
        self.cells, self.held, self.n = np.zeros(1 << bits, np.uint32), [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append((h & np.uint64(len(self.cells) - 1)).astype(np.uint32))
        self.n += len(h)
        if self.n >= 1 << 20:
            self._settle()

    def _settle(self) -> None:
        if self.held:
            at, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.cells[at] += times.astype(np.uint32)
        self.held, self.n = [], 0

    def chunks(self):
        """(chunk, compressed counts) of the chunks that hold any."""
        self._settle()
        size = min(CHUNK, len(self.cells))
        for k in range(len(self.cells) // size):
            part = self.cells[k * size : (k + 1) * size]
            if part.any():
                yield k, zlib.compress(part.tobytes(), 1)


CELLS = "k int, cells binary"


def summed(sent: DataFrame, bits: int) -> np.ndarray:
    """The cells that tasks sent as chunks (k, cells), added up; 4 bytes a cell whatever the input."""
    size = min(CHUNK, 1 << bits)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64)
                sums[k] = sums[k] + got if k in sums else got
        for k, got in sums.items():
            yield _chunks([(k, zlib.compress(np.minimum(got, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1))])

    out = np.zeros(1 << bits, np.uint32)
    for k, part in sent.select("k", "cells").repartition(16, "k").mapInArrow(total, CELLS).collect():
        out[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(part), np.uint32)
    return out


def _chunks(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in rows], pa.int32()), "cells": pa.array([x for _, x in rows], pa.binary())})


def count_sketch(df: DataFrame, hashes, bits: int) -> np.ndarray:
    """Occurrences of hashes, counted in ``2**bits`` cells over the whole input.

    ``hashes(batch)`` yields uint64 arrays. A task adds up its own cells and
    sends them in chunks; chunks are summed in a stream, so that no group is
    ever held. The result has a fixed size (4 bytes a cell) and may be broadcast.
    """

    def count(batches):
        cells = Cells(bits)
        for batch in batches:
            for h in hashes(batch):
                cells.add(h)
        for row in cells.chunks():
            yield _chunks([row])

    return summed(df.mapInArrow(count, CELLS), bits)


def seen(df: DataFrame, hashes, bits: int) -> np.ndarray:
    """Bits (packed) of the ``2**bits`` cells that a hash of the input falls in.

    Tasks send the sorted cells they met; each chunk of cells is merged where
    its parts meet. The result has ``2**bits / 8`` bytes whatever the input and
    may be broadcast.
    """
    size, chunk = 1 << bits, 1 << min(bits, 20)

    def met(batches):
        held, n = [], 0
        for batch in batches:
            for h in hashes(batch):
                held.append((h & np.uint64(size - 1)).astype(np.uint32))
                n += len(h)
            if n >= 1 << 20:
                yield from sent(np.unique(np.concatenate(held)))
                held, n = [], 0
        if held:
            yield from sent(np.unique(np.concatenate(held)))

    def sent(cells):
        edges = np.searchsorted(cells, np.arange(0, size + 1, chunk))
        for k in np.flatnonzero(np.diff(edges)):
            part = cells[edges[k] : edges[k + 1]]
            steps = np.diff(part, prepend=np.uint32(k * chunk)).astype(np.uint32)
            yield _chunks([(int(k), zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1))])

    def merged(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(part), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                if k not in found:
                    found[k] = np.zeros(chunk, np.bool_)
                found[k][np.cumsum(steps, dtype=np.int64)] = True
        for k, on in found.items():
            yield _chunks([(k, zlib.compress(np.packbits(on).tobytes(), 1))])

    out = np.zeros(size // 8, np.uint8)
    for k, part in df.mapInArrow(met, CELLS).repartition(32, "k").mapInArrow(merged, CELLS).collect():
        out[k * chunk // 8 : (k + 1) * chunk // 8] = np.frombuffer(zlib.decompress(part), np.uint8)
    return out


def in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's cell is set in a result of ``seen``."""
    cell = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_R, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: bytes, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each blank-separated word of ``data``.

    Works on pieces of ``step`` bytes, so that memory follows the piece and not
    the text, nor its longest word: a word cut by a piece's end is carried on.
    The hash is a polynomial over the bytes modulo 2**64, scrambled with the
    length; texts made for it can collide, prose does not.
    """
    starts, found, open_ = [], [], None  # a word under way: start, length, sum
    up, down = _powers(step + 1)
    for at in range(0, len(data), step):
        piece = np.frombuffer(data, np.uint8, min(step, len(data) - at), at)
        word = np.concatenate(([False], piece != 32, [False]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        a, b = edge[::2], edge[1::2]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        values, sizes, begin = (sums[b] - sums[a]) * down[a], (b - a).astype(np.int64), a + at
        if open_:
            first, size, total = open_
            if len(a) and a[0] == 0:
                values[0] = np.uint64((total + pow(_R, size, 1 << 64) * int(values[0])) & _MASK)
                sizes[0] += size
                begin[0] = first
            else:
                values, sizes, begin = np.append(np.uint64(total), values), np.append(size, sizes), np.append(first, begin)
            open_ = None
        if len(b) and b[-1] == len(piece) and at + len(piece) < len(data):
            open_ = int(begin[-1]), int(sizes[-1]), int(values[-1])
            values, sizes, begin = values[:-1], sizes[:-1], begin[:-1]
        found.append(mix(values + sizes.astype(np.uint64)))
        starts.append(begin)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(found)


def shingle_sets(texts, k: int):
    """The sorted distinct hashes of each text's ``k``-word shingles.

    ``texts`` is a list or an Arrow column. A-Z are lower-cased; words are what
    ASCII blanks separate. Fewer than ``k`` words give one shingle, no words
    (or null) none. Texts are hashed together in batches of about 1 MB; a
    longer one alone.
    """
    with np.errstate(over="ignore"):
        batch, size = [], 0
        for text in texts:
            text = text if text is None or isinstance(text, str) else text.as_py()
            batch.append((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
            size += len(batch[-1])
            if size >= 1 << 20:
                yield from _sets(batch, k)
                batch, size = [], 0
        if batch:
            yield from _sets(batch, k)


def _sets(batch: list[bytes], k: int):
    starts, w = word_hashes(b" ".join(batch))
    ends = np.cumsum([len(x) + 1 for x in batch])
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = max(0, len(w) - k + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams += w[i : i + n] * np.uint64(pow(_R, 2 * i + 3, 1 << 64) | 1)
    grams = mix(grams)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            whole = int(b - a)
            for x in w[a:b]:
                whole = (whole * 0x100000001B3 + int(x)) & _MASK
            yield mix(np.array([whole ^ 0x5851F42D4C957F2D], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
