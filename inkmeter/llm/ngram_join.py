"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

The n-grams have one global order: first those that few documents hold, by a
sketch of fixed size, then by hash. That order is cut at pivots into fragments:
ranges of the hash for the n-grams that few hold, and one for the rest. A pair's
overlap is counted in each fragment apart, and the parts are summed per pair
and held against the threshold, so every link is exact (n-grams are compared by
their 64-bit hashes).

Which pairs are counted: two sets can only reach the threshold if they share
one of their first ``n - ceil(t * n) + 1`` n-grams in the global order; a
passage that many documents share comes last and proposes nothing. Equal sets
are one node. Among the nodes that share such an n-gram one leader is paired
with all first; pairs that the links found so far already connect need no
count, and of the others only members of different components are paired, in
large groups block by block. A group of near copies thus costs a few counts per
member and not one per pair, while no two documents that are linked end in
different components. Before sets are sent, profiles (counts by range of the
hash) bound a pair's overlap from above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CELLS, Cells, Table, connected_components, cut, held, in_bits, mix, seen, shingle_sets, summed

FRAGMENTS = 4
BLOCK = 512
SKETCH_BITS = 22
FILTER_BITS = 26
RANGES = 256
#: n-grams that a worker gathers before it sends them.
SENT = 1 << 18


def _key(found: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


SETS = f"doc_id long, n long, k1 long, k2 long, {CELLS}"


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, k1, k2): each row's number of n-grams and the digest of its set; and (k, cells): sketches of the n-grams."""

    def run(batches):
        held("ngrams")
        cells = Cells(SKETCH_BITS)
        for batch in batches:
            n, one, two = [], [], []
            for found in shingle_sets(batch.column("text"), k):
                a, b = _key(found)
                n.append(len(found))
                one.append(a)
                two.append(b)
                cells.add(found)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "n", "k1", "k2", "k", "cells"])
        for at, part in cells.chunks():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([at], pa.int32()), pa.array([part], pa.binary())], names=["doc_id", "n", "k1", "k2", "k", "cells"])

    return docs.mapInArrow(run, SETS)


def _commonness(found: np.ndarray, counts: np.ndarray, usual: float) -> np.ndarray:
    """0 for n-grams that few hold, else the magnitude of their count; with the hash, the global order."""
    est = counts[(found & np.uint64(len(counts) - 1)).astype(np.int64)]
    return np.where(est > usual, np.log2(np.maximum(est, 1)).astype(np.int64), 0)


def _usual(counts: np.ndarray) -> float:
    return float(counts.mean() + 5 * counts.mean() ** 0.5 + 8)


def _prefixes(docs: DataFrame, k: int, percent: int, cells) -> DataFrame:
    """(s, key): the first n-grams in the global order of each set; a task mostly gives a set once."""

    def run(batches):
        held("ngrams")
        counts, known, out, size = cells.value, set(), [], 0
        usual = _usual(counts)
        for batch in batches:
            for found in shingle_sets(batch.column("text"), k):
                n = len(found)
                if not n or (key := _key(found)) in known:
                    continue
                if len(known) < 50_000:  # only spares repeats; the next step removes the rest
                    known.add(key)
                first = found[np.argsort(_commonness(found, counts, usual), kind="stable")[: n - (percent * n + 99) // 100 + 1]]
                out.append((first.view(np.int64), np.full(len(first), key[0])))
                size += len(first)
                if size >= SENT:
                    yield sent(out)
                    out, size = [], 0
        if out:
            yield sent(out)

    def sent(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["s", "key"])

    return docs.mapInArrow(run, "s long, key long")


def _shared(first: DataFrame) -> DataFrame:
    """The distinct rows (s, key) whose ``s`` has other keys too, and some at the ends of partitions.

    Rows are dealt by ranges of both columns and read in order, so an ``s`` of
    any size is spread over tasks and nothing of it is held. What another
    partition may continue is kept.
    """

    def run(batches):
        begin, last, kept = None, None, False
        for batch in batches:
            s, key = (batch.column(x).to_numpy() for x in ("s", "key"))
            if not len(s):
                continue
            if begin is None:
                begin = s[0]
            else:
                s, key = np.append(last[0], s), np.append(last[1], key)
            new = np.append(True, (s[1:] != s[:-1]) | (key[1:] != key[:-1]))
            s, key = s[new], key[new]
            same = s[1:] == s[:-1]
            keep = np.append(kept, same) | np.append(same, False) | (s == begin)
            last, kept = (s[-1], key[-1]), bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(s[:-1][keep[:-1]]), pa.array(key[:-1][keep[:-1]])], names=["s", "key"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], names=["s", "key"])

    return first.repartitionByRange("s", "key").sortWithinPartitions("s", "key").mapInArrow(run, first.schema)


def id_hash(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _of(docs: DataFrame, ids: DataFrame):
    """A broadcast filter of fixed size that lets the documents of ``ids`` (id) pass, and few others."""
    return docs.sparkSession.sparkContext.broadcast(seen(ids, lambda b: [id_hash(b.column("id").to_numpy())], FILTER_BITS))


def _wanted(batch, bits, k: int):
    """(doc_id, set) of the documents of a batch that the filter lets pass."""
    ids = np.array([0 if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
    want = np.flatnonzero(in_bits(bits, id_hash(ids)))
    yield from zip(ids[want].tolist(), shingle_sets(batch.column("text").take(pa.array(want)), k), strict=True)


def _fragments(docs: DataFrame, k: int, cells, wanted) -> DataFrame:
    """(id, f, seg): the sets of the wanted documents, cut at the pivots of the global order."""

    def run(batches):
        held("ngrams")
        counts, out, size = cells.value, [], 0
        usual = _usual(counts)
        for batch in batches:
            for i, found in _wanted(batch, wanted.value, k):
                range_ = (found >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)
                part = np.where(_commonness(found, counts, usual) > 0, FRAGMENTS - 1, range_.astype(np.int64))
                for f in range(FRAGMENTS):
                    seg = found[part == f]
                    if len(seg):
                        out.append((i, f, seg.view(np.int64)))
                size += len(found)
                if size >= SENT:
                    yield sent(out)
                    out, size = [], 0
        if out:
            yield sent(out)

    def sent(out):
        off = np.concatenate(([0], np.cumsum([len(x) for _, _, x in out])))
        segs = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate([x for _, _, x in out])))
        return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in out], pa.int64()), pa.array([f for _, f, _ in out], pa.int32()), segs], names=["id", "f", "seg"])

    return docs.mapInArrow(run, "id long, f int, seg array<long>")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, cells) -> DataFrame:
    """(a, b): of ``pairs`` (x, y, nx, ny), those that reach the threshold."""
    segs = _fragments(docs, k, cells, _of(docs, _ids(pairs)))
    left = segs.select(F.col("id").alias("x"), "f", F.col("seg").alias("sx"))
    right = segs.select(F.col("id").alias("y"), "f", F.col("seg").alias("sy"))
    parts = pairs.withColumn("f", F.explode(F.array(*map(F.lit, range(FRAGMENTS))))).join(left, ["x", "f"]).join(right, ["y", "f"])
    parts = parts.select("x", "y", "nx", "ny", "f", F.size(F.array_intersect("sx", "sy")).cast("long").alias("part"))
    parts = parts.groupBy("x", "y", "nx", "ny", "f").agg(F.max("part").alias("part"))  # a repeated row counts once
    total = parts.groupBy("x", "y", "nx", "ny").agg(F.sum("part").alias("both"))
    return total.where(f"100 * both >= {percent} * (nx + ny - both)").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _profiles(docs: DataFrame, k: int, wanted) -> DataFrame:
    """(id, profile): how many n-grams of a wanted document's set fall in each range of the hash, in 1, 2 or 4 bytes each."""

    def run(batches):
        held("ngrams")
        for batch in batches:
            ids, rows = [], []
            for i, found in _wanted(batch, wanted.value, k):
                many = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=RANGES)
                top = many.max(initial=0)
                ids.append(i)
                rows.append(many.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["id", "profile"])

    return docs.mapInArrow(run, "id long, profile binary").dropDuplicates(["id"])


def _ranges(profile: bytes) -> np.ndarray:
    return np.frombuffer(profile, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(profile) // RANGES])


def _table(column) -> np.ndarray:
    """The profiles of a column as rows of one array."""
    rows = [_ranges(x) for x in column.to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, RANGES), np.uint8)


def _able(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of ``pairs`` (x, y, nx, ny), those whose profiles allow a link."""
    pairs = cut(pairs.distinct())
    profiles = _profiles(docs, k, _of(docs, _ids(pairs)))
    met = pairs.join(profiles.select(F.col("id").alias("x"), F.col("profile").alias("fx")), "x")
    met = met.join(profiles.select(F.col("id").alias("y"), F.col("profile").alias("fy")), "y")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                both = np.minimum(_table(part.column("fx")), _table(part.column("fy"))).sum(axis=1, dtype=np.int64)
                n = part.column("nx").to_numpy() + part.column("ny").to_numpy()
                yield part.select(["x", "y", "nx", "ny"]).filter(pa.array((100 + percent) * both >= percent * n))

    return cut(met.select("x", "y", "nx", "ny", "fx", "fy").mapInArrow(run, "x long, y long, nx long, ny long"))


def _across(docs: DataFrame, many: DataFrame, k: int, percent: int) -> DataFrame:
    """(x, y, nx, ny) of the pairs in large buckets whose components differ and whose profiles allow a link.

    ``many`` is (s, id, n, c, size, odd, odds): ``odd`` are the members outside
    the bucket's largest component, ``odds`` their number. Only they are
    compared with the rest, and with each other: blocks of them meet blocks of
    the whole bucket, two in a task.
    """
    rows = many.join(_profiles(docs, k, _of(docs, many.select("id").distinct())), "id")
    rows = rows.withColumn("l", F.ceil(F.col("odds") / BLOCK).cast("int")).withColumn("r", F.ceil(F.col("size") / BLOCK).cast("int"))
    spot = F.xxhash64("id")
    base = ["s", "id", "n", "c", "profile"]
    left = rows.where("odd").select(*base, F.lit(True).alias("left"), F.pmod(spot, F.col("l")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("j"))
    right = rows.select(*base, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("l") - 1)).alias("i"), F.pmod(spot, F.col("r")).cast("int").alias("j"))

    def compare(key, table):
        ids, n, c = (table.column(v).to_numpy() for v in ("id", "n", "c"))
        side = table.column("left").to_numpy(zero_copy_only=False)
        profile, there, out = _table(table.column("profile")), np.flatnonzero(~side), []
        for r in np.flatnonzero(side):
            ok = (c[there] != c[r]) & (100 * np.minimum(n[there], n[r]) >= percent * np.maximum(n[there], n[r]))
            at = there[ok]
            both = np.minimum(profile[at], profile[r]).sum(axis=1, dtype=np.int64)
            at = at[(100 + percent) * both >= percent * (n[at] + n[r])]
            x, y = np.minimum(ids[at], ids[r]), np.maximum(ids[at], ids[r])
            mine = ids[at] == x
            out.append((x, y, np.where(mine, n[at], n[r]), np.where(mine, n[r], n[at])))
        cols = [np.concatenate(v).astype(np.int64) for v in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("x", "y", "nx", "ny"), map(pa.array, cols), strict=True)))

    return left.union(right).groupBy("s", "i", "j").applyInArrow(compare, "x long, y long, nx long, ny long")


def _leader_pairs(posts: DataFrame, fits: str) -> DataFrame:
    """(x, y, nx, ny): each member of a bucket with the bucket's leader.

    The leader is the member whose prefix most others share: of near copies, the one nearest to all.
    """
    sizes = posts.groupBy("s").agg(F.count("*").alias("size"))
    weight = posts.join(sizes, "s").groupBy("id").agg(F.sum("size").alias("weight"))
    rank = weight.select("id", (F.col("weight") * 1024 + F.pmod(F.xxhash64("id"), F.lit(1024))).alias("rank"))
    lead = posts.join(rank, "id").groupBy("s").agg(F.max_by(F.struct("id", "n"), "rank").alias("l")).select("s", F.col("l.id").alias("y"), F.col("l.n").alias("ny"))
    return posts.select("s", F.col("id").alias("x"), F.col("n").alias("nx")).join(lead, "s").where(f"x <> y and {fits}").select("x", "y", "nx", "ny")


def _rest_pairs(docs: DataFrame, posts: DataFrame, comps: DataFrame, k: int, percent: int, fits: str) -> DataFrame:
    """(x, y, nx, ny): the pairs of a bucket in different components that may be links."""
    placed = posts.join(comps, "id", "left").select("s", "id", "n", F.coalesce("component", "id").alias("c"))
    shares = placed.groupBy("s", "c").agg(F.count("*").alias("m"))
    top = F.max(F.struct("m", "c"))
    mixed = shares.groupBy("s").agg(F.sum("m").alias("size"), top.alias("top"), F.count("*").alias("cs")).where("cs > 1")
    mixed = mixed.select("s", "size", F.col("top.c").alias("major"), (F.col("size") - F.col("top.m")).alias("odds"))
    rest = cut(placed.join(mixed, "s").select("s", "id", "n", "c", "size", (F.col("c") != F.col("major")).alias("odd"), "odds"))
    few = rest.where(F.col("size") <= BLOCK // 8)
    odd = few.where("odd").select("s", F.col("id").alias("i"), F.col("n").alias("m"), F.col("c").alias("d"))
    lesser = F.col("i") < F.col("id")
    pick = lambda a, b: F.when(lesser, F.col(a)).otherwise(F.col(b))
    found = odd.join(few, "s").where("c <> d").select(pick("i", "id").alias("x"), pick("id", "i").alias("y"), pick("m", "n").alias("nx"), pick("n", "m").alias("ny")).where(fits)
    many = rest.where(F.col("size") > BLOCK // 8)
    return found.union(_across(docs, many, k, percent)) if many.limit(1).count() else found


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents are linked when ``100 * intersection >= percent * union`` of
    their shingle sets. ``component_id`` is the smallest doc_id reachable by
    links. Null, empty and blank texts have no shingles and no links; rows with
    a null doc_id have a null component and link nothing. Repeated rows are
    kept. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = Table(_sets(docs, k), "sets")
    sets = made.rows.where("n is not null").select("doc_id", "n", "k1", "k2")
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"))
    cells = spark.sparkContext.broadcast(summed(made.rows.where("cells is not null"), SKETCH_BITS))
    docs = docs.where("doc_id is not null")
    first = Table(_prefixes(docs, k, percent, cells), "prefixes")
    # Two sets may have the same half of a digest: they then share what either proposes.
    posts = cut(_shared(first.rows).join(nodes.select(F.col("k1").alias("key"), "id", "n"), "key").select("s", "id", "n"))
    first.drop()

    fits = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
    tested = cut(_leader_pairs(posts, fits).distinct())
    links = cut(_verified(docs, _able(docs, tested, k, percent), k, percent, cells))
    comps = connected_components(links)
    done = tested.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    left = _rest_pairs(docs, posts, comps, k, percent, fits).distinct().join(done, ["x", "y"], "left_anti")
    left = _able(docs, left.select("x", "y", "nx", "ny"), k, percent)
    if left.limit(1).count():
        comps = connected_components(links.union(_verified(docs, left, k, percent, cells)))

    by_set = nodes.join(comps, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    out = sets.join(by_set, ["k1", "k2"], "left")
    out = cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))
    made.drop()
    return out


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each group of near copies.

    Rows whose doc_id is null stay. A repeated row (same doc_id) stays as often
    as it was there.
    """
    found = ngram_components(docs, k, percent)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


#: All pairs that share a shingle, for small tables alone.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0d]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS both_ FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * both_ >= 85 * (nx + ny - both_)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT doc_id, doc_id AS spot FROM g UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.spot = e.x)
SELECT g.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM g JOIN (SELECT doc_id, min(spot) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""
