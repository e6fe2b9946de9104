"""Near duplicates among embeddings by random-hyperplane hashing.

Equal vectors are one node with a count. Every node gets one signature per
table, the signs of its products with random hyperplanes. Nodes that agree on
a table's whole signature are compared exactly, block against block, in double
precision. A pair counts in the first table in which it meets, so links are
counted once without listing pairs; each block passes on only a spanning forest
of its links, from which distributed components are formed.

A signature's bucket may be of any size: it is cut into blocks of about
``BLOCK`` nodes, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

TABLES, BITS, BLOCK, SEED = 20, 11, 1024, 7
LEAST_COSINE = 0.9
#: Nodes that a bucket of unlike vectors holds on average, at most, and the recall wanted of pairs at the least cosine.
FILL, RECALL = 32, 0.97


def meeting(bits: int) -> float:
    """The probability that two vectors at the least cosine agree on one table's signature."""
    return (1 - math.acos(LEAST_COSINE) / math.pi) ** bits


def layout(nodes: int) -> tuple[int, int]:
    """(tables, bits) for so many nodes: bits grow with their logarithm, so that work
    grows little faster than their number, and tables with what the bits cost in recall."""
    bits = min(30, max(BITS, math.ceil(math.log2(max(1, nodes) / FILL))))
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log1p(-meeting(bits)))), bits


def planes(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, tables * bits))


def _signed(reps: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(id, n, unit, sigs): nodes with unit vectors (bytes of doubles) and signatures.

    Vectors of another length than their neighbours' are hashed with planes of
    their own and only ever meet vectors of that length.
    """
    powers = 1 << np.arange(bits)

    def run(batches):
        for batch in batches:
            ids, n, units, sigs = [], [], [], []
            rows = zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("embedding").to_pylist(), strict=True)
            by_width: dict[int, list] = {}
            for row in rows:
                by_width.setdefault(len(row[2]), []).append(row)
            for width, group in by_width.items():
                x = np.array([r[2] for r in group], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                bit = (x @ planes(width, tables, bits, seed) >= 0).reshape(len(group), tables, bits)
                sig = (bit * powers).sum(axis=2).astype(np.int32)
                for row, unit, s in zip(group, x, sig, strict=True):
                    ids.append(row[0])
                    n.append(row[1])
                    units.append(unit.tobytes())
                    sigs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(units, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "unit", "sigs"])

    return reps.mapInArrow(run, "id long, n long, unit binary, sigs binary")


def _roots(links: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a boolean link matrix reaches."""
    label = np.arange(len(links))
    while True:
        near = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _compare(key, table):
    """One block, or two blocks against each other: links per node and a forest of links."""
    t, i, j = (key[k].as_py() for k in (0, 3, 4))
    table = table.sort_by("id")
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    unit = np.array([np.frombuffer(x, np.float64) for x in table.column("unit").to_pylist()])
    sigs = np.array([np.frombuffer(x, np.int32) for x in table.column("sigs").to_pylist()])
    block = table.column("block").to_numpy()
    links = unit @ unit.T >= LEAST_COSINE
    np.fill_diagonal(links, False)
    if i != j:
        links &= block[:, None] != block[None, :]
    for s in range(t):  # met before
        links &= sigs[:, None, s] != sigs[None, :, s]
    count = links @ n
    some = np.flatnonzero(count)
    root = _roots(links[np.ix_(some, some)])
    return pa.table({"id": pa.array(ids[some]), "links": pa.array(count[some].astype(np.int64)), "root": pa.array(ids[some[root]])})


def near_duplicates(vectors: DataFrame, tables: int | None = None, bits: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing. No link below cosine 0.9 is made; a pair at 0.9 meets in some
    table with probability ``1 - (1 - 0.856**bits)**tables`` (0.98 with 20
    tables of 11 bits, which ``layout`` chooses up to 65,536 vectors, and at
    least 0.97 beyond), a closer pair with a higher one. Equal vectors always link. Repeated
    vec_ids are rows of their own; a null vec_id links with nothing. Other
    columns of ``vectors`` are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(F.coalesce(fine, F.lit(False)))
    reps = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    chosen = layout(reps.count())
    tables, bits = tables or chosen[0], bits or chosen[1]
    members = good.join(reps.select("embedding", "id"), "embedding").select("vec_id", "id")
    nodes = _signed(reps, tables, bits, seed)
    sig = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("t"), F.substring("sigs", t * 4 + 1, F.lit(4)).alias("sig")))
    spread = nodes.withColumn("at", F.explode(sig)).select("at.t", "at.sig", F.length("unit").alias("width"), "id", "n", "unit", "sigs")
    sizes = spread.groupBy("t", "sig", "width").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    placed = spread.join(cut(sizes), ["t", "sig", "width"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = cut(placed.drop("blocks", "other", "width").select("t", "sig", F.length("unit").alias("width"), "i", "j", "block", "id", "n", "unit", "sigs").groupBy("t", "sig", "width", "i", "j").applyInArrow(_compare, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_node = reps.select("id", "n").join(links, "id", "left").join(comps, "id", "left")
    by_node = by_node.select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = members.join(by_node, "id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
