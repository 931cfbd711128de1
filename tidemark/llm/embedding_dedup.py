"""Operator 7, embedding near-dedup: int8 quantised tile products with error bounds, then full precision where they can't tell.

Every vector is brought to length 1 and to int8 codes times a scale of its own
before anything is shuffled. With e = u - s * q the rest of a vector u,
|u.v - s_u s_v q_u.q_v| <= |e_u| + |e_v| + |e_u| |e_v|, since u and v have length
1; the lengths of the rests are measured for each vector, not guessed. Vectors
of one label are dealt into blocks of about BLOCK rows, and pairs of blocks are
tiles, task-sized products of codes. A pair whose product less the bound reaches
the threshold is a link; one whose product plus the bound does is doubtful. Only
the vectors of doubtful pairs travel to a second round, in double precision. A
tile returns link counts for each of its vectors and a forest of its links,
never its pairs.

Labels of many blocks are first cut into cells of the width that two linked
vectors can be apart, along the AXES directions in which a bounded sample
spreads most; only tiles of cells that touch are made. Cells leave out tiles
without links, never links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, read_table, small_arrow_batches, stored

THRESHOLD, BLOCK = 0.98, 2048
#: Directions that cells are cut along, vectors that they are fit on, and blocks of a label from which cells are made.
AXES, SAMPLE, CELLS_FROM = 3, 2000, 16


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and upper bounds on the lengths of what they leave out."""
    scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, rest + 1e-12


def tile_bounds(a: tuple, b: tuple, stripe: int = 512):
    """Least and greatest possible products of all rows of a and b, each (codes, scales, rests), stripe by stripe: first row, lower, upper."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    exact = np.float32 if qa.shape[1] <= 1040 else np.float64  # products of int8 codes are exact in float32 up to 1,040 dimensions
    right = qb.astype(exact).T
    for lo in range(0, len(qa), stripe):
        product = (qa[lo : lo + stripe].astype(exact) @ right).astype(np.float64)
        product *= sa[lo : lo + stripe, None] * sb[None, :]
        bound = ra[lo : lo + stripe, None] + rb[None, :]
        bound += ra[lo : lo + stripe, None] * rb[None, :] + 1e-9
        yield lo, product - bound, product + bound


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node of its tree."""
    low = np.arange(n)
    if not pairs:
        return low
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


FOUND = "vec_id long, n long, root long, doubt boolean, label_no long, lo int, hi int, block int, twin long"
KEYS = ["label_no", "lo", "hi"]


def _sides(table: pa.Table, key) -> tuple[dict[str, np.ndarray], int]:
    """The columns of a tile's rows, those of its lower block first, rows repeated with one id and vector once; and the size of the lower block (0: a block with itself)."""
    lo, hi = (k.as_py() for k in key[1:])
    block, ids, twin = (table[c].to_numpy() for c in ("block", "vec_id", "twin"))
    order = np.lexsort((twin, ids, block))
    same = (block[order][1:] == block[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (twin[order][1:] == twin[order][:-1])
    order = order[np.append(True, ~same)] if len(order) else order
    return {"order": order, "vec_id": ids[order], "twin": twin[order], "block": block[order]}, (0 if lo == hi else int((block[order] == lo).sum()))


def _matrix(table: pa.Table, name: str, order: np.ndarray, kind) -> np.ndarray:
    column = table[name].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), -1)[order]


def _gathered(key, rows: dict, split: int, blocks, doubt: np.ndarray) -> pa.Table:
    """A tile's result: blocks gives its links as pairs of rows."""
    ids = rows["vec_id"]
    n, pairs = np.zeros(len(ids), np.int64), []
    for x, y in blocks:
        y = y + split
        keep = (ids[x] != ids[y]) if split else (x < y) & (ids[x] != ids[y])
        x, y = x[keep], y[keep]
        n += np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
        if len(x):
            pairs.append((x, y))
            if sum(len(p[0]) for p in pairs) > 1_000_000:
                pairs = [(np.arange(len(ids)), forest(len(ids), pairs))]
    low = forest(len(ids), pairs)
    # The root of a tree must have its smallest id: rows are in order of ids within a block only.
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, low, ids)
    out = np.flatnonzero((n > 0) | doubt)
    consts = [pa.array(np.full(len(out), k.as_py()), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
    columns = [pa.array(ids[out]), pa.array(n[out]), pa.array(least[low][out]), pa.array(doubt[out]), *consts, pa.array(rows["block"][out].astype(np.int32)), pa.array(rows["twin"][out])]
    return pa.table(columns, names=["vec_id", "n", "root", "doubt", *KEYS, "block", "twin"])


def _quantised_tile(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, split = _sides(table, key)
        order = rows["order"]
        codes = _matrix(table, "codes", order, np.int8)
        side = codes, table["scale"].to_numpy()[order], table["rest"].to_numpy()[order]
        a, b = (tuple(x[:split] for x in side), tuple(x[split:] for x in side)) if split else (side, side)
        doubt = np.zeros(len(order), bool)

        def links():
            if split == len(order) or not len(order):
                return
            for lo, lower, upper in tile_bounds(a, b):
                i, j = np.nonzero((upper >= threshold) & (lower < threshold))
                i, j = i + lo, j + split
                other = rows["vec_id"][i] != rows["vec_id"][j]
                doubt[i[other]] = doubt[j[other]] = True
                i, j = np.nonzero(lower >= threshold)
                yield i + lo, j

        blocks = list(links())
        return _gathered(key, rows, split, blocks, doubt)

    return run


def _exact_tile(threshold: float):
    """Pairs that their codes leave in doubt, in double precision; the vectors are those that the first round named."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, split = _sides(table, key)
        units = _matrix(table, "unit", rows["order"], np.float64)
        side = quantise(units)
        a, b = (tuple(x[:split] for x in side), tuple(x[split:] for x in side)) if split else (side, side)
        ua, ub = (units[:split], units[split:]) if split else (units, units)

        def links():
            if split == len(units) or not len(units):
                return
            for lo, lower, upper in tile_bounds(a, b):
                i, j = np.nonzero((upper >= threshold) & (lower < threshold))
                for at in range(0, len(i), 200_000):
                    x, y = i[at : at + 200_000] + lo, j[at : at + 200_000]
                    good = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
                    yield x[good], y[good]

        return _gathered(key, rows, split, links(), np.zeros(len(units), bool))

    return run


PREPARED = "vec_id long, dim int, codes binary, scale double, rest double, unit binary, twin long, c0 int, c1 int, c2 int"


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors (finite, not zero, not null) and each divided by its length; largest component first, so squares stay finite."""
    places, units = [], []
    values, offsets = vectors.values, vectors.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    there = np.asarray(vectors.is_valid())
    sizes = np.diff(offsets)
    for d in np.unique(sizes[there]).tolist():
        own = np.flatnonzero(there & (sizes == d))
        if not d:
            continue
        block = flat[offsets[own][:, None] + np.arange(d)]
        most = np.abs(block).max(1)
        good = np.isfinite(most) & (most > 0)  # a NaN makes the largest NaN
        block = block[good] / most[good, None]
        places.append(own[good])
        units += list(block / np.sqrt(np.einsum("ij,ij->i", block, block))[:, None])
    order = np.argsort(np.concatenate(places), kind="stable") if places else []
    return (np.concatenate(places)[order] if places else np.zeros(0, np.int64)), [units[i] for i in order]


def _prepare(axes: dict[int, np.ndarray], width: float):
    def run(batches):
        for batch in batches:
            at, units = unit_rows(batch.column(2))
            codes, scale, rest, cells = [], [], [], np.zeros((len(units), AXES), np.int32)
            for i, u in enumerate(units):
                q, s, r = quantise(u[None, :])
                codes.append(q.tobytes())
                scale.append(s[0])
                rest.append(r[0])
                if len(u) in axes:
                    cells[i, : len(axes[len(u)])] = np.floor(axes[len(u)] @ u / width)
            twins = [int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True) for u in units]
            take = pa.array(at)
            columns = [batch.column(0).take(take), pa.array([len(u) for u in units], pa.int32()), pa.array(codes, pa.binary()), pa.array(scale, pa.float64()), pa.array(rest, pa.float64())]
            columns += [pa.array([u.tobytes() for u in units], pa.binary()), pa.array(twins, pa.int64()), *(pa.array(cells[:, k]) for k in range(AXES)), batch.column(1).take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "codes", "scale", "rest", "unit", "twin", "c0", "c1", "c2", "label"])

    return run


def spread_axes(sample: pa.Array, most: int = AXES) -> dict[int, np.ndarray]:
    """For each dimension the orthonormal directions in which the sample spreads most."""
    _, units = unit_rows(sample)
    by_dim: dict[int, list[np.ndarray]] = {}
    for u in units:
        by_dim.setdefault(len(u), []).append(u)
    out = {}
    for d, rows in by_dim.items():
        centred = np.stack(rows) - np.mean(rows, axis=0)
        out[d] = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :most].T.copy()
    return out


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Only vectors of one label that is not null are compared. Null, zero-length
    and zero vectors, and those that hold nulls, NaN or infinities, link with
    nothing. Vectors are compared only with those of their own length. Ids are
    integers; a null id links with nothing and has a null component. Rows
    repeated with one id and vector are one vector, each of them gets its row;
    rows of one id with other vectors add their links up and never link with
    each other. A product equal to the threshold links. Ties don't matter: links
    are counted, and the smallest id names a component. An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = rows.where("vec_id is not null and label is not null and v is not null")
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = pa.concat_arrays(sample.chunks) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    axes = spread_axes(sample) if len(sample) else {}
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6  # how far linked vectors can be apart
    schema = T.StructType([*T._parse_datatype_string(PREPARED).fields, T.StructField("label", rows.schema["label"].dataType)])
    prepared = stored(usable.mapInArrow(_prepare(axes, width), schema), "vectors")

    # Labels and lengths by number; labels of few blocks are one cell.
    kinds = prepared.groupBy("label", "dim").agg(F.count("*").alias("total"))
    kinds = stored(kinds.withColumn("label_no", F.monotonically_increasing_id()), "labels")
    cells = [F.when(F.col("total") >= CELLS_FROM * block, F.col(f"c{k}")).otherwise(0).alias(f"c{k}") for k in range(AXES)]
    axis = [f"c{k}" for k in range(AXES)]
    known = stored(prepared.join(kinds, ["label", "dim"]).select("vec_id", "twin", "codes", "scale", "rest", "label_no", *cells), "codes")
    counts = known.groupBy("label_no", *axis).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    # One row a cell; a block's number is its place among those of its label.
    base = F.coalesce(F.sum("parts").over(Window.partitionBy("label_no").orderBy(*axis).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    counts = stored(counts.withColumn("base", base), "cells")
    dealt = known.join(counts, ["label_no", *axis]).withColumn("block", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).drop(*axis, "base", "parts")
    # Cells that touch: each looks up its neighbours by their place, then their blocks meet, every pair once.
    near = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(step)]) for step in np.ndindex(*[3] * AXES)])
    around = counts.withColumn("d", F.explode(near)).select("label_no", "base", "parts", *[(F.col(f"c{k}") + F.col(f"d.d{k}") - 1).alias(f"c{k}") for k in range(AXES)])
    touching = around.join(counts.select("label_no", *axis, F.col("base").alias("base2"), F.col("parts").alias("parts2")), ["label_no", *axis])
    span = lambda at, n: F.sequence(F.col(at), F.col(at) + F.col(n) - 1)
    tiles = touching.withColumn("lo", F.explode(span("base", "parts"))).withColumn("hi", F.explode(span("base2", "parts2"))).where("lo <= hi").select("label_no", "lo", "hi")
    sides = tiles.select("label_no", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    laid = dealt.join(sides, ["label_no", "block"])
    first = stored(laid.groupBy(*KEYS).applyInArrow(_quantised_tile(threshold), FOUND), "tiles")
    asked = first.where("doubt").select(*KEYS, "block", "vec_id", "twin")
    exact = asked.join(prepared.select("vec_id", "twin", "unit").dropDuplicates(["vec_id", "twin"]), ["vec_id", "twin"])
    second = stored(exact.groupBy(*KEYS).applyInArrow(_exact_tile(threshold), FOUND), "doubts")
    found = first.union(second).where("n > 0")
    counts_of = stored(found.groupBy("vec_id").agg(F.sum("n").alias("n_links")), "links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vectors").withColumnRenamed("node", "vec_id")
    discard(prepared, kinds, known, counts, first, second)
    out = rows.select("vec_id").join(counts_of, "vec_id", "left").join(groups, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
