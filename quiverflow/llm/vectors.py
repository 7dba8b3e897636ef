"""Near-duplicate vectors: products of int8 tiles with error bounds, exact cosines where the bound leaves a doubt.

A unit vector x is s q + e with integers q of at most 127; |x.y - (s q).(s' q')| is at most |e| |s' q'| + |s q| |e'| + |e| |e'|,
with each vector's own norms.  Only pairs whose product comes within that bound of the threshold are computed again in double
precision.  Tiles hold neighbours in the order of a random-projection code; tiles whose centres are further apart than
their radii and the threshold's angle allow are not paired at all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, read

THRESHOLD, TILE = 0.98, 512
#: Pairs computed again at once.
PAIRS = 1 << 15
#: Parts in which a label's tiles meet the label's others.
PARTS = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows are finite and not zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows x as int8 q, scale s, and the norms of s q and of the error, rounded up."""
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None])
    up = 1 + 1e-12
    return q.astype(np.int8), s, np.linalg.norm(q * s[:, None], axis=1) * up, np.linalg.norm(x - q * s[:, None], axis=1) * up + 1e-15


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible cosine of each pair of rows of two quantised tiles."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # in which integer products are exact
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(float) * sa[:, None] * sb[None, :]
    doubt = ea[:, None] * nb[None, :] + na[:, None] * eb[None, :] + ea[:, None] * eb[None, :] + 1e-9
    return near - doubt, near + doubt


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number that each of n is connected to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


SEEN = "u long, n long, a long, b long, ta long, tb long, place int, right boolean, weight long, rep long, mask binary"


def _found(i, j, left: dict, right: dict) -> dict:
    """Links (i, j) as columns: counts for each vector that has some, and a forest over those with an id."""
    out: dict = {"u": [], "n": [], "a": [], "b": []}
    for k, mine, other, weight in ((i, left, j, right["n"]), (j, right, i, left["n"])):
        n = np.bincount(k, weight[other], len(mine["u"])).astype(np.int64)
        some = np.flatnonzero(n)
        out["u"] += mine["u"][some].tolist()
        out["n"] += n[some].tolist()
    out["a"], out["b"] = [None] * len(out["u"]), [None] * len(out["u"])
    named = left["has"][i] & right["has"][j]
    names = np.append(left["rep"], right["rep"])
    root = roots(len(names), i[named], j[named] + len(left["rep"]))
    child = np.flatnonzero(root != np.arange(len(root)))
    out["a"] += names[child].tolist()
    out["b"] += names[root[child]].tolist()
    out["u"] += [None] * len(child)
    out["n"] += [None] * len(child)
    return out


def _rows(columns: dict):
    """A table of SEEN's columns; those not given are null."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    n = max((len(v) for v in columns.values()), default=0)
    pairs = [c.split() for c in SEEN.split(", ")]
    return pa.table({c: pa.array(columns.get(c, [None] * n), kinds[k]) for c, k in pairs})


def _compare(threshold: float):
    """Two tiles by their int8 products: links above the threshold by the bounds, and the rows of pairs that the bounds leave open."""

    def one(table):
        r = table.to_pylist()[0]
        sides, tiles = [], []
        for s in "ab":
            u = np.frombuffer(r["u" + s], np.int64)
            sides.append({"u": u, "n": np.frombuffer(r["n" + s], np.int64), "rep": np.frombuffer(r["rep" + s], np.int64), "has": np.frombuffer(r["has" + s], bool)})
            norms = np.frombuffer(r["norms" + s]).reshape(3, -1)
            tiles.append((np.frombuffer(r["q" + s], np.int8).reshape(len(u), -1), *norms))
        least, most = bounds(*tiles)
        sure, open_ = least >= threshold, (least < threshold) & (most >= threshold)
        if r["tilea"] == r["tileb"]:
            sure, open_ = np.triu(sure, 1), np.triu(open_, 1)
        out = _found(*np.nonzero(sure), *sides)
        first, second = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        done, more = len(out["u"]), len(first) + len(second)
        mask = np.packbits(open_[np.ix_(first, second)], axis=1)
        extra = {
            "u": sides[0]["u"][first].tolist() + sides[1]["u"][second].tolist(),
            "n": [None] * more,
            "a": [None] * more,
            "b": [None] * more,
            "ta": [r["tilea"]] * more,
            "tb": [r["tileb"]] * more,
            "place": [*range(len(first)), *range(len(second))],
            "right": [False] * len(first) + [True] * len(second),
            "weight": sides[0]["n"][first].tolist() + sides[1]["n"][second].tolist(),
            "rep": [int(v) if ok else None for s, k in zip(sides, (first, second), strict=True) for v, ok in zip(s["rep"][k], s["has"][k], strict=True)],
            "mask": [m.tobytes() for m in mask] + [None] * len(second),
        }
        return _rows({c: (out[c] if c in out else [None] * done) + v for c, v in extra.items()})

    return one


def _decide(threshold: float):
    """The open pairs of two tiles, in double precision."""

    def one(table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["right"], r["place"]))
        sides = [[r for r in rows if r["right"] == right] for right in (False, True)]
        x, y = (unit(np.stack([np.frombuffer(r["x"]) for r in s])) for s in sides)
        mask = np.unpackbits(np.stack([np.frombuffer(r["mask"], np.uint8) for r in sides[0]]), axis=1, count=len(y))
        i, j = np.nonzero(mask)
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), PAIRS):
            ok[k : k + PAIRS] = (x[i[k : k + PAIRS]] * y[j[k : k + PAIRS]]).sum(1) >= threshold
        columns = [
            {"u": np.array([r["u"] for r in s]), "n": np.array([r["weight"] for r in s]), "rep": np.array([r["rep"] or 0 for r in s]), "has": np.array([r["rep"] is not None for r in s])}
            for s in sides
        ]
        return _rows(_found(i[ok], j[ok], *columns))

    return one


def link_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors are compared within equal, not null labels and equal lengths.  A null or zero vector, one with null or non-finite
    components and one without label link with nothing.  Equal vectors are compared once and count as often as they
    occur; repeated rows are vectors of their own.  A null key counts among others' links but has no component of its own (null)
    and connects nobody.  Other columns are not read.

    Tiles travel as int8; doubles are fetched only for vectors in pairs that the bounds leave open.
    """
    import pyarrow as pa

    key_of = F.col(key).cast("long").alias("vec_id")
    good = "label is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('inf')) and exists(x, v -> v <> 0)"
    base = rows.select(key_of, F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))

    def prepare(batches):
        import xxhash
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            # Equal vectors of a batch become one row with all their ids, so that no vector is a hot key later.
            ids, kinds = batch.column("vec_id").to_pylist(), {}
            for k, (v, t) in enumerate(zip(batch.column("x").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                v = np.array(v) + 0.0  # -0.0 becomes 0.0
                kinds.setdefault((len(v), t, v.tobytes()), []).append(ids[k])
            for n in {k[0] for k in kinds}:
                mine = [k for k in kinds if k[0] == n]
                x = unit(np.stack([np.frombuffer(k[2]) for k in mine]))
                q, s, norm, error = quantise(x)
                side = np.random.default_rng(n).standard_normal((20, n))
                code = ((x @ side.T > 0) @ (1 << np.arange(19, -1, -1))).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(at, at + len(mine)), pa.int64()), pa.array([f"{n}:{k[1]}" for k in mine]), pa.array([xxhash.xxh3_128_digest(k[2]) for k in mine], pa.binary()), pa.array([kinds[k] for k in mine], pa.list_(pa.int64()))]
                    + [pa.array(code, pa.int64()), pa.array([v.tobytes() for v in q], pa.binary()), *(pa.array(v, pa.float64()) for v in (s, norm, error)), pa.array([k[2] for k in mine], pa.binary())],
                    ["u", "grp", "same", "ids", "code", "q", "s", "norm", "error", "x"],
                )
                at += len(mine)

    ready = cut(base.filter(F.expr(good)).mapInArrow(prepare, "u long, grp string, same binary, ids array<long>, code long, q binary, s double, norm double, error double, x binary"))
    # One row for each different vector, under the number of one of its rows; it stands for the smallest id (or, without any id, for none).
    first = F.min(F.struct("u", "code", "q", "s", "norm", "error")).alias("f")
    kinds = cut(ready.groupBy("grp", "same").agg(first, F.min(F.array_min("ids")).alias("rep"), F.sum(F.size("ids").cast("long")).alias("n")).select("grp", "same", "f.*", "rep", "n"))
    spread = max(1, kinds.count() // (16 * tile))
    columns = ("u", "n", "rep", "has", "q", "norms")

    def pack(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held, now = [], None

        def out():
            nonlocal seq
            q = np.stack([np.frombuffer(r["q"], np.int8) for r in held])
            norms = np.array([[r[c] for r in held] for c in ("s", "norm", "error")])
            x = unit(q.astype(float))
            centre = x.mean(0)
            centre = centre / max(np.linalg.norm(centre), 1e-12)
            # A vector is within the arc of its error from its int8 form.
            radius = float((np.arccos(np.clip(x @ centre, -1, 1)) + np.arcsin(np.minimum(norms[2], 1))).max()) + 1e-7
            seq += 1
            whole = {c: np.array([r[c] for r in held], np.int64).tobytes() for c in ("u", "n")}
            whole |= {"rep": np.array([r["rep"] or 0 for r in held], np.int64).tobytes(), "has": np.array([r["rep"] is not None for r in held]).tobytes()}
            whole |= {"q": q.tobytes(), "norms": norms.tobytes(), "grp": now, "tile": (part << 32) + seq, "centre": centre.tolist(), "radius": radius}
            kind = [("grp", pa.string()), ("tile", pa.int64()), *((c, pa.binary()) for c in columns), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]
            return pa.RecordBatch.from_pylist([whole], pa.schema(kind))

        for b in batches:
            for r in b.to_pylist():
                if held and (r["grp"] != now or len(held) >= tile):
                    yield out()
                    held = []
                now = r["grp"]
                held.append(r)
        if held:
            yield out()

    near = kinds.drop("same").repartitionByRange(spread, "grp", "code", "u").sortWithinPartitions("grp", "code", "u")
    tiles = cut(near.mapInArrow(pack, f"grp string, tile long, {', '.join(c + ' binary' for c in columns)}, centre array<double>, radius double"))
    meta = tiles.select("grp", "tile", "centre", "radius")
    a, b = (meta.select("grp", *(F.col(c).alias(c + s) for c in ("tile", "centre", "radius"))) for s in "ab")
    # A label's tiles meet in PARTS parts, not in one task.
    a, b = a.withColumn("part", F.pmod(F.xxhash64("tilea"), F.lit(PARTS)).cast("int")), b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    angle = F.expr("acos(least(1D, greatest(-1D, aggregate(zip_with(centrea, centreb, (p, q) -> p * q), 0D, (s, v) -> s + v))))")
    pairs = a.join(b, ["grp", "part"]).filter("tilea <= tileb").filter((F.col("tilea") == F.col("tileb")) | (angle <= F.col("radiusa") + F.col("radiusb") + float(np.arccos(threshold)) + 1e-7)).select("tilea", "tileb")
    for s in "ab":
        pairs = pairs.join(tiles.select(F.col("tile").alias("tile" + s), *(F.col(c).alias(c + s) for c in columns)), "tile" + s)
    seen = cut(pairs.groupBy("tileb", "tilea").applyInArrow(_compare(threshold), SEEN))
    doubt = seen.filter("ta is not null").drop("n", "a", "b").join(ready.select("u", "x"), "u")
    links = seen.filter("ta is null").select("u", "n", "a", "b").union(cut(doubt.groupBy("ta", "tb").applyInArrow(_decide(threshold), SEEN).select("u", "n", "a", "b")))
    counts = links.filter("n is not null").groupBy("u").agg(F.sum("n").alias("more"))
    # Components by the smallest id: each node of the links is the id of its vector.
    found = components(links.filter("a is not null").select("a", "b"))
    known = kinds.select("grp", "same", "u", "rep", "n").join(counts, "u", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("grp", "same", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    result = ready.select("grp", "same", "ids").join(known, ["grp", "same"]).select(F.explode("ids").alias("vec_id"), "n_links", "component_id")
    result = result.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.col("component_id")))
    alone = base.filter(~F.coalesce(F.expr(good), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))
