"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, in bands, verified.

A shingle is five words; its weight is its count times the mean inverse document frequency of its
words.  (Frequencies of whole shingles would punish exactly the groups that are looked for: a large
group of copies makes its own shingles common and the few that differ rare.)  Document frequencies are counted exactly over all
documents.  A word in less than a share RARE of them weighs as much as one in just that share, so the words that must be known
to every task are at most a document's mean number of different words over RARE, whatever the corpus's size.

A sample is consistent (Ioffe 2010): of each shingle with weight S, t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1);
the shingle with the least a is drawn, and with its t it is the sample; two documents draw alike with a probability of their
weighted Jaccard similarity.  r, c ~ Gamma(2, 1) and b ~ U(0, 1) are read from tables by different bits of a hash of shingle and sample.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, read, slices, tidy, word_hash

SHINGLE, SIMILAR = 5, 0.8
#: Bands and samples in each; a pair at 0.8 shares a band with a probability of 0.998.
BANDS, ROWS = 12, 4
#: Words in a smaller share of the documents count as words in this share.
RARE = 1e-4
#: Entries (a power of two) of the tables of r, c and b.
TABLE_BITS = 14
#: Samples of all that a pair must share to be verified; a pair at 0.8 falls below with a probability of 0.0003.
SHARED = 29
#: Texts of a band group that are compared in one block, the words that these have together (but for one text), and texts of a larger group that go into all its blocks.
BLOCK, BLOCK_WORDS, PIVOTS = 512, 1_000_000, 8
#: A sample's last byte is kept, eight to a column.
DRAWS = [f"d{k}" for k in range(BANDS * ROWS // 8)]
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task counts before it passes them on.
FLUSH = 1 << 20
#: Bytes of texts that are split into words at once (a longer text alone), and shingles that are sampled together.
SPLIT, CACHED = 1 << 20, 1 << 14


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def pieces(batches, text: str):
    """Slices, cut so that the texts of one have SPLIT bytes at most or are one."""
    import pyarrow.compute as pc

    for b in slices(batches):
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, SPLIT + (size[at - 1] if at else 0), "right")))
            yield b.slice(at, end - at)
            at = end


class Idf:
    """ln((documents + 1) / (frequency + 1)) + 1, where a frequency is at least RARE of all documents.  words: sorted hashes; n: their frequencies."""

    def __init__(self, documents: int, words: np.ndarray, n: np.ndarray):
        self.most = float(np.log((documents + 1) / (RARE * documents + 1)) + 1)
        self.words = np.append(words, np.iinfo(np.int64).max)  # no search ends behind the last
        self.idf = np.append(np.minimum(np.log((documents + 1) / (n + 1)) + 1, self.most), self.most)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.words, words)
        return np.where(self.words[k] == words, self.idf[k], self.most)


def document_frequency(docs: DataFrame, text: str = "text") -> Idf:
    """From the number of documents with words and, for each word, of those that hold it."""
    import pyarrow as pa

    def run(batches):
        held, size, n = [], 0, 0

        def out():
            k, count = np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1)
            held.clear()
            order = np.argsort(k)
            k, count = k[order], count[order]
            first = np.flatnonzero(np.diff(k, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(np.add.reduceat(count, first))], ["word", "n"])

        for b in pieces(batches, text):
            seen = [w for t in b.column(0).to_pylist() if (w := set(words_of(t)))]
            words = Counter(itertools.chain.from_iterable(seen))
            held.append(np.array([[word_hash(w) for w in words], list(words.values())], np.int64))
            size, n = size + len(words), n + len(seen)
            if size > FLUSH:
                yield out()
                size = 0
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([n])], ["word", "n"])

    counts = cut(docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    documents = counts.filter("word = -1").agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("word") >= 0) & (F.col("n") > RARE * documents)).toPandas()
    rows = rows.sort_values("word")
    return Idf(documents, rows["word"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


class Shingler:
    """Weighted shingles of texts.  idf: of an array of words' hashes; each different word of the texts is looked up once, all together."""

    def __init__(self, idf):
        self.idf = idf

    def __call__(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted shingle hashes and their weights, for each text, given as its words; a text of fewer than five words is one shingle."""
        out = [(np.zeros(0, np.uint64), np.zeros(0))] * len(texts)
        for n in range(1, SHINGLE + 1):
            those = [k for k, w in enumerate(texts) if min(len(w), SHINGLE) == n]
            if those:
                for k, made in zip(those, self.group([texts[k] for k in those], n), strict=True):
                    out[k] = made
        return out

    def group(self, texts: list[list[str]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Likewise with shingles of n words; no text has fewer."""
        ends = np.cumsum([len(w) for w in texts])
        place = defaultdict(itertools.count().__next__)
        at = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(texts)), np.int64, ends[-1])
        h = np.fromiter(map(word_hash, place), np.int64, len(place))
        idf, h = (self.idf(h) / n)[at], h.view(np.uint64)[at]
        m = len(h) - n + 1
        key, weight = np.zeros(m, np.uint64), np.zeros(m)
        for j in range(n):
            key = (key ^ h[j : j + m]) * MIX
            key ^= key >> np.uint64(29)
            weight += idf[j : j + m]
        order, starts, start = [], [], 0
        for end in ends.tolist():  # windows over two texts are in no piece
            order.append(np.argsort(key[start : end - n + 1]) + start)
            starts.append(end - start - n + 1)
            start = end
        order, starts = np.concatenate(order), np.append(0, np.cumsum(starts))
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        new[starts[:-1]] = True
        first = np.flatnonzero(new)
        key, weight = key[first], weight[order[first]] * np.diff(np.append(first, len(order)))
        cuts = np.searchsorted(first, starts).tolist()
        return [(key[i:j], weight[i:j]) for i, j in itertools.pairwise(cuts)]


def random_tables(samples: int, seed: int = 5):
    g = np.random.default_rng(seed)
    r, c, b = g.gamma(2, 1, 1 << TABLE_BITS), g.gamma(2, 1, 1 << TABLE_BITS), g.random(1 << TABLE_BITS)
    odd = g.integers(1, 1 << 63, samples, np.uint64) | np.uint64(1)
    f = lambda x: x.astype(np.float32)
    return f(r), f(1 / r), f(np.log(c)), f(b), odd


def samples_of(shingles: list[tuple[np.ndarray, np.ndarray]], tables) -> np.ndarray:
    """For each text and sample 64 bits: ln a of the shingle drawn, which tells its t, and 32 bits of its hash.  No text may be empty."""
    r, inv, log_c, b, odd = tables
    out = np.zeros((len(odd), len(shingles)), np.int64)
    size = np.array([len(k) for k, _ in shingles])
    mask, low = (1 << TABLE_BITS) - 1, np.int64((1 << 32) - 1)
    at = 0
    while at < len(size):  # texts whose shingles together fit a cache
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), CACHED)))
        keys = np.concatenate([k for k, _ in shingles[at:end]])
        log = np.log(np.concatenate([w for _, w in shingles[at:end]])).astype(np.float32)
        starts = np.append(0, np.cumsum(size[at:end])[:-1])
        for j, m in enumerate(odd):
            h = (keys * m >> np.uint64(64 - 3 * TABLE_BITS)).view(np.int64)
            k = h >> (2 * TABLE_BITS)
            x, t = r.take(k, mode="clip"), inv.take(k, mode="clip")  # no place is beyond the tables; "clip" spares the check
            y = b.take(h >> TABLE_BITS & mask, mode="clip")
            t *= log
            t += y
            np.floor(t, out=t)
            t -= y
            t += 1
            x *= t
            a = (log_c.take(h & mask, mode="clip") - x).view(np.int32)
            a ^= (a >> 31) & 0x7FFFFFFF  # whole numbers in the order of the floats
            out[j, at:end] = np.minimum.reduceat(a.astype(np.int64) << 32 | h & low, starts)
        at = end
    return np.ascontiguousarray(out.T)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of lesser weights over sum of greater ones."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    k = np.searchsorted(b[0], a[0])
    k[k == len(b[0])] = 0
    same = b[0][k] == a[0]
    x, y = a[1][same], b[1][k[same]]
    least = np.minimum(x, y).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def meetings(member: DataFrame, draws: DataFrame) -> DataFrame:
    """Texts that have something to be compared with: band, tile, side, rep, component, place.

    member: band, tile, side, rep, component.  In a tile, texts of side 2 are compared with each other, those of sides 0 and 1
    with those of the other side.  draws: rep, bands, alone (bits of the bands whose group is one block) and DRAWS.
    A pair meets if it shares SHARED samples and no earlier band that is compared in one block.
    """
    import pyarrow as pa

    names = ["band", "tile", "side", "rep", "component"]

    def run(batches):
        at, held = None, []

        def out():
            seen = tile_pairs(held, np.array([h[5] for h in held]), np.array([h[6] for h in held]), np.array([h[7] for h in held], np.int64), at[0])
            near = np.zeros(len(held), bool)
            for i, j in seen:
                near[i] = True
                near[j] = True
            rows = [held[k][:5] for k in np.flatnonzero(near)]
            return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], pa.schema([(c, pa.int64()) for c in names]))

        for b in slices(batches):
            cols = [b.column(c).to_pylist() for c in names]
            drawn = np.column_stack([b.column(d).to_numpy() for d in DRAWS]).view(np.uint8)
            bands, alone = b.column("bands").to_pylist(), b.column("alone").to_pylist()
            for k, row in enumerate(zip(*cols, strict=True)):
                if row[:2] != at:
                    if len(held) > 1:
                        yield out()
                    at, held = row[:2], []
                held.append((*row, drawn[k], bands[k], alone[k]))
        if len(held) > 1:
            yield out()

    rows = member.join(draws, "rep").select(*names, "bands", "alone", *DRAWS).repartition("band", "tile").sortWithinPartitions("band", "tile", "side", "rep")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def tile_pairs(held, drawn: np.ndarray, bands: np.ndarray, alone: np.ndarray, band: int):
    """(i, earlier ones that i is to be compared with), i ascending."""
    side, comp, rep = (np.array([h[k] for h in held], np.int64) for k in (2, 4, 3))
    bit = np.int64(1) << np.arange(bands.shape[1], dtype=np.int64)
    place = int(np.flatnonzero((bands == band).any(0))[0])
    ours = (alone[:, None] & bit[None, :place]) != 0
    for i in range(1, len(held)):
        ok = (comp[:i] != comp[i]) & (rep[:i] != rep[i]) & ((side[:i] != side[i]) | (side[:i] == 2))
        if not ok.any():
            continue
        ok[ok] = (drawn[:i][ok] == drawn[i]).sum(1) >= SHARED
        if place and ok.any():
            ok[ok] = ~((bands[:i, :place][ok] == bands[i, :place]) & ours[i]).any(1)
        if ok.any():
            yield i, np.flatnonzero(ok)


def links_of(met: DataFrame, draws: DataFrame, docs: DataFrame, shingler, similar: float) -> DataFrame:
    """(a, b): components to be merged, by pairs that meet and are similar; pairs whose components the tile has merged already are passed over."""
    import pyarrow as pa

    names = ["band", "tile", "side", "rep", "component"]

    def run(batches):
        make, at, held = shingler(), None, []

        def out():
            drawn, bands, alone = np.array([h[5] for h in held]), np.array([h[6] for h in held]), np.array([h[7] for h in held], np.int64)
            up: dict[int, int] = {}

            def top(c: int) -> int:
                while (above := up.get(c, c)) != c:
                    up[c] = c = up.get(above, above)
                return c

            found = [], []
            for i, near in tile_pairs(held, drawn, bands, alone, at[0]):
                for j in near.tolist():
                    if (x := top(held[j][4])) != (y := top(held[i][4])) and similarity(held[j][8], held[i][8]) >= similar:
                        up[max(x, y)] = min(x, y)
                        found[0].append(max(x, y))
                        found[1].append(min(x, y))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

        for b in pieces(batches, "text"):
            cols = [b.column(c).to_pylist() for c in names]
            drawn = np.column_stack([b.column(d).to_numpy() for d in DRAWS]).view(np.uint8)
            bands, alone, made = b.column("bands").to_pylist(), b.column("alone").to_pylist(), make([words_of(t) for t in b.column("text").to_pylist()])
            for k, row in enumerate(zip(*cols, strict=True)):
                if row[:2] != at:
                    if len(held) > 1:
                        yield out()
                    at, held = row[:2], []
                held.append((*row, drawn[k], bands[k], alone[k], made[k]))
        if len(held) > 1:
            yield out()

    texts = docs.withColumnRenamed("doc_id", "rep").join(met.select("rep").distinct(), "rep").dropDuplicates(["rep"])
    rows = met.join(texts, "rep").join(draws, "rep").select(*names, "bands", "alone", *DRAWS, "text")
    rows = rows.repartition("band", "tile").sortWithinPartitions("band", "tile", "side", "rep")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, kept for each document: its class is the smallest id that it reaches over links.

    Links: weighted Jaccard of at least `similar` between documents that share a band and SHARED samples.  Equal word sequences are one text
    from the start, by a 128-bit hash.  Every pair of different texts that meets in a band is either compared or already in one class:
    a band's group is dealt into blocks, all pairs of a block are compared, and a few texts of the group in all its blocks; then, of
    groups of more than one block and more than one class, the texts outside the largest class with all texts, tile by tile.  A text
    travels once a block in which it meets something, not once a pair.

    Case counts for nothing, white space only separates.  Empty texts are equal texts; null texts are classes of their own.  Rows with
    one key must be copies of each other and give one row; rows with a null key are left out, as they can't be named.  Very long
    texts count whole.  An empty table gives no rows; columns beside key and text are not looked at.
    """
    import pyarrow as pa
    import xxhash

    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    idf, tables = sc.broadcast(document_frequency(docs)), sc.broadcast(random_tables(BANDS * ROWS))
    shingler = lambda: Shingler(idf.value)
    bands = [f"b{k}" for k in range(BANDS)]
    marks = [*bands, "words", *DRAWS]

    def sign(batches):
        make = shingler()
        for b in pieces(batches, "text"):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            words = [words_of(t) for t in texts]
            rows = [k for k, w in enumerate(words) if w]
            drawn = samples_of(make([words[k] for k in rows]), tables.value) if rows else np.zeros((0, BANDS * ROWS), np.int64)
            drawn = drawn.view(np.uint64) * MIX
            drawn ^= drawn >> np.uint64(32)
            full = np.zeros((len(rows), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                full = (full ^ drawn[:, j::ROWS]) * MIX
                full ^= full >> np.uint64(31)
            values = np.zeros((len(ids), len(marks)), np.int64)
            values[rows, :BANDS] = full.view(np.int64)
            values[:, BANDS] = [len(w) for w in words]
            values[rows, BANDS + 1 :] = (drawn & np.uint64(255)).astype(np.uint8).view(np.int64)
            same = [None if t is None else xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for t, w in zip(texts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), *map(pa.array, values.T)], ["doc_id", "same", *marks])

    signed = cut(docs.mapInArrow(sign, "doc_id long, same binary, " + ", ".join(f"{c} long" for c in marks)))
    # Rows of equal texts have equal marks; the grouping combines them before it shuffles.
    reps = cut(signed.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), *(F.max(c).alias(c) for c in marks)))
    held = reps.filter("words > 0")
    member = held.select("rep", "words", F.posexplode(F.array(*bands)).alias("k", "band"))
    sizes = member.groupBy("band").agg(F.count("*").alias("n"), F.sum("words").alias("w")).filter("n > 1")
    sizes = sizes.select("band", F.expr(f"greatest(ceil(n / {BLOCK}), ceil(w / {BLOCK_WORDS}))").alias("blocks"))
    member = cut(member.join(sizes, "band").select("rep", "k", "band", "blocks"))
    alone = member.filter("blocks = 1").groupBy("rep").agg(F.sum(F.expr("shiftleft(1L, k)")).alias("alone"))
    draws = held.select("rep", F.array(*bands).alias("bands"), *DRAWS).join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("long")))
    draws = cut(draws.join(member.select("rep").distinct(), "rep", "left_semi"))
    tile = F.pmod(F.xxhash64("rep"), "blocks")
    large = member.filter("blocks > 1")
    pivots = large.groupBy("band", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(PIVOTS)).alias("p")).agg(F.min("rep").alias("rep"), F.max("blocks").alias("blocks"))
    everywhere = pivots.select("rep", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("tile"))
    placed = member.select("rep", "band", tile.alias("tile")).union(everywhere).distinct()
    met = cut(meetings(placed.withColumn("side", F.lit(2).cast("long")).withColumn("component", F.col("rep")), draws))
    classes = components(cut(links_of(met, draws, docs, shingler, similar)))
    # What blocks and pivots have left apart.
    now = large.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = now.groupBy("band", "component").agg(F.count("*").alias("n"))
    top = parts.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).filter("parts > 1")
    top = top.select("band", F.col("top.component").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("chunks"))
    apart = cut(now.join(top, "band"))
    if not apart.isEmpty():
        chunk = F.pmod(F.xxhash64("rep", F.lit(2)), "chunks")
        grid = lambda row, col: row * F.col("blocks") + col
        all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        cols = ["band", "tile", "side", "rep", "component"]
        ours = apart.filter("component <> top").withColumn("_c", all_).withColumn("tile", grid(chunk, F.col("_c"))).withColumn("side", F.lit(0).cast("long")).select(cols)
        theirs = apart.withColumn("_r", every).withColumn("tile", grid(F.col("_r"), tile)).withColumn("side", F.lit(1).cast("long")).select(cols)
        met = cut(meetings(ours.union(theirs), draws))
        more = components(cut(links_of(met, draws, docs, shingler, similar)))
        classes = classes.join(more.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
        whole = classes.select("node", F.coalesce("_to", "component").alias("component"))
        lone = more.join(classes.select("node"), "node", "left_anti")
        classes = whole.union(lone.select("node", "component"))
    # One key more than the grouping's, always equal: the join gets exchanges of its own, so that the planner can split a frequent text.
    named = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.octet_length("same").alias("_l"), F.coalesce("component", "rep").alias("class_id"))
    rows = signed.select("doc_id", "same", F.coalesce(F.octet_length("same"), F.lit(0)).alias("_l"))
    out = rows.join(named, ["same", "_l"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).distinct()
    tidy(docs.sparkSession)
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each class, that with the smallest key.  Rows with a null key stay, as do all rows with one key; null texts
    stay, of empty ones one stays.  Other columns stay as they are.  An empty table stays empty."""
    gone = near_duplicates(docs, text, key).filter("not kept").select(F.col("doc_id").alias(key))
    return docs.join(gone, key, "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
