"""Cross-entropy difference (Moore and Lewis 2010): documents scored by two n-gram models over one vocabulary.

Target: documents labelled as good.  Background: all documents.  Both models are bigram models with a Dirichlet prior (MacKay and Peto 1995)
over the same words and bigrams, which are all that the documents hold, each counted exactly: the models grow with the input and are never in
one place.  A document is scored by what the others hold: its own counts are taken off first, from the target's only if it is good.

Documents are packed and dealt into blocks by their key.  A block asks for each of its different words and bigrams once, with its own counts,
as sorted 64-bit hashes in one row for each bucket of hashes; a bucket adds up and answers each row with its counts in the same
order.  So a very common bigram is one entry of a block, and the shuffle holds about six bytes for a word of text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import WordTable, read, shared_folder, slices, word_hash

#: The prior's weight, in tokens after a word.
PRIOR = 4.0
#: About so many letters are a block, and so many blocks' entries a bucket.
LETTERS, BLOCKS = 3 << 20, 2
#: Rows of a block, in this order: answers, marks of good keys, documents.
ANSWER, MARK, DOCUMENT = range(3)
RESULTS = ["n_tokens", "ce_target", "ce_background", "ce_diff"]


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, by planes of bytes."""
    import zstandard

    return zstandard.ZstdCompressor().compress(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(batches, key: str) -> Iterator:
    """Tables of the rows with one value of key, by which the batches are sorted."""
    import pyarrow as pa

    held, now = [], None
    for b in batches:
        ids = b.column(key).to_numpy()
        start = 0
        for end in [*(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]:
            if start == end:
                continue
            if held and ids[start] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = ids[start]
            held.append(b.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """A block's documents: their tokens one after the other, as places among its words, and its keys, which are its words and then its bigrams."""

    def __init__(self, rows, table: WordTable):
        import zstandard

        kinds = rows.column("kind").to_numpy()
        first, last = np.searchsorted(kinds, [MARK, DOCUMENT])
        self.id = rows.column("block")[0].as_py()
        self.answers, self.docs = rows.slice(0, first), rows.slice(last)
        marked = set(rows.slice(first, last - first).column("key").to_pylist())
        self.good = np.array([k is not None and k in marked for k in self.docs.column("key").to_pylist()], bool)
        texts = zstandard.ZstdDecompressor()
        parts = [np.fromiter((table[w] for w in texts.decompress(t).decode("utf-8", "surrogatepass").split("\n") if w), np.uint64) for t in self.docs.column("data").to_pylist()]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.doc = np.repeat(np.arange(len(parts)), self.lengths)
        words, self.word = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True)
        # Places of a bigram's second word, and the number of each bigram among the block's different ones.
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        self.n_words = n = max(1, len(words))
        pairs, self.pair = np.unique(self.word[self.second - 1] * n + self.word[self.second], return_inverse=True)
        one = mixed(words)
        two = mixed(one[pairs // n] * np.uint64(0x9E3779B97F4A7C15) + words[pairs % n]) if len(pairs) else np.zeros(0, np.uint64)
        # The last bit tells words from bigrams.
        self.keys = np.concatenate([one & ~np.uint64(1), two | np.uint64(1)])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: how often in all the block's documents, and in the good ones."""
        n = len(self.keys)
        v = n - (int(self.pair.max()) + 1 if len(self.pair) else 0)
        of, good = np.concatenate([self.word, self.pair + v]), self.good[np.concatenate([self.doc, self.doc[self.second]])]
        return np.bincount(of, minlength=n), np.bincount(of[good], minlength=n)

    def losses(self, background: np.ndarray, target: np.ndarray, totals: np.ndarray, vocabulary: int) -> np.ndarray:
        """Mean loss of each document by target and background.  background, target: all documents' counts of each key."""
        v = len(self.keys) - (int(self.pair.max()) + 1 if len(self.pair) else 0)

        def own(doc, of, n):
            _, at, times = np.unique(doc * max(1, n) + of, return_inverse=True, return_counts=True)
            return times[at]

        one, two = own(self.doc, self.word, v), own(self.doc[self.second], self.pair, len(self.keys) - v)
        out = []
        for n, total, off in ((target, totals[1], self.good), (background, totals[0], np.ones(len(self.good), bool))):
            single = n[self.word] - one * off[self.doc]
            p = (single + 1) / ((total - self.lengths * off)[self.doc] + vocabulary)
            p[self.second] = (n[v + self.pair] - two * off[self.doc[self.second]] + PRIOR * p[self.second]) / (single[self.second - 1] + PRIOR)
            out.append(np.bincount(self.doc, -np.log(p), len(self.lengths)) / np.maximum(1, self.lengths))
        return np.stack(out)


def score(docs: DataFrame, good: DataFrame, text: str = "text", key: str = "doc_id", letters: int = LETTERS) -> DataFrame:
    """docs without text, with n_tokens, ce_target, ce_background and ce_diff (target minus background, in nats for a token).

    good (key): the target's documents; without any, the target's model is uniform.  letters: of a block, about.  Whole texts, of any length; a
    block's documents are held together, and rows with one key are in one block (a null key's are dealt by their texts).  A null or empty text has
    no tokens and null losses.  Repeated rows are documents of their own, all good if their key is; a null key is never good.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    fields = [f for f in docs.schema.fields if f.name != text]
    blocks = max(1, (docs.agg(F.sum(F.length(text))).first()[0] or 0) // letters)
    buckets = max(1, blocks // BLOCKS)

    def dealt(*of):
        return F.pmod(F.xxhash64(*of), F.lit(blocks)).cast("long").alias("block")

    # Labels grow with the documents, so their marks are dealt as the documents are.
    kind = docs.schema[key].dataType
    marks = good.select(F.col(key).cast(kind).alias("key")).filter("key is not null").distinct().select(dealt("key"), F.lit(MARK).alias("kind"), "key")
    plain = docs.select(
        F.when(F.col(key).isNull(), dealt(text)).otherwise(dealt(key)).alias("block"), F.lit(DOCUMENT).alias("kind"), F.col(key).alias("key"),
        F.struct(*(F.col(f.name) for f in fields)).alias("kept"), F.col(text).cast("string").alias("data"),
    )

    def squeeze(batches):
        import zstandard

        z = zstandard.ZstdCompressor()
        for b in slices(batches):
            data = pa.array([z.compress("\n".join(words_of(t)).encode("utf-8", "surrogatepass")) for t in b.column("data").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], data], b.schema.names)

    packed = plain.mapInArrow(squeeze, StructType([*plain.schema.fields[:-1], *StructType.fromDDL("data binary").fields]))

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition("block").sortWithinPartitions("block", "kind")

    def ask(batches):
        table = WordTable(word_hash)
        for rows in runs(batches, "block"):
            block = Block(rows, table)
            keys = block.keys[block.order]
            own, target = (c[block.order] for c in block.counts())
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            ends = [*(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
            start = 0
            for end in ends if len(keys) else []:
                part = slice(start, end)
                yield pa.RecordBatch.from_pydict(
                    {"bucket": [int(bucket[start])], "block": [block.id], "keys": [pack(np.diff(keys[part], prepend=np.uint64(0)))], "own": [pack(own[part])], "target": [pack(target[part])]},
                    schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "own", "target"))]),
                )
                start = end

    asked = by_block(packed.drop("kept").unionByName(marks, allowMissingColumns=True)).mapInArrow(ask, "bucket long, block long, keys binary, own binary, target binary")

    def answer(batches):
        schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("background", pa.binary()), ("target", pa.binary()), ("words", pa.int64()), ("sum", pa.int64()), ("good", pa.int64())])
        for rows in runs(batches, "bucket"):
            parts = [np.cumsum(unpack(k)) for k in rows.column("keys").to_pylist()]
            keys = np.unique(np.concatenate(parts))
            sums = np.zeros((2, len(keys)), np.int64)
            for k, part in enumerate(parts):
                at = np.searchsorted(keys, part)
                for m, c in enumerate(("own", "target")):
                    np.add.at(sums[m], at, unpack(rows.column(c)[k].as_py()).astype(np.int64))
            word = keys & np.uint64(1) == 0
            bucket, ids = rows.column("bucket")[0].as_py(), rows.column("block").to_pylist()
            del rows
            yield pa.RecordBatch.from_pylist([{"words": int(word.sum()), "sum": int(sums[0][word].sum()), "good": int(sums[1][word].sum())}], schema)
            for block, part in zip(ids, parts, strict=True):
                at = np.searchsorted(keys, part)
                yield pa.RecordBatch.from_pylist([{"block": block, "n": bucket, "background": pack(sums[0][at]), "target": pack(sums[1][at])}], schema)

    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(answer, "block long, n long, background binary, target binary, words long, sum long, good long")
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    answers.write.parquet(folder)
    answers = spark.read.schema(answers.schema).parquet(folder)
    totals = answers.agg(F.sum("sum"), F.sum("good"), F.sum("words")).first()
    total, vocabulary = np.array([totals[0] or 0, totals[1] or 0], float), max(1, totals[2] or 0)
    replies = answers.filter("block is not null").select("block", F.lit(ANSWER).alias("kind"), "n", "background", "target")
    stream = packed.unionByName(marks, allowMissingColumns=True).unionByName(replies, allowMissingColumns=True)

    def run(batches):
        table = WordTable(word_hash)
        for rows in runs(batches, "block"):
            block = Block(rows, table)
            if not len(block.docs):
                continue
            turn = np.argsort(block.answers.column("n").to_numpy())
            counts = np.zeros((2, len(block.keys)))
            for m, c in enumerate(("background", "target")):
                data = block.answers.column(c).to_pylist()
                counts[m, block.order] = np.concatenate([*(unpack(data[k]) for k in turn), np.zeros(0, np.uint64)])
            loss, empty = block.losses(*counts, total, vocabulary), block.lengths == 0
            kept = pa.concat_arrays(block.docs.column("kept").chunks).flatten()
            cols = [pa.array(block.lengths), *(pa.array(x, mask=empty) for x in (*loss, loss[0] - loss[1]))]
            yield pa.RecordBatch.from_arrays([*kept, *cols], [*(f.name for f in fields), *RESULTS])

    return by_block(stream).mapInArrow(run, StructType([*fields, *(StructField(c, DoubleType() if k else LongType()) for k, c in enumerate(RESULTS))]))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").filter("quality = 1"))
