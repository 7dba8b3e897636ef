"""BPE encoding and decoding with a given vocabulary; nothing is trained here.

Encoding a word: an Aho-Corasick automaton over the tokens gives the longest token at
each place, and a backtracking walk keeps the tokens whose neighbours are compatible,
i.e. which the merges, in order of rank, would leave side by side.  Each place is left at
most once, so the walk is linear.  Decoding cuts the tokens' strings from one text by a
table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from .common import WordTable, read, slices, worker_state

SUFFIX = "</w>"
# Where the tables of the tokenizers library (0.23) and those of Python's modules (3.13, regex) are of different ages, found by comparing all code points.
#: Letters and numbers of regex that are neither to the library.
NO_LETTERS = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    r"\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Marks that its NFC takes for starters, as a younger Unicode made them marks; the last one is U+11930, which it doesn't put together with U+11935.
STARTERS = (
    r"\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab\U00010eac"
    r"\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839\U0001183a\U0001193d\U0001193e\U00011943"
    r"\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f"
    r"\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef\U00011930"
)
#: Capitals that it lowers and Python doesn't.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {k: k + 32 for k in range(0x10D50, 0x10D66)} | {k: k + 27 for k in range(0x16EA0, 0x16EB9)}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class WordBpe:
    """A vocabulary of byte-level pieces whose words end in a suffix.  spec: text of its JSON file."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        spec = json.loads(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        n = max(*vocab.values(), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        names = [""] * n
        for token, i in vocab.items():
            names[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            names[i] = token
        self.offsets, self.names = [0], "".join(names)
        for x in names:
            self.offsets.append(self.offsets[-1] + len(x))
        # A letter of the automaton is a byte's letter; the last one of a word is another letter.
        letters = byte_letters()
        self.letter = {b: x for b, x in enumerate(letters)}
        self.last = {x: chr(0x1000 + k) for k, x in enumerate(letters)}
        self.ends = {b: self.last[x] for b, x in enumerate(letters)}
        self.pairs = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self.rank = [0] * n  # symbols come before merges, merges in their order
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(n)]
        for k, (a, b) in enumerate(merges):
            self.rank[vocab[a + b]], self.parts[vocab[a + b]] = k + 1, (vocab[a], vocab[b])
        self.length = [0] * n
        self.automaton = ahocorasick.Automaton()
        by_word: dict[str, int] = {}
        for token, i in vocab.items():
            word = token.removesuffix(SUFFIX)
            if len(word) < len(token):
                word = word[:-1] + self.last[word[-1]]
            if all(self.parts[i][k] != i for k in (0, 1)) or len(word) == 1:
                by_word[word], self.length[i] = i, len(word)
                self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * n  # the longest token that a token begins with
        for word, i in by_word.items():
            self.shorter[i] = next((by_word[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in by_word), -1)
        self.fits = WordTable(self._fits, 200_000)
        self.words = WordTable(self._word_bytes)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        no = f"(?![{NO_LETTERS}])"
        self.split_odd = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:{no}\p{{L}})+|{no}\p{{N}}|(?:[^\s\p{{L}}\p{{N}}]|[{NO_LETTERS}])+").findall
        self.odd = regex.compile(f"[{NO_LETTERS}{STARTERS}\U00011938{''.join(map(chr, LOWER))}]").search
        self.cut_starters = regex.compile(f"(?=[{STARTERS}])|(?<=[{STARTERS}])|(\U00011938)").split
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda text: [text]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether no merge across the border of two neighbouring tokens comes before their own merges.

        The tokens are taken apart from the last merge on; at each step the pieces at the border must not
        have a merge of lower rank than the merges already taken apart.
        """
        left, right = pair
        most = (1 << 40, 0)  # merges before this one may not apply; at equal rank the left one comes first
        while True:
            whole = self.pairs.get((left, right))
            if whole is not None and (self.rank[whole], 0) < most:
                return False
            if self.rank[left] > self.rank[right]:
                most, left = (self.rank[left], 0), self.parts[left][1]
            elif self.rank[right]:
                most, right = (self.rank[right], 1), self.parts[right][0]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one word in bytes, as merging in order of rank leaves them."""
        if not word:
            return []
        letters = "".join([self.letter[b] for b in word[:-1]]) + self.ends[word[-1]]
        longest = [-1] * len(letters)
        length, shorter, fits = self.length, self.shorter, self.fits
        for end, token in self.automaton.iter(letters):
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while True:
            while token >= 0 and (at + length[token] in dead or (out and not fits[out[-1], token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == len(letters):
                    return out
                token = longest[at]
            else:  # nothing goes on from here
                dead.add(at)
                token = out.pop()
                at -= length[token]

    def _word_bytes(self, word: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.encode_word(word.encode("utf-8"))])

    def normal_odd(self, text: str) -> str:
        """NFC by the library's tables."""
        return "".join([x if x == "\U00011938" else unicodedata.normalize("NFC", x) for x in self.cut_starters(text) if x])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, words = [], self.words
        for part in self.cut_special(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                odd = not part.isascii() and self.odd(part)
                part = self.normal_odd(part) if odd else unicodedata.normalize("NFC", part)
                part = part.replace("\u03a3", "\u03c3").lower()
                out += [words[w] for w in (self.split_odd(part.translate(LOWER)) if odd else self.split(part))]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_bytes(text)).cast("I"))

    def decode(self, ids) -> str:
        """The tokens' strings with a blank between any two, as a vocabulary file without decoder asks for."""
        names, offsets = self.names, self.offsets
        return " ".join([names[offsets[i] : offsets[i + 1]] for i in ids])


def _load(spec: str) -> WordBpe:
    state, key = worker_state(), ("bpe", hashlib.sha256(spec.encode()).digest())
    if key not in state:
        state[key] = WordBpe(spec)
    return state[key]


def encode_docs(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with its text's token ids as array<int> `ids`, and `decoded` if a name is given.

    Whole texts; a null text counts as empty and an empty one has no ids.  Rows are independent of each
    other, so repeated rows give repeated results.  `ids` and `decoded` replace columns of these names.
    The vocabulary (one file of fixed size) goes to the executors with the function.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    docs = docs.drop(*(x for x in (ids, decoded) if x))
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [StructField(ids, ArrayType(IntegerType(), False))] + ([StructField(decoded, StringType())] if decoded else [])

    def run(batches):
        bpe = _load(spec.value)
        for b in slices(batches):
            raw = [bpe.encode_bytes(t or "") for t in b.column(text).to_pylist()]
            at = [0]
            for x in raw:
                at.append(at[-1] + len(x) // 4)
            flat = pa.Array.from_buffers(pa.int32(), at[-1], [None, pa.py_buffer(b"".join(raw))])
            columns = [*b.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)]
            if decoded:
                columns.append(pa.array([bpe.decode(memoryview(x).cast("I")) for x in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def token_digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; the texts stay in the worker."""
    import pyarrow as pa

    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = _load(spec.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            raw = [bpe.encode_bytes(t or "") for t in b.column(text).to_pylist()]
            back = (bpe.decode(memoryview(x).cast("I")) for x in raw)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(map(sha, raw)), pa.array([sha(x.encode("utf-8", "surrogatepass")) for x in back])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"))
