"""Personal data: regular expressions propose, checksums confirm, context adjusts the score.

Native: DataFrame and SQL functions only.  A match's place comes from the text
between the matches (`split`) and the matches themselves (`regexp_extract_all`),
whose lengths in code points add up to the offsets; no shuffle is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read


@dataclass(frozen=True)
class Kind:
    """pattern: Java syntax, possessive where nothing that follows could give characters
    back, so that long runs neither recurse nor backtrack.  hint: LIKE pattern that every text
    with a match fits.  valid: SQL over `m`.  score, context: score alone, words that raise it."""

    name: str
    pattern: str
    hint: str
    valid: str
    score: float
    context: str
    least: float = 0.0


LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + if((length({d}) - i) % 2 = 1, "
    "2 * int(substr({d}, i, 1)) - if(int(substr({d}, i, 1)) > 4, 9, 0), int(substr({d}, i, 1)))) % 10 = 0"
)
DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: ISO 13616: the first four characters go to the end, A is 10 and Z is 35, the number is 1 modulo 97.
MOD97 = (
    "aggregate(split(concat(substr({c}, 5), substr({c}, 1, 4)), '(?<=.)(?=.)'), 0, (a, x) -> "
    "if(x rlike '[0-9]', (a * 10 + int(x)) % 97, (a * 100 + ascii(x) - 55) % 97)) = 1"
)
LOCAL = "[A-Za-z0-9._%+-]"
PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: The base kinds in their listed order, then those that the method adds.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++", "%@%", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", "%.%.%.%", rf"m rlike '^{PART}(\\.{PART}){{3}}$'", 0.6, "ip|host|server|address"),
    Kind("card", r"[0-9]([ -]?[0-9])++", "%", f"if(length({DIGITS}) between 12 and 19, {LUHN.format(d=DIGITS)}, false)", 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "%+%", f"length({DIGITS}) between 9 and 15", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "%", MOD97.format(c="replace(m, ' ', '')"), 0.8, "iban|bank|account|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "%-%-%", r"not m rlike '^(000|666|9)|-00-|-0000$'", 0.3, "ssn|social|security|tax", 0.5),
)
BASE = tuple(k.name for k in KINDS[:4])
#: Code points before a match in which context words count.
CONTEXT = 40


def _running(lens: Column, block: int = 128) -> Column:
    """Running sums of an array, by blocks, so that no long array is copied for each element."""
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("t"))

    def sums(a: Column) -> Column:
        step = lambda s, x: F.struct(F.array_append(s["out"], s["t"] + x).alias("out"), (s["t"] + x).alias("t"))
        return F.aggregate(a, zero, step)["out"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / block).cast("int")), lambda b: F.slice(lens, b * block + 1, block))
    inner = F.transform(blocks, sums)
    before = F.transform(inner, lambda s: F.element_at(s, -1))
    shift = F.zip_with(sums(before), before, lambda t, own: t - own)
    return F.flatten(F.zip_with(inner, shift, lambda s, t: F.transform(s, lambda v: v + t)))


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with `spans` array<struct<start, rank, kind, end, score>>, sorted by start, then kind as listed.

    A null text counts as empty; an empty text has no spans.  Matches of one kind don't overlap,
    those of different kinds may.  Repeated rows give repeated results.  Other columns stay,
    whatever their names; a column `spans` is replaced.
    """
    own = fresh("_pii", docs)
    df = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    for k in kinds:
        pattern = F.lit(k.pattern)
        maybe = F.col(own).like(k.hint)
        df = df.withColumn(f"{own}_m_{k.name}", F.when(maybe, F.regexp_extract_all(own, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    for k in kinds:
        df = df.withColumn(f"{own}_p_{k.name}", F.when(F.size(f"{own}_m_{k.name}") > 0, F.split(own, k.pattern, -1)))
    for k in kinds:
        m, p = F.col(f"{own}_m_{k.name}"), F.col(f"{own}_p_{k.name}")
        ends = _running(F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: (F.char_length(a) + F.char_length(b)).cast("bigint")))
        rank = BASE.index(k.name) if k.name in BASE else len(BASE) + kinds.index(k)
        tail = lambda s: F.lower(F.expr(f"right(s.p, {CONTEXT})"))  # noqa: E731, F841
        found = F.arrays_zip(ends.alias("e"), m.alias("m"), F.slice(p, 1, F.size(m)).alias("p"))
        df = df.withColumn(f"{own}_f_{k.name}", F.when(F.size(m) > 0, found))
        df = df.withColumn(
            f"{own}_f_{k.name}",
            F.expr(
                f"coalesce(filter(transform({own}_f_{k.name}, s -> named_struct('start', s.e - char_length(s.m), 'rank', {rank}, 'kind', '{k.name}', 'end', s.e, "
                f"'score', least(1.0D, {k.score}D + if(lower(right(s.p, {CONTEXT})) rlike '\\\\b({k.context})', 0.3D, 0.0D)), "
                f"'ok', transform(array(s.m), m -> {k.valid})[0])), s -> s.ok and s.score >= {k.least}D), array())"
            ),
        )
    spans = F.array_sort(F.concat(*(F.col(f"{own}_f_{k.name}") for k in kinds)))
    return df.withColumn("spans", spans).drop(own, *(f"{own}_{x}_{k.name}" for x in "mpf" for k in kinds))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    line = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    base = f"filter(spans, s -> s.rank < {len(BASE)})"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2(concat_ws(',', {line.format(base)}), 256)").alias("base_sha256"),
        F.expr(f"concat_ws(',', {line.format('spans')})").alias("spans"),
        F.expr("coalesce(array_max(transform(spans, s -> s.score)), 0.0D)").alias("max_score"),
    )
