"""Personal data in texts: regular expressions propose spans, checksums confirm them, context words adjust the score. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_DIGIT, BYTE = "[^0-9]", "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, NOT_DIGIT, "")


def luhn(m: Column) -> Column:
    """Whether the digits of m have a Luhn sum that ten divides."""
    r = F.reverse(digits(m))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether m, its first four signs moved to the end and letters counted from 10 on, is 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(total: Column, i: Column) -> Column:
        code = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(code < 58, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """What to look for. sign: a text without it has no match. shortest: code points of the shortest match. base: kept whatever the score."""

    name: str
    pattern: str
    sign: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    shortest: int
    checked: bool = False
    context: str = "^\\b$"
    prior: float = 0.6
    base: bool = True


#: The patterns match what plain greedy ones do from left to right; possessive steps and look-behind keep them linear on long runs.
KINDS = (
    Kind("email", "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 5, context="(?i)mail|contact|kontakt|correo|courriel"),
    Kind("ip", "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}", lambda t: t.rlike("[0-9]\\.[0-9]"), lambda m: m.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"), 7, context="(?i)\\bip\\b|host|server|address"),
    Kind("card", "[0-9](?:[ -]?[0-9])++", lambda t: t.rlike("[0-9][0-9 -]{12}"), lambda m: F.length(digits(m)).between(14, 19) & luhn(m), 14, True, "(?i)card|visa|karte|carte|tarjeta"),
    Kind("phone", "\\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(digits(m)).between(10, 15), 11, context="(?i)phone|tel|call|mobil"),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z][A-Z][0-9][0-9] ?[A-Z0-9]{4}"), mod97, 12, True, "(?i)iban|account|konto|compte|cuenta", 0.4, False),
    Kind("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9][0-9]-[0-9]"), lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 11, context="(?i)ssn|social security", prior=0.2, base=False),
)
#: Words near a match that speak against its being personal data.
AGAINST = "(?i)\\b(?:order|invoice|part|serial|isbn|sku|version|example|sample|test|tracking|checksum)\\b"
#: Least score of a span that is not of a base kind; what a confirmed checksum and a context word add; what a word against it takes; code
#: points of context on either side.
THRESHOLD, CHECKED, CONTEXT, DOUBT, NEAR = 0.5, 0.35, 0.35, 0.35, 40


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b, block: int = 64) -> Column:
    """Running totals (or what join makes) of a non-empty array of longs of at least zero, in blocks so that the work stays near its length."""
    zero = F.array(F.lit(0).cast("long"))

    def scan(a: Column) -> Column:
        return F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    count = F.ceil(F.size(values) / block).cast("int")
    local = F.transform(F.sequence(F.lit(1), count), lambda b: scan(F.slice(values, (b - 1) * block + 1, F.lit(block))))
    sums = scan(F.transform(local, lambda part: F.element_at(part, -1)))
    lifted = F.transform(F.arrays_zip(local.alias("part"), sums.alias("sum")), lambda z: F.transform(F.coalesce(F.slice(z["part"], 2, block), F.array().cast("array<bigint>")), lambda v: join(v, z["sum"])))
    return F.flatten(lifted)


def _matches(df: DataFrame, kind: Kind) -> DataFrame:
    """df with an array column of the kind's name: its spans (start, end, kind, rank, score, text) in order.

    The context of a match is what stands within NEAR code points of it on either side. It is put together from the gaps between the
    kind's matches and as many of these as can stand that near, so that no text is cut once for each match.
    """
    pattern, found, gaps, ends, back, ahead = F.lit(kind.pattern), *(f"_{kind.name}_{n}" for n in ("found", "gaps", "ends", "back", "ahead"))
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(kind.sign(F.col("_text")), F.regexp_extract_all("_text", pattern, 0)).otherwise(none))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, F.split("_text", kind.pattern, -1)).otherwise(none))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(found), lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    df = df.withColumn(ends, F.when(some, running(steps)).otherwise(F.array().cast("array<bigint>")))
    before = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(found), lambda g, m: F.concat(F.right(g, F.lit(NEAR)), m))
    after = F.zip_with(F.col(found), F.slice(gaps, F.lit(2), F.size(found)), lambda m, g: F.concat(m, F.left(g, F.lit(NEAR))))
    df = df.withColumn(back, F.when(some, before).otherwise(none)).withColumn(ahead, F.when(some, after).otherwise(none))
    zipped = F.arrays_zip(F.col(found).alias("m"), F.col(ends).alias("e"), F.col(back).alias("b"), F.col(ahead).alias("a"))
    most = -(-NEAR // kind.shortest)

    def span(z: Column, i: Column) -> Column:
        # i counts from zero, places in arrays from one
        own_gap = F.left(z["b"], F.length(z["b"]) - F.length(z["m"]))
        earlier = F.right(F.concat(F.array_join(F.slice(F.col(back), F.greatest(i - most + 1, F.lit(1)), F.least(i, F.lit(most))), ""), own_gap), F.lit(NEAR))
        next_gap = F.right(z["a"], F.length(z["a"]) - F.length(z["m"]))
        later = F.left(F.concat(next_gap, F.array_join(F.slice(F.col(ahead), i + 2, F.lit(most)), "")), F.lit(NEAR))
        score = F.lit(kind.prior + CHECKED * kind.checked) + F.when(earlier.rlike(kind.context) | later.rlike(kind.context), CONTEXT).otherwise(0.0) - F.when(earlier.rlike(AGAINST) | later.rlike(AGAINST), DOUBT).otherwise(0.0)
        return F.struct(
            (z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), F.lit(kind.name).alias("kind"), F.lit([k.name for k in KINDS].index(kind.name)).alias("rank"),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"), z["m"].alias("text"),
        )

    kept = F.filter(F.transform(zipped, lambda z, i: F.when(kind.valid(z["m"]), span(z, i))), lambda s: s.isNotNull())
    if not kind.base:
        kept = F.filter(kept, lambda s: s["score"] >= THRESHOLD)
    return df.withColumn(kind.name, F.when(some, kept).otherwise(F.filter(kept, lambda s: F.lit(False)))).drop(found, gaps, ends, back, ahead)


def spans(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, out: str = "spans") -> DataFrame:
    """docs with one more column, out: array of (start, end, kind, rank, score, text) by start, then kind.

    Places count code points, the end is exclusive. Matches of one kind never overlap; matches of two kinds may. A score is what the kind
    starts with, more by a confirmed checksum and by a word of its context near the match, less by a word against it; a span that is not
    of a base kind needs a score of THRESHOLD. Null and empty texts have no spans. Every row stays as it was, repeated ones too, whatever
    its columns are called; a column named out is replaced. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c != out]
    df = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own]).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    for kind in kinds:
        df = _matches(df, kind)
    joined = F.concat(*[F.col(k.name) for k in kinds])
    every = F.array_sort(joined, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"]))
    return df.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], F.when(F.size(joined) > 1, every).otherwise(joined).alias(out))


def written_spans(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the counts of base kinds, base_sha256, spans as text, and the scores of these in their order."""
    base = [k.name for k in KINDS if k.base]
    found = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, base), F.sha2(written_spans(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def mask(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets; overlapping spans become one, named by the first.

    chars_col, if given, gets the new text's code points. Texts without spans, null ones too, and other columns stay as they were,
    whatever they are called; repeated rows stay; an empty table gives no rows.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = spans(row, "text")
    # a span begins a replaced stretch if it starts where all earlier ones have ended
    found = found.withColumn("ends", F.when(F.size("spans") > 0, running(F.transform("spans", lambda s: s["end"]), F.greatest)).otherwise(F.array().cast("array<bigint>")))

    def piece(s: Column, i: Column) -> Column:
        done = F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0)).cast("int")
        return F.when(s["start"] >= done, F.concat(F.substring("text", done + 1, (s["start"] - done).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    tail = F.substring("text", F.element_at("ends", -1).cast("int") + 1, F.length("text"))
    masked = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", piece), ""), tail)).otherwise(F.col("text"))
    found = found.withColumn("masked", masked)
    new = {text_col: F.col("masked")} | ({chars_col: F.length("masked").cast(dict(docs.dtypes)[chars_col])} if chars_col else {})
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
