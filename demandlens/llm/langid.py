"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.llm.common import id_remainder, written

#: Longest n-gram, hash bits of an n-gram, landmarks and training rows for each language (the bounds of the sample), ridge, least eigenvalue.
NGRAM, BITS, LANDMARKS, TRAIN, RIDGE, CUT = 4, 15, 16, 600, 1e-2, 1e-3
#: Languages that are learned; a worker holds 2 MB of landmarks for each.
LANGUAGES = 64
UNKNOWN = "und"
ODD = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 1274126177, 2971215073, 1640531527], np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of the Unicode categories for letters."""
    return any(map(str.isalpha, text or ""))


def spectrum(text: str | None, most: int = NGRAM, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams of 1 to most characters that a text has, ascending and without repeats: its blended-spectrum presence features."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(1 << bits, np.bool_)
    for n in range(1, most + 1):
        if codes.size < n:
            break
        h = np.full(codes.size - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : codes.size - n + 1 + k]) * ODD[k]
        seen[h >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


def _dense(features: list[np.ndarray], bits: int) -> np.ndarray:
    """Rows of unit length, so that their products are kernel values in [0, 1]."""
    x = np.zeros((len(features), 1 << bits), np.float32)
    for row, f in zip(x, features, strict=True):
        if len(f):
            row[f] = 1 / np.sqrt(len(f))
    return x


def solve(features: dict[str, list[np.ndarray]], landmarks: int = LANDMARKS, bits: int = BITS, ridge: float = RIDGE, cut: float = CUT) -> dict:
    """Model of each language's n-gram features: one-versus-rest kernel ridge regression in the space that the landmarks span.

    The first landmarks rows of each language are landmarks. Directions in which their kernel matrix has less than cut of its largest
    eigenvalue are left out. Each language counts alike, whatever its number of rows.
    """
    langs = sorted(features)
    marks = _dense([f for lang in langs for f in features[lang][:landmarks]], bits)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > cut * max(values.max(), 1e-9)
    root = vectors[:, good] / np.sqrt(values[good])
    gram, cross = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(langs)))
    for k, lang in enumerate(langs):
        z = _dense(features[lang], bits) @ marks.T @ root
        weight = 1 / max(1, len(z))
        y = -np.ones((len(z), len(langs)))
        y[:, k] = 1
        gram += weight * z.T @ z
        cross += weight * z.T @ y
    weights = np.linalg.solve(gram + ridge * np.eye(len(gram)), cross)
    return {"langs": langs, "bits": bits, "marks": (marks > 0), "norms": np.sqrt(np.maximum(1, (marks > 0).sum(axis=1))), "weights": root @ weights}


def values(found: list[np.ndarray], marks: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Regression values of a batch: n-gram presence by landmarks (as columns), then kernel values by weights."""
    return _dense(found, bits) @ marks @ weights


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: tuple[int, int] = (3, 1), landmarks: int = LANDMARKS, train: int = TRAIN, bits: int = BITS, ridge: float = RIDGE, languages: int = LANGUAGES) -> dict:
    """Model from the rows with a language whose crc32(id) modulo held[0] is not held[1].

    At most train rows of each language are used, those with the least hash of id and text, each of several equal rows once; the first
    landmarks of them serve as landmarks. The languages with the most rows are learned, at most languages of them, ties to the lesser name;
    texts in others get the learned language that is nearest. So the driver gets at most languages times train times 2^bits ids of n-grams,
    whatever the number of rows, of null ids, of copies or of values in the language column. Without labelled rows the model knows no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (id_remainder(F.col(id_col), held[0]) != held[1])).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.col(lang_col).cast("string")).alias("mark"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return {"langs": [], "bits": bits}
    # so many marks are enough in all likelihood; where many rows are equal fewer are left
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * train / n))])[F.col("lang")]
    likely = rows.where(F.pmod("mark", F.lit(1 << 40)) <= share * (1 << 40))  # a language that is not learned has no share
    order = F.pmod("mark", F.lit(1 << 40))
    chosen = written(likely.select("lang", "mark").distinct().withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(order, "mark"))).where(F.col("n") <= train).select("lang", "mark", "n"), "chosen")

    def run(batches):
        seen = set()
        for b in batches:
            new = [i for i, m in enumerate(b.column(1).to_pylist()) if m not in seen and not seen.add(m)]
            b = b.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([spectrum(t.as_py(), bits=bits) for t in b.column(3)], pa.list_(pa.int32()))], ["lang", "mark", "n", "grams"])

    # bounded: train rows of three numbers for each language
    texts = likely.join(F.broadcast(chosen), ["lang", "mark"]).select("lang", "mark", "n", "text")
    sample = texts.mapInArrow(run, "lang string, mark long, n int, grams array<int>").groupBy("lang", "n").agg(F.first("grams").alias("grams")).toArrow()
    features: dict[str, list[tuple[int, np.ndarray]]] = {}
    for lang, n, grams in zip(sample.column("lang").to_pylist(), sample.column("n").to_pylist(), sample.column("grams"), strict=True):
        features.setdefault(lang, []).append((n, grams.values.to_numpy()))
    return solve({lang: [g for _, g in sorted(found, key=lambda x: x[0])] for lang, found in features.items()}, landmarks, bits, ridge)


def annotate(docs: DataFrame, model: dict, lang_name: str, score_name: str, text_col: str = "text", batch: int = 64) -> DataFrame:
    """docs with two more columns: the language with the largest regression value and its score in [0, 1].

    The values come from batched matrix products: n-gram presence by landmarks, then kernel values by regression weights.
    A text that is null or has no letter is "und" with score 0, as is any text if the model knows no language.
    """
    packed = docs.sparkSession.sparkContext.broadcast({k: np.packbits(v, axis=1) if k == "marks" else v for k, v in model.items()})
    at = docs.columns.index(text_col)

    def run(batches):
        m = packed.value
        langs, bits = m["langs"], m["bits"]
        if langs:
            marks = np.unpackbits(m["marks"], axis=1, count=1 << bits).astype(np.float32) / m["norms"][:, None].astype(np.float32)
            marks, weights = np.ascontiguousarray(marks.T), m["weights"].astype(np.float32)
        for b in batches:
            texts = b.column(at).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            for k in range(0, len(lettered), batch):
                part = lettered[k : k + batch]
                f = values([spectrum(texts[i], bits=bits) for i in part], marks, weights, bits)
                best = f.argmax(axis=1)
                scores[part] = np.clip((f[np.arange(len(part)), best] + 1) / 2, 0, 1)
                for i, j in zip(part, best, strict=True):
                    names[i] = langs[j]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_name, score_name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: tuple[int, int] = (3, 1)) -> DataFrame:
    """Language of every row of docs: doc_id, held_out, lang_pred, score.

    Null and blank texts, digits and signs alone: "und". Null languages are never learned. Repeated rows stay, each with its own
    result; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, id_col, text_col, lang_col, held)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = annotate(rows, model, "lang_pred", "score")
    return found.select("doc_id", (id_remainder(F.col("doc_id"), held[0]) == held[1]).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that have no language ("und"); a null language gets the predicted one, all other values stay.

    Null, empty and letterless texts go, whatever their language column says. Repeated rows and rows with a null id stay, each judged by
    its own text; columns of any names keep their values and types; an empty table gives no rows. Without labelled rows to learn from,
    rows whose text has a letter stay as they are.
    """
    model = fit(docs, id_col, text_col, lang_col)
    if not model["langs"]:
        return docs.where(F.col(text_col).rlike("\\p{L}"))
    longest = max(docs.columns, key=len)  # names that are longer than all of the table's are none of them
    lang_name, score_name = f"{longest}_lang", f"{longest}_score"
    found = annotate(docs, model, lang_name, score_name, text_col)
    predicted = F.col(f"`{lang_name}`")
    lang = F.coalesce(F.col(lang_col).cast("string"), predicted).cast(docs.schema[lang_col].dataType).alias(lang_col)
    return found.where(predicted != UNKNOWN).select(*[lang if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
