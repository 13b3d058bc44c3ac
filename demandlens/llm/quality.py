"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.llm.common import id_remainder, written

#: Hash bits of an n-gram; labelled rows and n-grams of theirs that the linear model is fitted on at most (the bounds of the sample);
#: regularisation; passes; score from which a text is accepted.
BITS, SAMPLE, SAMPLE_GRAMS, COST, EPOCHS, ACCEPT = 18, 8000, 24_000_000, 0.3, 12, 0.7
CHARS, SHAPES = (2, 3, 4), (1, 2, 3, 4)
ODD = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def _hashed(codes: np.ndarray, n: int, salt: int, bits: int) -> np.ndarray:
    h = np.full(codes.size - n + 1, salt, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : codes.size - n + 1 + k]) * ODD[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def shapes(text: str) -> np.ndarray:
    """A code for each word: how it is written, and whether it repeats the word before it or any earlier one; line ends count as words."""
    out, seen, before = [], set(), None
    for line in text.split("\n"):
        key = line.strip()
        out.append(1 if len(key) > 20 and key in seen else 0)
        seen.add(key)
        for w in line.split():
            core = w.strip(".,;:!?()\"'")
            if not core:
                shape = 2
            elif core.isalpha():
                shape = 3 if core.islower() else 4 if core.isupper() and len(core) > 1 else 5 if core[0].isupper() and (len(core) == 1 or core[1:].islower()) else 6
            elif core.isdigit():
                shape = 7
            else:
                shape = 8 if any(c.isdigit() for c in core) else 9
            out.append(16 + shape * 8 + (4 if w == before else 0) + (2 if w[-1:] == "!" else 1 if w[-1:] in ".,;:?" else 0))
            before = w
    return np.array(out, np.uint32)


def grams(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams of characters and of word shapes that a whole text has, ascending and without repeats; a bias is always among them."""
    text = text or ""
    seen = np.zeros(1 << bits, np.bool_)
    seen[0] = True
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for n in CHARS:
        if codes.size >= n:
            seen[_hashed(codes, n, n, bits)] = True
    words = shapes(text)
    for n in SHAPES:
        if words.size >= n:
            seen[_hashed(words, n, 100 + n, bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss model over scaled indicator rows of unit length, by dual coordinate descent."""
    w = np.zeros(len(scale))
    values = [scale[r] / max(1e-12, float(np.linalg.norm(scale[r]))) for r in rows]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            g = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - g, 0.0), cost[i])  # rows have length one, so the step needs no division
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
    return w


def margins(rows: list[np.ndarray], weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for i, r in enumerate(rows):
        s = scale[r]
        out[i] = float(weights[r] @ s) / max(1e-12, float(np.linalg.norm(s)))
    return out


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of the margin, the two classes weighted alike."""
    a, b = 1.0, 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    t = (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p)
        grad = np.array([(g * m).sum() + 1e-2 * a, g.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-2, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: tuple[int, int] = (4, 2), sample: int = SAMPLE, bits: int = BITS, sample_grams: int = SAMPLE_GRAMS) -> dict | None:
    """Model from labelled rows whose crc32(id) modulo held[0] is not held[1]; None if they do not have both labels.

    The model is fitted on whole texts of at most sample labelled rows that have at most sample_grams n-grams by their lengths, those with
    the least hash of id and text, each of several equal rows once. So what the driver gets is bounded in rows and in bytes.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (id_remainder(F.col(id_col), held[0]) != held[1])).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    share = min(1.0, 2 * sample / max(1, known.count()))
    likely = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    text = F.col(text_col).cast("string")
    # about twice the sample's rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(likely), "id").withColumn("mark", F.xxhash64("id", "text"))
    grams_most = F.least(F.lit(1 << bits), (len(CHARS) + len(SHAPES)) * F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long")
    least = rows.select("mark", "y", grams_most.alias("grams")).distinct().orderBy(F.pmod("mark", F.lit(1 << 40)), "mark").limit(sample).withColumn("order", F.pmod("mark", F.lit(1 << 40)))
    chosen = least.withColumn("upto", F.sum("grams").over(W.orderBy("order", "mark"))).where(F.col("upto") <= sample_grams)  # a window over at most sample rows
    chosen = written(chosen.select("mark"), "chosen")

    def run(batches):
        seen = set()
        for b in batches:
            new = [i for i, m in enumerate(b.column(0).to_pylist()) if m not in seen and not seen.add(m)]
            b = b.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([grams(t.as_py(), bits) for t in b.column(2)], pa.list_(pa.int32()))], ["mark", "y", "grams"])

    # bounded: at most sample rows of one number
    texts = rows.join(F.broadcast(chosen), "mark").select("mark", "y", "text")
    found = texts.mapInArrow(run, "mark long, y int, grams array<int>").groupBy("mark").agg(F.first("y").alias("y"), F.first("grams").alias("grams")).toArrow()
    order = np.argsort(found.column("mark").to_numpy(), kind="stable")
    y = np.where(found.column("y").to_numpy()[order] > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return None
    lists = found.column("grams").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    base = offsets[0]
    x = [flat[offsets[i] - base : offsets[i + 1] - base] for i in order]
    counts = [np.bincount(np.concatenate([r for r, v in zip(x, y, strict=True) if v == c]), minlength=1 << bits) for c in (1.0, -1.0)]
    pos, neg = counts[0] + 1.0, counts[1] + 1.0
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    ratio[counts[0] + counts[1] < 3] = 0  # too rare to tell
    ratio[0] = 0.5
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * COST
    folds = np.arange(len(y)) % 3
    out = np.zeros(len(y))
    for f in range(3):  # margins of rows that the fold's model has not seen, for the curve
        inside = np.flatnonzero(folds != f)
        w = descend([x[i] for i in inside], y[inside], ratio, cost[inside], 5)
        outside = np.flatnonzero(folds == f)
        out[outside] = margins([x[i] for i in outside], w, ratio)
    w = descend(x, y, ratio, cost)
    slope, offset = _logistic(out, y)
    # the margin where both classes are equally likely gets the score at which a text is accepted
    return {"bits": bits, "weights": (w).astype(np.float32), "ratio": ratio.astype(np.float32), "slope": slope, "offset": offset + float(np.log(ACCEPT / (1 - ACCEPT)))}


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: tuple[int, int] = (4, 2), accept: float = ACCEPT) -> DataFrame:
    """Quality of every row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= accept).

    Null texts count as empty and get the score that the bias gives. Repeated rows stay; null ids are never learned; of several labels
    of one id the largest counts. Without labels of both kinds every score is 0.5. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col, held)
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = packed.value
        for b in batches:
            if m is None:
                s = np.full(b.num_rows, 0.5)
            else:
                weights, ratio, s = m["weights"], m["ratio"], np.zeros(b.num_rows)
                for i, t in enumerate(b.column(1)):
                    s[i] = margins([grams(t.as_py(), m["bits"])], weights, ratio)[0]
                s = 1 / (1 + np.exp(-np.clip(m["slope"] * s + m["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", (id_remainder(F.col("doc_id"), held[0]) == held[1]).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
