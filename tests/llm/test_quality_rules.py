import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from demandlens.llm import robust_rules


def slow(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered, seen, dup = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_statistics(spark):
    random.seed(8)
    texts = ["", " \n ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é😀 #\n\n \n#\n#"] + ["".join(random.choice(["a ", "b ", "cé ", "\n", "#", "\t", "a b c "]) for _ in range(random.choice([3, 50, 400]))) for _ in range(150)] + ["Te " * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in robust_rules.base_statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow(texts[r.doc_id]), texts[r.doc_id][:200]


def far(x, mean, covariance):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(covariance), x - mean)


def slow_estimate(x, firsts):
    """Reweighted minimum covariance determinant of the rows x from given (mean, covariance) of starts, with numpy."""
    floors = np.diag(np.square(robust_rules.FLOORS))
    states = [(np.linalg.slogdet(c + floors)[1], k, m, c, True) for k, (m, c) in enumerate(firsts)]

    def step(state):
        depth, k, m, c, _ = state
        bins = np.floor(np.log(far(x, m, c + floors) + 1e-9) / robust_rules.LOG_BIN)
        limit = min(b for b in set(bins) if (bins <= b).sum() >= robust_rules.CORE * len(x))
        near = x[bins <= limit]
        new = near.mean(axis=0), np.cov(near.T, bias=True)
        now = np.linalg.slogdet(new[1] + floors)[1]
        return (now, k, *new, True) if now < depth - 1e-9 else (depth, k, m, c, False)

    for _ in range(robust_rules.FIRST_STEPS):
        states = [step(s) for s in states]
    states = sorted(states, key=lambda s: s[:2])[: robust_rules.FINALISTS]
    while any(s[4] for s in states):
        states = [step(s) for s in states]
    _, _, m, c, _ = min(states, key=lambda s: s[:2])
    near = x[far(x, m, c * robust_rules.consistency(robust_rules.CORE) + floors) <= 11.143287]
    return near.mean(axis=0), np.cov(near.T, bias=True) * robust_rules.consistency(robust_rules.REWEIGHT)


def test_estimates_are_those_of_numpy(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(6):
        n = (400, 150, 37, 12, 4, 1)[g]
        spread = rng.normal(size=(4, 4)) * [0.3, 0.2, 0.5, 0.4]
        rows += [(str(g), *map(float, x)) for x in rng.normal(size=(n, 4)) @ spread + 2]
        rows += [(str(g), 1.9, 9.2, 0.1, float(k % 2)) for k in range(n // 6)]  # a far cluster that would bend a plain estimate
    rows += [("same", 1.0, 0.0, 0.0, 0.0)] * 50
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double").repartition(3)

    def moments(r):
        c = np.zeros((4, 4))
        for i, j in robust_rules.ROOT:
            c[i, j] = c[j, i] = r[f"c{i}{j}"]
        return np.array([r[f"m{i}"] for i in range(4)]), c

    firsts = {}
    for r in sorted(robust_rules._starts(df, "g", robust_rules.STARTS)[0].collect(), key=lambda r: r.start):
        firsts.setdefault(r.g, []).append(moments(r))
    found = {r.g: r for r in robust_rules.robust_estimates(df, "g")[0].collect()}
    assert set(found) == {r[0] for r in rows} and found["0"].n == 466
    for g, r in found.items():
        x = np.array([v[1:] for v in rows if v[0] == g])
        want, got = slow_estimate(x, firsts[g]), moments(r)
        assert np.allclose(got[0], want[0], atol=1e-6) and np.allclose(got[1], want[1], atol=1e-6), g
    assert abs(found["0"].m1 - 2) < 0.3  # the far cluster does not count


def test_factors():
    assert abs(robust_rules.chi_squared_point(0.999, 4) - 18.467) < 1e-3 and abs(robust_rules.chi_squared_point(0.975, 4) - 11.143) < 1e-3
    x = np.random.default_rng(1).normal(size=(200_000, 4))
    d = (x**2).sum(axis=1)
    near = x[d <= np.quantile(d, 0.75)]
    assert abs(near.var() * robust_rules.consistency(0.75) - 1) < 0.01


def test_each_statistic_alone_can_reject():
    for k, most in ((1, 100.0), (2, 20.0), (3, 50.0)):
        assert (np.log1p(most) / robust_rules.FLOORS[k]) ** 2 > robust_rules.CUTOFF


def test_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = robust_rules.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = found.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("double")).alias("a")).first()["a"]
    bad = found.where("quality = 0").agg(F.avg(F.col("kept").cast("double")).alias("a")).first()["a"]
    assert good > 0.99 and bad < 0.05
    plan = robust_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd_documents, no_documents):
    rows = {(r.doc_id, r.kept) for r in robust_rules.judge(odd_documents).collect()}
    assert (3, False) in rows and (4, False) in rows and robust_rules.judge(odd_documents).count() == 11
    assert robust_rules.judge(no_documents).count() == 0
