"""Reading of written values: what is understood, and what must not be guessed."""

import hashlib
import re
from datetime import date

import pytest
import xxhash
from pyspark.sql import functions as F

from demandlens.functions import extract, normalize, similarity


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [
    ("15-25K", (15000, 25000, 20000, 240000, None, "parsed_monthly")), ("20-30K·13薪", (20000, 30000, 25000, 325000, 13, "parsed_monthly_with_months")), ("200-300元/天", (4350, 6525, 5437.5, 65250, 12, "parsed_daily")),
    ("20-30万/年", (200000 / 12, 300000 / 12, 250000 / 12, 250000, 12, "parsed_annual")), ("面议", (None, None, None, None, None, "negotiable")), (None, (None, None, None, None, None, "missing_at_source")), ("", (None, None, None, None, None, "missing_at_source")),
    ("30-20K", (None, None, None, None, None, "invalid_range")), ("0-0K", (None, None, None, None, None, "invalid_range")), ("15-25美元/月", (None, None, None, None, None, "unparseable")), ("随便写的薪资", (None, None, None, None, None, "unparseable")),
    ("9" * 400 + "-" + "9" * 401 + "K", (None, None, None, None, None, "invalid_range")), ("20-30k·30薪", (None, None, None, None, None, "invalid_range")), ("２０－３０Ｋ", (20000, 30000, 25000, 300000, None, "parsed_monthly")),
])
def test_salary(spark, raw, want):
    r = one(spark, lambda c: normalize.salary(c, compatible=True), raw)
    assert tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) == want


@pytest.mark.parametrize(("raw", "want"), [("3-5年", (3, 5, "mid", "parsed")), ("经验不限", (0, None, "no_requirement", "parsed")), ("应届生", (0, 0, "entry", "parsed")), ("5-3年", (None, None, None, "unparseable")), ("1年以内", (0, 1, "entry", "parsed")), ("10年以上", (10, None, "expert", "parsed")), ("2年", (2, 2, "junior", "parsed")), ("some", (None, None, None, "unparseable")), (None, (None, None, None, "missing_at_source"))])
def test_years(spark, raw, want):
    assert tuple(one(spark, normalize.years, raw)) == want


@pytest.mark.parametrize(("raw", "want"), [("2026-08-01", date(2026, 8, 1)), ("2026/08/01", date(2026, 8, 1)), ("2026.08.01", date(2026, 8, 1)), ("2026-08-01T10:00:00Z", date(2026, 8, 1)), ("2026-8", None), ("昨天", None), ("2026-13-01", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, lambda c: normalize.date(c)[0], raw) == want


def test_text_and_bands(spark):
    assert one(spark, lambda c: normalize.text(c, True), "  ＡＢＣ　科技（北京）有限公司  ") == "abc 科技(北京)有限公司"
    assert one(spark, lambda c: normalize.keyword_band(c)[0], "本科及以上") == "bachelor" and one(spark, lambda c: normalize.keyword_band(c)[0], "学历不限") == "no_requirement"
    assert one(spark, normalize.script, "数据 data 分析师岗位职责") == "zh" or one(spark, normalize.script, "数据 data") in ("mixed", "en")
    assert one(spark, normalize.masked, "a@b.co 13800138000 x") == "[EMAIL] [PHONE] x"


def test_longest_prefix(spark):
    aliases = spark.createDataFrame([("北京", "BJ"), ("北京海淀", "HD"), ("shanghai", "SH")], "alias string, code string")
    rows = spark.createDataFrame([("北京海淀区",), ("北京·朝阳",), ("Shanghai City",), ("未知",), (None,)], "v string")
    found = {r.v: (r.code, r.code_status) for r in normalize.longest_prefix(rows, "v", aliases, [2, 4, 8]).collect()}
    assert found == {"北京海淀区": ("HD", "parsed"), "北京·朝阳": ("BJ", "parsed"), "Shanghai City": ("SH", "parsed"), "未知": (None, "unparseable"), None: (None, "missing_at_source")}


def test_extraction_boundaries_and_ties(spark):
    catalogue = {"js": ("JS", ["JavaScript"]), "python": ("Python", ["py"]), "r": ("R", []), "bi": ("Power BI", ["BI"])}
    frame = spark.createDataFrame([(k, n, a) for k, (n, a) in catalogue.items()], "item string, name string, aliases array<string>")
    rules = extract.rules_frame(frame, spark.createDataFrame([("r", "(?i)(?<![A-Za-z0-9_])R(?=\\s*(?:语言|programming\\b))")], "item string, pattern string"))
    kinds = {(r.item, r.term): (r.method, r.confidence, r.rank, r.pattern is None) for r in rules.collect()}
    assert kinds["r", "R"] == ("rule_short_context", 0.9, 1, False) and kinds["js", "JS"] == ("rule_canonical", 0.98, 3, True) and kinds["python", "py"] == ("rule_alias", 0.95, 2, True) and len(kinds) == 7
    docs = spark.createDataFrame([(1, "Node.js and PYTHON, R语言"), (2, "R and D; Python3; py"), (3, "power bi 分析, BI"), (4, None), (5, "")], "id long, text string")
    found = {(r.id, r.item): (r.method, r.start, r.matched) for r in extract.token_matches(docs, rules, "id", "text").collect()}
    assert found == {(1, "python"): ("rule_canonical", 12, "PYTHON"), (1, "r"): ("rule_short_context", 20, "R"), (2, "python"): ("rule_alias", 18, "py"), (3, "bi"): ("rule_canonical", 0, "power bi")}


def test_similarity(spark):
    assert similarity.ratio("kitten", "sitting") == pytest.approx(100 * (1 - 5 / 13)) and similarity.ratio("", "") == 100 and similarity.ratio("a", "") == 0
    prints = {r.t: r.p for r in spark.createDataFrame([("ab",), ("the same words here and there",), ("the same words here and then",), (None,)], "t string").select("t", similarity.simhash(F.col("t")).alias("p")).collect()}
    assert prints["ab"] is None and prints[None] is None
    assert (prints["the same words here and there"] ^ prints["the same words here and then"]).bit_count() < 20


def test_rules_match_as_a_search_of_each_text_does(spark):
    catalogue = {"js": ("js", ["node.js"]), "cpp": ("C++", ["c plus plus"]), "dot": (".NET", []), "data": ("data analysis", ["analysis"]), "cn": ("数据", ["数据分析"]), "one": ("R", []), "q": ("a\\E|b", [])}
    texts = ["uses JS and node.js", "x.js", "C++, .net; Data  analysis", "data analysis and analysis", "做数据分析。", "R", "r2 R.", "a\\E|b", "", None, "c plus  plus", "plain", "DATA ANALYSIS c++x C++ y"]
    rows = [*enumerate(texts), (3, "another text with R under the same id")]
    rules = extract.rules_frame(spark.createDataFrame([(k, n, a) for k, (n, a) in catalogue.items()], "item string, name string, aliases array<string>"))
    want = {}
    for i, text in rows:
        for item, (name, aliases) in catalogue.items():
            for term, confidence, method in ((name, 0.98, "rule_canonical"), *((a, 0.95, "rule_alias") for a in aliases)):
                before = "A-Za-z0-9_." if term.lower() == "js" else "A-Za-z0-9_"
                if m := re.search(f"(?<![{before}]){re.escape(term)}(?![A-Za-z0-9_])", text or "", re.I):
                    found = ((confidence, -m.start(), len(term)), (i, item, method, confidence, m.start(), m.group()))
                    want[i, item] = max(want.get((i, item), found), found)
    got = {tuple(r) for r in extract.token_matches(spark.createDataFrame(rows, "i long, t string"), rules, "i", "t").collect()}
    assert got == {x for _, x in want.values()} and len(got) > 10


def test_compatible_forms_are_one(spark):
    assert one(spark, normalize.text, " Ｄａｔａ　Ａnalyst（Ｌ）① ") == "data analyst(l)1" and one(spark, normalize.text, "　") is None
    assert one(spark, lambda c: normalize.text(c, compatible=False), " Ａb  C ") == "ａb c"


def test_simhash_against_a_plain_count(spark):
    texts = ["ab", "abc", "wir suchen menschen", "é😀é😀é", "aaaaaa" * 20, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", similarity.simhash(F.col("t")).alias("h")).collect()
    for r in rows:
        t = texts[r.i]
        if t is None or len(t) < 3:
            assert r.h is None
            continue
        hashes = [xxhash.xxh64_intdigest(t[k : k + 3].encode(), 42) for k in range(len(t) - 2)]
        assert r.h % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))


def test_blake2b_prints_against_a_plain_count(spark):
    texts = ["the same words here and there", "aaaa", "数据分析师", "ab", "", None, "x" * 500 + "y"]

    def plain(text):
        grams = [text[i : i + 3].encode() for i in range(len(text or "") - 2)]
        hashes = [int.from_bytes(hashlib.blake2b(g, digest_size=8).digest(), "big") for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes)) if hashes else None

    found = {r.t: r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", similarity.simhash_udf()("t").alias("p")).collect()}
    assert {t: None if p is None else p & (1 << 64) - 1 for t, p in found.items()} == {t: plain(t) for t in texts}
