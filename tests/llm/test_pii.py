import hashlib
import random
import re

from demandlens.llm import pii


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def slow_base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group(0).split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[^0-9]", "", m.group(0))
        if 14 <= len(s) <= 19 and luhn(s):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group(0))) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(docs).collect():
        base = slow_base(texts[r.doc_id] or "")
        counts = [sum(x[2] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest(), texts[r.doc_id]
        assert {f"{k}:{s}:{e}" for s, _, k, e in base} <= set(r.spans.split(","))


def test_tables_and_edges(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, docs)
    check(spark, [None, "", "a@b.c-d@e.f", "a@b.c_d@e.f", "é😀x@y.zé 1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.02.3.255", "+1+1 2345678901 +12 (34) 567-89-01 x", "4111-1111-1111-1111 4111 1111 1111 1112", "a" * 50000, "1" * 30000, "9 " * 20000, "+1" + " 2" * 9000, ".@-." * 3000])


def test_random_strings(spark):
    random.seed(5)
    check(spark, ["".join(random.choice("aB.@_%+- 0123456789().é") for _ in range(120)) for _ in range(1500)])


def test_many_matches_in_one_text(spark):
    check(spark, [" ".join(f"u{i}@h{i}.org" for i in range(3000))])


def test_confirmed_kinds_and_masks(spark):
    docs = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789.", 5, "k"), (2, "IBAN DE89 3704 0044 0532 0130 01 and 123-45-6789", 5, "k"), (3, None, None, None), (4, "x@y.de +4930123456789", 1, "")], "doc_id long, text string, n_chars long, email string")
    rows = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert rows[1].spans == "iban:5:32,ssn:38:49" and rows[2].spans == ""
    masked = {r.doc_id: r for r in pii.mask(docs, "text", "n_chars").collect()}
    assert masked[1].text == "IBAN [IBAN], ssn [SSN]." and masked[2].text == "IBAN DE89 3704 0044 0532 0130 01 and 123-45-6789"
    assert masked[3].text is None and masked[4].text == "[EMAIL] [PHONE]" and masked[4].n_chars == 15 and masked[4].email == ""


def test_plan_is_native(spark, odd_documents, no_documents):
    plan = pii.digest(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.digest(odd_documents).count() == 11 and pii.digest(no_documents).count() == 0
    assert pii.mask(odd_documents).dtypes == odd_documents.dtypes


def slow_scores(t):
    """(kind, start, score) of all valid matches, with the context cut from the whole text."""
    out = []
    for kind in pii.KINDS[-2:]:
        for m in re.finditer(kind.pattern, t):
            v = m.group(0).replace(" ", "")
            if kind.name == "iban":
                ok = int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
            else:
                ok = not re.search("^(?:000|666|9)|-00-|-0000$", v)
            sides = t[max(0, m.start() - pii.NEAR) : m.start()], t[m.end() : m.end() + pii.NEAR]
            score = kind.prior + pii.CHECKED * kind.checked + pii.CONTEXT * any(re.search(kind.context, x) for x in sides) - pii.DOUBT * any(re.search(pii.AGAINST, x) for x in sides)
            if ok and score >= pii.THRESHOLD:
                out.append((m.start(), kind.name, round(min(1.0, max(0.0, score)), 2)))
    return sorted(out)


def test_context_on_both_sides(spark):
    random.seed(3)
    parts = ["123-45-6789", "001-01-0001", "666-12-1234", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "ssn", "SSN:", "social security", "iban", "account", "order", "invoice no", "x", "lorem ipsum dolor", ";", ". ", "é😀", "word " * 9]
    texts = ["ssn, 123-45-6789; 123-45-6780", "123-45-6789 is the ssn", "order 123-45-6789 ssn", "order DE89370400440532013000", "order DE89370400440532013000 my iban"] + [" ".join(random.choice(parts) for _ in range(30)) for _ in range(400)]
    found = {r.doc_id: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        kinds = [(int(x.split(":")[1]), x.split(":")[0], float(v)) for x, v in zip(found[i].spans.split(","), found[i].scores.split(","), strict=True) if x and x.split(":")[0] in ("iban", "ssn")]
        assert kinds == slow_scores(t), t
    assert found[0].spans == "ssn:5:16,ssn:18:29" and found[1].spans == "ssn:0:11" and found[2].spans == "" and found[3].spans == "" and found[4].spans == "iban:6:28"


def test_columns_keep_names_types_and_values(spark):
    names = ["spans", "_text", "_masked", "_merged", "_row", "row", "ends", "masked", "email", "ssn"]
    docs = spark.createDataFrame([(1, "mail a@b.de now", *names), (2, None, *names), (3, "a@b.de c@d.ef", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    rows = pii.mask(docs)
    assert rows.dtypes == docs.dtypes
    assert {tuple(r) for r in rows.collect()} == {(1, "mail [EMAIL] now", *names), (2, None, *names), (3, "[EMAIL] [EMAIL]", *names)}
    assert pii.spans(docs, out="found").drop("found").dtypes == docs.dtypes


def test_overlapping_spans_become_one(spark):
    text = "+1.2.3.4567.8901 x 1.2.3.4@b.cd y " + "a@b.cd " * 500
    masked = pii.mask(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    found = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    out, at = "", 0
    for s in found:
        if s.start >= at:
            out += text[at : s.start] + f"[{s.kind.upper()}]"
        at = max(at, s.end)
    assert masked == out + text[at:] and masked.count("[EMAIL]") == 501
