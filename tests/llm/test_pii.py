import re
import time

from pyspark.sql import functions as F

from visigraph.llm import pii

from .edge import documents, nothing

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = ["a@b.c+d@e.f", "x@y@z.de", "a..b@c-.d.e.", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.01", "1.1.1.1111", "4111111111111111", "4111-1111 1111-1111", "4111 1111 1111 1112", "0 0 0 0 0 0 0 0 0 0 0 0", "+1 (386) 555-3733.", "+12", "++49 30 123456789", "+1 2345678", "ä@b.de 😀 a@b.de", "+1 4111 1111 1111 1111", "9" * 30_000, "1-" * 20_000 + "1", "a" * 50_000 + "@b.c", "a" * 50_000, "." * 2_000 + "@"]


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    spans = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_hard_texts_as_plain_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: r.x for r in pii.found_rows(rows).select("doc_id", pii.listed(F.col("base")).alias("x")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(HARD)}


def disclosed():
    """An address in five texts, always near one rare word, and many texts without."""
    more = [(100 + i, f"nr {i} say that Zorblax{'' if i % 2 else '.'} wrote from zed.q@mail.de about the matter {i}") for i in range(5)]
    return more + [(200 + i, f"plain text {i} about the matter that is here") for i in range(40)] + [(300, "ZORBLAX alone, and not Zorblaxian")]


def test_terms_that_disclose(spark, same_as_sql):
    got = same_as_sql(pii.op7_pii, pii.SQL, documents=documents(spark, disclosed()))
    rows = {r.doc_id: r.spans for r in got.collect()}
    assert "term:" in rows[100] and rows[300] == "term:0:7" and rows[200] == ""


def test_terms_of_what_identifiers_share(spark, same_as_sql):
    """Identifiers that stand in one text each: a name beside a user name, a firm beside a domain, a network, an exchange and an issuer are found."""
    near = [("Zorblax", "zed.{}@mail{}.de"), ("Quintel", "user{0}{0}x@quintel{1}.example"), ("Serverhall", "10.20.30.{}"), ("Frontdesk", "+1 (386) 555-37{:02d}"), ("Goldbank", "4111 11{:02d} 0000")]
    rows = [(100 + 10 * k + i, f"note {i} of {term} about the matter {what.format(10 + i, i if k == 0 else '')} as ever") for k, (term, what) in enumerate(near) for i in range(4)]
    rows += [(200 + i, f"plain text {i} about the matter of note as ever") for i in range(80)]
    rows += [(300, "zorblax and quintel, a serverhall, the frontdesk"), (301, "hapaxword 192.168.77.1 stands once")]
    spans = {r.doc_id: r.spans for r in same_as_sql(pii.op7_pii, pii.SQL, documents=documents(spark, rows)).collect()}
    assert spans[300] == "term:0:7,term:12:19,term:23:33,term:39:48"
    assert spans[301] == "ip:10:22" and all(spans[200 + i] == "" for i in range(80))


def test_doubt_by_hand(spark):
    """Copies of one text are one piece of evidence; two texts without a counterexample leave a bit; the entity of most documents discloses nothing."""
    rows = [(i, "Zorblax at 10.0.0.1") for i in range(9)] + [(20 + i, f"Quintel at 10.9.9.9 nr{i}") for i in range(2)] + [(40 + i, f"text {i}") for i in range(60)]
    found = {(r.term, r.entity): r for r in pii.disclosing_terms(pii.found_rows(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert set(found) == {("quintel", "10.9.9.9"), ("quintel", "10.9.9.")}
    r = found["quintel", "10.9.9.9"]
    assert (r.n_et, r.m, r.n_e, r.n_t, r.doubt) == (2, 2, 2, 2, 1.0)
    footer = spark.createDataFrame([(i, f"Imprint of text {i}, a@b.de") for i in range(30)], "doc_id long, text string")
    assert pii.disclosing_terms(pii.found_rows(footer)).count() == 0


def test_sanitise(spark):
    docs = spark.createDataFrame([(1, "write to a@b.de or 4111 1111 1111 1111, 😀 1.2.3.4!"), (2, None), (3, "clean")], "doc_id long, text string")
    found = pii.find(docs)
    assert [r.text for r in pii.sanitise(found).orderBy("doc_id").collect()] == ["write to [EMAIL] or [CARD], 😀 [IP]!", None, "clean"]
    assert pii.sanitise(found, remove=True).where("doc_id = 1").first().text == "write to  or , 😀 !"


def test_no_python_in_the_plan(spark):
    plan = pii.find(documents(spark, disclosed()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_and_extra_columns(spark):
    assert pii.find(nothing(spark)).count() == 0
    docs = documents(spark)
    assert pii.sanitise(pii.find(docs)).select(docs.columns).count() == docs.count()


def test_a_text_of_many_identifiers(spark):
    """A log of 5,000 addresses in one text, twice: time follows their number, and all are found."""
    line = lambda i: f"user{i} logged in from 10.{i // 250}.{i % 250}.7 as person{i}@example{i % 3}.org\n"
    text = "".join(map(line, range(2_500)))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a quiet text")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.n for r in pii.find(docs).select("doc_id", F.size("base").alias("n")).collect()}
    assert got == {1: 5_000, 2: 5_000, 3: 0} and time.perf_counter() - began < 120
