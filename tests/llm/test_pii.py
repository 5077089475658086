import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import pii

#: The contract's patterns, as they stand.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def listing(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(spark, texts):
    rows = pii.listed(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), support=10**6)).collect()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.spans == listing(want), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [getattr(r, f"n_{k}") for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]


HARD = [
    "a@b.c%d@e.f", "a@b.c.@x.yy", "x@y", "a@b c@d.e", "..@a.b..c", "a@b.c-", "é☃ a.b+c@d-e.f.g é", "@@a@b.c",
    "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0000255.01.1.1", "1.2.3", "a1.2.3.4b", "99.1.2.3 300.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "41111111111111112", "1 4111111111111111", "0" * 13, "0" * 20, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (555) 123-4567", "+1 (555) 123-4567 )", "+12", "+1+1+1 234 567 890", "+123456789012345678", "+1 2 3 4 5 6 7 8 9.",
    "", None, "☃" * 50 + "a@b.cc", "x@y.zz a@b.cc 1.2.3.4 +1 555 123 4567 4111111111111111",
]


def test_hard_texts(spark):
    check(spark, HARD)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a0149@.+-%() é\n", max_size=60), min_size=20, max_size=60))
def test_any_text(spark, texts):
    check(spark, texts)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" + "(" * 200_000, "a@" * 50_000, "a.b" * 60_000, "1." * 60_000, "a@b." * 20_000 + "c", "+1 " * 60_000])
def test_long_runs_take_linear_time(spark, text):
    row = spark.createDataFrame([(1, text)], "doc_id long, text string").select(*[F.size(pii.base_spans(F.col("text"), k)).alias(k) for k in pii.BASE]).first()
    assert row is not None


def test_matches_the_contract_on_data(spark, docs_small):
    texts = {r.doc_id: r.text for r in docs_small.collect()}
    for r in pii.listed(pii.find(docs_small)).collect():
        assert (r.spans + ",").startswith((listing(brute(texts[r.doc_id])) + ",").lstrip(","))


def disclosure(docs, window=60, support=3, low=0.75, high=0.9):
    """Which (entity, term) pairs disclose, by brute force."""
    near, seen = {}, {}
    for i, t in enumerate(docs):
        for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())):
            seen.setdefault(w, set()).add(i)
        for kind, p in BASE.items():
            spans = [m.span() for m in re.finditer(p, t)]
            for k, (a, b) in enumerate(spans):
                if not valid(kind, t[a:b]):
                    continue
                lo = spans[k - 1][1] if k else 0
                hi = spans[k + 1][0] if k + 1 < len(spans) else len(t)
                left, right = t[max(lo, a - window) : a], t[b : min(hi, b + window)]
                if len(left) >= window:
                    left = re.sub(r"^[^\W\d_]+", "", left)
                if len(right) >= window:
                    right = re.sub(r"[^\W\d_]+$", "", right)
                for w in {x.lower() for s in (left, right) for x in re.findall(r"[^\W\d_]{3,}", s)}:
                    near.setdefault((kind, t[a:b].lower()), {}).setdefault(w, {}).setdefault(i, set()).add((left, right))
    out = {}
    n = len(docs)
    for e, terms in near.items():
        having = {i for rows in terms.values() for i in rows}
        for w, rows in terms.items():
            if len(rows) >= support and len({x for own in rows.values() for x in own}) >= 2:
                told = math.log2(len(rows) * n / (len(having) * len(seen[w]))) / math.log2(n / len(having))
                if told >= low:
                    out[e, w] = "term" if told >= high else "hint"
    return out


def test_terms_that_give_an_entity_away(spark):
    filler = ["the weather is fine and the town is quiet today number %d" % k for k in range(200)]
    told = [f"please write to Ms Kowalska of the office {x} at jk@example.org about the matter {x}" for x in ("one", "two", "three", "four")]
    common = ["the office of the matter is quiet today"] * 40
    docs = told + filler + common
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    want = disclosure(docs)
    assert want[("email", "jk@example.org"), "kowalska"] == "term" and (("email", "jk@example.org"), "the") not in want
    for i, t in enumerate(told):
        for kind in ("hint", "term"):
            assert {t[s.start : s.end].lower() for s in rows[i][kind]} == {w for (_, w), k in want.items() if k == kind}
    assert all(not rows[i].term and not rows[i].hint for i in range(len(told), len(docs)))


def test_redaction(spark):
    text = "é a@b.cc and 1.2.3.4, call +1 555 123 4567"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {k: pii.base_spans(F.col("text"), k) for k in pii.BASE}
    found["term"] = F.array(F.struct(F.lit(9).cast("long").alias("start"), F.lit(12).cast("long").alias("end")))
    assert df.select(pii.redact(F.col("text"), found)).first()[0] == "é [EMAIL]  [IP], call [PHONE]"
    assert df.select(pii.redact(F.lit(""), {"ip": pii.base_spans(F.lit(""), "ip")})).first()[0] == ""


def test_oddities(spark, odd_docs, no_docs):
    rows = pii.listed(pii.find(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == "" for r in rows)
    assert pii.listed(pii.find(no_docs)).count() == 0


def test_places_of_very_many_matches(spark):
    text = "".join(f"{'é' * (k % 7)} 10.{k % 300}.0.{k % 256}, " for k in range(1500))
    got = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text"), "ip", 5).alias("s")).first().s
    assert [(x.start, x.end) for x in got] == [m.span() for m in re.finditer(BASE["ip"], text) if valid("ip", m.group())]
    assert len(got) > 1000


def test_an_entity_is_its_kind_and_value_wherever_it_stands(spark):
    """The same disclosure with another entity put first, and for entities of two kinds in one text."""
    rng = random.Random(3)
    filler = [f"the weather is fine and the town is quiet today number {k}" for k in range(200)]
    told = []
    for k, x in enumerate(("one", "two", "three", "four", "five", "six")):
        t = f"please write to Ms Kowalska of the office {x} at jk@example.org about the matter {x} or see the Zamosc machine {x} at 10.20.30.40 now"
        others = " and ".join(f"a{rng.randrange(10**6)}@other{rng.randrange(10**6)}.net" for _ in range(k % 3))
        told.append(f"{others} {'- ' * 60} {t}" if others else t)
    docs = told + filler
    rows = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    want = disclosure(docs)
    assert want[("email", "jk@example.org"), "kowalska"] == "term" and want[("ip", "10.20.30.40"), "zamosc"] == "term"
    for i, t in enumerate(told):
        terms = {t[s.start : s.end].lower() for s in rows[i].term}
        assert {"kowalska", "zamosc"} <= terms == {w for (_, w), k in want.items() if k == "term"}
        assert not re.search("kowalska|zamosc|example|10.20", rows[i].redacted.lower())
        assert "[EMAIL]" in rows[i].redacted and "[IP]" in rows[i].redacted
    assert all(rows[i].redacted == docs[i] for i in range(len(told), len(docs)))


def test_redaction_against_the_spans(spark, docs_small):
    """The redacted text is the text with its spans cut out, left to right."""
    texts = {r.doc_id: r.text or "" for r in docs_small.collect()}
    for r in pii.sanitise(docs_small).collect():
        spans = sorted((s.start, -s.end, "" if k == "term" else f"[{k.upper()}]") for k in pii.KINDS for s in r[k])
        at, out = 0, []
        for a, back, mark in spans:
            if a >= at:
                out += [texts[r.doc_id][at:a], mark]
            at = max(at, -back)
        assert r.redacted == "".join(out) + texts[r.doc_id][at:]
