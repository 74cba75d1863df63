import hashlib
import random
import re

from pyspark.sql import functions as F

from rowloom.llm.pii import find_pii, mod97, pii_report, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(make, rows):
    got = sorted(((r["doc_id"], r["base_sha256"], r["spans"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii_report(make(rows)).collect()), key=str)
    want = []
    for i, t in rows:
        spans = base(t or "")
        n = [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        want.append((i, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans), *n))
    bare = [(*g[:2], ",".join(s for s in g[2].split(",") if not s.startswith(("iban", "local"))), *g[3:]) for g in got]
    assert sorted(bare, key=str) == sorted(want, key=str)


def test_odd_rows(make, odd_rows):
    import sys

    short = [(i, t if t is None or len(t) < 60_000 else t[:60_000]) for i, t in odd_rows]
    sys.setrecursionlimit(10_000)
    check(make, short)


def test_random_texts(make):
    rng = random.Random(2)
    atoms = ["a", "Z", "_", "%", "@", ".", "..", "b.co", "@x.y", "1", "23", "255", "256", "007", ".", "-", " ", "+", "+4", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "😀", "\n", "1.2.3.4", "+49 30 123456"]
    check(make, [(i, "".join(rng.choice(atoms) for _ in range(rng.randint(1, 40)))) for i in range(1500)])


def test_many_spans_in_one_text(make):
    check(make, [(1, " ".join(f"é user{i}@host{i}.org 10.0.{i % 300}.1" for i in range(3000)))])


def test_added_kinds_and_scores(make):
    rows = [(1, "pay to IBAN DE89 3704 0044 0532 0130 00 now"), (2, "IBAN DE88 3704 0044 0532 0130 00"), (3, "call 030 1234 5678"), (4, "number 030 1234 5678"), (5, "card 4111111111111111")]
    got = {r["doc_id"]: r for r in pii_report(make(rows)).collect()}
    assert got[1]["spans"] == "iban:12:39" and got[2]["spans"] == ""
    assert got[3]["spans"].startswith("localphone:5:") and got[4]["spans"] == ""
    assert got[5]["n_likely"] == 1 and got[1]["n_card"] == 0
    assert find_pii(make([])).collect() == []


def test_mod97(spark):
    assert spark.range(1).select(mod97(F.lit("GB82WEST12345698765432"))).first()[0]
    assert not spark.range(1).select(mod97(F.lit("GB83WEST12345698765432"))).first()[0]


def test_redact(make):
    rows = [(1, "mail a@b.co and 1.2.3.4, 1.2.3.999; 4111 1111 1111 1111 +49 30 1234567"), (2, None), (3, "clean text 12.5")]
    got = dict(make(rows).select("doc_id", redact(F.col("text"))).collect())
    assert got == {1: "mail <EMAIL> and <IP>, 1.2.3.999; <CARD> <PHONE>", 2: None, 3: "clean text 12.5"}
