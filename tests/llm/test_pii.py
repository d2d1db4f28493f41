"""Pseudonyms against a second implementation in plain Python, and values in awkward places."""

import hashlib
from datetime import date, timedelta

from pyspark.sql import functions as F

from tunegrid.llm import pii

KEY = "k"


def permuted(a, b, m, n, kind):
    for i in range(8):
        drawn = int(hashlib.sha256(f"{KEY}|{kind}|{i}|{b if i % 2 == 0 else a}".encode()).hexdigest()[:15], 16)
        a, b = ((a + drawn % m) % m, b) if i % 2 == 0 else (a, (b + drawn % n) % n)
    return a, b


def card(d):
    tail = len(d) - 9
    a, b = permuted(int(d[1:8]), int(d[8 : 8 + tail]), 10**7, 10**tail, "card")
    body = f"{d[0]}{a:07d}{b:0{tail}d}"
    return next(body + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(body + c))) % 10 == 0)


def day(text):
    first = date(1800, 1, 1)
    a, b = permuted(*divmod((date.fromisoformat(text) - first).days, 5411), 27, 5411, "date")
    return (first + timedelta(days=a * 5411 + b)).isoformat()


def phone(d):
    a, b = permuted(int(d[:3]) - 200, (int(d[3:6]) - 200) * 10_000 + int(d[6:]), 800, 8_000_000, "phone")
    return f"{a + 200}{b // 10_000 + 200}{b % 10_000:04d}"


def address(text):
    o = [int(x) for x in text.split(".")]
    a, b = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def word(text, kind, tweak=""):
    symbols = [c for c in text if c.isalnum()]
    halves = [symbols[: len(symbols) // 2], symbols[len(symbols) // 2 :]]
    for i in range(8):
        own, other = i % 2, 1 - i % 2
        seed = "|".join([KEY, kind, tweak, str(i), "".join(halves[other])])
        blocks = [hashlib.sha256(f"{seed}|{b}".encode()).hexdigest() for b in range(len(halves[own]) // 16 + 2)]
        for k, c in enumerate(halves[own]):
            by = int(blocks[k // 16][k % 16 * 4 :][:4], 16)
            halves[own][k] = str((int(c) + by) % 10) if c.isdigit() else chr(97 + (ord(c) - 97 + by) % 26)
    done = iter(halves[0] + halves[1])
    return "".join(next(done) if c.isalnum() else c for c in text)


def mail(text):
    name, host = text.lower().rsplit(".", 1)[0].split("@")
    return f"{word(name, 'email', host)}@{word(host, 'host')}.{text.lower().rsplit('.', 1)[1]}"


def scan(spark, texts):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    return [(r.text, [(p.kind, p.original, p.pseudonym) for p in r.pii]) for r in rows]


def test_pseudonyms_equal_a_second_implementation(spark):
    values = [("card", "4111111111111111", card), ("card", "378282246310005", card), ("card", "5500000000000004", card), ("date", "2024-02-29", day), ("date", "1800-01-01", day), ("ip", "10.20.30.40", address), ("email", "Joe_7.Bloggs+x@mail2.example-site.co.uk", mail), ("email", "a@b.org", mail)]
    got = scan(spark, [v for _, v, _ in values] + ["(979) 555-5854"])
    assert got[:-1] == [(f(v), [(kind, v, f(v))]) for kind, v, f in values]
    d = phone("9795555854")
    assert got[-1][0] == f"({d[:3]}) {d[3:6]}-{d[6:]}"


def test_cards_and_phones_beside_other_digits(spark):
    whole = "4111 1111 1111 1111"
    d = card("4111111111111111")
    spaced = " ".join(d[k : k + 4] for k in range(0, 16, 4))
    texts = [f"{whole} 12", f"{whole} 12/27", "4111111111111111 123", f"5555 {whole} 1234", f"{whole} 5500-0000-0000-0004", "1999 2000 2001 2002 2003 2004", "4111111111111112 1", "212-555-1234", "12-212-555-1234", "212.555-1234"]
    got = [t for t, _ in scan(spark, texts)]
    e, p = card("5500000000000004"), phone("2125551234")
    assert got[:5] == [f"{spaced} 12", f"{spaced} 12/27", f"{d} 123", f"5555 {spaced} 1234", f"{spaced} {e[:4]}-{e[4:8]}-{e[8:12]}-{e[12:]}"]
    assert got[5:7] == texts[5:7] and got[7] == f"{p[:3]}-{p[3:6]}-{p[6:]}" and got[8:] == texts[8:]


def test_long_domains_names_and_digit_tables(spark):
    texts = ["x@" + ".".join(["ab"] * 10_000) + " end", "y" * 100_000, "z" * 100_000 + "@a.org", "1234 " * 20_000, "a@b." * 5_000]
    got = scan(spark, texts)
    assert [len(t) for t, _ in got] == [len(t) for t in texts]
    assert [len(p) for _, p in got[:4]] == [1, 0, 1, 0] and got[0][0].endswith(" end")


def test_equal_shapes_never_collide(spark):
    names = [f"{a}{b}{c}" for a in "abcdefgh" for b in "xyz0123" for c in "0123456789"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", pii.feistel_text(F.col("n"), KEY, "email").alias("p"))
    found = {r.n: r.p for r in rows.collect()}
    assert len(set(found.values())) == len(names) and all([c.isdigit() for c in n] == [c.isdigit() for c in p] for n, p in found.items())
    back = rows.select("n", pii.feistel_text(F.col("p"), KEY, "email", None, True).alias("q")).where("n != q")
    assert back.count() == 0
