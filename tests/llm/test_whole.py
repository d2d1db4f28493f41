"""Cases that an operator once left out."""

import random
import string

from pyspark.sql import functions as F

from tunegrid.llm import licenses, secrets, url_filter

NATURAL = ["internationalization", "zentralheizungsanlage", "anticonstitutionnellement", "donaudampfschifffahrtsgesellschaft", "ThisIsACamelCaseIdentifier", "PRIVATE_KEY_FOR_PRODUCTION", "/usr/local/lib/python3/dist-packages", "-" * 30]


def test_secrets_behind_equals_signs_and_without_digits(spark):
    rng = random.Random(4)
    token = "Zk3hQ9xT7bLm2VwRr8PdYc5NfJ"
    letters = ["".join(rng.choice(string.ascii_letters) for _ in range(24)) for _ in range(20)]
    texts = [f"PRIVATE_KEY={token}", f"https://a.example/f?sig={token}&x=1", f"{token}=1", f"k {token}== z", f"{token} and {token}"] + [f"a {t} b" for t in letters] + NATURAL
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.secrets if s.kind == "random"] for r in rows}
    assert [got[k] for k in range(5)] == [[token], [token], [token], [token + "=="], [token, token]]
    assert sum(got[5 + k] == [t] for k, t in enumerate(letters)) >= 17
    assert not any(got[25 + k] for k in range(len(NATURAL)))
    done = secrets.redact_secrets(spark.createDataFrame([(texts[0],), (texts[1],)], "text string")).collect()
    assert sorted(r.text for r in done) == ["PRIVATE_KEY=<secret>", "https://a.example/f?sig=<secret>&x=1"]


def test_battery_rejects_few_random_tokens_of_any_length(spark):
    rng = random.Random(8)
    hexa, plain = "0123456789ABCDEF", string.digits + string.ascii_letters
    cases = [(hexa, n) for n in (20, 23, 40)] + [("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), (plain, 20), (plain, 150)] + [(plain + "+/", n) for n in (43, 150, 172, 1000, 1600, 2300)] + [(plain + "-_", 150)]
    each = 60
    tokens = [(k, "".join(rng.choices(letters, k=n))) for k, (letters, n) in enumerate(cases) for _ in range(each)]
    rows = spark.createDataFrame(tokens, "k int, t string").repartition(8).select("k", secrets._battery(F.col("t"))["neglog"].alias("neglog")).collect()
    low = [sum(r.neglog > 2 for r in rows if r.k == k) for k in range(len(cases))]
    assert max(low) <= 5 and sum(low) <= 0.02 * len(rows), low


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


def test_verbatim_licence_notices(spark):
    texts = [APACHE, GPL, GPL.replace("software:", "software;"), BSD, "// SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0\nx = 1", "SPDX-License-Identifier: GPL-3.0-only"]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in rows}
    assert got == {0: ("Apache-2.0", 4), 1: ("GPL-3.0-or-later", 2), 2: ("GPL-3.0-or-later", 2), 3: ("BSD-2-Clause", 3), 4: ("MIT", 1), 5: ("Apache-2.0", 1), 6: ("GPL-3.0-only", 1)}



def test_unlabelled_hosts_back_off(spark):
    rows = [(k, f"http://h{k % 20}.bad.net/p") for k in range(400)] + [(1000 + k, f"http://h{k % 20}.ok.com/p") for k in range(400)]
    new = [(2000, "http://new.bad.net/p"), (2001, "http://new.other.net/p"), (2002, "http://new.ok.com/p"), (2003, "http://new.xyz/p")]
    pages = spark.createDataFrame(rows + new, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k < 1000 and k // 20 % 10 > 0)) for k, _ in rows], "page_id long, bad int")
    got = {r.page_id: (r.verdict, r.bound) for r in url_filter.filter_urls(pages, labels, []).collect()}
    assert len(got) == len(rows) + len(new)
    assert got[2000] == ("block", None) and got[2001][0] == "block" and got[2002] == ("allow", None) and got[2003] == ("allow", None)


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "xco.uk": ("xco.uk", "uk"), "a.xco.uk": ("xco.uk", "uk"), "w.x.com": ("x.com", "com"), "w.x.com:8080": ("x.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "u.ac.jp:1": ("u.ac.jp", "ac.jp")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").withColumns(url_filter.names_of("host")).collect()
    assert {r.host: (r.domain, r.suffix) for r in rows} == hosts


def test_sql_judges_hosts_without_labels_alike(spark, tmp_path):
    duckdb = __import__("pytest").importorskip("duckdb")
    rows = [(k, f"http://h{k % 20}.bad.co.uk/p") for k in range(400)] + [(1000 + k, f"http://h{k % 20}.ok.com/p") for k in range(400)]
    new = [(2000, "http://new.bad.co.uk/p"), (2001, "http://new.other.co.uk/p"), (2002, "http://new.ok.com/p"), (2003, "http://new.xyz/p")]
    pages = spark.createDataFrame(rows + new, "page_id long, url string")
    labels = [(k, int(k >= 1000 or k // 20 % 10 == 0), 0) for k, _ in rows]
    got = url_filter.filter_urls(pages, spark.createDataFrame([(k, 1 - q) for k, q, _ in labels], "page_id long, bad int")).collect()
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into pages values (?, ?)", rows + new)
    con.executemany("insert into labels values (?, ?, ?)", labels)
    found = con.sql(url_filter.ORACLE)
    assert sorted(found.fetchall(), key=str) == sorted((tuple(r[c] for c in found.columns) for r in got), key=str)
    assert {r.page_id: r.verdict for r in got if r.page_id >= 2000} == {2000: "block", 2001: "block", 2002: "allow", 2003: "allow"}
