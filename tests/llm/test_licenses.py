"""Standard notices, plain, wrapped and in comments."""

import textwrap

import pytest

from tunegrid.llm import licenses

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
BSD2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD3 = BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.'


def gpl(what, name, version):
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See it for more details."


NOTICES = {
    "MIT": MIT,
    "ISC": ISC,
    "BSD-2-Clause": BSD2,
    "BSD-3-Clause": BSD3,
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": gpl("program", "GNU General Public License", "3"),
    "GPL-2.0-or-later": gpl("program", "GNU General Public License", "2"),
    "LGPL-2.1-or-later": gpl("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later": gpl("library", "GNU Lesser General Public License", "3"),
    "AGPL-3.0-or-later": gpl("program", "GNU Affero General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
LINES = {
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "Released under the Apache License 2.0.": "Apache-2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC-ND 3.0": "CC-BY-NC-ND-3.0",
    "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy": "GPL-3.0-only",
    "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999": "LGPL-2.1-only",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": "Apache-2.0",
    "Mozilla Public License Version 2.0\n==================================": "MPL-2.0",
    "Eclipse Public License - v 2.0": "EPL-2.0",
    "Copyright 2020 by us. All rights reserved.": "proprietary",
}


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


@pytest.fixture(scope="module")
def found(spark):
    shapes = {"plain": lambda t: t, "wrapped": lambda t: wrapped(t, 72), "narrow": lambda t: wrapped(t, 40), "hash": lambda t: "x = 1\n\n" + wrapped(t, 70, "# "), "star": lambda t: "/*\n" + wrapped(t, 70, " * ") + " */", "slash": lambda t: wrapped(t, 70, "// "), "noted": lambda t: t.replace("\n\n", "\n\nSome words of our own stand here.\n\n")}
    texts = {(name, shape): f(text) for name, text in NOTICES.items() for shape, f in shapes.items() if not (shape == "noted" and name == "Apache-2.0")}
    texts |= {(want, line): line for line, want in LINES.items()}
    keys = list(texts)
    rows = licenses.scan_licenses(spark.createDataFrame([(k, texts[key]) for k, key in enumerate(keys)], "doc_id long, text string")).collect()
    return {keys[r.doc_id]: r.licenses for r in rows}, texts


def test_every_notice_in_every_shape(found):
    got, texts = found
    assert {k: got.get(k) for k in texts if got.get(k) != k[0]} == {}


def test_sql_finds_the_same(spark, found):
    duckdb = pytest.importorskip("duckdb")
    got, texts = found
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts.values())))
    keys = list(texts)
    names = [c[0] for c in con.execute(licenses.oracle()).description]
    rows = [dict(zip(names, r, strict=True)) for r in con.execute(licenses.oracle()).fetchall()]
    assert {keys[r["doc_id"]]: r["licenses"] for r in rows} == got


def test_order_and_incomplete_rules(spark):
    pieces = MIT.split("\n\n")
    texts = ["\n\n".join(pieces[::-1]), pieces[0], "\n\n".join([pieces[0], "more", pieces[1], "words " * 50, pieces[2]]), "no licence words", None, ""]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.n_sentences) for r in rows} == {0: ("", 3), 1: ("", 1), 2: ("MIT", 3)}
