"""License scans by sentence rules, with DataFrame functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.secrets import let

# Identifier and wording of known licence sentences, as normalised text.
SENTENCES = {
    "apache2-file": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-copy-https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache2-title-url": "apache license version 2 0 january 2004 http www apache org licenses",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-free-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "gpl2-free-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-title": "mozilla public license version 2 0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2-title": "eclipse public license v 2 0",
    "epl1-title": "eclipse public license v 1 0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "reserved": "all rights reserved",
}
# Licence and the sentences that show it, in order; others may stand between.
RULES = [
    ("Apache-2.0", ["apache2-file", "apache2-copy", "apache2-basis"]),
    ("Apache-2.0", ["apache2-file", "apache2-copy-https", "apache2-basis"]),
    ("Apache-2.0", ["apache2-title"]),
    ("Apache-2.0", ["apache2-title-url"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-title-short"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-author"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-3.0-only", ["gpl3-free-only", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-free-only", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("GPL-2.0-only", ["gpl2-title"]),
    ("LGPL-3.0-only", ["lgpl3-title"]),
    ("LGPL-2.1-only", ["lgpl21-title"]),
    ("AGPL-3.0-only", ["agpl3-title"]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy-https"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-2.0", ["epl2-title"]),
    ("EPL-1.0", ["epl1-title"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("proprietary", ["reserved"]),
]
# A licence whose rules another licence's hold within, so that it does not count beside that one.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}
#: What a reserved right alone shows; beside a licence it is no licence of its own.
RESERVED = "proprietary"
# Names by which a sentence `licensed under ...` tells a licence, as normalised text.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0"],
    "MIT": ["mit license", "mit"],
    "ISC": ["isc license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gpl v3", "gplv3", "gpl 3 0"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gpl v2", "gplv2", "gpl 2 0"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl v3", "lgplv3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl v2 1", "lgplv2 1"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl v3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "epl 1 0"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
}
# Elements and versions of the Creative Commons licences, and identifiers that only SPDX lines name.
_CC = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-ND": "attribution noderivatives", "BY-NC": "attribution noncommercial", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
_CC_VERSIONS = {"2.0": ["generic"], "2.5": ["generic"], "3.0": ["unported"], "4.0": ["international"]}
_SPDX_ONLY = ["0BSD", "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "CC0-1.0", "BSL-1.0", "Zlib"]


def _plain(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def _with_names() -> None:
    """Adds the sentences that only name a licence, each a rule of its own: `licensed under` one of its names, and SPDX lines."""
    for elements, words in _CC.items():
        for version, places in _CC_VERSIONS.items():
            short = f"{_plain(elements)} {_plain(version)}"
            long = f"{words} {_plain(version)}"
            NAMES[f"CC-{elements}-{version}"] = [f"cc {short}", f"cc {short} license", f"creative commons {long}", f"creative commons {long} license", *(f"creative commons {long} {p}{end}" for p in places for end in ("", " license"))]
    for licence, names in NAMES.items():
        for k, name in enumerate(names):
            SENTENCES[f"name-{licence}-{k}"] = f"licensed under {name}"
            RULES.append((licence, [f"name-{licence}-{k}"]))
    for licence in dict.fromkeys([*NAMES, *_SPDX_ONLY]):
        SENTENCES[f"spdx-{licence}"] = f"spdx license identifier {_plain(licence)}"
        RULES.append((licence, [f"spdx-{licence}"]))


_with_names()
#: A text without any of these words holds no rule's first sentence.
HINTS = ["licen", "reserved", "permission", "free software", "warrant", "redistribut", "notice", "except in compliance", "unencumbered"]
END = r"([.!?:;])[\t ]+"
#: Short forms in names, whose dot ends no sentence.
SHORT_FORMS = r"\b(Inc|Ltd|Corp|Co|Dr|Mr|Mrs|Ms|Prof)[.]"
#: A term that headers define on the way; no known sentence has it.
TERM = r"(?i)\(the [\"“']?license[\"”']?\)"
#: Marks that begin a line of a comment or of a list.
MARKS = r"\n[\t ]*(?:/?[*]+|//+|[#;>%-]+|[(]?[0-9a-z][.)])[\t ]+"
BLANK = r"\n[\t ]*(?:[*]|//|#)?[\t ]*\n"
#: Ways to say `licensed under`, and what may follow a licence's name.
LEAD = r"^(?:[a-z]+ ){0,4}(?:licensed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |a |an )?"
TAIL = r" (?:see|as found in) (?:the )?(?:accompanying )?(?:licen[sc]e|copying).*$"
#: Nor is a sentence that denies it one of them.
DENIED = r"^(?:[a-z0-9]+ ){0,8}(?:not|never|neither|cannot|no longer|isn t|aren t|wasn t) (?:[a-z]+ ){0,3}(?:licensed|released|distributed|available|published|provided) under "
#: Places of known sentences that any name fills, and the wording that stands for all.
SLOTS = [
    (r"^(?:[a-z0-9]+ ){1,8}is free software", "this program is free software"),
    (r"^(?:[a-z0-9]+ ){1,8}is distributed in the hope", "this program is distributed in the hope"),
    (r"^neither the names? of (?:[a-z0-9]+ ){1,16}nor the names of (?:its|their|any|the|other) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"^the names? of (?:the )?authors? may not", "the name of the author may not"),
]
#: An SPDX expression is read as one line for each of its licences: exceptions fall away, each pass cuts one `OR` or `AND`.
SPDX_LINE, SPDX_PASSES = "SPDX-License-Identifier:", 4
SPDX_WITH = r"(SPDX-License-Identifier:[ \t]*[(]*[A-Za-z0-9.+-]+)[ \t]+WITH[ \t]+[A-Za-z0-9.-]+"
SPDX_NEXT = r"(SPDX-License-Identifier:[ \t]*[(]*[A-Za-z0-9.+-]+[)]*)[ \t]+(?:OR|AND)[ \t]+[(]*"
#: Pieces that a known sentence may run over: `:`, `;` and blank lines also stand inside sentences.
SPAN = 3


def normal(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(sentence, TERM, " ")), "[^a-z0-9]+", " "))
    for slot, wording in SLOTS:
        plain = F.regexp_replace(plain, slot, wording)
    return let(plain, lambda x: F.when(x.contains(" under ") & ~x.rlike(DENIED), F.regexp_replace(F.regexp_replace(x, LEAD, "licensed under "), TAIL, "")).otherwise(x))


def _spelt_out(text: Column) -> Column:
    out = text
    for _ in range(SPDX_PASSES):
        out = F.regexp_replace(F.regexp_replace(out, SPDX_WITH, "$1"), SPDX_NEXT, f"$1\n{SPDX_LINE} ")
    return F.when(text.contains(SPDX_LINE), out).otherwise(text)


def _marks(pieces: Column, numbers: dict[str, int]) -> Column:
    """The known sentences' numbers in order of appearance; a sentence may run over SPAN pieces."""
    known = F.create_map(*[F.lit(x) for text, n in numbers.items() for x in (text, n)])
    longest = max(map(len, numbers))

    def found(s: Column) -> Column:
        joined = lambda i, k: F.try_element_at(known, F.array_join(F.slice(s, i + 1, F.lit(k)), " "))
        # The longest run of pieces first: a title's first line may be a shorter title.
        return F.transform(s, lambda x, i: F.when(F.length(x) <= longest, F.coalesce(*[joined(i, k) for k in range(SPAN, 1, -1)], F.try_element_at(known, x))))

    return F.array_compact(let(F.filter(F.transform(pieces, normal), lambda x: x != ""), found))


def _in_order(tied: Column, needs: list[int]) -> Column:
    """Whether the numbers stand in the comma-tied sequence in this order, each search going on behind the one before."""
    def behind(mark: str) -> Callable[[Column], Column]:
        return lambda p: F.when(p > 0, let(F.call_function("locate", F.lit(mark), tied, p), lambda q: F.when(q > 0, q + len(mark) - 1).otherwise(0))).otherwise(0)

    at = F.lit(1)
    for n in needs:
        at = let(at, behind(f",{n},"))
    return at > 0


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """(doc_id, licenses, sentences, n_sentences): one row per document with a known licence sentence.

    Texts are cut at sentence ends and lines, and once more with lines joined inside paragraphs
    for wrapped notices, without the marks of comments and lists; a known sentence may run over SPAN pieces of a cut. Normalised
    sentences (lower case, letters and digits only, one wording of `licensed under` and of the names in SLOTS) become
    identifiers; a rule holds if its identifiers come in its order, whatever stands between. licenses
    has the sorted distinct licences of the rules that hold, without one that WITHIN puts inside another and without RESERVED beside others, sentences the identifiers in order
    (of the cut that finds more), both comma-joined; licenses is empty if sentences complete no rule.
    Null, empty and other texts give no row; null and repeated ids pass through.
    """
    sentences, rules = sentences or SENTENCES, RULES if rules is None else rules
    hint = "(?i)" + "|".join(re.escape(h) for h in HINTS) if sentences is SENTENCES else "(?s)."
    names = list(sentences)
    numbers = {text: k for k, text in enumerate(sentences.values())}
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _spelt_out(text).alias("_t")).where(F.col("_t").rlike(hint))
    paragraphs = F.regexp_replace(F.concat(F.lit("\n"), "_t"), BLANK, "\n\u0001\n")
    rows = rows.withColumn("_u", F.regexp_replace(F.regexp_replace(paragraphs, MARKS, "\n"), SHORT_FORMS, "$1"))
    by_line = F.split(F.regexp_replace("_u", END, "$1\n"), "\n")
    joined = F.split(F.regexp_replace(F.regexp_replace("_u", r"[\t ]*\n[\t ]*", " "), END, "$1\u0001"), "\u0001")
    rows = rows.select("doc_id", _marks(by_line, numbers).alias("a"), _marks(joined, numbers).alias("b")).where((F.size("a") > 0) | (F.size("b") > 0))
    tied = lambda c: F.concat(F.lit(","), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    rows = rows.withColumns({"ta": tied("a"), "tb": tied("b")})
    single, ordered = {}, []
    for licence, needs in rules:
        if len(needs) == 1:
            single[numbers[sentences[needs[0]]]] = licence
        else:
            ordered.append((licence, [names.index(n) for n in needs]))
    alone = F.create_map(*[F.lit(x) for n, licence in single.items() for x in (n, licence)]) if single else None
    holds = [F.when(_in_order(F.col("ta"), needs) | _in_order(F.col("tb"), needs), F.lit(licence)) for licence, needs in ordered]
    found = F.array(*holds, F.lit(None).cast("string"))
    if alone is not None:
        found = F.concat(found, F.transform(F.concat("a", "b"), lambda x: F.try_element_at(alone, x)))
    rows = rows.withColumn("_l", F.array_distinct(F.array_compact(found)))
    kept = F.col("_l")
    for inner, outer in WITHIN.items():
        kept = F.when(F.array_contains("_l", outer), F.array_remove(kept, inner)).otherwise(kept)
    kept = let(kept, lambda x: F.when(F.size(x) > 1, F.array_remove(x, RESERVED)).otherwise(x))
    best = F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a"))
    label = F.array(*[F.lit(n) for n in names])
    return rows.select(
        "doc_id", F.array_join(F.array_sort(kept), ",").alias("licenses"),
        F.array_join(F.transform(best, lambda x: F.get(label, x)), ",").alias("sentences"), F.size(best).cast("long").alias("n_sentences"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    known = "MAP {" + ", ".join(f"{_quoted(s)}: {k}" for k, s in enumerate(SENTENCES.values())) + "}"
    names, longest = list(SENTENCES), max(map(len, SENTENCES.values()))
    plain = r"trim(regexp_replace(lower(regexp_replace(s, '{0}', ' ', 'gi')), '[^a-z0-9]+', ' ', 'g'))".format(TERM.removeprefix("(?i)").replace("'", "''"))
    for slot, wording in SLOTS:
        plain = f"regexp_replace({plain}, '{slot}', '{wording}')"
    normal_ = f"CASE WHEN contains(s, ' under ') AND NOT regexp_matches(s, '{DENIED}') THEN regexp_replace(regexp_replace(s, '{LEAD}', 'licensed under '), '{TAIL}', '') ELSE s END"
    pieces = lambda cut: f"list_filter(list_transform(list_transform({cut}, lambda s: {plain}), lambda s: {normal_}), lambda s: s <> '')"
    tries = ", ".join(f"k[array_to_string(s[i:i + {n - 1}], ' ')]" for n in range(SPAN, 1, -1))
    marks = f"list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN length(s[i]) <= {longest} THEN coalesce({tries}, k[s[i]]) END), lambda x: x IS NOT NULL)"
    spelt = "text"
    for _ in range(SPDX_PASSES):
        spelt = f"regexp_replace(regexp_replace({spelt}, '{SPDX_WITH}', '\\1', 'g'), '{SPDX_NEXT}', '\\1' || chr(10) || '{SPDX_LINE} ', 'g')"
    clean = rf"regexp_replace(regexp_replace(chr(10) || {spelt}, '{BLANK}', chr(10) || chr(1) || chr(10), 'g'), '{MARKS}', chr(10), 'g')"
    clean = f"regexp_replace({clean}, '{SHORT_FORMS}', '\\1', 'g')"
    by_line = r"string_split(regexp_replace(u, '([.!?:;])[\t ]+', '\1' || chr(10), 'g'), chr(10))"
    joined = r"string_split(regexp_replace(regexp_replace(u, '[\t ]*\n[\t ]*', ' ', 'g'), '([.!?:;])[\t ]+', '\1' || chr(1), 'g'), chr(1))"
    pattern = {lic_no: "(?:,.*)?".join(f",{names.index(n)}" for n in needs) + "," for lic_no, (_, needs) in enumerate(RULES)}
    holds = ", ".join(f"CASE WHEN regexp_matches(ta, '{pattern[k]}') OR regexp_matches(tb, '{pattern[k]}') THEN '{lic}' END" for k, (lic, _) in enumerate(RULES))
    kept = "l"
    for inner, outer in WITHIN.items():
        kept = f"CASE WHEN list_contains(l, '{outer}') THEN list_filter({kept}, lambda x: x <> '{inner}') ELSE {kept} END"
    kept = f"CASE WHEN len({kept}) > 1 THEN list_filter({kept}, lambda x: x <> '{RESERVED}') ELSE {kept} END"
    return f"""
WITH u AS (SELECT doc_id, {clean} AS u FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, {pieces(by_line)} AS x, {pieces(joined)} AS y FROM u),
known AS (SELECT {known} AS k),
m AS (SELECT doc_id, (SELECT {marks} FROM (SELECT x AS s), known) AS a, (SELECT {marks} FROM (SELECT y AS s), known) AS b FROM p),
t AS (SELECT *, ',' || array_to_string(a, ',') || ',' AS ta, ',' || array_to_string(b, ',') || ',' AS tb, CASE WHEN len(b) > len(a) THEN b ELSE a END AS best
      FROM m WHERE len(a) > 0 OR len(b) > 0),
r AS (SELECT *, list_distinct(list_filter([{holds}], lambda x: x IS NOT NULL)) AS l FROM t)
SELECT doc_id, array_to_string(list_sort({kept}), ',') AS licenses,
       array_to_string(list_transform(best, lambda x: [{', '.join(_quoted(n) for n in names)}][x + 1]), ',') AS sentences, len(best)::BIGINT AS n_sentences
FROM r
"""
