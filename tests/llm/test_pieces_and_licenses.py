from __future__ import annotations

import os
import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltline.llm import licenses
from siltline.llm.sentence_pieces import PieceModel, codec, decode_ids, encode_texts, parity, round_trips
from siltline.llm.wordbpe import vocabulary_path

PIECES = vocabulary_path("piece_bpe_32k.model")


def test_parity_with_the_library(awkward):
    texts = [t or "" for _, t in awkward] + ["  a  b ", "\t\n x", "<s> </s> <unk>", "日本語 😀 \x00 ß", "a" * 60, "trail  ", "<0x0A>", "x" + " " * 40 + "y"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab \u2581\n\té日") for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert parity(PIECES, texts) == []


def test_settings_that_are_not_carried_over():
    text = lambda number, raw: bytes([number << 3 | 2, len(raw)]) + raw
    piece = text(1, text(1, b"a") + b"\x18\x01")
    assert PieceModel.parse(piece).pieces == [("a", 0.0, 1)]
    suffix, escape, user = text(2, b"\xc0\x01\x01"), text(3, b"\x28\x00"), text(1, text(1, b"u") + b"\x18\x04") + text(2, b"\x18\x02")
    for bad in (suffix, escape, user):
        with pytest.raises(ValueError, match="carried"):
            PieceModel.parse(piece + bad)


def test_round_trips(docs, awkward):
    out = round_trips(docs, "doc_id", "text", PIECES).toPandas()
    assert len(out) == len(awkward) and out.same.all()
    back = decode_ids(encode_texts(docs, "doc_id", "text", PIECES), "key", "ids", PIECES).collect()
    assert Counter((r.key, r.text) for r in back) == Counter((i, t or "") for i, t in awkward)
    assert round_trips(docs.where("false"), "doc_id", "text", PIECES).count() == 0


def test_unigram_models_and_bad_bytes():
    model = PieceModel([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("▁", -3.0, 1)], 1, 0, False, b"", True, False)
    assert model.tokenizer().encode("▁ab", add_special_tokens=False).ids == [1, 2] and not model.crosses()
    own = codec(PIECES)
    broken = np.array([i for i, p in enumerate(own.model.pieces) if p[0] == "<0xE9>"])
    assert own.decode(broken).decode() == "�"


LICENSED = [
    (1, "Some text.\nReleased under the MIT License.\nMore."), (2, "x y.  This work is licensed under the GNU General Public License, version 3. z"), (3, "released under the mit   license"), (4, None), (5, ""),
    (6, "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    (7, "Licensed under the Apache License, Version 2.0 (the License).\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n"),
    (8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + "filler\n" * 3 + "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n" + "filler\n" * 4 + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    (9, "Released under the MIT License.\n" * 2), (9, "Released under the MIT License.\n" * 2), (None, "Licensed under CC BY-NC 4.0."), (10, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
]


def test_ordered_rules(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in LICENSED], "doc_id long, text string, name string, step int")
    got = Counter((r.doc_id, r.rule, r.first_sentence, r.last_sentence) for r in licenses.scan_licenses(df, "doc_id", "text").collect())
    want = Counter({(1, "mit-short", 1, 1): 1, (2, "gpl-3.0-short", 1, 1): 1, (3, "mit-short", 0, 0): 1, (7, "apache-2.0-header", 0, 2): 1, (9, "mit-short", 0, 0): 2, (9, "mit-short", 1, 1): 2, (None, "cc-by-nc-4.0-short", 0, 0): 1})
    assert got == want
    assert (8, "bsd-2-clause-text") in {(r.doc_id, r.rule) for r in licenses.scan_licenses(df, "doc_id", "text", gap=4).collect()}
    assert licenses.scan_licenses(df.where("false"), "doc_id", "text").count() == 0


def walk(steps, gap):
    """Matches in a list of (position, step) of a rule of three steps, by looking back from every last step."""
    found = {}
    for end, last in steps:
        at, want = end, 2
        while last == 3 and want and (before := [p for p, s in steps if s == want and p < at]) and at - max(before) - 1 <= gap:
            at, want = max(before), want - 1
        if last == 3 and want == 0:
            found[at] = min(end, found.get(at, end))
    return sorted(found.items())


def test_rule_walks_against_brute_force(spark):
    known, rules = {str(i): f"known sentence number {i} here" for i in (1, 2, 3)}, [("r", "L", True, ("1", "2", "3"))]
    orders = ["1223", "1213", "123123", "1 2 3", "1    23", "12233", "11233", "321", "12x1x23", "13", "122    3", "1232312323", "1 1 2    2 3"]
    orders += ["".join(random.Random(i).choices("123 ", k=14)) for i in range(60)]
    rows = [(i, "\n".join(known.get(c, "filler") for c in order)) for i, order in enumerate(orders)]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "id long, text string"), "id", "text", known, rules).collect():
        got.setdefault(r.doc_id, []).append((r.first_sentence, r.last_sentence))
    for i, order in enumerate(orders):
        assert sorted(got.get(i, [])) == walk([(p, int(c)) for p, c in enumerate(order) if c in known], 3), order
    assert got[0] == [(0, 3)] and got[2] == [(0, 2), (3, 5)] and 1 in got


def test_tags_and_notices_name_many_licences(spark):
    rows = [(1, "// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;"), (2, "This project is licensed under the Mozilla Public License 2.0."), (3, "Licensed under CC BY-NC-ND 3.0."), (4, "# SPDX-License-Identifier: CC0-1.0"), (5, "dedicated to the public domain"), (6, "SPDX-License-Identifier: Nonsense")]
    got = {(r.doc_id, r.license, r.reusable) for r in licenses.scan_licenses(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(1, "LGPL-2.1-or-later", True), (2, "MPL-2.0", True), (3, "CC-BY-NC-ND-3.0", False), (4, "CC0-1.0", True), (5, "public-domain", True)}
    sentences, rules = licenses.knowledge()
    assert len({lic for _, lic, _, _ in rules}) > 60 and len({n for n, _ in sentences}) == len({n for n, _ in sentences} | {s for *_, own in rules for s in own})
    assert len({r for r, *_ in rules}) == len(rules)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of
the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language."""


def test_wrapped_licence_texts(spark):
    wanted = {"mit-text": MIT, "gpl-3.0-header": GPL, "bsd-2-clause-text": BSD, "apache-2.0-header": APACHE}
    forms = [lambda t: t, lambda t: " ".join(t.split()), lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")), lambda t: "/*\r\n" + "\r\n".join(f" * {x}" for x in t.split("\n")) + "\r\n */\r\nint x;", lambda t: textwrap.fill(" ".join(t.split()), 60)]
    rows = [(f"{rule} {i}", "Some text.\n\n" + form(t)) for rule, t in wanted.items() for i, form in enumerate(forms)]
    # Words left out, added or in another order make no sentence.
    rows += [("out", MIT.replace("merge", "")), ("in", GPL.replace("later", "much later")), ("order", "rights\nall\nreserved"), ("within", "not all\nrights reserved here")]
    rows += [("twice", "All rights\nreserved.\nAll\nrights reserved.")]
    got = Counter((r.doc_id, r.rule, r.first_sentence, r.last_sentence) for r in licenses.scan_licenses(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect())
    found = Counter((i, rule) for i, rule, _, _ in got.elements())
    assert found == Counter({(f"{rule} {i}", rule): 1 for rule in wanted for i in range(len(forms))}) + Counter({("twice", "all-rights-reserved"): 2})
    assert got["twice", "all-rights-reserved", 0, 1] == got["twice", "all-rights-reserved", 2, 3] == 1


ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
TOLD = [
    (BSD + ENDORSE, {"BSD-3-Clause"}), (BSD, {"BSD-2-Clause"}), (BSD + "\n" * 12 + "filler. " * 9 + BSD + ENDORSE, {"BSD-2-Clause", "BSD-3-Clause"}), (GPL, {"GPL-3.0-or-later"}), (GPL.replace("version 3", "version 2"), {"GPL-2.0-or-later"}), (ISC, {"ISC"}),
    ("This file is licensed under the MIT License.", {"MIT"}), ("A tool by me and Released under the MIT license, thanks", {"MIT"}), ("The MIT License (MIT)\n\nCopyright", {"MIT"}), ("This file is licensed\nunder the MIT\nLicense for now", {"MIT"}),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}), ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", {"Apache-2.0 WITH LLVM-exception"}), ("# SPDX-License-Identifier: GPL-2.0\n", {"GPL-2.0-only"}), ("/* SPDX-License-Identifier: GPL-3.0+ */", {"GPL-3.0-or-later"}),
    ("SPDX-License-Identifier: (lgpl-2.1 AND (MIT OR Zlib)) OR Nonsense", {"LGPL-2.1-only", "MIT", "Zlib"}), ("SPDX-License-Identifier: MIT or else.", {"MIT"}), ("SPDX-License-Identifier: MIT. More", {"MIT"}), ("SPDX-License-Identifier:", set()), ("SPDX-License-Identifier: MIT+ SPDX-License-Identifier=ISC", {"MIT", "ISC"}),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"CC-BY-4.0"}), ("under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License", {"CC-BY-NC-SA-3.0"}), ("We like the MIT license and all rights", set()),
    ("Our files are licensed under the GNU General Public License, version 3, as a whole", {"GPL-3.0-only"}), ("is licensed under the Mozilla Public License 2.0 (see below)", {"MPL-2.0"}), ("x" * 3_000_000 + " licensed under the MIT license " + "y " * 500_000, {"MIT"}),
]


def test_texts_as_people_write_them(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOLD)], "doc_id long, text string")
    rows = licenses.scan_licenses(df, "doc_id", "text").collect()
    got = {i: {r.license for r in rows if r.doc_id == i} for i in range(len(TOLD))}
    assert got == {i: want for i, (_, want) in enumerate(TOLD)}
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(TOLD[:-1])])
    told = con.sql(f"SELECT doc_id, license, reusable, rule, first_sentence, last_sentence FROM ({licenses.oracle()})").fetchall()
    assert sorted(told) == sorted(tuple(r) for r in rows if r.doc_id < len(TOLD) - 1)


def slowly(text, known, rules, gap):
    """Matches by trying every run of words and every chain."""
    pieces = re.split(r"[\r\n]+|(?<=[.;:])[ \t]+", text)
    words = [(w, i) for i, p in enumerate(pieces) for w in re.sub("[^a-z0-9]+", " ", p.lower()).split()]
    spans = []
    for name, sentence in known:
        n = len(sentence.split())
        for a in range(len(words) - n + 1):
            whole = (a == 0 or words[a - 1][1] != words[a][1]) and (a + n == len(words) or words[a + n][1] != words[a + n - 1][1])
            if [w for w, _ in words[a : a + n]] == sentence.split() and (whole or licenses.inside(name)):
                spans.append((a, a + n, name))
    spans = [(a, b, n) for a, b, n in spans if not any(c <= a and b <= d and d - c > b - a for c, d, _ in spans)]
    first = {}
    for a, b, n in sorted(spans):
        own = first.setdefault((words[a][1], n), [a, 0])
        own[1] = max(own[1], words[b - 1][1])
    ends = {}
    for rule, licence, free, steps in rules:
        for (p, n), (a, last) in first.items():
            at, begins, k, done = a, p, len(steps) - 1, n == steps[-1]
            while done and k:
                before = [(x, q, e) for (q, m), (x, e) in first.items() if m == steps[k - 1] and x < at]
                done = bool(before) and begins - max(before)[2] <= gap + 1
                if done:
                    at, begins, _ = max(before)
                    k -= 1
            if done:
                own = ends.setdefault((rule, begins), [licence, free, last])
                own[2] = min(own[2], last)
    names = {r: s for r, _, _, s in rules}
    return sorted((lic, free, r, f, last) for (r, f), (lic, free, last) in ends.items() if not any(g == f and len(names[q]) > len(names[r]) and names[q][: len(names[r])] == names[r] for q, g in ends))


def test_scanner_against_every_run_of_words():
    known, rules = [("a", "x y"), ("b", "x y z"), ("c", "z z"), ("d-short", "y z"), ("e", "w")], [("r", "L", True, ("a", "b")), ("s", "M", False, ("a",)), ("t", "N", True, ("a", "b", "c")), ("u", "O", True, ("d-short",)), ("v", "P", True, ("e", "e"))]
    scanner, rng = licenses.Scanner(known, rules, 1), random.Random(6)
    seen = Counter()
    for _ in range(4000):
        text = "".join(rng.choice(["x ", "y ", "z ", "x y\n", "z z\n", "x y z. ", "w\n", "\n", "; ", "q "]) for _ in range(rng.randrange(1, 14)))
        got = scanner.matches(text)
        assert got == slowly(text, known, rules, 1), text
        seen.update(r for _, _, r, _, _ in got)
    assert set(seen) == set("rstuv")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_registered_scan_against_every_run_of_words(spark):
    from siltline.llm.queries import queries

    sf, (known, rules) = "/root/testdata/sf0.001", licenses.knowledge()
    known = [(n, s) for n, s in known if not licenses.is_tag(n)]
    got = {}
    for r in queries()["op9_licenses"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    some = [(i, t) for i, t in texts if i in got or i % 10 == 0]
    assert all(sorted(got.get(i, [])) == slowly(t, known, rules, 3) for i, t in some if "SPDX" not in t) and got


def test_odd_spaces_and_own_knowledge(spark):
    rows = [(1, "All  rights\treserved."), (2, "x\nAll\u00a0rights reserved"), (3, "Hoc opus Est!"), (4, "a b"), (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {r.doc_id for r in licenses.scan_licenses(df, "id", "text").collect()} == {1, 2}
    own = licenses.scan_licenses(df, "id", "text", {"opus": "Hoc opus est.", "short": "a b"}, [("own", "L", True, ("opus",)), ("two", "M", True, ("short",))])
    assert {(r.doc_id, r.rule) for r in own.collect()} == {(3, "own"), (4, "two")}
    assert licenses.scan_licenses(df, "id", "text", {}, licenses.RULES).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_queries_against_sql(spark):
    from siltline.llm.queries import oracle_sql, queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, sf)
        columns = sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), name
