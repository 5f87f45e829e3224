"""Licence scans: known sentences first, ordered rules second.

A text is cut into pieces (at line breaks, and at spaces after a full stop, semicolon or colon) and
normalised to lower-case words and numbers. Known sentences are found by one automaton over a text's
words, wherever lines break. Sentences of licence texts count where they fill whole pieces, one or
several; notices that name a licence also count inside a piece ("this file is licensed under the MIT
License, thanks"). A sentence inside a longer one does not count. Tags ``SPDX-License-Identifier`` are
read as expressions: AND, OR, WITH, parentheses, a plus, and identifiers of former versions of the
list; each operand that is known gives a match, others are passed over.

A rule names sentences that must follow one another in order, with at most ``gap`` other pieces between
two: each occurrence of a step follows the nearest earlier one of the step before, so repeated sentences
and other sentences between hide nothing. A match is a chain from a first to a last step. Chains that
share a sentence share their first, and only the one that ends first counts. A rule whose sentences
begin a longer rule's yields to that where both match from one piece. Positions are those of pieces.

Texts that hold none of a few words, one of which is in each known sentence, are set aside before
they are cut. Null and empty texts match nothing. Repeated rows are each scanned, and a null id is
returned as null. A very long text is scanned whole in one task's memory. Names of other columns do not matter.

``SQL`` states all of this for the registered query.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import bounded_batches, thrifty

#: The sentences of licence notices and texts, as normalised, by identifier.
SENTENCES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-notice-the-license": "licensed under the apache license version 2 0 the license",
    "apache-2.0-may-not-use": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-2.1-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gnu-library-no-warranty": "this library is distributed in the hope that it will be useful but without any warranty",
    "gnu-copy": "you should have received a copy of the gnu general public license along with this program",
    "gnu-lesser-copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "gnu-affero-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "mpl-2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "public-domain": "dedicated to the public domain",
    "cc0-waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-notice": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl-2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "wtfpl-do": "you just do what the fuck you want to",
    "cddl-subject": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "ofl-1.1-notice": "this font software is licensed under the sil open font license version 1 1",
    "ofl-1.1-grant": "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions",
    "ncsa-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "eupl-notice": "licensed under the eupl",
    "confidential": "unauthorized copying of this file via any medium is strictly prohibited",
    "proprietary": "proprietary and confidential",
    "all-rights-reserved": "all rights reserved",
}
#: Further wordings of these sentences, as the licence texts have them in full.
WORDINGS = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2.0-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("apache-2.0-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
)
#: Public identifiers of licences, whether text may be reused under them, and the names that notices use.
NAMED = {
    "0BSD": (True, "bsd zero clause license"), "AFL-3.0": (True, "academic free license version 3 0"), "AGPL-3.0-only": (True, "gnu affero general public license version 3"), "AGPL-3.0-or-later": (True, None), "Apache-1.1": (True, "apache software license version 1 1"),
    "Apache-2.0": (True, "apache license 2 0"), "APSL-2.0": (True, "apple public source license version 2 0"), "Artistic-2.0": (True, "artistic license 2 0"), "BSD-2-Clause": (True, "bsd 2 clause license"), "BSD-3-Clause": (True, "bsd 3 clause license"), "BSD-4-Clause": (True, None),
    "BSL-1.0": (True, "boost software license version 1 0"), "BUSL-1.1": (False, "business source license 1 1"), "CC0-1.0": (True, "cc0 1 0 universal"), "CDDL-1.0": (True, "common development and distribution license version 1 0"), "CDDL-1.1": (True, None), "CECILL-2.1": (True, None), "CPL-1.0": (True, "common public license version 1 0"),
    "ECL-2.0": (True, "educational community license version 2 0"), "EPL-1.0": (True, "eclipse public license 1 0"), "EPL-2.0": (True, "eclipse public license 2 0"), "EUPL-1.2": (True, "european union public licence v 1 2"), "GFDL-1.3-only": (True, "gnu free documentation license version 1 3"), "GPL-2.0-only": (True, "gnu general public license version 2"), "GPL-2.0-or-later": (True, None),
    "GPL-3.0-only": (True, None), "GPL-3.0-or-later": (True, None), "HPND": (True, None), "IPL-1.0": (True, "ibm public license version 1 0"), "ISC": (True, "isc license"), "LGPL-2.1-only": (True, "gnu lesser general public license version 2 1"), "LGPL-2.1-or-later": (True, None), "LGPL-3.0-only": (True, "gnu lesser general public license version 3"), "LGPL-3.0-or-later": (True, None), "LPPL-1.3c": (True, None),
    "MIT": (True, None), "MIT-0": (True, "mit no attribution license"), "MPL-1.1": (True, "mozilla public license 1 1"), "MPL-2.0": (True, "mozilla public license 2 0"), "MS-PL": (True, "microsoft public license"), "MS-RL": (True, "microsoft reciprocal license"), "NCSA": (True, None), "ODbL-1.0": (True, "open data commons open database license"), "OFL-1.1": (True, "sil open font license version 1 1"), "OSL-3.0": (True, "open software license version 3 0"),
    "PostgreSQL": (True, "postgresql license"), "PSF-2.0": (True, "python software foundation license version 2"), "Ruby": (True, "ruby license"), "SSPL-1.0": (False, "server side public license version 1"), "Unlicense": (True, None), "UPL-1.0": (True, "universal permissive license v 1 0"), "Vim": (True, None), "WTFPL": (True, None), "Zlib": (True, "zlib license"), "ZPL-2.1": (True, "zope public license version 2 1"),
}
#: Creative Commons terms and versions: those with "nc" or "nd" do not allow reuse.
TERMS, VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("2.0", "2.5", "3.0", "4.0")
#: How a Creative Commons licence is spelled out in notices.
SPELLED = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
#: Identifiers of former versions of the list, and what they mean now.
FORMER = {
    "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later",
    "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later", "GFDL-1.3": "GFDL-1.3-only",
}
#: Sentences that name a licence and count inside a piece; so do all NOTICES.
INSIDE = ("apache-2.0-notice", "mit-notice", "mit-notice-licensed", "mit-title", "gpl-3-notice", "boost-notice", "ofl-1.1-notice", "eupl-notice")
#: How a notice names its licence.
NOTICES = ("licensed under the {}", "released under the {}", "distributed under the {}", "this work is licensed under the {}", "this project is licensed under the {}", "this software is licensed under the {}")


def named_rules() -> tuple[dict[str, str], list[tuple[str, str, bool, tuple[str, ...]]]]:
    """Sentences and rules of one sentence for tags and notices that name a licence."""
    sentences, rules = {}, []

    def add(name: str, licence: str, free: bool, sentence: str) -> None:
        sentences[name] = normal(sentence)
        rules.append((name, licence, free, (name,)))

    for licence, (free, title) in NAMED.items():
        add(f"{licence.lower()}-tag", licence, free, f"SPDX-License-Identifier: {licence}")
        for i, notice in enumerate(NOTICES if title else ()):
            add(f"{licence.lower()}-notice-{i}", licence, free, notice.format(title))
    for terms in TERMS:
        for version in VERSIONS:
            licence, free = f"CC-{terms.replace(' ', '-').upper()}-{version}", "nc" not in terms and "nd" not in terms
            add(f"{licence.lower()}-tag", licence, free, f"SPDX-License-Identifier: {licence}")
            add(f"{licence.lower()}-short", licence, free, f"licensed under cc {terms} {version}")
            for i, article in enumerate(("", "a ", "the ")):
                add(f"{licence.lower()}-notice-{i}", licence, free, f"under {article}creative commons {' '.join(SPELLED[t] for t in terms.split())} {version}")
    for i, notice in enumerate(NOTICES[:3]):
        add(f"gpl-3.0-only-notice-{i}", "GPL-3.0-only", True, notice.format("gnu general public license version 3"))
    return sentences, rules


#: Rule, licence, whether text may be reused, and the sentences in order.
RULES = (
    ("apache-2.0-short", "Apache-2.0", True, ("apache-2.0-notice",)),
    ("apache-2.0-header", "Apache-2.0", True, ("apache-2.0-notice-the-license", "apache-2.0-may-not-use", "apache-2.0-copy")),
    ("mit-short", "MIT", True, ("mit-notice",)),
    ("mit-short-licensed", "MIT", True, ("mit-notice-licensed",)),
    ("mit-title", "MIT", True, ("mit-title",)),
    ("mit-text", "MIT", True, ("mit-grant", "mit-keep", "as-is")),
    ("gpl-3.0-short", "GPL-3.0-only", True, ("gpl-3-notice",)),
    ("gpl-3.0-header", "GPL-3.0-or-later", True, ("gpl-3-free", "gpl-no-warranty")),
    ("bsd-2-clause-text", "BSD-2-Clause", True, ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("bsd-3-clause-text", "BSD-3-Clause", True, ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("isc-text", "ISC", True, ("isc-grant", "isc-as-is")),
    ("0bsd-text", "0BSD", True, ("zero-bsd-grant", "isc-as-is")),
    ("ncsa-text", "NCSA", True, ("ncsa-grant", "bsd-source", "bsd-binary")),
    ("gpl-2.0-header", "GPL-2.0-or-later", True, ("gpl-2-free", "gpl-no-warranty")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", True, ("lgpl-2.1-free", "gnu-library-no-warranty")),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", True, ("lgpl-3-free", "gnu-library-no-warranty")),
    ("agpl-3.0-header", "AGPL-3.0-or-later", True, ("agpl-3-free", "gpl-no-warranty")),
    ("mpl-2.0-header", "MPL-2.0", True, ("mpl-2-subject", "mpl-2-copy")),
    ("unlicense-text", "Unlicense", True, ("unlicense-free", "unlicense-anyone")),
    ("public-domain-notice", "public-domain", True, ("public-domain",)),
    ("cc0-text", "CC0-1.0", True, ("cc0-waiver",)),
    ("zlib-text", "Zlib", True, ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("bsl-1.0-short", "BSL-1.0", True, ("boost-notice",)),
    ("bsl-1.0-text", "BSL-1.0", True, ("boost-grant",)),
    ("epl-2.0-header", "EPL-2.0", True, ("epl-2-notice",)),
    ("wtfpl-text", "WTFPL", True, ("wtfpl-do",)),
    ("cddl-header", "CDDL-1.0", True, ("cddl-subject", "apache-2.0-may-not-use")),
    ("postgresql-text", "PostgreSQL", True, ("postgresql-grant",)),
    ("ofl-1.1-short", "OFL-1.1", True, ("ofl-1.1-notice",)),
    ("ofl-1.1-text", "OFL-1.1", True, ("ofl-1.1-grant",)),
    ("eupl-short", "EUPL-1.2", True, ("eupl-notice",)),
    ("proprietary-notice", "proprietary", False, ("confidential", "proprietary")),
    ("all-rights-reserved", "proprietary", False, ("all-rights-reserved",)),
)
CUT = r"[\r\n]+|(?<=[.;:])[ \t]+"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def knowledge() -> tuple[list[tuple[str, str]], list[tuple[str, str, bool, tuple[str, ...]]]]:
    """All known sentences by name, and all rules."""
    more, rules = named_rules()
    return [*SENTENCES.items(), *more.items(), *WORDINGS], [*RULES, *rules]


def anchors(known: Iterable[str]) -> list[str]:
    """A few words, long if possible, of which each normalised sentence holds at least one."""
    left, found = {s for s in known if s}, []
    while left:
        words = {w for s in left for w in s.split() if len(w) >= min(6, max(map(len, s.split())))}
        found.append(max(sorted(words), key=lambda w: (sum(w in s for s in left), len(w))))
        left = {s for s in left if found[-1] not in s}
    return found


IDENTIFIER = r"[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?"
OPERAND = rf"\(*{IDENTIFIER}\+?(?:[ \t]+WITH[ \t]+{IDENTIFIER})?\)*"
EXPRESSION = rf"{OPERAND}(?:[ \t]+(?:AND|OR)[ \t]+{OPERAND})*"
TAG = rf"\b(?i:spdx[-\s]+license[-\s]+identifier)\s*[:=]?[ \t]*"


def is_tag(name: str) -> bool:
    return name.endswith("-tag")


def inside(name: str) -> bool:
    """Whether a sentence counts within a piece that has other words."""
    return name in INSIDE or bool(re.search(r"-(notice-\d+|short)$", name))


def tag_names() -> dict[str, str]:
    """The name of the tag's sentence by identifier, in lower case; a plus that says nothing new is passed over."""
    listed = [*NAMED, *(f"CC-{t.replace(' ', '-').upper()}-{v}" for t in TERMS for v in VERSIONS)]
    found = {f"{x.lower()}{plus}": f"{x.lower()}-tag" for x in listed for plus in ("+", "")}
    return found | {old.lower(): f"{now.lower()}-tag" for old, now in FORMER.items()}


class Scanner:
    """Finds matches in one text; made once a task from what is known."""

    def __init__(self, known: list[tuple[str, str]], rules: Iterable[tuple[str, str, bool, tuple[str, ...]]], gap: int) -> None:
        self.gap, self.machine, self.rules = gap, ahocorasick.Automaton(), list(rules)
        by_sentence: dict[str, set[str]] = {}
        for name, sentence in known:
            if sentence and not is_tag(name):
                by_sentence.setdefault(sentence, set()).add(name)
        for sentence, names in by_sentence.items():
            self.machine.add_word(f" {sentence} ", (len(sentence.split()), sorted(names)))
        if by_sentence:
            self.machine.make_automaton()
        self.any = bool(by_sentence)
        names = {n for n, _ in known}
        self.tags = {x: n for x, n in tag_names().items() if n in names}
        self.of: dict[str, list[tuple[int, int]]] = {}
        for i, (_, _, _, own) in enumerate(self.rules):
            for step, name in enumerate(own):
                self.of.setdefault(name, []).append((i, step))
        self.longer = {i: [j for j, b in enumerate(self.rules) if len(b[3]) > len(a[3]) and b[3][: len(a[3])] == a[3]] for i, a in enumerate(self.rules)}

    def occurrences(self, pieces: list[str]) -> list[tuple[int, int, int, str]]:
        """(start, position, last, name) of known sentences, by words and pieces."""
        words, piece_of = [], []
        for i, piece in enumerate(pieces):
            own = normal(piece).split()
            words += own
            piece_of += [i] * len(own)
        if not words or not self.any:
            return []
        places, at = [], 0
        for w in words:
            places.append(at)
            at += len(w) + 1
        found = []
        for end, (n, names) in self.machine.iter(f" {' '.join(words)} "):
            stop = bisect_right(places, end - 1)
            start = stop - n
            fills = (start == 0 or piece_of[start - 1] != piece_of[start]) and (stop == len(words) or piece_of[stop] != piece_of[stop - 1])
            found += [(start, stop, name) for name in names if fills or inside(name)]
        found.sort(key=lambda x: (x[0], -x[1], x[2]))
        kept: dict[tuple[int, str], list[int]] = {}
        reach, span = -1, None
        for start, stop, name in found:
            if stop <= reach and (start, stop) != span:
                continue
            if stop > reach:
                reach, span = stop, (start, stop)
            own = kept.setdefault((piece_of[start], name), [start, 0])
            own[1] = max(own[1], piece_of[stop - 1])
        return sorted((start, position, last, name) for (position, name), (start, last) in kept.items())

    def tagged(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(name, what follows the licence, position, last) of each operand of the tags' expressions."""
        for m in re.finditer(f"{TAG}({EXPRESSION})", text):
            position = len(re.findall(CUT, text[: m.start()]))
            last = position + len(re.findall(CUT, text[m.start() : m.end()]))
            for operand in re.split(r"[ \t]+(?:AND|OR)[ \t]+", m[1]):
                identifier, _, exception = re.sub(r"[()]", "", operand).partition("WITH")
                name = self.tags.get(identifier.strip().lower())
                if name:
                    yield name, f" WITH {exception.strip()}" if exception else "", position, last

    def matches(self, text: str) -> list[tuple[str, bool, str, int, int]]:
        """(license, reusable, rule, first, last)"""
        by_rule: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, position, last, name in self.occurrences(re.split(CUT, text)):
            for i, step in self.of.get(name, ()):
                by_rule.setdefault(i, []).append((start, step, position, last))
        ends: dict[int, dict[int, int]] = {}
        for i, own in by_rule.items():
            nearest: dict[int, tuple[int, int | None]] = {}
            for _, step, position, last in sorted(own, key=lambda x: (x[0], -x[1])):  # nothing follows itself
                before = nearest.get(step - 1)
                first = position if step == 0 else before[1] if before and position - before[0] <= self.gap + 1 else None
                nearest[step] = (last, first)
                if step == len(self.rules[i][3]) - 1 and first is not None:
                    into = ends.setdefault(i, {})
                    into[first] = min(last, into.get(first, last))
        out = {(self.rules[i][1], self.rules[i][2], self.rules[i][0], first, last) for i, own in ends.items() for first, last in own.items() if not any(first in ends.get(j, ()) for j in self.longer[i])}
        for name, more, position, last in self.tagged(text):
            for i, _ in self.of.get(name, ()):
                rule, licence, free, own = self.rules[i]
                if len(own) == 1:
                    out.add((licence + more, free, rule, position, last))
        return sorted(out)


def scan_licenses(df: DataFrame, key: str, text: str, known: dict[str, str] | None = None, rules=None, gap: int = 3) -> DataFrame:
    """doc_id, license, reusable, rule, first_sentence, last_sentence: one row per match of a rule."""
    bounded_batches(df.sparkSession)
    own_known, own_rules = knowledge()
    known = own_known if known is None else [(k, normal(v)) for k, v in known.items()]
    rules = own_rules if rules is None else rules
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("t"))
    rows = rows.where(F.lower("t").rlike("|".join(anchors(s for _, s in known)) or "(?!)"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    @thrifty
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, rules, gap)
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch["t"].to_pylist()):
                own = scanner.matches(t)
                at += [i] * len(own)
                found += own
            columns = [pa.array([r[c] for r in found], t) for c, t in enumerate((pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *columns], ["doc_id", "license", "reusable", "rule", "first_sentence", "last_sentence"])

    return rows.mapInArrow(work, f"doc_id {kind}, license string, reusable boolean, rule string, first_sentence int, last_sentence int")


#: Pieces are cut at a sign put in, as DuckDB cannot look behind; 2, 3 and 4 mark a tag, its expression and that one's end.
#: Words have two spaces between, so that sentences which follow each other share none.
SQL = r"""
WITH RECURSIVE known(name, sentence, inside) AS (VALUES {known}),
steps(rule, license, reusable, name, step, steps) AS (VALUES {steps}),
yields(rule, longer) AS (VALUES {yields}),
tags(id, name) AS (VALUES {tags}),
pieces AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '({tag})({expression})', chr(2) || '\1' || chr(3) || '\2' || chr(4), 'g'), '[\r\n]+', chr(1), 'g'), '([.;:])[ \t]+', '\1' || chr(1), 'g'), chr(1)) AS parts
  FROM documents WHERE text IS NOT NULL
),
plain AS (SELECT doc_id, list_transform(parts, lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))) AS ps FROM pieces),
counted AS (SELECT doc_id, ' ' || replace(array_to_string(list_filter(ps, lambda p: p <> ''), ' '), ' ', '  ') || ' ' AS w, list_transform(ps, lambda p: CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END) AS ns FROM plain),
hits AS (SELECT doc_id, name, inside, ns, len(string_split(sentence, ' ')) AS k, string_split(w, ' ' || replace(sentence, ' ', '  ') || ' ') AS seg FROM counted JOIN known ON contains(w, ' ' || replace(sentence, ' ', '  ') || ' ')),
sums AS (SELECT doc_id, list_transform(range(len(ns) + 1), lambda i: coalesce(list_sum(ns[1:i]), 0)) AS cum FROM (SELECT DISTINCT doc_id, ns FROM hits)),
placed AS (
  SELECT doc_id, name, inside, k, list_sum(list_transform(seg[1:j], lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> '')))) + (j - 1) * k AS start FROM (SELECT *, unnest(range(1, len(seg))) AS j FROM hits)
),
valid AS (SELECT doc_id, name, start, start + k AS stop, cum FROM placed JOIN sums USING (doc_id) WHERE inside OR list_contains(cum, start) AND list_contains(cum, start + k)),
longest AS (SELECT * FROM valid v WHERE NOT EXISTS (FROM valid o WHERE o.doc_id = v.doc_id AND o.start <= v.start AND o.stop >= v.stop AND o.stop - o.start > v.stop - v.start)),
occurs AS (
  SELECT doc_id, name, position, min(start) AS start, max(last) AS last
  FROM (SELECT doc_id, name, start, len(list_filter(cum[2:], lambda c: c <= start)) AS position, len(list_filter(cum[2:], lambda c: c < stop)) AS last FROM longest) GROUP BY ALL
),
met AS (SELECT doc_id, start, position, last, step, steps, rule, license, reusable FROM occurs JOIN steps USING (name)),
-- Of each step, the nearest earlier one of the step before.
follows AS (
  SELECT b.doc_id, b.rule, b.start, b.step, b.position, max(a.start) AS before
  FROM met b JOIN met a ON a.doc_id = b.doc_id AND a.rule = b.rule AND a.step = b.step - 1 AND a.start < b.start
  GROUP BY ALL
),
chain AS (
  SELECT doc_id, rule, start, step, position AS first, last FROM met WHERE step = 1
  UNION ALL
  SELECT f.doc_id, f.rule, f.start, f.step, c.first, m.last
  FROM chain c JOIN follows f ON f.doc_id = c.doc_id AND f.rule = c.rule AND f.step = c.step + 1 AND f.before = c.start JOIN met m ON m.doc_id = f.doc_id AND m.rule = f.rule AND m.step = f.step AND m.start = f.start
  WHERE f.position - c.last <= 4
),
ends AS (SELECT doc_id, license, reusable, rule, first, min(chain.last) AS last FROM chain JOIN met USING (doc_id, rule, start, step) WHERE step = steps GROUP BY ALL),
split AS (SELECT doc_id, i - 1 AS last, string_split(parts[i], chr(3)) AS seg FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pieces) WHERE contains(parts[i], chr(3))),
tagged AS (
  SELECT doc_id, last, last - CASE WHEN contains(seg[j], chr(2)) THEN 0 ELSE 1 END AS first, regexp_split_to_array(regexp_replace(string_split(seg[j + 1], chr(4))[1], '[()]', '', 'g'), '[ \t]+(?:AND|OR)[ \t]+') AS operands
  FROM (SELECT *, unnest(range(1, len(seg))) AS j FROM split)
),
operands AS (SELECT doc_id, first, last, string_split_regex(unnest(operands), '[ \t]+WITH[ \t]+') AS o FROM tagged)
SELECT doc_id, license, reusable, rule, CAST(first AS INTEGER) AS first_sentence, CAST(last AS INTEGER) AS last_sentence
FROM ends WHERE NOT EXISTS (FROM yields y JOIN ends l ON l.rule = y.longer WHERE y.rule = ends.rule AND l.doc_id = ends.doc_id AND l.first = ends.first)
UNION
SELECT doc_id, license || CASE WHEN len(o) > 1 THEN ' WITH ' || o[2] ELSE '' END, reusable, rule, CAST(first AS INTEGER), CAST(last AS INTEGER) FROM operands JOIN tags ON tags.id = lower(trim(o[1])) JOIN steps USING (name)
"""


def oracle() -> str:
    sentences, rules = knowledge()
    known = ", ".join(f"('{k}', '{v}', {str(inside(k)).lower()})" for k, v in sentences if not is_tag(k))
    steps = ", ".join(f"('{r}', '{lic}', {str(ok).lower()}, '{s}', {i + 1}, {len(own)})" for r, lic, ok, own in rules for i, s in enumerate(own))
    yields = ", ".join(f"('{a[0]}', '{b[0]}')" for a in rules for b in rules if len(b[3]) > len(a[3]) and b[3][: len(a[3])] == a[3])
    tags = ", ".join(f"('{x}', '{n}')" for x, n in tag_names().items())
    return SQL.format(known=known, steps=steps, yields=yields, tags=tags, tag=TAG, expression=EXPRESSION.replace("{", "{{").replace("}", "}}"))
