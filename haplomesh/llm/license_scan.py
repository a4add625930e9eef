"""License scan by sentence rules (operator 2).

A text is cut into sentences; a sentence is normalised (case, white space,
punctuation, years and copyright holders) and mapped to a known sentence
identifier. The sequence of identifiers, with unknown sentences between them
kept as gaps, is matched against ordered rules: a rule is a sequence of
identifiers that must follow one another within a few unknown sentences; rules
are tried in order and a matched identifier is used once.

Odd input: null, empty and licence-free texts give an empty list; a repeated
notice is reported for each place; known sentences that no rule uses are
reported under their own identifier with ``?``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame

from .common import Rows, id_and_text, small_batches

GAP = 2  # unknown sentences allowed between two identifiers of a rule

# Sentence identifiers and the normalised sentences that they name.
# <v> is a version number, <h> a holder or year list.
SENTENCES = {
    "mit-short": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache-short": "licensed under the apache license version <v>",
    "apache-terms": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-work": "this work is licensed under the gnu general public license version <v>",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <v> of the license or at your option any later version",
    "gpl-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version <v> as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-work": "this work is licensed under the gnu lesser general public license version <v>",
    "bsd-forms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-short": "licensed under the bsd license",
    "cc-by-nc": "licensed under cc by nc <v>",
    "cc-by-sa": "licensed under cc by sa <v>",
    "cc-by": "licensed under cc by <v>",
    "cc0": "licensed under cc0 <v>",
    "copyright": "copyright <h>",
    "reserved": "all rights reserved",
}
_GNU = (("gpl", "GPL", "General"), ("lgpl", "LGPL", "Lesser General"), ("lgpl", "LGPL", "Library General"), ("agpl", "AGPL", "Affero General"))
# The whole sentences of the standard texts, as they are cut there, by identifier.
WHOLE = [
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-short", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-url", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-asis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    *(("bsd-liable", f"IN NO EVENT SHALL THE COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;") for who in ("HOLDER", "HOLDERS", "OWNER")),
    ("bsd-damage", "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-asis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("mpl-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-form", "subject to the terms of the Mozilla Public License, v."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    *((f"{k}-{name}", text.format(it=it, full=full)) for k, _, full in _GNU for it in ("program", "library", "software") for name, text in (
        ("free", "This {it} is free software: you can redistribute it and/or modify it under the terms of the GNU {full} Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        ("is", "This {it} is free software;"),
        ("terms", "you can redistribute it and/or modify it under the terms of the GNU {full} Public License as published by the Free Software Foundation;"),
        ("later", "either version 2 of the License, or (at your option) any later version."),
        ("only", "you can redistribute it and/or modify it under the terms of the GNU {full} Public License version 2 as published by the Free Software Foundation."),
        ("only", "you can redistribute it and/or modify it under the terms of the GNU {full} Public License, version 2, as published by the Free Software Foundation;"),
        ("only", "This {it} is free software: you can redistribute it and/or modify it under the terms of the GNU {full} Public License version 3 as published by the Free Software Foundation."),
        ("hope", "This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
        ("even", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
        ("see", "See the GNU {full} Public License for more details."),
        ("copy", "You should have received a copy of the GNU {full} Public License along with this {it}."),
        ("copy", "You should have received a copy of the GNU {full} Public License along with this {it};"),
    )),
]
# Sentences that are cut as one where no empty line or line's beginning parts them (comments, texts in one line).
JOINED = (
    ("mit-grant", "mit-notice"), ("apache-copy", "apache-url"), ("apache-copy", "apache-url", "apache-asis"), ("apache-url", "apache-asis"), ("bsd-forms", "bsd-source"),
)


def _tails(licence: str, *ids: str, least: int) -> tuple:
    """Rules of the whole sequence and of its beginnings of ``least`` identifiers or more, the longest first."""
    return tuple((licence, ids[:n]) for n in range(len(ids), least - 1, -1))


def _gnu(key: str, name: str) -> tuple:
    """Rules of one GNU licence's notice; sentences that the licences share have the first one's identifiers."""
    end = ("gpl-hope", "gpl-even", f"{key}-see", f"{key}-copy")
    return (
        *_tails(name + "-{v}-or-later", "gpl-is", f"{key}-terms", "gpl-later", *end, least=3),
        *_tails(name + "-{v}-or-later", f"{key}-free", *end, least=1),
        *_tails(name + "-{v}", "gpl-is", f"{key}-only", *end, least=2),
        *_tails(name + "-{v}", f"{key}-only", *end, least=1),
    )


# Ordered rules, the more specific ones first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "mit-liable")),
    *_tails("Apache-{v}", "apache-short", "apache-terms", "apache-copy", "apache-url", "apache-asis", "apache-see", least=3),
    ("Apache-{v}", ("apache-short", "apache-terms", "apache-copy", "apache-asis", "apache-see")),
    *_gnu("gpl", "GPL"),
    *_gnu("lgpl", "LGPL"),
    *_gnu("agpl", "AGPL"),
    *_tails("BSD-3-Clause", "bsd-forms", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis", "bsd-liable", "bsd-damage", least=4),
    *_tails("BSD-2-Clause", "bsd-forms", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liable", "bsd-damage", least=4),
    *_tails("ISC", "isc-grant", "isc-asis", least=1),
    ("MPL-2.0", ("mpl-form",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-{v}", ("apache-short", "apache-terms", "apache-copy", "apache-asis")),
    ("Apache-{v}", ("apache-short", "apache-terms")),
    ("GPL-{v}-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-{v}-or-later", ("gpl-free",)),
    ("GPL-{v}", ("gpl-only", "gpl-hope")),
    ("GPL-{v}", ("gpl-only",)),
    ("BSD-2-Clause", ("bsd-forms", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-under",)),
    ("Apache-{v}", ("apache-short",)),
    ("GPL-{v}", ("gpl-work",)),
    ("LGPL-{v}", ("lgpl-work",)),
    ("BSD", ("bsd-short",)),
    ("CC-BY-NC-{v}", ("cc-by-nc",)),
    ("CC-BY-SA-{v}", ("cc-by-sa",)),
    ("CC-BY-{v}", ("cc-by",)),
    ("CC0-{v}", ("cc0",)),
    ("proprietary", ("copyright", "reserved")),
    ("proprietary", ("reserved",)),
)
#: Every known sentence holds one of these, so texts and sentences without them are skipped.
CUES = ("licen", "copyright", "permission", "warrant", "rights reserved", "redistribut", "merchantab", "public domain")
#: A sentence ends at a full stop, mark or semicolon before white space, at a line's end before another
#: line that begins a notice, or at an empty line.
ENDS = re.compile(r"(?<=[.!?;])\s+|\n\s*\n|\n(?=\s*(?:Copyright|Licensed|Released|This|Permission|The above|All rights|Redistribut|You may|Unless)\b)")
VERSION = re.compile(r"\b(?:v(?:ersion)?\s*)?(\d+(?:\.\d+)*)\b")
HOLDER = re.compile(r"copyright\b.*")
NAMES = re.compile(r"^(?:neither the names? of .* )?nor the names of")
PLAIN = re.compile(r"[^a-z0-9<>.]+")
CUE = re.compile("|".join(CUES))


def normalise(sentence: str) -> tuple[str, str]:
    """(normalised sentence, its last version number or '')."""
    s = PLAIN.sub(" ", sentence.lower()).strip(" .")
    if s.startswith("copyright "):
        return "copyright <h>", ""
    s = NAMES.sub("neither the name of <h> nor the names of", s)
    version = ""
    found = VERSION.findall(s)
    if found:
        version = found[-1]
        s = re.sub(r"\b" + re.escape(version) + r"\b", "<v>", s)
    s = s.replace(".", " ")
    return " ".join(s.split()), version


_KNOWN: dict[str, tuple[str, ...]] = {}
for _name, _text in WHOLE:
    _KNOWN.setdefault(normalise(_text)[0], (_name,))
_KNOWN |= {text: (name,) for name, text in SENTENCES.items()}
for _names in JOINED:
    for _texts in product(*([t for n, t in WHOLE if n == name] + [t for n, t in SENTENCES.items() if n == name] for name in _names)):
        _KNOWN.setdefault(normalise(" ".join(_texts))[0], _names)


def sentences(text: str):
    """(start, end, sentence) in code points."""
    at = 0
    for m in ENDS.finditer(text):
        if m.start() > at:
            yield at, m.start(), text[at : m.start()]
        at = m.end()
    if at < len(text):
        yield at, len(text), text[at:]


def identify(text: str) -> list[tuple[int, str, str, int, int]]:
    """(place among the sentences, identifier, version, start, end) of the known sentences."""
    out = []
    for k, (a, b, s) in enumerate(sentences(text)):
        low = s.lower()
        if CUE.search(low) or "unless required" in low or "you may" in low or "free software" in low or "cc" in low or "such damage" in low or "public domain" in low:
            norm, version = normalise(s)
            out.extend((k, name, version, a, b) for name in _KNOWN.get(norm, ()))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) of every notice, by start."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return []
    known, found = identify(text), []
    free = [True] * len(known)
    for licence, rule in RULES:
        i = 0
        while i < len(known):
            took = []
            if free[i] and known[i][1] == rule[0]:
                took = [i]
                for want in rule[1:]:
                    j = took[-1] + 1
                    while j < len(known) and not free[j]:
                        j += 1
                    if j < len(known) and known[j][1] == want and known[j][0] - known[took[-1]][0] <= GAP + 1:
                        took.append(j)
                    else:
                        break
            if len(took) == len(rule):
                version = next((known[j][2] for j in took if known[j][2]), "")
                found.append((licence.format(v=version), known[took[0]][3], known[took[-1]][4]))
                for j in took:
                    free[j] = False
            i += 1
    found += [(f"{known[i][1]}?", known[i][3], known[i][4]) for i in range(len(known)) if free[i]]
    return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_notices, licenses, spans`` of every document.

    ``licenses``: distinct names, sorted and comma-joined; ``spans``:
    ``name:start:end`` by start, comma-joined.
    """
    rows = Rows(doc_id="long", n_notices="long", licenses="string", spans="string")

    def run(batches):
        for batch in small_batches(batches):
            found = [scan(t) for t in batch.column(1).to_pylist()]
            yield rows.batch(
                batch.column(0),
                [len(f) for f in found],
                [",".join(sorted({n for n, _, _ in f})) for f in found],
                [",".join(f"{n}:{a}:{b}" for n, a, b in f) for f in found],
            )

    return id_and_text(docs).mapInArrow(run, rows.schema)
