"""Operator 7: license scans by template markup compiled into token automata.

A template is a license wording with two kinds of region, after the markup that
license lists use: ``[[...]]`` may be absent and may hold further regions, and ``<<n>>``
stands for 0 to n words of any kind (names, years, versions). It compiles into an
automaton over words whose states are sets of positions in the wording; a text is
accepted where all mandatory words stand in order, exactly. The base phrases are
templates without regions.

Words are runs of ASCII letters and digits and of other characters above ASCII, with
A-Z lower-cased, so punctuation and layout never matter. The score is 1 where a whole
license or a license's whole notice was accepted, so that a rider amid its wording, or a
clause that is missing, keeps it from 1; 0.8 for a reference to a license, 0.6 for the
opening of one alone, 0.5 for base phrases alone and 0 without any. Null and empty texts
have no words; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Label -> base phrase.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# The wordings of licenses and of their notices, with their optional and replaceable regions.
_NO_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_DEALINGS = "arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "[[3]] neither the name of <<8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version"
_GPL_END = (
    "of the license [[or [[at your option]] any later version]] this program is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
)
LICENSES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and [[its]] associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        f"the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_NO_WARRANTY} and noninfringement "
        f"in no event shall the <<8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise {_DEALINGS}"
    ),
    "isc": (
        "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2": f"{_BSD} {_BSD_END}",
    "bsd-3": f"{_BSD} {_BSD_NAMES} {_BSD_END}",
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the [[author]] [[authors]] be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
        f"{_NO_WARRANTY} and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise {_DEALINGS}"
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
        "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part "
        "and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
        f"{_NO_WARRANTY} title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise {_DEALINGS}"
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<1>> www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-2": f"{_GPL} 2 {_GPL_END}",
    "gpl-3": f"{_GPL} 3 {_GPL_END}",
}

#: (label, score, wording): whole licenses and notices, openings, and references.
TEMPLATES = (
    *((label, 1.0, wording) for label, wording in LICENSES.items()),
    ("mit", 0.6, "permission is hereby granted free of charge to any person obtaining a copy of this software and [[its]] associated documentation files the software to deal in the software without restriction"),
    ("bsd", 0.6, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2", 0.6, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-2", 0.6, f"{_GPL} 2"),
    ("gpl-3", 0.6, f"{_GPL} 3"),
    ("isc", 0.6, "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", 0.8, "[[this work is]] released under the mit license"),
    ("apache-2", 0.8, "licensed under [[the]] apache [[software]] license [[version]] 2 [[0]]"),
    ("gpl-3", 0.8, "licensed under the gnu general public license [[gpl]] version 3"),
    ("gpl-2", 0.8, "licensed under the gnu general public license [[gpl]] version 2"),
    ("lgpl-3", 0.8, "licensed under the gnu lesser general public license [[lgpl]] version 3"),
    ("mpl-2", 0.8, "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", 0.8, "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-sa", 0.8, "licensed under [[a]] [[the]] cc by sa <<1>> 0"),
    ("cc-by", 0.8, "licensed under [[a]] [[the]] creative commons attribution [[<<1>> 0]] [[international]] license"),
    ("all-rights-reserved", 0.8, "copyright [[c]] <<8>> all rights reserved"),
    ("spdx-mit", 0.8, "spdx license identifier mit"),
    ("spdx-apache-2", 0.8, "spdx license identifier apache 2 0"),
)
_MARKS = re.compile(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(_LOWER)) if text else []


class Automaton:
    """One template: steps of a word, or None for any word, and the steps that each may be skipped to.

    A position is a step still to come; skipping optional steps is folded into the
    moves, so a run holds just the set of positions that the words so far allow.
    """

    def __init__(self, template: str):
        self.words: list[str | None] = []
        self.skips: dict[int, list[int]] = {}
        open_ = []
        for mark in _MARKS.findall(template):
            at = len(self.words)
            if mark == "[[":
                open_.append(at)
            elif mark == "]]":
                self.skips.setdefault(open_.pop(), []).append(at)
            elif mark.startswith("<<"):
                self.words += [None] * int(mark[2:-2])
                for i in range(at, len(self.words)):
                    self.skips.setdefault(i, []).append(len(self.words))
            else:
                self.words.append(mark)
        if open_:
            raise ValueError("an optional region isn't closed")
        self.closed = [self._closure(p) for p in range(len(self.words) + 1)]

    def _closure(self, p: int) -> tuple[int, ...]:
        out, left = set(), [p]
        while left:
            p = left.pop()
            if p not in out:
                out.add(p)
                left += self.skips.get(p, [])
        return tuple(sorted(out))

    def starts(self) -> set[str]:
        """The words with which an accepted text can begin; templates begin with a given word."""
        return {self.words[p] for p in self.closed[0] if p < len(self.words)}

    def accepts(self, found: list[str], at: int) -> int:
        """The first end of an accepted run of words that starts at ``at``, or -1."""
        now, final = set(self.closed[0]), len(self.words)
        for i in range(at, len(found)):
            word, then = found[i], set()
            for p in now:
                if p < final and self.words[p] in (None, word):
                    then.update(self.closed[p + 1])
            if final in then:
                return i + 1
            if not then:
                return -1
            now = then
        return -1


class Scanner:
    """Automata by the words they can begin with."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.by_word: dict[str, list[tuple[str, float, bool, Automaton]]] = {}
        for label, score, is_base, wording in [*((k, 0.5, True, p) for k, p in base.items()), *((k, s, False, p) for k, s, p in templates)]:
            automaton = Automaton(wording)
            for word in automaton.starts():
                if word is None:
                    raise ValueError("a template must begin with a given word")
                self.by_word.setdefault(word, []).append((label, score, is_base, automaton))

    def matches(self, found: list[str]) -> Iterator[tuple[int, int, str, float, bool]]:
        """(start, end, label, score, whether base) of every accepted place."""
        by_word = self.by_word
        for i in [i for i, w in enumerate(found) if w in by_word]:
            for label, score, is_base, automaton in by_word[found[i]]:
                if (end := automaton.accepts(found, i)) >= 0:
                    yield i, end, label, score, is_base


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(templates, base):
    def run(batches):
        scanner = Scanner(templates, base)
        names = [c.split()[0] for c in _OUT.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                hits = list(scanner.matches(found))
                at = [h[0] for h in hits if h[4]]
                rows.append((doc_id, len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({h[2] for h in hits if h[4]})), ",".join(sorted({h[2] for h in hits})), max((h[3] for h in hits), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    return run


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are
    the smallest and largest of their first words' numbers, from 0.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(templates, base), _OUT)


def _regex(template: str) -> str:
    """The template over words that are each preceded by a blank."""
    out = []
    for mark in _MARKS.findall(template):
        out.append({"[[": "(?:", "]]": ")?"}.get(mark) or ("(?: [^ ]+){0," + mark[2:-2] + "}" if mark.startswith("<<") else " " + mark))
    return "".join(out) + "(?: |$)"


def _oracle() -> str:
    places = {k: f"list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + {len(p.split()) - 1}) = {p.split()})" for k, p in BASE.items()}
    labels = [f"CASE WHEN regexp_matches(t, '{_regex(p)}') THEN '{k}' END" for k, _, p in TEMPLATES]
    scores = [f"CASE WHEN regexp_matches(t, '{_regex(p)}') THEN {s} ELSE 0.0 END" for _, s, p in TEMPLATES]
    based = [f"CASE WHEN len({v}) > 0 THEN '{k}' END" for k, v in places.items()]
    joined = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, ' ') ELSE '' END AS t, list_concat(list_concat({', '.join(list(places.values())[:2])}), {list(places.values())[2]}) AS places FROM d)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       {joined.format(', '.join(based))} AS base_labels, {joined.format(', '.join(based + labels))} AS labels,
       CAST(greatest({', '.join(scores)}, CASE WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS score
FROM e
"""


ORACLE_SQL = _oracle()
