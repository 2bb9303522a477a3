"""License notices by templates with optional and replaceable regions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.contamination import words_of

#: Phrases that always count, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed value: the conditions that both licenses of this name share.
BSD_2 = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: <<any 2>> redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. <<any 2>> redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: Fixed values: (label, template), the wording that licenses ask their users to keep. ``<<optional>>..<</optional>>`` may
#: be missing, ``<<any n>>`` is up to n words.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the <<optional>>terms of the<</optional>> mit license"),
    (
        "mit",
        "<<optional>>the mit license<</optional>> <<optional>>copyright <<any 20>><</optional>> permission is hereby granted, free of "
        "charge, to any person obtaining a copy of this software and associated documentation files (the <<optional>>quot<</optional>> "
        "software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to "
        "do so, subject to the following conditions: the above copyright notice and this permission notice <<optional>>(including the "
        "next paragraph)<</optional>> shall be included in all copies or substantial portions of the software.",
    ),
    (
        "isc",
        "permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("bsd-2-clause", BSD_2),
    (
        "bsd-3-clause",
        BSD_2 + " <<any 2>> neither the name of <<any 12>> nor the names of <<optional>>its<</optional>> <<optional>>the<</optional>> "
        "<<any 3>> contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission",
    ),
    ("apache-2.0", "licensed under the apache license <<optional>>version<</optional>> 2<<optional>>.0<</optional>>"),
    (
        "apache-2.0",
        "licensed under the apache license version 2.0 (the <<optional>>quot<</optional>> license <<optional>>quot<</optional>>) you may not "
        "use <<any 3>> except in compliance with the license. you may obtain a copy of the license at <<any 12>> unless required by "
        "applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties "
        "or conditions of any kind, either express or implied. see the license for the specific language governing permissions and "
        "limitations under the license.",
    ),
    ("apache-2.0", "apache license version 2.0 january 2004 <<any 8>> terms and conditions for use, reproduction, and distribution"),
    ("gpl-3.0", "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>version<</optional>> 3"),
    ("gpl-2.0", "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>version<</optional>> 2"),
    *(
        (
            f"{label}-{version}.0" if len(version) == 1 else f"{label}-{version}",
            f"is free software<<optional>>:<</optional>> you can redistribute it and/or modify it under the terms of the gnu {name} "
            f"general public license as published by the free software foundation<<optional>>, either<</optional>> version {version} of the "
            "license<<optional>>, or (at your option) any later version<</optional>>",
        )
        for label, name, version in (
            ("gpl", "", "2"),
            ("gpl", "", "3"),
            ("lgpl", "lesser", "2.1"),
            ("lgpl", "lesser", "3"),
            ("agpl", "affero", "3"),
        )
    ),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of "
        "merchantability or fitness for a particular purpose. see the gnu general public license for more details",
    ),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", "gnu lesser general public license version 2.1 february 1999"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007"),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with "
        "this file, you can obtain one at <<any 8>> mozilla.org/mpl/2.0",
    ),
    ("mpl-2.0", "mozilla public license <<optional>>,<</optional>> <<any 1>> 2.0"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means",
    ),
    ("cc-by-nc", "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by-nc"),
    ("cc-by-nc", "creative commons attribution<<optional>>-<</optional>>noncommercial"),
)

_MARK = re.compile(r"<<(/?optional|any (\d+))>>")


class Automaton:
    """Templates compiled into one set of states over words.

    A state has edges by word, and maybe an edge by any word; edges without a
    word are folded away when compiling. An optional part at either end of a
    template makes no difference, since texts need not end there, and is left
    out; a replaceable part there could not be told from any text, and is refused.
    """

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.words: list[dict[bytes, set[int]]] = []
        self.wild: list[set[int]] = []
        self.free: list[set[int]] = []
        self.ends: dict[int, str] = {}
        entries = []
        for label, template in templates:
            entry = self._state()
            self.ends[self._compile(entry, _parsed(template))] = label
            entries.append(entry)
        self.closed = [self._closure({s}) for s in range(len(self.words))]
        self.starts: dict[bytes, set[int]] = {}
        for entry in entries:
            for state in self.closed[entry]:
                if self.wild[state] or state in self.ends:
                    raise ValueError("a template needs a word before any replaceable part")
                for word, to in self.words[state].items():
                    self.starts.setdefault(word, set()).update(*(self.closed[t] for t in to))

    def _state(self) -> int:
        self.words.append({})
        self.wild.append(set())
        self.free.append(set())
        return len(self.words) - 1

    def _compile(self, at: int, parts: list) -> int:
        for part in parts:
            if isinstance(part, bytes):
                to = self._state()
                self.words[at].setdefault(part, set()).add(to)
                at = to
            elif isinstance(part, int):
                end = self._state()
                for _ in range(part):
                    self.free[at].add(end)
                    to = self._state()
                    self.wild[at].add(to)
                    at = to
                self.free[at].add(end)
                at = end
            else:
                end = self._compile(at, part)
                self.free[at].add(end)
                at = end
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)

    def labels(self, words: list[bytes]) -> set[str]:
        """Labels of the templates that hold somewhere in the words."""
        found: set[str] = set()
        starts = self.starts
        if starts.keys().isdisjoint(words):
            return found
        for at in [i for i, w in enumerate(words) if w in starts]:
            live, k = starts[words[at]], at + 1
            while live:
                found.update(self.ends[s] for s in live if s in self.ends)
                if k == len(words):
                    break
                word, new = words[k], set()
                for s in live:
                    for to in self.words[s].get(word, ()):
                        new |= self.closed[to]
                    for to in self.wild[s]:
                        new |= self.closed[to]
                live, k = new, k + 1
        return found


def _parsed(template: str) -> list:
    """Words, numbers of replaceable words, and lists for optional parts; no optional parts that are at an end or have no word."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(template):
        stack[-1] += words_of(template[at : mark.start()].encode())
        at = mark.end()
        if mark[2]:
            stack[-1].append(int(mark[2]))
        elif mark[1] == "optional":
            stack.append([])
        elif len(stack) == 1:
            raise ValueError("the end of an optional part has no start")
        else:
            done = stack.pop()
            if done:
                stack[-1].append(done)
    stack[-1] += words_of(template[at:].encode())
    parts = stack.pop()
    if stack:
        raise ValueError("an optional part has no end")
    for end in (0, -1):
        while parts and isinstance(parts[end], list):
            parts.pop(end)
    if not any(isinstance(p, bytes) for p in parts) or isinstance(parts[0], int) or isinstance(parts[-1], int):
        raise ValueError("a template needs a word, and one before and after any replaceable part")
    return parts


class Phrases:
    """Places of fixed phrases among words."""

    def __init__(self, phrases: Mapping[str, str]):
        self.by_last: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            words = words_of(phrase.encode())
            self.by_last.setdefault(words[-1], []).append((words, label))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        if self.by_last.keys().isdisjoint(words):
            return []
        out = []
        for at, word in enumerate(words):
            for phrase, label in self.by_last.get(word, ()):
                start = at - len(phrase) + 1
                if start >= 0 and words[start : at + 1] == phrase:
                    out.append((start, label))
        return out


def licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per row of ``docs``.

    ``n_base`` counts the places of the fixed phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without any). A
    template's label is given if its mandatory words stand in the text one after
    another, with nothing between them but what the template marks as optional
    or replaceable. ``score`` is 1 with a template, 0.5 with phrases alone, else
    0. Words are runs of digits, letters and anything beyond ASCII.

    Null or wordless texts have no words and no labels (the empty string). Long
    texts are read whole, one at a time. Repeated rows and null ids count each; an empty table gives an empty result; other columns
    are ignored. The automaton depends on the templates alone; a text is read
    once, with a bounded set of states.
    """
    automaton, fixed = Automaton(templates), Phrases(phrases)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def row(raw: bytes | None) -> tuple:
        words = [] if raw is None else words_of(raw)
        places = fixed.places(words)
        base = {label for _, label in places}
        own = automaton.labels(words)
        starts = [p for p, _ in places]
        score = 1.0 if own else 0.5 if base else 0.0
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_buffer()
                rows.append(row(None if raw is None else raw.to_pybytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def oracle() -> str:
    """DuckDB SQL for ``licenses`` with its fixed phrases and templates, these as patterns over words with blanks between."""

    def pattern(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += f" {part.decode()}"
            elif isinstance(part, int):
                out += f"(?: [^ ]+){{0,{part}}}"
            else:
                out += f"(?:{pattern(part)})?"
        return out

    def places(phrase: str) -> str:
        words = phrase.split()
        same = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        return f"list_filter(range(1, len(w) + 1), lambda i: {same})"

    own = ", ".join(f"case when regexp_matches(line, '{pattern(_parsed(t))} ') then '{label}' end" for label, t in TEMPLATES)
    base = ", ".join(f"case when len({places(p)}) > 0 then '{label}' end" for p, label in PHRASES.items())
    spots = " || ".join(places(p) for p in PHRASES)
    return f"""
with split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
found as (
  select doc_id, len(w)::bigint as n_words, {spots} as spots, list_filter([{base}], lambda x: x is not null) as base,
    list_filter([{own}], lambda x: x is not null) as own
  from (select *, ' ' || array_to_string(w, ' ') || ' ' as line from split))
select doc_id, n_words, len(spots)::bigint as n_base, (list_min(spots) - 1)::bigint as first_word, (list_max(spots) - 1)::bigint as last_word,
  array_to_string(list_sort(list_distinct(base)), ',') as base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') as labels,
  (case when len(own) > 0 then 1 when len(base) > 0 then 0.5 else 0 end)::double as score
from found"""
