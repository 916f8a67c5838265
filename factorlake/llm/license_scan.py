"""Licence notices by conditional compression.

A block of text that follows a licence template compresses much better if the compressor has
the template as its dictionary. Blocks are the words around each cue, as many on both sides as the
template has; templates are ranked by the reduction of their block's compressed size, and
the best are confirmed by the exact differences in wording. Only templates of whose words a text and a
block hold enough to be confirmed are ranked, so whole licences cost nothing where none is.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from factorlake.llm.common import plain

#: Whole licences, one file each: the terms without an appendix on how to apply them.
WHOLE = [f"{name}-text" for name in (
    "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1",
    "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "Artistic-1.0", "ISC")]
GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
GNU_VERSIONS = [("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]
GNU_HEADER = (
    "This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind} "
    "Public License as published by the Free Software Foundation, either version {number} of the License, or (at your "
    "option) any later version.")


def _gnu_header(kind: str, version: str) -> str:
    return GNU_HEADER.format(work="library" if kind == "LGPL" else "program", stop=":" if version == "3.0" else ";",
                             kind=GNU[kind], number=version.removesuffix(".0"))


#: Public notices in their usual wording.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-opening": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software."),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at"),
    # What the BSD licences share.
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"),
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
} | {
    f"{kind}-{version}": f"This work is licensed under the GNU {GNU[kind]} Public License, version {version.removesuffix('.0')}."
    for kind, version in GNU_VERSIONS
} | {
    f"{kind}-{version}-header": _gnu_header(kind, version) for kind, version in GNU_VERSIONS
} | {
    f"CC-{kind}-4.0": f"Licensed under CC {kind} 4.0." for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
} | {
    name: pkgutil.get_data(__package__, f"licences/{name}.txt").decode() for name in WHOLE
}
#: Names, variants and versions: phrases of a template that must stand in the text word for word. Whole licences
#: have the clause that their next of kin lacks, or their title where there is none.
MUST = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "Apache-2.0-header": ["Apache License, Version 2.0"],
    "MPL-1.1": ["Mozilla Public License", "1.1"],
    "MPL-2.0": ["Mozilla Public License", "2.0"],
    "MIT-text": ["this permission notice shall be included in all copies"],
    "BSD-2-Clause-text": ["Redistributions in binary form must reproduce"],
    "BSD-3-Clause-text": ["to endorse or promote products derived from this software"],
    "BSD-4-Clause-text": ["All advertising materials mentioning features or use of this software must display",
                          "to endorse or promote products derived from this software"],
    "Apache-2.0-text": ["Apache License Version 2.0"],
    "GPL-1.0-text": ["GNU General Public License Version 1, February 1989"],
    "GPL-2.0-text": ["consequence of a court judgment or allegation of patent infringement"],
    "GPL-3.0-text": ["Use with the GNU Affero General Public License"],
    "LGPL-2.0-text": ["versions of the Library General Public License from time to time"],
    "LGPL-2.1-text": ["versions of the Lesser General Public License from time to time"],
    "LGPL-3.0-text": ["incorporates the terms and conditions of version 3 of the GNU General Public License"],
    "AGPL-3.0-text": ["Remote Network Interaction; Use with the GNU General Public License"],
    "MPL-1.1-text": ["Mozilla Public License Version 1.1"],
    "MPL-2.0-text": ["Mozilla Public License Version 2.0"],
    "CC0-1.0-text": ["CC0 1.0 Universal"],
    "Artistic-1.0-text": ["Artistic License"],
    "ISC-text": ["this permission notice appear in all copies"],
} | {
    f"{kind}-{version}{form}": [f"GNU {GNU[kind]} Public License", f"version {version}"]
    for kind, version in GNU_VERSIONS for form in ("", "-header")
} | {
    name: [name.removeprefix("CC-").removesuffix("-4.0").join(("CC ", " 4.0"))] for name in TEMPLATES if name.startswith("CC-BY")
}
#: How licences are called, without versions where these follow by rule.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License v2.0", "Apache License 2.0", "Apache 2.0 License",
                   "Apache-2.0 License", "Apache 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License", "BSD-4-Clause License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic License, Version 1.0"],
}
NUMBERED = {
    "MPL": (["1.0", "1.1", "2.0"], ["Mozilla Public License, Version {n}", "Mozilla Public License {n}",
                                    "Mozilla Public License, v. {n}", "Mozilla Public License v{n}", "MPL {n}", "MPL-{n}"]),
    **{short: (versions, [f"GNU {kind} Public License, version {{n}}", f"GNU {kind} Public License v{{n}}",
                          f"GNU {kind} Public License {{n}}", f"GNU {short} version {{n}}", f"GNU {short} v{{n}}",
                          f"GNU {short}v{{n}}", f"{short} version {{n}}", f"{short} v{{n}}", f"{short}v{{n}}",
                          f"{short} {{n}}", f"{short}-{{n}}"])
       for short, versions, kind in (("GPL", ["1.0", "2.0", "3.0"], "General"), ("LGPL", ["2.0", "2.1", "3.0"], "Lesser General"),
                                     ("AGPL", ["1.0", "3.0"], "Affero General"))},
}
CC_PARTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: What stands before a name in a notice. Creative Commons licences and SPDX tags are notices without it.
LEADS = ["under {}", "under the {}", "under the terms of the {}"]


def short_notices() -> dict[str, str]:
    """Every short notice by ``license/number``. They must stand in a text word for word."""
    names = dict(NAMES)
    for short, (versions, forms) in NUMBERED.items():
        for v in versions:
            numbers = dict.fromkeys([v, v.removesuffix(".0")])
            names[f"{short}-{v}"] = [form.format(n=n) for form in forms for n in numbers]
    out = {name: [lead.format(form) for form in forms for lead in LEADS] for name, forms in names.items()}
    for kind in CC_KINDS:
        long = "-".join(CC_PARTS[p] for p in kind.split("-"))
        for v, place in CC_VERSIONS.items():
            out[f"CC-{kind}-{v}"] = [f"CC {kind} {v}", f"CC-{kind} {v}", f"CC-{kind}-{v}", f"Creative Commons {long} {v}",
                                     f"Creative Commons {long} {v} {place}"]
    out["CC0-1.0"] += NAMES["CC0-1.0"]
    for name in list(out):
        gnu = name.split("-")[0] in GNU
        for tag in [name, *([f"{name}-only", f"{name}-or-later"] if gnu else [])]:
            out.setdefault(tag, []).append(f"SPDX-License-Identifier: {tag}")
    found = {}
    for name, forms in out.items():
        # Forms that read the same, such as version 3 and 3.0, once.
        for k, form in enumerate({tuple(normal(form)): form for form in forms}.values()):
            found[f"{name}/{k}"] = form
    return found


CUE = re.compile(r"licen[cs]e|permission\W+is\W+hereby|permission\W+to\W+use|redistribution\W+and\W+use|free\W+software"
                 r"|spdx|creative\W+commons|\bcc\W+by\b|\bcc0\b|gpl|(?:released|distributed|available)\W+under", re.IGNORECASE)
WORDS = re.compile(r"[\w.+-]*\w")
#: zstandard does not index the last eight bytes of a dictionary.
PADDING = "\n" * 8
#: The least reduction of the compressed size of a notice.
REDUCTION = 0.25
#: Words of the template that may be missing or added inside the notice, as shares of its words.
MISSING, ADDED = 0.15, 0.15
#: Words that stand more often in a template than once in so many words are no anchors of the alignment.
COMMON = 100

SCHEMA = ("doc_id long, start int, stop int, license string, reduction double, n_words int, "
          "missing string, added string")


def same_version(word: str) -> str:
    """Version 3.0 is version 3, and v3.0 is v3."""
    return word[:-2] if word.endswith(".0") and word[:-2].removeprefix("v").isdigit() else word


def normal(text: str) -> list[str]:
    return [same_version(w) for w in WORDS.findall(text.lower())]


def occurrences(phrase: list[str], words: list[str]) -> list[tuple[int, int]]:
    n = len(phrase)
    return [(k, k + n) for k in range(len(words) - n + 1) if words[k:k + n] == phrase]


def matches(words: list[str], template: list[str], common: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    found = SequenceMatcher(common.__contains__, words, template, autojunk=False)
    return [(m.a, m.b, m.size) for m in found.get_matching_blocks() if m.size]


def aligned(words: list[str], template: list[str]) -> list[tuple[int, int, int]]:
    """Runs of equal words: place among the words, place in the template, length.

    Rarer words are the anchors; then what lies between and beside the anchored runs is aligned by all words. A
    template of any length is aligned by the same rule.
    """
    most = 1 + len(template) // COMMON
    common = frozenset(w for w, n in Counter(template).items() if n > most)
    anchored = matches(words, template, common)
    if not common or not anchored:
        return anchored or matches(words, template)
    out, x, y = [], max(0, anchored[0][0] - anchored[0][1]), 0
    ends = min(len(words), anchored[-1][0] + len(template) - anchored[-1][1])
    for a, b, n in [*anchored, (ends, len(template), 0)]:
        out += [(x + i, y + k, size) for i, k, size in matches(words[x:a], template[y:b])]
        if n:
            out.append((a, b, n))
        x, y = a + n, b + n
    return out


SHORT = short_notices()
TEMPLATES |= SHORT


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: normal(t) for name, t in templates.items()}
        self.bags = {name: Counter(words) for name, words in self.words.items()}
        phrases = MUST | {name: [wording] for name, wording in SHORT.items()}
        self.must = {name: [place for phrase in phrases.get(name, ()) for place in occurrences(normal(phrase), words)]
                     for name, words in self.words.items()}
        self.must_words = {name: {w for a, b in places for w in self.words[name][a:b]}
                           for name, places in self.must.items()}
        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.frame = len(self.alone.compress(b""))
        self.given: dict[str, zstandard.ZstdCompressor] = {}

    def compressor(self, name: str) -> zstandard.ZstdCompressor:
        if name not in self.given:
            held = zstandard.ZstdCompressionDict((" ".join(self.words[name]) + PADDING).encode(),
                                                 dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=9)
            self.given[name] = zstandard.ZstdCompressor(
                level=9, dict_data=held, write_content_size=False, write_dict_id=False)
        return self.given[name]

    def reduction(self, words: list[str], name: str) -> float:
        """The share of the compressed size, without the empty frame, that the template saves.

        The block is written three times: a few bytes alone would be stored as they are, with or without a dictionary.
        """
        block = " ".join(words * 3).encode()
        size = len(self.alone.compress(block)) - self.frame
        return (size + self.frame - len(self.compressor(name).compress(block))) / size

    def possible(self, bag: Counter, name: str) -> bool:
        """Are there enough of the template's words, and all it must have, in whatever order?"""
        if not all(w in bag for w in self.must_words[name]):
            return False
        size, get = len(self.words[name]), bag.get
        return size - sum(min(n, get(w, 0)) for w, n in self.bags[name].items()) <= MISSING * size

    def differences(self, words: list[str], name: str) -> tuple[int, int, list[str], list[str], list[str]] | None:
        """Where the template stands among the words, the words it lacks and has more, and those outside
        that stand in the place of its first and last ones. None where a phrase it must have differs.
        """
        template = self.words[name]
        parts = aligned(words, template)
        if not parts:
            return None
        begin, end = parts[0][0], parts[-1][0] + parts[-1][2]
        hit_a = {k for a, _, n in parts for k in range(a, a + n)}
        hit_b = {k for _, b, n in parts for k in range(b, b + n)}
        at = {b + k: a + k for a, b, n in parts for k in range(n)}
        for first, stop in self.must[name]:
            if any(at.get(k, -1) != at.get(first, -2) + k - first for k in range(first, stop)):
                return None
        missing = [w for k, w in enumerate(template) if k not in hit_b]
        added = [words[k] for k in range(begin, end) if k not in hit_a]
        before, after = parts[0][1], len(template) - parts[-1][1] - parts[-1][2]
        return begin, end, missing, added, words[max(0, begin - before):begin] + words[end:end + after]

    def find(self, text: str) -> list[tuple[int, int, str, float, int, str, str]]:
        """start, stop, license, reduction, n_words, missing, added of each notice, in order."""
        cues = [m.start() for m in CUE.finditer(text)]
        if not cues:
            return []
        places = list(WORDS.finditer(text))
        words, starts = [same_version(m.group().lower()) for m in places], [m.start() for m in places]
        bag = Counter(words)
        names = [name for name in self.words if self.possible(bag, name)]
        out, done = [], 0
        for cue in cues:
            at = max(0, bisect_right(starts, cue) - 1)
            if at < done:  # inside the last notice
                continue
            blocks = {}
            for name in names:
                size = len(self.words[name])
                more = int(ADDED * size)
                a, b = max(done, at - size - more), at + size + more + 1
                if self.possible(Counter(words[a:b]), name):
                    blocks[name] = a, b
            ranked = sorted(((self.reduction(words[a:b], name), name) for name, (a, b) in blocks.items()),
                            reverse=True)
            best = None
            for _, name in ranked:
                shift, stop = blocks[name]
                place = self.differences(words[shift:stop], name)
                if place is None:
                    continue
                begin, end, missing, added, outside = place[0] + shift, place[1] + shift, *place[2:]
                size = len(self.words[name])
                saved = self.reduction(words[begin:end], name)
                if saved < REDUCTION or len(missing) > MISSING * size or len(added) > ADDED * size:
                    continue
                # The longest confirmed wording, then the larger reduction.
                score = (size - len(missing) - len(added), saved, name)
                if best is None or score > best[0]:
                    best = (score, begin, end, name, saved, " ".join(missing), " ".join(added + outside))
            if best:
                _, begin, end, name, saved, missing, added = best
                label = name.split("/")[0]
                out.append((starts[begin], places[end - 1].end(), label, saved, end - begin, missing, added))
                done = end
        return out


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (code points), license, reduction, n_words, missing, added words.

    Words in the place of missing ones at either end are listed last among the added; ``start`` and ``stop``
    leave them out. The phrases in ``MUST`` are never missing.
    One row for each notice. Texts without one, null and empty texts have no row; rows that repeat
    an identifier each have theirs; an empty table gives no row.
    """
    known = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known.value)
        for batch in batches:
            rows = [(doc_id, *found) for doc_id, text in zip(batch.column(0).to_pylist(),
                                                             batch.column(1).to_pylist())
                    for found in scanner.find(text)]
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(),
                     pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[f.split()[0] for f in SCHEMA.split(", ")])

    return plain(docs, id_col, text_col).mapInArrow(run, SCHEMA)
