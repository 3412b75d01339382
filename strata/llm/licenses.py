"""License scans: Dice coefficient over word bigrams against licence templates.

A text is cut into units: every line, every paragraph, and the whole.  A unit and a template are
compared by 2 |A and B| / (|A| + |B|) over their distinct adjacent word pairs.  A coefficient of t
bounds |A| by t/(2-t) |B| from below and (2-t)/t |B| from above, which prunes the templates that
a unit is compared with at all; and it needs that share of the template's pairs, so each template
has a few long words of which a matching text must hold one.  A text without any, and too short to
hold enough pairs of a long template, is done; else only templates are looked at of which the
whole text holds enough pairs.

A notice may also be part of a line, or wrapped over lines of a longer paragraph.  In what the
reported units leave (for a template: those of itself and of templates that hold it), runs of
words are compared too.  Adding a shared pair at an end never lowers a run's coefficient, and
dropping an unshared one raises it, so the best run starts where a stretch of shared pairs starts
and ends at the first place of a shared pair: only these are scored, if enough shared pairs
follow.  Of runs that overlap the best is kept, the first of equal ones.

All of it is one projection: no shuffle, no user function, and templates are constants.

Defined results: a null or empty text has no units; a unit of one word is the set of that word;
equal units of a text count once; a run is given as its lower-cased words, and has at most twice
the pairs that the bound on distinct pairs allows; repeated rows get equal results; other columns
pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import indexes, let
from strata.llm.quality import STOP_WORDS

PERCENT = 80
SEPARATORS = r"[^\p{L}\p{N}]+"
CUT = "\uFFFF"  # no character

COMMON = frozenset(STOP_WORDS) | frozenset("under any use work free public general version following above".split())

LONG = 300  # templates of more pairs have too many long words to look for these first

# Public licence notices, and opening paragraphs of licences; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
this work.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Whole licence texts, without title and copyright lines where these vary.
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8")
              for f in sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name)}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def cue_words(words: list[str], percent: int) -> set[str]:
    """Words, rare ones and long ones first, until fewer pairs are without one than a match may lack."""
    pairs = template_pairs(words)
    lacking = len(pairs) - math.ceil(len(pairs) * percent / (200 - percent))
    chosen: set[str] = set()
    for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
        chosen.add(w)
        if sum(bool(chosen & set(p.split())) for p in pairs) > lacking:
            break
    return chosen


def listed(values: list[str]) -> Column:
    """A constant array; none of ``values`` holds a line break."""
    return F.split(F.lit("\n".join(values)), "\n")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def pairs(w: Column) -> Column:
    return F.when(F.size(w) < 2, w).otherwise(F.array_distinct(
        F.transform(indexes(F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))


def run_pairs(w: Column) -> Column:
    """All adjacent pairs in order, repeats included."""
    return F.transform(indexes(F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))


def units(text: Column) -> Column:
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09\r]*\n"), F.array(text)))


def scan(docs: DataFrame, text: str = "text", percent: int = PERCENT, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` plus ``licenses``: an array of ``license, dice, unit`` (the unit's text), best first."""
    rows, cues, long = [], set(), []
    words_of = {name: template_words(body) for name, body in sorted(templates.items())}
    pairs_of = {name: template_pairs(own) for name, own in words_of.items()}
    for name, p in pairs_of.items():
        least = -(-len(p) * percent // (200 - percent))  # shared pairs that a match has at least
        if len(p) > LONG:
            long.append(least)
        else:
            cues |= cue_words(words_of[name], percent)
        held_by = [m for m, q in pairs_of.items() if len(set(p) & set(q)) >= least]
        rows.append(F.struct(F.lit(name).alias("license"), F.lit(len(p)).alias("n"), listed(p).alias("pairs"),
                             F.lit(least).alias("least"), F.lit(2 * (len(p) * (200 - percent) // percent)).alias("most"),
                             F.lit(len(words_of[name]) < 2).alias("single"), listed(held_by).alias("held_by")))
    known, cue = F.array(*rows), listed(sorted(cues))
    all_pairs = listed(sorted({x for p in pairs_of.values() for x in p}))
    singles = any(len(own) < 2 for own in words_of.values())
    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def matches(unit: Column, likely: Column) -> Column:
        def against(own: Column) -> Column:
            n = F.size(own)
            near = F.filter(likely, lambda t: ((200 - percent) * n >= percent * t["n"]) & (percent * n <= (200 - percent) * t["n"]))
            scored = F.transform(near, lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(own, t["pairs"])) / (n + t["n"])).alias("dice"), t["license"].alias("license"),
                unit.alias("unit")))
            return F.filter(scored, lambda s: 100 * s["dice"] >= percent)
        return let(let(words(unit), pairs), against)

    def ranked(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda m: F.struct(
            (-m["dice"]).alias("o"), m["license"].alias("license"), m["unit"].alias("unit"), m["dice"].alias("dice"))))
        return F.transform(order, lambda m: F.struct(m["license"].alias("license"), m["dice"].alias("dice"), m["unit"].alias("unit")))

    def best_end(t: Column, seq: Column, start: Column) -> Column:
        """The best run from ``start``: the distinct pairs of a run are a prefix of those that follow."""
        def scored(ahead: Column) -> Column:
            def ends(d: Column) -> Column:
                places = F.transform(F.array_intersect(d, t["pairs"]), lambda g: F.array_position(d, g).cast("int"))
                dice = F.transform(places, lambda p, r: F.struct((2.0 * (r + 1) / (p + t["n"])).alias("dice"), (-p).alias("p")))
                return let(F.array_max(dice), lambda m: F.struct(
                    m["dice"].alias("dice"), start.alias("a"),
                    (start + F.array_position(ahead, F.get(d, -m["p"] - 1)).cast("int")).alias("b")))
            return let(F.array_distinct(ahead), ends)
        return let(F.slice(seq, start + 1, t["most"]), scored)

    def apart(found: Column) -> Column:
        """Of runs in order of their starts, those that no better one overlaps."""
        def add(kept: Column, r: Column) -> Column:
            return (F.when((F.size(kept) == 0) | (r["a"] >= F.try_element_at(kept, F.lit(-1))["b"]), F.concat(kept, F.array(r)))
                    .when(r["dice"] > F.try_element_at(kept, F.lit(-1))["dice"],
                          F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(r))).otherwise(kept))
        return F.aggregate(found, F.filter(found, lambda r: F.lit(False)), add)

    def runs(t: Column, w: Column) -> Column:
        """The runs of ``w`` that match ``t``."""
        def among(seq: Column) -> Column:
            def started(hits: Column) -> Column:
                fresh = F.filter(indexes(F.size(hits)), lambda k: (
                    F.coalesce(F.get(hits, k - 1) != F.get(hits, k) - 1, F.lit(True))
                    & F.coalesce(F.get(hits, k + t["least"] - 1) - F.get(hits, k) < t["most"], F.lit(False))))
                scored = F.transform(fresh, lambda k: best_end(t, seq, F.get(hits, k)))
                return let(F.filter(scored, lambda r: 100 * r["dice"] >= percent), apart)
            return let(F.filter(indexes(F.size(seq)), lambda i: F.array_contains(t["pairs"], F.get(seq, i))), started)
        return F.transform(let(F.when(t["single"], w).otherwise(run_pairs(w)), among), lambda r: F.struct(
            r["dice"].alias("dice"), t["license"].alias("license"),
            F.array_join(F.slice(w, r["a"] + 1, r["b"] - r["a"] + F.when(t["single"], 0).otherwise(1)), " ").alias("unit")))

    def left(t: Column, reported: Column) -> Column:
        """The words of each part of the text that no reported unit of ``t``, or of a template that holds it, covers."""
        known_units = F.filter(reported, lambda m: F.array_contains(t["held_by"], m["license"]))
        longest = F.array_sort(F.transform(known_units, lambda m: F.struct((-F.length(m["unit"])).alias("o"), m["unit"].alias("unit"))))
        cut = F.aggregate(longest, column, lambda text, m: F.replace(text, m["unit"], F.lit(CUT)))
        return F.transform(F.split(cut, CUT), words)

    def with_runs(reported: Column, likely: Column) -> Column:
        return F.concat(reported, F.array_distinct(F.flatten(F.transform(likely, lambda t: F.flatten(
            F.transform(left(t, reported), lambda w: runs(t, w)))))))

    none = F.array().cast("array<struct<license:string,dice:double,unit:string>>")

    def of_likely(likely: Column) -> Column:
        found = let(F.flatten(F.transform(units(column), lambda u: matches(u, likely))), lambda reported: with_runs(reported, likely))
        return F.when(F.size(likely) > 0, ranked(found)).otherwise(none)

    def of_words(w: Column) -> Column:
        def holding(own: Column) -> Column:
            return F.filter(known, lambda t: F.size(F.array_intersect(own, t["pairs"])) >= t["least"])
        held = F.array_intersect(F.concat(run_pairs(w), w) if singles else run_pairs(w), all_pairs)
        enough = F.size(w) > min(long) if long else F.lit(False)
        return F.when(F.arrays_overlap(w, cue) | enough, let(let(held, holding), of_likely)).otherwise(none)

    return docs.withColumn("licenses", let(words(column), of_words))
