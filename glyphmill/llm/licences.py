"""Licence notices found by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from .common import LOWER, UPPER, lower_ascii


_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _MIT_WARRANTY
_BSD_LIST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _gnu(kind: str, version: str) -> str:
    """The notice that the GNU licences ask for at the start of a file."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published "
        f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details. You should have "
        f"received a copy of the {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


# Notices as the licences themselves ask for them to be written.
TEMPLATES: Mapping[str, str] = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-notice": "Licensed under the GNU General Public License, Version 3.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
    "all-rights-reserved-short": "All rights reserved.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": _MIT_WARRANTY,
    "MIT-text": _MIT,
    "MIT-text-titled": "MIT License " + _MIT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-licensed": "Licensed under the BSD License.",
    "BSD-2-text": _BSD_LIST + _BSD_WARRANTY,
    "BSD-3-text": _BSD_LIST + _BSD_NAMES + _BSD_WARRANTY,
    **{f"{name}-header": _gnu(kind, version) for name, kind, version in (
        ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"),
    )},
    **{name: _gnu(kind, version).split(" This program is distributed")[0] for name, kind, version in (
        ("GPL-2.0", "GNU General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"),
    )},
    "GPL-2.0-notice": "Licensed under the GNU General Public License, Version 2.",
    "LGPL-notice": "Licensed under the GNU Lesser General Public License, Version 3.",
    "AGPL-notice": "Licensed under the GNU Affero General Public License, Version 3.",
    "GPL-work": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **{f"CC-{short}-4.0-work": f"This work is licensed under a Creative Commons {long} 4.0 International License." for short, long in _CC.items()},
    **{f"CC-{short}-4.0-view": f"This work is licensed under a Creative Commons {long} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{short.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA." for short, long in _CC.items()},
    **{f"CC-{short}-4.0": f"Licensed under CC {short} 4.0." for short in ("BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC0-notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    # Whole licences; white space does not count.
    **{f"{path.stem}-full": " ".join(path.read_text("utf-8").split())
       for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))},
}
THRESHOLD = 0.8

_MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, every other ASCII mark a gap."""
    return F.array_remove(F.split(lower_ascii(text), _MARKS), "")


def _bigrams(words: Column) -> Column:
    """Distinct word bigrams; a passage of one word is its own only one."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def _template_bigrams(text: str) -> list[str]:
    import re

    words = [w for w in re.split(_MARKS, text.translate({c: c + 32 for c in range(65, 91)})) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))) if len(words) > 1 else words


# A template that needs more words than this to be sure of one is told by how many of its words are there.
MOST_SIGNS = 40
# Words that most English texts have: they tell little.
_COMMON = frozenset(
    "a all an and any are as at be been but by can do for from has have if in is it may no not of on one or other such "
    "that the their there these they this to under use was which who will with work you your".split()
)
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


@dataclass(frozen=True)
class Signs:
    """What every passage like enough to a template has: a word of each of `tests`, or, of a template that would
    need too many words for that, `least` of `words`; and `length` characters or more."""

    tests: tuple[tuple[str, ...], ...]
    words: frozenset[str]
    least: int
    length: int


def _signs(grams: list[str], threshold: float) -> Signs:
    """A passage at least `threshold` like the template shares t / (2 - t) of its bigrams, so it lacks at most the
    rest. Words that more bigrams than that have between them cannot all be lacking."""
    shared = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
    spare = len(grams) - shared
    of: dict[str, set[str]] = {}
    for gram in grams:
        for word in gram.split(" "):
            of.setdefault(word, set()).add(gram)
    # Different bigrams stand at different places, and each takes its first word and the mark after it.
    length = max(sum(sorted(len(gram.split(" ")[0]) for gram in grams)[:shared]) + shared - 1, 0)
    words = sorted(of, key=lambda w: (w in _COMMON, len(w) < 4, -len(w), w))
    tests, left = [], set(grams)
    while len(left) > spare:
        some, found = [], set()
        for word in words:
            if len(found) > spare:
                break
            if not of[word] & left <= found:
                some.append(word)
                found |= of[word] & left
        tests.append(tuple(some))
        left -= found
    # One word that alone has more bigrams than may be lacking is a test too.
    tests = [t for t in tests if len(t) <= MOST_SIGNS] + [(w,) for w in words if len(of[w]) > spare]
    if any(not _COMMON.issuperset(t) for t in tests):
        return Signs(tuple(dict.fromkeys(tests)), frozenset(), 0, length)
    rare = [w for w in words if w not in _COMMON]
    need, least = len(set().union(*(of[w] for w in rare))) - spare if rare else 0, 0
    for size in sorted((len(of[w]) for w in rare), reverse=True):
        if need <= 0:
            break
        need, least = need - size, least + 1
    return Signs((), frozenset(rare), least, length)


def _tells(text: Column, signs: list[Signs]) -> Column:
    """Whether a text has the signs of a template anywhere. Its words are cut once. If a template's first test can
    hold, the words that are a sign of any template are taken out, and all tests look at these few."""
    by_tests: dict[tuple, int] = {}
    for s in signs:
        if s.tests:
            by_tests[s.tests] = min(s.length, by_tests.get(s.tests, s.length))
    counted = [s for s in signs if not s.tests]

    def fixed(words: Iterable[str]) -> Column:
        return F.split(F.lit(" ".join(sorted(words))), " ")

    def tested(size: Column, present: Column) -> Column:
        return reduce(or_, [
            reduce(and_, [size >= length, *(F.arrays_overlap(present, fixed(t)) for t in tests)])
            for tests, length in by_tests.items()
        ])

    def tell(size: Column, words: Column) -> Column:
        found = []
        if by_tests:
            every = {w for tests in by_tests for t in tests for w in t}
            first = {w for tests in by_tests for w in tests[0]}
            found.append(F.arrays_overlap(words, fixed(first)) & F.exists(
                F.array(F.array_intersect(words, fixed(every))), lambda present: tested(size, present)
            ))
        if counted:
            every = frozenset().union(*(s.words for s in counted))
            found.append((size >= min(s.length for s in counted)) & (
                F.size(F.array_intersect(words, fixed(every))) >= min(s.least for s in counted)
            ))
        return reduce(or_, found)

    plain = F.split(F.translate(text, UPPER + _GAPS, LOWER + " " * len(_GAPS)), " ")
    return F.exists(F.array(plain), lambda words: tell(F.length(text), words))


def passages(text: Column) -> Column:
    """(passage, text) of a text: its lines by number, and, numbered -1, the whole text if it has
    several lines."""
    lines = F.transform(
        F.split(text, "\n"), lambda line, i: F.struct(i.cast("bigint").alias("passage"), line.alias("body"))
    )
    whole = F.array(F.struct(F.lit(-1).cast("bigint").alias("passage"), text.alias("body")))
    return F.when(F.instr(text, "\n") > 0, F.concat(lines, whole)).otherwise(lines)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text",
         templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, passage, licence, n_bigrams, n_shared, dice): passages at least `threshold` like a template.

    Dice is 2 * shared / (bigrams of the passage + bigrams of the template), over distinct
    bigrams. It can reach t only if the sizes lie within t / (2 - t) of each other, so a
    passage is held only against templates of fitting size, and one too short or too long
    for all is never cut into bigrams. Texts and lines without the words that
    every passage like a template must have cannot reach t either, and are not cut into words. All hits are kept, also several per passage. Null or
    empty texts and passages without a word give no row; repeated rows give their rows
    again. The templates are a small fixed set and travel in the plan: no join, no shuffle.
    """
    sets = {name: _template_bigrams(body) for name, body in templates.items()}
    sets = {name: grams for name, grams in sets.items() if grams}
    if not sets:
        raise ValueError("no template has a word")
    low = threshold / (2 - threshold) - 1e-9  # a bound may not lose a passage to rounding
    least = min(map(len, sets.values())) * low
    most = max(map(len, sets.values())) / low
    table = F.array(*[
        F.struct(F.lit(name).alias("licence"), F.split(F.lit("\n".join(grams)), "\n").alias("grams"))
        for name, grams in sets.items()
    ])
    signs = [_signs(grams, threshold) for grams in sets.values()]

    def likeness(grams: Column) -> Column:
        n = F.size(grams)
        fitting = F.filter(
            table, lambda t: (n >= F.size(t["grams"]) * low) & (n * low <= F.size(t["grams"]))
        )
        return F.when(n.between(F.lit(least), F.lit(most)), F.transform(fitting, lambda t: F.struct(
            t["licence"].alias("licence"), n.cast("bigint").alias("n_bigrams"), F.size(t["grams"]).alias("size"),
            F.size(F.array_intersect(grams, t["grams"])).cast("bigint").alias("n_shared"),
        )))

    def judged(words: Column) -> Column:
        # A run of words with k different ones has k - 1 different bigrams or more.
        fits = (F.size(words) >= F.lit(least)) & (F.size(F.array_distinct(words)) - 1 <= F.lit(most))
        return F.when(fits, let(_bigrams(words), likeness))

    # Each value is bound once: a filter on a computed column would compute it again. The same holds
    # for plain explode, which asks for its array's size first.
    body = F.col("p.body")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.where(_tells(F.col("_text"), signs)).select(
        "_key", F.explode_outer(passages(F.col("_text"))).alias("p")
    ).where(F.col("p").isNotNull() & _tells(body, signs))
    hits = rows.select(
        "_key", "p.passage", F.explode_outer(let(_words(body), judged)).alias("hit")
    ).where("hit is not null").select(
        F.col("_key").alias(key), "passage", "hit.licence", "hit.n_bigrams", "hit.n_shared",
        (2 * F.col("hit.n_shared") / (F.col("hit.n_bigrams") + F.col("hit.size"))).alias("dice"),
    )
    return hits.where(F.col("dice") >= threshold)


def oracle(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """`scan`'s rows of `documents` in SQL, from all passages and templates."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in templates.items())
    grams = (
        f"CASE WHEN len({{w}}) > 1 THEN list_distinct(list_transform(range(1, len({{w}})), "
        f"lambda i: {{w}}[i] || ' ' || {{w}}[i + 1])) ELSE {{w}} END"
    )
    split = rf"regexp_extract_all(translate({{t}}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), passages AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS passage, unnest(ls) AS body FROM lines
  UNION ALL SELECT doc_id, -1, text FROM lines WHERE len(ls) > 1
), cut AS (
  SELECT doc_id, passage, {grams.format(w='w')} AS g
  FROM (SELECT doc_id, passage, {split.format(t='body')} AS w FROM passages) WHERE len(w) > 0
), templates AS (
  SELECT licence, {grams.format(w='w')} AS g
  FROM (SELECT licence, {split.format(t='body')} AS w FROM (VALUES {values}) v(licence, body))
)
SELECT doc_id, passage, licence, n_bigrams, n_shared, round(dice, 9) AS dice FROM (
  SELECT doc_id, passage, licence, len(c.g)::BIGINT AS n_bigrams, len(list_intersect(c.g, t.g))::BIGINT AS n_shared,
         2.0::DOUBLE * len(list_intersect(c.g, t.g)) / (len(c.g) + len(t.g)) AS dice
  FROM cut c JOIN templates t ON 2 * least(len(c.g), len(t.g)) >= ({threshold} - 1e-9) * (len(c.g) + len(t.g))
) WHERE dice >= {threshold}
"""
