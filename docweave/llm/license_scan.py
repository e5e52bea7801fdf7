"""Licence scans with DataFrame functions only.

Texts are cut into lines and into paragraphs of several lines, normalised (A-Z
folded, runs of other ASCII characters than letters and digits are one blank)
and compared with licence templates by the Dice coefficient of their sets of
word bigrams. A template can reach the threshold only for units whose set is
between ``t / (2 - t)`` and ``(2 - t) / t`` of its size, so the size bounds choose
the templates to compare, and units that share no bigram with any template are
dropped before. The templates are a literal in the plan: no join, no shuffle.

Defined cases: null and empty texts match nothing; a unit that several templates
match equally well gives the first by name; repeated lines each match; extra
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import col

PERCENT = 80

# fixed values: short notices and headings under which licences are granted
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "Copyright. All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "EPL-2.0": "This program is made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, percent: int) -> tuple[int, int]:
    """Set sizes that can reach the threshold against ``n`` bigrams."""
    return -(-n * percent // (200 - percent)), n * (200 - percent) // percent


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, _UPPER, _LOWER), NOT_WORD, " "))


def _templates(templates: dict[str, str], percent: int) -> Column:
    rows = []
    for name, text in sorted(templates.items()):
        grams = template_bigrams(text)
        if not grams:
            raise ValueError(f"template {name} has fewer than two words")
        low, high = size_bounds(len(grams), percent)
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"),
                             F.array(*[F.lit(g) for g in grams]).alias("grams")))
    return F.array(*rows)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                  percent: int = PERCENT) -> DataFrame:
    """``id, kind, unit_no, license, dice, unit``: the best template of each
    line or paragraph (numbered from 0) that reaches ``percent``."""
    templates = TEMPLATES if templates is None else templates
    sizes = [len(template_bigrams(t)) for t in templates.values()]
    least, most = min(size_bounds(n, percent)[0] for n in sizes), max(size_bounds(n, percent)[1] for n in sizes)
    known = F.array(*[F.lit(g) for g in sorted({g for t in templates.values() for g in template_bigrams(t)})])

    def units(kind: str, pattern: str) -> Column:
        return F.transform(F.split(F.col("text"), pattern, -1), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit_no"), x.alias("unit")))

    base = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = base.select("id", F.inline(units("line", "\n")))
    blocks = base.select("id", F.inline(F.filter(units("paragraph", "\n[ \t\r]*\n"), lambda u: F.contains(u["unit"], F.lit("\n")))))
    found = lines.union(blocks).withColumn("words", F.split(_normal(F.col("unit")), " ", -1))
    found = found.filter(F.size("words") > least)
    bigrams = F.array_distinct(F.transform(F.slice("words", 1, F.size("words") - 1),
                                           lambda w, i: F.concat(w, F.lit(" "), F.get(F.col("words"), i + 1))))
    # a one-element inline keeps the set from being worked out again for each use
    sets = found.select(F.inline(F.array(F.struct("id", "kind", "unit_no", "unit", bigrams.alias("grams")))))
    sets = sets.filter(F.size("grams").between(least, most) & F.arrays_overlap("grams", known))
    n = F.size("grams")
    fitting = F.filter(_templates(templates, percent), lambda t: n.between(t["low"], t["high"]))
    scored = F.transform(fitting, lambda t: F.struct(
        F.size(F.array_intersect(t["grams"], F.col("grams"))).alias("both"), F.size(t["grams"]).alias("size"), t["name"].alias("name")))
    reached = F.filter(scored, lambda s: s["both"] * 200 >= (s["size"] + n) * percent)
    ranked = F.transform(reached, lambda s: F.struct(
        (-2.0 * s["both"] / (s["size"] + n)).alias("order"), s["name"].alias("name")))
    best = sets.select("id", "kind", "unit_no", "unit", F.array_min(ranked).alias("best")).filter("best is not null")
    return best.select("id", "kind", "unit_no", F.col("best.name").alias("license"), (-F.col("best.order")).alias("dice"), "unit")
