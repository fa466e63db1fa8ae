"""License scans with DataFrame functions alone: normalised text compared to licence
templates by the Dice coefficient over distinct word bigrams.

A document is read in units: its lines, its paragraphs (parted by blank lines) and the
whole text. A template is compared with a unit only if their sizes allow the wanted
coefficient: with d the least coefficient, a unit of n bigrams fits templates of
n * d / (2 - d) to n * (2 - d) / d bigrams. Everything happens inside the row: there is
no join, no shuffle and no Python.

It is read in passages too, so that a notice inside a longer line or paragraph, or dealt
over several, counts: runs of as many words as the template, at each of its bigrams in
the text. Of overlapping passages the one with most common bigrams stays, then that of
the larger coefficient, the smaller name, the earlier place. A passage that lies in a
unit found with the same licence is no further match. Standard licence files hold such a
passage (the Apache, GPL and MPL files their own notice, those of Creative Commons
their first sentence), so that no template is a whole long licence.

A run that reaches d shares n * d / (2 - d) of a template's n bigrams at least. A few more
than the others of each template are its anchors; texts without an anchor match nothing.

Defined results: null and empty texts and units of fewer than two words match nothing
(best_score 0, no licence); equal best coefficients go to the smaller licence name;
repeated rows are scanned each; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

# Licence names and wordings of their notices and short texts.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights"),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def templates() -> list[tuple[str, list[str]]]:
    return [(name, b) for name, text in TEMPLATES if (b := bigrams(text))]


def _literal(rows: list[tuple[str, list[str]]]) -> str:
    """An array of (name, bigrams) structs as an SQL literal; names and bigrams hold no quotes."""
    return "array(" + ", ".join(f"named_struct('name', '{name}', 'b', array({', '.join(repr(x) for x in b)}))" for name, b in rows) + ")"


def normalised(text: Column) -> Column:
    """Lower case, words of a-z and 0-9, line ends."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[^a-z0-9\n]+", " ")


def units(low: Column) -> Column:
    """Lines, paragraphs and the whole of a normalised text."""
    lines = F.split(low, "\n")
    paragraphs = F.transform(F.split(low, r"\n ?(?:\n ?)+"), lambda p: F.regexp_replace(p, r"[ \n]+", " "))
    return F.array_distinct(F.transform(F.concat(lines, paragraphs, F.array(F.regexp_replace(low, r"[ \n]+", " "))), lambda u: F.trim(u)))


def _strings(found) -> str:
    return ", ".join(map(repr, found))


def anchors(known: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Bigrams of which any run that reaches `least` holds one: of each template all but fewer
    than such a run has to share with it, those of the longest words."""
    out: dict[str, None] = {}
    for _, b in known:
        need = math.ceil(len(b) * least / (2 - least) - 1e-9)
        out |= dict.fromkeys(sorted(b, key=lambda x: (-min(map(len, x.split())), -len(x), x))[: len(b) - need + 1])
    return list(out)


def _runs(k: int, text: str, least: float) -> str:
    """Runs of template k's number of words, at positions in _at of its bigrams, that reach `least`."""
    name, own = TEMPLATES[k][0], bigrams(text)
    need, length = math.ceil(len(own) * least / (2 - least) - 1e-9), len(re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))) - 1
    run = f"array_distinct(transform(sequence(h[i], least(h[i] + {length - 1}, size(_w) - 2)), j -> concat(_w[j], ' ', _w[j + 1])))"
    starts = f"filter(sequence(0, size(h) - {need}), i -> h[i + {need - 1}] - h[i] < {length})"
    common = f"transform({starts}, i -> transform(array({run}), b -> named_struct('i', i, 'b', b, 'n', size(array_intersect(b, array({_strings(own)})))))[0])"
    row = f"named_struct('loss', -x.n, 'more', -2.0D * x.n / (size(x.b) + {len(own)}), 'name', '{name}', 's', h[x.i], 'e', h[x.i] + {length - 1}, 'b', x.b)"
    good = f"transform(filter({common}, x -> 2.0D * x.n / (size(x.b) + {len(own)}) >= {least!r}D), x -> {row})"
    here = f"filter(_at, i -> concat(_w[i], ' ', _w[i + 1]) in ({_strings(own)}))"
    return f"flatten(transform(array({here}), h -> if(size(h) >= {need}, {good}, array())))"


def scan(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per document: doc_id, licences (distinct names, sorted, of all units and passages that
    reach `least`), n_matches (units and passages that reach it) and best_score, the largest
    coefficient among them (0 without any: the size bounds leave smaller ones unknown)."""
    known = templates()
    shortest = min(len(b) for _, b in known) * least / (2 - least) - 1e-6
    longest = max(len(b) for _, b in known) * (2 - least) / least + 1e-6
    ratio = least / (2 - least) - 1e-9  # a hair below: bounds prune, the coefficient decides
    vocabulary = sorted({x for _, b in known for x in b})
    pair = "concat(_w[i], ' ', _w[i + 1])"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("_low"))
    rows = rows.select("doc_id", "_low", F.split(F.trim(F.regexp_replace("_low", r"[ \n]+", " ")), " ").alias("_w"))
    # positions of templates' bigrams; every unit is a run of the text's words
    first = _strings(sorted({x.split()[0] for x in vocabulary}))
    at = f"if(size(_w) > 1, filter(sequence(0, size(_w) - 2), i -> _w[i] in ({first}) and {pair} in ({_strings(vocabulary)})), array())"
    rows = rows.select("doc_id", "_low", "_w", F.expr(at).alias("_at"))
    rows = rows.withColumn("_any", F.expr(f"exists(_at, i -> {pair} in ({_strings(anchors(known, least))}))"))
    # sizes first, by blanks: a unit's words are its blanks and one more; bigrams can repeat, so
    # only the lower bound holds before they are told apart
    sized = F.filter(units(F.col("_low")), lambda u: F.length(u) - F.length(F.translate(u, " ", "")) >= F.lit(shortest))
    passages = F.expr(f"array_sort(concat({', '.join(_runs(k, text, least) for k, (_, text) in enumerate(TEMPLATES) if bigrams(text))}))")
    rows = rows.select("doc_id", F.when(F.col("_any"), sized).alias("_units"), F.when(F.col("_any"), passages).alias("_passages"))
    pairs = F.expr(
        """transform(_units, u -> transform(array(split(u, ' ')), w -> array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))))[0])"""
    )
    some = F.expr(f"filter(_pairs, b -> size(b) between {shortest!r}D and {longest!r}D and arrays_overlap(b, array({_strings(vocabulary)})))")
    scored = F.expr(
        f"""filter(transform(_some, b -> named_struct('b', b, 'x', array_min(transform(
              filter({_literal(known)}, t -> size(t.b) >= size(b) * {ratio!r}D and size(t.b) * {ratio!r}D <= size(b)),
              t -> named_struct('loss', -2.0D * size(array_intersect(b, t.b)) / (size(b) + size(t.b)), 'name', t.name))))), u -> u.x is not null and -u.x.loss >= {least!r}D)"""
    )
    best = rows.withColumn("_pairs", pairs).select("doc_id", "_passages", some.alias("_some")).select("doc_id", "_passages", F.expr("size(_some) > 0").alias("_any"), "_some")
    found = best.select("doc_id", "_passages", F.when(F.col("_any"), scored).alias("_found"))
    apart = "aggregate(slice(_passages, 2, size(_passages)), slice(_passages, 1, 1), (a, p) -> if(exists(a, q -> q.s <= p.e and p.s <= q.e), a, array_append(a, p)))"
    known_unit = "exists(coalesce(_found, array()), u -> u.x.name = p.name and size(array_except(p.b, u.b)) = 0)"
    further = F.expr(f"if(size(_passages) > 0, filter({apart}, p -> not {known_unit}), array())")
    found = found.select("doc_id", "_found", further.alias("_further"))
    good = F.expr("concat(coalesce(transform(_found, u -> u.x), array()), transform(_further, p -> named_struct('loss', p.more, 'name', p.name)))")
    return found.select("doc_id", good.alias("_good")).select(
        "doc_id",
        F.expr("array_sort(array_distinct(transform(_good, x -> x.name)))").alias("licences"),
        F.expr("cast(size(_good) as bigint)").alias("n_matches"),
        F.expr("coalesce(array_max(transform(_good, x -> -x.loss)), 0.0D)").alias("best_score"),
    )
