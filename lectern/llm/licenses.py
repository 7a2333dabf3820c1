"""License scans by diagonal voting.

Every rolling word ``K``-gram of every document is joined by hash to the positions it has in the
templates. A hit at word p of the document and word q of a template votes for the diagonal p - q;
votes are added up by document, template and diagonal. Neighbouring diagonals, at most ``DRIFT``
apart and overlapping in the document, are one span with words inserted or dropped. Spans of one
template that lie no farther apart than ``MIN_SCORE`` lets words be inserted or dropped are a
cluster. In clusters with enough votes every span, and every union of neighbouring ones that isn't
too long, is verified on the text: the longest common word subsequence with the template must
reach ``MIN_SCORE`` of the longer of the two, and of each group of ``MARKS`` that the template holds
(what tells a licence from its siblings: name, version, conditions) the span must hold one, or have
it at most ``DRIFT`` words off, which makes it part of the span.

The template table is fixed and small (its bytes are bounded before it is broadcast); the votes
are combined before they are shuffled; the documents with spans are broadcast where their measured
size allows, and joined by shuffle beyond that; texts are read again only for them. Templates are
notices, grants and conditions of licences, and the lines that name one by its SPDX identifier.

Defined cases: a text of any length is scanned whole; a null, empty or shorter text has no grams and no spans; a null doc_id is carried
along and told apart by its text; rows that repeat a doc_id with the same text give the spans
once; of spans that overlap, whatever the template, the one with the most words in common stays, ties going
to the better score and then to the first; an empty table gives an empty result; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm._small import MAX_BROADCAST_BYTES, small
from lectern.llm._vec import U64, as_i64, column_bytes, gram_hashes, mix, row_words, slices, span_hashes, word_spans

K, DRIFT, MIN_VOTES, MIN_SCORE = 3, 3, 0.2, 0.7

#: Identifiers that a line of ``SPDX-License-Identifier`` may name.
SPDX = tuple(
    """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
    CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2
    GFDL-1.3-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
    LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib""".split()
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any " "person obtaining a copy of this software and associated " "documentation files (the \"Software\"), to deal in the Software " "without restriction, including without limitation the rights to use, " "copy, modify, merge, publish, " "distribute, sublicense, and/or sell copies " "of the Software, and to permit persons to whom " "the Software is furnished to do so, subject to " "the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall " "be included in all copies or substantial portions of " "the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("NCSA", "Licensed under the University of Illinois/NCSA Open Source License."),
    ("LGPL-2.1", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation"),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
)

#: Groups of equivalent phrases; a template asks for those groups that its own text holds.
MARKS: tuple[tuple[str, ...], ...] = (
    ("mit license", "mit licence"), ("isc",), ("apache",), ("mozilla",), ("cc0",), ("bsd 2",), ("bsd 3",), ("neither the name",), ("appear in all copies",),
    ("gnu general public", "gnu gpl"), ("gnu lesser general public", "gnu lgpl"), ("gnu affero general public", "gnu agpl"),
    *((f"version {v}", f"v {v}", f"v{v}", f"license {v}", f"licence {v}") for v in ("1.0", "1.1", "2.0", "2.1")), ("version 2", "v 2", "v2"), ("version 3", "v 3", "v3"),
    ("cc by 4.0", "attribution 4.0"), ("by sa 4.0", "attribution sharealike 4.0"), ("by nd 4.0", "attribution noderivatives 4.0", "attribution noderivs 4.0"), ("by nc 4.0", "attribution noncommercial 4.0"),
    ("attribution 3.0",), ("attribution sharealike 3.0",), ("by advertising", "all advertising"), ("boost software",), ("eclipse public license 2.0", "eclipse public license v 2.0", "eclipse public license v2.0"),
    ("eclipse public license 1.0", "eclipse public license v 1.0", "eclipse public license v1.0"), ("eupl",), ("common development and distribution",), ("without a written agreement",), ("open font",), ("artistic",), ("ncsa",),
    ("free documentation license version 1.3",), ("free documentation license version 1.2",), ("person or organization",), ("you want to public license",), ("unencumbered",), *((f"identifier {name}",) for name in SPDX),
    ("by nc sa 4.0", "attribution noncommercial sharealike 4.0"), ("by nc nd 4.0", "attribution noncommercial noderivatives 4.0", "attribution noncommercial noderivs 4.0"),
)


def template_words(templates: tuple[tuple[str, str], ...]) -> list[np.ndarray]:
    words, first = row_words(pa.array([t for _, t in templates], pa.string()))
    return [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where a phrase begins."""
    n = len(words) - len(phrase) + 1
    return np.flatnonzero(np.all([words[i : i + n] == w for i, w in enumerate(phrase)], axis=0)) if n > 0 else np.zeros(0, np.int64)


def template_marks(bodies: list[np.ndarray]) -> list[list[list[np.ndarray]]]:
    """Of each template, the groups of phrases it asks for."""
    groups = [template_words(tuple(("", x) for x in g)) for g in MARKS]
    return [[g for g in groups if any(len(_places(body, x)) for x in g)] for body in bodies]


def marked(words: np.ndarray, lo: int, hi: int, marks: list[list[np.ndarray]]) -> tuple[int, int] | None:
    """[lo, hi), or as little more as holds a phrase of every group; None if one has none within reach."""
    first, end = lo, hi
    for group in marks:
        near = []
        for x in group:
            a = max(0, lo - DRIFT - len(x))
            near += [(max(0, lo - p) + max(0, p + len(x) - hi), p, p + len(x)) for p in (_places(words[a : hi + DRIFT + len(x)], x) + a).tolist()]
        if not near:
            return None
        _, p, q = min(near)
        first, end = min(first, p), max(end, q)
    return first, end


def _row_key(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the whole text of each row."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    acc = np.concatenate([[U64(0)], np.cumsum(mix(words + place.astype(U64)))])
    return as_i64(acc[first[1:]] - acc[first[:-1]])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column("text")):
            data, starts, ends = column_bytes(pc.utf8_lower(b.column("text").slice(lo, hi - lo)))
            s, e, first = word_spans(data, starts, ends)
            words = span_hashes(data, s, e) if len(s) else np.zeros(0, U64)
            key = _row_key(words, first)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            place = np.arange(len(words)) - first[row]
            ok = first[row + 1] - np.arange(len(words)) >= K
            at = np.flatnonzero(ok)
            ids = b.column("doc_id").take(pa.array(row[at] + lo))
            yield pa.RecordBatch.from_arrays([ids, pa.array(key[row[at]]), pa.array(place[at].astype(np.int32)), pa.array(as_i64(gram_hashes(words, K)[at]))], ["doc_id", "row", "p", "gram"])


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(gram, t, q): the positions of every gram of every template."""
    rows = [(int(g), t, q) for t, w in enumerate(template_words(templates)) if len(w) >= K for q, g in enumerate(as_i64(gram_hashes(w, K)[: len(w) - K + 1]))]
    return spark.createDataFrame(rows or [], "gram bigint, t int, q int")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    run = np.zeros(len(b) + 1, np.int64)
    for x in a:
        run[1:] = np.maximum.accumulate(np.maximum(run[1:], np.where(b == x, run[:-1] + 1, 0)))
    return int(run[-1])


def best_window(words: np.ndarray, template: np.ndarray, lo: int, hi: int, marks: list[list[np.ndarray]] = ()) -> tuple[float, int, int]:
    """(score, first word, end) of the span around [lo, hi) that fits the template best: its ends sit on common words. 0 without its marks."""
    shared = np.isin(words, template)
    size = len(template)
    a, b = max(0, lo - size), min(len(words), hi + size)
    room = size * (1 - MIN_SCORE) / MIN_SCORE  # words of its own that a good span may have

    def outward(at: int, step: int) -> list[int]:
        """Ends of the span on one side: behind common words, then over gaps of up to ``DRIFT`` words to the next common ones."""
        out, foreign = [], 0
        while True:
            begin = at
            while a <= at + min(step, 0) and at + max(step, 0) <= b and shared[at + min(step, 0)]:
                at += step
            if not out or at != begin:
                out.append(at)
            gap = next((g for g in range(1, DRIFT + 1) if a <= at + step * g + min(step, 0) and at + step * g + max(step, 0) <= b and shared[at + step * g + min(step, 0)]), None)
            if gap is None or (foreign := foreign + gap) > room:
                return out
            at += step * gap

    def measured(p: int, q: int) -> tuple[float, int, int]:
        if (span := marked(words, p, q, marks)) is None:
            return 0.0, lo, hi
        p, q = span
        return common(words[p:q], template) / max(q - p, size, 1), p, q

    starts, ends = outward(lo, -1), outward(hi, 1)
    best = max(measured(lo, hi), measured(starts[0], ends[0]))
    if best[0] < 1.0 and (len(starts) > 1 or len(ends) > 1):  # edits near the ends
        start = max(starts, key=lambda p: measured(p, ends[0])[0])
        best = max(best, *(measured(start, q) for q in ends))
    return best


def unions(spans: list[dict], sizes: list[int]) -> list[tuple[int, int, int]]:
    """(template, first word, end) of the spans with enough votes and the unions of neighbours in a cluster that a score of ``MIN_SCORE`` leaves room for."""
    out = set()
    for i, x in enumerate(spans):
        size, hi, votes = sizes[x["t"]], 0, 0
        for y in spans[i:]:
            hi, votes = max(hi, y["p1"]), votes + y["votes"]
            if (y["t"], y["cluster"]) != (x["t"], x["cluster"]) or y is not x and (hi - x["p0"]) * MIN_SCORE > size:
                break
            if votes >= max(1, MIN_VOTES * (size - (K - 1))):
                out.add((x["t"], x["p0"], hi))
    return sorted(out)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start_char, end_char, score) of every verified notice."""
    spark = docs.sparkSession
    sizes = [len(w) for w in template_words(templates)]
    text = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")
    where = template_table(spark, templates)
    if 16 * sum(sizes) <= MAX_BROADCAST_BYTES:  # a row of it is three numbers
        where = F.broadcast(where)
    hits = text.mapInArrow(_grams, "doc_id bigint, row bigint, p int, gram bigint").join(where, "gram")
    votes = hits.groupBy("doc_id", "row", "t", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.count_distinct("p").alias("votes"), F.min("p").alias("p0"), (F.max("p") + K).alias("p1"))
    w = Window.partitionBy("doc_id", "row", "t").orderBy("diagonal", "p0")
    votes = votes.withColumn("new", F.when((F.col("diagonal") - F.lag("diagonal").over(w) <= DRIFT) & (F.col("p0") <= F.lag("p1").over(w) + DRIFT) & (F.col("p1") + DRIFT >= F.lag("p0").over(w)), 0).otherwise(1))
    votes = votes.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.array(*[F.lit(n) for n in sizes])[F.col("t")] if sizes else F.lit(0)
    spans = votes.groupBy("doc_id", "row", "t", "span").agg(F.sum("votes").alias("votes"), F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    near = Window.partitionBy("doc_id", "row", "t").orderBy("p0", "p1", "span")
    reach = F.greatest(F.lit(DRIFT), F.floor(size * ((1 - MIN_SCORE) / MIN_SCORE)))
    spans = spans.withColumn("new", F.when(F.col("p0") <= F.max("p1").over(near.rowsBetween(Window.unboundedPreceding, -1)) + reach, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.greatest(F.lit(1.0), F.lit(MIN_VOTES) * (size - (K - 1)))
    spans = spans.withColumn("all", F.sum("votes").over(Window.partitionBy("doc_id", "row", "t", "cluster"))).where(F.col("all") >= least)
    found = spans.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("t", "cluster", "p0", "p1", "votes"))).alias("spans")).withColumnsRenamed({"doc_id": "d"}).checkpoint()
    found = small(found)
    back = text.join(found, text["doc_id"].eqNullSafe(found["d"])).select("doc_id", "text", "row", "spans")
    names = [n for n, _ in templates]
    bodies = template_words(templates)
    marks = template_marks(bodies)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                one = b.column("text").slice(r, 1)
                data, s, e = column_bytes(pc.utf8_lower(one))
                ws, we, first = word_spans(data, s, e)
                words = span_hashes(data, ws, we)
                if _row_key(words, first)[0] != b.column("row")[r].as_py():
                    continue  # another row of this doc_id
                chars = np.cumsum((data & 0xC0) != 0x80) - 1
                spans = []
                for t, lo, hi in unions(b.column("spans")[r].as_py(), sizes):
                    score, p, q = best_window(words, bodies[t], lo, hi, marks[t])
                    if score >= MIN_SCORE:
                        spans.append((-round(score * max(q - p, sizes[t])), -score, p, q, names[t]))
                taken: list[tuple[int, int]] = []
                for _, score, p, q, name in sorted(spans):
                    if all(q <= a or p >= z for a, z in taken):
                        taken.append((p, q))
                        out.append((b.column("doc_id")[r].as_py(), name, int(chars[ws[p]]), int(chars[we[q - 1] - 1]) + 1, -score))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "license", "start_char", "end_char", "score"])

    return back.mapInArrow(verify, "doc_id bigint, license string, start_char bigint, end_char bigint, score double").distinct()
