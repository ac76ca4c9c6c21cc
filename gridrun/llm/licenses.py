"""Licence scan by sentence rules; DataFrame functions only.

Texts that hold a word every known sentence needs are split at line ends and sentence ends. One piece, or several
in a row (wrapped lines), normalised to lower-case words, is looked up in the table of known licence sentences. The
identifiers of a text in order of place are then matched against the licence rules in their order; what a rule
has matched is used up.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd3-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "bsd2-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3-later-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl2-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "lgpl-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-spdx": "SPDX-License-Identifier: MPL-2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Licence rules in their order; identifiers that must follow one another.
RULES = [
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-basis")),
    ("Apache-2.0", ("apache-notice", "apache-comply")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("LGPL-3.0-or-later", ("lgpl-later",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-grant",)),
    ("MPL-2.0", ("mpl-form",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-spdx",)),
    ("ISC", ("isc-spdx",)),
    ("BSD-3-Clause", ("bsd3-spdx",)),
    ("BSD-2-Clause", ("bsd2-spdx",)),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-spdx",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-spdx",)),
    ("GPL-3.0-or-later", ("gpl3-later-spdx",)),
    ("GPL-2.0-only", ("gpl2-spdx",)),
    ("MPL-2.0", ("mpl-spdx",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
]
#: A text without any of these, in lower case, holds no known sentence.
NEEDED = ("licens", "permi", "redistribut", "warrant", "copyright", "unencumbered")
BREAK = r"\n|[.!?;:](?:\s+|$)"
PIECES = 12


def normal(sentence: str) -> str:
    """Lower-case words of letters and digits, one blank between."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


KNOWN = {normal(text): name for name, text in SENTENCES.items()}
assert len(KNOWN) == len(SENTENCES) and all(any(w in s for w in NEEDED) for s in KNOWN)


def known_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, key, at, sentence``: known sentences by piece; ``key`` tells rows with one doc_id and other texts apart."""
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(KNOWN.items()), "normal string, sentence string"))  # a fixed table
    low = F.lower("text")
    hopeful = docs.select("doc_id", "text").where(F.greatest(*[low.contains(w) for w in NEEDED]))
    pieces = hopeful.select("doc_id", F.xxhash64("text").alias("key"), F.split(low, BREAK).alias("raw"))
    pieces = pieces.withColumn("pieces", F.transform("raw", lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))).drop("raw")
    starts = pieces.select("doc_id", "key", "pieces", F.explode(F.sequence(F.lit(1), F.size("pieces"))).alias("at"))
    starts = starts.select("doc_id", "key", "at", F.slice("pieces", F.col("at"), PIECES).alias("next")).where(F.element_at("next", 1) != "")
    tries = starts.select("doc_id", "key", "at", "next", F.explode(F.sequence(F.lit(1), F.size("next"))).alias("many"))
    tries = tries.select("doc_id", "key", "at", "many", F.concat_ws(" ", F.slice("next", F.lit(1), F.col("many"))).alias("normal"))
    return tries.join(table, "normal").groupBy("doc_id", "key", "at").agg(F.max_by("sentence", "many").alias("sentence"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per text with a known sentence: ``doc_id, n_sentences, sentences, licenses, n_unused``.

    ``sentences`` are the identifiers in order of place, ``licenses`` the licences of the rules that match, each once
    and in rule order, both joined by commas; ``n_unused`` counts identifiers that no rule used. Null and empty texts
    and texts without a known sentence give no row; rows with the same doc_id and text give one. Texts are whole. A
    text's own findings are gathered in one place, which grows with that text alone.
    """
    found = known_sentences(docs).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("all"))
    out = found.select("doc_id", F.size("all").cast("long").alias("n_sentences"), F.array_join("all.sentence", ",").alias("sentences"))
    out = out.withColumn("_rest", F.concat(F.lit(","), F.regexp_replace("sentences", ",", ",,"), F.lit(",")))
    names = []
    for i, (license_name, ids) in enumerate(RULES):
        pattern = ",,".join(ids)
        names.append(F.when(F.col(f"_m{i}"), F.lit(license_name)))
        out = out.withColumn(f"_m{i}", F.col("_rest").contains(f",{pattern},")).withColumn("_rest", F.replace("_rest", F.lit(f",{pattern},"), F.lit("|")))
    used = F.array_distinct(F.array_compact(F.array(*names)))
    unused = F.regexp_count("_rest", F.lit("[^,|]+"))
    return out.select("doc_id", "n_sentences", "sentences", F.array_join(used, ",").alias("licenses"), unused.cast("long").alias("n_unused"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(n)}, {quote(s)})" for n, s in sorted(KNOWN.items()))
    steps, names, last = [], [], "s"
    for i, (license_name, ids) in enumerate(RULES):
        pattern = quote("," + ",,".join(ids) + ",")
        steps.append(f"r{i} AS (SELECT * REPLACE (replace(rest, {pattern}, '|') AS rest), contains(rest, {pattern}) AS m{i} FROM {last})")
        names.append(f"CASE WHEN m{i} THEN {quote(license_name)} END")
        last = f"r{i}"
    return f"""
WITH known(normal, sentence) AS (VALUES {known}),
d AS (SELECT DISTINCT doc_id, text, regexp_split_to_array(lower(text), '{BREAK}') AS raw FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, [trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) for x in raw] AS pieces FROM d
      WHERE regexp_matches(lower(text), '{"|".join(NEEDED)}')),
t AS (SELECT doc_id, text, pieces, unnest(generate_series(1, len(pieces))) AS pos FROM p),
u AS (SELECT doc_id, text, pieces, pos, unnest(generate_series(1, least({PIECES}, len(pieces) - pos + 1))) AS many FROM t WHERE pieces[pos] <> ''),
k AS (SELECT doc_id, text, pos, max_by(sentence, many) AS sentence
      FROM (SELECT u.*, array_to_string([x for x in pieces[pos:pos+many-1]], ' ') AS normal FROM u) v JOIN known USING (normal) GROUP BY doc_id, text, pos),
s AS (SELECT doc_id, count(*) AS n_sentences, string_agg(sentence, ',' ORDER BY pos) AS sentences,
             ',' || string_agg(sentence, ',,' ORDER BY pos) || ',' AS rest FROM k GROUP BY doc_id, text),
{", ".join(steps)},
l AS (SELECT *, [x for x in [{", ".join(names)}] if x IS NOT NULL] AS found FROM {last})
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentences,
       array_to_string([found[i] for i in generate_series(1, len(found)) if list_position(found, found[i]) = i], ',') AS licenses,
       CAST(len(regexp_extract_all(rest, '[^,|]+')) AS BIGINT) AS n_unused
FROM l
"""
