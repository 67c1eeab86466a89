"""License scans by sentence rules.

Each text is cut into sentences (blank lines, and sentence ends followed by white space), each sentence is normalised (lower
case, anything but a-z and 0-9 one space) and looked up among the known licence sentences. A sentence may be wrapped over
lines and stand behind comment marks; where it is not known as a whole, known sentences of INSIDE words or more are found
anywhere in it, whatever stands before and after (a title, a copyright line, the first point of a list), and each of its
lines is looked up, so that a short licence line between lines of prose counts too. The identifiers that are found, in order
(of a sentence that is not known, those of its lines before those inside it), are matched against rules, each an ordered
list of identifiers that may have other ones between them.
All of it is one projection: the tables of sentences and rules are constants of this module.

Defined cases: a null text is an empty text, with no sentence; a text without a known sentence has empty lists;
rows are taken one by one, so repeated rows give repeated results; a licence is listed once however often it is met; a line
with neither letter of a-z nor digit is a blank line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import let, table

#: Known sentences, normalised, by identifier: the sentences of the licences' own texts and notices, and short notices. Fixed values.
SENTENCES = {
    "licensed under the apache license version 2 0": 1,
    "licensed under the apache license version 2 0 the license": 1,
    "this project is licensed under the apache license 2 0": 1,
    "you may not use this file except in compliance with the license": 2,
    "you may obtain a copy of the license at": 3,
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": 4,
    "see the license for the specific language governing permissions and limitations under the license": 5,
    "released under the mit license": 10,
    "licensed under the mit license": 10,
    "this project is licensed under the mit license": 10,
    "mit license": 11,
    "the mit license": 11,
    "the mit license mit": 11,
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 12,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 13,
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": 14,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 16,
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": 17,
    "this work is licensed under the gnu general public license version 3": 20,
    "licensed under the gnu general public license version 3": 20,
    "this program is free software": 21,
    "you can redistribute it and or modify it under the terms of the gnu general public license": 22,
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": 22,
    "either version 3 of the license or at your option any later version": 23,
    "this work is licensed under the gnu general public license version 2": 24,
    "either version 2 of the license or at your option any later version": 25,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 26,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": 27,
    "this library is free software": 28,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": 29,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 30,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 31,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": 32,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 33,
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": 34,
    "either version 2 1 of the license or at your option any later version": 35,
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 33,
    "this software is provided by the copyright holders and contributors as is": 34,
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 36,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 36,
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": 40,
    "this work is licensed under the creative commons attribution 4 0 international license": 41,
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": 42,
    "licensed under cc by nc 4 0": 40,
    "licensed under cc by 4 0": 41,
    "licensed under cc by sa 4 0": 42,
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": 40,
    "this work is licensed under a creative commons attribution 4 0 international license": 41,
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": 42,
    "all rights reserved": 50,
    "this work is dedicated to the public domain": 60,
    "this is free and unencumbered software released into the public domain": 61,
    "this source code form is subject to the terms of the mozilla public license v": 70,
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": 71,
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": 71,
}
#: Licence, whether its texts may be used freely, and the identifiers in their order; those of an inner list follow at once. Fixed values.
RULES = (
    ("AGPL-3.0", False, (27,)),
    ("Apache-2.0", True, (1,)),
    ("Apache-2.0", True, (2, 3)),
    ("BSD-2-Clause", True, (30, 31, (32, 34))),
    ("BSD-3-Clause", True, (30, 31, 32, 33)),
    ("CC-BY-4.0", True, (41,)),
    ("CC-BY-NC-4.0", False, (40,)),
    ("CC-BY-SA-4.0", False, (42,)),
    ("CC0-1.0", True, (60,)),
    ("GPL-2.0", False, (24,)),
    ("GPL-2.0", False, (21, 22, 25)),
    ("GPL-3.0", False, (20,)),
    ("GPL-3.0", False, (26,)),
    ("GPL-3.0", False, (21, 22, 23)),
    ("ISC", True, (16, 17)),
    ("LGPL-2.1", False, (28, 29, 35)),
    ("LGPL-3.0", False, (36,)),
    ("LGPL-3.0", False, (28, 29, 23)),
    ("MIT", True, (10,)),
    ("MIT", True, (12, 13, 14)),
    ("MPL-2.0", False, (70, 71)),
    ("Proprietary", False, (50,)),
    ("Unlicense", True, (61,)),
)
#: Each licence's SPDX line, as one more sentence with an identifier and a rule of its own.
_FREE = {name: free for name, free, _ in RULES}
SPDX = {name: 100 + i for i, name in enumerate(sorted(_FREE)) if name != "Proprietary"}
SENTENCES |= {re.sub("[^a-z0-9]+", " ", f"spdx license identifier {name}".lower()): i for name, i in SPDX.items()}
RULES += tuple((name, _FREE[name], (i,)) for name, i in SPDX.items())

CUT = "[.!?;][\\x20\\x09-\\x0D]+|\\n[^A-Za-z0-9\\n]*\\n"
#: No known sentence is longer or shorter; others need not be looked up.
SHORTEST, LONGEST = min(map(len, SENTENCES)), max(map(len, SENTENCES))


#: Words that a known sentence has at least to be found inside another one; and words of which every such sentence has one, so that others need
#: not be searched.
INSIDE = 8
LONG = sorted((s for s in SENTENCES if s.count(" ") >= INSIDE - 1), key=lambda s: (-len(s), s))
CUES = "licen[sc]e|software|conditions|copyright|free of charge|mpl |public domain"
WITHIN = f"\\b({'|'.join(LONG)})\\b"


def _pattern(ids: tuple) -> str:
    parts = (",".join(map(str, i)) if isinstance(i, tuple) else str(i) for i in ids)
    return ",([0-9]+,)*".join(parts).join((",", ","))


def _known(normal: Column) -> Column:
    """The identifier of a normalised sentence, or null."""
    known = F.create_map(*[F.lit(x) for s in SENTENCES.items() for x in s])
    return F.when(F.length(normal).between(SHORTEST, LONGEST), F.try_element_at(known, normal))


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def _ids(s: Column) -> Column:
    """The identifiers of a sentence: its own, else those of its lines that are short ones, and of the long ones inside it."""

    def inside(n: Column) -> Column:
        return F.when(n.rlike(CUES), F.transform(F.regexp_extract_all(n, F.lit(WITHIN), F.lit(1)), _known)).otherwise(F.array().cast("array<int>"))

    def short(line: Column) -> Column:
        return let(_normal(line), lambda n: F.when(F.length(F.regexp_replace(n, "[^ ]", "")) < INSIDE - 1, _known(n)))

    def parts(n: Column) -> Column:
        return F.concat(F.array_compact(F.transform(F.split(s, "\n", -1), short)), inside(n))

    return let(_normal(s), lambda n: let(_known(n), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(parts(n))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_sentences, sentence_ids (in order), licenses (sorted names) and restricted."""
    sentences = F.split(F.coalesce(F.col(text), F.lit("")), CUT, -1)
    whole = let(F.filter(sentences, lambda s: F.lower(s).rlike("[a-z0-9]")), lambda n: F.struct(
        F.size(n).cast("long").alias("n"), F.flatten(F.transform(n, _ids)).alias("ids"),
    ))
    out = docs.withColumn("__found", whole)
    line = F.concat(F.lit(","), F.array_join("__found.ids", ","), F.lit(","))
    hit = out.withColumn("__line", line)
    met = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col("__line").rlike(_pattern(ids)), F.lit(name)) for name, _, ids in RULES]))))
    closed = [name for name, free, _ in RULES if not free]
    return (
        hit.withColumn("n_sentences", F.col("__found.n"))
        .withColumn("sentence_ids", F.array_join("__found.ids", ","))
        .withColumn("__met", met)
        .withColumn("licenses", F.array_join("__met", ","))
        .withColumn("restricted", F.arrays_overlap("__met", F.array(*map(F.lit, sorted(set(closed))))))
        .drop("__found", "__line", "__met")
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "sentence_ids", "licenses", "restricted")


_KNOWN = ", ".join(f"('{s}', {i})" for s, i in SENTENCES.items())
_RULES = ", ".join(f"('{n}', {'true' if f else 'false'}, '{_pattern(i)}')" for n, f, i in RULES)
_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

OP10_SQL = f"""
WITH known(s, id) AS (VALUES {_KNOWN}), rules(name, free, pattern) AS (VALUES {_RULES}),
d AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{CUT}') AS ss FROM documents),
n AS (SELECT doc_id, CAST(len(list_filter(ss, lambda s: regexp_matches(lower(s), '[a-z0-9]'))) AS BIGINT) AS n_sentences FROM d),
s AS (SELECT doc_id, unnest(ss) AS raw, generate_subscripts(ss, 1) AS i FROM d),
w AS (SELECT doc_id, raw, i, {_NORMAL.format('raw')} AS normal, id FROM s LEFT JOIN known ON {_NORMAL.format('raw')} = known.s),
p AS (SELECT doc_id, i, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS j FROM w WHERE id IS NULL),
x AS (SELECT doc_id, i, regexp_extract_all(normal, '{WITHIN}', 1) AS met FROM w WHERE id IS NULL),
y AS (SELECT doc_id, i, unnest(met) AS s, generate_subscripts(met, 1) AS j FROM x),
a AS (SELECT doc_id, i, 0 AS k, 0 AS j, id FROM w WHERE id IS NOT NULL
      UNION ALL SELECT doc_id, i, 1, j, known.id FROM p JOIN known ON {_NORMAL.format('line')} = known.s WHERE length(regexp_replace(known.s, '[^ ]', '', 'g')) < {INSIDE - 1}
      UNION ALL SELECT doc_id, i, 2, j, known.id FROM y JOIN known ON known.s = y.s),
f AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i, k, j) AS ids FROM a GROUP BY doc_id),
m AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, bool_or(NOT free) AS restricted
      FROM (SELECT DISTINCT doc_id, name, free FROM f JOIN rules ON regexp_matches(',' || ids || ',', pattern)) GROUP BY doc_id)
SELECT n.doc_id, n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(restricted, false) AS restricted
FROM n LEFT JOIN f ON f.doc_id = n.doc_id LEFT JOIN m ON m.doc_id = n.doc_id
"""
