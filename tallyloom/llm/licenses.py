"""License scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences at the end marks before white space and at empty lines,
wrapped lines joined.  One that isn't known as a whole is cut at its line ends, and
its lines count, so that both layouts may stand in one paragraph.  Each sentence is normalised (letters A-Z lowered; runs of anything but
a-z and 0-9 become one blank) and looked up among the known licence sentences.
The identifiers found, in the order of the text, form a sequence; RULES, tried in
their order at each place of the sequence, turn runs of identifiers into
licences.  Sentences that aren't known don't break a run.

No shuffle: each row is worked out by itself.  Null and empty texts have no
sentences: counts of 0, empty strings.  Repeated rows get one row each, those of null doc_id too.
Texts of any length are scanned whole.  Empty table: no rows.
Only doc_id and text are read: other columns, also of clashing names, change nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import pick

# Known licence sentences by identifier, written as published.
SENTENCES = {
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2",
    "gpl3-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl2-only-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl3-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-licensed": "Licensed under the BSD 2-Clause License",
    "bsd3-licensed": "Licensed under the BSD 3-Clause License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-licensed": "Licensed under the ISC License",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-licensed": "Licensed under the Mozilla Public License 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost": "Distributed under the Boost Software License, Version 1.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0": "Licensed under CC0 1.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
# Ordered rules, the longer run of a licence before its parts.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-project"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply", "apache2-copy", "apache2-as-is"]),
    ("Apache-2.0", ["apache2-header", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", ["apache2-header"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("AGPL-3.0-or-later", ["agpl3-terms", "gpl-no-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-terms"]),
    ("LGPL-3.0-or-later", ["lgpl3-terms", "gpl-no-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-terms"]),
    ("GPL-3.0-or-later", ["gpl3-terms", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-terms"]),
    ("GPL-3.0-or-later", ["spdx-gpl3"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-2.0-or-later", ["gpl2-terms", "gpl-no-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-terms"]),
    ("GPL-2.0-only", ["gpl2-only-terms"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-licensed"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("BSD-2-Clause", ["bsd2-licensed"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-licensed"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("MPL-2.0", ["mpl2-licensed"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC0-1.0", ["cc0"]),
]
LINES = r"[.!?]+[ \t\r\n]+|[.!?]+\z|\n+"
PARAGRAPHS = r"[.!?]+[ \t\r\n]+|[.!?]+\z|\n[ \t\r]*\n[ \t\r\n]*"
#: Every known sentence has one of these within a word; texts without any are passed by.
CUES = ["licens", "permission", "redistribut", "software", "warrant", "copyright"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised form to identifier; a sentence that the cuts divide counts by its parts, numbered."""
    out = {}
    for name, text in sentences.items():
        parts = [p for p in (normal(x) for x in re.split(LINES.replace(r"\z", r"\Z"), text)) if p]
        for k, part in enumerate(parts):
            out.setdefault(part, name if len(parts) == 1 else f"{name}-{k + 1}")
    return out


def rules_by_run(rules, sentences) -> dict[str, str]:
    """Marked run of identifiers to licence, in the order of the rules."""
    parts = {name: [i for i in known({name: text}).values()] for name, text in sentences.items()}
    out: dict[str, str] = {}
    for licence, names in rules:
        out.setdefault("".join(f"<{i}>" for n in names for i in parts[n]), licence)
    return out


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None, cues: list[str] | None = None) -> DataFrame:
    """doc_id, n_cuts, n_known, sentence_ids, licenses (distinct, comma-joined, sorted), n_licenses for each row."""
    sentences, rules, cues = sentences or SENTENCES, rules or RULES, cues or CUES
    table, runs = known(sentences), rules_by_run(rules, sentences)
    if missed := [s for s in table if not any(c in w for c in cues for w in s.split())]:
        raise ValueError(f"no cue stands in: {missed}")
    ids = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in runs.items() for x in kv])
    lowered = pick(docs, "doc_id", "text").select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    cue = F.lit(False)
    for c in cues:
        cue = cue | F.contains("low", F.lit(c))

    def id_of(sentence):
        return ids[F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))]

    def ids_of(sentence):
        whole = id_of(sentence)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.split(sentence, "\n+"), id_of))

    pieces = F.transform(F.split("low", PARAGRAPHS), ids_of)
    known_ids = F.filter(F.flatten(pieces), lambda i: i.isNotNull())
    found = lowered.select("doc_id", F.regexp_count("low", F.lit(LINES)).cast("long").alias("n_cuts"), F.when(cue, known_ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    pattern = "|".join(re.escape(r).replace(r"\-", "-") for r in runs)
    sequence = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    hits = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(sequence, F.lit(pattern), F.lit(0)), lambda r: names[r])))
    return found.select(
        "doc_id",
        "n_cuts",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(hits, ",").alias("licenses"),
        F.size(hits).cast("long").alias("n_licenses"),
    )


def oracle() -> str:
    """The same in SQL for another engine."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table, runs = known(SENTENCES), rules_by_run(RULES, SENTENCES)
    as_map = lambda d: "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"
    cue = " OR ".join(f"contains(low, {q(c)})" for c in CUES)
    pattern = "|".join(re.escape(r).replace(r"\-", "-") for r in runs)

    def id_of(sentence: str) -> str:
        return f"map_extract(t, trim(regexp_replace({sentence}, '[^a-z0-9]+', ' ', 'g')))[1]"

    return f"""
WITH known AS (SELECT {as_map(table)} AS t),
l AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
p AS (SELECT doc_id, len(regexp_extract_all(low, {q(LINES)})) AS n_cuts, CASE WHEN {cue} THEN list_transform(regexp_split_to_array(low, {q(PARAGRAPHS)}),
  lambda s: CASE WHEN {id_of('s')} IS NOT NULL THEN [{id_of('s')}] ELSE list_transform(regexp_split_to_array(s, '\n+'), lambda x: {id_of('x')}) END) ELSE []::VARCHAR[][] END AS pieces FROM l, known),
f AS (SELECT doc_id, n_cuts, list_filter(flatten(pieces), lambda i: i IS NOT NULL) AS ids FROM p),
h AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), {q(pattern)}), lambda r: map_extract({as_map(runs)}, r)[1]))) AS hits FROM f)
SELECT doc_id, n_cuts::BIGINT AS n_cuts, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(hits, ','), '') AS licenses, len(hits)::BIGINT AS n_licenses FROM h
"""
