"""Licence scans by sentence rules (operator 9), in DataFrame functions only.

Known licence sentences have identifiers; a rule is an ordered sequence of identifiers. A text is cut into
pieces at line ends and stops and normalised (lower case, letters and digits, single blanks). A known
sentence is one piece, or goes on over line ends as in wrapped files and headers, but not over a stop or a
blank line; at one place the longest counts, and a list number before it is passed over. Runs of
identifiers with at most MAX_GAP other sentences between two of them are matched against the rules as
sequences; wrapped lines are one sentence there, and blank lines and bare list marks none. A match that a
longer matching rule of the same text contains isn't reported.

All of it happens within the row: no shuffle, so hot sources or copies don't matter. Texts that hold none
of the known sentences' longest words are passed over before anything is cut.

Rows: a null or empty text has no match; a text without match gives no row; a text with several matches
gives a row per rule; repeated rows give repeated results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.llm.common import text_of

#: fixed values: sentences of public licences and of the usual notices
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "all-rights": "All rights reserved",
}
#: rule: licence and the ordered sentences that show it
RULES = {
    "mit-notice": ("MIT", ["mit-notice"]),
    "mit-licensed": ("MIT", ["mit-licensed"]),
    "mit-text": ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    "mit-grant": ("MIT", ["mit-grant"]),
    "apache-notice": ("Apache-2.0", ["apache-notice"]),
    "apache-header": ("Apache-2.0", ["apache-header"]),
    "apache-full-header": ("Apache-2.0", ["apache-header", "apache-copy", "apache-as-is"]),
    "gpl3-notice": ("GPL-3.0-only", ["gpl3-notice"]),
    "gpl3-or-later": ("GPL-3.0-or-later", ["gpl-free"]),
    "gpl3-or-later-full": ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]),
    "bsd-2": ("BSD-2-Clause", ["bsd-redistribution"]),
    "bsd-3": ("BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    "cc-by-notice": ("CC-BY-4.0", ["cc-by-notice"]),
    "cc-by-work": ("CC-BY-4.0", ["cc-by-work"]),
    "cc-by-sa-work": ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
}
#: sentences and rules the SQL twin doesn't know; identifiers of the SPDX list, where GPL-2.0 and its kin (without
#: -only or -or-later, also written with a plus that normalising drops) leave open whether later versions are meant
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    *[f"{name}{end}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("", "-only", "-or-later")],
)
_FREE = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
_LATER = _FREE + ", either version {version} of the License, or (at your option) any later version"
#: licence and the one sentence that shows it
COMMON = {f"spdx-{name.lower()}": (name, f"SPDX-License-Identifier: {name}") for name in SPDX} | {
    "gpl2-or-later": ("GPL-2.0-or-later", _LATER.format(what="program", name="General Public License", version="2")),
    "gpl2-only": ("GPL-2.0-only", _FREE.format(what="program", name="General Public License version 2")),
    "gpl2-notice": ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2"),
    "lgpl21-or-later": ("LGPL-2.1-or-later", _LATER.format(what="library", name="Lesser General Public License", version="2.1")),
    "lgpl21-program": ("LGPL-2.1-or-later", _LATER.format(what="program", name="Lesser General Public License", version="2.1")),
    "lgpl3-or-later": ("LGPL-3.0-or-later", _LATER.format(what="library", name="Lesser General Public License", version="3")),
    "lgpl3-program": ("LGPL-3.0-or-later", _LATER.format(what="program", name="Lesser General Public License", version="3")),
    "agpl3-or-later": ("AGPL-3.0-or-later", _LATER.format(what="program", name="Affero General Public License", version="3")),
    # a stop and a blank follow the v; only version 2.0 speaks of a Source Code Form
    "mpl2-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    "isc-grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "isc-grant-old": ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd-grant": ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain"),
}
ALL_SENTENCES = SENTENCES | {rule: sentence for rule, (_, sentence) in COMMON.items()}
ALL_RULES = RULES | {rule: (licence, [rule]) for rule, (licence, _) in COMMON.items()}
MAX_GAP = 3
#: a piece ends at a line end, or at a stop that white space follows; the header of a licence may go
#: on after a semicolon, so that isn't a stop
STOP = r"[.!?][\x20\x09-\x0D]"
#: in normalised texts a newline stands for a line end, \x01 for a stop, and \x02 and \x03 enclose a known sentence
NOT_WORD = r"[^\p{L}\p{N}\n\x01]+"
END, NO_END = r"[\n\x01]", r"[^\n\x01]"
#: other text between known sentences counts as going on in the next line from this many characters on
WRAPPED = 40
LIST_MARK = r"(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})"


def normal_words(sentence: str) -> str:
    return " ".join(w for w in re.split(r"[\W_]+", sentence.lower()) if w)


def _normal(low: Column) -> Column:
    """The pieces of a lower-cased text as words with single blanks, each between two marks of its ends."""
    stops = F.regexp_replace(F.translate(low, "\x01\x02\x03", "   "), STOP, "\x01")
    return F.concat(F.lit("\x01"), F.btrim(F.regexp_replace(F.regexp_replace(stops, NOT_WORD, " "), f" ?({END}) ?", "$1"), F.lit(" ")), F.lit("\x01"))


def _others(between: Column) -> Column:
    """Number of sentences in the text between two known ones."""
    bare = F.regexp_replace(between, f"(?<={END}){LIST_MARK}(?={END})", "")
    joined = F.regexp_replace(bare, f"(?<={END})({NO_END}{{{WRAPPED},}}+)\\n(?={NO_END})", "$1 ")
    return F.size(F.filter(F.split(joined, END), lambda x: x != ""))


def find_licences(docs: DataFrame, sentences: dict[str, str] = ALL_SENTENCES, rules: dict[str, tuple[str, list[str]]] = ALL_RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """doc_id, licence, rule, first_sentence (number of the first matching sentence, from 0), n_matches."""
    known = {normal_words(text): name for name, text in sentences.items()}
    # computed_once: the optimizer would copy these expressions into every cue test and every lambda
    rows = scale.computed_once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), low=F.lower("text")).drop("text")
    # the longest word of a known sentence stands in every text that holds the sentence
    cues = sorted({max(text.split(), key=len) for text in known})
    any_cue = F.lit(False)
    for cue in cues:
        any_cue = any_cue | F.contains("low", F.lit(cue))
    # the longest first, so that no shorter one is taken where it begins
    either = "|".join(text.replace(" ", "[ \\n]") for text in sorted(known, key=len, reverse=True))
    cut = scale.computed_once(rows.filter(any_cue), marked=F.regexp_replace(_normal(F.col("low")), f"(?<={END})(?:[0-9]{{1,3}} )?({either})(?={END})", "\x02$1\x03")).drop("low")
    cut = cut.filter(F.contains("marked", F.lit("\x02")))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # piece numbers from 0: one more piece begins at each mark
    numbered = F.transform(F.split("marked", END), lambda s, i: F.struct((i - 1).alias("at"), F.startswith(s, F.lit("\x02")).alias("known")))
    found = scale.computed_once(
        cut,
        places=F.transform(F.filter(numbered, lambda s: s["known"]), lambda s: s["at"]),
        names=F.transform(F.regexp_extract_all("marked", F.lit("\x02([^\x03]*)\x03")), lambda s: names[F.translate(s, "\n", " ")]),
        gaps=F.transform(F.regexp_extract_all("marked", F.lit("\x03([^\x02]*+)\x02")), _others),
    ).drop("marked")
    hits = F.arrays_zip(F.col("places").alias("at"), F.col("names").alias("name"), F.concat(F.array(F.lit(0)), "gaps").alias("gap"))
    found = scale.computed_once(found, hits=hits).select("doc_id", "hits")
    # one string per text: identifiers between bars, a double bar where a run breaks
    marked = F.transform("hits", lambda h, i: F.concat(F.when((i > 0) & (h["gap"] > max_gap), F.lit("|")).otherwise(""), h["name"]))
    runs = scale.computed_once(found, run=F.concat(F.lit("|"), F.array_join(marked, "|"), F.lit("|")))
    table = F.array(*[
        F.struct(F.lit(licence).alias("licence"), F.lit(rule).alias("rule"), F.lit("|" + "|".join(ids) + "|").alias("ids"), F.lit(ids[0]).alias("first"), F.lit(len(ids)).alias("n"))
        for rule, (licence, ids) in rules.items()
    ])
    matching = runs.select("doc_id", "hits", "run", F.filter(table, lambda r: F.contains(F.col("run"), r["ids"])).alias("rules"))
    longest = F.filter("rules", lambda r: ~F.exists("rules", lambda o: (o["n"] > r["n"]) & F.contains(o["ids"], r["ids"])))
    each = matching.select("doc_id", "hits", "run", F.explode(longest).alias("r"))
    # identifiers before the match count the sentences before it
    upto = F.expr("substring(run, 1, locate(r.ids, run))")
    place = F.size(F.filter(F.split(upto, r"\|"), lambda x: x != ""))
    ids_twice = F.replace(F.col("run"), F.lit("|"), F.lit("||"))
    inner = F.concat(F.lit("|"), F.replace(F.expr("substring(r.ids, 2, length(r.ids) - 2)"), F.lit("|"), F.lit("||")), F.lit("|"))
    n_matches = ((F.length(ids_twice) - F.length(F.replace(ids_twice, inner, F.lit("")))) / F.length(inner)).cast("long")
    return each.select("doc_id", F.col("r.licence").alias("licence"), F.col("r.rule").alias("rule"), F.col("hits")[place]["at"].cast("long").alias("first_sentence"), n_matches.alias("n_matches"))
