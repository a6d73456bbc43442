"""Licence scan by sentence rules, in DataFrame functions only: sentences become identifiers, identifier sequences match ordered rules."""
from pyspark.sql import functions as F

#: Normalised sentence -> identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "licensed under cc by nc 4 0": "ccbync4-ref",
    "licensed under cc by 4 0": "ccby4-ref",
    "licensed under cc by sa 4 0": "ccbysa4-ref",
    "all rights reserved": "reserved",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl2-ref",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl1-ref",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-ref",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
}
THIRD = "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
SENTENCES |= {THIRD.format(x): "bsd-third" for x in ("the copyright holder", "the copyright holders", "the author", "the organization", "the university")}
for _n, _k in (("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl")):
    _t = f"you can redistribute it and or modify it under the terms of the {_n} as published by the free software foundation"
    SENTENCES[_t] = f"{_k}-terms"
    for _v, _i in (("2", "2"), ("2 1", "21"), ("3", "3")):
        _e = f"either version {_v} of the license or at your option any later version"
        SENTENCES |= {f"{_t} {_e}": f"{_k}{_i}-ref", _e: f"version{_i}"}
#: Names by which a licence is referred to, normalised, with its identifier.
NAMES = {
    "mit license": "mit", "mit": "mit", "apache license version 2 0": "apache2", "apache license 2 0": "apache2", "apache 2 0 license": "apache2", "apache 2 0": "apache2", "bsd 2 clause license": "bsd2", "bsd 2 clause": "bsd2",
    "bsd 3 clause license": "bsd3", "bsd 3 clause": "bsd3", "isc license": "isc", "isc": "isc", "mozilla public license version 2 0": "mpl2", "mozilla public license 2 0": "mpl2", "mpl 2 0": "mpl2",
    "gnu general public license version 2": "gpl2", "gnu general public license version 3": "gpl3", "gnu general public license v2 0": "gpl2", "gnu general public license v3 0": "gpl3", "gplv2": "gpl2", "gplv3": "gpl3", "gpl 2 0": "gpl2", "gpl 3 0": "gpl3",
    "gnu lesser general public license version 2 1": "lgpl21", "gnu lesser general public license version 3": "lgpl3", "gnu lesser general public license v2 1": "lgpl21", "gnu lesser general public license v3 0": "lgpl3", "lgpl 2 1": "lgpl21", "lgpl 3 0": "lgpl3",
    "gnu affero general public license version 3": "agpl3", "gnu affero general public license v3 0": "agpl3", "agpl 3 0": "agpl3", "unlicense": "unlicense", "cc by 4 0": "ccby4", "cc by sa 4 0": "ccbysa4", "cc by nc 4 0": "ccbync4",
    "apache license v2 0": "apache2", "apache license": "apache2", "simplified bsd license": "bsd2", "new bsd license": "bsd3", "modified bsd license": "bsd3", "eclipse public license 2 0": "epl2", "epl 2 0": "epl2", "boost software license 1 0": "bsl1", "bsl 1 0": "bsl1", "zlib license": "zlib", "zlib": "zlib",
    "cc0 1 0": "cc0", "cc0": "cc0", "wtfpl": "wtfpl", "creative commons attribution 4 0": "ccby4", "creative commons attribution sharealike 4 0": "ccbysa4", "creative commons attribution noncommercial 4 0": "ccbync4", "gnu gpl version 2": "gpl2", "gnu gpl version 3": "gpl3", "gpl v2": "gpl2", "gpl v3": "gpl3", "agplv3": "agpl3", "lgplv3": "lgpl3",
}
#: What may stand before a name, and after an SPDX one.
BEFORE = r"^(?:(?:this|the) (?:work|project|software|program|library|code|file|package) is )?(?:(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?|spdx license identifier )"
AFTER = r" (?:only|or later)$"
#: Ordered rules, longest first; a matched sequence is used up.
RULES = [
    ("apache2-head|apache2-use|apache2-copy", "Apache-2.0"), ("bsd-source|bsd-binary|bsd-third", "BSD-3-Clause"), ("bsd-source|bsd-binary", "BSD-2-Clause"), ("mit-grant|mit-notice", "MIT"), *[(f"{k}-terms|version{i}", f"{n}-{v}") for k, n in (("lgpl", "LGPL"), ("agpl", "AGPL"), ("gpl", "GPL")) for i, v in (("2", "2.0"), ("21", "2.1"), ("3", "3.0"))], ("apache2-ref", "Apache-2.0"),
    ("apache2-use", "Apache-2.0"), ("gpl3-ref", "GPL-3.0"), ("gpl2-ref", "GPL-2.0"), ("lgpl3-ref", "LGPL-3.0"), ("lgpl21-ref", "LGPL-2.1"), ("lgpl2-ref", "LGPL-2.0"), ("agpl3-ref", "AGPL-3.0"), ("mpl2-ref", "MPL-2.0"),
    ("bsd3-ref", "BSD-3-Clause"), ("bsd2-ref", "BSD-2-Clause"), ("isc-grant", "ISC"), ("isc-ref", "ISC"), ("mit-ref", "MIT"), ("mit-grant", "MIT"), ("mit-notice", "MIT"), ("ccbync4-ref", "CC-BY-NC-4.0"), ("ccby4-ref", "CC-BY-4.0"),
    ("ccbysa4-ref", "CC-BY-SA-4.0"), ("unlicense-ref", "Unlicense"), ("unlicense", "Unlicense"), ("zlib-warranty|zlib-grant", "Zlib"), ("zlib-grant", "Zlib"), ("zlib-ref", "Zlib"), ("epl2-ref", "EPL-2.0"), ("bsl1-ref", "BSL-1.0"), ("cc0-ref", "CC0-1.0"), ("wtfpl", "WTFPL"), ("wtfpl-ref", "WTFPL"), ("reserved", "All-rights-reserved"),
]
#: Words of the longest sentence; references by name are shorter.
LONGEST = max(len(s.split(" ")) for s in SENTENCES)


def scan(docs, id_col="doc_id", text_col="text"):
    """doc_id, sentence_ids and licences ('|'-joined, in order of the rules; empty if none) of every row. Null or empty text has none.

    A blank line, and a full stop or the like before white space, end a sentence; a sentence wrapped over lines counts where it starts, and a line may be a sentence
    of its own too, unless it lies within a wrapped one that is known; one may start at any line of a paragraph. List marks ("1.", "(a)", "*") and comment marks before a line are no part of it. No shuffle.
    """
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    named = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, f"{v}-ref")])
    marks = r"(?m)^[ \t]*(?:(?://|#|;|--|/?\*+/?|-)+[ \t]*)*(?:\(?(?:[0-9]{1,2}|[a-zA-Z])[.)][ \t]+)?"
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), marks, "")
    text = F.regexp_replace(text, r"(?i)\b(spdx-license-identifier:|v\.)[ \t]+(?=[\w(])", "$1")
    parts = F.split(F.regexp_replace(text, r"([.!?;:])[ \t]+|([.!?;:])\n|\n[ \t]*\n+", "$1$2\u0001"), "\u0001")
    clean = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    name = lambda c: F.when(c.rlike(BEFORE), F.element_at(named, F.regexp_replace(F.regexp_replace(c, BEFORE, ""), AFTER, "")))
    id_of = lambda c: F.coalesce(F.element_at(known, c), name(c))
    begin = F.struct(F.lit("").alias("tail"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("ids"))

    def line(acc, c):
        """From the last line up: what stands from this line to the end, as long as it has no more words than a sentence may have, else the line alone."""
        tail = F.when(acc["over"], F.lit("")).otherwise(F.trim(F.concat(c, F.lit(" "), acc["tail"])))
        over = acc["over"] | (F.size(F.split(tail, " ")) > LONGEST)
        found = F.coalesce(F.when(~over, id_of(tail)), id_of(c))
        return F.struct(tail.alias("tail"), over.alias("over"), F.when(found.isNull(), acc["ids"]).otherwise(F.concat(F.array(found), acc["ids"])).alias("ids"))

    rest = lambda s: F.aggregate(F.reverse(F.transform(F.split(s, "\n"), clean)), begin, line)["ids"]
    found_in = lambda s: F.when(id_of(clean(s)).isNotNull(), F.array(id_of(clean(s)))).otherwise(rest(s))
    ids = F.concat_ws("|", F.filter(F.flatten(F.transform(parts, found_in)), lambda x: x.isNotNull()))
    ids = F.when(F.lower(text_col).rlike("licen|reserved|redistribut|copyright|public domain|permission|permitted|warranty|(?:released|distributed|available)\\s+under"), ids).otherwise("")
    rules = F.array(*[F.struct(F.lit(f"|{a}|").alias("seq"), F.lit(b).alias("name")) for a, b in RULES])
    start = F.struct(F.concat(F.lit("|"), F.replace("sentence_ids", F.lit("|"), F.lit("||")), F.lit("|")).alias("left"), F.lit("").alias("out"))

    def step(acc, rule):
        seq = F.concat(F.lit("|"), F.replace(F.substring(rule["seq"], F.lit(2), F.length(rule["seq"]) - 2), F.lit("|"), F.lit("||")), F.lit("|"))
        hit = F.contains(acc["left"], seq)
        return F.struct(F.when(hit, F.replace(acc["left"], seq, F.lit("#"))).otherwise(acc["left"]).alias("left"), F.when(hit, F.concat_ws("|", F.nullif(acc["out"], F.lit("")), rule["name"])).otherwise(acc["out"]).alias("out"))

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(ids, F.lit("")).alias("sentence_ids"))
    return found.withColumn("licences", F.when(F.col("sentence_ids") == "", "").otherwise(F.aggregate(rules, start, step)["out"]))
