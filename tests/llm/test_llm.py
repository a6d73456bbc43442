import base64
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from postloom.llm import bpe, licences

TEXTS = [(1, None), (2, ""), (3, "A b c d e f g"), (4, "a B c d e f g"), (5, "one two"), (6, " Released under the MIT License. x"), (7, "word " * 3000), (None, "a b c d e f g"), (3, "A b c d e f g")]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")


def test_bpe_equals_the_library_and_round_trips(spark):
    path, r = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(1)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = TEXTS + [(100 + i, "".join(r.choice("ab é\n\t 1'sß漢\x1c\x85.  ") for _ in range(r.randrange(60)))) for i in range(200)] + [(999, "ab" * 5000)]
    for x in bpe.decode(bpe.encode(frame(spark, rows), path, P.PATTERN), path).collect():
        assert x.ids == own.encode_ordinary(x.decoded.decode())
    assert sorted(bytes(x.decoded) for x in bpe.decode(bpe.encode(frame(spark, rows), path, P.PATTERN), path).collect()) == sorted((t or "").encode() for _, t in rows)


def test_licences_wrapped_over_lines(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    bsd = "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    third = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"
    lgpl = gpl.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
    agpl = gpl.replace("software;", "software:").replace("GNU General", "GNU Affero General").replace("Foundation; either version 2", "Foundation, either version 3")
    cases = [(mit, "MIT"), (bsd, "BSD-2-Clause"), (bsd + third, "BSD-3-Clause"), (gpl, "GPL-2.0"), (lgpl, "LGPL-2.1"), (agpl, "AGPL-3.0"), (isc, "ISC"), (mpl, "MPL-2.0"), ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0")]
    cases += [("x\nThis project is licensed under the MIT License\ny", "MIT"), ("a line\nThis project is licensed under the\nMIT License.", "MIT"), ("the MIT license is short", ""), (None, ""), ("All rights reserved.\r\nx", "All-rights-reserved")]
    got = {r.doc_id: r.licences for r in licences.scan(frame(spark, [(i, c) for i, (c, _) in enumerate(cases)])).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


