"""License scans by sentence rules, in DataFrame operations only.

A text is cut into sentences at blank lines and after .;:!? before white space; a line
end alone may end a sentence or be a soft wrap inside one. Comment leaders (anything but
a-z and 0-9 at the start of a line, which leaves a line of nothing else blank) are left
out. Sentences are normalised (lower case, runs of anything but a-z and 0-9 become one
space), and the known licence sentences are found that begin and end at a cut or a line
end, the longest one where several begin. The identifiers found, in order, are matched
against the ordered rules: a rule names a licence and the identifiers that must follow
one another, with no other known sentence between them. Rules are tried in their order
and a sentence counts for the first rule that takes it, so long grants come before the
single lines that they begin with.

Only texts that hold an anchor are normalised; each known sentence holds one (checked
when the tables are made), so nothing is left out.

Defined results: a null or empty text has no sentences found (counts 0, empty strings,
licence null); null or repeated doc_ids pass through, one row out per row in; an empty
table gives an empty result; other columns of the input are ignored. `licences` holds
each licence once, in the rules' order, `licence` its first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, by identifier; each as it stands between cuts,
#: in all its known forms.
SENTENCES = {
    "a1": ["Licensed under the Apache License, Version 2.0"],
    "a2": [
        'Licensed under the Apache License, Version 2.0 (the "License")',
        'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")',
        'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"), you may not use this file except in compliance with the License',
    ],
    "a3": ["you may not use this file except in compliance with the License"],
    "a4": [
        "You may obtain a copy of the License at",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ],
    "a5": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "a6": ["See the License for the specific language governing permissions and limitations under the License"],
    "a7": ["Apache License Version 2.0, January 2004", "Apache License, Version 2.0, January 2004"],
    "m1": ["Released under the MIT License", "Distributed under the MIT License", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT".replace(": ", " ")],
    "m2": ["Licensed under the MIT License"],
    "m3": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ],
    "m4": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    ],
    "m5": ["This project is licensed under the MIT License"],
    "m6": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    ],
    "m7": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    ],
    "n1": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ],
    "i1": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "i2": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "q1": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    ],
    "b1": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "b2": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer",
    ],
    "b3": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "b4": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "b5": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "b6": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    ],
    "g1": ["This work is licensed under the GNU General Public License, version 3"],
    "g2": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "g3": ["either version 2 of the License, or (at your option) any later version", "either version 2, or (at your option) any later version"],
    "g4": ["You should have received a copy of the GNU General Public License along with this program"],
    "g5": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "g6": ["either version 3 of the License, or (at your option) any later version", "either version 3, or (at your option) any later version"],
    "g7": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms and conditions of the GNU General Public License, version 2, as published by the Free Software Foundation",
    ],
    "g8": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "g9": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ga": ["See the GNU General Public License for more details"],
    "l1": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    ],
    "l2": ["either version 2.1 of the License, or (at your option) any later version"],
    "l3": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "l4": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "l5": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "l6": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    ],
    "v1": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "v2": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "v3": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "c1": ["Licensed under CC BY-NC 4.0"],
    "c2": ["Licensed under CC BY 4.0"],
    "c3": ["Licensed under CC BY-SA 4.0"],
    "c4": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "c5": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "c6": [
        "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    ],
    "c7": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "p1": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "p2": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "p3": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")'],
    "p4": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "e1": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
        "Eclipse Public License - v 1.0",
    ],
    "e2": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
        "Eclipse Public License - v 2.0",
    ],
    "d1": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")'],
    "o1": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "o2": ["Distributed under the Boost Software License, Version 1.0"],
    "z1": ["This software is provided 'as-is', without any express or implied warranty"],
    "z2": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "u1": ["This is free and unencumbered software released into the public domain"],
    "u2": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "w1": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "t1": ["The Artistic License 2.0", "Artistic License 2.0"],
    "r1": ["All rights reserved"],
}

#: The ordered rules, licence and identifiers.
RULES = [
    ("Apache-2.0", ["a2", "a3", "a4", "a5", "a6"]),
    ("Apache-2.0", ["a2"]),
    ("Apache-2.0", ["a1"]),
    ("Apache-2.0", ["a7"]),
    ("BSD-4-Clause", ["b1", "b2", "b5", "b4", "b3"]),
    ("BSD-4-Clause", ["b1", "b2", "b5", "b4"]),
    ("BSD-3-Clause", ["b1", "b2", "b5", "b3"]),
    ("BSD-3-Clause", ["b1", "b2", "b3"]),
    ("BSD-2-Clause", ["b1", "b2", "b5"]),
    ("BSD-2-Clause", ["b1", "b2"]),
    ("NCSA", ["n1"]),
    ("MIT", ["m3", "m4", "m6"]),
    ("MIT", ["m3", "m4"]),
    ("MIT", ["m3"]),
    ("MIT", ["m1"]),
    ("MIT", ["m2"]),
    ("MIT", ["m5"]),
    ("MIT-0", ["m7"]),
    ("ISC", ["i1"]),
    ("0BSD", ["i2"]),
    ("PostgreSQL", ["q1"]),
    ("AGPL-3.0-or-later", ["v1"]),
    ("AGPL-3.0-or-later", ["v2", "g6"]),
    ("AGPL-3.0", ["v3"]),
    ("LGPL-3.0-or-later", ["l3"]),
    ("LGPL-3.0-or-later", ["l1", "g6"]),
    ("LGPL-2.1-or-later", ["l6"]),
    ("LGPL-2.1-or-later", ["l1", "l2"]),
    ("LGPL-2.0-or-later", ["l1", "g3"]),
    ("LGPL-2.1", ["l4"]),
    ("LGPL-3.0", ["l5"]),
    ("LGPL", ["l1"]),
    ("GPL-3.0-or-later", ["g2", "g4"]),
    ("GPL-3.0-or-later", ["g2"]),
    ("GPL-3.0-or-later", ["g5", "g6"]),
    ("GPL-3.0", ["g1"]),
    ("GPL-3.0", ["g9"]),
    ("GPL-2.0-or-later", ["g5", "g3"]),
    ("GPL-2.0-or-later", ["g3", "g4"]),
    ("GPL-2.0-only", ["g7"]),
    ("GPL-2.0", ["g8"]),
    ("CC-BY-NC-4.0", ["c1"]),
    ("CC-BY-NC-4.0", ["c5"]),
    ("CC-BY-SA-4.0", ["c3"]),
    ("CC-BY-SA-4.0", ["c7"]),
    ("CC-BY-4.0", ["c2"]),
    ("CC-BY-4.0", ["c4"]),
    ("CC0-1.0", ["c6"]),
    ("MPL-2.0", ["p1"]),
    ("MPL-2.0", ["p2"]),
    ("MPL-1.1", ["p3"]),
    ("EPL-1.0", ["e1"]),
    ("EPL-2.0", ["e2"]),
    ("CDDL-1.0", ["d1"]),
    ("BSL-1.0", ["o1"]),
    ("BSL-1.0", ["o2"]),
    ("Zlib", ["z1", "z2"]),
    ("Zlib", ["z2"]),
    ("Unlicense", ["u1", "u2"]),
    ("Unlicense", ["u1"]),
    ("WTFPL", ["w1"]),
    ("Artistic-2.0", ["t1"]),
    ("proprietary", ["r1"]),
]

#: Each known sentence holds one of these, in lower case.
ANCHORS = ["licen", "permi", "copy", "redistrib", "warrant", "public domain", "rights reserved", "advertising", "any later version", "the mpl"]


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Normalised sentence to identifier, longest first. A sentence that holds a cut or no
    anchor, or is there twice, is an error."""
    table: dict[str, str] = {}
    for k, forms in SENTENCES.items():
        for form in forms:
            words = normalised(form)
            if re.search(r"[.;:!?]\s", form) or not any(a in form.lower() for a in ANCHORS) or table.get(words, k) != k:
                raise ValueError(f"sentence {k}: {form}")
            table[words] = k
    return dict(sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0])))


def marked(low: Column) -> Column:
    """A text in lower case as normalised words, with H where a sentence ends and S where
    a line ends; lower case has no such letters of its own."""
    t = F.regexp_replace(low, r"(?:\r\n|\r|\n)[^a-z0-9\r\n]*(?:(?:rem|dnl)[ \t]+|(?:[0-9]{1,2}|[a-z])[.)][ \t]+)?", "\n")
    t = F.regexp_replace(t, r"\n{2,}|[.;:!?](?=[ \t\n])", " H ")
    t = F.regexp_replace(F.replace(t, F.lit("\n"), F.lit(" S ")), "[^a-z0-9HS]+", " ")
    return F.concat(F.lit("H "), F.trim(t), F.lit(" H"))


def _wrapped(words: str) -> str:
    """A pattern for words between ends, with a line end between any two of them."""
    return words.replace(" ", " (?:S )?")


def _match(ids: Column) -> tuple[Column, list[Column]]:
    """ids: the sequence as ' a1 a2 '. What no rule takes; per rule its number of matches."""
    counts = []
    for _, seq in RULES:
        want = " " + " ".join(seq) + " "
        # each identifier is followed by its own space and preceded by another: doubled, matches can't overlap
        text = F.replace(ids, F.lit(" "), F.lit("  "))
        want2 = " " + "  ".join(seq) + " "
        counts.append(((F.length(text) - F.length(F.replace(text, F.lit(want2), F.lit("")))) / len(want2)).cast("int"))
        ids = F.regexp_replace(F.replace(text, F.lit(want2), F.lit(" | ")), " +", " ")
    return ids, counts


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentence_ids, licences, licence."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = F.lit(False)
    for a in ANCHORS:
        held = held | low.contains(a)
    table = known()
    ids = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    sentence = f"(?<=[HS] )(?:{'|'.join(map(_wrapped, table))})(?= [HS])"
    lines = F.regexp_extract_all(marked(low), F.lit(sentence), F.lit(0))
    found = F.transform(lines, lambda s: F.element_at(ids, F.replace(s, F.lit(" S "), F.lit(" "))))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(held, found).otherwise(F.array().cast("array<string>")).alias("found"))
    src = src.withColumn("sentence_ids", F.array_join("found", " "))
    some = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    _, counts = _match(some)
    names = F.filter(F.array(*(F.when((F.col("sentence_ids") != "") & (c > 0), F.lit(name)) for (name, _), c in zip(RULES, counts, strict=True))), lambda x: x.isNotNull())
    src = src.withColumn("names", F.array_distinct(names))
    return src.select("doc_id", F.size("found").cast("long").alias("n_sentences"), "sentence_ids", F.array_join("names", ",").alias("licences"), F.try_element_at("names", F.lit(1)).alias("licence"))
