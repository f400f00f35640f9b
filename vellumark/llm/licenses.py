"""Licence statements by Dice coefficient over word bigrams.

Texts and templates are normalised alike (lower case, runs of letters and digits). A window of a text as long as a template is
compared with it: twice the shared bigrams over the bigrams of both, repeats counted. Size bounds prune first: a template of n bigrams
can only reach the threshold t in a text that has at least n*t/(2-t) bigrams among the template's, and in a window that has so many. A best window begins with
one of the template's bigrams, so only those are tried. Of overlapping finds the one that shares most bigrams stays (ties: the higher coefficient, the name,
the earlier). A reserved right is reported only where no licence is found.

A row for each find; texts without one give no row. Null and empty texts have none; texts are read whole. Repeated rows each give theirs;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellumark.llm.scratch import id_and_text
from vellumark.llm.tokens import texts

# Public licences' identifiers and names. Short statements are made of them by rule.
NAMES = {
    "Apache-2.0": "Apache License, Version 2.0", "MIT": "MIT License", "GPL-3.0": "GNU General Public License, version 3", "GPL-2.0": "GNU General Public License, version 2",
    "LGPL-3.0": "GNU Lesser General Public License, version 3", "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "AGPL-3.0": "GNU Affero General Public License, version 3",
    "BSD-3-Clause": "BSD 3-Clause License", "BSD-2-Clause": "BSD 2-Clause License", "ISC": "ISC License", "MPL-2.0": "Mozilla Public License, version 2.0", "EPL-2.0": "Eclipse Public License, version 2.0",
    "EUPL-1.2": "European Union Public Licence, version 1.2", "CDDL-1.0": "Common Development and Distribution License, version 1.0", "BSL-1.0": "Boost Software License, Version 1.0", "Zlib": "zlib License",
    "Artistic-2.0": "Artistic License 2.0", "OFL-1.1": "SIL Open Font License, Version 1.1", "CC-BY-4.0": "Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC0-1.0": "CC0 1.0 Universal", "Unlicense": "Unlicense", "0BSD": "Zero-Clause BSD License",
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
# Notices and bodies.
BODIES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL-3.0": ["This program " + _GNU.format(":", "General Public License", ",", "3")],
    "GPL-2.0": ["This program " + _GNU.format(";", "General Public License", ";", "2")],
    "LGPL-3.0": ["This library " + _GNU.format(":", "Lesser General Public License", ",", "3")],
    "LGPL-2.1": ["This library " + _GNU.format(";", "Lesser General Public License", ";", "2.1")],
    "AGPL-3.0": ["This program " + _GNU.format(":", "Affero General Public License", ",", "3")],
    "BSD-3-Clause": [_BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": [_BSD],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."], "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."], "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."], "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."], "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Proprietary": ["All rights reserved."],
}
RESERVED = "Proprietary"
TEMPLATES = {
    k: ([f"{lead} under the {NAMES[k]}." for lead in ("Licensed", "Released", "This work is licensed")] + [f"SPDX-License-Identifier: {k}"] if k in NAMES else []) + BODIES.get(k, []) for k in [*NAMES, RESERVED]
}

_WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, license string, dice double, start_word int, n_words int, matched string"


def normal(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values())
    return 2 * both / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: float) -> None:
        self.least = least
        self.templates = [(name, words, bigrams(words)) for name, forms in templates.items() for words in map(normal, forms)]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, words, _ in self.templates for w in words}))}
        self.size = len(self.ids)
        self.need = np.array([int(np.ceil((len(words) - 1) * least / (2 - least) - 1e-9)) for _, words, _ in self.templates])
        # Every bigram of the templates, ordered, and the templates that have it.
        pairs = sorted((self.ids[a] * self.size + self.ids[b], k) for k, (_, _, grams) in enumerate(self.templates) for a, b in grams)
        self.key, first = np.unique(np.array([p for p, _ in pairs], "i8"), return_index=True)
        self.first, self.of = np.append(first, len(pairs)), np.array([k for _, k in pairs], "i8")

    def scan(self, text: str | None) -> list[tuple]:
        """(license, dice, start_word, n_words, matched) of each find, in text order."""
        words = normal(text or "")
        ids = np.fromiter((self.ids.get(w, -1) for w in words), "i8", len(words))
        pairs = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.size + ids[1:], -1)
        at = np.flatnonzero(pairs >= 0)
        gram = np.minimum(np.searchsorted(self.key, pairs[at]), len(self.key) - 1)
        known = self.key[gram] == pairs[at]
        at, gram = at[known], gram[known]
        if not len(at):
            return []
        n = self.first[gram + 1] - self.first[gram]
        own = np.repeat(np.arange(len(at)), n)
        of = self.of[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + self.first[gram][own]]
        found = []
        for t in np.flatnonzero(np.bincount(of, minlength=len(self.templates)) >= self.need):
            name, template, grams = self.templates[t]
            size, mine = len(template) - 1, at[own[of == t]]
            # Windows of as many bigrams as the template that have enough of them.
            for k in np.flatnonzero(np.searchsorted(mine, mine + size) - np.arange(len(mine)) >= self.need[t]):
                start = int(mine[k])
                window = bigrams(words[start : start + size + 1])
                d = dice(grams, window)
                if d >= self.least:
                    found.append((-sum((grams & window).values()), -d, name, start, min(size + 1, len(words) - start)))
        kept: list[tuple] = []
        for _, minus, name, start, n in sorted(found):
            if all(start + n <= s or s + m <= start for _, _, s, m, _ in kept):
                kept.append((name, -minus, start, n, " ".join(words[start : start + n])))
        if any(f[0] != RESERVED for f in kept):
            kept = [f for f in kept if f[0] != RESERVED]
        return sorted(kept, key=lambda f: f[2])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows = [(doc_ids[k + j], *f) for k, some in texts(batch) for j, t in enumerate(some) for f in scanner.scan(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "license", "dice", "start_word", "n_words", "matched"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, FOUND)
