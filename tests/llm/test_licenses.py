import random

from vellumark.llm import licenses


def brute(text, least=0.8, templates=licenses.TEMPLATES):
    """The names found by comparing every window of every template's length."""
    words, found = licenses.normal(text or ""), set()
    whole = licenses.bigrams(words)
    for name, forms in templates.items():
        for form in forms:
            t = licenses.normal(form)
            # A text without most of the template's bigrams has no window with them either.
            if sum((whole & licenses.bigrams(t)).values()) < 0.5 * (len(t) - 1):
                continue
            for k in range(max(1, len(words) - len(t) + 1)):
                if licenses.dice(licenses.bigrams(t), licenses.bigrams(words[k : k + len(t)])) >= least:
                    found.add(name)
    return found


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    for r in licenses.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for d in docs.collect():
        want = brute(d.text)
        assert bool(want) == bool(got.get(d.doc_id)) and got.get(d.doc_id, set()) <= want


def test_changed_templates():
    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, forms in licenses.TEMPLATES.items():
        words = licenses.normal(max(forms, key=len))
        if len(words) > 30:
            words[rng.randrange(5, len(words) - 5)] = "zzz"
        text = "Some lines.\n" + " ".join(words).upper() + "\nand more of them"
        assert name in {f[0] for f in scanner.scan(text)}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "license", "x"), (None, "Released under the MIT License.", "x"), (4, "Released under the MIT License.", "x"), (4, "Released under the MIT License.", "x"), (5, "w " * 200_000 + "All rights reserved.", "x"), (6, "rights and all reserved the license", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.license, r.start_word) for r in got) == [(0, "MIT", 0), (4, "MIT", 0), (4, "MIT", 0), (5, "Proprietary", 200_000)]
    assert licenses.scan_licenses(docs.where("false")).collect() == []


def plain(text, least=0.8):
    """All finds over every window of every template, then those that share most bigrams where they overlap."""
    words, found = licenses.normal(text), []
    for name, forms in licenses.TEMPLATES.items():
        for t in map(licenses.normal, forms):
            grams = licenses.bigrams(t)
            for k in range(len(words) - 1):
                window = licenses.bigrams(words[k : k + len(t)])
                d = licenses.dice(grams, window)
                # A window counts if it begins with one of the template's bigrams.
                if d >= least and tuple(words[k : k + 2]) in grams:
                    found.append((-sum((grams & window).values()), -d, name, k, min(len(t), len(words) - k)))
    kept = []
    for _, _, name, k, n in sorted(found):
        if all(k + n <= s or s + m <= k for _, s, m in kept):
            kept.append((name, k, n))
    return sorted(x for x in kept if x[0] != "Proprietary" or all(y[0] == "Proprietary" for y in kept))


def test_scanner_is_the_plain_one_both_ways():
    """Templates whole, edited, cut short and side by side: the same licences in the same places, none more and none less."""
    rng, scanner, names = random.Random(6), licenses.Scanner(licenses.TEMPLATES, 0.8), list(licenses.TEMPLATES)
    for _ in range(60):
        parts = []
        for name in rng.sample(names, rng.randint(1, 3)):
            words = rng.choice(licenses.TEMPLATES[name]).split()
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                words[rng.randrange(len(words))] = rng.choice(["the", "zzz", "license"])
            parts += [*(rng.choice("of the and some words in between".split()) for _ in range(rng.randint(0, 9))), *words[: rng.choice([len(words), len(words), len(words) * 3 // 4])]]
        text = " ".join(parts)
        got = sorted((f[0], f[2], f[3]) for f in scanner.scan(text))
        want = plain(text)
        assert got == want


def test_real_notices():
    scan = lambda text: [f[0] for f in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)]
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    affero = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd2 = licenses.BODIES["BSD-2-Clause"][0] + ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
    assert scan(lesser) == ["LGPL-2.1"] and scan(affero) == ["AGPL-3.0"] and scan(bsd2) == ["BSD-2-Clause"] and scan(licenses.BODIES["BSD-3-Clause"][0]) == ["BSD-3-Clause"]
    assert scan("Copyright 2020 Firm. All rights reserved. " + licenses.BODIES["MIT"][0]) == ["MIT"] and scan("All rights reserved.") == ["Proprietary"]
    assert scan("// SPDX-License-Identifier: CC-BY-4.0") == ["CC-BY-4.0"] and scan("SPDX-License-Identifier: GPL-2.0-only") == ["GPL-2.0"] and scan("Licensed under the Foo License.") == []
