import random

from chainlake.llm import licences as x


def test_families_unknown_and_odd_rows(spark):
    r = random.Random(1)
    line = lambda: " ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(12)) + "."
    rows, want = [], {}
    for i in range(300):
        family = r.choice([*x.FAMILIES, None, None, "other"])
        notice = {None: "", "other": r.choice(["The licence of this kind is unclear.", "Licensed under the Foo Bar Agreement.", "Copyright is held by someone."])}.get(family) if family in (None, "other") else x.TEMPLATES[family][0] + "."
        if i % 5 == 0:
            notice = " ".join(w + "###" for w in notice.upper().split())
        rows.append((i, "\n".join([line(), notice, line()]), "x"))
        want[i] = family if family in x.TEMPLATES else None
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n\n", "x"), (1003, "word " * 60_000 + "\n" + x.TEMPLATES["MIT"][0], "x"), (1004, x.TEMPLATES["MIT"][0] + "\n" + x.TEMPLATES["GPL-3.0"][0], "x"), (1004, "same id", "x"), (None, x.TEMPLATES["CC-BY"][0], "x")]
    got = x.licence_scan(spark.createDataFrame(rows, "doc_id long, text string, family string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    assert sum(by[i].family == f for i, f in want.items()) >= 0.99 * len(want)
    assert by[1000].n_paragraphs == by[1001].n_paragraphs == by[1002].n_paragraphs == 0 and by[1000].families == [] and by[1000].chance == 0
    assert by[1003].family == "MIT" and by[1004].families == ["GPL-3.0", "MIT"] and by[None].family == "CC-BY"


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = x.licence_scan(docs)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_wrapped_notices_of_every_family(spark):
    import textwrap

    long = {f: max(ts, key=len) for f, ts in x.TEMPLATES.items()}
    other = "The quick report on rivers and lakes of the county was printed in spring."
    rows, want = [], {}
    for width in (24, 40, 72):
        for mark in ("", " * ", "# "):
            for f, notice in long.items():
                lines = textwrap.wrap(f"{notice}.", width)
                want[len(rows)] = f
                rows.append((len(rows), "\n".join(mark + y for y in [other, *lines, other])))
    two = "\n".join([other, *textwrap.wrap(long["MIT"], 40), *textwrap.wrap(long["BSD"], 40)])
    rows += [(9000, "You may not use this file except in compliance with the Apache\nLicense."), (9001, two), (9002, other)]
    rows += [(9003, "modify\nit under the terms of the GNU General Public License as published by\nsomeone"), (9004, "Licensed under the Eclipse Public License, Version 2.0"), (9005, "Licensed under the Educational Community License, Version 2.0")]
    got = {g.doc_id: g for g in x.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, want[i], tuple(got[i].families)) for i in want if got[i].families != [want[i]]} == set()
    assert got[9000].families == ["Apache-2.0"] and got[9001].families == ["BSD", "MIT"] and got[9002].n_cues == 0
    assert "AGPL-3.0" not in got[9003].families and got[9004].families == got[9005].families == []


def test_every_gram_set_that_confirms_holds_an_anchor():
    import re

    chosen = set(x.anchors())
    for t in (t for group in x.TEMPLATES.values() for t in group):
        words = re.findall(r"[^\W_]+(?:[.]\d+)*", t.lower())
        grams = {(w,) for w in words} | set(zip(words, words[1:]))
        assert sum(not chosen & set(g) for g in grams) < x.CONFIRM * len(grams)


def test_standard_notices_and_held_out_wording(spark):
    gnu = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {0}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    texts = {
        "GPL-3.0": [gnu.format(""), "Code here is licensed under the GNU General Public License, version 3 only, as said."],
        "LGPL": [gnu.format("Lesser "), "All of it is licensed under the GNU Lesser General Public License by the authors"],
        "AGPL-3.0": [gnu.format("Affero "), "Licensed as a whole under the GNU Affero General Public License, version 3 or later"],
        "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction", "It was released by us under the MIT License"],
        "Apache-2.0": ["# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License.", "Everything is licensed under the Apache License, Version 2.0, January 2004"],
        "BSD": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"],
        "ISC": ["Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"],
        "Unlicense": ["This is free and unencumbered software released into the public domain."],
    }
    rows = [(f, t) for f, ts in texts.items() for t in ts]
    unknown = ["See the licence of the vendor before use.", "Licensed under the rules of the club, all members agree.", "Copyright terms are explained elsewhere in this book.", "She held a driving licence and a public permit."]
    docs = [(i, f"Some words of the story came first.\n\n{t}\n\nThen others followed it.") for i, t in enumerate([t for _, t in rows] + unknown)]
    got = {g.doc_id: g for g in x.licence_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(f, tuple(got[i].families)) for i, (f, _) in enumerate(rows) if got[i].families != [f] and f not in ("GPL-3.0",)] == []
    assert all(got[i].families == ["GPL-3.0"] for i in range(2)), [got[i].families for i in range(2)]
    assert all(got[len(rows) + k].families == [] and got[len(rows) + k].n_unknown >= 1 for k in range(len(unknown)))


def test_versions_variants_tags_denials_and_one_word_a_line(spark):
    gnu = "redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    wanted = {
        gnu: ["GPL-2.0"], "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"], gnu.replace("version 2", "version 3"): ["GPL-3.0"],
        "This is not released under the MIT License.": [], "The code was never\nreleased under the MIT License.": [], "It isn't licensed under the Apache License, Version 2.0": [], "Released under the MIT License, not public domain": ["MIT"],
        "// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"], "SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0"], "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0"], "SPDX-License-Identifier: LGPL-2.1-only": ["LGPL"],
        "SPDX-License-Identifier: BSD-3-Clause": ["BSD"], "SPDX-License-Identifier: Foo-1.0": [], "\n".join("Released under the MIT License".split()): ["MIT"], "\n\n".join(x.TEMPLATES["MIT"][2].split()): ["MIT"],
        "Licensed under CC BY-NC-ND 4.0": ["CC-BY-NC-ND"], "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA"], "Licensed under CC BY-ND 4.0": ["CC-BY-ND"], "Distributed under the Boost Software License, Version 1.0": ["BSL-1.0"], "Licensed under the zlib License": ["Zlib"],
        "x" * 3_000 + " " + x.TEMPLATES["Apache-2.0"][2]: ["Apache-2.0"],
    }
    docs = spark.createDataFrame([(i, f"Some words came first.\n\n{t}\n\nOthers followed it.") for i, t in enumerate(wanted)], "doc_id long, text string")
    got = {g.doc_id: g.families for g in x.licence_scan(docs).collect()}
    assert {t[:60]: got[i] for i, (t, f) in enumerate(wanted.items()) if got[i] != f} == {}
