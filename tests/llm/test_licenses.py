"""Operator 4 against a plain TF-IDF and a walk up the tree."""

import math
import re
from collections import Counter

from glosa.llm import licenses

MIT = licenses.TEMPLATES[4][1]


def brute(files):
    units = {}
    for i, path, text in files:
        t = text or ""
        name = (path or "").rsplit("/", 1)[-1]
        lic = bool(re.match(licenses.LICENCE_FILE, name))
        units[i] = (lic, {x for x in t.split("\n") if re.search(licenses.MARK, x)} | ({t} if lic else set()))
    words = lambda t: Counter(re.findall(licenses.WORDS, t.lower()))
    all_units = {u for _, us in units.values() for u in us}
    docs = [words(u) for u in all_units] + [words(t) for _, t in licenses.TEMPLATES]
    df = Counter(w for d in docs for w in d)
    vec = lambda t: {w: n * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, n in words(t).items()}

    def best(us):
        found = []
        for u in us:
            a = vec(u)
            for name, t in licenses.TEMPLATES:
                b = vec(t)
                dot = sum(a.get(w, 0) * x for w, x in b.items())
                if dot:
                    c = round(dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 4)
                    if c >= licenses.LEAST:
                        found.append((-c, name))
        return min(found) if found else None

    own = {i: best(us) for i, (_, us) in units.items()}
    speaks = {}
    for i, path, _ in files:
        if path is not None and units[i][0] and own[i]:
            d = path.rsplit("/", 1)[0] if "/" in path else ""
            speaks[d] = min(speaks.get(d, own[i]), own[i])
    out = {}
    for i, path, _ in files:
        if own[i]:
            out[i] = (own[i][1], -own[i][0], "file" if units[i][0] else "header", None)
            continue
        d = None if path is None else (path.rsplit("/", 1)[0] if "/" in path else "")
        while d is not None and d not in speaks:
            d = None if d == "" else (d.rsplit("/", 1)[0] if "/" in d else "")
        out[i] = (None, None, None, None) if d is None else (speaks[d][1], -speaks[d][0], "inherited", d)
    return out


def test_scan(spark):
    files = [
        ("a/LICENSE", MIT + " and so on"), ("a/b/c/x.py", "nothing"), ("a/b/LICENSE.md", "no words of that kind"), ("a/b/c/d/y.py", None),
        ("ab/z.py", "prose"), ("COPYING", "GNU General Public License\nVersion 3, 29 June 2007"), ("top.txt", ""), (None, "x"), (None, "Released under the MIT License."),
        ("q/h.py", "code\nLicensed under the Apache License, Version 2.0.\nmore"), ("q/k.py", "Copyright nobody"), ("q/r/NOTICE", "Licensed under CC BY-NC 4.0."),
        ("q/r/LICENSE", "Released under the MIT License."), ("q/r/s/t.py", "w " * 50_000), ("q/r/s/u.py", "licensed dogs only\n" * 3), ("/abs/f", "t"),
        ("q/licenses.py", "x"), ("a/b/c/x.py", "nothing"), ("q/v.py", "RELEASED UNDER THE MIT LICENCE"),
    ]
    files = [(i, p, t) for i, (p, t) in enumerate(files)]
    df = spark.createDataFrame([(*f, "clash") for f in files], "doc_id long, path string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["cosine"], r["origin"], r["from_dir"]) for r in licenses.license_scan(df).collect()}
    want = brute(files)
    assert got == want
    assert got[1][:1] + got[1][2:] == ("MIT", "inherited", "a") and got[4][3] == "" and got[9][0] == "Apache-2.0"


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []


def test_spdx_headers_and_notices_inside_long_lines(spark):
    prose = " ".join(f"word{i}" for i in range(400))
    files = [
        ("a/LICENSE", "Released under the MIT License.", "MIT"), ("a/x.c", "// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
        ("a/y.c", "/* spdx-license-identifier: mit */", "MIT"), ("a/z.c", "# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0"),
        ("a/w.c", "SPDX-License-Identifier: (MIT OR Zlib) AND BSD-3-Clause", "BSD-3-Clause"), ("b/n.c", "SPDX-License-Identifier: NOASSERTION", None),
        ("b/p.c", f"{prose}. Released under the MIT License. See the project page for more: {prose}", "MIT"),
        ("b/q.c", f"{prose} licensed under the Apache License, Version 2.0, {prose}", "Apache-2.0"),
        ("b/r.c", "Released under the MIT License. See the project page of these tools for the names, years and places of all authors who took part.", "MIT"),
        ("b/s.c", f"{prose} public license of no kind {prose}", None), ("b/t.c", prose, None), ("a/u.c", prose, "MIT"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert {i: r["license"] for i, r in got.items()} == {i: want for i, (_, _, want) in enumerate(files)}
    assert all(got[i]["origin"] == "header" and got[i]["cosine"] == 1.0 for i in (1, 2, 3, 4, 6, 7, 8))
