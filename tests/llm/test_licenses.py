import pathlib

import duckdb
import pytest

from rosterforge.llm import licenses

SCHEMA = "doc_id long, text string, whole_text string, digest int"


def scanned(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_notices, r.license_ids, r.whole_text) for r in licenses.scan(docs).collect()}


def test_notices_spellings_and_whole_texts(spark):
    mit = "Copyright (c) 2020 Ann Author\r\n\r\n" + licenses.TEXTS["MIT"].upper().replace(". ", ".  ")
    rows = {
        1: "Some prose.\nReleased under the MIT License.\nmore", 2: "This work is licensed under the GNU General Public Licence, version 3!", 3: "Licensed under CC BY-NC 4.0.\nLicensed under Creative Commons Attribution-NonCommercial 4.0 International",
        4: mit, 5: "intro text\n\n" + licenses.TEXTS["ISC"] + "\n\nafter", 6: "SPDX-License-Identifier: Apache-2.0", 7: "He got into MIT, said the licence plate.", 8: None, 9: "", 10: "word " * 50_000,
    }
    assert scanned(spark, rows.items()) == {
        1: (1, "MIT", False), 2: (1, "GPL-3.0", True), 3: (2, "CC-BY-NC-4.0", False), 4: (1, "MIT", True), 5: (1, "ISC", False),
        6: (1, "Apache-2.0", True), 7: (0, "", False), 8: (0, "", False), 9: (0, "", False), 10: (0, "", False),
    }


def test_bare_names_are_no_notices(spark):
    rows = [(1, "MIT"), (2, "Mit."), (3, "This is the project of the MIT."), (4, "zlib\nISC\nExpat"), (5, "GPLv3"), (6, "under the MIT")]
    got = scanned(spark, rows)
    assert [got[i][0] for i in range(1, 7)] == [0, 0, 0, 0, 1, 0]


@pytest.mark.parametrize("shape", ["{t}", "head line\n\n{t}\n\ntail line", "Copyright (c) 1999, 2004 Zed Odd <z@x.org>\n{t}", "(c) 2011 by Zed. {t}", "a\n\nCopyright 2020 The Authors. All rights reserved.\n\n{t}\n\nb"])
def test_every_whole_text_is_found(spark, shape):
    """As published, in one block and rewrapped; alone, inside a document and after copyright notices."""
    forms = (lambda t: t, lambda t: t.replace("\n\n", "\n"), lambda t: t.replace(", ", ",\n").upper())
    rows = [(k, shape.format(t=form(t)), i) for k, (i, t, form) in enumerate((i, t, form) for i, t in licenses.TEXTS.items() for form in forms)]
    got = scanned(spark, [(k, t) for k, t, _ in rows if "\n" in t])
    missing = [(i, k % 3) for k, t, i in rows if "\n" in t and i not in got[k][1].split(",")]
    assert missing == []


def test_passing_over_loses_none(spark):
    """The scan finds what looking up every line and every run of blocks without passing over would find."""
    import re

    wraps = ("{}", "Released under the {} License.", "THIS WORK IS LICENSED UNDER {}!", "(the) {} licence, of the project", "(c) 2001 Someone Odd\n{}", "\u00a9 Zed Zebra 1999 all rights\n\n{} ...", "1. licence: {}", "available under the terms of the {} license")
    texts = [w.format(n) for names in licenses.NOTICES.values() for n in names for w in wraps]
    texts += [f"The {licenses.NOTICES[i][0]} License\n\n{t}" for i, t in licenses.TEXTS.items()]
    known = dict(licenses.known_texts())

    def brute(text):
        blocks = re.split(r"\n[ \t]*\n\s*", text)
        found = [(known[c], -1 - k) for k, x in enumerate(text.split("\n")) if (c := licenses.canonical_text(x)) in known]
        for a in range(len(blocks)):
            for b in range(a + 1, len(blocks) + 1):
                run = "\n\n".join(blocks[a:b])
                if "\n" in run and licenses.canonical_text(run) in known:
                    found.append((known[licenses.canonical_text(run)], b))
        return len(set(found)), ",".join(sorted({i for i, _ in found}))

    got = scanned(spark, enumerate(texts))
    want = {k: brute(t.strip(" \t\n")) for k, t in enumerate(texts)}
    assert {k: (texts[k], v, got[k]) for k, v in want.items() if got[k][:2] != v} == {}
    assert sum(n > 0 for n, _ in want.values()) > 0.6 * len(texts)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(None, "MIT License", "", 0), (None, "x", "", 0), (3, "MIT License", "", 0), (3, "ISC License\nGPLv2", "", 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_notices, r.license_ids) for r in licenses.scan(docs).collect())
    assert got == [(-1, 0, ""), (-1, 1, "MIT"), (3, 1, "MIT"), (3, 2, "GPL-2.0,ISC")]


def test_oracle_agrees_on_written_notices(spark):
    """The SQL, which goes another way, on sentences and whole texts."""
    texts = [f"so\n{s}" for n in licenses.NOTICES.values() for s in (f"Licensed under the {n[0]}.", f"This work is released under the terms of the {n[0]} License", f"SPDX-License-Identifier: {n[0]}"[:0] + f"{n[0]} licence")]
    texts += [t for t in licenses.TEXTS.values() if "\n\n" not in t and "\n" in t] + ["MIT", "the licence plate", "", None]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: tuple(r[1:]) for r in con.execute(licenses.oracle_sql()).fetchall()}
    assert scanned(spark, rows) == want


def test_digests_are_distinct_and_empty_table(spark):
    digests = licenses.known_digests()
    assert len({d for d, _ in digests}) == len(digests)
    assert licenses.canonical_text("Licensed under the Apache License, Version 2.0.") == licenses.canonical_text("released under Apache-license 2")
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_runs_of_any_number_of_blocks(spark):
    """A double-spaced license, one with a blank line after each line, and one under many copyright blocks."""
    bsd = licenses.TEXTS["BSD-3-Clause"]
    lines = [" ".join(words[i : i + 9]) for words in map(str.split, bsd.split("\n\n")) for i in range(0, len(words), 9)]
    notices = "\n\n".join(f"Copyright (c) 20{k} Somebody {k}" for k in range(10, 40))
    texts = ["\n\n".join(lines), "\n".join(lines), f"{notices}\n\n" + "\n".join(lines), "Some words ahead\n\n" + "\n \n".join(lines) + "\n\nand behind\nit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_notices, r.license_ids, r.whole_text) for r in licenses.scan(docs).collect()}
    assert got == {0: (1, "BSD-3-Clause", True), 1: (1, "BSD-3-Clause", True), 2: (1, "BSD-3-Clause", True), 3: (1, "BSD-3-Clause", False)}


@pytest.mark.parametrize("lead", ["", "// ", "# ", " * ", ";; "])
def test_whole_texts_between_lines_without_blank_ones(spark, lead):
    """A license in a comment at the head of a source file: code directly behind it, a line directly ahead."""
    rows = []
    for k, (ident, text) in enumerate(licenses.TEXTS.items()):
        lines = [" ".join(words[i : i + 11]) for words in map(str.split, text.split("\n\n")) for i in range(0, len(words), 11)]
        rows.append((k, "/* tool.c, the tool\n" + "\n".join(lead + x for x in ["Copyright (c) 2020 Ann Author", *lines]) + "\nint main() { return 0; }\nand prose", ident))
    got = scanned(spark, [(k, t) for k, t, _ in rows])
    assert [(i, got[k]) for k, _, i in rows if got[k] != (1, i, False)] == []


def test_sentences_in_a_line(spark):
    rows = [(1, "Some prose here. Released under the MIT License. More of it"), (2, "See below; licensed under CC BY 4.0! The CC BY 4.0 license is free."), (3, "He is under the MIT. A licence plate."), (4, "Licensed under GPLv2.")]
    assert scanned(spark, rows) == {1: (1, "MIT", False), 2: (1, "CC-BY-4.0", False), 3: (0, "", False), 4: (1, "GPL-2.0", True)}


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
PUBLISHED = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not PUBLISHED.exists(), reason="no copies of the long licenses on this machine")
def test_long_texts_as_published(spark):
    """Alone, and rewrapped inside a document."""
    rows = []
    for name, ident in FILES.items():
        text = (PUBLISHED / name).read_text()
        wrapped = "\n".join(" ".join(words[i : i + 9]) for words in (p.split() for p in text.replace("END OF TERMS", "\n\nEND OF TERMS").split("\n\n")) for i in range(0, len(words), 9))
        rows += [(text, ident, True), ("a line ahead\n" + text + "\nand one behind", ident, False)] + [("ahead\n" + wrapped + "\nbehind", ident, False)] * ("Copyright" not in text[:500])
    got = scanned(spark, [(k, t) for k, (t, _, _) in enumerate(rows)])
    missing = [(i, k) for k, (_, i, whole) in enumerate(rows) if i not in got[k][1].split(",") or got[k][2] != whole]
    assert missing == []
