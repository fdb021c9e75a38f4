"""Licences in texts written without the templates."""

from skyraster.llm import license_library, licenses

#: Notices as authors write them.
NOTICES = [
    ("Released under the MIT License.", {"mit"}),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", {"mit"}),
    ("The code is released under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("Content available under CC BY-NC 4.0, unless noted otherwise.", {"cc-by-nc-4.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0"}),
    (
        "frobnicate is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Lesser General "
        "Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
        {"lgpl-3.0"},
    ),
    (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        set(),  # a third of ISC
    ),
    ("We spoke about the license of the MIT library for hours.", set()),
]


def test_notices_and_whole_texts(spark):
    filler = " ".join(f"w{i}" for i in range(700))
    texts = [(f"{filler} {t} {filler}", names) for t, names in NOTICES]
    for name, file in license_library._TEXTS.items():
        words = (license_library.Path(license_library.__file__).parent / "license_texts" / f"{file}.txt").read_text().split()
        words[40::200] = ["changed"] * len(words[40::200])
        texts.append((f"{filler} {' '.join(words)} {filler}", {name}))
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in licenses.scan_licenses(frame, license_library.library()).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    for i, (text, names) in enumerate(texts):
        own = got.get(i, [])
        assert len(own) == len(set(own)) and names <= set(own), (i, names, own)
        if i < len(NOTICES):
            assert set(own) == names, (i, own)


def test_whole_library_on_a_table(spark):
    """Every template against every whole text."""
    library = license_library.library()
    grams_of = lambda text: set(licenses._shingles(licenses.WORD.findall(text.lower())))
    templates = [(name, grams_of(t)) for name, own in library.items() for t in ([own] if isinstance(own, str) else own)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    holders: dict = {}
    for n, (_, wanted) in enumerate(templates):
        for g in wanted:
            holders.setdefault(g, []).append(n)
    expected: dict = {}
    for r in docs.collect():
        shared: dict = {}
        for g in grams_of(r.text or ""):
            for n in holders.get(g, ()):
                shared[n] = shared.get(n, 0) + 1
        for n, count in shared.items():
            name, wanted = templates[n]
            if count >= 0.8 * len(wanted):
                expected.setdefault(r.doc_id, {}).setdefault(name, 0)
                expected[r.doc_id][name] = max(expected[r.doc_id][name], count / len(wanted))
    got: dict = {}
    for r in licenses.scan_licenses(docs, library).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.license, 0)
        got[r.doc_id][r.license] = max(got[r.doc_id][r.license], r.containment)
    assert got.keys() == expected.keys() and got
    for doc_id, own in expected.items():
        assert got[doc_id].items() <= own.items()
        for name in own.keys() - got[doc_id].keys():  # outdone by a licence with alike words
            assert max(got[doc_id].values()) > own[name]


def test_all_occurrences(spark):
    notice = "Released under the MIT License."
    apart = " ".join(f"w{i}" for i in range(40))
    text = f"İİİ {notice} {notice} {apart} {notice} İ {apart} released under the mit license"
    rows = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), license_library.library()).collect()
    found = sorted((r.window_start, r.window_end) for r in rows)
    assert [text[a:b].lower() for a, b in found] == ["released under the mit license"] * 4
    bsd = licenses.TEMPLATES["bsd"]
    rows = licenses.scan_licenses(spark.createDataFrame([(1, f"{bsd}; {bsd} {apart} {bsd}")], "doc_id long, text string")).collect()
    assert sorted(r.window_start for r in rows) == [0, len(bsd) + 2, 2 * len(bsd) + len(apart) + 4] and {r.containment for r in rows} == {1.0}


def test_few_texts_are_split_into_words(monkeypatch):
    """A text that shares no shingle with a template is not split; one that shares any always is."""
    index = licenses.Index(license_library.library())
    notice = "Released under the MIT License."
    plain = " ".join(f"w{i}" for i in range(60))
    odd = ["released under “the” MIT, license", "naïve released_under...the mit license", f"{plain} Released under the MİT License", "released under the mit lïcense"]
    texts = [plain, notice, "", f"{plain}\n{notice}", "released under the", "the MIT License", *odd, "under the K", f"{plain} " * 9]
    monkeypatch.setattr(licenses, "SIFT_BYTES", 256)
    sifted = set(index.sift(texts).tolist())
    known: dict = {}
    held = {i for i, t in enumerate(texts) if (words := licenses._words(t)) and len(index.hits(licenses._shingle_hashes(words, known)))}
    assert held == {1, 3, 6, 7} and sifted == held | {10}
    # A template of fewer words than a shingle, and one with a word outside of ASCII, rule out less.
    odd = licenses.Index({"a": "all rights reserved", "b": "le café est à tout le monde"})
    texts = [plain, "All rights reserved.", "le Café est à tout le monde"]
    assert [len(odd.matches(texts[i], {})) for i in odd.sift(texts)] == [1, 1]
    monkeypatch.setattr(licenses, "SIFT_MOST", 100)
    assert list(odd.sift(texts)) == [0, 1, 2]


def test_only_sifted_texts_are_split(monkeypatch):
    seen = []
    words = licenses._words
    monkeypatch.setattr(licenses, "_words", lambda text: (seen.append(text), words(text))[1])
    index = licenses.Index(license_library.library())
    texts = [" ".join(f"w{i * j}" for i in range(50)) for j in range(40)] + ["Released under the MIT License."]
    found = [m for n in index.sift(texts) for m in index.matches(texts[n], {})]
    assert len(found) == 1 and seen == texts[-1:]
