"""Templates of licences by name: whole texts, file headers, and short notices.

Whole texts are in the folder ``license_texts``; the one of AGPL-3.0 is made of GPL-3.0, from which it
differs in its name and section 13, and of EPL-2.0 there are only its header and notices.
"""

from __future__ import annotations

from pathlib import Path

from .licenses import TEMPLATES

_TEXTS = {
    "apache-2.0": "Apache-2.0",
    "gpl-2.0": "GPL-2",
    "gpl-3.0": "GPL-3",
    "lgpl-2.1": "LGPL-2.1",
    "lgpl-3.0": "LGPL-3",
    "mpl-2.0": "MPL-2.0",
    "cc0-1.0": "CC0-1.0",
    "bsd": "BSD",
    "isc": "ISC",
    "unlicense": "Unlicense",
    "mit": "MIT",
}
_GNU = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_HEADERS = {
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "gpl-2.0": [_GNU.format(work="program", name="General Public License", version="2")],
    "gpl-3.0": [_GNU.format(work="program", name="General Public License", version="3")],
    "lgpl-2.1": [_GNU.format(work="library", name="Lesser General Public License", version="2.1")],
    "lgpl-3.0": [_GNU.format(work="library", name="Lesser General Public License", version="3")],
    "agpl-3.0": [_GNU.format(work="program", name="Affero General Public License", version="3")],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at http://www.eclipse.org/legal/epl-2.0",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: What follows "licensed under" and the like in a notice.
_NAMES = {
    "mit": ["the MIT License", "the terms of the MIT License", "an MIT license", "MIT license terms"],
    "bsd": ["the BSD License", "a BSD license", "the 3-Clause BSD License", "the 2-Clause BSD License", "the BSD 3-Clause License", "the BSD 2-Clause License"],
    "isc": ["the ISC License", "the terms of the ISC License"],
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache 2.0"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPLv2 license", "GPL 2.0"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3 license", "GPL 3.0"],
    "lgpl-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPL 2.1"],
    "lgpl-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPL 3.0"],
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL 3.0"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"],
    "epl-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "EPL 2.0"],
    "cc0-1.0": ["the CC0 1.0 Universal license", "CC0 1.0 Universal", "CC0 1.0"],
    "unlicense": ["the Unlicense license", "the terms of the Unlicense"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
}
_LEADS = ["licensed", "released", "distributed", "available", "published", "provided", "shared", "covered by", "use is governed by"]


def _notices(names: list[str]) -> list[str]:
    found = []
    for name in names:
        if len(name.replace("-", " ").replace(".", " ").split()) >= 5:  # long enough without a lead
            found.append("under " + name)
        found += [f"{lead} {name}" if lead.endswith("by") else f"{lead} under {name}" for lead in _LEADS]
    return found


def library() -> dict[str, list[str]]:
    """All templates of every licence."""
    folder = Path(__file__).parent / "license_texts"
    texts = {name: (folder / f"{file}.txt").read_text(encoding="utf-8") for name, file in _TEXTS.items()}
    affero = texts["gpl-3.0"].replace("GNU General Public License", "GNU Affero General Public License")
    texts["agpl-3.0"] = affero.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    out: dict[str, list[str]] = {name: [text] for name, text in TEMPLATES.items()}
    for name, text in texts.items():
        out.setdefault(name, []).append(text)
    for more in (_HEADERS, {name: _notices(names) for name, names in _NAMES.items()}):
        for name, found in more.items():
            out.setdefault(name, []).extend(found)
    return out
