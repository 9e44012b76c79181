"""License notices by conditional compression: a block is compressed with each template as a raw zstandard dictionary.

A block is a run of lines, or of windows of long lines, and, so that a short notice among other words isn't lost in its window, what begins with the first words of a notice, as long as such
notices are. Whether a block is a candidate is told by compression: with all templates as one dictionary it must come out clearly smaller than alone. Compression ranks the licenses of each candidate,
and only those it leaves are compared: a notice is confirmed by its exact words, and what differs from the nearest notice is listed.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public license notices, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "Licensed under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-1.0": ["This work is licensed under the GNU General Public License, version 1.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
}
# Names of the licenses, by SPDX identifier.
NAMES: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License", "0BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "GNU AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "EUPL-1.2": ["EUPL, Version 1.2"],
    "GPL-1.0": ["GNU General Public License, version 1", "GPLv1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GNU GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GNU GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License"],
}
#: Sentences that give a work a license by its name, and words that take it back if they stand before it in its sentence. Fixed values.
FORMS = ("Released under the {}.", "Released under {}.", "Licensed under the {}.", "Licensed under {}.", "Licensed under a {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}.", "Distributed under the terms of the {}.", "Available under the {}.")
DENIALS = frozenset("not never no nor neither without unless isn aren wasn weren don doesn didn won cannot can't previously formerly longer unlike false untrue wrong refuse refuses refused deny denies denied reject rejects rejected except instead nobody none hardly revoked withdrawn pretend pretends".split())
#: A sentence ends at such a mark before white space, or at an empty line; notices among the words before are no longer looked at.
_ENDS = re.compile(r"[.!?;:](?=\s)|\n[ \t\r]*\n")


def notices_by_license() -> dict[str, list[str]]:
    """The given notices, and those made of names and forms and of identifiers."""
    made = {key: [form.format(name) for name in names for form in FORMS] + [f"SPDX-License-Identifier: {key}"] for key, names in NAMES.items()}
    return {key: TEMPLATES.get(key, []) + made.get(key, []) for key in sorted(TEMPLATES.keys() | NAMES.keys())}


WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: A word broken at its hyphen by the end of a line.
_BROKEN = re.compile(r"([A-Za-z0-9.-]*[A-Za-z0-9]-)[ \t\r]*\n[ \t]*(?=[A-Za-z0-9])")
LEVEL = 3
#: Words of a window in a long line and of the step to the next; a candidate saves so many bytes and this share at least. Words around an exact notice that are compressed with it.
WINDOW, STEP, SAVED, SHARE, AROUND = 24, 12, 8, 0.12, 4


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def changes(block: list[str], notice: list[str]) -> list[str]:
    """The words of the notice that the block lacks (-) and those it has between its first and last word in common with the notice (+)."""
    codes = [c for c in difflib.SequenceMatcher(None, block, notice, autojunk=False).get_opcodes()]
    same = [c for c in codes if c[0] == "equal"]
    if not same:
        return [f"-{w}" for w in notice]
    low, high = same[0][1], same[-1][2]
    return [x for c in codes if c[0] != "equal" for x in [*(f"-{w}" for w in notice[c[3] : c[4]]), *(f"+{w}" for w in block[max(c[1], low) : min(c[2], high)])]]


class Scanner:
    def __init__(self, notices: dict[str, list[str]], top: int | None = None) -> None:
        """top: of a block without an exact notice so many licenses are compared word by word, the first by size reduction; all that save bytes if none is given."""
        import zstandard

        self.top = top
        self.notices = {name: sorted({tuple(words(t)) for t in texts}, key=lambda t: (-len(t), t)) for name, texts in notices.items()}
        self.known = {notice: name for name, own in self.notices.items() for notice in own}
        self.starts: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for notice in sorted(self.known, key=lambda t: (-len(t), t)):
            self.starts.setdefault(notice[:2], []).append(notice)
        self.firsts = {key[0] for key in self.starts}
        self.lengths = {key: sorted({len(t) for t in own}, reverse=True) for key, own in self.starts.items()}
        frame = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        raw = lambda texts: zstandard.ZstdCompressionDict("\n".join(" ".join(t) for t in texts).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.plain = zstandard.ZstdCompressor(**frame)
        self.packers = {}
        for name, own in {"": list(self.known), **self.notices}.items():
            d = raw(own)
            d.precompute_compress(level=LEVEL)
            self.packers[name] = zstandard.ZstdCompressor(dict_data=d, **frame)
        self.any = self.packers.pop("")

    def saved(self, own: list[str]) -> tuple[int, int]:
        data = " ".join(own).encode()
        alone = len(self.plain.compress(data))
        return alone, alone - len(self.any.compress(data))

    def candidate(self, own: list[str]) -> bool:
        """Whether all templates together shrink the words clearly."""
        alone, saved = self.saved(own)
        return saved >= SAVED and saved >= SHARE * alone

    def ranked(self, own: list[str]) -> tuple[int, dict[str, int]]:
        """Bytes of the words alone, and what each license's dictionary saves of them, the most first; licenses that save none are left out."""
        data = " ".join(own).encode()
        alone = len(self.plain.compress(data))
        saved = {name: alone - len(packer.compress(data)) for name, packer in self.packers.items()}
        return alone, dict(sorted(((x, n) for x, n in saved.items() if n > 0), key=lambda r: (-r[1], r[0])))

    def blocks(self, lines: list[list[str]]) -> Iterator[tuple[int, int, list[str]]]:
        """(first line, place of the first word, words) of runs of lines, or of windows of long lines, that all templates together shrink clearly."""
        run: list[str] = []
        first = start = place = 0
        for n, own in enumerate(lines):
            if not own:  # an empty line ends no notice
                continue
            spans = [(at, at + WINDOW) for at in range(0, max(1, len(own) - WINDOW + STEP), STEP)] if len(own) > WINDOW else [(0, len(own))]
            end = 0  # words of this line that are in the run or behind it
            for low, high in spans:
                if self.candidate(own[low:high]):
                    if not run or low > end:
                        if run:
                            yield first, start, run
                        run, first, start = [], n, place + low
                        end = low
                    run += own[max(low, end) : high]
                    end = min(high, len(own))
            if run and end < len(own):
                yield first, start, run
                run = []
            place += len(own)
        if run:
            yield first, start, run

    def exact(self, own: list[str]) -> Iterator[tuple[str, int, int]]:
        """(license, first word, word behind the last) of the candidates, among blocks that begin as a notice does, that are a notice of a license they are ranked under; the longest first where several start."""
        behind = 0
        for at in [i for i, w in enumerate(own) if w in self.firsts]:
            if at >= behind and (found := next(self._confirmed(own, at), None)) is not None:
                behind = at + found[1]
                yield found[0], at, behind

    def _confirmed(self, own: list[str], at: int) -> Iterator[tuple[str, int]]:
        """(license, words) of the blocks at a place that compression tells to be candidates, by their exact words."""
        for key in (tuple(own[at : at + 2]), (own[at],)):
            for n in self.lengths.get(key, []):
                block = own[at : at + n]
                if len(block) == n and self.candidate(block):
                    yield from ((name, n) for name in self.ranked(block)[1] if tuple(block) in self.notices[name])

    @staticmethod
    def refused(text: str, own: list[str], at: int, end: int) -> str | None:
        """A denial in the notice's sentence before it, or a version number right after it."""
        place = next(m.start() for n, m in enumerate(WORD.finditer(text.lower())) if n == at)
        before = text[:place]
        start = max((m.end() for m in _ENDS.finditer(before)), default=0)
        denied = next((w for w in words(before[start:]) if w in DENIALS), None)
        return denied or (own[end] if end < len(own) and own[end][0].isdigit() else None)

    def scan(self, text: str) -> Iterator[dict]:
        if "-\n" in text:
            text = _BROKEN.sub(r"\n\1", text)  # the whole word goes to the next line
        lines = [words(line) for line in text.split("\n")]
        own = [w for line in lines for w in line]
        found = list(self.exact(own))
        ends = list(accumulate(map(len, lines)))
        for name, at, end in found:
            data = " ".join(own[max(0, at - AROUND) : end + AROUND]).encode()
            alone = len(self.plain.compress(data))
            refused = self.refused(text, own, at, end)
            yield {"line": bisect_right(ends, at), "license": name, "plain_bytes": alone, "saved_bytes": alone - len(self.packers[name].compress(data)), "changed": [f"+{refused}"] if refused else [], "confirmed": not refused}
        for line, start, block in self.blocks(lines):
            if any(at < start + len(block) and end > start for _, at, end in found):
                continue
            alone, saved = self.ranked(block)
            best: tuple | None = None
            bag = set(block)
            for name in list(saved)[: self.top]:
                for notice in self.notices[name]:
                    if 2 * len(bag.intersection(notice)) > len(set(notice)):
                        changed = changes(block, list(notice))
                        best = min(best or (9.0,), (len(changed) / len(notice), -saved[name], name, changed))
            if best and best[0] <= 0.5:
                yield {"line": line, "license": best[2], "plain_bytes": alone, "saved_bytes": -best[1], "changed": best[3], "confirmed": False}


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, top: int | None = None) -> DataFrame:
    """Rows for what may be a license notice in docs (doc_id, text): doc_id, line, license, plain_bytes, saved_bytes, changed, confirmed.

    Each notice that stands in a text word by word, on its own, within a sentence or over several lines, is a candidate by compression and gives a confirmed row, with the size reduction of its words
    and a few around by its license's own dictionary, unless a denial stands before it in its sentence or a version number after it. Other lines, and windows of long lines, are candidates if all
    notices as one dictionary shrink them clearly; neighbours are one block, and give at most one row, not confirmed: of the licenses by size reduction the notice
    that differs least, at most by half, and the words that differ. Null and empty texts give no rows; repeated rows give theirs again; null ids stay; other columns are ignored.
    """
    notices = notices or notices_by_license()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, top)
        schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("license", pa.string()), ("plain_bytes", pa.int32()), ("saved_bytes", pa.int32()), ("changed", pa.list_(pa.string())), ("confirmed", pa.bool_())])
        for batch in batches:
            rows = [{"doc_id": i} | x for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in scanner.scan(text.decode("utf-8", "replace"))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    return known.mapInArrow(run, "doc_id long, line int, license string, plain_bytes int, saved_bytes int, changed array<string>, confirmed boolean")
