"""Licence scan: a trained classifier over the words and word pairs of paragraphs names families, templates confirm them.

A paragraph is a block between blank lines, however its lines are wrapped. Overlapping windows of a paragraph's
words are classified; windows that state a licence are joined to regions. The families that the classifier names in a region's
windows, long and short, are confirmed one by one: a statement of that very family must stand there, with the words that tell
it from its kin (version, clauses, the identifier itself), and not be denied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import texts

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
# Statements by which well-known licences are declared, by SPDX-like family. The first of each family is its usual short form.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Distributed under the Apache License 2.0.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication."),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "Licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ),
}
# Licence-like statements that name none of the families.
OTHER = (
    "Licensed under the terms of our own licence agreement.",
    "Copyright by the authors. All rights reserved.",
    "Released under a proprietary license.",
    "Use of this work requires written permission of the copyright holder.",
    "Licensed under the Example Community License, version 7.",
    "Distributed under the terms of the partner license.",
    "No part of this publication may be reproduced or distributed in any form without the prior written permission of the publisher.",
    "This software is the confidential and proprietary information of the company and may be used only under a license agreement.",
    "You may use and copy this software for evaluation purposes only; redistribution in any form is not permitted.",
    "This document may be shared freely as long as the author is credited and no fee is charged.",
    "Permission to reprint this work for teaching is granted if the notice below is kept.",
    "This data is made available under the Open Example License; see the terms of use for details.",
)
OTHER += (
    "This work is not licensed under the Apache License, Version 2.0; it is proprietary.", "This software is not released under the MIT License or the GNU General Public License.", "The code was never distributed under the BSD License.",
    "SPDX-License-Identifier: AFL-3.0", "SPDX-License-Identifier: MS-PL", "SPDX-License-Identifier: LicenseRef-Own", "SPDX-License-Identifier: Artistic-2.0",
    "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: CDDL-1.0", "SPDX-License-Identifier: WTFPL", "SPDX-License-Identifier: Proprietary",
)
# SPDX identifiers of the families.
SPDX = {
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "Apache-2.0": ("Apache-2.0",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "BSL-1.0": ("BSL-1.0",),
    "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "CC-BY-SA-4.0": ("CC-BY-SA-4.0",), "CC0-1.0": ("CC0-1.0",), "EPL-2.0": ("EPL-2.0",),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "ISC": ("ISC",),
    "LGPL": ("LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",), "MPL-2.0": ("MPL-2.0",), "Unlicense": ("Unlicense",), "Zlib": ("Zlib",),
}
TEMPLATES = {k: (*(t for t in v if not t.startswith("SPDX")), *(f"SPDX-License-Identifier: {i}" for i in SPDX[k])) for k, v in TEMPLATES.items()}
# What must stand in a statement of each family, as words with single spaces between: the words that tell it from its kin.
_GNU = "(?<!affero )(?<!lesser )(?<!library )general public license\\b(?: [a-z]+){0,9}? (?:version |v )?"
MARKS = {
    "AGPL-3.0": "affero general public license|\\bagpl\\b", "Apache-2.0": "\\bapache (?:software )?(?:license )?(?:version )?(?:v )?2(?:\\.0)?(?![0-9.])|licenses license 2\\.0|permissions and limitations under the license",
    "BSD": "\\bbsd\\b|redistributions? (?:and use )?(?:in|of) (?:source|binary)|neither the name of", "BSL-1.0": "boost software license|\\bbsl 1",
    "CC-BY-4.0": "\\bcc by 4\\.0|commons attribution 4\\.0", "CC-BY-NC-4.0": "\\bcc by nc 4\\.0|attribution non ?commercial 4\\.0", "CC-BY-SA-4.0": "\\bcc by sa 4\\.0|attribution share ?alike 4\\.0",
    "CC0-1.0": "\\bcc0\\b", "EPL-2.0": "eclipse public license (?:version |v )?2|\\bepl 2",
    "GPL-2.0": f"{_GNU}2(?:\\.0)?(?![0-9.])|(?<![a-z])gpl (?:v )?2(?:\\.0)?(?![0-9.])", "GPL-3.0": f"{_GNU}3(?:\\.0)?(?![0-9.])|(?<![a-z])gpl (?:v )?3(?:\\.0)?(?![0-9.])",
    "ISC": "\\bisc\\b|permission to use copy modify and or distribute", "LGPL": "lesser general public license|library general public license|\\blgpl\\b",
    "MIT": "\\bmit\\b|permission is hereby granted free of charge|permission notice shall be included in all copies", "MPL-2.0": "mozilla public license (?:version |v )?2|\\bmpl 2|mozilla\\.org|mozilla org mpl 2",
    "Unlicense": "\\bunlicense\\b|free and unencumbered|anyone is free to copy modify publish", "Zlib": "\\bzlib\\b|without any express or implied warranty|including commercial applications|origin of this software must not|altered source versions",
}
MARKS = {k: re.compile(v) for k, v in MARKS.items()}
# A statement that is denied, and an identifier line.
DENIED = re.compile("\\b(?:not|never|no longer|nor|isn t|aren t|wasn t|neither) (?:be |been )?(?:licensed|released|distributed|available|made available|covered|offered|provided|published|under)\\b")
TAGGED = re.compile("spdx license identifier")
NONE, UNKNOWN = "none", "unknown"
#: Words of the short windows by which families are named, from one to the next, words beside a window that are read with it, and the least probability that names.
SHORT, STEP_SHORT, BESIDE, NAMED = 10, 3, 4, 0.02
#: Negative documents of the training sample at most (expected), variants of a statement, training steps, least word-pair likeness to a statement.
SAMPLE, VARIANTS, STEPS, LIKE = 400, 40, 150, 0.6
#: Share of the corpus windows from which a word is vocabulary.
COMMON = 0.01
#: Letters of a piece of the training sample at most.
PIECE = 2000
#: Words of a window and from one window to the next.
WIDTH, HOP = 24, 8


def paragraphs(text: str | None) -> list[str]:
    return [p for p in BLANK.split(text or "") if p.strip()]


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Classifier:
    """Multinomial logistic regression over counts of words and word pairs in a window of WIDTH words.

    The vocabulary is the words and pairs of the statements and those that stand in COMMON of the corpus windows. A
    word or pair that it lacks counts as one other. A window's logits are differences of running sums, so that all
    windows of a text cost one pass over its words.
    """

    def __init__(self, negatives: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = [NONE, UNKNOWN, *sorted(TEMPLATES)]
        stated = [(self.classes.index(k), WORD.findall(t.lower())) for k, v in sorted(TEMPLATES.items()) for t in v] + [(1, WORD.findall(t.lower())) for t in OTHER]
        self.templates = {k: [pairs_of(WORD.findall(t.lower())) for t in v] for k, v in TEMPLATES.items()}
        every = [p for v in self.templates.values() for p in v] + [pairs_of(w) for c, w in stated if c == 1]
        plain = []
        for t in negatives:
            words = WORD.findall(t.lower())
            for i in range(0, max(1, len(words) - WIDTH // 2), WIDTH):
                w = words[i : i + WIDTH]
                own = pairs_of(w)
                # no window that holds a statement, or that a longer statement holds
                if w and not any(len(p & own) >= LIKE * min(len(p), max(1, len(own))) for p in every):
                    plain.append(w)
        # statements alone, and within the prose of the corpus; of every third statement, half of the variants calibrate
        rows, held = [(0, w) for w in plain], []
        prose = [w for p in plain for w in p]
        for w in plain[::3]:  # fragments, and words over and over
            rows.append((0, w[: int(rng.integers(1, 9))]))
            a, b = (w[int(k)] for k in rng.integers(0, len(w), 2))
            turn = int(rng.integers(0, WIDTH))
            rows.append((0, [a] * turn + [b] * (WIDTH - turn)))
        rows += [(0, [w] * WIDTH) for w in sorted({w for _, words in stated for w in words})]
        for n, (c, words) in enumerate(stated):
            for i in range(VARIANTS):
                kept = [w for w in words if i < 2 or rng.random() > 0.06]
                if len(kept) > WIDTH:
                    at = int(rng.integers(0, len(kept) - WIDTH + 1))
                    kept = kept[at : at + WIDTH]
                room = min(len(prose), WIDTH - len(kept))
                room = 0 if i == 0 else room if i % 4 else int(rng.integers(0, room + 1))
                before = int(rng.integers(0, room + 1))
                cut = int(rng.integers(0, len(prose) - room + 1))
                own = prose[cut : cut + room]
                (held if n % 3 == 2 and i % 2 else rows).append((c, own[:before] + kept + own[before:]))
        rows = [rows[i] for i in rng.permutation(len(rows))]
        held += [r for r in rows if r[0] == 0][: len(plain) // 5]
        seen: dict[str, int] = {}
        for w in plain:
            for g in {*w, *(f"{a} {b}" for a, b in pairs_of(w))}:
                seen[g] = seen.get(g, 0) + 1
        known = {g for g, n in seen.items() if n >= max(2, COMMON * len(plain))}.union(*({*w, *(f"{a} {b}" for a, b in pairs_of(w))} for _, w in stated))
        self.words = {g: n + 1 for n, g in enumerate(sorted(g for g in known if " " not in g))}
        base = len(self.words) + 1
        code = np.array([self.words[a] * base + self.words[b] for a, b in (g.split(" ") for g in known if " " in g) if a in self.words and b in self.words], np.int64)
        self.pairs = np.sort(code)
        x, y = np.stack([self._features(w) for _, w in rows]), np.array([c for c, _ in rows])
        weights, self.heat = self._fit(x, y), 1.0
        self.bias, self.weights = weights[-1], weights[:-1]
        if held:
            z, y = np.stack([self._features(w) for _, w in held]) @ weights, np.array([c for c, _ in held])
            heats = np.linspace(0.25, 4, 61)
            self.heat = float(heats[np.argmin([-np.log(self._soft(z / h)[np.arange(len(y)), y] + 1e-12).mean() for h in heats])])

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the weights for each word, and for each pair: word 0 and pair 0 are any other."""
        get, base = self.words.get, len(self.words) + 1
        one = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        two = one[:-1] * base + one[1:]
        at = np.minimum(np.searchsorted(self.pairs, two), max(0, len(self.pairs) - 1))
        two = np.where((one[:-1] > 0) & (one[1:] > 0) & (self.pairs[at] == two), at + 1, 0) if len(self.pairs) else np.zeros(len(two), np.int64)
        return one, base + two

    def _features(self, words: list[str]) -> np.ndarray:
        v = np.zeros(len(self.words) + 1 + len(self.pairs) + 1 + 1, np.float32)
        one, two = self._ids(words)
        np.add.at(v, one, 1 / WIDTH**0.5)
        np.add.at(v, two, 1 / WIDTH**0.5)
        v[-1] = 1
        return v

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Adam on the log loss with a small ridge; half of the loss is that of windows without a licence, the rest is shared by the classes."""
        k = len(self.classes)
        w, m, v = (np.zeros((x.shape[1], k), np.float32) for _ in range(3))
        goal = np.eye(k, dtype=np.float32)[y]
        share = (np.where(np.arange(k) == 0, k - 1, 1) / np.maximum(1, np.bincount(y, minlength=k)))[y][:, None]
        share = (share / share.sum()).astype(np.float32)
        for i in range(1, STEPS + 1):
            g = x.T @ ((self._soft(x @ w) - goal) * share) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        return w

    def windows(self, words: list[str], width: int = WIDTH, hop: int = HOP) -> tuple[np.ndarray, np.ndarray]:
        """(starts, calibrated probabilities by class) of the windows of a paragraph; the last one ends with it."""
        one, two = self._ids(words)
        each = self.weights[one]
        each[1:] += self.weights[two]
        total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=float)])
        start = np.unique(np.append(np.arange(0, max(1, len(words) - width + 1), hop), max(0, len(words) - width)))
        end = np.minimum(start + width, len(words))
        z = total[end] - total[start]
        z[start > 0] -= self.weights[two[start[start > 0] - 1]]  # the pair that leads into the window
        return start, self._soft((z / WIDTH**0.5 + self.bias) / self.heat)

    def _confirmed(self, family: str, words: list[str], spans: list[tuple[int, int]], region: set) -> float:
        """Likeness of the family's best statement to the region, or 0 where its words do not stand in what names it, or are denied."""
        whole = " ".join(words)
        at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])  # where each word begins
        marks = [(int(np.searchsorted(at, m.start(), "right")) - 1, int(np.searchsorted(at, m.end()))) for m in MARKS[family].finditer(whole)]
        for a, b in spans:
            lo, hi = max(0, a - BESIDE), b + BESIDE
            if any(x < hi and y > lo for x, y in marks) and not DENIED.search(" ".join(words[lo:hi])):
                break
        else:
            return 0.0
        return max(len(t & region) / len(t) for t in self.templates[family])

    def paragraph(self, text: str) -> list[tuple[str, float, float]]:
        """(family or 'unknown', calibrated probability, likeness to its best statement) of each licence of each region that states one.

        A region's families are those that the classifier gives NAMED in one of its windows, long or short, the surest first. One that its
        own statement does not confirm is dropped; a region without any left is unknown, as sure as that some licence stands there.
        """
        words = WORD.findall(text.lower())
        if not words:
            return []
        start, p = self.windows(words)
        says = np.flatnonzero(p[:, 0] < 0.5)
        if not len(says):
            return []
        out = []
        for part in np.split(says, np.flatnonzero(start[says[1:]] > start[says[:-1]] + WIDTH) + 1):
            first, last = int(start[part[0]]), int(start[part[-1]]) + WIDTH
            own = words[first:last]
            region = pairs_of(own)
            near, q = self.windows(own, SHORT, STEP_SHORT)
            spans = [(int(start[i]) - first, int(start[i]) - first + WIDTH) for i in part] + [(int(i), int(i) + SHORT) for i in near]
            told = np.concatenate([p[part], q])
            found = []
            for n in np.argsort(-told[:, 2:].max(axis=0), kind="stable").tolist():
                named = np.flatnonzero(told[:, 2 + n] >= NAMED)
                if not len(named):
                    continue
                family = self.classes[2 + n]
                like = self._confirmed(family, own, [spans[i] for i in named[np.argsort(-told[named, 2 + n], kind="stable")].tolist()], region)
                if like >= LIKE:
                    found.append((family, float(told[named, 2 + n].max()), like))
            out += found or [(UNKNOWN, float(1 - p[part, 0].min()), 0.0)]
        return out

    def document(self, text: str | None) -> tuple[int, list[tuple[str, float, float, int]]]:
        """How many paragraphs, and of each region that states a licence its result and paragraph."""
        own = paragraphs(text)
        return len(own), [(*got, n) for n, x in enumerate(own) for got in self.paragraph(x)]


def trained(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier whose negatives are 5 * ``sample`` pieces, of PIECE letters at most, of the paragraphs of about ``sample`` whole documents (by hashes)."""
    n = docs.count()
    some = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text", F.lit("licences")), F.lit(1_000_000)) < int(min(1.0, sample / max(1, n)) * 1_000_000)))
    # whole texts, in pieces of a bounded size, so that what comes to the driver is bounded by bytes
    parts = some.select(F.explode(F.split("text", r"\n[ \t\r\f]*\n")).alias("part")).select(F.explode(F.regexp_extract_all("part", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("part"))
    lines = parts.where("trim(part) <> ''").distinct().orderBy(F.xxhash64("part"), "part").limit(5 * sample)
    return Classifier([r.part for r in lines.collect()])


def scanned(docs: DataFrame) -> DataFrame:
    """Documents -> (doc_id, n_paragraphs, licence, confidence, likeness, findings): one row a document.

    licence is the family of the most confident finding (ties: the earliest), each licence of a dual licence is a finding, 'unknown' if a licence is stated
    that no family's statement confirms, or null. Every window of every paragraph of every text is classified;
    only the negatives of the training set are a bounded sample. Repeated rows are scanned one by one. A text of
    any length is scanned a paragraph at a time. Null and empty texts have no paragraph. Empty table: no rows.
    """
    model = trained(docs)
    rows = texts(docs)
    finding = T.StructType().add("licence", "string").add("confidence", "double").add("likeness", "double").add("paragraph", "long")
    schema = T.StructType().add("doc_id", "long").add("n_paragraphs", "long").add("licence", "string").add("confidence", "double").add("likeness", "double").add("findings", T.ArrayType(finding))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("licence", pa.string()), ("confidence", pa.float64()), ("likeness", pa.float64()), ("findings", pa.list_(pa.struct([("licence", pa.string()), ("confidence", pa.float64()), ("likeness", pa.float64()), ("paragraph", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = model.document(t)
                best = max(found, key=lambda f: (f[0] != UNKNOWN, f[1], -f[3]), default=(None, None, None))
                out.append((d, n, *best[:3], [dict(zip(("licence", "confidence", "likeness", "paragraph"), f, strict=True)) for f in found]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)
