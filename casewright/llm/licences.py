"""Licence scans by TF-IDF cosine, with inheritance along directories (operator 9)."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from importlib.resources import files as package_files
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from casewright.llm.common import short_batches, small, sub_batches, written

#: Cosine from which a line, a window or a text is taken for a licence.
SIMILAR = 0.7
#: A window of a wording with fewer terms has to hold the wording's rarest term: "all rights of" is no reservation.
SHORT = 10
TERM = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
#: Names of files that license their directory, whatever share of the text the licence is.
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
# Licences by their SPDX names, with wordings of their headers and the opening of their files.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU General Public License Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL-3.0": (
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: What reserves rights and grants none; it names a text only where no grant does.
RESERVATION = "Proprietary"
#: A wording that has one of these is no match of a text without it.
NAMES = frozenset({"apache", "mit", "gnu", "bsd", "mozilla", "eclipse", "cc", "cc0", "creative", "isc"})
#: Words before "General Public License" that make it another licence.
KINDS = {"lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}
#: Terms in which the title of a complete licence stands, and in which the clauses of a BSD licence follow its opening.
TITLE, CLAUSES = 40, 320
# Fixed value: what the users of AGPL-3.0 are promised beyond GPL-3.0, in its section 13.
REMOTE_USE = "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."


def versions(terms: list[str]) -> set[str]:
    """Numbers of versions: after "version" or "v", as "v2", or with a dot; 2.0 is 2."""
    found = set()
    for before, t in zip(["", *terms], terms):
        n = re.fullmatch(r"v?(\d+(?:\.\d+)*)", t)
        if n and (before in ("version", "v") or t[0] == "v" or "." in t):
            found.add(re.sub(r"(\.0)+$", "", n[1]))
    return found


def kinds(terms: list[str]) -> set[str]:
    """What tells licences of one family apart: GNU licences by the word before "general", others by their hyphened names."""
    gnu = {KINDS[t] for t, after in zip(terms, terms[1:]) if t in KINDS and after == "general"}
    return gnu | {t for t in terms if re.fullmatch(r"by(-(nc|sa|nd))+|attribution(-(noncommercial|sharealike|noderivatives))+|[234]-clause", t)}


def family(name: str, terms: list[str]) -> str:
    """The licence without its version, of the kind that the terms tell."""
    stem = "CC" if name.startswith("CC-") else name.split("-")[0]
    return min(kinds(terms) & set(KINDS.values()), default="GPL") if stem in ("GPL", "LGPL", "AGPL") else stem


def bsd_by_clauses(terms: list[str]) -> str:
    """Which BSD licence an opening begins, by the clauses up to the disclaimer; the family where that is not there."""
    said = " ".join(terms[:CLAUSES])
    clauses, disclaimer, _ = said.partition("this software is provided")
    if "neither the name" in clauses:
        return "BSD-3-Clause"
    return "BSD-2-Clause" if disclaimer else "BSD"


@cache
def complete_texts() -> dict[str, str]:
    """Complete texts of licences by name; that of AGPL-3.0 is GPL-3.0's under its own name and with its own section 13."""
    folder = package_files("casewright.llm") / "licence_texts"
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    texts["AGPL-3.0"] = re.sub(r"(?i)(GNU)(\s+General\s+Public)", r"\1 Affero\2", texts["GPL-3.0"])
    texts["AGPL-3.0"] = re.sub(r"(?s)\n\s*13\. Use with.*?(?=\n\s*14\.)", f"\n  13. Remote Network Interaction; Use with the GNU General Public License.\n\n{REMOTE_USE}\n", texts["AGPL-3.0"])
    return texts


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


class Scanner:
    """Unit vectors of the templates and of complete licences, and of what is compared with them.

    Term weights are inverse document frequencies over all texts; terms that no template has weigh as the rarest.
    """

    def __init__(self, texts: int, having: dict[str, int]):
        self.idf = {t: math.log((texts + 1) / (n + 1)) + 1 for t, n in having.items()}
        self.rare = math.log(texts + 1) + 1
        self.templates: list[tuple[str, dict[str, float]]] = []
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.keys: set[str] = set()
        self.sizes: list[int] = []
        self.own_keys: list[set[str]] = []
        self.rarest: list[set[str]] = []
        for name, wordings in TEMPLATES.items():
            for wording in wordings:
                v = self.unit(terms_of(wording))
                self.sizes.append(len(terms_of(wording)))
                self.own_keys.append(set())
                most = max(self.idf.get(t, self.rare) for t in v)
                self.rarest.append({t for t in v if self.idf.get(t, self.rare) >= most})
                for t, x in v.items():
                    self.by_term.setdefault(t, []).append((len(self.templates), x))
                self.templates.append((name, v))
                # without these terms of a template, nothing reaches the cosine: the rest of the template is too short
                rest = 1.0
                for t, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
                    if rest < SIMILAR**2:
                        break
                    self.keys.add(t)
                    self.own_keys[-1].add(t)
                    rest -= x * x
        self.ids = {t: i for i, t in enumerate(self.by_term)}
        self.squares = self.squared([v for _, v in self.templates], self.ids)
        self.told = [(frozenset(NAMES.intersection(terms)), versions(terms), kinds(terms), "spdx-license-identifier" in terms) for ws in TEMPLATES.values() for w in ws for terms in [terms_of(w)]]
        #: How much of a licence a wording says: the length of its vector before it is made a unit.
        self.weight = [self.length(terms_of(w)) for ws in TEMPLATES.values() for w in ws]
        self.complete = [(name, self.unit(terms_of(text))) for name, text in complete_texts().items()]
        self.titles = [terms_of(text)[:TITLE] for text in complete_texts().values()]
        self.complete_ids = {t: i for i, t in enumerate(sorted({t for _, v in self.complete for t in v}))}
        self.complete_squares = self.squared([v for _, v in self.complete], self.complete_ids).T.copy()

    @staticmethod
    def squared(vectors: list[dict[str, float]], ids: dict[str, int]) -> np.ndarray:
        """Squares of the vectors' components, a row each; the last column is for terms that none has."""
        squares = np.zeros((len(vectors), len(ids) + 1))
        for n, v in enumerate(vectors):
            for t, x in v.items():
                squares[n, ids[t]] = x * x
        return squares

    def raw(self, terms: list[str]) -> dict[str, float]:
        return {t: (1 + math.log(n)) * self.idf.get(t, self.rare) for t, n in Counter(terms).items()}

    def length(self, terms: list[str]) -> float:
        return math.sqrt(sum(x * x for x in self.raw(terms).values()))

    def unit(self, terms: list[str]) -> dict[str, float]:
        v = self.raw(terms)
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if length else {}

    def cosines(self, terms: list[str]) -> dict[int, float]:
        """The cosine with each template that it may reach SIMILAR with."""
        found: dict[int, float] = {}
        if not self.keys.isdisjoint(terms):
            for t, x in self.unit(terms).items():
                for n, y in self.by_term.get(t, ()):
                    found[n] = found.get(n, 0.0) + x * y
        return found

    def best(self, terms: list[str]) -> float:
        """The greatest cosine with a template."""
        return min(max(self.cosines(terms).values(), default=0.0), 1.0)

    def named(self, n: int, terms: list[str], rest: list[str]) -> tuple[str, bool] | None:
        """The licence that ``terms``, similar to wording ``n``, name, and whether it is just that; None if they name another.

        Version and kind have to be the wording's, or the answer is the family.  ``rest``: the text from these terms on.
        """
        name, (names, version, kind, spdx) = self.templates[n][0], self.told[n]
        met = set(terms)
        if not names <= met or spdx and not self.templates[n][1].keys() <= met:
            return None
        if name == "BSD-3-Clause" and "redistribution" in self.templates[n][1]:
            said = bsd_by_clauses(rest)
            return said, said != "BSD"
        if spdx or kind == kinds(terms) and version <= versions(terms):
            return name, True
        return family(name, terms), False

    def best_complete(self, terms: list[str]) -> tuple[float, str | None]:
        """The greatest cosine of a text with a complete licence, and its name; 0 if it is below SIMILAR."""
        met = [i for t in set(terms) if (i := self.complete_ids.get(t)) is not None]
        # the cosine is at most the length of what the text has of the licence's unit vector
        near = np.flatnonzero(self.complete_squares[met].sum(0) >= SIMILAR**2 - 1e-9)
        top: tuple[float, str | None, int] = (0.0, None, 0)
        if len(near):
            u = self.unit(terms)
            for n in near:
                name, v = self.complete[n]
                x = sum(y * u.get(t, 0.0) for t, y in v.items())
                if x >= SIMILAR and x > top[0]:
                    top = (min(x, 1.0), name, n)
        if top[1]:
            title, own = terms[:TITLE], self.titles[top[2]]
            agrees = kinds(title) == kinds(own) and versions(own) <= versions(title)
            return top[0], top[1] if agrees else family(top[1], title)
        return top[:2]

    def windows(self, n: int, terms: list[str], ids: np.ndarray, least: float) -> Iterator[tuple[float, int]]:
        """cosine, at least ``least``, and place of the runs of terms as long as wording ``n``, each run once."""
        v, size = self.templates[n][1], self.sizes[n]
        if size > len(terms):
            return
        sums = np.concatenate(([0.0], np.cumsum(self.squares[n][ids])))
        bound = sums[size:] - sums[:-size]  # at least the square of the cosine, see best_complete
        seen: set[tuple[str, ...]] = set()
        for at in np.flatnonzero(bound >= least**2 - 1e-9).tolist():
            window = tuple(terms[at : at + size])
            if window in seen:
                continue
            seen.add(window)
            if size < SHORT and self.rarest[n].isdisjoint(window):
                continue
            x = sum(y * v.get(t, 0.0) for t, y in self.unit(window).items())
            if x >= least:
                yield min(x, 1.0), at

    def scan(self, text: str | None) -> tuple[str | None, float, int | None, bool]:
        """Licence, cosine, line (from 0, null for the whole text) and whether the text as a whole is a licence.

        A window counts for the line that it begins in.
        """
        if not text:
            return None, 0.0, None, False
        lines = [terms_of(line) for line in text.split("\n")]
        terms = [t for line in lines for t in line]
        whole, whole_name = self.best_complete(terms)
        if whole_name:
            return whole_name, whole, None, True
        if self.keys.isdisjoint(terms):
            return None, 0.0, None, False
        starts = [0, *accumulate(map(len, lines))]
        top: tuple = ()
        highest = 0.0

        def consider(n: int, x: float, at: int, size: int, line: int | None) -> None:
            nonlocal top
            got = self.named(n, terms[at : at + size], terms[at : at + CLAUSES])
            if got:
                name, exact = got
                # a grant before a family before a reservation; then what says most, is nearest, listed first, and earliest
                key = (name != RESERVATION, exact, round(x * self.weight[n], 9), round(x, 9), -n, line is None, -at)
                if not top or key > top[0]:
                    top = (key, name, min(x, 1.0), line)

        for at, size, line in [(0, len(terms), None), *((starts[i], len(t), i) for i, t in enumerate(lines))]:
            for n, x in self.cosines(terms[at : at + size]).items():
                highest = max(highest, x)
                if x >= SIMILAR:
                    consider(n, x, at, size, line)
        whole = self.best(terms)
        met = set(terms)
        ids = np.fromiter(map(self.ids.get, terms, repeat(-1)), np.int64, len(terms))
        for n in sorted(range(len(self.templates)), key=lambda n: (self.templates[n][0] == RESERVATION, -self.weight[n])):
            if top and (top[0][:2] > (self.templates[n][0] != RESERVATION, True) or top[0][0] and top[0][1] and top[0][2] >= self.weight[n] + 1e-6):
                break  # nothing that follows can say more
            if not self.own_keys[n].isdisjoint(met):
                for x, at in self.windows(n, terms, ids, SIMILAR):
                    consider(n, x, at, self.sizes[n], bisect_right(starts, at) - 1)
        if not top:
            return None, min(highest, 1.0), None, False
        return top[1], top[2], top[3], whole >= SIMILAR


def vocabulary() -> list[str]:
    return sorted({t for wordings in [*TEMPLATES.values(), complete_texts().values()] for w in wordings for t in terms_of(w)})


def scan_licences(docs: DataFrame, path: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, path, licence, cosine, line, is_licence_file and inherited_from of every row of ``docs``.

    A row's own licence is that of a template near, from cosine SIMILAR on, to one of its lines, to a run of as many terms
    anywhere in its text, line ends within or not, or to its whole text; of several the one that says most (cosine times
    the length of the wording's vector).  Version and kind ("Lesser", "version 2") have to be the template's, or the answer
    is a family ("GPL", "BSD") where nothing better is found; a reservation of rights counts only where no grant is found.
    A text that is a complete licence is that one.  A row
    without one takes that of the nearest directory above it that has a licence file: a text that is a licence as a
    whole, or a licensed text so named.  Of several in a directory the greatest cosine, then the smallest path counts.
    ``inherited_from`` is that directory.  Null, empty and termless texts have no licence of their own; a null path has
    no directory, inherits nothing and licenses nothing; repeated rows stay.
    """
    short_batches(docs)
    words = vocabulary()
    known = frozenset(words)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in sub_batches(batches, "text"):
            for t in b.column(0).to_pylist():
                total.update(known.intersection(terms_of(t)))
                total[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    met = dict(docs.select(F.col(text_col).alias("text")).mapInArrow(having, "term string, n long").groupBy("term").agg(F.sum("n")).collect())
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(met.get("", 0), {t: met.get(t, 0) for t in words}))

    @F.pandas_udf("licence string, cosine double, line int, whole boolean")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scanner.value.scan(t) for t in texts], columns=["licence", "cosine", "line", "whole"])
        out["line"] = out["line"].astype("Int32")
        return out

    rows = docs.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), scan(F.col(text_col)).alias("s")).select("id", "path", "s.*")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    rows = rows.withColumn("folder", folder).withColumn("is_file", F.col("licence").isNotNull() & F.col("path").isNotNull() & (F.col("whole") | F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_NAME), F.lit(False))))
    rows = written(rows, "scanned")
    files = rows.where("is_file").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("f")).select(F.col("folder").alias("above"), F.col("f.licence").alias("given"))
    parts = F.split("folder", "/")
    above = rows.select("folder").where("folder IS NOT NULL").distinct().select("folder", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n))))).alias("above")).distinct()
    near = above.join(files, "above").withColumn("nth", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc(F.length("above"))))).where("nth = 1").select("folder", "above", "given")
    done = rows.join(small(near), "folder", "left")
    return done.select(
        F.col("id").alias(id_col), "path", F.coalesce("licence", "given").alias("licence"), "cosine", "line", F.col("is_file").alias("is_licence_file"), F.when(F.col("licence").isNull() & F.col("given").isNotNull(), F.col("above")).alias("inherited_from")
    )
