"""Licence families of lines and paragraphs, by a sparse word n-gram classifier, in DataFrame functions alone.

Every line is judged, and every paragraph of several lines (up to a blank one) as a whole; a paragraph is listed at its first
line, where none of its own lines has its family with the same probability or more. Terms are words and pairs of successive words that aren't all in COMMON. They
add their weights, and a softmax over the families, `unknown` (licences of no family here) and `none` gives probabilities. Training is
done on the driver from the fixed texts below (no table is read): logistic regression with an L1 penalty, by proximal gradient steps.
Probabilities are calibrated on texts that the weights were not learned from: in each of FOLDS rounds a part of every family's notices,
whole families of FOREIGN licences and a part of the prose are held out; the temperature and the cut below which a family becomes
`unknown` are those that suit all held-out texts best. A family is confirmed if CONFIRMED of the distinct words (of the text or the
template, whichever has fewer) are common to the text and one of that family's templates.

Nothing is scored that can't be a licence: the model's terms fall into heavy ones and light ones, whose weights cannot lift any family
above `none` even if a text holds all of them (`gate`); each heavy term has a word in the gate, so a text without one is `none`.

Null and empty texts have no licence lines, and an empty table gives an empty result. Of equal probabilities the family that is first by
name counts, `none` last. Every row gives one row; repeated rows have equal results; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C

#: Usual notices of each family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL, version 3.0 or later.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the GNU AGPL v3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "Distributed under the terms of the AGPLv3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0",
        "Released under Apache 2.0.", "Available under the Apache 2.0 license.", "Distributed under the terms of the Apache Software License.", "Code is under Apache License v2.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD license.", "Distributed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc_by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Content is available under CC-BY 4.0.",
        "Published under a Creative Commons Attribution license.", "Text under CC BY 3.0.",
    ],
    "cc_by_nc": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Content is available under CC-BY-NC 4.0.",
        "Published under a Creative Commons Attribution-NonCommercial license.", "Text under CC BY-NC 3.0, no commercial use.",
    ],
    "cc_by_sa": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Content is available under CC-BY-SA 4.0.",
        "Published under a Creative Commons Attribution-ShareAlike license.", "Text under CC BY-SA 3.0, share alike.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL, version 2.", "Released under the GNU GPL v3 or later.", "Distributed under the terms of the GPLv2.", "GPL-2.0-only", "GNU GPL version 3.", "Distributed under the terms of the GPL v2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the GNU LGPL v3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Distributed under the terms of the LGPLv2.1.",
    ],
    "mit": [
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Code is under MIT.", "MIT licensed.", "Distributed under the terms of the MIT License.",
        "The software is provided as is, without warranty of any kind, express or implied.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0.", "Released under the MPL 2.0.", "Distributed under the terms of the MPL v2.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "This material is proprietary and confidential.", "All rights reserved.", "Proprietary and confidential.",
        "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved.",
    ],
    "public_domain": [
        "This work is dedicated to the public domain.", "Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain.", "Licensed under CC0.",
        "The authors waive all rights; the text is in the public domain.",
    ],
}
#: Licences of none of the families, by licence.
FOREIGN = {
    "eclipse": ["Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License."],
    "eupl": ["Licensed under the EUPL, Version 1.2.", "European Union Public Licence", "SPDX-License-Identifier: EUPL-1.2"],
    "isc": ["ISC License", "Released under the ISC license.", "SPDX-License-Identifier: ISC"],
    "artistic": ["Artistic License 2.0", "You may modify it under the terms of the Artistic License.", "SPDX-License-Identifier: Artistic-2.0"],
    "zlib": ["Licensed under the zlib license.", "SPDX-License-Identifier: Zlib", "This software is under the zlib/libpng License."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Use is subject to the Boost license."],
    "wtfpl": ["Released under the WTFPL.", "SPDX-License-Identifier: WTFPL", "Licensed under the WTFPL, version 2."],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0", "Licensed under the CDDL."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1", "Fonts under the OFL."],
    "postgresql": ["Released under the PostgreSQL License.", "SPDX-License-Identifier: PostgreSQL", "Licensed under the PostgreSQL license."],
    "php": ["This source file is subject to version 3.01 of the PHP license.", "SPDX-License-Identifier: PHP-3.01", "Licensed under the PHP License."],
    "psf": ["Licensed under the Python Software Foundation License.", "SPDX-License-Identifier: PSF-2.0", "Distributed under the PSF license."],
    "mspl": ["Microsoft Public License", "This source is subject to the Microsoft Permissive License.", "SPDX-License-Identifier: MS-PL"],
    "odbl": ["Made available under the Open Database License.", "SPDX-License-Identifier: ODbL-1.0", "Data licensed under the ODbL."],
    "other": ["Licensed under the Frobnicate Terms.", "Use is subject to the Example Community License.", "Released under a custom license.", "See the license agreement for terms of use.", "Licensed under the terms of the vendor agreement."],
}
OTHER = ["The driver showed a license at the border.", "A fishing license costs ten dollars a year.", "She was granted permission to leave early.", "Copyright law protects authors.", "The restaurant lost its liquor license.", "Public opinion changed under the new version.", "The general said the public works were free.", "They released a statement under pressure.", "Apache helicopters flew over the town.", "MIT students built a robot.", "All visitors reserved seats; rights of way apply.", "The work is under way.", "Creative people share common spaces.", "Conditions of use are posted at the door.", "Version 2 of the plan is subject to approval.", "Permission slips are due; the license plate was found."]
#: Prose whose common words are also in the notices ("mit" is German for "with").
OTHER += ["Sie kam mit dem Zug und ging mit ihm nach Hause.", "Mit der Zeit wurde es besser, und er war mit allen zufrieden.", "Das Kind spielt mit einem Ball in der Sonne.", "Wir fahren mit euch, nicht mit den anderen.", "Der Mann mit dem Hut ist nicht von hier.", "Es ist schwer, mit so wenig auszukommen.", "Komm mit!", "Er sprach mit uns und mit ihr.", "Tee mit Milch.", "He was in and out of the house all day, and that is all.", "It is not the end of the world, and you may see it in time.", "The man with the dog came by, for a walk in the park.", "All of it was in the box, with a note on top.", "You are free to go at any time, or to stay.", "This is the way it was, and all that is left of it is in here.", "There is no one here, he said, and it is late.", "What is that?", "She is tired and he is not.", "And is he here?", "La casa es de la familia y no se vende a nadie.", "Le chat est sur la table et le chien est dans la cour, a dit la dame."]
#: More prose with words of notices.
OTHER += ["The public library opened under a new director.", "A source close to the family said so.", "The software company released a new version of its program in May.", "The code of conduct applies to all.", "He asked for permission and was granted a day off.", "The terms of the contract are fair.",
          "Attribution of the painting is disputed.", "Commercial use of the river began in the spring.", "Free of charge for children under six.", "All copies of the book were sold.", "The files are in the box under the desk.", "Her identifier was written on the form.", "Provided that it rains, the crops will grow.",
          "Without warranty, the radio was cheap.", "The material was soft and warm.", "The domain of the king was wide.", "The notice on the board was read by all.", "Written permission is required from parents.", "Version 3 of the song is the best.", "She reserved a table for the foundation.", "You can modify the recipe.", "Distribution of food was slow.",
          "His driving licence expired.", "They obtained a copy of the letter.", "The form was subject to review.", "The work was published in 2001.", "The general election is over.", "Use of the pool is free.", "The data are in the table."]
#: Common words of four languages. A term needs a word that is not among them.
COMMON = frozenset("""
a about after all also am an and any are as at be been before but by can could did do does for from had has have he her here him his how i if in into is it its last late like made many may me more most much my
new no not now of off on one only or other our out over s said same see shall she should so some such than that the their them then there these they this those time to two up us was way we were what when which
who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es euch fur haben hat hier ich ihm ihn ihr im in ist ja kann kein man mehr mein mich mit nach nicht
noch nun nur oder schon sehr sein seine sich sie sind so uber um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y
al como con cuando de del el ella en entre era es esta este fue ha hay la las le lo los mas me mi muy no nos o para pero por que se ser si sin su sus te todo un una y ya
""".split())
GAPS = "".join(chr(x) for x in range(256) if not re.match(r"[a-z0-9. ]", chr(x)))
UNKNOWN, NONE = "unknown", "none"
FAMILIES = [*TEMPLATES, UNKNOWN, NONE]
CONFIRMED, FOLDS, MARGIN = 0.6, 3, 5.0
LEADS = ("", "note: ", "this file: ", "copyright 2020 the authors. ", "unless stated otherwise, ")
TAILS = ("", " see the file for details.", " all contributions are welcome.", " thank you.")


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9.]+", text.lower().replace(". ", " ").rstrip(".")) if w]


def grams(text: str) -> set[str]:
    w = words(text)
    return {x for x in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) if not COMMON.issuperset(x.split(" "))}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _texts() -> list[tuple[str, str, int]]:
    """Text, family and fold. A notice stands in one fold with all its variants, a foreign licence with all its notices."""
    out = [(t, f, k % FOLDS) for f, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    out += [(t, UNKNOWN, k % FOLDS) for k, texts in enumerate(FOREIGN.values()) for t in texts]
    out += [(t, NONE, k % FOLDS) for k, t in enumerate(OTHER)]
    return [(lead + t + tail, f, k) for t, f, k in out for lead, tail in zip(LEADS + LEADS[:3], TAILS + TAILS, strict=True)]


def _fit(x: np.ndarray, y: np.ndarray, bias: np.ndarray, steps: int = 500, rate: float = 1.0, penalty: float = 3e-4) -> np.ndarray:
    """Weights by proximal gradient steps with momentum; families count alike, however many notices they have."""
    w = z = np.zeros((x.shape[1], y.shape[1]), np.float32)
    share = (y / np.maximum(y.sum(axis=0), 1)).sum(axis=1, keepdims=True).astype(np.float32) / y.shape[1]
    t = 1.0
    for _ in range(steps):
        step = z - rate * (x.T @ ((_softmax(x @ z + bias) - y) * share))
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / u * (new - w), new, u
    return w


@lru_cache
def model() -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Terms, their weights (a row for each), the families' biases, the temperature, and the probability that makes a family certain."""
    rows = _texts()
    found = [grams(t) for t, _, _ in rows]
    names = sorted(set().union(*found))
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, g in enumerate(found):
        x[i, [place[k] for k in g]] = 1
    kind = np.array([FAMILIES.index(f) for _, f, _ in rows])
    y = np.eye(len(FAMILIES), dtype=np.float32)[kind]
    fold = np.array([k for _, _, k in rows])
    bias = np.zeros(len(FAMILIES), np.float32)
    bias[-1] = MARGIN
    held = np.zeros_like(y)
    for k in range(FOLDS):
        held[fold == k] = x[fold == k] @ _fit(x[fold != k], y[fold != k], bias) + bias
    loss = {float(t): -np.log(np.maximum((_softmax(held / t) * y).sum(axis=1), 1e-12)).mean() for t in np.geomspace(0.125, 8, 49)}
    temperature = min(loss, key=loss.get)
    odds = _softmax(held / temperature)
    best, foreign = odds.argmax(axis=1), kind == FAMILIES.index(UNKNOWN)
    known = kind < len(TEMPLATES)

    def right(cut: float) -> float:
        sure = odds.max(axis=1) >= cut
        return (sure & (best == kind))[known].mean() + (~sure | (best == FAMILIES.index(UNKNOWN)))[foreign].mean()

    certain = max((float(c) for c in np.linspace(0.2, 0.95, 76)), key=right)
    w = _fit(x, y, bias)
    used = np.abs(w).max(axis=1) > 0
    return [n for n, u in zip(names, used, strict=True) if u], w[used].astype(np.float64).round(6), bias.astype(np.float64), float(temperature), certain


@lru_cache
def gate() -> list[str]:
    """Words of which a text needs one to be anything but `none`. Terms are light from the smallest gain on, as long as all light ones
    together give no family more than `none` has ahead; the others each give a word, the one that most of them share."""
    names, weights, bias, _, _ = model()
    gain = np.maximum(weights[:, :-1] - weights[:, -1:], 0)
    room = bias[-1] - bias[:-1] - 1e-6
    total, heavy = np.zeros(len(room)), []
    for i in np.argsort(gain.max(axis=1), kind="stable"):
        if (total + gain[i] < room).all():
            total = total + gain[i]
        else:
            heavy.append(names[i])
    out: set[str] = {n for n in heavy if " " not in n}
    pairs = [n.split(" ") for n in heavy if " " in n]
    while pairs := [p for p in pairs if not out.intersection(p)]:
        uses = [w for p in pairs for w in p if w not in COMMON]
        out.add(max(sorted(set(uses)), key=uses.count))
    return sorted(out)


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(line: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(line), r"\.(?= )", ""), r"\.+$", "")
    parted = F.translate(F.decode(text.cast("binary"), "ISO-8859-1"), GAPS, " " * len(GAPS))  # by byte: quicker than a pattern
    return F.filter(F.split(parted, " "), lambda w: w != "")


def classify_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and lines: an array of (line, text, family, probability, confirmed) for the lines and paragraphs whose family isn't none."""
    names, weights, bias, temperature, certain = model()
    docs = C.id_and_text(docs, id_col, text_col)
    book = _constant([w.tolist() for w in weights], "array<array<double>>")
    start = F.array(*[F.lit(float(v)) for v in bias])
    families = F.array(*[F.lit(f) for f in FAMILIES])
    templates = _constant([{"family": f, "words": sorted(set(words(t)))} for f, texts in TEMPLATES.items() for t in texts], "array<struct<family: string, words: array<string>>>")
    terms = F.array(*[F.lit(n) for n in names])
    # any word of the gate, as a word or before a full stop
    head = r"(?<![a-z0-9.])(?:" + "|".join(re.escape(w) for w in gate()) + r")(?![a-z0-9])"

    def known(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_intersect(F.concat(words, pairs), terms)

    def scores(own: Column) -> Column:
        return F.aggregate(own, start, lambda acc, t: F.zip_with(acc, F.get(book, F.array_position(terms, t).cast("int") - 1), lambda a, b: a + b))

    def judged(x: Column) -> Column:
        odds = F.transform(x["scores"], lambda s: F.exp((s - F.array_max(x["scores"])) / temperature))
        best = F.array_max(odds)
        return F.struct(x["line"].alias("line"), x["end"].alias("end"), x["text"].alias("text"), x["words"].alias("words"), F.get(families, F.array_position(odds, best).cast("int") - 1).alias("best"), (best / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)).alias("probability"))

    def confirmed(x: Column) -> Column:
        own = F.filter(templates, lambda t: t["family"] == x["best"])
        share = F.transform(own, lambda t: F.size(F.array_intersect(t["words"], x["words"])) / F.greatest(F.least(F.size(x["words"]), F.size(t["words"])), F.lit(1)))
        return F.coalesce(F.array_max(share), F.lit(0.0)) >= CONFIRMED

    docs = docs.select("doc_id", F.when(F.lower("text").rlike(head), F.split("text", "\n")).alias("all"))
    possible = F.filter(F.transform("all", lambda t, i: F.when(F.lower(t).rlike(head), i)), lambda i: i.isNotNull())
    docs = docs.select("doc_id", "all", possible.alias("at"))
    # paragraphs of several lines: from after one blank line to before the next
    blank = F.filter(F.transform("all", lambda t, i: F.when(t.rlike(r"^\s*$"), i)), lambda i: i.isNotNull())
    docs = docs.select("doc_id", "all", "at", F.when(F.size("at") > 0, blank).alias("blank"))
    ends, starts = F.concat("blank", F.array(F.size("all"))), F.concat(F.array(F.lit(0)), F.transform("blank", lambda i: i + 1))
    blocks = F.transform(F.zip_with(starts, ends, lambda a, e: F.struct(a.alias("a"), e.alias("e"))), lambda x: F.struct(x["a"].alias("a"), x["e"].alias("e"), F.filter("at", lambda i: (i >= x["a"]) & (i < x["e"])).alias("in")))
    docs = docs.select("doc_id", "all", "at", F.coalesce(F.filter(blocks, lambda x: (F.size(x["in"]) > 0) & (x["e"] - x["a"] > 1)), F.array()).alias("blocks"))
    single = F.transform("at", lambda i: F.struct(i.cast("long").alias("line"), F.lit(0).cast("long").alias("end"), F.get("all", i).alias("text"), _words(F.get("all", i)).alias("words")))
    whole = F.transform("blocks", lambda x: F.struct(x["a"].cast("long").alias("line"), x["e"].cast("long").alias("end"), F.array_join(F.slice("all", x["a"] + 1, x["e"] - x["a"]), "\n").alias("text"), F.flatten(F.transform(F.slice("all", x["a"] + 1, x["e"] - x["a"]), _words)).alias("words")))
    out = docs.select("doc_id", F.concat(single, whole).alias("l"))
    out = out.select("doc_id", F.transform("l", lambda x: F.struct(x["line"].alias("line"), x["end"].alias("end"), x["text"].alias("text"), F.array_distinct(x["words"]).alias("words"), known(x["words"]).alias("grams"))).alias("l"))
    out = out.select("doc_id", F.transform("l", lambda x: F.struct(x["line"].alias("line"), x["end"].alias("end"), x["text"].alias("text"), x["words"].alias("words"), scores(x["grams"]).alias("scores"))).alias("l"))
    out = out.select("doc_id", F.filter("l", lambda x: F.array_position(x["scores"], F.array_max(x["scores"])) < len(FAMILIES)).alias("l"))
    out = out.select("doc_id", F.transform("l", judged).alias("l"))
    done = F.transform("l", lambda x: F.struct(x["line"].alias("line"), x["end"].alias("end"), x["text"].alias("text"), F.when(x["probability"] >= certain, x["best"]).otherwise(UNKNOWN).alias("family"), x["probability"].alias("probability"), ((x["probability"] >= certain) & confirmed(x)).alias("confirmed")))
    out = out.select("doc_id", done.alias("l"))
    # a paragraph adds what none of its lines says as surely
    new = F.filter("l", lambda x: (x["end"] == 0) | ~F.exists("l", lambda y: (y["end"] == 0) & (y["line"] >= x["line"]) & (y["line"] < x["end"]) & (y["family"] == x["family"]) & (y["probability"] >= x["probability"])))
    done = F.transform(new, lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), x["family"].alias("family"), x["probability"].alias("probability"), x["confirmed"].alias("confirmed")))
    empty = F.from_json(F.lit("[]"), "array<struct<line: bigint, text: string, family: string, probability: double, confirmed: boolean>>")
    return out.select("doc_id", F.coalesce(done, empty).alias("lines"))


def op5_licences(spark, sf_dir: str) -> DataFrame:
    found = classify_lines(C.read(spark, sf_dir, "documents"))
    kinds = F.transform("lines", lambda x: x["family"])
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("families"), F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"), F.size(F.filter("lines", lambda x: x["family"] == "unknown")).cast("long").alias("n_unknown"),
    )
