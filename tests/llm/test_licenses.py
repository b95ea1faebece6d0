import random
import re
import time

from quarrylight.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SNIPPETS = ["Released under the MIT License.", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by nc cc by nc", "GNU General Public License, version 3 or later", "All rights reserved.", "SPDX-License-Identifier: Apache-2.0", "in the public domain", "BSD-3-Clause license", "CC-BY-NC-SA 4.0", "licence", "wort mit licht", "émit license"]


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(words):
    return sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def brute_labels(words):
    form = f" {' '.join(words)} "
    found = []
    for rank, r in enumerate(licenses.rules()):
        if r.gate in form and r.keyword in form:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", form):
                start = form[: m.start()].count(" ") - 1
                found.append((start, start + len(m[0].split(" ")), r.priority, rank, r.label, r.base))

    def beaten(b):
        return any((a[0] < b[1] and b[0] < a[1] and a[2] > b[2]) or (a[0] <= b[0] and b[1] <= a[1] and a[2] == b[2] and a[3] < b[3]) for a in found)

    kept = [d for d in found if d[5] or not beaten(d)]
    return ",".join(sorted({d[4] for d in kept})), max([d[2] for d in kept], default=0) / 100


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice([*SNIPPETS, "word", "Mit", "x_y"]) for _ in range(n))) for k, n in enumerate([0, 1, 1, 2, 3, 5, 8, 13, 30, 60])]
    rows += [(50 + k, s) for k, s in enumerate(SNIPPETS)] + [(90, None), (91, ""), (1, rows[1][1]), (None, "cc by nc"), (92, "Kelvin İ CC-BY-NC")]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words int")
    got = licenses.scan(frame).withColumn("labels", licenses.labels_of(licenses.F.col("detections"))).withColumn("score", licenses.score_of(licenses.F.col("detections"))).collect()
    for (i, text), r in zip(rows, got):
        words = words_of(text)
        assert (r.doc_id, r.n_words) == (i, len(words))
        assert sorted((d.start, d.label) for d in r.detections if d.base) == base_places(words)
        assert (r.labels, r.score) == brute_labels(words), text
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_are_ordered_and_stay_within_the_longest_match():
    rules = licenses.rules()
    assert len(rules) > 300
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    for r in rules:
        assert len(re.sub(r"\(\?:|\)|\?", "", r.pattern).split(" ")) <= licenses.LONGEST


def test_gates_lose_no_match_of_any_rule(spark):
    rnd = random.Random(8)

    def example(pattern):
        pattern = pattern.replace("(?:[^ ]+ ){1,5}", "some owner ")
        text = re.sub(r"\(\?:((?:[^()]|\([^()]*\))*)\)\?", lambda m: f"(?:{m[1]})" if rnd.random() < 0.5 else "", pattern)
        while "(?:" in text:
            text = re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: "" if m[2] and rnd.random() < 0.5 else rnd.choice(m[1].split("|")), text)
        text = re.sub(r"\[([a-z0-9-]+)\]", lambda m: rnd.choice(m[1].replace("-", "")), text)
        return re.sub(r"(\w)\?", lambda m: rnd.choice([m[1], ""]), text.replace("(?:", "").replace(")", ""))

    every = licenses.rules()
    texts = ["released under GPL v3 or later", "distributed under Apache 2.0", *(example(r.pattern) for r in every)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(frame).withColumn("labels", licenses.labels_of(licenses.F.col("detections"))).withColumn("score", licenses.score_of(licenses.F.col("detections"))).collect()
    compiled = [(k, r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for k, r in enumerate(every)]
    n_hits = 0
    for text, row in zip(texts, got):
        form = f" {' '.join(words_of(text))} "
        found = []
        for k, r, pattern in compiled:
            for m in pattern.finditer(form):
                start = form[: m.start()].count(" ") - 1
                found.append((start, start + len(m[0].split(" ")), r.priority, k, r.label, r.base))
        kept = [b for b in found if b[5] or not any((a[0] < b[1] and b[0] < a[1] and a[2] > b[2]) or (a[0] <= b[0] and b[1] <= a[1] and a[2] == b[2] and a[3] < b[3]) for a in found)]
        n_hits += bool(kept)
        assert (row.labels, row.score) == (",".join(sorted({d[4] for d in kept})), max([d[2] for d in kept], default=0) / 100), text
    assert n_hits == len(texts)
    assert [(r.labels, r.score) for r in got[:2]] == [("gpl-3", 0.8), ("apache-2", 0.8)]


#: Pieces of license texts as people write them, with the labels that a reader would give them.
TEXTS = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED', "mit"),
    ("Released under the MIT License.", "mit"),
    ("The Software shall be used for Good, not Evil.", "json"),
    ("shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software", "x11"),
    ("to deal with the Software without restriction, including without limitation", "ncsa"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES', "isc"),
    ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "postgresql"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived", "bsd-3"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4"),
    ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES', "bsd"),
    ("you may not use this file except in compliance with the License.", "apache-2"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS', "apache-2"),
    ("This product includes software developed by the Apache Software Foundation", "apache"),
    ("either version 2 of the License, or (at your option) any later version.", "gpl-2"),
    ("either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    ("either version 2.1 of the License, or (at your option) any later version.", "lgpl-2.1"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "gpl"),
    ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gpl"),
    ("an opportunity to receive the source for all users interacting with it remotely through a computer network", "agpl-3"),
    ("with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.", "gfdl"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org", "mpl-2"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1", "mpl-1.1"),
    ("This Source Code may also be made available under the following Secondary Licenses", "epl-2"),
    ("Licensed under the EUPL", "eupl"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "boost-1"),
    ("copy at https://www.boost.org/LICENSE_1_0.txt)", "boost-1"),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("Altered source versions must be plainly marked as such", "zlib"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense"),
    ("Everyone may DO WHAT THE FUCK YOU WANT TO.", "wtfpl"),
    ("The person who associated a work with this deed has dedicated the work to the public domain", "cc0"),
    ("http://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
    ("https://creativecommons.org/licenses/by/4.0/", "cc-by"),
    ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa"),
    ("see creativecommons.org/licenses/by-nc-sa/4.0 for terms", "cc-by-nc-sa"),
    ("The intent of this document is to state the conditions under which a Package may be copied", "artistic-1"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"),
    ("PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce", "python-2"),
    ("This product includes PHP software, freely available from", "php"),
    ("software developed by the OpenSSL Project for use in the OpenSSL Toolkit", "openssl"),
    ("you can buy me a beer in return", "beerware"),
    ("Vim is Charityware.", "vim"),
    ("This work may be distributed and/or modified under the conditions of the LaTeX Project Public License", "lppl"),
    ("Contains public sector information licensed under the Open Government Licence", "ogl"),
    ("Use is governed by the Business Source License 1.1", "busl"),
    ("under the Server Side Public License, version 1", "sspl"),
    ("Llama 3 Community License Agreement", "llama"),
    ("the BigScience OpenRAIL-M license applies", "openrail"),
    ("PolyForm Noncommercial License", "polyform-noncommercial"),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"),
    ("No part of this book may be reproduced", "all-rights-reserved"),
    ("No rights are mentioned in this sentence about copies and software.", ""),
    ("The committee permitted a public version without further agreement.", ""),
    ("Her license to drive a package van was renewed; the copy is in the file.", ""),
]


def test_texts_get_the_labels_that_a_reader_gives_them(spark):
    assert len(TEXTS) >= 55 and len(licenses.CLAUSES) > 100
    got = licenses.scan(spark.createDataFrame(list(enumerate(t for t, _ in TEXTS)), "doc_id long, text string")).select("doc_id", licenses.labels_of(licenses.F.col("detections")).alias("labels"))
    wrong = [(TEXTS[r.doc_id], r.labels) for r in got.collect() if r.labels != TEXTS[r.doc_id][1]]
    assert not wrong


def test_the_plan_is_built_in_little_time(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    licenses.scan(frame)
    began = time.time()
    licenses.scan(frame)
    assert time.time() - began < 1.5


def test_a_very_long_text(spark):
    text = "word " * 100_000 + "Released under the MIT License. " + "wort " * 100_000
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 200_005 and [(d.start, d.label) for d in row.detections if d.base] == [(100_001, "mit")]
