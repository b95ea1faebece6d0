"""License scans by ordered signature rules.

A text is reduced to its lower-case words, one space apart. Rules are regular expressions
over that form, ordered by priority; two keywords gate each rule, so a text without license
vocabulary costs a few substring searches and a rule's expression runs only where both of its
keywords occur. Overlapping detections are resolved by priority and containment. Everything is
a column expression over one row: no shuffle, no Python, whole texts.

Null and empty texts have no words and no labels, and score 0.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything but digits, letters and non-ASCII characters parts words.
PARTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
MARK = "\x01"
#: Words of the longest match of any rule, at most.
LONGEST = 24

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Family: (keyword, label stem, names as word patterns, versions). No versions: the stem is the label.
FAMILIES = (
    ("mit", "mit", ("mit", "mit x11", "mit expat"), ()),
    ("expat", "mit", ("expat",), ()),
    ("apache", "apache", ("apache", "apache software"), ("1 0", "1 1", "2", "2 0")),
    ("bsd", "bsd-2", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"), ()),
    ("bsd", "bsd-3", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"), ()),
    ("bsd", "bsd-4", ("bsd 4 clause", "4 clause bsd", "original bsd"), ()),
    ("bsd", "bsd", ("bsd",), ()),
    ("lesser", "lgpl", ("gnu lesser general public", "lesser general public"), ("2", "2 1", "3", "3 0")),
    ("library", "lgpl", ("gnu library general public", "library general public"), ("2", "2 0")),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl"), ("2", "2 1", "3", "3 0")),
    ("affero", "agpl", ("gnu affero general public", "affero general public"), ("1", "3", "3 0")),
    ("agpl", "agpl", ("agpl", "gnu agpl"), ("1", "3", "3 0")),
    ("general public", "gpl", ("gnu general public", "general public"), ("1", "2", "2 0", "3", "3 0")),
    ("gpl", "gpl", ("gpl", "gnu gpl"), ("1", "2", "2 0", "3", "3 0")),
    ("free documentation", "gfdl", ("gnu free documentation", "free documentation"), ("1 1", "1 2", "1 3")),
    ("mozilla", "mpl", ("mozilla public",), ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", ("mpl",), ("1 0", "1 1", "2 0")),
    ("eclipse", "epl", ("eclipse public",), ("1 0", "2 0")),
    ("common development", "cddl", ("common development and distribution",), ("1 0", "1 1")),
    ("european union", "eupl", ("european union public",), ("1 0", "1 1", "1 2")),
    ("academic", "afl", ("academic free",), ("2 0", "2 1", "3 0")),
    ("open software", "osl", ("open software",), ("1 0", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", ("artistic",), ("1 0", "2 0")),
    ("boost", "boost", ("boost software", "boost"), ("1 0",)),
    ("microsoft", "ms-pl", ("microsoft public",), ()),
    ("microsoft", "ms-rl", ("microsoft reciprocal",), ()),
    ("python", "python", ("python software foundation", "python"), ("2", "2 0")),
    ("php", "php", ("php",), ("3 0", "3 01")),
    ("zlib", "zlib", ("zlib", "zlib libpng"), ()),
    ("isc", "isc", ("isc",), ()),
    ("openssl", "openssl", ("openssl",), ()),
    ("open font", "ofl", ("sil open font", "open font"), ("1 0", "1 1")),
    ("open database", "odbl", ("open database",), ("1 0",)),
    ("open government", "ogl", ("open government",), ("1 0", "2 0", "3 0")),
)
#: Creative Commons: label and the words of its elements, short and long.
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution sharealike"),
    ("cc-by-nd", "by nd", "attribution noderivatives"),
    ("cc-by-nc", "by nc", "attribution noncommercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Phrases of their own: keyword, label, pattern, priority.
PHRASES = (
    ("copyright", "mit", "permission is hereby granted free of charge to any person obtaining a copy", 85),
    ("permission", "mit", "permission is hereby granted free of charge to any person obtaining a copy", 85),
    ("permission", "isc", "permission to use copy modify and or distribute this software for any purpose", 85),
    ("redistribution", "bsd", "redistribution and use in source and binary forms with or without modification", 70),
    ("unlicense", "unlicense", "the unlicense", 80),
    ("public domain", "public-domain", "(?:is |are |into |in )?(?:the )?public domain", 50),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 80),
    ("creative commons", "cc0", "creative commons zero(?: 1 0)?", 80),
    ("wtfpl", "wtfpl", "wtfpl", 80),
    ("beerware", "beerware", "beerware", 60),
    ("all rights reserved", "all-rights-reserved", "all rights reserved", 20),
    ("confidential", "proprietary", "proprietary and confidential", 30),
)
#: Clauses and headers of license texts, as they stand in them: label, priority, keyword (a part that no match lacks), pattern.
CLAUSES = (
    ("mit", 84, "permission notice shall be included", "(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 55, "software is provided as is without warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("x11", 86, "otherwise to promote the sale", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("ncsa", 86, "deal with the software", "(?:to )?deal with the software without restriction"),
    ("json", 88, "software shall be used for good", "the software shall be used for good not evil"),
    ("isc", 84, "author disclaims all warranties", "the software is provided as is and the author disclaims all warranties"),
    ("hpnd", 84, "documentation for any purpose and without fee", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee"),
    ("postgresql", 86, "without a written agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", 72, "redistributions of source code", "redistributions of source code must retain the above copyright notice(?: this list of conditions)?"),
    ("bsd", 72, "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice(?: this list of conditions)?"),
    ("bsd", 60, "any express or implied warranties", "this software is provided by the (?:copyright holders|regents|authors?)(?: and contributors)? as is and any express or implied warranties"),
    ("bsd-3", 78, "may be used to endorse or promote products", "neither the names? of (?:the )?(?:[^ ]+ ){1,5}nor the names of (?:its )?contributors may be used to endorse or promote products"),
    ("bsd-4", 80, "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", 82, "except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2", 82, "distributed under the license is distributed on an as is basis", "(?:unless required by applicable law or agreed to in writing )?software distributed under the license is distributed on an as is basis"),
    ("apache-2", 86, "apache org licenses license 2 0", "(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2", 84, "each contributor hereby grants to you a perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright license|patent license|except as stated)"),
    ("apache", 76, "software developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", 64, "free software you can redistribute it", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", 88, "either version 2 of the license", "either version 2 of the license or at your option any later version"),
    ("gpl-3", 88, "either version 3 of the license", "either version 3 of the license or at your option any later version"),
    ("gpl", 62, "distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 74, "copy of the gnu general public license along with", "you should have received a copy of the gnu general public license along with this (?:program|software|file)"),
    ("gpl", 74, "does not permit incorporating your program into proprietary", "(?:the gnu general public license )?does not permit incorporating your program into proprietary programs"),
    ("gpl", 66, "verbatim copies of this license document", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", 70, "this library is free software you can redistribute it", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", 89, "either version 2 1 of the license", "either version 2 1 of the license or at your option any later version"),
    ("lgpl", 76, "copy of the gnu lesser general public license along with", "you should have received a copy of the gnu lesser general public license along with this (?:program|library|software)"),
    ("agpl", 76, "copy of the gnu affero general public license along with", "you should have received a copy of the gnu affero general public license along with this (?:program|software)"),
    ("agpl-3", 86, "interacting with it remotely through a computer network", "(?:offer )?all users interacting with it remotely through a computer network"),
    ("gfdl", 76, "modify this document under the terms of the gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 72, "no front cover texts", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", 78, "subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2", 84, "if a copy of the mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 84, "subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", 84, "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", 78, "made available under the terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-2", 84, "following secondary licenses", "this source code may also be made available under the following secondary licenses"),
    ("cddl", 78, "terms of the common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", 74, "under the eupl", "licensed under the eupl"),
    ("boost-1", 84, "person or organization obtaining a copy", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1", 84, "boost org license 1 0 txt", "(?:https? )?(?:www )?boost org license 1 0 txt"),
    ("zlib", 78, "authors be held liable for any damages arising from the use of this software", "in no event (?:will|shall) the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 80, "use this software for any purpose including commercial applications", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", 82, "altered source versions must be plainly marked", "altered source versions must be plainly marked as such"),
    ("zlib", 82, "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented"),
    ("unlicense", 86, "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 82, "publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 82, "do what the fuck you want to", "do what the fuck you want to(?: public license)?"),
    ("cc0", 84, "has dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", 84, "waived all copyright and related or neighboring rights", "has waived all copyright and related or neighboring rights"),
    ("cc0", 88, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", 86, "creativecommons org publicdomain mark", "creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-by", 86, "creativecommons org licenses by", "creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", 88, "creativecommons org licenses by sa", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nd", 88, "creativecommons org licenses by nd", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc", 88, "creativecommons org licenses by nc", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", 89, "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", 89, "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("artistic-1", 80, "conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("ofl-1.1", 86, "licensed under the sil open font license version 1 1", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 82, "font software may use the reserved font name", "no modified version of the font software may use the reserved font names?"),
    ("python-2", 84, "psf hereby grants licensee", "(?:subject to the terms and conditions of this license agreement )?psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", 80, "this product includes php software", "this product includes php software(?: freely available from)?"),
    ("openssl", 84, "software developed by the openssl project", "(?:this product includes )?software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 82, "cryptographic software written by eric young", "this product includes cryptographic software written by eric young"),
    ("ms-pl", 82, "patent claim against any contributor over patents", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("beerware", 78, "buy me a beer in return", "you can buy me a beer in return"),
    ("ruby", 78, "verbatim copies of the source form of the software", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("vim", 78, "vim is charityware", "vim is charityware"),
    ("lppl", 82, "conditions of the latex project public license", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("odbl", 80, "made available under the open database license", "is made available under the open database license"),
    ("odbl", 76, "database contents license", "any rights in individual contents of the database are licensed under the database contents license"),
    ("ogl", 80, "public sector information licensed under the open government licen", "contains public sector information licensed under the open government licen[cs]e"),
    ("sspl", 82, "server side public license", "server side public license(?: version 1)?"),
    ("busl", 82, "business source license", "business source license(?: version)?(?: 1 1)?"),
    ("elastic", 80, "elastic license", "elastic license(?: version)?(?: 2(?: 0)?)?"),
    ("commons-clause", 82, "commons clause", "commons clause(?: license condition)?"),
    ("polyform-noncommercial", 82, "polyform noncommercial", "polyform noncommercial(?: license)?"),
    ("polyform-small-business", 82, "polyform small business", "polyform small business(?: license)?"),
    ("llama", 82, "community license", "(?:meta )?llama [234](?: [123])? community license(?: agreement)?"),
    ("openrail", 82, "openrail", "(?:bigscience |bigcode |creativeml )?openrail(?: m)?(?: license)?"),
    ("openrail", 82, "open rail", "(?:bigscience |creativeml )open rail(?: m)?(?: license)?"),
    ("blueoak", 80, "blue oak model license", "blue oak model license(?: 1 0 0)?"),
    ("mulan-psl", 80, "mulan permissive software license", "mulan permissive software license(?: v(?:ersion )?2)?"),
    ("w3c", 78, "w3c software", "w3c software (?:notice and )?(?:document )?license"),
    ("cpl", 74, "common public license", "common public license(?: (?:version )?1 0)?"),
    ("ipl", 76, "ibm public license", "ibm public license(?: (?:version )?1 0)?"),
    ("npl", 76, "netscape public license", "netscape public license(?: (?:version )?1 [01])?"),
    ("spl", 76, "sun public license", "sun public license(?: (?:version )?1 0)?"),
    ("qpl", 76, "q public license", "(?:the )?q public license(?: (?:version )?1 0)?"),
    ("sleepycat", 76, "sleepycat license", "(?:the )?sleepycat license"),
    ("nasa", 76, "nasa open source agreement", "nasa open source agreement(?: (?:version )?1 3)?"),
    ("upl", 76, "universal permissive license", "universal permissive license(?: (?:version )?1 0)?"),
    ("unicode", 76, "unicode license agreement", "unicode license agreement(?: data files and software)?"),
    ("cern-ohl", 76, "cern open hardware licen", "cern open hardware licen[cs]e(?: version [12](?: 2)?)?"),
    ("solderpad", 76, "solderpad hardware licen", "solderpad hardware licen[cs]e"),
    ("hippocratic", 76, "hippocratic license", "(?:the )?hippocratic license(?: (?:version )?[23] [01])?"),
    ("free-art", 76, "free art license", "free art license(?: 1 [23])?"),
    ("opl", 74, "open publication license", "open publication license(?: v?1 0)?"),
    ("proprietary", 45, "via any medium is strictly prohibited", "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", 35, "for internal use only", "for internal use only"),
    ("proprietary", 40, "trade secret", "(?:contains|constitutes) (?:valuable |confidential )?(?:proprietary information and )?trade secrets? of"),
    ("proprietary", 38, "may not be disclosed to third parties", "may not be disclosed to third parties without (?:the )?(?:prior )?written (?:consent|permission)"),
    ("all-rights-reserved", 40, "may be reproduced", "no part of this (?:publication|document|book|work|website) may be reproduced"),
    ("all-rights-reserved", 36, "in any form or by any means", "(?:reproduced|transmitted|distributed) in any form or by any means(?: electronic or mechanical)?"),
)
#: One of these is part of every keyword of a clause: a text without any of them is not looked at for clauses.
CLAUSE_GATES = ("licen", "software", "permission", "copy", "public", "commons", "redistributions", "warrant", "version", "without", "promote", "advertising", "incorporating", "interacting", "cover", "mpl", "contributor", "eupl", "boost", "want", "dedicated", "package", "font", "beer", "charity", "polyform", "openrail", "open rail", "medium", "internal", "secret", "disclosed", "reproduced", "means", "useful", "agreement")
#: Ways to name a license: the words before it, priority gained.
GRANTS = (
    ("(?:licensed|relicensed|dual licensed) under (?:the )?(?:terms of )?(?:the )?", 20),
    ("(?:released|published|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?", 20),
    ("(?:covered|governed) by (?:the )?(?:terms of )?(?:the )?", 15),
    ("(?:terms|conditions) of (?:the )?", 10),
    ("", 0),
)


@dataclass(frozen=True)
class Rule:
    """Signature: ``pattern`` is tried where both keywords occur, words that a match needs unless a rule of the same pattern tries it too. Larger priority wins."""

    gate: str
    keyword: str
    label: str
    pattern: str
    priority: int
    base: bool = False


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority, highest first."""
    out = [Rule("licen" if "license" in phrase else "cc by", phrase, label, phrase, 90, True) for phrase, label in BASE.items()]
    for keyword, stem, names, versions in FAMILIES:
        for name in names:
            for lead, gain in GRANTS:
                gate = "licen" if "licensed" in lead else name
                out.append(Rule("licen", keyword, stem, f"{lead}{name} licen[cs]es?", 40 + gain))
                for version in versions:
                    label = f"{stem}-{version.removesuffix(' 0').replace(' ', '.')}"
                    out.append(Rule(gate, keyword, label, f"{lead}{name} (?:licen[cs]e )?(?:version |v)?{version}(?: or (?:any )?later)?", 60 + gain))
    for label, short, long in COMMONS:
        for lead, gain in GRANTS[:2] + GRANTS[-1:]:
            out.append(Rule("creative commons", "attribution", label, f"{lead}creative commons {long}(?: (?:{'|'.join(COMMONS_VERSIONS)}))?(?: (?:international|unported|generic))?", 60 + gain + len(short)))
            out.append(Rule("cc by", f"cc {short}", label, f"{lead}cc {short}(?: (?:{'|'.join(COMMONS_VERSIONS)}))?", 60 + gain + len(short)))
    out += [Rule(keyword, keyword, label, pattern, priority) for keyword, label, pattern, priority in PHRASES]
    out += [Rule(next(g for g in CLAUSE_GATES if g in keyword), keyword, label, pattern, priority) for label, priority, keyword, pattern in CLAUSES]
    ids = {label.split(" ")[0] for _, label, _, versions in FAMILIES if not versions} | {f"{stem}-{v.removesuffix(' 0').replace(' ', '.')}" for _, stem, _, versions in FAMILIES for v in versions}
    out += [Rule("spdx", "spdx license identifier", label, f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}(?: 0)?", 95) for label in sorted(ids)]
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern)))


def words_form(text: Column) -> Column:
    """The text's lower-case words with one space before, between and after them; one space if it has none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PARTS, " ")), F.lit(" ")), " {2,}", " ")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _found(form: Column, rule: Column) -> Column:
    """Detections of one rule: start and end word, in order."""
    pattern = F.concat(F.lit("(?<= )"), rule["pattern"], F.lit("(?= )"))

    def place(matches: Column) -> Column:
        marked = F.split(F.regexp_replace(form, pattern, F.lit(MARK + "$0")), F.lit(" "))
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(MARK), i - 1)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.transform(matches, lambda m, k: F.struct(F.get(at, k).alias("start"), (F.get(at, k) + F.size(F.split(m, F.lit(" ")))).alias("end"), rule["rank"].alias("rank"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["base"].alias("base"))))

    matches = F.regexp_extract_all(form, pattern, F.lit(0))
    return _let(matches, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(DETECTIONS)))


RULES = "array<struct<rank:int,gate:string,keyword:string,label:string,pattern:string,priority:int,base:boolean>>"


@cache
def rules_json() -> str:
    """All rules as one literal, which the optimizer parses once: building a literal for each field takes seconds."""
    return json.dumps([{"rank": k} | asdict(r) for k, r in enumerate(rules())])


DETECTIONS = "array<struct<start:int,end:int,rank:int,priority:int,label:string,base:boolean>>"


def _beats(a: Column, b: Column) -> Column:
    """Whether detection ``a`` suppresses ``b``: overlap and a higher priority, or containment and an earlier rule."""
    overlap = (a["start"] < b["end"]) & (b["start"] < a["end"])
    inside = (a["start"] <= b["start"]) & (b["end"] <= a["end"])
    return (overlap & (a["priority"] > b["priority"])) | (inside & (a["priority"] == b["priority"]) & (a["rank"] < b["rank"]))


def _resolved(found: Column, n_rules: Column) -> Column:
    """Base detections and those that no other one suppresses.

    Detections are sorted by start. Each of ``n_rules`` rules starts at most once at a word, and
    no match is longer than LONGEST words, so only so many neighbours can overlap.
    """
    reach = n_rules * LONGEST

    def survives(d: Column, k: Column, every: Column) -> Column:
        first = F.greatest(k - reach, F.lit(0))
        return d["base"] | ~F.exists(F.slice(every, first + 1, 2 * reach), lambda e: _beats(e, d))

    return _let(F.array_sort(found), lambda every: F.filter(every, lambda d, k: survives(d, k, every)))


def scan(docs: DataFrame, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_words, and ``detections`` (start and end word, rank, priority, label, base) after suppression.

    Rows are independent: repeated rows repeat, null ids pass, an empty table gives no rows, and columns not in ``keep`` are
    dropped. A text of any length is one row's work, in time proportional to its length and its detections.
    """
    table = F.from_json(F.lit(rules_json()), RULES)
    gates = sorted({r.gate for r in rules()})
    form = F.col("__form")
    gated = form.contains(gates[0])
    for gate in gates[1:]:
        gated = gated | form.contains(gate)
    tried = F.filter(table, lambda r: F.contains(form, r["gate"]) & F.contains(form, r["keyword"]))
    found = F.when(gated, _let(tried, lambda t: _resolved(F.flatten(F.transform(t, lambda r: _found(form, r))), F.size(t)))).otherwise(F.array().cast(DETECTIONS))
    staged = docs.select(*keep, words_form(F.col(text_column)).alias("__form"))
    return staged.select(*keep, (F.length("__form") - F.length(F.replace("__form", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"), found.alias("detections"))


def labels_of(detections: Column) -> Column:
    """Distinct labels, sorted and joined by commas; empty if there are none."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def score_of(detections: Column) -> Column:
    """The priority of the best detection as a share of 100; 0 without any."""
    return F.coalesce(F.array_max(F.transform(detections, lambda d: d["priority"])), F.lit(0)) / F.lit(100.0)
