"""Licence scans by ordered signature rules.

A rule is a regex over the normalised words of a text, a keyword that must occur
before the regex is tried, a label and a priority. Signatures of licence texts,
headers and notices are written one by one; grants are wordings (how a licence is
granted) times licences (how it is named). Where detections overlap, one that lies within another
of higher priority, or within a longer one of the same priority, is suppressed.
The scan is one projection: no shuffle, no Python.

Normalised text: A-Z lowered, every run of other ASCII characters than letters
and digits taken as a separator, each word written with a space on either side.
A match's first word is then half the number of spaces before it.

Edge cases: a null text is empty and has no detections; repeated rows are scanned
alike; other columns pass through; input columns that clash with an output name
are replaced in the output.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.llm.common import let, read

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label: how the licence is named, in words; alternatives are parted by a bar, and a word in brackets may be left out.
NAMES = {
    "mit": "mit|expat|x11",
    "apache-1.1": "apache [software] license [version] 1 1",
    "apache-2.0": "apache [software] license [version] 2 0|apache 2 0",
    "apache": "apache [software] license",
    "gpl-2": "gnu general public license [version] 2|general public license [version] 2|gnu gpl [version] 2|gpl 2|gplv2",
    "gpl-3": "gnu general public license [version] 3|general public license [version] 3|gnu gpl [version] 3|gpl 3|gplv3",
    "gpl": "gnu general public license|gnu gpl|general public license",
    "lgpl-2.1": "gnu lesser general public license [version] 2 1|lgpl 2 1|lgplv2 1",
    "lgpl-3": "gnu lesser general public license [version] 3|lgpl 3|lgplv3",
    "lgpl": "gnu lesser general public license|gnu library general public license|lgpl",
    "agpl-3": "gnu affero general public license [version] 3|agpl 3|agplv3",
    "agpl": "gnu affero general public license|agpl",
    "fdl": "gnu free documentation license|gfdl",
    "bsd-2-clause": "bsd 2 clause|simplified bsd|freebsd",
    "bsd-3-clause": "bsd 3 clause|new bsd|modified bsd",
    "bsd-4-clause": "bsd 4 clause|original bsd",
    "bsd": "bsd",
    "isc": "isc|internet systems consortium",
    "mpl-1.1": "mozilla public license [version] 1 1|mpl 1 1",
    "mpl-2.0": "mozilla public license [version] 2 0|mpl 2 0",
    "mpl": "mozilla public license",
    "epl-1.0": "eclipse public license [version] 1 0|epl 1 0",
    "epl-2.0": "eclipse public license [version] 2 0|epl 2 0",
    "epl": "eclipse public license",
    "cddl": "common development and distribution license|cddl",
    "cpl": "common public license",
    "eupl": "european union public license|eupl",
    "artistic": "artistic license [version] 2 0|perl artistic license|artistic license",
    "zlib": "zlib|zlib libpng",
    "boost": "boost software license|bsl 1 0",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "cc0": "cc0|cc0 1 0|creative commons zero",
    "cc-by-4.0": "cc by 4 0|creative commons attribution 4 0",
    "cc-by-3.0": "cc by 3 0|creative commons attribution 3 0",
    "cc-by-sa-4.0": "cc by sa 4 0|creative commons attribution sharealike 4 0|creative commons attribution share alike 4 0",
    "cc-by-sa-3.0": "cc by sa 3 0|creative commons attribution sharealike 3 0|creative commons attribution share alike 3 0",
    "cc-by-nc-4.0": "cc by nc 4 0|creative commons attribution noncommercial 4 0|creative commons attribution non commercial 4 0",
    "cc-by-nc-sa-4.0": "cc by nc sa 4 0|creative commons attribution noncommercial sharealike 4 0",
    "cc-by-nd-4.0": "cc by nd 4 0|creative commons attribution noderivatives 4 0",
    "cc-by-nc-nd-4.0": "cc by nc nd 4 0|creative commons attribution noncommercial noderivatives 4 0",
    "cc": "creative commons",
    "ofl": "sil open font license|open font license",
    "odbl": "open database license|odbl",
    "php": "php license",
    "python": "python software foundation license|psf license",
    "postgresql": "postgresql license",
    "ruby": "ruby license",
    "openssl": "openssl license",
    "ms-pl": "microsoft public license|ms pl",
}
#: wording, priority, score. The name stands for {}; "license" may be spelt either way.
WORDINGS = (
    ("spdx license identifier {}", 5, 1.0),
    ("[is] licensed under [the] [terms] [of] [the] {} [license]", 4, 0.95),
    ("[is] (?:released|distributed|available|published|provided) under [the] [terms] [of] [the] {} [license]", 4, 0.95),
    ("under [the] terms of [the] {} [license]", 3, 0.9),
    ("[the] {} license", 2, 0.8),
    ("license {}", 2, 0.7),
)
#: Signatures of licence bodies, headers and notices, written one by one: words (<1,5>: so many of any), label, priority, score.
SIGNATURES = (
    # permissive
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5, 0.95),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "mit", 5, 0.95),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", 4, 0.9),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit", 3, 0.8),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc", 5, 0.95),
    ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "isc", 5, 0.95),
    ("the software is provided as is and the author disclaims all warranties with regard to this software", "isc", 4, 0.9),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 4, 0.9),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", 4, 0.9),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd", 4, 0.9),
    ("neither the name of <1,12> nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause", 5, 0.95),
    ("all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause", 5, 0.95),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties", "bsd", 3, 0.8),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "0bsd", 5, 0.95),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 5, 0.95),
    ("the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", 5, 0.95),
    ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib", 5, 0.95),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "boost", 5, 0.95),
    ("unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", "boost", 5, 0.95),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", 5, 0.95),
    ("in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", "postgresql", 4, 0.9),
    ("permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "hpnd", 4, 0.9),
    ("permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute", "hpnd", 4, 0.9),
    ("copyright and permission notice <0,6> daniel stenberg", "curl", 5, 0.9),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "zlib", 5, 0.95),
    ("this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 5, 0.95),
    ("the names openssl toolkit and openssl project must not be used to endorse or promote products", "openssl", 5, 0.95),
    ("this product includes software developed by the apache software foundation", "apache-1.1", 4, 0.9),
    ("products derived from this software may not be called apache nor may apache appear in their name", "apache-1.1", 5, 0.95),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0", 4, 0.9),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0", 4, 0.9),
    ("see the license for the specific language governing permissions and limitations under the license", "apache-2.0", 3, 0.85),
    ("terms and conditions for use reproduction and distribution", "apache-2.0", 3, 0.85),
    ("each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache-2.0", 5, 0.95),
    ("www apache org licenses license 2 0", "apache-2.0", 5, 0.95),
    ("this software includes php software freely available from", "php", 5, 0.9),
    ("products derived from this software may not be called php nor may php appear in their name", "php", 5, 0.95),
    ("this license agreement is between the python software foundation", "python", 5, 0.95),
    ("psf is making python available to licensee on an as is basis", "python", 5, 0.95),
    ("you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices", "ruby", 4, 0.9),
    ("place your modifications in the public domain or otherwise make them freely available", "artistic", 4, 0.9),
    ("the intent of this document is to state the conditions under which a package may be copied", "artistic", 5, 0.95),
    ("you may distribute verbatim copies of the source form of the standard version of this package", "artistic", 5, 0.95),
    ("same terms as perl itself", "artistic", 4, 0.85),
    ("this program is free software it comes without any warranty", "wtfpl", 4, 0.85),
    ("do what the fuck you want to public license", "wtfpl", 5, 0.95),
    ("you just do what the fuck you want to", "wtfpl", 5, 0.95),
    ("as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer", "beerware", 5, 0.95),
    ("the beer ware license", "beerware", 5, 0.95),
    ("the software shall be used for good not evil", "json", 5, 0.95),
    # copyleft
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", 4, 0.9),
    ("either version 2 of the license or at your option any later version", "gpl-2-or-later", 5, 0.9),
    ("either version 3 of the license or at your option any later version", "gpl-3-or-later", 5, 0.9),
    ("either version 2 1 of the license or at your option any later version", "lgpl-2.1-or-later", 5, 0.9),
    ("you should have received a copy of the gnu general public license along with", "gpl", 4, 0.9),
    ("you should have received a copy of the gnu lesser general public license along with", "lgpl", 4, 0.9),
    ("you should have received a copy of the gnu library general public license along with", "lgpl", 4, 0.9),
    ("you should have received a copy of the gnu affero general public license along with", "agpl", 4, 0.9),
    ("without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl", 4, 0.9),
    ("without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", "lgpl", 4, 0.9),
    ("without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details", "agpl", 4, 0.9),
    ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl", 3, 0.8),
    ("the licenses for most software are designed to take away your freedom to share and change it", "gpl-2", 5, 0.9),
    ("the gnu general public license is a free copyleft license for software and other kinds of works", "gpl-3", 5, 0.95),
    ("the gnu affero general public license is a free copyleft license for software and other kinds of works", "agpl-3", 5, 0.95),
    ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", "lgpl-3", 5, 0.95),
    ("this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license", "lgpl-2.1", 5, 0.95),
    ("notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", "agpl-3", 5, 0.95),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "fdl", 5, 0.95),
    ("with no invariant sections no front cover texts and no back cover texts", "fdl", 4, 0.9),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 4, 0.9),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 4, 0.9),
    ("mozilla org mpl 2 0", "mpl-2.0", 5, 0.95),
    ("the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 5, 0.95),
    ("software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights", "mpl-1.1", 4, 0.85),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", 4, 0.9),
    ("the accompanying program is provided under the terms of this eclipse public license agreement", "epl", 5, 0.95),
    ("www eclipse org legal epl v10", "epl-1.0", 5, 0.95),
    ("www eclipse org legal epl 2 0", "epl-2.0", 5, 0.95),
    ("the accompanying program is provided under the terms of this common public license agreement", "cpl", 5, 0.95),
    ("the contents of this file are subject to the terms of the common development and distribution license", "cddl", 5, 0.95),
    ("when distributing covered code include this cddl header", "cddl", 5, 0.95),
    ("this european union public licen[cs]e the eupl applies to the work", "eupl", 5, 0.95),
    ("licensed under the eupl", "eupl", 4, 0.9),
    ("this license governs use of the accompanying software if you use the software you accept this license", "ms-pl", 5, 0.9),
    ("the contents of this file are subject to the <1,5> public license", "mpl-like", 3, 0.7),
    ("this file is part of the <1,4> free software you can redistribute it", "gpl", 3, 0.75),
    # works other than software
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", 5, 0.95),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0", 5, 0.95),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0", 5, 0.95),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd-4.0", 5, 0.95),
    ("creativecommons org licenses by 4 0", "cc-by-4.0", 5, 0.95),
    ("creativecommons org licenses by 3 0", "cc-by-3.0", 5, 0.95),
    ("creativecommons org licenses by sa 4 0", "cc-by-sa-4.0", 5, 0.95),
    ("creativecommons org licenses by sa 3 0", "cc-by-sa-3.0", 5, 0.95),
    ("creativecommons org licenses by nc 4 0", "cc-by-nc-4.0", 5, 0.95),
    ("creativecommons org licenses by nc sa 4 0", "cc-by-nc-sa-4.0", 5, 0.95),
    ("creativecommons org licenses by nd 4 0", "cc-by-nd-4.0", 5, 0.95),
    ("creativecommons org licenses by nc nd 4 0", "cc-by-nc-nd-4.0", 5, 0.95),
    ("creativecommons org publicdomain zero 1 0", "cc0", 5, 0.95),
    ("text is available under the creative commons attribution share alike license", "cc-by-sa", 5, 0.95),
    ("some rights reserved", "cc", 1, 0.5),
    ("to the extent possible under law <1,12> waived all copyright and related or neighboring rights", "cc0", 5, 0.95),
    ("the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", "cc0", 5, 0.9),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5, 0.95),
    ("anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 5, 0.95),
    ("this font software is licensed under the sil open font license", "ofl", 5, 0.95),
    ("the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "ofl", 5, 0.95),
    ("with reserved font name", "ofl", 4, 0.85),
    ("this database is made available under the open database license", "odbl", 5, 0.95),
    ("opendatacommons org licenses odbl", "odbl", 5, 0.95),
    ("contains public sector information licensed under the open government licen[cs]e", "ogl", 5, 0.95),
    ("open government licen[cs]e", "ogl", 3, 0.85),
    ("this work is in the public domain in the united states", "public-domain", 4, 0.9),
    ("work of the united states government", "us-government", 3, 0.8),
    ("dedicated to the public domain", "public-domain", 3, 0.9),
    ("released into the public domain", "public-domain", 3, 0.9),
    ("in the public domain", "public-domain", 1, 0.5),
    ("the project gutenberg license included with this", "gutenberg", 5, 0.95),
    # restricted
    ("all rights reserved", "proprietary", 1, 0.6),
    ("proprietary and confidential", "proprietary", 3, 0.9),
    ("unauthorized copying of this file via any medium is strictly prohibited", "proprietary", 4, 0.9),
    ("no part of this publication may be reproduced", "proprietary", 3, 0.9),
    ("may not be reproduced distributed or transmitted in any form or by any means", "proprietary", 3, 0.9),
    ("without the prior written permission of the publisher", "proprietary", 3, 0.85),
    ("this software is the confidential and proprietary information of", "proprietary", 4, 0.95),
    ("by installing or using the software you agree to be bound by the terms of this agreement", "eula", 4, 0.9),
    ("end user license agreement", "eula", 3, 0.85),
    ("for personal and non commercial use only", "non-commercial", 3, 0.8),
    ("free for non commercial use", "non-commercial", 3, 0.8),
    ("for academic and research purposes only", "research-only", 3, 0.8),
    ("dual licensed under", "dual", 2, 0.6),
    ("licensed under either of", "dual", 2, 0.6),
    ("business source license", "busl", 4, 0.9),
    ("server side public license", "sspl", 4, 0.9),
    ("commons clause license condition", "commons-clause", 4, 0.9),
    ("elastic license", "elastic", 3, 0.85),
)


def _pattern(words: str) -> str:
    """A regex over normalised text: each word as ' word ', a word in brackets optional, <1,5> for any words, so many."""
    out = []
    for w in words.split():
        if w.startswith("<"):
            out.append(f"(?: [^ ]+ ){{{w[1:-1]}}}")
        elif w.startswith("["):
            out.append(f"(?: {_spelt(w[1:-1])} )?")
        else:
            out.append(w if w.startswith("(?:") else f" {_spelt(w)} ")
    return "".join(out)


def _exact(words: str) -> str:
    """Those words, spelt so, in normalised text."""
    return "".join(f" {w} " for w in words.split())


def _spelt(word: str) -> str:
    return "licen[cs]e" if word == "license" else "licen[cs]ed" if word == "licensed" else word


def rules() -> list[dict]:
    """All rules, in order: rank says which of two equal detections stays."""
    made = []
    for wording, priority, score in WORDINGS:
        for label, named in NAMES.items():
            for name in named.split("|"):
                ends = name.split()[-1] == "license"
                text = wording.replace("{} license", "{}").replace("{} [license]", "{}") if ends else wording
                keyword = f" {max((w for w in name.split() if w[0] != '[' and w != 'license'), key=len)} "
                made.append({"pattern": _pattern(text.replace("{}", name)), "keyword": keyword, "label": label, "priority": priority, "score": score})
    for words, label, priority, score in SIGNATURES:
        keyword = f" {max((w for w in words.split() if w.isalnum() and not w.startswith('licen')), key=len)} "
        made.append({"pattern": _pattern(words), "keyword": keyword, "label": label, "priority": priority, "score": score})
    return [r | {"rank": i} for i, r in enumerate(made)]


#: No rule matches a text without one of these; signatures that have none of them add their keywords.
_GATE = ("licen", "spdx", " rights ", " proprietary ", " domain ", " permission ", " redistribution ", " released ", " distributed ", " available ", " published ", " provided ", " under ")
GATE = (*_GATE, *sorted({r["keyword"] for r in rules() if not any(f" {g.strip()} " in r["pattern"] if g[0] == " " else g in r["pattern"] for g in _GATE)}))


def normalised(text: Column) -> Column:
    """Lower case outside ASCII as well, which moves no word boundary and makes no ASCII letter that a rule has."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, "  "), "^ +| +$", "")
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def places(norm: Column, pattern: Column) -> Column:
    """array<struct<start, stop>>: where pattern matches, in words, stop excluded."""
    parts = F.transform(F.split(norm, pattern), lambda p: (spaces(p) / 2).cast("int"))
    sizes = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), lambda m: (spaces(m) / 2).cast("int"))

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + m["before"]
        return F.struct((start + m["size"]).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + m["size"]).alias("stop")))).alias("out"))

    zipped = let(parts, lambda p: F.transform(sizes, lambda z, i: F.struct(F.get(p, i).alias("before"), z.alias("size"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    return F.aggregate(zipped, zero, step)["out"]


DETECTION = "array<struct<start:int,stop:int,priority:int,rank:int,label:string,score:double>>"


def detections(norm: Column) -> Column:
    """Every place of every rule whose keyword the text has, by start, longest and highest priority first."""
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<pattern:string,keyword:string,label:string,priority:int,score:double,rank:int>>")

    def of(r: Column) -> Column:
        return F.transform(
            places(norm, r["pattern"]),
            lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), r["priority"].alias("priority"), r["rank"].alias("rank"), r["label"].alias("label"), r["score"].alias("score")),
        )

    tried = F.filter(table, lambda r: F.contains(norm, r["keyword"]) & F.rlike(norm, r["pattern"]))
    return F.flatten(F.transform(tried, of))


LEVELS = 5


def suppressed(found: Column) -> Column:
    """Detections that none of higher priority contains, no longer one of the same priority, and no earlier rule's with the same span and priority.

    In the order of start, stop (last first), priority (highest first) and rank, whatever beats a
    detection stands before it, so one pass with the furthest stop of each priority decides.
    """

    def step(a: Column, d: Column) -> Column:
        seen = F.transform(a["seen"], lambda v, i: F.when(i + 1 == d["priority"], F.greatest(v, d["stop"])).otherwise(v))
        beaten = F.array_max(F.slice(a["seen"], d["priority"], F.lit(LEVELS))) >= d["stop"]
        return F.struct(seen.alias("seen"), F.when(beaten, a["out"]).otherwise(F.concat(a["out"], F.array(d))).alias("out"))

    ordered = F.sort_array(F.transform(found, lambda d: F.struct(d["start"].alias("a"), (-d["stop"]).alias("b"), (-d["priority"]).alias("c"), d["rank"].alias("r"), d.alias("d"))))
    zero = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("seen"), F.array().cast(DETECTION).alias("out"))
    return F.aggregate(F.transform(ordered, lambda x: x["d"]), zero, step)["out"]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, detections (spans kept), labels and score."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score"]
    step = docs.drop(*[c for c in made if c != text]).withColumn("_norm", normalised(F.col(text)))
    norm = F.col("_norm")
    none = F.array().cast("array<int>")
    starts = F.flatten(F.array(*[F.when(F.contains(norm, F.lit(_exact(p))), F.transform(places(norm, F.lit(_exact(p))), lambda x: x["start"])).otherwise(none) for p, _ in BASE]))
    base = F.filter(F.array(*[F.when(F.contains(norm, F.lit(_exact(p))), F.lit(label)) for p, label in BASE]), lambda x: x.isNotNull())
    gate = F.contains(norm, F.lit(GATE[0]))
    for word in GATE[1:]:
        gate = gate | F.contains(norm, F.lit(word))
    step = step.withColumns(
        {
            "n_words": (spaces(norm) / 2).cast("long"),
            "_starts": starts,
            "_base": base,
            "detections": F.when(gate, suppressed(detections(norm))).otherwise(F.array().cast(DETECTION)),
        }
    )
    said = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0))
    return step.withColumns(
        {
            "n_base": F.size("_starts").cast("long"),
            "first_word": F.array_min("_starts").cast("long"),
            "last_word": F.array_max("_starts").cast("long"),
            "base_labels": F.array_join(F.array_sort(F.array_distinct("_base")), ","),
            "labels": F.array_join(said, ","),
            "score": F.greatest(best, F.when(F.size("_base") > 0, F.lit(0.8)).otherwise(0.0)),
        }
    ).drop("_norm", "_starts", "_base")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_Q = lambda s: s.replace("'", "''")
_PLACES = lambda pattern: f"list_transform(range(1, len(regexp_extract_all(norm, {pattern})) + 1), lambda j: (length(array_to_string(list_transform(range(1, j + 1), lambda k: regexp_split_to_array(norm, {pattern})[k]), '')) - length(replace(array_to_string(list_transform(range(1, j + 1), lambda k: regexp_split_to_array(norm, {pattern})[k]), ''), ' ', '')) + length(array_to_string(regexp_extract_all(norm, {pattern})[1:j - 1], '')) - length(replace(array_to_string(regexp_extract_all(norm, {pattern})[1:j - 1], ''), ' ', '')))::BIGINT // 2)"
_SIZE = "((length(m) - length(replace(m, ' ', ''))) // 2)"
ORACLE = f"""WITH rules(pattern, keyword, label, priority, score, rank) AS (VALUES {", ".join(f"('{_Q(r['pattern'])}', '{r['keyword']}', '{r['label']}', {r['priority']}, {r['score']}::DOUBLE, {r['rank']})" for r in rules())}),
base(pattern, label) AS (VALUES {", ".join(f"('{_exact(p)}', '{label}')" for p, label in BASE)}),
cut AS (SELECT row_number() OVER () AS rid, doc_id, trim(regexp_replace(lower(coalesce(text, '')), '{SEPARATORS}', '  ', 'g'), ' ') AS w FROM documents),
docs AS (SELECT rid, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS norm FROM cut),
in_base AS (SELECT rid, label, unnest({_PLACES("pattern")}) AS start FROM docs JOIN base ON contains(norm, pattern)),
by_base AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM in_base GROUP BY rid),
hits AS (SELECT rid, norm, pattern, label, priority, score, rank FROM docs JOIN rules ON contains(norm, keyword) AND regexp_matches(norm, pattern)),
found AS (SELECT rid, label, priority, score, rank, unnest({_PLACES("pattern")}) AS start,
    unnest(list_transform(regexp_extract_all(norm, pattern), lambda m: {_SIZE})) AS size FROM hits),
kept AS (SELECT * FROM found d WHERE NOT EXISTS (SELECT 1 FROM found e WHERE e.rid = d.rid AND e.start <= d.start AND e.start + e.size >= d.start + d.size
    AND (e.priority > d.priority OR (e.priority = d.priority AND (e.start < d.start OR e.size > d.size OR e.rank < d.rank))))),
said AS (SELECT rid, label FROM kept UNION SELECT rid, label FROM in_base),
by_label AS (SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM said GROUP BY rid),
by_score AS (SELECT rid, max(score) AS score FROM kept GROUP BY rid)
SELECT doc_id, ((length(norm) - length(replace(norm, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 0.8 ELSE 0 END)::DOUBLE AS score
FROM docs LEFT JOIN by_base USING (rid) LEFT JOIN by_label USING (rid) LEFT JOIN by_score USING (rid)"""
