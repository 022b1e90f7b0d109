"""License scans: ordered signature rules behind a keyword gate, overlaps settled by priority and containment.

A text becomes its lower-cased words joined by single spaces. Every rule one of whose keywords occurs is run (what a
rule matches always holds one); detections are then taken in order of priority, length, place and rule, and one
whose interval lies within that of one taken before is suppressed. Three plain phrases (base) are counted besides and
always keep their labels.

Null or empty texts: zero words, no labels, score 0. Empty table: no rows. Ties of two rules: the earlier one's label. Very long texts: one pass each, rules only behind the gate.
Repeated rows are scanned one by one; other columns of the input are kept by scan() and never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES

BASE = ((b" mit license ", "mit"), (b" apache license ", "apache"), (b" general public license ", "gpl"))

#: label, keyword (or several, one for each alternative), pattern of the name in lower-case words.
NAMES = (
    ("mit", (b"mit", b"expat", b"x11"), r"(?:the )?(?:mit|expat|x11)(?: style)?"),
    ("mit-0", b"mit", r"mit 0|mit no attribution"),
    ("apache-2.0", b"apache", r"(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?"),
    ("apache-1.1", b"apache", r"(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version)? v?1 1"),
    ("gpl-2.0", b"general public", r"(?:the )?(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", b"general public", r"(?:the )?(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?"),
    ("gpl-2.0", b"gpl", r"(?:the )?(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3.0", b"gpl", r"(?:the )?(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl-2.1", b"lesser general", r"(?:the )?(?:gnu )?lesser general public licen[sc]e(?: version)? v?2 1"),
    ("lgpl-3.0", b"lesser general", r"(?:the )?(?:gnu )?lesser general public licen[sc]e(?: version)? v?3(?: 0)?"),
    ("lgpl-2.0", b"library general", r"(?:the )?(?:gnu )?library general public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("lgpl", b"lgpl", r"(?:the )?(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl-3.0", b"affero", r"(?:the )?(?:gnu )?affero general public licen[sc]e(?: version)?(?: v?3(?: 0)?)?"),
    ("agpl-3.0", b"agpl", r"(?:the )?(?:gnu )?agpl(?: ?v?3(?: 0)?)?"),
    ("gfdl", b"free documentation", r"(?:the )?gnu free documentation licen[sc]e(?: version)?(?: 1 [123])?"),
    ("bsd-2-clause", b"bsd", r"(?:the )?(?:bsd 2 clause|simplified bsd|2 clause bsd|freebsd)"),
    ("bsd-3-clause", b"bsd", r"(?:the )?(?:bsd 3 clause|new bsd|modified bsd|revised bsd|3 clause bsd)"),
    ("bsd-4-clause", b"bsd", r"(?:the )?(?:bsd 4 clause|original bsd|old bsd|4 clause bsd)"),
    ("0bsd", (b"0bsd", b"zero clause bsd"), r"(?:the )?(?:0bsd|zero clause bsd)"),
    ("bsd", b"bsd", r"(?:a |the )?bsd(?: style)?"),
    ("isc", b"isc", r"(?:the )?isc"),
    ("mpl-1.1", b"mozilla", r"(?:the )?mozilla public licen[sc]e(?: version)? v?1 1"),
    ("mpl-2.0", b"mozilla", r"(?:the )?mozilla public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("mpl-2.0", b"mpl", r"(?:the )?mpl ?v?2(?: 0)?"),
    ("epl-1.0", b"eclipse", r"(?:the )?eclipse public licen[sc]e(?: version)? v?1(?: 0)?"),
    ("epl-2.0", b"eclipse", r"(?:the )?eclipse public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("edl-1.0", b"eclipse", r"(?:the )?eclipse distribution licen[sc]e(?: version)?(?: v?1(?: 0)?)?"),
    ("cddl-1.0", b"common development", r"(?:the )?common development and distribution licen[sc]e(?: version)?(?: v?1(?: [01])?)?"),
    ("cddl-1.0", b"cddl", r"(?:the )?cddl(?: v?1(?: [01])?)?"),
    ("cpl-1.0", b"common public", r"(?:the )?common public licen[sc]e(?: version)?(?: v?1(?: 0)?)?"),
    ("eupl-1.2", b"european union", r"(?:the )?european union public licen[sc]e(?: version)?(?: v?1 [12])?"),
    ("eupl-1.2", b"eupl", r"(?:the )?eupl(?: v?1 [12])?"),
    ("artistic-2.0", b"artistic", r"(?:the )?artistic licen[sc]e(?: version)? v?2(?: 0)?"),
    ("artistic-1.0", b"artistic", r"(?:the )?(?:perl )?artistic licen[sc]e(?: version)?(?: v?1(?: 0)?)?"),
    ("boost-1.0", b"boost", r"(?:the )?boost software licen[sc]e(?: version)?(?: v?1(?: 0)?)?"),
    ("zlib", b"zlib", r"(?:the )?zlib(?: libpng)?"),
    ("libpng", b"libpng", r"(?:the )?libpng"),
    ("unlicense", b"unlicense", r"(?:the )?unlicense"),
    ("wtfpl", b"wtfpl", r"(?:the )?wtfpl(?: version)?(?: v?2)?"),
    ("cc0-1.0", b"cc0", r"(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd-4.0", b"nc nd", r"(?:the )?(?:creative commons )?cc by nc nd(?: 4 0)?"),
    ("cc-by-nc-sa-4.0", b"nc sa", r"(?:the )?(?:creative commons )?cc by nc sa(?: 4 0)?"),
    ("cc-by-nc-4.0", b"by nc", r"(?:the )?(?:creative commons )?cc by nc(?! nd| sa)(?: 4 0)?"),
    ("cc-by-nd-4.0", b"by nd", r"(?:the )?(?:creative commons )?cc by nd(?: 4 0)?"),
    ("cc-by-sa-3.0", b"by sa", r"(?:the )?(?:creative commons )?cc by sa 3 0"),
    ("cc-by-sa-4.0", b"by sa", r"(?:the )?(?:creative commons )?cc by sa(?! 3)(?: 4 0)?"),
    ("cc-by-3.0", b"cc by", r"(?:the )?(?:creative commons )?cc by 3 0"),
    ("cc-by-4.0", b"cc by", r"(?:the )?(?:creative commons )?cc by(?! n| s| 3)(?: 4 0)?"),
    ("cc-by-nc-nd-4.0", b"attribution", r"(?:the |a )?creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: 4 0)?(?: international)?"),
    ("cc-by-nc-sa-4.0", b"attribution", r"(?:the |a )?creative commons attribution non ?commercial share ?alike(?: 4 0)?(?: international)?"),
    ("cc-by-nc-4.0", b"attribution", r"(?:the |a )?creative commons attribution non ?commercial(?! no| share)(?: 4 0)?(?: international)?"),
    ("cc-by-nd-4.0", b"attribution", r"(?:the |a )?creative commons attribution no ?deriv(?:ative)?s(?: 4 0)?(?: international)?"),
    ("cc-by-sa-4.0", b"attribution", r"(?:the |a )?creative commons attribution share ?alike(?: 4 0)?(?: international)?"),
    ("cc-by-4.0", b"attribution", r"(?:the |a )?creative commons attribution(?! n| s)(?: 4 0)?(?: international)?"),
    ("python-2.0", (b"python software", b"psf"), r"(?:the )?(?:python software foundation|psf)(?: licen[sc]e)?(?: version)?(?: v?2(?: 0)?)?"),
    ("php-3.01", b"php", r"(?:the )?php(?: licen[sc]e)?(?: version)?(?: v?3 01)?"),
    ("ruby", b"ruby", r"(?:the )?ruby"),
    ("openssl", b"openssl", r"(?:the )?openssl"),
    ("odbl-1.0", b"open database", r"(?:the )?open database licen[sc]e(?: odbl)?(?: version)?(?: v?1(?: 0)?)?"),
    ("ofl-1.1", b"open font", r"(?:the )?(?:sil )?open font licen[sc]e(?: version)?(?: v?1 1)?"),
    ("ms-pl", b"microsoft public", r"(?:the )?microsoft public"),
    ("ms-rl", b"microsoft reciprocal", r"(?:the )?microsoft reciprocal"),
    ("osl-3.0", b"open software", r"(?:the )?open software licen[sc]e(?: version)?(?: v?3(?: 0)?)?"),
    ("afl-3.0", b"academic free", r"(?:the )?academic free licen[sc]e(?: version)?(?: v?3(?: 0)?)?"),
    ("ncsa", b"ncsa", r"(?:the )?(?:university of illinois )?(?:ncsa)(?: open source)?"),
    ("postgresql", b"postgresql", r"(?:the )?postgresql"),
    ("w3c", b"w3c", r"(?:the )?w3c software(?: notice and)?"),
    ("bsl-1.1", b"business source", r"(?:the )?business source licen[sc]e(?: version)?(?: v?1 1)?"),
    ("sspl-1.0", b"server side public", r"(?:the )?server side public licen[sc]e(?: version)?(?: v?1)?"),
    ("elastic-2.0", b"elastic", r"(?:the )?elastic licen[sc]e(?: version)?(?: v?2(?: 0)?)?"),
    ("openrail", b"rail", r"(?:the )?(?:bigscience |creativeml )?(?:open )?rail(?: m)?"),
)

#: kind, priority (lower wins), pattern around a name, weight. Four kinds for each name.
FRAMES = (
    ("grant", 2, r"(?:is |are )?(?:dual )?(?:licen[sc]ed|released|distributed|published|available|provided|made available) (?:to you )?under (?:the terms of |the terms and conditions of |terms of )?(?:{name})(?: licen[sc]e)?", 0.9),
    ("tag", 1, r"spdx licen[sc]e identifier (?:{name})(?: only| or later)?", 1.0),
    ("field", 3, r"licen[sc]es? (?:is |are |type |name )?(?:{name})(?: licen[sc]e)?", 0.7),
    ("name", 4, r"(?:{name}) (?:public )?(?:licen[sc]e|agreement|dedication)", 0.6),
)

#: label, keyword, pattern, priority: wording of the licences themselves and of notices.
WORDING = (
    ("mit", b"hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0),
    ("mit", b"sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies", 0),
    ("mit", b"above copyright notice", r"the above copyright notice and this permission notice shall be included", 0),
    ("isc", b"permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0),
    ("bsd", b"redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0),
    ("bsd-3-clause", b"endorse or promote", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products", 0),
    ("bsd-4-clause", b"advertising materials", r"all advertising materials mentioning features or use of this software", 0),
    ("apache-2.0", b"apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance", 0),
    ("apache-2.0", b"apache org", r"(?:https? )?www apache org licenses license 2 0", 0),
    ("apache-2.0", b"conditions of any kind", r"without warranties or conditions of any kind either express or implied", 0),
    ("gpl", b"redistribute it", r"(?:is free software )?you can redistribute it and or modify it under the terms of the gnu general public license", 0),
    ("gpl-2.0", b"version 2", r"either version 2 of the license or at your option any later version", 0),
    ("gpl-3.0", b"version 3", r"either version 3 of the license or at your option any later version", 0),
    ("gpl", b"gnu org", r"(?:https? )?www gnu org licenses", 1),
    ("lgpl", b"lesser general", r"redistribute it and or modify it under the terms of the gnu lesser general public license", 0),
    ("agpl-3.0", b"affero", r"redistribute it and or modify it under the terms of the gnu affero general public license", 0),
    ("mpl-2.0", b"mozilla", r"subject to the terms of the mozilla public license v 2 0", 0),
    ("unlicense", b"unencumbered", r"this is free and unencumbered software released into the public domain", 0),
    ("wtfpl", b"want to", r"do what the fuck you want to public license", 0),
    ("zlib", b"as is", r"this software is provided as is without any express or implied warranty in no event will the authors", 0),
    ("boost-1.0", b"boost", r"distributed under the boost software license", 0),
    ("cc", b"creativecommons", r"(?:https? )?creativecommons org licenses(?: by\S*)?(?: (?:nc|nd|sa))*(?: [1-4] 0)?", 1),
    ("cc0-1.0", b"creativecommons", r"(?:https? )?creativecommons org publicdomain zero", 1),
    ("public-domain", b"public domain", r"(?:is |are )?(?:placed |released |dedicated )?(?:in|into|to) the public domain", 3),
    ("public-domain", b"public domain", r"public domain (?:work|dedication|mark)", 3),
    ("warranty", b"warrant", r"without any warranty without even the implied warranty of merchantability", 5),
    ("warranty", b"warrant", r"the software is provided as is without warranty of any kind", 5),
    ("liability", b"liab", r"in no event shall the (?:authors?|copyright holders?)(?: or \S+ \S+)? be liable", 5),
    ("copyright", b"copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*(?: by)?", 6),
    ("copyright", b"copyright", r"copyright holders? and contributors", 6),
    ("all-rights-reserved", b"rights reserved", r"all rights reserved", 6),
    ("no-rights-reserved", b"rights reserved", r"no rights reserved", 6),
    ("some-rights-reserved", b"rights reserved", r"some rights reserved", 6),
    ("proprietary", b"proprietary", r"(?:proprietary and confidential|confidential and proprietary|proprietary (?:licen[sc]e|software|information))", 4),
    ("proprietary", b"permission", r"(?:may not be|unauthori[sz]ed) (?:reproduced|copied|copying|distributed|redistributed)\b.{0,60}without (?:the )?(?:prior |express |written )*permission", 4),
    ("eula", b"end user", r"end user licen[sc]e agreement", 4),
    ("non-commercial", b"use only", r"(?:for )?(?:non ?commercial|personal) use only", 5),
    ("educational", (b"use only", b"purposes only"), r"for (?:educational|research|academic)(?: and \S+)? (?:use|purposes) only", 5),
    ("royalty-free", b"royalt", r"royalty free(?: licen[sc]e)?", 6),
    ("dual-licensed", b"dual licen", r"dual licen[sc](?:ed|e|ing)", 6),
)


def _rules() -> list[tuple[tuple[bytes, ...], re.Pattern, str, int, float]]:
    made = [(key, rf" (?:{pattern})(?= )", label, priority, 1.0 if priority < 2 else 0.5) for label, key, pattern, priority in WORDING]
    for label, key, name in NAMES:
        made += [(key, " " + frame.format(name=name) + "(?= )", label, priority, weight) for _, priority, frame, weight in FRAMES]
    return [(key if isinstance(key, tuple) else (key,), re.compile(pattern.encode()), label, priority, weight) for key, pattern, label, priority, weight in made]


RULES = _rules()
_BY_KEYS: dict[tuple[bytes, ...], list[int]] = {}
for _i, _rule in enumerate(RULES):
    _BY_KEYS.setdefault(_rule[0], []).append(_i)


def detections(norm: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) of what is left after suppression; norm: words with a space before and after each."""
    found = []
    for keys, rules in _BY_KEYS.items():
        if any(key in norm for key in keys):
            for i in rules:
                _, pattern, label, priority, weight = RULES[i]
                found += [(priority, m.start() - m.end(), m.start(), i, m.end(), label, weight) for m in pattern.finditer(norm)]
    found.sort()
    # taken intervals none of which holds another: starts and ends both ascend
    starts, ends, kept = [], [], []
    for _, _, start, _, end, label, weight in found:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, label, weight))
        # what the new one holds needs no place of its own any more
        stop = at
        if at and starts[at - 1] == start:
            at -= 1
        while stop < len(starts) and ends[stop] <= end:
            stop += 1
        starts[at:stop], ends[at:stop] = [start], [end]
    return sorted(kept)


def scan_text(raw: bytes | None) -> tuple:
    words = (raw or b"").translate(WORD_BYTES).split()
    norm = b" " + b" ".join(words) + b" " if words else b""
    if not words:
        return 0, 0, None, None, "", "", 0.0
    places, base, spans = [], set(), []
    for phrase, label in BASE:
        at = norm.find(phrase)
        while at >= 0:
            places.append(at)
            base.add(label)
            spans.append((at, at + len(phrase) - 1))
            at = norm.find(phrase, at + 1)
    kept = detections(norm)
    spans = sorted(spans + [(s, e) for s, e, _, _ in kept])
    covered, upto = 0, 0
    for s, e in spans:
        s = max(s, upto)
        if e > s:
            covered += norm.count(b" ", s, e)
            upto = e
    first = norm.count(b" ", 0, min(places)) if places else None
    last = norm.count(b" ", 0, max(places)) if places else None
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in kept})), min(1.0, covered / len(words))


SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")] + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])


@F.pandas_udf(SCHEMA)
def _scan(text: pd.Series) -> pd.DataFrame:
    rows = [scan_text(t.encode() if t is not None else None) for t in text]
    out = pd.DataFrame(rows, columns=SCHEMA.names)
    return out.astype({"first_word": "Int64", "last_word": "Int64"})


def scan(text: Column) -> Column:
    """A struct of SCHEMA for a text; score: share of the words that detections cover."""
    return _scan(text)
