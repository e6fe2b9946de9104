"""License scan by ordered signature rules.

Every rule is a regular expression over the words of a text and has a keyword,
a word that each of its matches holds. Only rules whose keyword is among a
text's words are run. Where detections overlap, one that lies inside another is
suppressed if the other's rule comes first in the order, or has the same rank
and is longer. The base phrases are searched beside the rules and always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held

#: The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: label, keyword, names as patterns of words (a name's words may be apart by one blank).
FAMILIES = [
    ("mit", "mit", ["mit license", "mit licence", "mit expat license", "x11 mit license", "mit"]),
    ("mit-0", "attribution", ["mit no attribution(?: license)?"]),
    ("apache-1.0", "apache", ["apache(?: software)? license(?: version)? v?1 0", "apache 1 0"]),
    ("apache-1.1", "apache", ["apache(?: software)? license(?: version)? v?1 1", "apache 1 1"]),
    ("apache-2.0", "apache", ["apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?", "apache v?2(?: 0)?"]),
    ("apache-2.0", "asl", ["asl v?2(?: 0)?"]),
    ("apache", "apache", ["apache(?: software)? licen[sc]e"]),
    ("gpl-1.0", "public", ["(?:gnu )?general public licen[sc]e(?: version| v) ?1(?: 0)?"]),
    ("gpl-2.0", "public", ["(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?"]),
    ("gpl-3.0", "public", ["(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?"]),
    ("gpl-2.0", "gpl", ["(?:gnu )?gpl(?: version)? v? ?2(?: 0)?"]),
    ("gpl-2.0", "gpl2", ["(?:gnu )?gpl2(?: 0)?"]),
    ("gpl-2.0", "gplv2", ["(?:gnu )?gplv2"]),
    ("gpl-3.0", "gpl", ["(?:gnu )?gpl(?: version)? v? ?3(?: 0)?"]),
    ("gpl-3.0", "gpl3", ["(?:gnu )?gpl3(?: 0)?"]),
    ("gpl-3.0", "gplv3", ["(?:gnu )?gplv3"]),
    ("gpl", "public", ["(?:gnu )?general public licen[sc]e"]),
    ("gpl", "gpl", ["(?:gnu )?gpl"]),
    ("lgpl-2.1", "lesser", ["(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?2 1"]),
    ("lgpl-3.0", "lesser", ["(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?"]),
    ("lgpl-2.0", "library", ["(?:gnu )?library general public licen[sc]e(?:(?: version| v)? ?2(?: 0)?)?"]),
    ("lgpl", "lesser", ["(?:gnu )?lesser general public licen[sc]e"]),
    ("lgpl", "lgpl", ["(?:gnu )?lgpl"]),
    ("agpl-3.0", "affero", ["(?:gnu )?affero general public licen[sc]e(?:(?: version| v)? ?3(?: 0)?)?"]),
    ("agpl-3.0", "agpl", ["(?:gnu )?agpl(?: v?3(?: 0)?)?"]),
    ("gfdl", "documentation", ["(?:gnu )?free documentation licen[sc]e"]),
    ("bsd-2-clause", "bsd", ["(?:simplified|freebsd) bsd licen[sc]e", "bsd 2 clause(?: simplified)?(?: licen[sc]e)?", "2 clause bsd(?: licen[sc]e)?"]),
    ("bsd-3-clause", "bsd", ["(?:new|revised|modified) bsd licen[sc]e", "bsd 3 clause(?: new or revised)?(?: licen[sc]e)?", "3 clause bsd(?: licen[sc]e)?"]),
    ("bsd-4-clause", "bsd", ["original bsd licen[sc]e", "bsd 4 clause(?: licen[sc]e)?", "4 clause bsd(?: licen[sc]e)?"]),
    ("0bsd", "bsd", ["zero clause bsd(?: licen[sc]e)?", "bsd zero clause(?: licen[sc]e)?"]),
    ("bsd", "bsd", ["bsd licen[sc]e", "bsd style licen[sc]e"]),
    ("isc", "isc", ["isc licen[sc]e"]),
    ("mpl-1.1", "mozilla", ["mozilla public licen[sc]e(?: version| v)? ?1 1"]),
    ("mpl-2.0", "mozilla", ["mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?"]),
    ("mpl", "mozilla", ["mozilla public licen[sc]e"]),
    ("mpl", "mpl", ["mpl(?: v?[12](?: [01])?)?"]),
    ("epl-1.0", "eclipse", ["eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?"]),
    ("epl-2.0", "eclipse", ["eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?"]),
    ("epl", "eclipse", ["eclipse public licen[sc]e"]),
    ("cpl-1.0", "common", ["common public licen[sc]e(?:(?: version| v)? ?1(?: 0)?)?"]),
    ("cddl-1.0", "cddl", ["cddl(?: v?1(?: 0)?)?"]),
    ("cddl-1.0", "distribution", ["common development and distribution licen[sc]e"]),
    ("artistic-1.0", "artistic", ["artistic licen[sc]e(?: version| v)? ?1(?: 0)?"]),
    ("artistic-2.0", "artistic", ["artistic licen[sc]e(?: version| v)? ?2(?: 0)?"]),
    ("artistic", "artistic", ["artistic licen[sc]e"]),
    ("boost", "boost", ["boost software licen[sc]e(?:(?: version| v)? ?1(?: 0)?)?"]),
    ("zlib", "zlib", ["zlib(?: libpng)? licen[sc]e"]),
    ("unlicense", "unlicense", ["(?:the )?unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("postgresql", "postgresql", ["postgresql licen[sc]e"]),
    ("python", "python", ["python software foundation licen[sc]e", "python licen[sc]e"]),
    ("php", "php", ["php licen[sc]e(?:(?: version| v)? ?3(?: 0[01]?)?)?"]),
    ("openssl", "openssl", ["openssl licen[sc]e"]),
    ("ofl-1.1", "ofl", ["sil ofl(?: 1 1)?"]),
    ("ofl-1.1", "font", ["(?:sil )?open font licen[sc]e(?:(?: version| v)? ?1 1)?"]),
    ("eupl-1.2", "union", ["european union public licen[sc]e(?:(?: version| v)? ?1 2)?"]),
    ("ms-pl", "microsoft", ["microsoft public licen[sc]e"]),
    ("ms-rl", "reciprocal", ["microsoft reciprocal licen[sc]e"]),
    ("osl-3.0", "open", ["open software licen[sc]e(?:(?: version| v)? ?3(?: 0)?)?"]),
    ("afl-3.0", "academic", ["academic free licen[sc]e(?:(?: version| v)? ?3(?: 0)?)?"]),
    ("ecl-2.0", "educational", ["educational community licen[sc]e(?:(?: version| v)? ?2(?: 0)?)?"]),
    ("bsl-1.1", "business", ["business source licen[sc]e(?:(?: version| v)? ?1 1)?"]),
    ("sspl-1.0", "server", ["server side public licen[sc]e"]),
    ("cc0-1.0", "cc0", ["cc0(?: 1 0)?(?: universal)?"]),
    ("cc-by-nc-nd", "noderivatives", ["attribution noncommercial noderivatives"]),
    ("cc-by-nc-sa", "noncommercial", ["attribution noncommercial sharealike"]),
    ("cc-by-nc", "noncommercial", ["attribution noncommercial"]),
    ("cc-by-sa", "sharealike", ["attribution sharealike"]),
    ("cc-by-sa", "cc", ["cc by sa(?: [1234] 0)?"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa(?: [1234] 0)?"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd(?: [1234] 0)?"]),
    ("cc-by-nc", "cc", ["cc by nc(?: [1234] 0)?"]),
    ("cc-by-nd", "cc", ["cc by nd(?: [1234] 0)?"]),
    ("cc-by", "cc", ["cc by [1234] 0"]),
    ("cc-by", "creative", ["creative commons attribution(?: [1234] 0)?(?: international)?(?: licen[sc]e)?"]),
    ("cc", "creative", ["creative commons(?: licen[sc]e)?"]),
    ("public-domain", "domain", ["public domain"]),
    ("proprietary", "reserved", ["all rights reserved"]),
]

#: Rank and confidence of a rule by what stands around the name; lower ranks come first.
#: Short names alone ("mit") are not enough for the last.
FORMS = [
    (0, 1.0, "spdx license identifier {n}"),
    (1, 0.95, "(?:is |are )?licen[sc]ed(?: to you)? under(?: the)?(?: terms of)?(?: the)? {n}"),
    (1, 0.95, "(?:released|distributed|provided|available|published) under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {n}"),
    (2, 0.9, "(?:subject to|covered by|governed by|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {n}"),
    (2, 0.9, "(?:redistribute|modify) it under(?: the)? terms of(?: the)? {n}"),
    (3, 0.8, "(?:see|copy of|read)(?: the)? {n}"),
    (4, 0.6, "{n}"),
]


#: Signatures of licence texts, headers and notices: label, rank, confidence, keyword, pattern over words.
SIGNATURES = [
    # grants
    ("mit", 0, 0.99, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 1, 0.9, "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 2, 0.85, "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 0, 0.95, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: [^ ]+){0,30}? to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", 1, 0.95, "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 0, 0.97, "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", 0, 0.97, "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", 0, 0.9, "advertising", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted(?: [^ ]+){0,60}? not be used in advertising or publicity"),
    ("postgresql", 0, 0.97, "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", 0, 0.95, "representations", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted(?: [^ ]+){0,60}? makes no representations"),
    ("bsd", 1, 0.9, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", 2, 0.8, "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 1, 0.95, "endorse", "neither the names? of(?: the)?(?: [^ ]+){1,12}? may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 0, 0.97, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", 0, 0.97, "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("zlib", 0, 0.97, "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 1, 0.95, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", 0, 0.97, "machine", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("boost", 0, 0.97, "boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt"),
    ("unlicense", 0, 0.99, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 0, 0.95, "jurisdictions", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", 0, 0.99, "fuck", "(?:0 )?you just do what the fuck you want to"),
    ("wtfpl", 0, 0.99, "want", "do what the f u c k you want to public license"),
    ("beerware", 0, 0.95, "beer", "you can buy me a beer in return"),
    ("fsfap", 0, 0.95, "royalty", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice"),
    ("curl", 0, 0.9, "fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("json", 0, 0.99, "evil", "the software shall be used for good not evil"),
    ("ofl-1.1", 0, 0.97, "reserved", "no modified version of the font software may use the reserved font name"),
    ("ofl-1.1", 0, 0.97, "font", "this font software is licensed under the sil open font license version 1 1"),
    # notices of the Apache family
    ("apache-2.0", 0, 0.99, "compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 1, 0.95, "apache", "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2.0", 1, 0.95, "apache", "www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", 0, 0.95, "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", 0, 0.97, "patent", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0", 1, 0.9, "notice", "if the work includes a notice text file as part of its distribution"),
    ("apache-1.1", 0, 0.97, "apache", "this product includes software developed by the apache software foundation"),
    # notices of the GNU family
    ("gpl-3.0-or-later", 0, 0.99, "later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-or-later", 0, 0.99, "later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2.0-only", 0, 0.98, "version", "under the terms of(?: version 2 of)? the gnu general public license(?: version 2)? (?:only )?as published by the free software foundation version 2(?: of the license)? only"),
    ("gpl-2.0-only", 0, 0.98, "under", "under the terms of the gnu general public license version 2 only"),
    ("lgpl-2.1-or-later", 0, 0.99, "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", 0, 0.99, "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", 0, 0.99, "library", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3.0-or-later", 0, 0.99, "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", 1, 0.9, "preamble", "preamble the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 0, 0.97, "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", 0, 0.97, "network", "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl-3.0", 0, 0.95, "incorporates", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("gpl", 1, 0.85, "gnu", "you should have received a copy of the gnu general public license along with this (?:program|file|software|library|package)"),
    ("lgpl", 1, 0.85, "lesser", "you should have received a copy of the gnu lesser general public license along with this (?:program|file|software|library|package)"),
    ("agpl-3.0", 1, 0.85, "affero", "you should have received a copy of the gnu affero general public license along with this (?:program|file|software|library|package)"),
    ("gpl", 2, 0.8, "gnu", "www gnu org licenses gpl(?: [123] 0)?(?: html| txt)?"),
    ("lgpl", 2, 0.8, "gnu", "www gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("agpl-3.0", 2, 0.8, "gnu", "www gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", 0, 0.97, "invariant", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: [^ ]+){0,30}? with (?:no|the) invariant sections"),
    ("gpl-classpath", 0, 0.97, "exception", "as a special exception the copyright holders of this (?:library|program) give you permission to link this (?:library|program) with independent modules"),
    # notices of file-level copyleft licences
    ("mpl-2.0", 0, 0.99, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 1, 0.95, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 0, 0.97, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 0, 0.95, "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("epl-1.0", 0, 0.98, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 0, 0.98, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-2.0", 1, 0.9, "eclipse", "www eclipse org legal epl 2 0"),
    ("epl-1.0", 1, 0.9, "eclipse", "www eclipse org legal epl v10 html"),
    ("cddl-1.0", 0, 0.97, "cddl", "the contents of this file are subject to the terms of the common development and distribution license(?: the license)?(?: [^ ]+){0,20}? cddl"),
    ("cddl-1.1", 0, 0.97, "either", "the contents of this file are subject to the terms of either the gnu general public license version 2 only gpl or the common development and distribution license"),
    ("cpl-1.0", 0, 0.95, "common", "the accompanying program is provided under the terms of this common public license"),
    ("eupl-1.2", 0, 0.97, "eupl", "licensed under the eupl(?: version 1 2| v ?1 2)?"),
    ("osl-3.0", 0, 0.95, "open", "licensed under the open software license version 3 0"),
    ("artistic-2.0", 0, 0.95, "package", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package may be copied"),
    ("artistic-1.0", 0, 0.95, "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("lppl-1.3c", 0, 0.97, "lppl", "this work has the lppl maintenance status"),
    ("lppl-1.3c", 0, 0.95, "latex", "under the conditions of the latex project public license either version 1 3 of this license or(?: at your option)? any later version"),
    ("perl", 0, 0.97, "perl", "under the same terms as perl itself"),
    ("ruby", 0, 0.95, "ruby", "under the same terms as ruby"),
    ("python-2.0", 0, 0.95, "psf", "psf is making python available to licensee on an as is basis"),
    ("php-3.01", 0, 0.97, "php", "this source file is subject to version 3 01 of the php license"),
    ("openssl", 0, 0.97, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 0, 0.97, "cryptographic", "this product includes cryptographic software written by eric young"),
    ("w3c", 0, 0.95, "w3c", "w3c software notice and license"),
    ("ijg", 0, 0.95, "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("libpng", 0, 0.95, "png", "the png reference library is supplied as is"),
    ("icu", 0, 0.9, "unicode", "unicode inc license agreement data files and software"),
    ("ncsa", 0, 0.95, "deal", "to deal with the software without restriction"),
    ("vim", 0, 0.95, "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("ms-pl", 0, 0.97, "microsoft", "this license governs use of the accompanying software(?: [^ ]+){0,60}? microsoft public license"),
    # content and data licences
    ("cc0-1.0", 0, 0.98, "waived", "to the extent possible under law(?: [^ ]+){0,20}? has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 1, 0.95, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", 0, 0.97, "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 0, 0.97, "creativecommons", "creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", 0, 0.97, "creativecommons", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 0, 0.97, "creativecommons", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", 0, 0.97, "creativecommons", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", 0, 0.97, "creativecommons", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 0, 0.97, "creativecommons", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nd-4.0", 0, 0.97, "creativecommons", "creativecommons org licenses by nd 4 0"),
    ("odbl-1.0", 0, 0.97, "odbl", "open database license odbl"),
    ("odbl-1.0", 1, 0.95, "opendatacommons", "opendatacommons org licenses odbl 1 0"),
    ("odc-by-1.0", 0, 0.97, "opendatacommons", "opendatacommons org licenses by 1 0"),
    ("pddl-1.0", 0, 0.97, "opendatacommons", "opendatacommons org licenses pddl 1 0"),
    ("ogl-uk-3.0", 0, 0.97, "government", "contains public sector information licensed under the open government licen[sc]e v3 0"),
    # source-available and closed
    ("bsl-1.1", 0, 0.97, "additional", "additional use grant"),
    ("sspl-1.0", 0, 0.95, "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", 0, 0.97, "elastic", "(?:licensed under the )?elastic license 2 0"),
    ("commons-clause", 0, 0.97, "commons", "the software is provided to you by the licensor under the license as defined below subject to the following condition(?: [^ ]+){0,30}? commons clause"),
    ("polyform-noncommercial", 0, 0.97, "polyform", "polyform noncommercial license(?: 1 0 0)?"),
    ("openrail-m", 0, 0.95, "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?"),
    ("llama", 0, 0.95, "llama", "llama [23](?: [123])? community license(?: agreement)?"),
    ("proprietary", 1, 0.8, "confidential", "proprietary and confidential"),
    ("proprietary", 1, 0.8, "prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 1, 0.85, "reproduced", "no part of this (?:publication|work|document|software) may be reproduced(?: [^ ]+){0,20}? without(?: the)? prior written permission"),
    ("public-domain", 1, 0.85, "dedicate", "(?:i |we )?hereby dedicate (?:this|the) (?:work|software|code) to the public domain"),
    ("public-domain", 1, 0.85, "placed", "(?:has been |is )?placed in(?:to)? the public domain"),
    ("public-domain", 1, 0.85, "government", "work of the (?:united states|u s|us) government"),
]


class Rule:
    __slots__ = ("confidence", "keyword", "label", "pattern", "rank")

    def __init__(self, rank: int, confidence: float, label: str, keyword: str, pattern: str):
        self.rank, self.confidence, self.label, self.keyword = rank, confidence, label, keyword.encode()
        self.pattern = re.compile(rb"(?<= )" + pattern.encode() + rb"(?= )")


def rules() -> list[Rule]:
    """All signature rules, in order of rank; of one rank those of names come first, specific ones before others."""
    made = []
    for rank, confidence, form in FORMS:
        for label, keyword, names in FAMILIES:
            for name in names:
                if rank < 4 or " " in name.replace("(?: ", "(?:") or name in ("(?:the )?unlicense", "wtfpl"):
                    made.append(Rule(rank, confidence, label, keyword, form.format(n=f"(?:{name})")))
    made += [Rule(rank, confidence, label, keyword, pattern) for label, rank, confidence, keyword, pattern in SIGNATURES]
    return sorted(made, key=lambda x: x.rank)


#: All bytes that are not part of a word become blanks; A-Z are lower-cased.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    """Scans texts; one per Python worker."""

    def __init__(self):
        self.by_key: dict[bytes, list[tuple[int, Rule]]] = {}
        for order, rule in enumerate(rules()):
            self.by_key.setdefault(rule.keyword, []).append((order, rule))
        self.keys = frozenset(self.by_key)
        self.base = [(f" {p} ".encode(), label) for p, label in BASE]

    def scan(self, text: str | None) -> tuple:
        """n_words, base starts, base labels, kept detections (start, end, label, confidence)."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        here = self.keys.intersection(words)
        if not here:
            return len(words), [], set(), []
        data = b" " + b" ".join(words) + b" "
        blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        at, starts, labels = data.find, [], set()
        for phrase, label in self.base:
            p = at(phrase)
            while p >= 0:
                starts.append(p)
                labels.add(label)
                p = at(phrase, p + 1)
        found = []
        for order, rule in sorted((x for k in here for x in self.by_key[k]), key=lambda x: x[0]):
            for m in rule.pattern.finditer(data):
                found.append((m.start(), m.end(), rule.rank, order, rule))
        found.sort(key=lambda x: (x[2], x[0] - x[1], x[3]))
        kept, reach = [], Reach(sorted({x[0] for x in found}))
        for a, b, _, _, rule in found:
            if reach.upto(a) < b:
                reach.put(a, b)
                kept.append((a, b, rule))
        kept.sort(key=lambda x: x[:2])
        first = (np.searchsorted(blanks, [x[0] for x in kept]) - 1).tolist()
        last = np.searchsorted(blanks, [x[1] for x in kept]).tolist()
        return len(words), np.searchsorted(blanks, starts).tolist(), labels, [(a, b, r.label, r.confidence) for a, b, (_, _, r) in zip(first, last, kept, strict=True)]


class Reach:
    """The furthest end of the intervals put so far that start at or before a place, in logarithmic time."""

    def __init__(self, starts: list[int]):
        self.starts, self.tree = starts, [0] * (len(starts) + 1)

    def put(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], end)
            i += i & -i

    def upto(self, start: int) -> int:
        i, best = bisect_right(self.starts, start), 0
        while i:
            best = max(best, self.tree[i])
            i -= i & -i
        return best


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, labels, score, detections.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` tell of the
    base phrases; ``labels`` also of the rules. ``score`` is the highest
    confidence of a detection, 0 without any. ``detections`` lists
    label:start:end in words, end exclusive. Null and empty texts have no words
    and empty labels. Rows are independent, so repeated rows and null doc_ids
    come back as they are; other columns of ``docs`` are ignored.
    """

    def run(batches):
        scan = held("licences", Scanner).scan
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, starts, base, found = scan(text.as_py())
                labels = ",".join(sorted(base | {x[2] for x in found}))
                score = max([0.6] * bool(base) + [x[3] for x in found], default=0.0)
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, score, ",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in found)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
