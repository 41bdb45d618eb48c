"""Hand-written license signatures.

A rule is written ``priority | keyword | label | regex`` and matches the document's
words, lower-cased and joined by single spaces; any match holds the ``keyword`` word
(one of several, with slashes).  Lower priorities win: 1 identifiers, 2 full names with a version, 3 names,
4 families and general wording.  ``{v}`` stands for each version listed after ``;``
(a version 2.0 is the words "2 0"), once in the label and once in the regex.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

RULES_TEXT = r"""
1 | spdx | mit | spdx license identifier mit
1 | spdx | mit-0 | spdx license identifier mit 0
1 | spdx | isc | spdx license identifier isc
1 | spdx | zlib | spdx license identifier zlib
1 | spdx | unlicense | spdx license identifier unlicense
1 | spdx | wtfpl | spdx license identifier wtfpl
1 | spdx | bsd-2-clause | spdx license identifier bsd 2 clause
1 | spdx | bsd-3-clause | spdx license identifier bsd 3 clause
1 | spdx | bsd-4-clause | spdx license identifier bsd 4 clause
1 | spdx | 0bsd | spdx license identifier 0bsd
1 | spdx | bsl-1.0 | spdx license identifier bsl 1 0
1 | spdx | ncsa | spdx license identifier ncsa
1 | spdx | postgresql | spdx license identifier postgresql
1 | spdx | python-2.0 | spdx license identifier python 2 0
1 | spdx | artistic-{v} | spdx license identifier artistic {v} ; 1.0 2.0
1 | spdx | apache-{v} | spdx license identifier apache {v} ; 1.0 1.1 2.0
1 | spdx | gpl-{v}-only | spdx license identifier gpl {v}(?: only)?(?! or later) ; 1.0 2.0 3.0
1 | spdx | gpl-{v}-or-later | spdx license identifier gpl {v} or later ; 1.0 2.0 3.0
1 | spdx | lgpl-{v}-only | spdx license identifier lgpl {v}(?: only)?(?! or later) ; 2.0 2.1 3.0
1 | spdx | lgpl-{v}-or-later | spdx license identifier lgpl {v} or later ; 2.0 2.1 3.0
1 | spdx | agpl-{v}-only | spdx license identifier agpl {v}(?: only)?(?! or later) ; 1.0 3.0
1 | spdx | agpl-{v}-or-later | spdx license identifier agpl {v} or later ; 1.0 3.0
1 | spdx | mpl-{v} | spdx license identifier mpl {v} ; 1.0 1.1 2.0
1 | spdx | epl-{v} | spdx license identifier epl {v} ; 1.0 2.0
1 | spdx | eupl-{v} | spdx license identifier eupl {v} ; 1.0 1.1 1.2
1 | spdx | cddl-{v} | spdx license identifier cddl {v} ; 1.0 1.1
1 | spdx | cc0-1.0 | spdx license identifier cc0 1 0
1 | spdx | cc-by-{v} | spdx license identifier cc by {v} ; 1.0 2.0 2.5 3.0 4.0
1 | spdx | cc-by-sa-{v} | spdx license identifier cc by sa {v} ; 1.0 2.0 2.5 3.0 4.0
1 | spdx | cc-by-nd-{v} | spdx license identifier cc by nd {v} ; 1.0 2.0 2.5 3.0 4.0
1 | spdx | cc-by-nc-{v} | spdx license identifier cc by nc {v} ; 1.0 2.0 2.5 3.0 4.0
1 | spdx | cc-by-nc-sa-{v} | spdx license identifier cc by nc sa {v} ; 1.0 2.0 2.5 3.0 4.0
1 | spdx | cc-by-nc-nd-{v} | spdx license identifier cc by nc nd {v} ; 1.0 2.0 2.5 3.0 4.0
1 | spdx | ofl-{v} | spdx license identifier ofl {v} ; 1.0 1.1
1 | spdx | odbl-1.0 | spdx license identifier odbl 1 0
2 | apache | apache-{v} | apache(?: software)? licen[sc]e(?: version)? {v} ; 1.0 1.1 2.0
2 | apache | apache-2.0 | apache(?: software)? licen[sc]e(?: version)? 2(?! \d)
2 | apache | apache-2.0 | www apache org licenses license 2 0
2 | apache | apache-{v} | apache {v} licen[sc]e ; 1.0 1.1 2.0
2 | permission | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 | permission | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 | redistribution | bsd-2-clause | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
2 | endorse | bsd-3-clause | neither the name of .{1,80}? may be used to endorse or promote products derived from this software
2 | advertising | bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 | bsd | bsd-2-clause | (?:2|two) clause bsd(?: licen[sc]e)?
2 | bsd | bsd-3-clause | (?:3|three) clause bsd(?: licen[sc]e)?
2 | bsd | bsd-4-clause | (?:4|four) clause bsd(?: licen[sc]e)?
2 | bsd | bsd-2-clause | bsd 2 clause(?: licen[sc]e)?
2 | bsd | bsd-3-clause | bsd 3 clause(?: licen[sc]e)?
2 | bsd | bsd-4-clause | bsd 4 clause(?: licen[sc]e)?
2 | bsd | bsd-2-clause | simplified bsd licen[sc]e
2 | bsd | bsd-3-clause | (?:new|modified|revised) bsd licen[sc]e
2 | bsd | bsd-4-clause | (?:original|old) bsd licen[sc]e
2 | bsd | 0bsd | (?:zero|0) clause bsd(?: licen[sc]e)?
2 | gnu | gpl-{v} | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version {v} ; 1 2 3
2 | gnu | lgpl-{v} | gnu (?:lesser|library) general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version {v} ; 2 2.1 3
2 | gnu | agpl-{v} | gnu affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version {v} ; 1 3
2 | gnu | gfdl-{v} | gnu free documentation licen[sc]e version {v} ; 1.1 1.2 1.3
2 | gnu | gpl-{v} | gnu gpl v?{v} ; 1 2 3
2 | gnu | lgpl-{v} | gnu lgpl v?{v} ; 2 2.1 3
2 | gnu | agpl-{v} | gnu agpl v?{v} ; 1 3
2 | gplv{v} | gpl-{v} | gplv{v} ; 1 2 3
2 | lgplv{v} | lgpl-{v} | lgplv{v} ; 2 3
2 | agplv{v} | agpl-{v} | agplv{v} ; 1 3
2 | gpl | gpl-{v} | gpl(?: version)? {v} ; 1 2 3
2 | lgpl | lgpl-{v} | lgpl(?: version)? {v} ; 2 2.1 3
2 | agpl | agpl-{v} | agpl(?: version)? {v} ; 1 3
2 | mozilla | mpl-{v} | mozilla public licen[sc]e(?: version| v)? {v} ; 1.0 1.1 2.0
2 | mpl | mpl-{v} | mpl {v} ; 1.0 1.1 2.0
2 | eclipse | epl-{v} | eclipse public licen[sc]e(?: version| v)? {v} ; 1.0 2.0
2 | epl | epl-{v} | epl {v} ; 1.0 2.0
2 | cddl | cddl-{v} | cddl(?: version)? {v} ; 1.0 1.1
2 | european | eupl-{v} | european union public licen[sc]e(?: version| v)? {v} ; 1.0 1.1 1.2
2 | boost | bsl-1.0 | boost software licen[sc]e version 1 0
2 | artistic | artistic-{v} | artistic licen[sc]e(?: version)? {v} ; 1.0 2.0
2 | academic | afl-{v} | academic free licen[sc]e(?: version)? {v} ; 1.1 1.2 2.0 2.1 3.0
2 | open | osl-{v} | open software licen[sc]e(?: version)? {v} ; 1.0 1.1 2.0 2.1 3.0
2 | python | python-2.0 | python software foundation licen[sc]e version 2
2 | sil | ofl-{v} | sil open font licen[sc]e(?: version)? {v} ; 1.0 1.1
2 | cc | cc-by-{v} | cc by {v} ; 1.0 2.0 2.5 3.0 4.0
2 | cc | cc-by-sa-{v} | cc by sa {v} ; 1.0 2.0 2.5 3.0 4.0
2 | cc | cc-by-nd-{v} | cc by nd {v} ; 1.0 2.0 2.5 3.0 4.0
2 | cc | cc-by-nc-{v} | cc by nc {v} ; 1.0 2.0 2.5 3.0 4.0
2 | cc | cc-by-nc-sa-{v} | cc by nc sa {v} ; 1.0 2.0 2.5 3.0 4.0
2 | cc | cc-by-nc-nd-{v} | cc by nc nd {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creativecommons | cc-by-{v} | creativecommons org licenses by {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creativecommons | cc-by-sa-{v} | creativecommons org licenses by sa {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creativecommons | cc-by-nd-{v} | creativecommons org licenses by nd {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creativecommons | cc-by-nc-{v} | creativecommons org licenses by nc {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creativecommons | cc-by-nc-sa-{v} | creativecommons org licenses by nc sa {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creativecommons | cc-by-nc-nd-{v} | creativecommons org licenses by nc nd {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creativecommons | cc0-1.0 | creativecommons org publicdomain zero 1 0
2 | creative | cc-by-{v} | creative commons attribution {v}(?: international| unported| generic)? ; 1.0 2.0 2.5 3.0 4.0
2 | creative | cc-by-sa-{v} | creative commons attribution share ?alike {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creative | cc-by-nd-{v} | creative commons attribution no ?deriv(?:ative)?s {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creative | cc-by-nc-{v} | creative commons attribution non ?commercial {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creative | cc-by-nc-sa-{v} | creative commons attribution non ?commercial share ?alike {v} ; 1.0 2.0 2.5 3.0 4.0
2 | creative | cc-by-nc-nd-{v} | creative commons attribution non ?commercial no ?deriv(?:ative)?s {v} ; 1.0 2.0 2.5 3.0 4.0
2 | open | odbl-1.0 | open (?:data commons open )?database licen[sc]e v?1 0
2 | open | odc-by-1.0 | open data commons attribution licen[sc]e v?1 0
2 | government | ogl-{v} | open government licen[sc]e(?: version| v)? ?{v} ; 1.0 2.0 3.0
3 | license/licence | mit | (?:the )?mit licen[sc]e
3 | licensed/licenced | mit | licen[sc]ed under(?: the)? mit
3 | attribution | mit-0 | mit no attribution
3 | expat | mit | expat licen[sc]e
3 | x11 | x11 | x11 licen[sc]e
3 | isc | isc | isc licen[sc]e
3 | zlib | zlib | zlib(?: libpng)? licen[sc]e
3 | unencumbered | unlicense | free and unencumbered software released into the public domain
3 | wtfpl | wtfpl | wtfpl
3 | beerware | beerware | beerware licen[sc]e
3 | ncsa | ncsa | university of illinois ncsa open source licen[sc]e
3 | postgresql | postgresql | postgresql licen[sc]e
3 | php | php | php licen[sc]e
3 | ruby | ruby | ruby licen[sc]e
3 | perl | perl | same terms as perl itself
3 | openssl | openssl | openssl licen[sc]e
3 | sleepycat | sleepycat | sleepycat licen[sc]e
3 | vim | vim | vim licen[sc]e
3 | w3c | w3c | w3c software(?: and document)?(?: notice and)? licen[sc]e
3 | unicode | unicode | unicode(?: data files and software)? licen[sc]e
3 | curl | curl | curl licen[sc]e
3 | json | json | json licen[sc]e
3 | evil | json | software shall be used for good not evil
3 | intel | intel | intel open source licen[sc]e
3 | ibm | ipl-1.0 | ibm public licen[sc]e
3 | common | cpl-1.0 | common public licen[sc]e
3 | common | cddl | common development and distribution licen[sc]e
3 | microsoft | ms-pl | microsoft public licen[sc]e
3 | microsoft | ms-rl | microsoft reciprocal licen[sc]e
3 | sun | sissl | sun industry standards source licen[sc]e
3 | qt | qpl-1.0 | q public licen[sc]e qt
3 | netscape | npl-1.1 | netscape public licen[sc]e
3 | nokia | nokia | nokia open source licen[sc]e
3 | zope | zpl | zope public licen[sc]e
3 | latex | lppl | latex project public licen[sc]e
3 | elastic | elastic-2.0 | elastic licen[sc]e
3 | sspl | sspl-1.0 | sspl
3 | server | sspl-1.0 | server side public licen[sc]e
3 | business | busl-1.1 | business source licen[sc]e
3 | commons | commons-clause | commons clause licen[sc]e condition
3 | polyform | polyform | polyform (?:noncommercial|shield|strict|small business|free trial|internal use|perimeter) licen[sc]e
3 | hippocratic | hippocratic | hippocratic licen[sc]e
3 | rail/openrail | openrail | (?:creativeml )?open ?rail(?: [ms]| plus plus)? licen[sc]e
3 | llama | llama | llama(?: \d)? community licen[sc]e
3 | bigscience | bigscience-rail | bigscience rail licen[sc]e
3 | bigcode | bigcode-openrail | bigcode open ?rail
3 | community | cdla | community data licen[sc]e agreement
3 | mulan | mulan-psl | mulan permissive software licen[sc]e
3 | upl | upl-1.0 | universal permissive licen[sc]e upl
3 | blue | blueoak-1.0 | blue oak model licen[sc]e
3 | educational | ecl-2.0 | educational community licen[sc]e
3 | etalab | etalab-2.0 | licence ouverte etalab
3 | cecill | cecill | cecill(?: [bc])?(?: licen[sc]e)?
3 | affero | agpl | gnu affero general public licen[sc]e
3 | lesser | lgpl | gnu lesser general public licen[sc]e
3 | library | lgpl | gnu library general public licen[sc]e
3 | gnu | gpl | gnu general public licen[sc]e
3 | gnu | gfdl | gnu free documentation licen[sc]e
3 | gnu | gnu-all-permissive | gnu all permissive licen[sc]e
3 | mozilla | mpl | mozilla public licen[sc]e
3 | eclipse | epl | eclipse public licen[sc]e
3 | european | eupl | european union public licen[sc]e
3 | apache | apache | apache(?: software)? licen[sc]e
3 | boost | bsl-1.0 | boost software licen[sc]e
3 | artistic | artistic | artistic licen[sc]e
3 | academic | afl | academic free licen[sc]e
3 | bsd | bsd | bsd(?: style)? licen[sc]e
3 | sil | ofl | sil open font licen[sc]e
3 | python | python | python software foundation licen[sc]e
3 | cc0 | cc0 | cc0
3 | cc | cc-by | cc by
3 | cc | cc-by-sa | cc by sa
3 | cc | cc-by-nd | cc by nd
3 | cc | cc-by-nc | cc by nc
3 | cc | cc-by-nc-sa | cc by nc sa
3 | cc | cc-by-nc-nd | cc by nc nd
3 | creative | cc-by | creative commons attribution
3 | creative | cc-by-sa | creative commons attribution share ?alike
3 | creative | cc-by-nd | creative commons attribution no ?deriv(?:ative)?s
3 | creative | cc-by-nc | creative commons attribution non ?commercial
3 | creative | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike
3 | creative | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s
3 | open | odbl | open database licen[sc]e
3 | government | ogl | open government licen[sc]e
3 | domain | public-domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
3 | domain | public-domain | dedicate any and all copyright interest in the software to the public domain
4 | gpl | gpl | gpl
4 | lgpl | lgpl | lgpl
4 | agpl | agpl | agpl
4 | creative | creative-commons | creative commons licen[sc]e
4 | commons | creative-commons | (?:under|by) (?:a )?creative commons
4 | domain | public-domain | in the public domain
4 | warranty | warranty-disclaimer | the software is provided as is without warranty of any kind
4 | warranty | warranty-disclaimer | without any warranty without even the implied warranty of merchantability
4 | reserved | all-rights-reserved | all rights reserved
4 | proprietary | proprietary | proprietary and confidential
4 | confidential | proprietary | this software is (?:the )?confidential and proprietary
4 | redistribution | proprietary | redistribution (?:is )?(?:strictly )?prohibited
4 | unauthorized | proprietary | unauthorized (?:copying|use|reproduction|distribution)(?: of)? .{0,60}?prohibited
4 | commercial | non-commercial | for non ?commercial (?:use|purposes) only
4 | noncommercial | non-commercial | noncommercial (?:use|purposes) only
4 | personal | non-commercial | for personal use only
4 | educational | non-commercial | for educational (?:use|purposes) only
4 | academic | non-commercial | for academic (?:use|purposes) only
4 | evaluation | evaluation | for evaluation purposes only
4 | freeware | freeware | freeware
4 | shareware | shareware | shareware
4 | commercially | commercial | commercially licensed
4 | commercial | commercial | commercial licen[sc]e
4 | dual | dual-license | dual licen[sc]ed
4 | user | eula | end user licen[sc]e agreement
"""

#: Share of certainty a detection of a priority stands for.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.6}


@dataclass(frozen=True)
class Rule:
    order: int
    priority: int
    keywords: tuple[str, ...]
    label: str
    regex: re.Pattern


def load_rules(text: str = RULES_TEXT) -> list[Rule]:
    """Rules in order, versions written out.  Words are joined by single blanks; other white space
    is part of a word, so only a blank ends one."""
    out: list[Rule] = []
    for line in text.strip().splitlines():
        priority, keyword, label, regex = (x.strip() for x in line.split(" | ", 3))
        regex, _, versions = regex.partition(" ; ")
        for v in versions.split() or [""]:
            words = v.replace(".", " ")
            body = regex.replace("{v}", words)
            out.append(Rule(len(out), int(priority), tuple(keyword.replace("{v}", words).split("/")), label.replace("{v}", v),
                            re.compile(rf"(?<![^ ])(?:{body})(?![^ ])")))
    return out
