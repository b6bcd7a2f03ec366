"""Signature rules of licences: word patterns, each with a keyword that a text must hold for the rule to be tried.

A pattern is a row of words; a word is a regular expression over one word of the text, `x~` may be
absent, `a ?b` may be written as one, and `*n` stands for n words at most. compiled() makes it a
regular expression over texts whose words each carry their place and stand between spaces of
their own (" mit#4  license#5 "), so that a match says where it is and shares nothing with the next.
"""

from __future__ import annotations

from typing import NamedTuple

#: Ranks: a notice that names an exact licence, a licence's name, and words that only hint at one.
EXACT, NAME, HINT = 0, 1, 2

# Names of licences and their published versions.
# label | keyword (see Rule) | words of the name | versions
FAMILIES = """
agpl | affero | gnu~ affero general public licen[cs]e | 1.0 3.0
lgpl | lesser+licen | gnu~ lesser general public licen[cs]e | 2.1 3.0
lgpl | library+licen | gnu~ library general public licen[cs]e | 2.0
gpl | gnu | gnu general public licen[cs]e | 1.0 2.0 3.0
gpl | gpl | gnu~ gpl | 1.0 2.0 3.0
lgpl | lgpl | gnu~ lgpl | 2.0 2.1 3.0
agpl | agpl | gnu~ agpl | 1.0 3.0
gfdl | documentation+licen | gnu~ free documentation licen[cs]e | 1.1 1.2 1.3
apache | apache | apache software~ licen[cs]e | 1.0 1.1 2.0
mpl | mozilla | mozilla public licen[cs]e | 1.0 1.1 2.0
epl | eclipse | eclipse public licen[cs]e | 1.0 2.0
edl | eclipse | eclipse distribution licen[cs]e | 1.0
cddl | development+licen | common development and distribution licen[cs]e | 1.0 1.1
cpl | common+licen | common public licen[cs]e | 1.0
cpal | attribution+licen | common public attribution licen[cs]e | 1.0
ipl | ibm+licen | ibm public licen[cs]e | 1.0
eupl | european+licen | european union public licen[cs]e | 1.0 1.1 1.2
osl | licen | open software licen[cs]e | 1.0 2.0 2.1 3.0
afl | academic+licen | academic free licen[cs]e | 1.1 1.2 2.0 2.1 3.0
artistic | artistic+licen | the~ artistic licen[cs]e | 1.0 2.0
bsl | boost+licen | boost software licen[cs]e | 1.0
busl | business+licen | business source licen[cs]e | 1.1
sspl | server+licen | server side public licen[cs]e | 1.0
elastic | elastic+licen | elastic licen[cs]e | 2.0
zpl | zope | zope public licen[cs]e | 1.1 2.0 2.1
php | php+licen | php licen[cs]e | 3.0 3.01
psf | python+licen | python software foundation licen[cs]e | 2.0
python | python+licen | python licen[cs]e | 2.0
qpl | licen | q public licen[cs]e | 1.0
lppl | latex+licen | latex project public licen[cs]e | 1.0 1.1 1.2 1.3
ofl | font+licen | sil~ open font licen[cs]e | 1.0 1.1
odbl | database+licen | open database licen[cs]e | 1.0
odc-by | commons+licen | open data commons attribution licen[cs]e | 1.0
pddl | dedication+licen | public domain dedication and licen[cs]e | 1.0
ms-pl | microsoft+licen | microsoft public licen[cs]e |
ms-rl | microsoft+licen | microsoft reciprocal licen[cs]e |
apsl | apple+licen | apple public source licen[cs]e | 1.0 1.1 1.2 2.0
nasa | nasa | nasa open source agreement | 1.3
spl | licen | sun public licen[cs]e | 1.0
w3c | w3c | w3c software notice~ and~ document~ licen[cs]e |
unlicense | unlicense | the unlicense |
wtfpl | want+licen | do what the *1 you want to public licen[cs]e | 1.0 2.0
isc | isc+licen | isc licen[cs]e |
mit | mit licen | mit licen[cs]e |
mit | expat+licen | expat licen[cs]e |
x11 | x11+licen | x11 licen[cs]e |
zlib | zlib | zlib libpng~ licen[cs]e |
ncsa | illinois+licen | university of illinois ncsa~ open source licen[cs]e |
postgresql | postgresql | postgresql licen[cs]e |
openssl | openssl | openssl licen[cs]e |
ruby | ruby+licen | ruby licen[cs]e |
vim | vim+licen | vim licen[cs]e |
curl | curl+licen | curl licen[cs]e |
upl | permissive+licen | universal permissive licen[cs]e | 1.0
ecl | educational+licen | educational community licen[cs]e | 1.0 2.0
cecill | cecill | cecill free~ software~ licen[cs]e~ | 1.0 2.0 2.1
mulanpsl | mulan | mulan permissive software licen[cs]e | 1.0 2.0
blueoak | oak+licen | blue oak model licen[cs]e | 1.0.0
json | json+licen | json licen[cs]e |
beerware | beer | beer ?ware licen[cs]e |
bsd | bsd | (?:new|modified|simplified|revised)~ bsd style~ licen[cs]e |
bsd-0-clause | bsd | (?:zero|0) clause bsd licen[cs]e~ |
bsd-2-clause | bsd | (?:two|2) clause bsd licen[cs]e~ |
bsd-3-clause | bsd | (?:three|3) clause bsd licen[cs]e~ |
bsd-4-clause | bsd | (?:four|4) clause bsd licen[cs]e~ |
cc0 | cc0 | cc0 | 1.0
cc0 | creative+commons | creative commons zero | 1.0
cc-by | cc by | cc by | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | cc by | cc by sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | cc by | cc by nc | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | cc by | cc by nd | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | cc by | cc by nc sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | cc by | cc by nc nd | 1.0 2.0 2.5 3.0 4.0
cc-by | creative+commons | creative commons attribution | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | creative+commons | creative commons attribution share ?alike | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | creative+commons | creative commons attribution (?:noncommercial|non) commercial~ | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | creative+commons | creative commons attribution (?:noderivs|noderivatives|no) (?:derivs|derivatives)~ | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | creative+commons | creative commons attribution (?:noncommercial|non) commercial~ share ?alike | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | creative+commons | creative commons attribution (?:noncommercial|non) commercial~ (?:noderivs|noderivatives|no) (?:derivs|derivatives)~ | 1.0 2.0 2.5 3.0 4.0
"""

# Sentences of licences and of notices.
# label | rank | keyword | words
SENTENCES = """
mit | 0 | permission+hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and~ associated~ documentation~ files~
mit | 0 | warranty+merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
apache-2.0 | 0 | compliance+licen | you may not use this *2 except in compliance with the licen[cs]e
apache-2.0 | 0 | apache | apache org licen[cs]es licen[cs]e 2 0
apache | 1 | apache | apache version~ v?2 0~
asf | 1 | apache | licen[cs]ed to the apache software foundation
gpl | 0 | redistribute+licen | this *2 is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | 0 | redistribute+licen | this *2 is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
gpl-2.0-or-later | 0 | option+licen | either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later | 0 | option+licen | either version 3 of the licen[cs]e or at your option any later version
gpl-1.0 | 0 | gplv1 | gplv1
gpl-2.0 | 0 | gplv2 | gplv2
gpl-3.0 | 0 | gplv3 | gplv3
lgpl-2.1 | 0 | lgplv2 | lgplv2 1~
lgpl-3.0 | 0 | lgplv3 | lgplv3
agpl-3.0 | 0 | agplv3 | agplv3
gpl | 1 | gnu | gnu org licen[cs]es gpl
lgpl | 1 | gnu | gnu org licen[cs]es lgpl
agpl | 1 | gnu | gnu org licen[cs]es agpl
gpl | 2 | received+licen | you should have received a copy of the gnu general public licen[cs]e along with
bsd | 0 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 0 | endorse | neither the names? *12 may be used to endorse or promote products derived from this software
bsd-4-clause | 0 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 1 | freebsd | freebsd licen[cs]e
isc | 0 | permission+hereby | permission to use copy modify and or~ distribute this software for any purpose with or without fee is hereby granted
zlib | 0 | held+liable | in no event will the authors be held liable for any damages arising from the use of this software
bsl-1.0 | 0 | organization+hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
unlicense | 0 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 0 | unlicense | unlicense org
wtfpl | 0 | wtfpl | wtfpl
wtfpl | 0 | just+want | you just do what the *1 you want to
beerware | 0 | beer | you can buy me a beer in return
mpl-1.1 | 0 | mozilla | contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-2.0 | 0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 | 0 | mozilla | mozilla org mpl 2 0
epl | 1 | eclipse | eclipse org legal epl v10
epl-2.0 | 0 | eclipse | eclipse org legal epl 2 0
artistic | 0 | redistribute+perl | you can redistribute it and or modify it under the same terms as perl itself
json | 0 | evil+good | the software shall be used for good not evil
ofl-1.1 | 0 | scripts+sil | scripts sil org ofl
cc0-1.0 | 0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 0 | creativecommons | creativecommons org publicdomain mark 1 0
cc | 1 | creative+commons | creative commons licen[cs]es?
cc | 2 | creative+commons | some rights reserved creative commons
public-domain | 1 | public+domain | (?:released|placed|dedicated) *4 (?:into|in|to) the public domain
public-domain | 1 | public+domain | (?:is|are) in the public domain
commons-clause | 0 | commons+clause | commons clause licen[cs]e~ condition~
proprietary | 1 | proprietary | proprietary and confidential
proprietary | 1 | proprietary | proprietary licen[cs]e
all-rights-reserved | 2 | rights+reserved | all rights reserved
free-licence | 2 | copyleft | copyleft licen[cs]es?
notice | 2 | licen | (?:dual|triple) licen[cs]ed
notice | 2 | licen | licen[cs]ed under (?:the|a|an)~
notice | 2 | licen | (?:released|distributed|published|available) under the~ terms~ of~ (?:the|a|an) *3 licen[cs]e
notice | 2 | licen | see the~ licen[cs]e file for details
notice | 2 | spdx | spdx licen[cs]e identifier
"""


class Rule(NamedTuple):
    """keyword: what a text must hold, `a+b` both somewhere, `a b` a word that ends in a and then one that begins with b."""

    keyword: str
    rank: int
    number: int
    label: str
    regex: str


def compiled(words: str) -> str:
    """The pattern as a regular expression, which Java and RE2 read alike, over words marked with their places."""
    out = []
    for word in words.replace(" ?", "\0").split(" "):
        if word.startswith("*"):
            out.append(f"(?: [^ ]+ ){{0,{word[1:]}}}")
            continue
        may, word = word.endswith("~"), word.removesuffix("~")
        ways = [word.split("\0"), [word.replace("\0", "")]] if "\0" in word else [[word]]
        joined = "|".join("".join(rf" {w}#\d+ " for w in way) for way in ways)
        out.append(f"(?:{joined}){'?' if may else ''}" if may or len(ways) > 1 else joined)
    return "".join(out)


def parsed(table: str, columns: int) -> list[list[str]]:
    """The table's lines; a bar inside brackets belongs to its pattern."""
    out = []
    for line in table.strip().splitlines():
        cells, depth = [""], 0
        for c in line:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                cells.append("")
            else:
                cells[-1] += c
        if len(cells) != columns:
            raise ValueError(f"{columns} columns are needed: {line}")
        out.append([cell.strip() for cell in cells])
    return out


def rules() -> list[Rule]:
    """All rules in order; of equal detections the first counts.

    A family gives its name, the name after words that grant something, and for each version the
    name before or behind it and the licence's identifier.
    """
    found: list[tuple[str, int, str, str]] = []
    for label, rank, keyword, words in parsed(SENTENCES, 4):
        found.append((keyword, int(rank), label, words))
    for label, keyword, name, versions in parsed(FAMILIES, 4):
        short = label.replace("-", " ")
        for version in versions.split():
            first, *rest = version.split(".")
            number = " ".join([f"v?{first}", *(f"{x}~" if x == "0" else x for x in rest)])
            exact = f"{label}-{version}"
            found.append((keyword, EXACT, exact, f"{name} (?:version|ver|v)~ {number}"))
            found.append((keyword, EXACT, exact, f"version {number} of the~ {name}"))
            if keyword in ("cc by", "cc0"):
                by = short.removeprefix("cc ")
                found.append(("creativecommons", EXACT, exact, f"creativecommons org licen[cs]es {by} {version.replace('.', ' ')}"))
            found.append(("spdx", EXACT, exact, f"spdx licen[cs]e identifier {short} {version.replace('.', ' ')} (?:only|or)~ later~"))
        if not versions:
            found.append(("spdx", EXACT, label, f"spdx licen[cs]e identifier {short}"))
        found.append((keyword, NAME, label, f"(?:licen[cs]ed|released|distributed|available|published|provided) under the~ terms~ of~ the~ {name}"))
        found.append((keyword, NAME, label, name))
    known = dict.fromkeys(found)  # two families of one label share identifiers
    return [Rule(keyword, rank, i, label, compiled(words)) for i, (keyword, rank, label, words) in enumerate(known)]
