"""The signature rules of the licence scan: patterns over normal words, written by hand.

Four sources: names of licences in several ways of pointing to them, identifiers in SPDX expressions, sentences of the
licences' own texts, and notices.  Each line has label | keyword | pattern; the keyword stands after a blank in every text
that the pattern fits (a slash parts keywords of which one does), so it is the beginning of a word, or of several.
"""

from __future__ import annotations

from itertools import groupby

#: label | keyword | names, as regular expressions over words.  Longer, more exact names stand first.
NAMES = """
agpl-3|affero|gnu affero general public license(?: version 3| v3)?
agpl-3|agpl|agpl(?: ?v?3)?(?: 0)?
lgpl-3|lesser|gnu lesser general public license,? (?:version 3|v3)
lgpl-2.1|lesser|gnu lesser general public license (?:version 2 1|v2 1)
lgpl|lesser|(?:gnu )?lesser general public license
lgpl|lgpl|lgpl(?: ?v?(?:2 1|3))?
gpl-3|general public|gnu general public license (?:version 3|v3)
gpl-3|gpl|(?:gnu )?gpl ?(?:version |v)?3(?: 0)?
gpl-2|general public|gnu general public license (?:version 2|v2)
gpl-2|gpl|(?:gnu )?gpl ?(?:version |v)?2(?: 0)?
gpl|general public|(?:gnu )?general public license
apache-2|apache|apache (?:software )?license(?: version)? 2(?: 0)?
apache-2|apache|apache 2 0
apache-1.1|apache|apache (?:software )?license(?: version)? 1 1
apache-1|apache|apache (?:software )?license(?: version)? 1 0
mit|mit licen|(?:the )?mit licen[cs]e
mit|expat|expat licen[cs]e
isc|isc licen|isc licen[cs]e
bsd-2|bsd|(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd-2|freebsd|freebsd(?: licen[cs]e)?
bsd-3|bsd|(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-4|bsd|(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
0bsd|bsd|(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
0bsd|0bsd|0bsd(?: licen[cs]e)?
bsd|bsd|bsd(?: style)? licen[cs]e
mpl-2|mozilla|mozilla public license(?: version| v)? 2(?: 0)?
mpl-1.1|mozilla|mozilla public license(?: version| v)? 1 1
mpl|mpl|mpl(?: [12] [01])?
epl-2|eclipse|eclipse public license(?: version| v)? 2(?: 0)?
epl-1|eclipse|eclipse public license(?: version| v)? 1(?: 0)?
edl-1|eclipse|eclipse distribution license(?: version| v)? 1(?: 0)?
cddl|cddl|cddl(?: 1 [01])?
cddl|distribution license|common development and distribution license
cpl-1|common|common public license(?: version)?(?: 1 0)?
eupl|european|european union public licen[cs]e
cecill|cecill|cecill(?: [abc])?(?: 2 [01])?
artistic-2|artistic|artistic license 2(?: 0)?
artistic|artistic|artistic license
boost-1|boost software|boost software license(?: version)?(?: 1 0)?
zlib|zlib|zlib(?: libpng)? license
libpng|libpng|libpng license
openssl|openssl|openssl license
php-3|php|php license(?: version)?(?: 3 01?)?
python-2|python|python software foundation license(?: version)?(?: 2)?
python-2|psf|psf license(?: version)?(?: 2)?
ruby|ruby|ruby license
postgresql|postgresql|postgresql license
unlicense|unlicense|(?:the )?unlicense
wtfpl|wtfpl|wtfpl
wtfpl|want to public|do what the [a-z]+ you want to public license
cc0|cc0|cc0(?: 1 0)?(?: universal)?
cc0|creative|creative commons zero
cc-by-nc-nd|cc by/creative|(?:cc|creative commons) by nc nd(?: [1-4] [05])?
cc-by-nc-nd|noderivatives|creative commons attribution noncommercial noderivatives(?: [1-4] [05])?
cc-by-nc-sa|cc by/creative|(?:cc|creative commons) by nc sa(?: [1-4] [05])?
cc-by-nc-sa|sharealike|creative commons attribution noncommercial sharealike(?: [1-4] [05])?
cc-by-nc|cc by/creative|(?:cc|creative commons) by nc(?: [1-4] [05])?
cc-by-nc|noncommercial|creative commons attribution noncommercial(?: [1-4] [05])?
cc-by-nd|cc by/creative|(?:cc|creative commons) by nd(?: [1-4] [05])?
cc-by-sa|cc by/creative|(?:cc|creative commons) by sa(?: [1-4] [05])?
cc-by-sa|sharealike|creative commons attribution sharealike(?: [1-4] [05])?
cc-by|cc by/creative|(?:cc|creative commons) by(?: [1-4] [05])?
cc-by|attribution|creative commons attribution(?: [1-4] [05])?
ofl-1.1|ofl |(?:sil )?ofl(?: 1 1)?
ofl-1.1|font|(?:sil )?open font license(?: version)?(?: 1 1)?
odbl|open database|open database license
osl-3|open software|open software license(?: version)?(?: 3 0)?
afl-3|academic|academic free license(?: version)?(?: 3 0)?
ms-pl|microsoft|microsoft public license
ms-rl|microsoft|microsoft reciprocal license
public-domain|domain|public domain
proprietary|rights reserved|all rights reserved
""".strip().splitlines()

#: Ways in which a text names its licence: pattern around the name, priority, confidence.
FORMS = [
    ("(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{}", 40, 0.95),
    ("under the (?:terms (?:and conditions )?of the )?{}", 30, 0.9),
    ("(?:see|read|subject to|governed by) (?:the )?{}", 20, 0.8),
    ("{}", 10, 0.6),
]

#: label | identifier, as words.
SPDX = """
0bsd|0bsd
aal|aal
afl-3|afl 3 0
agpl-3|agpl 3 0(?: only| or later)?
apache-1|apache 1 0
apache-1.1|apache 1 1
apache-2|apache 2 0
artistic|artistic 1 0(?: perl)?
artistic-2|artistic 2 0
blueoak-1|blueoak 1 0 0
boost-1|bsl 1 0
bsd|bsd 1 clause
bsd-2|bsd 2 clause(?: patent| views)?
bsd-3|bsd 3 clause(?: clear| lbnl)?
bsd-4|bsd 4 clause(?: uc)?
busl-1.1|busl 1 1
cc0|cc0 1 0
cc-by|cc by (?:1|2|3|4) (?:0|5)
cc-by-nc|cc by nc (?:1|2|3|4) (?:0|5)
cc-by-nc-nd|cc by nc nd (?:1|2|3|4) (?:0|5)
cc-by-nc-sa|cc by nc sa (?:1|2|3|4) (?:0|5)
cc-by-nd|cc by nd (?:1|2|3|4) (?:0|5)
cc-by-sa|cc by sa (?:1|2|3|4) (?:0|5)
cddl|cddl 1 (?:0|1)
cecill|cecill (?:1 0|1 1|2 0|2 1|b|c)
cpl-1|cpl 1 0
curl|curl
ecl-2|ecl 2 0
edl-1|edl 1 0
epl-1|epl 1 0
epl-2|epl 2 0
elastic-2|elastic 2 0
eupl|eupl 1 (?:0|1|2)
fsfap|fsfap
ftl|ftl
gfdl|gfdl 1 (?:1|2|3)(?: only| or later)?
gpl-1|gpl 1 0(?: only| or later)?
gpl-2|gpl 2 0(?: only| or later)?
gpl-3|gpl 3 0(?: only| or later)?
hpnd|hpnd
icu|icu
ijg|ijg
ipl-1|ipl 1 0
isc|isc
lgpl-2|lgpl 2 0(?: only| or later)?
lgpl-2.1|lgpl 2 1(?: only| or later)?
lgpl-3|lgpl 3 0(?: only| or later)?
libpng|libpng(?: 2 0)?
lppl-1.3|lppl 1 3(?:a|c)
mit|mit
mit-0|mit 0
mpl-1.1|mpl 1 1
mpl-2|mpl 2 0(?: no copyleft exception)?
ms-pl|ms pl
ms-rl|ms rl
mulanpsl-2|mulanpsl 2 0
ncsa|ncsa
odbl|odbl 1 0
ofl-1.1|ofl 1 1(?: no rfn| rfn)?
openssl|openssl
osl-3|osl 3 0
php-3|php 3 01?
postgresql|postgresql
python-2|(?:python 2 0|psf 2 0)
qpl-1|qpl 1 0
ruby|ruby
sspl-1|sspl 1 0
tcl|tcl
unicode-3|unicode (?:3 0|dfs 2016)
unlicense|unlicense
upl-1|upl 1 0
vim|vim
w3c|w3c
wtfpl|wtfpl
x11|x11
zlib|zlib
zpl-2.1|zpl 2 1
classpath-exception|classpath exception 2 0
gcc-exception|gcc exception 3 1
llvm-exception|llvm exception
autoconf-exception|autoconf exception (?:2|3) 0
bison-exception|bison exception 2 2
font-exception|font exception 2 0
linux-syscall-note|linux syscall note
openssl-exception|openssl exception
""".strip().splitlines()
EXPRESSION = "spdx license identifier (?:(?:{every}) (?:and|or|with) )*{one}"

#: label | keyword | sentence of the licence's text.
TEXTS = """
mit|permission|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|merge publish|without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit|substantial|the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions
mit|noninfringement|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit-0|permission|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc|permission to|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd|permission to|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc|author disclaims|the software is provided as is and the author disclaims all warranties with regard to this software
bsd|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|redistributions|redistributions of source code must retain the (?:above )?copyright notice
bsd|redistributions|redistributions in binary form must reproduce the (?:above )?copyright notice
bsd-3|neither the name|neither the names? of (?:[a-z0-9]+ ){1,12}?nor the names of (?:its|any|their) contributors
bsd-4|advertising|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2|views and conclusions|the views and conclusions contained in the software and documentation are those of the authors
apache-2|apache|licensed under the apache license version 2 0 the license you may not use this file except in compliance
apache-2|apache|apache license version 2 0 january 2004
apache-2|apache|you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2|contributor|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2|prominent notices|you must cause any modified files to carry prominent notices stating that you changed the files
apache-1.1|apache software|this product includes software developed by the apache software foundation
gpl|is free software|this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2|general public|gnu general public license as published by the free software foundation version 2
gpl-2|general public|gnu general public license as published by the free software foundation either version 2
gpl-3|general public|gnu general public license as published by the free software foundation version 3
gpl-3|general public|gnu general public license as published by the free software foundation either version 3
gpl|general public|you should have received a copy of the gnu general public license along with this program
gpl|copyleft|the gnu general public license is a free copyleft license for software
gpl-2|freedom|the licenses for most software are designed to take away your freedom to share and change it
gpl-3|freedom|the licenses for most software and other practical works are designed to take away your freedom
lgpl|lesser|you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl-2.1|lesser|gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3|lesser|gnu lesser general public license as published by the free software foundation either version 3
lgpl|lesser|you should have received a copy of the gnu lesser general public license
lgpl-2|library general|gnu library general public license
agpl-3|affero|under the terms of the gnu affero general public license as published by the free software foundation
agpl-3|computer network|interacting with it remotely through a computer network
gpl|copyleft|copyleft license
gpl|special exception|as a special exception (?:if you|the) (?:link|copyright holders)
classpath-exception|linking this|linking this library statically or dynamically with other modules is making a combined work
mpl-2|mozilla|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2|mpl was|if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1|mozilla|the contents of this file are subject to the mozilla public license version 1 1
epl-2|eclipse|this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl-1|eclipse|this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
edl-1|eclipse|under the terms of the eclipse distribution license v (?:1 )?1 0
cddl|common|the contents of this file are subject to the terms of the common development and distribution license
boost-1|boost software|distributed under the boost software license version 1 0
boost-1|executable|unless such copies or derivative works are solely in the form of machine executable object code
zlib|misrepresented|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|altered|altered source versions must be plainly marked as such and must not be misrepresented
zlib|any damages|in no event will the authors be held liable for any damages arising from the use of this software
openssl|openssl|this product includes software developed by the openssl project
openssl|cryptographic software|this product includes cryptographic software written by eric young
python-2|psf|psf is making python available to licensee on an as is basis
python-2|psf|psf hereby grants licensee a nonexclusive royalty free world wide license
php-3|php|this product includes php software freely available from
artistic|standard version|you may distribute your modifications as a standard version
artistic-2|artistic|this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0
postgresql|permission to|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
unlicense|unencumbered|this is free and unencumbered software released into the public domain
unlicense|anyone is free|anyone is free to copy modify publish use compile sell or distribute this software
wtfpl|want to|you just do what the [a-z]+ you want to
cc0|dedicated|the person who associated a work with this deed has dedicated the work to the public domain
cc0|affirmer|affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by|creative|this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international |unported |generic )?license
cc-by-sa|creative|this work is licensed under a creative commons attribution share ?alike (?:[1-4] [05] )?(?:international |unported |generic )?license
cc-by-nc|creative|this work is licensed under a creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international |unported |generic )?license
cc-by-nd|creative|this work is licensed under a creative commons attribution no ?deriv(?:ative)?s (?:[1-4] [05] )?(?:international |unported |generic )?license
cc-by-nc-sa|creative|this work is licensed under a creative commons attribution non ?commercial share ?alike (?:[1-4] [05] )?(?:international |unported |generic )?license
cc-by-nc-nd|creative|this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1-4] [05] )?(?:international |unported |generic )?license
cc|creativecommons|creativecommons org licenses [a-z]+
ofl-1.1|font|this font software is licensed under the sil open font license
ofl-1.1|reserved font|with reserved font name
gfdl|documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl|invariant|with no invariant sections
odbl|open database|made available under the open database license
ms-pl|accompanying software|this license governs use of the accompanying software if you use the software you accept this license
sspl-1|server side|server side public license
busl-1.1|business source|business source license 1 1
elastic-2|managed service|you may not provide the software to third parties as a hosted or managed service
hpnd|permission to|permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
x11|x consortium|the name of the x consortium shall not be used in advertising
ncsa|ncsa|university of illinois (?:at urbana champaign )?ncsa open source license
jpeg|jpeg|this software is based in part on the work of the independent jpeg group
ftl|freetype|the freetype project license
bzip2|bzip2|bzip2 and libbzip2
vim|vim is|vim is charityware
beerware|beer ware|the beer ware license
json|evil|the software shall be used for good not evil
""".strip().splitlines()

#: label | keyword | notice.
NOTICES = """
copyright|copyright|copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright|copyright|copyright (?:c )?by
copyright|copyrighted|copyrighted (?:material|work)
copyright|copyright|portions copyright
proprietary|confidential|proprietary and confidential
proprietary|trade secret|trade secrets? of
proprietary|unauthorized|unauthorized (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? of this
proprietary|written|without (?:the )?(?:express )?(?:prior )?written (?:permission|consent)
proprietary|internal use|for internal use only
proprietary|redistribute|(?:do|may) not (?:be )?redistributed?
public-domain|dedicated|dedicated to the public domain
public-domain|the public domain|(?:released|placed) (?:in|into|to) the public domain
public-domain|known copyright|no known copyright restrictions
public-domain|government|work of the (?:u s|united states) government
dual|dual|dual licensed under
dual|either of the|under either of the following licenses
unlicensed|license|without (?:a|any) license
permissive|provided as|provided as is without (?:any )?warranty
source-available|source available|source available license
eula|end user|end user license agreement
""".strip().splitlines()


def rules() -> list[tuple[str, str, str, int, float]]:
    """label, keyword, pattern over ' word word ', priority, confidence."""
    found = []
    for line in NAMES:
        label, keyword, name = line.split("|", 2)
        found += [(label, keyword, form.format(f"(?:{name})"), priority, sure) for form, priority, sure in FORMS]
    ids = [line.split("|", 1) for line in SPDX]
    every = "|".join(one for _, one in ids)
    found += [(label, "spdx", EXPRESSION.format(every=every, one=one), 60, 0.99) for label, one in ids]
    for lines, priority, sure in ((TEXTS, 50, 0.97), (NOTICES, 5, 0.5)):
        found += [(*line.split("|", 2), priority, sure) for line in lines]
    return [(label, keyword, f"(?<= )(?:{pattern})(?= )", priority, sure) for label, keyword, pattern, priority, sure in found]


def gate(keywords: list[str]) -> str:
    """Pattern that fits every normal text with one of the keywords: a blank, then the keywords by their first letter."""
    every = sorted({k for keyword in keywords for k in keyword.split("/")})
    return " (?:" + "|".join(f"{first}(?:{'|'.join(k[1:] for k in own)})" for first, own in groupby(every, key=lambda k: k[0])) + ")"
