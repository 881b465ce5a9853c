"""License signatures: notices, headers and metadata as licenses really use them; and families in words, with the forms in
which texts name them.

Rules match lower-cased words joined by single spaces, so that `GPL-3.0` reads `gpl 3 0`. A rule's priority is its own, or
its family's plus its form's; more specific families come first, and what a license text says of itself before all.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: label | priority | keywords: any match has a word that begins with one | name | short identifier
FAMILIES = r"""
agpl-3.0 | 30 | affero agpl | (?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)? | agpl(?:v| v)? ?3(?: 0)?(?: only| or later)?
agpl | 20 | affero agpl | (?:gnu )?affero general public license | agpl
lgpl-3.0 | 30 | lesser lgpl | (?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)? | lgpl(?:v| v)? ?3(?: 0)?(?: only| or later)?
lgpl-2.1 | 30 | lesser lgpl | (?:gnu )?lesser general public license(?: version| v)? ?2 1(?: or (?:any )?later)? | lgpl(?:v| v)? ?2 1(?: only| or later)?
lgpl-2.0 | 29 | library lgpl | gnu library general public license(?: version| v)? ?2(?: 0)? | lgpl(?:v| v)? ?2 0(?: only| or later)?
lgpl | 20 | lesser lgpl | (?:gnu )?lesser general public license | lgpl
gpl-3.0 | 28 | general gpl | (?:gnu )?general public license(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)? | gpl(?:v| v)? ?3(?: 0)?(?: only| or later)?
gpl-2.0 | 28 | general gpl | (?:gnu )?general public license(?: version| v)? ?2(?: 0)?(?: or (?:any )?later)? | gpl(?:v| v)? ?2(?: 0)?(?: only| or later)?
gpl-1.0 | 28 | general gpl | (?:gnu )?general public license(?: version| v)? ?1(?: 0)? | gpl(?:v| v)? ?1(?: 0)?(?: only| or later)?
gpl | 15 | general gnu | gnu general public license | gnu gpl
gfdl-1.3 | 28 | documentation gfdl | (?:gnu )?free documentation license(?: version| v)? ?1 3 | gfdl 1 3(?: only| or later)?
gfdl-1.2 | 28 | documentation gfdl | (?:gnu )?free documentation license(?: version| v)? ?1 2 | gfdl 1 2(?: only| or later)?
gfdl | 18 | documentation gfdl | (?:gnu )?free documentation license | gfdl
apache-2.0 | 28 | apache | apache (?:software )?license(?: version| v)? ?2(?: 0)? | apache ?2 0
apache-1.1 | 28 | apache | apache (?:software )?license(?: version| v)? ?1 1 | apache 1 1
apache-1.0 | 27 | apache | apache (?:software )?license(?: version| v)? ?1 0 | apache 1 0
apache | 15 | apache | apache (?:software )?license | apache licensed
mit-0 | 28 | mit | mit no attribution(?: license)? | mit 0
mit | 20 | mit expat x11 | (?:expat|mit|mit x11|x11) license | mit licensed
bsd-4-clause | 28 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)? | bsd 4 clause
bsd-3-clause | 28 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)(?: license)? | bsd 3 clause
bsd-2-clause | 28 | bsd freebsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)? | bsd 2 clause
0bsd | 28 | bsd zero free 0bsd | (?:zero clause bsd|bsd zero clause|free public)(?: license)? | 0bsd
bsd | 15 | bsd | bsd (?:style )?license | bsd licensed
isc | 24 | isc | isc license | isc licensed
mpl-2.0 | 28 | mozilla mpl | mozilla public license(?: version| v)? ?2(?: 0)? | mpl ?2 0
mpl-1.1 | 28 | mozilla mpl | mozilla public license(?: version| v)? ?1 1 | mpl ?1 1
mpl | 18 | mozilla mpl | mozilla public license | mpl licensed
epl-2.0 | 28 | eclipse epl | eclipse public license(?: version| v)? ?2(?: 0)? | epl ?2 0
epl-1.0 | 28 | eclipse epl | eclipse public license(?: version| v)? ?1(?: 0)? | epl ?1 0
edl-1.0 | 26 | eclipse edl | eclipse distribution license(?: version| v)? ?1(?: 0)? | edl 1 0
cddl-1.1 | 28 | distribution cddl | common development and distribution license(?: version| v)? ?1 1 | cddl 1 1
cddl-1.0 | 27 | distribution cddl | common development and distribution license(?:(?: version| v)? ?1 0)? | cddl 1 0
cpl-1.0 | 26 | common cpl | common public license(?:(?: version| v)? ?1 0)? | cpl 1 0
ipl-1.0 | 26 | ibm ipl | ibm public license(?:(?: version| v)? ?1 0)? | ipl 1 0
eupl-1.2 | 28 | european eupl | european union public licen[cs]e(?: version| v)? ?1 2 | eupl 1 2
eupl-1.1 | 27 | european eupl | european union public licen[cs]e(?: version| v)? ?1 1 | eupl 1 1
artistic-2.0 | 28 | artistic | artistic license(?: version| v)? ?2(?: 0)? | artistic 2 0
artistic-1.0 | 24 | artistic | artistic license(?:(?: version| v)? ?1(?: 0)?)? | artistic 1 0(?: perl| cl8)?
zlib | 24 | zlib | zlib(?: libpng)? license | zlib licensed
libpng | 23 | png libpng | (?:png reference library|libpng)(?: license)?(?: version)?(?: 2)? | libpng 2 0
bsl-1.0 | 26 | boost bsl | boost software license(?:(?: version)? 1 0)? | bsl 1 0
unlicense | 26 | unlicense | (?:the )?unlicense(?: license)? | unlicense
wtfpl | 26 | wtfpl | wtfpl(?: license)? | wtfpl
psf-2.0 | 24 | python psf | python software foundation license(?:(?: version)? 2)? | psf 2 0
python-2.0 | 24 | python | python license(?:(?: version)? 2(?: 0)?)? | python 2 0
php-3.01 | 24 | php | php license(?:(?: version)? 3 01)? | php 3 01
ruby | 22 | ruby | ruby(?: s)? license | ruby licensed
openssl | 22 | openssl | openssl license | openssl licensed
ofl-1.1 | 26 | font ofl | (?:sil )?open font license(?:(?: version)? 1 1)? | ofl 1 1
ms-pl | 26 | microsoft ms | microsoft public license | ms pl
ms-rl | 26 | microsoft ms | microsoft reciprocal license | ms rl
odbl-1.0 | 26 | database odbl | open (?:data commons open )?database license(?:(?: version)? 1 0)? | odbl 1 0
pddl-1.0 | 26 | dedication pddl | (?:open data commons )?public domain dedication and license(?:(?: version)? 1 0)? | pddl 1 0
odc-by-1.0 | 26 | commons odc | open data commons attribution license(?:(?: version)? 1 0)? | odc by 1 0
elastic-2.0 | 26 | elastic | elastic license(?:(?: version)? 2(?: 0)?)? | elastic 2 0
sspl-1.0 | 26 | server sspl | server side public license(?:(?: version)? 1)? | sspl 1 0
busl-1.1 | 26 | business busl | business source license(?:(?: version)? 1 1)? | busl 1 1
postgresql | 24 | postgresql | postgresql licen[cs]e | postgresql licensed
ncsa | 24 | illinois ncsa | (?:university of illinois|ncsa|illinois)(?: ncsa)? open source license | ncsa licensed
w3c | 23 | w3c | w3c software (?:notice and )?(?:document )?license | w3c 20150513
afl-3.0 | 26 | academic afl | academic free license(?:(?: version)? 3 0)? | afl 3 0
osl-3.0 | 26 | open osl | open software license(?:(?: version)? 3 0)? | osl 3 0
cecill-2.1 | 26 | cecill | cecill(?: free software license agreement)?(?: version| v)? ?2 1 | cecill 2 1
upl-1.0 | 26 | universal upl | universal permissive license(?:(?: version)? 1 0)? | upl 1 0
cc0-1.0 | 30 | cc0 creative | (?:cc0|creative commons zero|creative commons cc0)(?: 1 0)?(?: universal)? | cc0 1 0
cc-by-nc-nd | 30 | attribution cc | (?:creative commons )?(?:attribution noncommercial noderivatives|attribution non commercial no derivatives)(?: [1-4] 0)? | cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa | 30 | attribution cc | (?:creative commons )?(?:attribution noncommercial sharealike|attribution non commercial share alike)(?: [1-4] 0)? | cc by nc sa(?: [1-4] 0)?
cc-by-nc | 28 | attribution cc | (?:creative commons )?(?:attribution noncommercial|attribution non commercial)(?: [1-4] 0)? | cc by nc(?: [1-4] 0)?
cc-by-nd | 28 | attribution cc | (?:creative commons )?(?:attribution noderivatives|attribution no derivatives)(?: [1-4] 0)? | cc by nd(?: [1-4] 0)?
cc-by-sa | 28 | attribution cc | (?:creative commons )?(?:attribution sharealike|attribution share alike)(?: [1-4] 0)? | cc by sa(?: [1-4] 0)?
cc-by-4.0 | 26 | attribution cc | creative commons attribution(?: international)?(?: license)? 4 0(?: international)? | cc by 4 0
cc-by-3.0 | 26 | attribution cc | creative commons attribution(?: unported)?(?: license)? 3 0(?: unported)? | cc by 3 0
cc-by | 15 | attribution cc | creative commons attribution(?: license)? | cc by
proprietary | 12 | rights | all rights reserved | rights reserved by
public-domain | 14 | domain public | (?:released into|dedicated to|placed in|in) the public domain | public domain
"""

#: label | priority | confidence | keywords | pattern
SIGNATURES = r"""
mit | 95 | 1.0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 90 | 0.9 | copies | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit-0 | 97 | 1.0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
x11 | 94 | 0.9 | advertising | except as contained in this notice the name of (?:\S+ ){1,12}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
bsl-1.0 | 98 | 1.0 | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | 90 | 1.0 | boost | (?:http|https) www boost org license 1 0 txt
ncsa | 97 | 1.0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
isc | 95 | 1.0 | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | 96 | 1.0 | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
postgresql | 95 | 1.0 | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | 94 | 0.9 | permission | permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)? (?:is hereby granted )?without fee
bsd | 85 | 0.9 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 88 | 0.9 | views | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3-clause | 92 | 1.0 | endorse | neither the names? of (?:\S+ ){1,16}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 91 | 1.0 | endorse | the names? of (?:\S+ ){1,16}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 96 | 1.0 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 93 | 0.9 | california | this product includes software developed by the university of california berkeley and its contributors
bsd-source-code | 85 | 0.8 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
apache-2.0 | 96 | 1.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 90 | 0.9 | applicable | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 92 | 1.0 | apache | (?:http|https) www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 91 | 0.9 | asf | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | 90 | 1.0 | apache | apache license version 2 0 january 2004
apache-1.1 | 94 | 1.0 | apache | this product includes software developed by the apache software foundation
apache-1.0 | 94 | 1.0 | apache | this product includes software developed by the apache group for use in the apache http server project
openssl | 95 | 1.0 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 95 | 1.0 | eric | this product includes cryptographic software written by eric young
gpl-3.0 | 96 | 1.0 | general | this program is free software(?: you can)? redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0 | 96 | 1.0 | general | (?:it|this program|this file|\S+) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or at your option any later version)?
gpl-2.0 | 96 | 1.0 | general | (?:it|this program|this file|\S+) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 2(?: of the license)?(?: or at your option any later version)?
gpl-2.0 | 90 | 1.0 | general | gnu general public license version 2 june 1991
gpl-3.0 | 90 | 1.0 | general | gnu general public license version 3 29 june 2007
gpl | 80 | 0.9 | general | you should have received a copy of the gnu general public license along with (?:this program|\S+)
gpl-3.0 | 88 | 1.0 | gnu | (?:http|https) www gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-2.0 | 88 | 1.0 | gnu | (?:http|https) www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl | 76 | 0.8 | gnu | (?:http|https) www gnu org licenses gpl(?: html| txt| en html)?
gpl-2.0 | 86 | 0.9 | common | usr share common licenses gpl 2
gpl-3.0 | 86 | 0.9 | common | usr share common licenses gpl 3
lgpl-2.1 | 86 | 0.9 | common | usr share common licenses lgpl 2 1
lgpl-3.0 | 86 | 0.9 | common | usr share common licenses lgpl 3
apache-2.0 | 86 | 0.9 | common | usr share common licenses apache 2 0
artistic-1.0 | 86 | 0.9 | common | usr share common licenses artistic
lgpl-3.0 | 97 | 1.0 | lesser | (?:it|this library|this program|\S+) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or at your option any later version)?
lgpl-2.1 | 97 | 1.0 | lesser | (?:it|this library|this program|\S+) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1(?: of the license)?(?: or at your option any later version)?
lgpl-2.0 | 97 | 1.0 | library | (?:it|this library|this program|\S+) is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation(?: either)? version 2(?: of the license)?(?: or at your option any later version)?
lgpl-2.1 | 90 | 1.0 | lesser | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | 90 | 1.0 | lesser | gnu lesser general public license version 3 29 june 2007
lgpl | 82 | 0.9 | lesser | you should have received a copy of the gnu lesser general public license along with (?:this library|this program|\S+)
lgpl-3.0 | 88 | 1.0 | gnu | (?:http|https) www gnu org licenses lgpl 3 0(?: html| txt| en html)?
lgpl-2.1 | 88 | 1.0 | gnu | (?:http|https) www gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?
agpl-3.0 | 98 | 1.0 | affero | (?:it|this program|\S+) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation(?: either)? version 3(?: of the license)?(?: or at your option any later version)?)?
agpl-3.0 | 90 | 1.0 | affero | gnu affero general public license version 3 19 november 2007
agpl-3.0 | 84 | 0.9 | affero | you should have received a copy of the gnu affero general public license along with (?:this program|\S+)
agpl-3.0 | 88 | 1.0 | gnu | (?:http|https) www gnu org licenses agpl(?: 3 0)?(?: html| txt| en html)?
gfdl | 94 | 1.0 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.3 | 96 | 1.0 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 | 96 | 1.0 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gcc-exception | 92 | 0.9 | exception | (?:gcc runtime library exception|under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception)
classpath-exception | 92 | 0.9 | statically | linking this library statically or dynamically with other modules is making a combined work based on this library
mpl-2.0 | 96 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 92 | 1.0 | mpl mozilla | if a copy of the mpl was not distributed with this file you can obtain one at (?:http|https)(?: www)? mozilla org mpl 2 0
mpl-2.0 | 90 | 1.0 | mozilla | (?:http|https)(?: www)? mozilla org mpl 2 0
mpl-1.1 | 96 | 1.0 | mozilla | the contents of this file are subject to the mozilla public license version 1 1(?: the license)?
mpl-1.0 | 96 | 1.0 | mozilla | the contents of this file are subject to the mozilla public license version 1 0(?: the license)?
npl-1.1 | 95 | 1.0 | netscape | the contents of this file are subject to the netscape public license version 1 1
epl-2.0 | 95 | 1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0
epl-1.0 | 95 | 1.0 | eclipse | (?:all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | 88 | 1.0 | eclipse | (?:http|https) www eclipse org legal epl 2 0
epl-1.0 | 88 | 1.0 | eclipse | (?:http|https) www eclipse org legal epl v10(?: html)?
edl-1.0 | 88 | 1.0 | eclipse | (?:http|https) www eclipse org org documents edl v10(?: php| html)?
cddl | 94 | 1.0 | distribution | the contents of this file are subject to the terms of the common development and distribution license
cddl | 84 | 0.9 | opensolaris | you can obtain a copy of the license at usr src opensolaris license or (?:http|https) www opensolaris org os licensing
cpl-1.0 | 94 | 1.0 | common | this program is distributed under the terms of the common public license
eupl-1.2 | 95 | 1.0 | eupl | licensed under the eupl(?: version| v)? ?1 2(?: or as soon they will be approved by the european commission subsequent versions of the eupl)?
eupl-1.1 | 95 | 1.0 | eupl | licensed under the eupl(?: version| v)? ?1 1(?: or as soon they will be approved by the european commission subsequent versions of the eupl)?
unlicense | 95 | 1.0 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 90 | 0.9 | anyone | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense | 88 | 1.0 | unlicense | (?:http|https) unlicense org
wtfpl | 95 | 1.0 | everyone | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl | 93 | 1.0 | want | do what the \S+ you want to public license
zlib | 94 | 1.0 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 92 | 0.9 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | 95 | 1.0 | png | the png reference library is supplied as is
libjpeg | 94 | 1.0 | jpeg | this software is based in part on the work of the independent jpeg group
curl | 94 | 0.9 | stenberg | copyright (?:c )?\d{4}(?: \d{4})? daniel stenberg(?: \S+){0,8}
psf-2.0 | 95 | 1.0 | psf | psf is making python available to licensee on an as is basis
psf-2.0 | 93 | 1.0 | python | python software foundation license version 2
python-2.0 | 93 | 1.0 | beopen | beopen python open source license agreement version 1
php-3.01 | 94 | 1.0 | php | this product includes php software freely available from (?:http|https) www php net software
ruby | 92 | 0.9 | bsdl | you can redistribute it and or modify it under either the terms of the 2 clause bsdl(?: \S+){0,4} or the conditions below
artistic-2.0 | 94 | 1.0 | artistic | this is free software licensed under the artistic license 2 0
artistic-1.0 | 92 | 0.9 | artistic | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
perl | 94 | 1.0 | perl | (?:this (?:library|module|program) is free software you (?:can|may) redistribute it and or modify it|same terms) under the same terms as perl itself
ofl-1.1 | 95 | 1.0 | font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 90 | 1.0 | sil | (?:http|https) scripts sil org ofl
ms-pl | 94 | 0.9 | microsoft | this license governs use of the accompanying software if you use the software you accept this license(?: \S+){0,12} microsoft
odbl-1.0 | 92 | 1.0 | opendatacommons | (?:http|https)(?: www)? opendatacommons org licenses odbl(?: 1 0)?
pddl-1.0 | 92 | 1.0 | opendatacommons | (?:http|https)(?: www)? opendatacommons org licenses pddl(?: 1 0)?
odc-by-1.0 | 92 | 1.0 | opendatacommons | (?:http|https)(?: www)? opendatacommons org licenses by(?: 1 0)?
elastic-2.0 | 94 | 1.0 | hosted | you may not provide the software to third parties as a hosted or managed service
elastic-2.0 | 92 | 1.0 | elastic | licensed under the elastic license 2 0(?: \S+){0,6}
sspl-1.0 | 95 | 1.0 | functionality | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | 95 | 1.0 | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause | 94 | 1.0 | commons | commons clause license condition v1 0
cc0-1.0 | 95 | 1.0 | waived | to the extent possible under law (?:\S+ ){1,12}ha(?:s|ve) waived all copyright and related or neighboring rights
cc0-1.0 | 93 | 1.0 | publicdomain | (?:http|https)(?: www)? creativecommons org publicdomain zero 1 0
public-domain | 93 | 1.0 | publicdomain | (?:http|https)(?: www)? creativecommons org publicdomain mark 1 0
cc-by-nc-nd | 93 | 1.0 | creativecommons | (?:http|https)(?: www)? creativecommons org licenses by nc nd [1-4] [05](?: \S+)?
cc-by-nc-sa | 93 | 1.0 | creativecommons | (?:http|https)(?: www)? creativecommons org licenses by nc sa [1-4] [05](?: \S+)?
cc-by-nc | 92 | 1.0 | creativecommons | (?:http|https)(?: www)? creativecommons org licenses by nc [1-4] [05](?: \S+)?
cc-by-nd | 92 | 1.0 | creativecommons | (?:http|https)(?: www)? creativecommons org licenses by nd [1-4] [05](?: \S+)?
cc-by-sa | 92 | 1.0 | creativecommons | (?:http|https)(?: www)? creativecommons org licenses by sa [1-4] [05](?: \S+)?
cc-by | 91 | 1.0 | creativecommons | (?:http|https)(?: www)? creativecommons org licenses by [1-4] [05](?: \S+)?
cc-by-sa | 86 | 0.9 | sharealike | text is available under the creative commons attribution sharealike license
mit | 84 | 0.9 | osi | license osi approved mit license
bsd | 84 | 0.9 | osi | license osi approved bsd license
apache-2.0 | 84 | 0.9 | osi | license osi approved apache software license
gpl-3.0 | 85 | 0.9 | osi | license osi approved gnu general public license v3(?: or later)?(?: gplv3)?
gpl-2.0 | 85 | 0.9 | osi | license osi approved gnu general public license v2(?: or later)?(?: gplv2)?
lgpl-3.0 | 85 | 0.9 | osi | license osi approved gnu lesser general public license v3(?: or later)?(?: lgplv3)?
lgpl-2.1 | 85 | 0.9 | osi | license osi approved gnu lesser general public license v2(?: or later)?(?: lgplv2)?
agpl-3.0 | 85 | 0.9 | osi | license osi approved gnu affero general public license v3(?: or later)?
mpl-2.0 | 85 | 0.9 | osi | license osi approved mozilla public license 2 0(?: mpl 2 0)?
psf-2.0 | 85 | 0.9 | osi | license osi approved python software foundation license
isc | 85 | 0.9 | osi | license osi approved isc license(?: iscl)?
unlicense | 85 | 0.9 | osi | license osi approved the unlicense(?: unlicense)?
proprietary | 85 | 0.9 | osi other | license other proprietary license
public-domain | 85 | 0.9 | public | license public domain
proprietary | 82 | 0.9 | unauthorized | unauthorized (?:copying|reproduction|distribution|use) of (?:this file|this software|this document|\S+)(?: via any medium)? is strictly prohibited
proprietary | 82 | 0.9 | proprietary | (?:this (?:software|document|file|material) (?:is|contains) )?(?:strictly )?(?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary | 80 | 0.8 | reproduced | no part of this (?:publication|book|document|work|website) may be (?:reproduced|copied|transmitted)
proprietary | 80 | 0.8 | reproduced copied | may not be (?:reproduced|copied|published|broadcast|rewritten|redistributed)(?: \S+){0,6} without (?:the )?(?:express |prior )?(?:written )?(?:permission|consent)
proprietary | 80 | 0.8 | agreement | (?:this software is licensed|licensed) (?:to you )?(?:under|subject to) (?:the terms of )?(?:an?|the|this) end user license agreement
proprietary | 78 | 0.7 | trade | (?:contains|constitutes) (?:valuable )?trade secrets? (?:of|and)
public-domain | 84 | 0.9 | dedicate dedicates dedicated | (?:the author|the authors|i) (?:hereby )?dedicates? (?:any and all copyright interest in )?this (?:work|software|file)(?: to| into) the public domain
public-domain | 82 | 0.8 | public | (?:this (?:work|file|software) is|is) in the public domain
public-domain | 82 | 0.9 | government | (?:works?|this software) (?:of|was developed (?:by|at)) (?:the )?(?:united states|u s) government(?: \S+){0,12} not subject to copyright
beerware | 94 | 1.0 | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 93 | 1.0 | evil | the software shall be used for good not evil
"""

#: form | priority | confidence | pattern around {name} or {id}
FORMS = r"""
grant | 60 | 1.0 | (?:licensed|released|distributed|available|provided|published|covered|redistribute it and or modify it)(?: to you)? (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{name}
identifier | 50 | 1.0 | spdx license identifier {id}
field | 40 | 0.9 | licen[cs]e(?: is| type| name)? (?:the )?(?:{id}|{name})
name | 20 | 0.8 | {name}
short | 10 | 0.6 | {id}
"""


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    pattern: re.Pattern[str]


def _rows(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]


def build() -> tuple[list[Rule], dict[str, list[int]]]:
    """All rules, and the numbers of the rules behind each keyword."""
    rules: list[Rule] = []
    behind: dict[str, list[int]] = {}
    for family in _rows(FAMILIES):
        label, priority, words, name, short = family
        for _, more, confidence, form in _rows(FORMS):
            pattern = form.replace("{name}", f"(?:{name})").replace("{id}", f"(?:{short})")
            for word in words.split():
                behind.setdefault(word, []).append(len(rules))
            rules.append(Rule(label, int(priority) + int(more), float(confidence), re.compile(rf"(?<!\S){pattern}(?!\S)")))
    for label, priority, confidence, words, pattern in _rows(SIGNATURES):
        for word in words.split():
            behind.setdefault(word, []).append(len(rules))
        rules.append(Rule(label, int(priority), float(confidence), re.compile(rf"(?<!\S)(?:{pattern})(?!\S)")))
    return rules, behind
