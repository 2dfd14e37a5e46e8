"""Signatures of licenses, one a line: priority, label | words that every match holds | pattern.

Patterns run over words joined by one space (A-Z lowered, other ASCII than letters and
digits gone), so "BSD-3-Clause" is "bsd 3 clause" and "v2.0" is "v2 0". Priorities: 6
identifiers and whole grants, 5 grants by name, 4 names with a version, 3 names, 2 short
forms that need a verb beside them, 1 hints.
"""

from __future__ import annotations

_TEXT = r"""
6 mit | license mit | spdx license identifier mit(?: 0)?
6 apache-2.0 | license apache | spdx license identifier apache 2 0
6 apache-1.1 | license apache | spdx license identifier apache 1 1
6 gpl-2.0-only | license gpl | spdx license identifier gpl 2 0(?: only)?
6 gpl-2.0-or-later | license gpl later | spdx license identifier gpl 2 0 or later
6 gpl-3.0-only | license gpl | spdx license identifier gpl 3 0(?: only)?
6 gpl-3.0-or-later | license gpl later | spdx license identifier gpl 3 0 or later
6 lgpl-2.1 | license lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
6 lgpl-3.0 | license lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
6 agpl-3.0 | license agpl | spdx license identifier agpl 3 0(?: only| or later)?
6 bsd-2-clause | license bsd clause | spdx license identifier bsd 2 clause
6 bsd-3-clause | license bsd clause | spdx license identifier bsd 3 clause
6 bsd-4-clause | license bsd clause | spdx license identifier bsd 4 clause
6 0bsd | license 0bsd | spdx license identifier 0bsd
6 isc | license isc | spdx license identifier isc
6 mpl-2.0 | license mpl | spdx license identifier mpl 2 0
6 epl-2.0 | license epl | spdx license identifier epl 2 0
6 cc0 | license cc0 | spdx license identifier cc0 1 0
6 cc-by-4.0 | license cc by | spdx license identifier cc by 4 0
6 cc-by-sa-4.0 | license cc by sa | spdx license identifier cc by sa 4 0
6 unlicense | license unlicense | spdx license identifier unlicense
6 zlib | license zlib | spdx license identifier zlib
6 boost | license bsl | spdx license identifier bsl 1 0
6 ofl-1.1 | license ofl | spdx license identifier ofl 1 1
6 wtfpl | license wtfpl | spdx license identifier wtfpl
6 mit | permission granted | permission is hereby granted free of charge to any person obtaining a copy of this software
6 mit-0 | permission granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
6 isc | permission granted hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
6 hpnd | permission granted hereby | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
6 bsd | redistribution permitted | redistribution and use in source and binary forms with or without modification are permitted
6 bsd-3-clause | permission endorse | may be used to endorse or promote products derived from this software without specific prior written permission
6 bsd-4-clause | advertising mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
6 apache-2.0 | license apache compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
6 apache-1.1 | redistribution software apache | the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by the apache software foundation
6 gpl | gnu license redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
6 lgpl | gnu license redistribute lesser | you can redistribute it and or modify it under the terms of the gnu lesser general public license
6 lgpl-2.0 | gnu license redistribute library | you can redistribute it and or modify it under the terms of the gnu library general public license
6 agpl | gnu license redistribute affero | you can redistribute it and or modify it under the terms of the gnu affero general public license
6 gfdl | gnu license permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
6 mpl-2.0 | mozilla license | this source code form is subject to the terms of the mozilla public license v 2 0
6 mpl-1.1 | mozilla license | the contents of this file are subject to the mozilla public license version 1 1
6 mpl-1.0 | mozilla license | the contents of this file are subject to the mozilla public license version 1 0
6 npl | netscape license | the contents of this file are subject to the netscape public license
6 cddl | license common | the contents of this file are subject to the terms of the common development and distribution license
6 epl | license eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
6 cpl | license common | this program and the accompanying materials are made available under the terms of the common public license
6 zlib | permission granted altered | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely(?: subject to the following restrictions)?(?: [a-z0-9]+){0,60} altered source versions must be plainly marked
6 unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
6 wtfpl | license fuck | do what the fuck you want to public license
6 boost | permission granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
6 ncsa | permission granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
6 postgresql | permission granted agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
6 openssl | openssl permission | the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software without prior written permission
6 php | php permission | the name php must not be used to endorse or promote products derived from this software without prior written permission
6 psf | python license | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce(?: [a-z0-9]+){0,30} python
6 ofl-1.1 | permission font | permission is hereby granted free of charge to any person obtaining a copy of the font software
6 cc0 | domain copyright waive | to waive(?: [a-z0-9]+){0,12} copyright(?: [a-z0-9]+){0,12} public domain
6 cc-pdm | copyright domain known | this work has been identified as being free of known restrictions under copyright law(?: [a-z0-9]+){0,12} public domain
6 beerware | license beer | the beer ware license
6 json | software evil license | the software shall be used for good not evil(?: [a-z0-9]+){0,40} license
6 curl | curl copyright | curl and libcurl are licensed under an mit x derivate license(?: [a-z0-9]+){0,20} copyright
6 x11 | consortium permission | except as contained in this notice the name of the x consortium shall not be used in advertising(?: [a-z0-9]+){0,20} permission
6 sleepycat | redistributions license | redistributions in any form must be accompanied by information on how to obtain complete source code(?: [a-z0-9]+){0,60} license
6 sspl | license server | offer the functionality of the program as a service(?: [a-z0-9]+){0,40} server side public license
6 busl-1.1 | license business | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use(?: [a-z0-9]+){0,60} business source license
6 elastic-2.0 | license elastic | elastic license 2 0(?: elv2)? you may not provide the software to third parties as a hosted or managed service
6 commons-clause | commons license sell | commons clause license condition(?: [a-z0-9]+){0,60} sell
5 mit | license mit | (?:re)?licensed under (?:the )?(?:terms of )?(?:the )?mit(?: x11)? license
5 mit | mit license | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit license
5 mit | license expat | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?expat license
5 apache-2.0 | license apache | (?:re)?licensed under (?:the )?(?:terms of )?(?:the )?apache license version 2 0
5 apache-2.0 | license apache | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache license version 2 0
5 apache | license apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? license
5 gpl-3.0 | license gnu general | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?gnu general public license version 3
5 gpl-2.0 | license gnu general | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?gnu general public license version 2
5 gpl | license general public | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license
5 lgpl | license lesser general | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public license
5 agpl | license affero general | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public license
5 bsd | license bsd | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? license
5 bsd-2-clause | license bsd clause | (?:licensed|released|distributed) under (?:the )?(?:2 clause bsd|bsd 2 clause) license
5 bsd-3-clause | license bsd clause | (?:licensed|released|distributed) under (?:the )?(?:3 clause bsd|bsd 3 clause) license
5 bsd-3-clause | license bsd | (?:licensed|released|distributed) under (?:the )?(?:new|revised|modified) bsd license
5 bsd-2-clause | license bsd simplified | (?:licensed|released|distributed) under (?:the )?simplified bsd license
5 bsd-4-clause | license bsd original | (?:licensed|released|distributed) under (?:the )?original bsd license
5 mpl-2.0 | license mozilla | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?mozilla public license(?: version | v ?| )2 0
5 mpl | license mozilla | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?mozilla public license
5 epl | license eclipse | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?eclipse public license
5 isc | license isc | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?isc license
5 zlib | license zlib | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? license
5 artistic | license artistic | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:perl )?artistic license
5 perl | perl terms license | under the same terms as perl itself(?: [a-z0-9]+){0,20} license
5 boost | license boost | (?:licensed|released|distributed) under (?:the )?boost software license
5 cddl | license common | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?common development and distribution license
5 eupl | european union license | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?european union public license
5 eupl | european union licence | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?european union public licence
5 cc-by-4.0 | creative commons attribution license | (?:licensed|released|distributed) under (?:a |the )?creative commons attribution 4 0 international license
5 cc-by-sa-4.0 | creative commons sharealike license | (?:licensed|released|distributed) under (?:a |the )?creative commons attribution sharealike 4 0 international license
5 cc-by-nc-4.0 | creative commons noncommercial license | (?:licensed|released|distributed) under (?:a |the )?creative commons attribution noncommercial 4 0 international license
5 cc-by | creative commons attribution license | (?:licensed|released|distributed) under (?:a |the )?creative commons attribution license
5 cc-by | licensed cc by | licensed under (?:a |the )?cc by(?: [1-4] 0)?
5 cc-by-sa | licensed cc by sa | licensed under (?:a |the )?cc by sa(?: [1-4] 0)?
5 cc-by-nc | licensed cc by nc | licensed under (?:a |the )?cc by nc(?: [1-4] 0)?
5 cc-by-nd | licensed cc by nd | licensed under (?:a |the )?cc by nd(?: [1-4] 0)?
5 cc-by-nc-sa | licensed cc by nc sa | licensed under (?:a |the )?cc by nc sa(?: [1-4] 0)?
5 cc-by-nc-nd | licensed cc by nc nd | licensed under (?:a |the )?cc by nc nd(?: [1-4] 0)?
5 cc0 | licensed cc0 | licensed under (?:the )?cc0(?: 1 0)?
5 cc0 | commons domain dedication | creative commons (?:cc0 )?(?:1 0 )?(?:universal )?public domain dedication
5 odbl | open database license | (?:licensed|made available) under (?:the )?open database license
5 pddl | open domain dedication license | open data commons public domain dedication and license
5 odc-by | open data commons attribution license | open data commons attribution license
5 ogl | open government licence | (?:licensed|released|available) under (?:the )?open government licence
5 ofl | open font license | (?:licensed|released|distributed) under (?:the )?(?:sil )?open font license
5 vim | license vim | (?:licensed|released|distributed) under (?:the )?vim license
5 ruby | license ruby | (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?ruby license
5 ms-pl | license microsoft public | (?:licensed|released|distributed) under (?:the )?microsoft public license
5 ms-rl | license microsoft reciprocal | (?:licensed|released|distributed) under (?:the )?microsoft reciprocal license
5 upl-1.0 | license universal permissive | (?:licensed|released|distributed) under (?:the )?universal permissive license
5 afl-3.0 | license academic free | (?:licensed|released|distributed) under (?:the )?academic free license
5 osl-3.0 | license open software | (?:licensed|released|distributed) under (?:the )?open software license
5 unlicense | released unlicense | released under (?:the )?unlicense
4 apache-2.0 | license apache | (?:the )?apache license(?: version | v ?| )2(?: 0)?
4 apache-2.0 | apache license | (?:the )?apache 2 0 license
4 apache-1.0 | apache license | (?:the )?apache(?: software)? license(?: version | v ?| )1 0
4 apache-1.1 | apache license | (?:the )?apache(?: software)? license(?: version | v ?| )1 1
4 gpl-1.0 | general public license | (?:gnu )?general public license(?: version | v ?| )1
4 gpl-2.0 | general public license | (?:gnu )?general public license(?: version | v ?| )2
4 gpl-3.0 | general public license | (?:gnu )?general public license(?: version | v ?| )3
4 gpl-2.0-or-later | general public license later | general public license(?: [a-z]+){0,6} (?:version )?2(?: of the license)? or (?:at your option )?any later version
4 gpl-3.0-or-later | general public license later | general public license(?: [a-z]+){0,6} (?:version )?3(?: of the license)? or (?:at your option )?any later version
4 gpl-2.0 | gplv2 | gplv2
4 gpl-3.0 | gplv3 | gplv3
4 gpl-2.0 | gpl | gpl(?: version | v ?| )2(?: 0)?
4 gpl-3.0 | gpl | gpl(?: version | v ?| )3(?: 0)?
4 gpl-2.0-only | gpl only | gpl 2 0 only
4 gpl-3.0-or-later | gpl later | gpl 3 0 or later
4 lgpl-2.0 | library general public license | (?:gnu )?library general public license(?: version | v ?| )2
4 lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license(?: version | v ?| )2 1
4 lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license(?: version | v ?| )3
4 lgpl-2.1 | lgpl | lgpl(?: version | v ?| )2 1
4 lgpl-3.0 | lgpl | lgpl(?: version | v ?| )3(?: 0)?
4 lgpl-2.1 | lgplv2 | lgplv2 1
4 lgpl-3.0 | lgplv3 | lgplv3
4 agpl-3.0 | affero general public license | (?:gnu )?affero general public license(?: version | v ?| )3
4 agpl-3.0 | agpl | agpl(?: version | v ?| )3(?: 0)?
4 agpl-3.0 | agplv3 | agplv3
4 gfdl-1.3 | free documentation license | (?:gnu )?free documentation license(?: version | v ?| )1 3
4 gfdl-1.2 | free documentation license | (?:gnu )?free documentation license(?: version | v ?| )1 2
4 mpl-1.1 | mozilla public license | mozilla public license(?: version | v ?| )1 1
4 mpl-2.0 | mozilla public license | mozilla public license(?: version | v ?| )2 0
4 epl-1.0 | eclipse public license | eclipse public license(?: version | v ?| )1 0
4 epl-2.0 | eclipse public license | eclipse public license(?: version | v ?| )2 0
4 cddl-1.0 | development distribution license | common development and distribution license(?: version | v ?| )1 0
4 cddl-1.1 | development distribution license | common development and distribution license(?: version | v ?| )1 1
4 cpl-1.0 | common public license | common public license(?: version | v ?| )1 0
4 eupl-1.2 | eupl | eupl(?: version | v ?| )1 2
4 artistic-1.0 | artistic license | artistic license(?: version | v ?| )1 0
4 artistic-2.0 | artistic license | artistic license(?: version | v ?| )2 0
4 boost-1.0 | boost software license | boost software license(?: version | v ?| )1 0
4 python-2.0 | python license | python (?:software foundation )?license(?: version | v ?| )2
4 php-3.01 | php license | php license(?: version | v ?| )3 01
4 zpl-2.1 | zope public license | zope public license(?: version | v ?| )2 1
4 w3c | w3c software license | w3c software(?: notice and)?(?: and document)? license
4 unicode | unicode license | unicode(?: inc)? license(?: v3| agreement)?
4 afl-3.0 | academic free license | academic free license(?: version | v ?| )3 0
4 osl-3.0 | open software license | open software license(?: version | v ?| )3 0
4 cecill-2.1 | cecill | cecill(?: version | v ?| )2 1
4 cc-by-4.0 | commons attribution international | creative commons attribution 4 0 international
4 cc-by-sa-4.0 | commons sharealike | creative commons attribution sharealike(?: [1-4] 0)?
4 cc-by-nc-4.0 | commons attribution noncommercial | creative commons attribution noncommercial 4 0
4 cc-by-nd | commons attribution noderivatives | creative commons attribution noderivatives(?: [1-4] 0)?
4 cc-by-nc-sa | commons noncommercial sharealike | creative commons attribution noncommercial sharealike(?: [1-4] 0)?
4 cc-by-nc-nd | commons noncommercial noderivatives | creative commons attribution noncommercial noderivatives(?: [1-4] 0)?
3 mit | mit license | (?:the )?(?:mit|mit x11) license
3 mit | expat license | (?:the )?expat license
3 apache | apache license | (?:the )?apache(?: software)? license
3 gpl | general public license | (?:the )?(?:gnu )?general public license
3 gpl | gnu gpl | (?:the )?gnu gpl
3 gpl | gpl licensed | gpl licensed|licensed (?:under )?(?:the )?gpl
3 lgpl | lesser general public license | (?:the )?(?:gnu )?lesser general public license
3 lgpl | library general public license | (?:the )?(?:gnu )?library general public license
3 lgpl | lgpl | (?:the )?(?:gnu )?lgpl
3 agpl | affero general public license | (?:the )?(?:gnu )?affero general public license
3 agpl | agpl | (?:the )?(?:gnu )?agpl
3 gfdl | free documentation license | (?:the )?(?:gnu )?free documentation license
3 bsd | bsd license | (?:the )?bsd(?: style)? license
3 bsd-2-clause | bsd clause license | (?:bsd 2 clause|2 clause bsd) license
3 bsd-3-clause | bsd clause license | (?:bsd 3 clause|3 clause bsd) license
3 bsd-4-clause | bsd clause license | (?:bsd 4 clause|4 clause bsd) license
3 bsd-3-clause | bsd license | (?:new|revised|modified) bsd license
3 bsd-2-clause | bsd license | (?:simplified|freebsd) bsd license
3 isc | isc license | (?:the )?isc license
3 mpl | mozilla public license | (?:the )?mozilla public license
3 epl | eclipse public license | (?:the )?eclipse public license
3 cddl | development distribution license | (?:the )?common development and distribution license
3 cpl | common public license | (?:the )?common public license
3 eupl | european union license | (?:the )?european union public license
3 eupl | european union licence | (?:the )?european union public licence
3 zlib | zlib license | (?:the )?zlib(?: libpng)? license
3 libpng | libpng license | (?:the )?libpng license
3 artistic | artistic license | (?:the )?artistic license
3 boost | boost software license | (?:the )?boost software license
3 psf | python software foundation license | python software foundation license
3 postgresql | postgresql license | (?:the )?postgresql license
3 openssl | openssl license | (?:the )?openssl license
3 php | php license | (?:the )?php license
3 ruby | ruby license | (?:the )?ruby license
3 vim | vim license | (?:the )?vim license
3 tcl | tcl license | (?:the )?tcl(?: tk)? license
3 zpl | zope public license | (?:the )?zope public license
3 ncsa | illinois license | university of illinois(?: ncsa)? open source license
3 qpl | q public license | (?:the )?q public license
3 ipl | ibm public license | (?:the )?ibm public license
3 spl | sun public license | (?:the )?sun public license
3 apsl | apple public license | (?:the )?apple public source license
3 ms-pl | microsoft public license | (?:the )?microsoft public license
3 ms-rl | microsoft reciprocal license | (?:the )?microsoft reciprocal license
3 afl | academic free license | (?:the )?academic free license
3 osl | open software license | (?:the )?open software license
3 ofl | open font license | (?:the )?(?:sil )?open font license
3 odbl | open database license | (?:the )?open database license
3 sspl | side public license | (?:the )?server side public license
3 busl | business source license | (?:the )?business source license
3 elastic | elastic license | (?:the )?elastic license
3 unlicense | unlicense | (?:the )?unlicense
3 wtfpl | wtfpl | (?:the )?wtfpl
3 eupl | eupl | eupl
3 cecill | cecill | (?:the )?cecill(?: [bc])?
3 lppl | latex project public license | (?:the )?latex project public license
3 cc-by | commons attribution | creative commons attribution
3 creative-commons | creative commons license | creative commons(?: [a-z]+){0,3} license
3 ogl | open government licence | (?:the )?open government licence
3 public-domain | public domain | (?:in|into|to) the public domain
3 mit | mit lizenz | mit lizenz
3 apache | apache lizenz | apache lizenz
3 gpl | gpl lizenz | gpl lizenz
3 mit | licence mit | licence mit
3 mit | licencia mit | licencia mit
3 apache | licencia apache | licencia apache
3 gpl | licencia general | licencia pública general
3 gpl | licence générale | licence publique générale
2 mit | under mit | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[cs]e)?
2 apache | under apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?apache(?: licen[cs]e)?(?: 2 0)?
2 gpl | under gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:gnu )?gpl
2 bsd | under bsd | (?:licensed|released|distributed|available|published|provided) under (?:the )?bsd(?: [234] clause)?(?: licen[cs]e)?
2 isc | under isc | (?:licensed|released|distributed|available|published|provided) under (?:the )?isc
2 mpl | under mpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?mpl(?: 2 0)?
2 zlib | under zlib | (?:licensed|released|distributed|available|published|provided) under (?:the )?zlib
2 mit | license mit | license (?:is )?(?:the )?mit
2 apache-2.0 | license apache | license (?:is )?(?:the )?apache(?: 2 0)?
2 gpl | license gpl | license (?:is )?(?:the )?(?:gnu )?gpl
2 bsd | license bsd | license (?:is )?(?:the )?bsd(?: [234] clause)?
2 copyleft | copyleft | copyleft
2 proprietary | proprietary confidential | proprietary and confidential|confidential and proprietary
2 proprietary | unauthorized prohibited copying | unauthorized copying(?: [a-z]+){0,8} (?:is )?strictly prohibited
2 proprietary | rights reserved | all rights reserved
2 proprietary | redistribution prohibited | redistribution(?: [a-z]+){0,6} (?:is )?(?:strictly )?prohibited
1 copyright | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
1 copyright | copyright holders | copyright holders
1 warranty-disclaimer | warranty kind | without warranty of any kind
1 warranty-disclaimer | warranties merchantability | implied warranties of merchantability
1 warranty-disclaimer | merchantability fitness | merchantability(?: [a-z]+){0,4} fitness for a particular purpose
1 permission | permission reproduced | may not be reproduced(?: [a-z]+){0,8} permission
1 permission | permission copyright | with permission of the copyright
"""


def _line(line: str) -> tuple[int, str, tuple[str, ...], str]:
    head, keys, pattern = map(str.strip, line.split("|", 2))
    priority, label = head.split(" ", 1)
    return int(priority), label, tuple(keys.split()), pattern


#: (priority, label, words that every match holds, pattern), in order of the text above.
SIGNATURES = tuple(_line(x) for x in _TEXT.strip().splitlines())
