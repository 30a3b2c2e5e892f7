"""License scans by ordered signature rules, in SQL functions alone.

A text's words, lower-cased and joined by single spaces, are searched by some hundreds of regular expressions: hand-written
sentences of licenses and notices and hand-written names, the latter in each of the ways in which texts name a license. A rule runs only on
texts that hold its keyword, and only texts that hold one of a few stems are looked at at all. What a rule finds is an interval of the text with
the rule's priority. An interval inside another of the same or a better priority is suppressed, so of "apache license version 2 0" the
longest reading stays; the labels of those left are the method's labels.

The base phrases are counted apart: their places are where their words stand consecutively.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase: label
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, keyword, names as a regular expression over single-spaced words). Keywords are plain parts that each of the names holds.
LICENSES = (
    ("apache-1.1", "apache", r"apache (?:software )?license(?: version)? 1 1|apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license(?: version)? 2(?: 0)?|apache 2(?: 0)?"),
    ("apache-2.0", " asl 2 0", r"asl 2 0"),
    ("apache-2.0", " al2 0", r"al2 0"),
    ("apache", "apache", r"apache (?:software )?license|apache"),
    ("mit", " mit ", r"mit license|mit licence|mit x11 license|mit"),
    ("mit", " expat ", r"expat license|expat"),
    ("mit-0", " mit ", r"mit no attribution(?: license)?|mit 0"),
    ("bsd-2-clause", " bsd ", r"(?:simplified |freebsd |2 clause |two clause )bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-3-clause", " bsd ", r"(?:new |modified |revised |3 clause |three clause )bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-4-clause", " bsd ", r"(?:original |old |4 clause )bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("bsd-0", " bsd ", r"(?:zero clause |0 clause )bsd(?: license)?"),
    ("bsd-0", " 0bsd ", r"0bsd"),
    ("bsd", " bsd ", r"bsd license|bsd style license"),
    ("bsd", "berkeley software", r"berkeley software distribution license"),
    ("isc", " isc ", r"isc license|isc licence"),
    ("gpl-1.0", "general public license", r"(?:gnu )?general public license(?: version| v)? ?1(?: 0)?(?: or later| only)?"),
    ("gpl-1.0", " gpl ", r"(?:gnu )?gpl(?: version| v)? 1(?: 0)?(?: or later| only)?"),
    ("gpl-1.0", "gplv1", r"gplv1"),
    ("gpl-2.0", "general public license", r"(?:gnu )?general public license(?: version| v)? ?2(?: 0)?(?: or later| only)?"),
    ("gpl-2.0", " gpl ", r"(?:gnu )?gpl(?: version| v)? 2(?: 0)?(?: or later| only)?"),
    ("gpl-2.0", " gpl2", r"gpl2(?: 0)?"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "general public license", r"(?:gnu )?general public license(?: version| v)? ?3(?: 0)?(?: or later| only)?"),
    ("gpl-3.0", " gpl ", r"(?:gnu )?gpl(?: version| v)? 3(?: 0)?(?: or later| only)?"),
    ("gpl-3.0", " gpl3", r"gpl3(?: 0)?"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("gpl", "general public license", r"gnu general public license|general public license"),
    ("gpl", " gpl ", r"gnu gpl|gpl"),
    ("lgpl-2.1", "general public license", r"(?:gnu )?(?:lesser|library) general public license(?: version| v)? ?2(?: [01])?(?: or later| only)?"),
    ("lgpl-2.1", " lgpl ", r"(?:gnu )?lgpl(?: version| v)? 2(?: [01])?(?: or later| only)?"),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?"),
    ("lgpl-3.0", "general public license", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?(?: or later| only)?"),
    ("lgpl-3.0", " lgpl ", r"(?:gnu )?lgpl(?: version| v)? 3(?: 0)?(?: or later| only)?"),
    ("lgpl-3.0", "lgplv3", r"lgplv3"),
    ("lgpl", "general public license", r"(?:gnu )?(?:lesser|library) general public license"),
    ("lgpl", " lgpl ", r"(?:gnu )?lgpl"),
    ("agpl-3.0", "affero general public", r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?(?: or later| only)?"),
    ("agpl-3.0", " agpl ", r"(?:gnu )?agpl(?: version| v)? 3(?: 0)?(?: or later| only)?"),
    ("agpl-3.0", "agplv3", r"agplv3"),
    ("agpl", "affero general public", r"(?:gnu )?affero general public license"),
    ("agpl", " agpl ", r"(?:gnu )?agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license(?: version 1 [123])?"),
    ("gfdl", " gfdl ", r"gfdl(?: 1 [123])?"),
    ("mpl-1.1", "mozilla public", r"mozilla public license(?: version| v)? 1(?: [01])?"),
    ("mpl-1.1", " mpl 1", r"mpl 1 [01]"),
    ("mpl-2.0", "mozilla public", r"mozilla public license(?: version| v)? 2(?: 0)?"),
    ("mpl-2.0", " mpl 2", r"mpl 2 0"),
    ("mpl", "mozilla public", r"mozilla public license"),
    ("epl-1.0", "eclipse public", r"eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-1.0", " epl 1", r"epl 1 0"),
    ("epl-2.0", "eclipse public", r"eclipse public license(?: version| v)? 2(?: 0)?"),
    ("epl-2.0", " epl 2", r"epl 2 0"),
    ("epl", "eclipse public", r"eclipse public license"),
    ("edl", "eclipse distribution", r"eclipse distribution license(?: version| v)?(?: 1 0)?"),
    ("cddl", "common development", r"common development and distribution license(?: cddl)?(?: version 1 [01])?"),
    ("cddl", " cddl ", r"cddl(?: 1 [01])?"),
    ("cpl", "common public", r"common public license(?: version 1 0)?"),
    ("cpal", "common public attribution", r"common public attribution license(?: version 1 0)?"),
    ("eupl", "european union public", r"european union public licen[cs]e(?: version| v)?(?: 1 [012])?"),
    ("eupl", " eupl ", r"eupl(?: 1 [012])?"),
    ("artistic", "artistic license", r"(?:perl )?artistic license(?: version)?(?: [12] 0)?"),
    ("zlib", " zlib ", r"zlib(?: libpng)? license"),
    ("boost", "boost software", r"boost software license(?: version)?(?: 1 0)?"),
    ("boost", " bsl 1 0", r"bsl 1 0"),
    ("unlicense", " unlicense", r"(?:the )?unlicense"),
    ("wtfpl", " wtfpl ", r"wtfpl(?: version 2)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("python", "python software", r"python software foundation license(?: version 2)?"),
    ("python", " psf ", r"psf license"),
    ("ruby", " ruby ", r"ruby license"),
    ("php", " php ", r"php license(?: version)?(?: 3 01?)?"),
    ("vim", " vim ", r"vim license"),
    ("curl", " curl ", r"curl license"),
    ("ntp", " ntp ", r"ntp license"),
    ("w3c", " w3c ", r"w3c software(?: notice and)? license"),
    ("ncsa", "university of illinois", r"university of illinois(?: ncsa)? open source license"),
    ("openssl", "openssl", r"openssl license"),
    ("ofl", "open font", r"sil open font license(?: version 1 1)?|open font license"),
    ("ofl", " ofl 1", r"ofl 1 [01]"),
    ("odbl", "open database", r"open (?:data commons )?open database license|open database license(?: 1 0)?"),
    ("odbl", " odbl ", r"odbl(?: 1 0)?"),
    ("odc-by", "open data commons attribution", r"open data commons attribution license"),
    ("pddl", "public domain dedication and license", r"(?:open data commons )?public domain dedication and license"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("sspl", "server side public", r"server side public license(?: version 1)?"),
    ("busl", "business source", r"business source license(?: 1 1)?"),
    ("elastic", "elastic license", r"elastic license(?: 2 0)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) license(?: 1 0 0)?"),
    ("afl", "academic free", r"academic free license(?: version| v)?(?: 3 0)?"),
    ("osl", "open software license", r"open software license(?: version| v)?(?: 3 0)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m| m license)?"),
    ("llama", "community license", r"llama [23](?: [123])? community license(?: agreement)?"),
    ("cc0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons zero", r"creative commons zero"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-nd", "commercial no", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-sa", "commercial share", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nc", "creative commons attribution non", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-nd", "creative commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-sa", "creative commons attribution share", r"creative commons attribution share ?alike"),
    ("cc-by", "cc by", r"cc by(?: [1234] [05])?"),
    ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1234] [05])?"),
    ("creative-commons", "creative commons", r"creative commons license|creative commons"),
)

#: (priority, less is better; strength; words before the name; words after it). A weaker form may stand inside a stronger one.
FORMS = (
    (1, 1.0, "spdx license identifier ", ""),
    (2, 0.95, r"(?:this \w+ |this work |it |code |software )?(?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of (?:the )?)?", r"(?: license)?"),
    (2, 0.95, r"(?:is |are )?(?:released|distributed|published|available|made available|provided|shared) under (?:the )?(?:terms of (?:the )?)?", r"(?: license)?"),
    (2, 0.9, r"(?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of (?:the )?)?", r"(?: license)?"),
    (3, 0.85, r"license[sd]? (?:by |is |as )?", ""),
    (4, 0.6, r"(?:the |a |an )?", r"(?: license| licence| licensed)"),
)

#: (label, keyword, strength, sentence), priority 0: the words of the licenses themselves and of notices.
SENTENCES = (
    # MIT and its kin
    ("mit", "permission is hereby granted", 0.98, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "deal in the software without restriction", 0.97, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "substantial portions", 0.9, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "provided as is without warranty", 0.7, r"the software is provided as is without warranty of any kind express or implied"),
    ("mit", "authors or copyright holders", 0.7, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "software or the use or other dealings", 0.75, r"out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "advertising or otherwise to promote the sale", 0.8, r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", "permission to use copy modify", 0.95, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties with regard", 0.8, r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "special direct indirect or consequential", 0.7, r"in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("ntp", "appears in all copies", 0.6, r"provided that the above copyright notice appears in all copies and that both"),
    ("x11", "x consortium", 0.8, r"the name of the x consortium shall not be used in advertising"),
    # BSD
    ("bsd", "redistribution and use", 0.95, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", 0.85, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse or promote", 0.9, r"may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials mentioning", 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "this software is provided by", 0.8, r"this software is provided by the (?:copyright holders?|author|regents)(?: and contributors)? as is"),
    ("bsd", "copyright holder or contributors be liable", 0.75, r"in no event shall the copyright holder or contributors be liable for any direct indirect incidental"),
    ("bsd", "theory of liability whether in contract", 0.6, r"on any theory of liability whether in contract strict liability or tort"),
    ("bsd-clear", "no express or implied licenses to any party", 0.9, r"no express or implied licenses to any party s patent rights are granted by this license"),
    # Apache
    ("apache-2.0", "in compliance with the license", 0.98, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "as is basis", 0.8, r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "apache org licenses", 0.95, r"you may obtain a copy of the license at (?:http |https )(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "specific language governing permissions", 0.8, r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "licensed to the apache software", 0.95, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "grant of patent license", 0.7, r"grant of patent license subject to the terms and conditions of this license"),
    ("apache-2.0", "prominent notices stating that you changed", 0.7, r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "includes a notice text file", 0.8, r"if the work includes a notice text file as part of its distribution"),
    ("apache-1.1", "developed by the apache software", 0.95, r"this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl", "published by the free software foundation", 0.9, r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you can redistribute it", 0.9, r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "hope that it will be useful", 0.8, r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy of the gnu general public", 0.9, r"you should have received a copy of the gnu general public license along with this (?:program|software|file)"),
    ("gpl", "absolutely no warranty", 0.7, r"comes with absolutely no warranty"),
    ("gpl", "everyone is permitted to copy and distribute verbatim", 0.85, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "freedom to share and change", 0.85, r"licenses? (?:is|are) intended to guarantee your freedom to share and change"),
    ("gpl-2.0", "either version 2 of the license", 0.95, r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "either version 3 of the license", 0.95, r"either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license version 2 june", 0.95, r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29", 0.95, r"gnu general public license version 3 29 june 2007"),
    ("gpl", "special exception the copyright holders", 0.7, r"as a special exception the copyright holders give you permission"),
    ("gpl-classpath", "classpath exception", 0.85, r"(?:with the )?classpath exception"),
    ("lgpl", "gnu lesser general public license as published", 0.9, r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "gnu library general public license as published", 0.9, r"under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl", "this library is free software", 0.9, r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", "this library is distributed in the hope", 0.85, r"this library is distributed in the hope that it will be useful"),
    ("lgpl-2.1", "either version 2 1 of the license", 0.95, r"either version 2 1 of the license or at your option any later version"),
    ("agpl", "gnu affero general public license as published", 0.9, r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "interacting with it remotely", 0.9, r"users interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy distribute", 0.9, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", 0.8, r"with no invariant sections no front cover texts and no back cover texts"),
    # weak copyleft
    ("mpl-2.0", "source code form is subject", 0.98, r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-2.0", "copy of the mpl was not distributed", 0.95, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible with secondary licenses", 0.85, r"incompatible with secondary licenses"),
    ("mpl-1.1", "contents of this file are subject to the mozilla", 0.95, r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-1.1", "the original code is", 0.5, r"the initial developer of the original code is|the original code is"),
    ("epl", "made available under the terms of the eclipse", 0.95, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "terms of the common development", 0.95, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "opensolaris license", 0.8, r"you can obtain a copy of the license at usr src opensolaris license"),
    ("cpl", "this common public license", 0.9, r"the accompanying program is provided under the terms of this common public license"),
    ("eupl", "licensed under the eupl", 0.95, r"licensed under the eupl(?: version)?(?: 1 [12])?"),
    ("osl", "licensed under the open software", 0.9, r"licensed under the open software license version [123] [01]"),
    ("afl", "licensed under the academic free", 0.9, r"licensed under the academic free license version [123] [01]"),
    ("artistic", "version of the package", 0.85, r"(?:modified version|standard version) of the package"),
    ("artistic", "the same terms as perl itself", 0.95, r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("ruby", "the same terms as ruby", 0.9, r"(?:distributed )?under the same terms as ruby"),
    ("python", "psf is making python available", 0.95, r"psf is making python available to licensee on an as is basis"),
    ("php", "this product includes php software", 0.9, r"this product includes php software freely available from"),
    # short permissive licenses
    ("unlicense", "released into the public domain", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish", 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "altered source versions", 0.95, r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software must not", 0.95, r"the origin of this software must not be misrepresented"),
    ("zlib", "as is without any express or implied warranty", 0.75, r"this software is provided as is without any express or implied warranty"),
    ("zlib", "notice may not be removed or altered", 0.85, r"this notice may not be removed or altered from any source distribution"),
    ("boost", "copy of the software and accompanying documentation", 0.95, r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "license 1 0 txt", 0.9, r"see accompanying file license 1 0 txt"),
    ("wtfpl", "what the f", 0.9, r"do what the f\w+ you want to public license"),
    ("beerware", "beer ware license", 0.95, r"the beer ware license"),
    ("beerware", "buy me a beer", 0.8, r"you think this (?:stuff|software) is worth it you can buy me a beer in return"),
    ("ncsa", "neither the names of", 0.7, r"neither the names of \w+(?: \w+){0,8} nor the names of its contributors"),
    ("postgresql", "its documentation for any purpose without fee", 0.85, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", "in supporting documentation", 0.7, r"that copyright notice and this permission notice appear in supporting documentation"),
    ("curl", "copyright notice and this permission notice appear in all copies", 0.85, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("openssl", "developed by the openssl project", 0.95, r"this product includes software developed by the openssl project"),
    ("ssleay", "written by eric young", 0.9, r"this product includes cryptographic software written by eric young"),
    ("libpng", "png reference library", 0.85, r"the png reference library is supplied as is"),
    ("freetype", "freetype project", 0.8, r"portions of this software are copyright c? ?(?:19|20)\d\d the freetype project"),
    ("ijg", "independent jpeg group", 0.85, r"this software is based in part on the work of the independent jpeg group"),
    ("unicode", "unicode data files", 0.85, r"obtaining a copy of the unicode data files"),
    ("w3c", "w3c software notice", 0.9, r"w3c software notice and (?:document )?license"),
    ("json", "used for good not evil", 0.95, r"the software shall be used for good not evil"),
    ("ofl", "licensed under the sil open font", 0.95, r"this font software is licensed under the sil open font license"),
    ("ofl", "reserved font name", 0.8, r"with reserved font name"),
    # creative commons and data
    ("cc0", "has dedicated the work to the public domain", 0.95, r"has dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("cc0", "copyright and related or neighboring rights", 0.85, r"waived all copyright and related or neighboring rights"),
    ("cc-by", "give appropriate credit", 0.8, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by", "creativecommons org licenses by ", 0.95, r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa", 0.95, r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc ", 0.95, r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", 0.95, r"creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", 0.95, r"creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nd", "creativecommons org licenses by nd", 0.95, r"creativecommons org licenses by nd [1234] [05]"),
    ("cc0", "creativecommons org publicdomain", 0.95, r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-sa", "must distribute your contributions under the same", 0.85, r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "may not use the material for commercial", 0.85, r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "may not distribute the modified material", 0.85, r"you may not distribute the modified material"),
    ("odbl", "made available under the open database", 0.95, r"made available under the open database license"),
    ("odbl", "openstreetmap contributors", 0.7, r"openstreetmap contributors"),
    ("ogl", "open government licen", 0.9, r"(?:contains public sector information )?licensed under the open government licen[cs]e(?: v3 0| v2 0)?"),
    # restricted and proprietary
    ("ms-pl", "copyright license to reproduce", 0.6, r"non exclusive worldwide royalty free (?:reproduction )?copyright license to reproduce"),
    ("sspl", "offering the program as a service", 0.8, r"offering the program as a service"),
    ("busl", "change date", 0.6, r"change date (?:is|means|\d\d\d\d)"),
    ("elastic", "hosted or managed service", 0.8, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", 0.9, r"commons clause license condition|subject to the commons clause"),
    ("commons-clause", "right to sell the software", 0.85, r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("openrail", "use based restrictions", 0.8, r"use based restrictions (?:as )?(?:set forth|referenced)"),
    ("llama", "monthly active users", 0.7, r"greater than 700 million monthly active users"),
    ("non-commercial", "non commercial use only", 0.8, r"(?:for|licensed for|permitted for) (?:personal and )?non commercial use only"),
    ("non-commercial", "research purposes only", 0.7, r"(?:for|licensed for) (?:non commercial )?(?:academic )?research purposes only"),
    ("evaluation", "evaluation purposes only", 0.7, r"(?:for|licensed for) evaluation purposes only"),
    ("shareware", "shareware", 0.6, r"this (?:software|program) is shareware"),
    ("freeware", "freeware", 0.6, r"this (?:software|program) is freeware|freeware license"),
    ("eula", "end user license agreement", 0.8, r"end user license agreement"),
    ("eula", "reverse engineer decompile", 0.7, r"you may not (?:modify )?reverse engineer decompile or disassemble the software"),
    ("eula", "software is licensed not sold", 0.85, r"the software is licensed not sold"),
    ("eula", "installing copying or otherwise using", 0.8, r"by installing copying or otherwise using the software"),
    ("oracle", "oracle technology network", 0.85, r"oracle technology network license agreement"),
    ("oracle", "oracle binary code", 0.9, r"oracle binary code license agreement"),
    ("nvidia", "nvidia software license", 0.85, r"nvidia software license agreement"),
    ("intel", "intel simplified software", 0.9, r"intel simplified software license"),
    ("us-government", "restricted rights legend", 0.7, r"(?:us |u s )?government restricted rights legend|restricted rights legend"),
    ("us-government", "commercial computer software", 0.6, r"commercial computer software documentation"),
    ("us-government", "work of the united states government", 0.85, r"(?:is |was )?(?:a )?work of the united states government"),
    ("trade-secret", "trade secret", 0.7, r"trade secrets? (?:of|and confidential)"),
    ("proprietary", "proprietary and confidential", 0.8, r"proprietary and confidential"),
    ("proprietary", "confidential and proprietary", 0.8, r"confidential and proprietary"),
    ("proprietary", "proprietary license", 0.8, r"proprietary license"),
    ("proprietary", "unauthorized", 0.8, r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|material|document|work)"),
    ("proprietary", "prior written permission", 0.6, r"without (?:the )?(?:express )?prior written permission of (?:the )?(?:publisher|copyright owner|author)"),
    ("proprietary", "no part of this", 0.7, r"no part of this (?:publication|book|document|work|site) may be reproduced"),
    ("proprietary", "may not be reproduced", 0.6, r"may not be reproduced (?:distributed |or distributed |in whole or in part )"),
    ("fair-use", "fair use notice", 0.6, r"fair use notice"),
    ("fair-use", "disclaimer under section", 0.6, r"copyright disclaimer under section 107"),
    # notices
    ("public-domain", "public domain", 0.8, r"(?:released|dedicated|placed|is|are) (?:in|into|to) the public domain"),
    ("public-domain", "no copyright is claimed", 0.8, r"no copyright is claimed"),
    ("public-domain", "public domain", 0.5, r"public domain"),
    ("reserved", "all rights reserved", 0.9, r"all rights reserved"),
    ("reserved", "alle rechte vorbehalten", 0.9, r"alle rechte vorbehalten"),
    ("reserved", "tous droits", 0.9, r"tous droits r\w+"),
    ("reserved", "todos los derechos reservados", 0.9, r"todos los derechos reservados"),
    ("reserved", "some rights reserved", 0.6, r"some rights reserved"),
    ("copyright", "copyright", 0.5, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", "copyrighted material", 0.4, r"(?:is|contains) copyrighted material"),
    ("trademark", "registered trademark", 0.4, r"(?:is a |are )?registered trademarks? of"),
    ("dual", "dual licensed", 0.6, r"(?:is |are )?dual licensed"),
    ("dual", "at your option under", 0.6, r"licensed at your option under"),
    ("license-file", "license file in the root", 0.7, r"license file in the root (?:directory )?of this (?:source tree|repository|project)"),
    ("license-file", "governed by a bsd style license", 0.9, r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("license-file", "governed by an mit style license", 0.9, r"use of this source code is governed by an mit style license that can be found in the license file"),
    ("license-file", "see the license file", 0.6, r"see the license file for (?:details|more information|the full text)"),
    ("terms", "terms of service", 0.4, r"(?:subject to|governed by) (?:our |the )?terms of service"),
)
#: Labels, or beginnings of them, whose names mean the license without words around them.
ALONE = ("cc", "gpl-", "lgpl", "agpl", "gfdl", "mpl-", "epl-", "cddl", "eupl", "ofl", "odbl", "openrail", "wtfpl")
#: A text without any of these holds no license; each rule's matches and each base phrase hold one.
STEMS = ("licen", "cc by", "gpl", "cc0", " mpl ", " epl ", "cddl", "creative commons", "creativecommons", "rights reserved", "public", "permission", "redistribut", "copyright", "spdx", "proprietary", "unauthorized",
         "endorse", "warrant", "altered", "software", "damages", "liab", "trademark", "trade secret", "restrict", "reproduced", "confidential", "beer", "derecho", "vorbehalten", "tous droits", "gfdl", "eupl", " ofl ", "odbl",
         " under ", "subject to", "governed by", "in accordance", "pursuant", " only ", "wtfpl", "openrail", "monthly active", "original code", "notice", "advertis", "this program", "classpath", "same terms", "all copies", "this library", "may not use",
         "openstreetmap", "change date", "font name", "png reference", "unicode data", "contributors", "of the package", "program as a service", "invariant", "modified", "remotely", "united states", "hereby", "acknowledgement")


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, regular expression, strength): sentences first, then every license in every form."""
    out = [(0, label, keyword, f" (?:{sentence})(?= )", strength) for label, keyword, strength, sentence in SENTENCES]
    for priority, strength, before, after in FORMS:
        out += [(priority, label, keyword, f" {before}(?:{names}){after}(?= )", strength) for label, keyword, names in LICENSES]
    # names that mean a license wherever they stand need no words around them
    out += [(4, label, keyword, f" (?:{names})(?= )", 0.6) for label, keyword, names in LICENSES if label.startswith(ALONE)]
    return out


def _literal_rules() -> Column:
    """All rules as one literal, which the optimizer parses once."""
    rows = [{"priority": p, "label": label, "keyword": k, "pattern": rx, "strength": s} for p, label, k, rx, s in rules()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<priority:int,label:string,keyword:string,pattern:string,strength:double>>")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(text: Column, rule: Column) -> Column:
    """The intervals of the rule's matches, from the lengths of the pieces between them."""
    pieces = F.split(text, rule["pattern"], -1)
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("length")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,priority:int,label:string,strength:double>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        hit = F.struct(a.alias("start"), (a + x["length"]).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["strength"].alias("strength"))
        return F.struct((a + x["length"]).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def _kept(hits: Column) -> Column:
    """The hits that don't lie inside one of the same or a better priority; of equal intervals the first rule's stays.

    In the order of start, then of longest first, a hit lies inside an earlier one if an earlier end is not before its own.
    """
    ordered = F.array_sort(hits, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"])
                           .otherwise(a["priority"] - b["priority"]))
    levels = range(5)
    zero = F.struct(F.array(*[F.lit(-1)] * len(levels)).alias("ends"),
                    F.expr("cast(array() as array<struct<label:string,strength:double>>)").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        inside = F.exists(F.slice(acc["ends"], F.lit(1), h["priority"] + 1), lambda e: e >= h["end"])
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == h["priority"], F.greatest(e, h["end"])).otherwise(e))
        kept = F.struct(h["label"].alias("label"), h["strength"].alias("strength"))
        return F.struct(ends.alias("ends"), F.when(inside, acc["out"]).otherwise(F.array_union(acc["out"], F.array(kept))).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    A null text counts as empty: no words, no labels (empty strings), null places, score 0. ``base`` maps phrases of lower-case words to
    labels; places may overlap. Repeated rows and null ids are kept, other columns are not carried, an empty table gives no rows. Each row is
    looked at by itself: no shuffle.
    """
    base = BASE if base is None else base
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), upper, upper.lower())
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), low.alias("low"))
    rows = rows.select("doc_id", F.regexp_replace("low", NO_WORD, " ").alias("spaced"))
    rows = rows.select("doc_id", F.concat(F.lit(" "), F.trim("spaced"), F.lit(" ")).alias("text"))
    stems = [*STEMS, *(p for p in base)]
    gate = F.lit(False)
    for stem in stems:
        gate = gate | F.contains("text", F.lit(stem))
    n_words = F.when(F.col("text") == "  ", 0).otherwise(_spaces(F.col("text")) - 1).cast("long")
    rows = rows.select("doc_id", n_words.alias("n_words"), F.when(gate, F.col("text")).alias("text"))

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in base.items():
        first, _, rest = phrase.partition(" ")
        pattern = f" {first}(?= {rest} )" if rest else f" {first}(?= )"
        n = F.when(F.contains("text", F.lit(f" {phrase} ")), F.regexp_count("text", F.lit(pattern)))
        pieces = F.when(n > 0, F.split("text", pattern, -1))
        counts.append(F.coalesce(n, F.lit(0)))
        firsts.append(_spaces(F.element_at(pieces, 1)))
        lasts.append(F.col("n_words") - _spaces(F.element_at(pieces, -1)))
        labels.append(F.when(n > 0, F.lit(label)))
    least = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    most = F.greatest(*lasts) if len(lasts) > 1 else lasts[0]
    rows = rows.select("*", sum(counts[1:], counts[0]).cast("long").alias("n_base"), least.cast("long").alias("first_word"), most.cast("long").alias("last_word"),
                       F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("based"))

    keywords = sorted({k for _, _, k, _, _ in rules()})
    text = F.col("text")
    present = F.filter(F.from_json(F.lit(json.dumps(keywords)), "array<string>"), lambda k: F.contains(text, k))
    rows = rows.withColumn("present", F.when(text.isNotNull(), present))
    run = F.filter(_literal_rules(), lambda r: F.array_contains(F.col("present"), r["keyword"]))
    rows = rows.withColumn("hits", F.when(F.size("present") > 0, F.flatten(F.transform(run, lambda r: _places(text, r)))))
    rows = rows.withColumn("kept", F.when(F.size("hits") > 0, _kept(F.col("hits"))))
    found = F.coalesce(F.transform("kept", lambda k: k["label"]), F.expr("cast(array() as array<string>)"))
    strength = F.coalesce(F.array_max(F.transform("kept", lambda k: k["strength"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("based", ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_distinct(F.concat("based", found))), ",").alias("labels"),
                       F.greatest(strength, F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)).alias("score"))
