"""Licence signature rules, written by hand, in order of precedence within a tier.

One rule a line: licence ; tier ; keywords ; regular expression.  A space in an
expression stands for any white space.  Tiers, strongest first: text (wording of
the licence itself), grant (a sentence that licenses the work), tag (a machine
readable mark), name (a named version), family (a name without its version),
hint (licensing language only).  A rule is tried only on texts that hold one of
its keywords in lower case, so any match of its expression must hold one of them.
"""

TIERS = ("text", "grant", "tag", "name", "family", "hint")

RULES = r"""
MIT;text;permission is hereby granted;permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT;text;furnished to do so;and to permit persons to whom the software is furnished to do so, subject to the following conditions
MIT;text;substantial portions;the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
MIT-0;text;without restriction;to deal in the software without restriction, including without limitation the rights to use(?:, copy, modify, merge)?[^.]{0,80}, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\.
X11;text;x consortium;except as contained in this notice, the name of the x consortium shall not be used
ISC;text;permission to use, copy, modify, and/or;permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
ISC;text;permission to use, copy, modify, and distribute;permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that
0BSD;text;with or without fee is hereby granted;permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.
BSD-2-Clause;text;redistribution and use;redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD-3-Clause;text;endorse or promote;neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products
BSD-4-Clause;text;advertising materials;all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-3-Clause-Clear;text;patent rights are granted;no express or implied licenses to any party's patent rights are granted by this license
BSD-2-Clause-Patent;text;each copyright holder and contributor hereby grants;subject to the terms and conditions of this license, each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual
BSD-disclaimer;text;provided by the copyright holders;this software is provided by the copyright holders and contributors "?as is"?
BSD-disclaimer;text;provided by the regents;this software is provided by the regents and contributors ``?as is''?
Apache-2.0;text;unless required by applicable law;unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
Apache-2.0;text;grant of copyright license;grant of copyright license\. subject to the terms and conditions of this license
Apache-2.0;text;grant of patent license;grant of patent license\. subject to the terms and conditions of this license
Apache-1.1;text;apache software foundation;this product includes software developed by the apache software foundation
Apache-1.0;text;apache group;this product includes software developed by the apache group for use in the apache http server project
GPL-1.0-only;text;gnu general public license;gnu general public license version 1, february 1989
GPL-2.0-only;text;gnu general public license;gnu general public license version 2, june 1991
GPL-3.0-only;text;gnu general public license;gnu general public license version 3, 29 june 2007
LGPL-2.0-only;text;library general public license;gnu library general public license version 2, june 1991
LGPL-2.1-only;text;lesser general public license;gnu lesser general public license version 2\.1, february 1999
LGPL-3.0-only;text;lesser general public license;gnu lesser general public license version 3, 29 june 2007
AGPL-3.0-only;text;affero general public license;gnu affero general public license version 3, 19 november 2007
GFDL-1.1-only;text;free documentation license;gnu free documentation license version 1\.1, march 2000
GFDL-1.2-only;text;free documentation license;gnu free documentation license version 1\.2, november 2002
GFDL-1.3-only;text;free documentation license;gnu free documentation license version 1\.3, 3 november 2008
GPL-preamble;text;designed to take away;the licenses for most software( and other practical works)? are designed to take away your freedom to share and change
GPL-2.0-or-later;grant;any later version;either version 2 of the license, or \(at your option\) any later version
GPL-3.0-or-later;grant;any later version;either version 3 of the license, or \(at your option\) any later version
LGPL-2.1-or-later;grant;any later version;lesser general public license[^.]{0,80}?either version 2\.1 of the license, or \(at your option\) any later version
LGPL-3.0-or-later;grant;any later version;lesser general public license[^.]{0,80}?either version 3(\.0)? of the license, or \(at your option\) any later version
AGPL-3.0-or-later;grant;any later version;affero general public license[^.]{0,80}?either version 3 of the license, or \(at your option\) any later version
GPL-any;grant;free software;is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license
LGPL-any;grant;free software;is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (lesser|library) general public license
AGPL-any;grant;free software;is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu affero general public license
GPL-warranty;text;fitness for a particular purpose;without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose
GPL-copy;text;you should have received a copy;you should have received a copy of the gnu (lesser |affero |library )?general public license along with this (program|library|software)
Classpath-exception-2.0;text;independent modules;as a special exception, the copyright holders of this library give you permission to link this library with independent modules
GCC-exception-3.1;text;runtime library exception;gcc runtime library exception
LLVM-exception;text;llvm exceptions;llvm exceptions to the apache 2\.0 license
Bison-exception-2.2;text;bison parser;as a special exception, you may create a larger work that contains part or all of the bison parser skeleton
Autoconf-exception-3.0;text;configure script;autoconf configure script exception
MPL-1.0;text;mozilla public license;mozilla public license version 1\.0
MPL-1.1;text;contents of this file;the contents of this file are subject to the mozilla public license version 1\.1
MPL-2.0;text;source code form;this source code form is subject to the terms of the mozilla public license, v\. 2\.0
NPL-1.1;text;netscape public;the contents of this file are subject to the netscape public license version 1\.1
EPL-1.0;text;eclipse public license;this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0
EPL-2.0;text;eclipse public license;this program and the accompanying materials are made available under the terms of the eclipse public license( v\.?)? 2\.0
CPL-1.0;text;common public license;the accompanying program is provided under the terms of this common public license
IPL-1.0;text;ibm public license;the accompanying program is provided under the terms of this ibm public license
CDDL-1.0;text;common development;common development and distribution license \(cddl\) version 1\.0
CDDL-1.1;text;common development;common development and distribution license \(cddl\) version 1\.1
EUPL-1.1;text;under the eupl;licensed under the eupl,? version 1\.1
EUPL-1.2;text;under the eupl;licensed under the eupl,? version 1\.2
OSL-3.0;text;open software license;licensed under the open software license version 3\.0
AFL-3.0;text;academic free license;licensed under the academic free license version 3\.0
AFL-2.1;text;academic free license;licensed under the academic free license version 2\.1
BSL-1.0;text;boost software license;boost software license - version 1\.0 - august 17th, 2003
BSL-1.0;grant;boost software license;distributed under the boost software license, version 1\.0
Zlib;text;origin of this software;the origin of this software must not be misrepresented; you must not claim that you wrote the original software
Zlib;text;plainly marked;altered source versions must be plainly marked as such
libpng-2.0;text;png reference library;png reference library license version 2
Unlicense;text;unencumbered;this is free and unencumbered software released into the public domain
WTFPL;text;what the fuck;do what the fuck you want to public license
Beerware;text;beer-ware,beerware;the beer-?ware license.{0,40}revision 42
PostgreSQL;text;without a written agreement;permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement
NCSA;text;university of illinois;university of illinois/ncsa open source license
Python-2.0;text;python software foundation;python software foundation license version 2
PSF-2.0;text;psf hereby;psf hereby grants licensee a nonexclusive, royalty-free, world-wide license
CNRI-Python;text;cnri;cnri license agreement
PHP-3.01;text;php license;the php license, version 3\.01
PHP-3.0;text;php license;the php license, version 3\.0\b(?!1)
Artistic-1.0;text;the intent of this document;the intent of this document is to state the conditions under which a package may be copied
Artistic-2.0;text;artistic license;the artistic license 2\.0
Ruby;text;modify it under either;you may redistribute it and/or modify it under either the terms of the (2-clause bsdl|gpl)
Vim;text;vim;vim license
OpenSSL;text;openssl;this product includes software developed by the openssl project
SSLeay;text;eric young;this product includes cryptographic software written by eric young
curl;text;with or without fee is hereby granted;permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
ICU;text;icu license;icu license - icu 1\.8\.1 and later
Unicode-DFS-2016;text;unicode;unicode, inc\. license agreement - data files and software
Unicode-3.0;text;unicode;unicode license v3
W3C;text;w3c;w3c software (notice and license|and document notice)
FTL;text;freetype;the freetype project license
IJG;text;independent jpeg group;this software is based in part on the work of the independent jpeg group
OFL-1.1;text;open font license;sil open font license version 1\.1
OFL-1.0;text;open font license;sil open font license version 1\.0
UPL-1.0;text;universal permissive;the universal permissive license \(upl\), version 1\.0
MulanPSL-2.0;text;mulan;mulan permissive software license, version 2
MulanPSL-1.0;text;mulan;mulan permissive software license, version 1
Ms-PL;text;microsoft public;microsoft public license \(ms-pl\)
Ms-RL;text;microsoft reciprocal;microsoft reciprocal license \(ms-rl\)
QPL-1.0;text;q public license;the q public license version 1\.0
Sleepycat;text;redistributions in any form;redistributions in any form must be accompanied by information on how to obtain complete source code
LPPL-1.3c;text;latex project;latex project public license.{0,20}version 1\.3c
CECILL-2.1;text;cecill;cecill free software license agreement version 2\.1
CECILL-B;text;cecill-b;cecill-b free software license agreement
CECILL-C;text;cecill-c;cecill-c free software license agreement
SSPL-1.0;text;server side public;server side public license version 1, october 16, 2018
BUSL-1.1;text;business source license;business source license 1\.1
Elastic-2.0;text;elastic license;elastic license 2\.0
PolyForm-Noncommercial-1.0.0;text;polyform;polyform noncommercial license 1\.0\.0
PolyForm-Small-Business-1.0.0;text;polyform;polyform small business license 1\.0\.0
PolyForm-Shield-1.0.0;text;polyform;polyform shield license 1\.0\.0
Commons-Clause;text;commons clause;"?commons clause"? license condition v1\.0
Hippocratic-2.1;text;hippocratic;hippocratic license(,? version)? 2\.1
JSON;text;for good;the software shall be used for good, not evil
CC0-1.0;text;cc0,cc zero;cc0 1\.0 universal
CC0-1.0;grant;waived all copyright;has waived all copyright and related or neighboring rights
CC-BY-NC-SA-4.0;name;creative commons;creative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0( international)?
CC-BY-NC-ND-4.0;name;creative commons;creative commons attribution[- ]non-?commercial[- ]no-?deriv(ative)?s 4\.0( international)?
CC-BY-NC-4.0;name;creative commons;creative commons attribution[- ]non-?commercial 4\.0( international)?
CC-BY-SA-4.0;name;creative commons;creative commons attribution[- ]share-?alike 4\.0( international)?
CC-BY-ND-4.0;name;creative commons;creative commons attribution[- ]no-?deriv(ative)?s 4\.0( international)?
CC-BY-4.0;name;creative commons;creative commons attribution 4\.0( international)?
CC-BY-NC-SA-3.0;name;creative commons;creative commons attribution[- ]non-?commercial[- ]share-?alike 3\.0( unported)?
CC-BY-NC-ND-3.0;name;creative commons;creative commons attribution[- ]non-?commercial[- ]no-?deriv(ative)?s 3\.0( unported)?
CC-BY-NC-3.0;name;creative commons;creative commons attribution[- ]non-?commercial 3\.0( unported)?
CC-BY-SA-3.0;name;creative commons;creative commons attribution[- ]share-?alike 3\.0( unported)?
CC-BY-ND-3.0;name;creative commons;creative commons attribution[- ]no-?deriv(ative)?s 3\.0( unported)?
CC-BY-3.0;name;creative commons;creative commons attribution 3\.0( unported)?
CC-BY-SA-2.5;name;creative commons;creative commons attribution[- ]share-?alike 2\.5
CC-BY-2.5;name;creative commons;creative commons attribution 2\.5
CC-BY-SA-2.0;name;creative commons;creative commons attribution[- ]share-?alike 2\.0
CC-BY-2.0;name;creative commons;creative commons attribution 2\.0
CC-BY-NC-SA-4.0;grant;licensed under;licensed under (the |a )?cc[- ]by-nc-sa 4\.0
CC-BY-NC-ND-4.0;grant;licensed under;licensed under (the |a )?cc[- ]by-nc-nd 4\.0
CC-BY-NC-4.0;grant;licensed under;licensed under (the |a )?cc[- ]by-nc 4\.0
CC-BY-SA-4.0;grant;licensed under;licensed under (the |a )?cc[- ]by-sa 4\.0
CC-BY-ND-4.0;grant;licensed under;licensed under (the |a )?cc[- ]by-nd 4\.0
CC-BY-4.0;grant;licensed under;licensed under (the |a )?cc[- ]by 4\.0
CC-BY-any;grant;licensed under;licensed under (the |a )?cc[- ]by(-nc)?(-sa|-nd)? [123]\.\d
CC0-1.0;grant;cc0;(dedicated|released|licensed) (to the public domain )?under (the )?cc0
CC-BY-NC-SA-any;tag;creativecommons.org;creativecommons\.org/licenses/by-nc-sa/\d\.\d
CC-BY-NC-ND-any;tag;creativecommons.org;creativecommons\.org/licenses/by-nc-nd/\d\.\d
CC-BY-NC-any;tag;creativecommons.org;creativecommons\.org/licenses/by-nc/\d\.\d
CC-BY-SA-any;tag;creativecommons.org;creativecommons\.org/licenses/by-sa/\d\.\d
CC-BY-ND-any;tag;creativecommons.org;creativecommons\.org/licenses/by-nd/\d\.\d
CC-BY-any;tag;creativecommons.org;creativecommons\.org/licenses/by/\d\.\d
CC0-1.0;tag;creativecommons.org;creativecommons\.org/publicdomain/zero/1\.0
CC-PDM-1.0;tag;creativecommons.org;creativecommons\.org/publicdomain/mark/1\.0
CC-sampling;tag;creativecommons.org;creativecommons\.org/licenses/(nc-)?sampling\+?/1\.0
Apache-2.0;tag;apache.org/licenses;apache\.org/licenses/license-2\.0
GPL-2.0-any;tag;gnu.org;gnu\.org/licenses/(old-licenses/)?gpl-2\.0
GPL-3.0-any;tag;gnu.org;gnu\.org/licenses/gpl-3\.0
LGPL-2.1-any;tag;gnu.org;gnu\.org/licenses/(old-licenses/)?lgpl-2\.1
LGPL-3.0-any;tag;gnu.org;gnu\.org/licenses/lgpl-3\.0
AGPL-3.0-any;tag;gnu.org;gnu\.org/licenses/agpl-3\.0
GFDL-any;tag;gnu.org;gnu\.org/licenses/fdl(-1\.\d)?
GPL-any;tag;gnu.org;gnu\.org/(copyleft|licenses)/gpl\.(html|txt)
MPL-2.0;tag;mozilla.org;mozilla\.org/mpl/2\.0
MPL-1.1;tag;mozilla.org;mozilla\.org/mpl/mpl-1\.1
EPL-2.0;tag;eclipse.org;eclipse\.org/legal/epl-2\.0
EPL-1.0;tag;eclipse.org;eclipse\.org/legal/epl-v10
MIT;tag;opensource.org;opensource\.org/licenses/mit\b
BSD-3-Clause;tag;opensource.org;opensource\.org/licenses/bsd-3-clause
BSD-2-Clause;tag;opensource.org;opensource\.org/licenses/bsd-2-clause
ISC;tag;opensource.org;opensource\.org/licenses/isc\b
OSI-any;tag;opensource.org;opensource\.org/licenses/[a-z0-9.-]+
BSL-1.0;tag;boost.org;boost\.org/license_1_0\.txt
Unlicense;tag;unlicense.org;unlicense\.org
OFL-any;tag;scripts.sil.org;scripts\.sil\.org/ofl
WTFPL;tag;wtfpl.net;wtfpl\.net
ODbL-1.0;tag;opendatacommons;opendatacommons\.org/licenses/odbl
ODC-By-1.0;tag;opendatacommons;opendatacommons\.org/licenses/by
PDDL-1.0;tag;opendatacommons;opendatacommons\.org/licenses/pddl
SPDX-compound;tag;spdx-license-identifier;spdx-license-identifier: ?\(?[a-z0-9.+-]+( (and|or|with) \(?[a-z0-9.+-]+\)?)+
SPDX-MIT;tag;spdx-license-identifier;spdx-license-identifier: ?mit\b(?!-)
SPDX-Apache-2.0;tag;spdx-license-identifier;spdx-license-identifier: ?apache-2\.0
SPDX-GPL-2.0;tag;spdx-license-identifier;spdx-license-identifier: ?gpl-2\.0(-only|-or-later|\+)?
SPDX-GPL-3.0;tag;spdx-license-identifier;spdx-license-identifier: ?gpl-3\.0(-only|-or-later|\+)?
SPDX-LGPL;tag;spdx-license-identifier;spdx-license-identifier: ?lgpl-(2\.0|2\.1|3\.0)(-only|-or-later|\+)?
SPDX-AGPL;tag;spdx-license-identifier;spdx-license-identifier: ?agpl-(1\.0|3\.0)(-only|-or-later|\+)?
SPDX-BSD;tag;spdx-license-identifier;spdx-license-identifier: ?(0bsd|bsd-[1-4]-clause[a-z-]*)
SPDX-MPL;tag;spdx-license-identifier;spdx-license-identifier: ?mpl-(1\.0|1\.1|2\.0)
SPDX-ISC;tag;spdx-license-identifier;spdx-license-identifier: ?isc\b
SPDX-CC;tag;spdx-license-identifier;spdx-license-identifier: ?cc(0|-by(-nc)?(-sa|-nd)?)-\d\.\d
SPDX-any;tag;spdx-license-identifier;spdx-license-identifier: ?[a-z0-9.+-]+
pypi-MIT;tag;osi approved;license :: osi approved :: mit license
pypi-Apache;tag;osi approved;license :: osi approved :: apache software license
pypi-BSD;tag;osi approved;license :: osi approved :: bsd license
pypi-GPL;tag;osi approved;license :: osi approved :: gnu (lesser |affero )?general public license[^\n]{0,40}
pypi-any;tag;osi approved;license :: osi approved(?: :: [a-z0-9 ()./-]+)?
npm-license;tag;license;"license": ?"[a-z0-9.+-]{2,40}"
cargo-license;tag;license;^license ?= ?"[a-z0-9.+/ -]{2,60}"
MIT;grant;mit license;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?mit license
Apache-2.0;grant;apache license;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?apache license,? (version |v\.?)?2(\.0)?
Apache-any;grant;apache license;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?apache license
GPL-3.0;grant;general public license;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?gnu general public license,? (version |v\.?)?3(\.0)?
GPL-2.0;grant;general public license;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?gnu general public license,? (version |v\.?)?2(\.0)?
GPL-any;grant;general public license;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?gnu general public license
LGPL-any;grant;lesser general public;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?gnu lesser general public license(,? (version |v\.?)?\d(\.\d)?)?
AGPL-any;grant;affero general public;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?gnu affero general public license(,? (version |v\.?)?\d(\.\d)?)?
GPL-short;grant;gpl;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?(gnu )?[al]?gpl[- ]?v?[123](\.\d)?\+?
BSD-any;grant;bsd;(released|licensed|distributed|available|published) under (the )?(terms of )?(the |a )?(\d-clause |new |modified |simplified )?bsd( \d-clause)?[- ](style )?licen[cs]e
MPL-any;grant;mozilla public;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?mozilla public license(,? (version |v\.? ?)?\d\.\d)?
ISC;grant;isc license;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?isc license
Unlicense;grant;unlicense;(released|licensed|distributed|available|published) under (the )?unlicense
Zlib;grant;zlib;(released|licensed|distributed|available|published) under (the )?zlib(/libpng)? license
EPL-any;grant;eclipse public;(released|licensed|distributed|available|published) under (the )?(terms of )?(the )?eclipse public license(,? (version |v\.? ?)?\d\.\d)?
Artistic-any;grant;artistic license,same terms as perl;(released|licensed|distributed|available|published) under (the )?(same terms as perl itself|(terms of )?(the )?artistic license)
CC-any;grant;creative commons;(released|licensed|distributed|available|published) under (the |a )?(terms of )?(the |a )?creative commons [a-z -]{0,60}licen[cs]e
public-domain;grant;public domain;(released|placed|dedicated) (in|into|to) the public domain
Perl;grant;perl;you can redistribute it and/or modify it under the same terms as perl
same-terms;grant;under the same;under the same (terms|license) as the (original|project|main program)
dual-MIT-Apache;grant;apache;(dual[- ])?licensed under (either of |either )?(the )?(mit (license )?(or|and|/) (the )?apache|apache[^\n]{0,40} (or|and|/) (the )?mit)
GPL-3.0;name;general public license;gnu general public license,? (version |v\.? ?)3(\.0)?
GPL-2.0;name;general public license;gnu general public license,? (version |v\.? ?)2(\.0)?
GPL-1.0;name;general public license;gnu general public license,? (version |v\.? ?)1(\.0)?
LGPL-3.0;name;lesser general public;gnu lesser general public license,? (version |v\.? ?)3(\.0)?
LGPL-2.1;name;lesser general public;gnu lesser general public license,? (version |v\.? ?)2\.1
LGPL-2.0;name;library general public;gnu library general public license,? (version |v\.? ?)2(\.0)?
AGPL-3.0;name;affero general public;gnu affero general public license,? (version |v\.? ?)3(\.0)?
Apache-2.0;name;apache license;apache license,? (version |v\.? ?)2(\.0)?
Apache-1.1;name;apache;apache (software )?license,? (version |v\.? ?)1\.1
BSD-3-Clause;name;bsd;\b(bsd 3-clause|3-clause bsd|new bsd|modified bsd)( licen[cs]e)?
BSD-2-Clause;name;bsd;\b(bsd 2-clause|2-clause bsd|simplified bsd|freebsd) licen[cs]e
BSD-4-Clause;name;bsd;\b(bsd 4-clause|4-clause bsd|original bsd) licen[cs]e
MPL-2.0;name;mozilla public;mozilla public license,? (version |v\.? ?)2\.0
MPL-1.1;name;mozilla public;mozilla public license,? (version |v\.? ?)1\.1
EPL-2.0;name;eclipse public;eclipse public license,? (- )?(version |v\.? ?)2\.0
EPL-1.0;name;eclipse public;eclipse public license,? (- )?(version |v\.? ?)1\.0
CDDL;name;common development;common development and distribution license
BSL-1.0;name;boost software;boost software license
ODbL-1.0;name;database license;open (data commons )?(open )?database license
PDDL-1.0;name;public domain dedication;public domain dedication and license
CDLA-Permissive-2.0;name;community data license;community data license agreement - permissive - version 2\.0
CDLA-Sharing-1.0;name;community data license;community data license agreement - sharing - version 1\.0
OpenRAIL-M;name;openrail;\b(creativeml |bigscience )?openrail(-m|\+\+)?( licen[cs]e)?
Llama-community;name;community license;llama \d(\.\d)? community license( agreement)?
Etalab-2.0;name;licence ouverte;licence ouverte ?(/ open licence)?( version)? 2\.0
OGL-UK-3.0;name;open government;open government licen[cs]e v3\.0
OGL-UK-any;name;open government;open government licen[cs]e
DL-DE-BY-2.0;name;datenlizenz;datenlizenz deutschland[^\n]{0,5}namensnennung[^\n]{0,5}version 2\.0
GFDL-any;name;free documentation;gnu free documentation license
MIT;family;mit licen;\bmit licen[cs]e
X11;family;x11 licen;\bx11 licen[cs]e
ISC;family;isc licen;\bisc licen[cs]e
BSD-any;family;bsd;\bbsd[- ](style )?licen[cs]e
GPL-any;family;general public license;gnu general public license
LGPL-any;family;lesser general public,library general public;gnu (lesser|library) general public license
AGPL-any;family;affero general public;gnu affero general public license
Apache-any;family;apache;apache (software )?licen[cs]e
MPL-any;family;mozilla public;mozilla public licen[cs]e
EPL-any;family;eclipse public;eclipse public licen[cs]e
EUPL-any;family;european union public;european union public licen[cs]e
Artistic-any;family;artistic licen;\bartistic licen[cs]e
CC-any;family;creative commons;creative commons
OFL-any;family;open font;open font licen[cs]e
CECILL-any;family;cecill;\bcecill\b
SSPL-any;family;server side public;server side public licen[cs]e
MS-any;family;microsoft;microsoft (public|reciprocal|limited public) licen[cs]e
GPL-abbreviation;family;gpl;\b[al]?gpl(v[123](\.\d)?|-[123]\.\d)\+?
CC-abbreviation;family;cc by,cc-by,cc+by;\bcc[- ]by(-nc)?(-sa|-nd)?( \d\.\d)?\b
CC0-abbreviation;family;cc0;\bcc0\b
proprietary;hint;proprietary;\bproprietary (and confidential|software|licen[cs]e)
confidential;hint;confidential;strictly confidential|confidential and proprietary
all-rights-reserved;hint;all rights reserved;all rights reserved
all-rights-reserved-fr;hint;tous droits;tous droits r[ée]serv[ée]s
all-rights-reserved-de;hint;alle rechte;alle rechte vorbehalten
all-rights-reserved-es;hint;todos los derechos;todos los derechos reservados
no-redistribution;hint;redistribut,copied,copy,reproduce;(may not|do not|no) (be )?(copied|copy|reproduced?|redistribut(e|ed|ion))\b
non-commercial;hint;commercial;(for )?non-?commercial (use|purposes?) only
personal-use;hint;personal use;for personal use only
permission-required;hint;without prior,without express,without the prior,without the express;without (the )?(prior|express) (written )?(permission|consent)
copyright-notice;hint;copyright;copyright (\(c\)|©)? ?(19|20)\d\d( ?[-–,] ?(19|20)\d\d)*
copyright-sign;hint;©,(c);(©|\(c\)) ?(19|20)\d\d
eula;hint;end user,end-user,end+user;end[- ]user licen[cs]e agreement
trademark;hint;trademark;(registered )?trademarks? of .{1,60}?(inc|corp|ltd|gmbh)\b
terms-of-use;hint;terms of;(subject to|accept) (the|these|our) terms of (use|service)
see-license;hint;license file,licence file,license.txt file,licence.txt file,license.md file,licence.md file;(see|in) (the )?licen[cs]e(\.(txt|md))? file
licensed-under;hint;licensed under;licensed under (the )?[a-z][^\n.]{2,60}
work-licensed;hint;is licensed,is licenced;this (work|project|software|content|document|dataset) is licen[cs]ed
public-domain;hint;public domain;\bpublic domain\b
copyleft;hint;copyleft;\bcopyleft\b
open-source;hint;open source,open-source,open+source;\bopen[- ]source (software|licen[cs]e)
warranty-disclaimer;hint;as is;provided "?as is"?,? without (any )?warrant(y|ies)
"""
