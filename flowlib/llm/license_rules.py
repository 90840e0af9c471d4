"""Signature rules for licence notices, one per line: label, strength, keywords, pattern.

Patterns see a text as lower-case words joined by single spaces (``Apache-2.0`` is ``apache 2 0``) and match whole
words only. A rule runs only where all its keywords (joined by ``+``) occur, so every alternative of its pattern must
hold them; alternatives without a common word are rules of their own. ``<2>`` stands for a version number with
or without "version" or "v" and ".0", ``<2.1>`` for one with a minor number, ``<lic>`` for license or licence,
``<l>`` for an optional license word, ``<later>`` for "or later".
"""

from __future__ import annotations

import re

RULES = r"""
mit 90 mit+license under (?:the )?(?:terms of )?(?:the )?mit <lic>
mit 85 mit+license (?:the )?mit <lic> mit
mit 80 mit+license mit <lic>
mit 85 mit+spdx spdx <lic> identifier mit
mit 95 permission+granted permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 75 notice+permission the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 60 noninfringement fitness for a particular purpose and noninfringement
mit 70 expat expat <lic>
mit 70 x11 (?:mit )?x11 <lic>
mit-0 90 mit mit 0(?: <lic>)?
mit-0 90 mit+attribution mit no attribution
mit-modern 85 mit mit modern variant
mit-cmu 85 cmu (?:mit )?cmu <lic>
isc 85 isc isc <lic>
isc 85 isc+spdx spdx <lic> identifier isc
isc 90 permission+fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd 90 0bsd 0bsd
0bsd 90 bsd (?:zero|0) clause bsd<l>
bsd-1 85 bsd bsd (?:1|one) clause<l>
bsd-1 85 bsd (?:1|one) clause bsd<l>
bsd-2 90 bsd bsd (?:2|two) clause<l>
bsd-2 90 bsd (?:2|two) clause bsd<l>
bsd-2 85 bsd simplified bsd<l>
bsd-2 85 freebsd freebsd <lic>
bsd-3 90 bsd bsd (?:3|three) clause<l>
bsd-3 90 bsd (?:3|three) clause bsd<l>
bsd-3 85 bsd (?:new|revised|modified) bsd<l>
bsd-3 80 endorse neither the name of .{1,120}? may be used to endorse or promote products derived from this software
bsd-3-clear 90 bsd bsd (?:3|three) clause clear<l>
bsd-4 90 bsd bsd (?:4|four) clause<l>
bsd-4 90 bsd (?:4|four) clause bsd<l>
bsd-4 80 advertising all advertising materials mentioning features or use of this software must display
bsd 60 bsd bsd <lic>
bsd 60 bsd bsd style <lic>
bsd 55 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd 50 redistributions redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice
bsd-patent 85 bsd bsd (?:2 clause )?plus patent<l>
apache-1 85 apache apache <lic> <1>
apache-1 85 apache apache software <lic> <1>
apache-1.1 90 apache apache (?:software )?<lic> <1.1>
apache-1.1 90 apache apache 1 1
apache-2 90 apache apache (?:software )?<lic> <2>
apache-2 90 apache+spdx spdx <lic> identifier apache 2 0
apache-2 85 apache apache 2(?: 0)?(?: <lic>)?
apache-2 85 apache apache v2(?: 0)?
apache-2 80 apache+licenses www apache org licenses <lic> 2 0
apache-2 85 asf licensed to the apache software foundation asf
apache-2 75 compliance+license you may not use this file except in compliance with the <lic>
apache-2 65 warranties+basis distributed on an as is basis without warranties or conditions of any kind
apache 55 apache apache (?:software )?<lic>
asl-2 70 asl asl <2>
gpl-1 90 gpl gpl <1>(?: only)?
gpl-1 90 gnu+general gnu general public <lic> <1>
gpl-2 90 gpl gpl <2>(?: only)?
gpl-2 90 gplv2 gplv2
gpl-2 90 gnu+general gnu general public <lic> <2>
gpl-2 85 gnu+published gnu general public <lic> as published by the free software foundation <2>
gpl-2+ 95 gpl gpl <2><later>
gpl-2+ 95 gplv2 gplv2(?: plus|<later>)
gpl-2+ 95 gplv2plus gplv2plus
gpl-2+ 95 gnu+general gnu general public <lic>(?: as published by the free software foundation(?: either)?)? <2><later>
gpl-2-classpath 95 classpath gpl <2> with(?: the)? classpath exception
gpl-2-linking 90 linking+exception gpl <2> with(?: a)? linking exception
gpl-3 90 gpl gpl <3>(?: only)?
gpl-3 90 gplv3 gplv3
gpl-3 90 gnu+general gnu general public <lic> <3>
gpl-3+ 95 gpl gpl <3><later>
gpl-3+ 95 gplv3 gplv3(?: plus|<later>)
gpl-3+ 95 gplv3plus gplv3plus
gpl-3+ 95 gnu+general gnu general public <lic>(?: as published by the free software foundation(?: either)?)? <3><later>
gpl-3-gcc 95 gcc+exception gcc runtime library exception
gpl 60 gnu+general gnu general public <lic>
gpl 55 gpl gnu gpl
gpl 50 gpl gpl <lic>
gpl 50 gpl licensed under (?:the )?gpl
gpl 55 received+gnu you should have received a copy of the gnu general public <lic>
lgpl-2 90 lgpl lgpl <2>(?: only)?
lgpl-2 90 gnu+library gnu library general public <lic> <2>
lgpl-2+ 95 lgpl lgpl <2><later>
lgpl-2.1 90 lgpl lgpl <2.1>(?: only)?
lgpl-2.1 90 gnu+lesser gnu lesser general public <lic> <2.1>
lgpl-2.1+ 95 lgpl lgpl <2.1><later>
lgpl-2.1+ 95 gnu+lesser gnu lesser general public <lic> <2.1><later>
lgpl-3 90 lgpl lgpl <3>(?: only)?
lgpl-3 90 lgplv3 lgplv3
lgpl-3 90 gnu+lesser gnu lesser general public <lic> <3>
lgpl-3+ 95 lgpl lgpl <3><later>
lgpl-3+ 95 gnu+lesser gnu lesser general public <lic> <3><later>
lgpl 60 gnu+lesser gnu lesser general public <lic>
lgpl 60 gnu+library gnu library general public <lic>
lgpl 55 lgpl gnu lgpl
agpl-1 90 affero affero general public <lic> <1>
agpl-3 90 agpl agpl <3>(?: only)?
agpl-3 90 agplv3 agplv3
agpl-3 90 affero (?:gnu )?affero general public <lic> <3>
agpl-3+ 95 agpl agpl <3><later>
agpl-3+ 95 affero (?:gnu )?affero general public <lic> <3><later>
agpl 60 affero (?:gnu )?affero general public <lic>
agpl 55 agpl gnu agpl
gfdl-1.1 90 gfdl gfdl <1.1>
gfdl-1.2 90 gfdl gfdl <1.2>
gfdl-1.2 90 gnu+documentation gnu free documentation <lic> <1.2>
gfdl-1.3 90 gfdl gfdl <1.3>
gfdl-1.3 90 gnu+documentation gnu free documentation <lic> <1.3>
gfdl 60 gnu+documentation gnu free documentation <lic>
mpl-1 90 mozilla mozilla public <lic> <1>
mpl-1.1 90 mpl mpl <1.1>
mpl-1.1 90 mozilla mozilla public <lic> <1.1>
mpl-2 90 mpl mpl <2>
mpl-2 90 mozilla mozilla public <lic> <2>
mpl-2 85 mozilla+source this source code form is subject to the terms of the mozilla public <lic>
mpl 60 mozilla mozilla public <lic>
npl-1.1 85 netscape netscape public <lic> <1.1>
epl-1 90 epl epl <1>
epl-1 90 eclipse eclipse public <lic> <1>
epl-2 90 epl epl <2>
epl-2 90 eclipse eclipse public <lic> <2>
epl 60 eclipse eclipse public <lic>
edl-1 90 eclipse eclipse distribution <lic> <1>
cpl-1 90 cpl cpl <1>
cpl-1 85 common+public common public <lic> <1>
ipl-1 85 ibm ibm public <lic> <1>
cddl-1 90 cddl cddl <1>
cddl-1.1 90 cddl cddl <1.1>
cddl 80 development+distribution common development and distribution <lic>
eupl-1.1 90 eupl eupl <1.1>
eupl-1.2 90 eupl eupl <1.2>
eupl 60 union european union public <lic>
cecill-2.1 90 cecill cecill <2.1>
cecill-b 90 cecill cecill b
cecill-c 90 cecill cecill c
cecill 60 cecill cecill(?: free software)? <lic>
osl-3 90 open+software open software <lic> <3>
osl-3 90 osl osl <3>
afl-3 90 academic academic free <lic> <3>
afl-3 90 afl afl <3>
afl-2.1 90 academic academic free <lic> <2.1>
artistic-1 90 artistic artistic <lic> <1>
artistic-2 90 artistic artistic <lic> <2>
artistic-2 85 artistic artistic 2(?: 0)?
artistic 60 artistic artistic <lic>
perl 70 perl same terms as perl(?: itself)?
bsl-1 90 boost boost software <lic>(?: <1>)?
bsl-1 85 bsl bsl <1>
busl-1.1 90 business business source <lic> <1.1>
busl 70 business business source <lic>
sspl-1 90 sspl sspl <1>
sspl-1 85 server+side server side public <lic>
elastic-2 90 elastic elastic <lic> <2>
elastic 70 elastic elastic <lic>
polyform-nc 90 polyform polyform noncommercial <lic>
polyform-sb 90 polyform polyform small business <lic>
zlib 85 zlib zlib <lic>
zlib 85 zlib+libpng zlib libpng<l>
zlib 80 misrepresented the origin of this software must not be misrepresented
libpng-2 85 libpng libpng <lic> <2>
libpng-2 85 png+reference png reference library <lic> <2>
ijg 80 jpeg independent jpeg group(?: s)?(?: <lic>)?
curl 80 curl curl <lic>
openssl 85 openssl openssl <lic>
ssleay 85 ssleay (?:original )?ssleay <lic>
python-2 85 python+foundation python software foundation <lic>(?: <2>)?
python-2 80 psf psf <lic>(?: <2>)?
php-3 85 php php <lic> <3>
php-3.01 90 php php <lic> <3.01>
ruby 75 ruby ruby(?: s)? <lic>
tcl 75 tcl tcl tk <lic>
vim 75 vim vim <lic>
w3c 80 w3c w3c (?:software )?(?:notice and )?<lic>
unicode 80 unicode unicode (?:data files and software )?<lic>(?: agreement)?
icu 75 icu icu <lic>
ncsa 85 ncsa (?:university of illinois )?ncsa(?: open source)?<l>
postgresql 85 postgresql postgresql <lic>
unlicense 90 unlicense (?:the )?unlicense
unlicense 90 unencumbered this is free and unencumbered software released into the public domain
wtfpl 90 wtfpl wtfpl
beerware 85 beer+ware (?:the )?beer ware <lic>
beerware 85 beerware (?:the )?beerware <lic>
beerware 85 beerware beerware
blueoak-1 90 blue blue oak model <lic>(?: <1>)?
mulan-2 90 mulan mulan (?:permissive software|psl) ?(?:<lic>)? ?<2>
upl-1 85 upl (?:universal permissive <lic> )?upl <1>
upl-1 85 universal+permissive universal permissive <lic>
ms-pl 85 microsoft microsoft public <lic>
ms-rl 85 microsoft microsoft reciprocal <lic>
ofl-1.1 90 ofl (?:sil )?ofl <1.1>
ofl-1.1 85 sil sil open font <lic>(?: <1.1>)?
oflb 70 font open font <lic>
ubuntu-font 85 ubuntu ubuntu font <lic>
lppl-1.3c 90 lppl lppl <1.3>c?
lppl 80 latex latex project public <lic>
odbl-1 85 odbl (?:open database <lic> )?odbl(?: <1>)?
odbl-1 85 database open (?:data commons open )?database <lic>(?: <1>)?
odc-by 85 attribution+commons open data commons attribution <lic>
pddl 85 dedication public domain dedication and <lic>
cdla-permissive-2 90 cdla cdla permissive <2>
cdla-sharing-1 90 cdla cdla sharing <1>
ogl-uk-3 90 government open government <lic>(?: <3>)?
etalab-2 85 etalab (?:licence ouverte )?etalab(?: <2>)?
cc0 90 cc0 cc0(?: <1>)?(?: universal)?
cc0 85 cc cc zero
cc0 85 creative+zero creative commons zero
cc-by-1 90 cc cc by <1>
cc-by-2 90 cc cc by <2>
cc-by-2.5 90 cc cc by <2.5>
cc-by-3 90 cc cc by <3>
cc-by-4 90 cc cc by <4>
cc-by 70 cc cc by
cc-by 75 creative+attribution creative commons attribution(?: <lic>)?
cc-by-3 90 creative+attribution creative commons attribution <3>
cc-by-4 90 creative+attribution creative commons attribution <4>(?: international)?
cc-by-sa-2 95 cc cc by sa <2>
cc-by-sa-3 95 cc cc by sa <3>
cc-by-sa-4 95 cc cc by sa <4>
cc-by-sa 80 cc cc by sa
cc-by-sa 85 creative+attribution creative commons attribution share ?alike
cc-by-sa-3 95 creative+attribution creative commons attribution share ?alike <3>
cc-by-sa-4 95 creative+attribution creative commons attribution share ?alike <4>(?: international)?
cc-by-nd-3 95 cc cc by nd <3>
cc-by-nd-4 95 cc cc by nd <4>
cc-by-nd 80 cc cc by nd
cc-by-nd 85 creative+attribution creative commons attribution no ?derivatives
cc-by-nc-2 95 cc cc by nc <2>
cc-by-nc-3 95 cc cc by nc <3>
cc-by-nc-4 95 cc cc by nc <4>
cc-by-nc 85 creative+attribution creative commons attribution non ?commercial
cc-by-nc-sa-3 97 cc cc by nc sa <3>
cc-by-nc-sa-4 97 cc cc by nc sa <4>
cc-by-nc-sa 90 cc cc by nc sa
cc-by-nc-sa 90 creative+attribution creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-3 97 cc cc by nc nd <3>
cc-by-nc-nd-4 97 cc cc by nc nd <4>
cc-by-nc-nd 90 cc cc by nc nd
cc-by-nc-nd 90 creative+attribution creative commons attribution non ?commercial no ?derivatives
cc-devnations 85 developing creative commons developing nations
creative-commons 50 creative creative commons(?: <lic>)?
creative-commons 60 creativecommons creativecommons org licenses
openrail-m 85 openrail (?:creativeml )?openrail m
openrail-m 85 open+rail (?:creativeml )?open rail m
llama-community 80 llama llama (?:2 |3 )?community <lic>
gemma-terms 75 gemma gemma terms of use
rail 75 responsible responsible ai <lic>
public-domain 70 domain (?:in|into|to) the public domain
public-domain 60 domain public domain
proprietary 70 reserved all rights reserved
proprietary 75 proprietary proprietary and confidential
proprietary 70 confidential confidential(?: and)? proprietary information
proprietary 60 not+copy (?:may not|do not) copy
proprietary 60 not+redistribute (?:may not|do not) redistribute
proprietary 60 not+reproduce (?:may not|do not) reproduce
proprietary 65 permission (?:without|no part) .{0,80}?(?:prior )?written permission
evaluation 60 evaluation for evaluation (?:purposes )?only
noncommercial 65 commercial (?:for )?non commercial (?:use|purposes)(?: only)?
noncommercial 65 noncommercial (?:for )?noncommercial (?:use|purposes)(?: only)?
research-only 65 research+only (?:for )?research (?:use|purposes) only
research-only 65 academic+only (?:for )?academic (?:use|purposes) only
eula 60 eula (?:end user <lic> agreement )?eula
eula 60 agreement end user <lic> agreement
shareware 55 shareware shareware
freeware 55 freeware freeware
unknown-notice 30 license (?<=under the )(?:\S+ ){0,4}?<lic>
unknown-notice 30 license (?<=terms of the )(?:\S+ ){0,4}?<lic>
unknown-notice 20 license (?:see|read) (?:the )?<lic>(?: file| text)?
unknown-notice 20 spdx spdx <lic> identifier \S+
"""

_NUMBER = r"(?:version |v |ver |release )?v?"


def pattern(text: str) -> str:
    """A rule's pattern with its short forms written out."""
    text = text.replace("<lic>", "licen[cs]e").replace("<later>", r"(?: or (?:any |at your option any )?(?:later|newer)(?: version)?| plus)").replace("<l>", "(?: licen[cs]e)?")
    text = re.sub(r"<(\d+)\.(\d+)>", rf"{_NUMBER}\1 \2", text)
    return re.sub(r"<(\d+)>", rf"{_NUMBER}\1(?: 0)?", text)


def parsed() -> list[tuple[str, int, tuple[str, ...], str]]:
    """(label, strength, keywords, pattern) of every rule."""
    rows = [line.split(" ", 3) for line in RULES.strip().splitlines()]
    return [(label, int(strength), tuple(words.split("+")), pattern(text)) for label, strength, words, text in rows]
