"""Signatures of licenses, written by hand: one a line, ``label level gate : pattern``.

A pattern is matched on lower-case words with one blank between them (``cc by nc 4 0``). It may use groups, options and
``\\S+`` for any word. Levels: 1 a tag or a license's own sentence, 2 a title or name with what is needed to know it,
3 a name alone. The words of the gate, joined by ``+``, must all be in a document, or the pattern isn't tried.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A signature: what it stands for, how sure it is, the words that it needs, and its pattern."""

    label: str
    level: int
    gate: tuple[str, ...]
    pattern: str


SIGNATURES = r"""
mit 1 spdx+mit : spdx license identifier mit
mit 1 charge+obtaining : permission is hereby granted free of charge to any person obtaining a copy of this software
mit 1 mit+license : (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit license
mit 1 mit+licence : (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit licence
mit 2 mit+license : (?:the )?mit license(?: mit)?
mit 2 mit+licence : (?:the )?mit licence
mit 2 mit+licensed : mit licensed
mit 2 mit+lizenz : mit lizenz
mit 2 opensource+mit : opensource org licenses? mit(?: license)?
mit 2 expat+license : expat license
mit-0 1 spdx+mit : spdx license identifier mit 0
mit-0 2 mit+attribution : mit no attribution
x11 1 spdx+x11 : spdx license identifier x11
x11 2 x11+license : (?:the )?x11 license
isc 1 spdx+isc : spdx license identifier isc
isc 1 purpose+fee : permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc 2 isc+license : (?:the )?isc license
0bsd 1 spdx+0bsd : spdx license identifier 0bsd
0bsd 2 bsd+zero : (?:bsd zero clause|zero clause bsd)(?: license)?
bsd-2 1 spdx+bsd : spdx license identifier bsd 2 clause(?: \S+)?
bsd-2 2 bsd+simplified : simplified bsd license
bsd-2 2 freebsd+license : freebsd license
bsd-2 2 bsd+clause : (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: license)?
bsd-3 1 spdx+bsd : spdx license identifier bsd 3 clause(?: \S+)?
bsd-3 1 neither+endorse : neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software
bsd-3 2 bsd+new : new bsd license
bsd-3 2 bsd+modified : modified bsd license
bsd-3 2 bsd+revised : revised bsd license
bsd-3 2 bsd+clause : (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: license)?
bsd-4 1 spdx+bsd : spdx license identifier bsd 4 clause(?: uc)?
bsd-4 1 advertising+materials : all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4 2 bsd+clause : (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: license)?
bsd-4 2 bsd+original : original bsd license
bsd 1 redistributions+source : redistributions of source code must retain the above copyright notice
bsd 1 redistribution+binary : redistribution and use in source and binary forms with or without modification are permitted
bsd 3 bsd+license : (?:a |the )?bsd(?: style)? license
bsd 3 bsd+licensed : bsd licensed
apache-1 1 spdx+apache : spdx license identifier apache 1 0
apache-1 2 apache+license : apache (?:software )?license (?:version |v)?1 0
apache-1.1 1 spdx+apache : spdx license identifier apache 1 1
apache-1.1 2 apache+license : apache (?:software )?license (?:version |v)?1 1
apache-2 1 spdx+apache : spdx license identifier apache 2 0
apache-2 1 apache+licensed : licensed under the apache (?:software )?license version 2 0(?: the license)?
apache-2 1 apache+org : www apache org licenses license 2 0(?: txt| html)?
apache-2 2 apache+license : (?:the )?apache (?:software )?license version 2(?: 0)?
apache-2 2 apache+license : (?:the )?apache (?:software )?license (?:v ?)?2 0
apache-2 2 apache : apache (?:2 0|2|v2|v2 0|asl 2 0)(?: license)?
apache-2 2 asl : asl (?:v )?2 0
apache-2 2 opensource+apache : opensource org licenses? apache 2 0
apache 3 apache+license : (?:the )?apache (?:software )?license
apache 3 apache+licensed : apache licensed
gpl-1 1 spdx+gpl : spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 2 gnu+general : gnu general public license version 1(?: 0)?
gpl-2 1 spdx+gpl : spdx license identifier gpl 2 0(?: only)?
gpl-2+ 1 spdx+gpl : spdx license identifier gpl 2 0 or later
gpl-2 1 gnu+general : under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2)
gpl-2+ 1 either+later : either version 2 of the license or (?:at your option )?any later version
gpl-2 2 gnu+general : gnu general public licen[cs]e (?:version |v)?2(?: 0)?
gpl-2 2 gpl : gpl (?:version |v)?2(?: 0)?(?: only)?
gpl-2 2 gplv2 : gplv2(?: only)?
gpl-2+ 2 gpl+later : gpl (?:version |v)?2(?: 0)? or (?:any )?later(?: version)?
gpl-2+ 2 gplv2+later : gplv2 or (?:any )?later
gpl-3 1 spdx+gpl : spdx license identifier gpl 3 0(?: only)?
gpl-3+ 1 spdx+gpl : spdx license identifier gpl 3 0 or later
gpl-3 1 gnu+general+licensed : (?:this work is )?licensed under the gnu general public license version 3(?: 0)?
gpl-3 1 gnu+general : under the terms of (?:version 3 of the gnu general public license|the gnu general public license version 3)
gpl-3+ 1 either+later : either version 3 of the license or (?:at your option )?any later version
gpl-3 2 gnu+general : (?:the )?gnu general public licen[cs]e (?:version |v)?3(?: 0)?
gpl-3 2 gpl : gpl (?:version |v)?3(?: 0)?(?: only)?
gpl-3 2 gplv3 : gplv3(?: only)?
gpl-3+ 2 gpl+later : gpl (?:version |v)?3(?: 0)? or (?:any )?later(?: version)?
gpl-3+ 2 gplv3+later : gplv3 or (?:any )?later
gpl-3 2 gnu+licenses : www gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-2 2 gnu+licenses : www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl 3 gnu+general : (?:the )?gnu general public licen[cs]e
gpl 3 gnu+gpl : (?:the )?gnu gpl
gpl 3 gnu+licenses : www gnu org licenses(?: gpl)?(?: html)?
lgpl-2 1 spdx+lgpl : spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 2 gnu+library : gnu library general public licen[cs]e(?: version 2(?: 0)?)?
lgpl-2.1 1 spdx+lgpl : spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 2 gnu+lesser : gnu lesser general public licen[cs]e (?:version |v)?2 1
lgpl-2.1 2 lgpl : lgpl (?:version |v)?2 1(?: or later)?
lgpl-2.1 2 lgplv2 : lgplv2 1
lgpl-2.1 1 version+lesser : version 2 1 of the gnu lesser general public license
lgpl-2.1 1 version+license : version 2 1 of the license
lgpl-3 1 spdx+lgpl : spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 2 gnu+lesser : gnu lesser general public licen[cs]e (?:version |v)?3(?: 0)?
lgpl-3 2 lgpl : lgpl (?:version |v)?3(?: 0)?(?: or later)?
lgpl-3 2 lgplv3 : lgplv3
lgpl 3 gnu+lesser : (?:the )?gnu lesser general public licen[cs]e
lgpl 3 gnu+lgpl : (?:the )?gnu lgpl
agpl-1 1 spdx+agpl : spdx license identifier agpl 1 0(?: only| or later)?
agpl-3 1 spdx+agpl : spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 2 gnu+affero : (?:the )?gnu affero general public licen[cs]e (?:version |v)?3(?: 0)?
agpl-3 2 agpl : agpl (?:version |v)?3(?: 0)?(?: or later)?
agpl-3 2 agplv3 : agplv3
agpl 3 affero+general : (?:the )?(?:gnu )?affero general public licen[cs]e
agpl 3 gnu+agpl : (?:the )?gnu agpl
gfdl 1 spdx+gfdl : spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl 2 gnu+documentation : gnu free documentation licen[cs]e(?: version 1 [123])?
gfdl 2 gfdl : gfdl(?: 1 [123])?
mpl-1.0 1 spdx+mpl : spdx license identifier mpl 1 0
mpl-1.0 2 mozilla+license : mozilla public license (?:version |v)?1 0
mpl-1.1 1 spdx+mpl : spdx license identifier mpl 1 1
mpl-1.1 2 mozilla+license : mozilla public license (?:version |v)?1 1
mpl-2.0 1 spdx+mpl : spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2.0 1 mozilla+subject : this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 1 mpl+obtain : if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 2 mozilla+license : (?:the )?mozilla public license (?:version |v ?)?2 0
mpl-2.0 2 mpl : mpl (?:version |v)?2 0
mpl 3 mozilla+license : (?:the )?mozilla public license
npl-1.1 2 netscape+license : netscape public license(?: version 1 [01])?
epl-1 1 spdx+epl : spdx license identifier epl 1 0
epl-1 2 eclipse+license : eclipse public license (?:version |v ?)?1 0
epl-2 1 spdx+epl : spdx license identifier epl 2 0
epl-2 2 eclipse+license : eclipse public license (?:version |v ?)?2 0
epl 3 eclipse+license : (?:the )?eclipse public license
edl-1 2 eclipse+distribution : eclipse distribution license(?: v)?(?: 1 0)?
cpl-1.0 1 spdx+cpl : spdx license identifier cpl 1 0
cpl-1.0 2 common+license : common public license (?:version |v)?1 0
ipl-1.0 2 ibm+license : ibm public license(?: version)?(?: 1 0)?
cddl-1.0 1 spdx+cddl : spdx license identifier cddl 1 0
cddl-1.0 2 cddl : cddl (?:version |v)?1 0
cddl-1.1 1 spdx+cddl : spdx license identifier cddl 1 1
cddl-1.1 2 cddl : cddl (?:version |v)?1 1
cddl 2 common+distribution : common development and distribution license(?: cddl)?
eupl-1.1 1 spdx+eupl : spdx license identifier eupl 1 1
eupl-1.1 2 eupl : eupl (?:version |v ?)?1 1
eupl-1.2 1 spdx+eupl : spdx license identifier eupl 1 2
eupl-1.2 2 eupl : eupl (?:version |v ?)?1 2
eupl 2 european+union : (?:the )?european union public licen[cs]e
cecill-2.1 1 spdx+cecill : spdx license identifier cecill 2 1
cecill-2.1 2 cecill : cecill (?:version |v)?2 1
cecill-b 2 cecill : cecill b(?: licen[cs]e)?
cecill-c 2 cecill : cecill c(?: licen[cs]e)?
cecill 3 cecill : (?:licence )?cecill(?: license)?
artistic-1 1 spdx+artistic : spdx license identifier artistic 1 0(?: \S+)?
artistic-1 2 artistic+license : artistic license (?:version )?1 0
artistic-2 1 spdx+artistic : spdx license identifier artistic 2 0
artistic-2 2 artistic+license : artistic license (?:version )?2 0
artistic 3 artistic+license : (?:the )?artistic license
perl 2 perl+terms : (?:under )?the same terms as perl(?: itself)?
ruby 1 spdx+ruby : spdx license identifier ruby
ruby 2 ruby+license : ruby license
ruby 2 ruby+terms : the same terms as ruby(?: itself)?
zlib 1 spdx+zlib : spdx license identifier zlib
zlib 1 altered+misrepresented : altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 2 zlib+license : (?:the )?zlib(?: libpng)? license
libpng 1 spdx+libpng : spdx license identifier libpng(?: 2 0)?
libpng 2 libpng+license : libpng license
boost 1 spdx+bsl : spdx license identifier bsl 1 0
boost 1 boost+distributed : distributed under the boost software license version 1 0
boost 2 boost+license : boost software license(?: version)?(?: 1 0)?
unlicense 1 spdx+unlicense : spdx license identifier unlicense
unlicense 1 unencumbered+domain : this is free and unencumbered software released into the public domain
unlicense 2 unlicense : (?:the )?unlicense(?: org)?
wtfpl 1 spdx+wtfpl : spdx license identifier wtfpl
wtfpl 1 fuck+license : do what the fuck you want to public license
wtfpl 2 wtfpl : wtfpl(?: version 2)?
beerware 1 spdx+beerware : spdx license identifier beerware
beerware 2 beer+ware : (?:the )?beer ware license
beerware 2 beerware : beerware(?: license)?
cc0 1 spdx+cc0 : spdx license identifier cc0 1 0
cc0 1 creativecommons+publicdomain : creativecommons org publicdomain zero(?: 1 0)?
cc0 2 cc0 : cc0(?: 1 0)?(?: universal)?
cc0 2 creative+zero : creative commons zero(?: v?1 0)?(?: universal)?
cc-by 1 spdx+cc : spdx license identifier cc by [1-4] [05]
cc-by 1 creativecommons+by : creativecommons org licenses by [1-4] [05]
cc-by 2 cc+by : cc by(?: [1-4] [05])?
cc-by 2 creative+attribution : creative commons attribution(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?
cc-by-sa 1 spdx+cc : spdx license identifier cc by sa [1-4] [05]
cc-by-sa 1 creativecommons+sa : creativecommons org licenses by sa [1-4] [05]
cc-by-sa 2 cc+sa : cc by sa(?: [1-4] [05])?
cc-by-sa 2 creative+sharealike : creative commons attribution sharealike(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?
cc-by-sa 2 creative+alike : creative commons attribution share alike(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?
cc-by-nd 1 spdx+cc : spdx license identifier cc by nd [1-4] [05]
cc-by-nd 1 creativecommons+nd : creativecommons org licenses by nd [1-4] [05]
cc-by-nd 2 cc+nd : cc by nd(?: [1-4] [05])?
cc-by-nd 2 creative+attribution : creative commons attribution noderiv(?:ative)?s(?: [1-4] [05])?(?: international| generic| unported)?
cc-by-nc 1 spdx+cc : spdx license identifier cc by nc [1-4] [05]
cc-by-nc 1 creativecommons+nc : creativecommons org licenses by nc [1-4] [05]
cc-by-nc 1 licensed+cc : licensed under (?:a |the )?cc by nc(?: [1-4] [05])?
cc-by-nc 2 cc+nc : cc by nc(?: [1-4] [05])?
cc-by-nc 2 creative+noncommercial : creative commons attribution noncommercial(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?
cc-by-nc 2 creative+commercial : creative commons attribution non commercial(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?
cc-by-nc-sa 1 spdx+cc : spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa 1 creativecommons+nc : creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa 2 cc+nc+sa : cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa 2 creative+attribution : creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| generic| unported)?
cc-by-nc-nd 1 spdx+cc : spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd 1 creativecommons+nc : creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd 2 cc+nc+nd : cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd 2 creative+attribution : creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| generic| unported)?
cc 3 creative+commons : (?:a |the )?creative commons(?: license| licence| lizenz)?
cc 3 creativecommons : creativecommons org
public-domain 1 creativecommons+mark : creativecommons org publicdomain mark(?: 1 0)?
public-domain 2 dedicated+domain : (?:is |are )?dedicated to the public domain
public-domain 2 placed+domain : (?:is |are |been )?placed in(?:to)? the public domain
public-domain 2 released+domain : (?:is |are |been )?released in(?:to)? the public domain
public-domain 3 public+domain : (?:in )?the public domain
odbl 1 spdx+odbl : spdx license identifier odbl 1 0
odbl 2 odbl : odbl(?: v?1 0)?
odbl 2 open+database : open (?:data commons open )?database licen[cs]e(?: odbl)?
odc-by 1 spdx+odc : spdx license identifier odc by 1 0
odc-by 2 commons+attribution : open data commons attribution licen[cs]e
pddl 1 spdx+pddl : spdx license identifier pddl 1 0
pddl 2 public+dedication : public domain dedication and licen[cs]e
ofl 1 spdx+ofl : spdx license identifier ofl 1 [01](?: \S+)?
ofl 2 sil+font : (?:the )?sil open font licen[cs]e(?: version)?(?: 1 [01])?
psf 1 spdx+psf : spdx license identifier psf 2 0
psf 1 spdx+python : spdx license identifier python 2 0(?: 1)?
psf 2 python+foundation : python software foundation license(?: version 2)?
psf 2 psf+license : psf license(?: agreement)?
php 1 spdx+php : spdx license identifier php 3 0(?:1)?
php 2 php+license : (?:the )?php license(?: version)?(?: 3 01?)?
openssl 1 spdx+openssl : spdx license identifier openssl
openssl 1 openssl+toolkit : this product includes software developed by the openssl project for use in the openssl toolkit
openssl 2 openssl+license : openssl license
postgresql 1 spdx+postgresql : spdx license identifier postgresql
postgresql 2 postgresql : (?:the )?postgresql licen[cs]e
ncsa 1 spdx+ncsa : spdx license identifier ncsa
ncsa 2 illinois+ncsa : (?:university of )?illinois (?:open source license )?ncsa(?: open source license)?
curl 1 spdx+curl : spdx license identifier curl
curl 2 curl+license : curl license
vim 1 spdx+vim : spdx license identifier vim
vim 2 vim+license : vim license
tcl 1 spdx+tcl : spdx license identifier tcl
tcl 2 tcl+license : tcl(?: tk)? license
w3c 1 spdx+w3c : spdx license identifier w3c(?: \S+)?
w3c 2 w3c+notice : w3c software (?:and document )?notice and license
unicode 1 spdx+unicode : spdx license identifier unicode (?:dfs 201[56]|3 0|tou)
unicode 2 unicode+license : unicode license(?: v3| agreement)?
icu 1 spdx+icu : spdx license identifier icu
icu 2 icu+license : icu license
json 1 spdx+json : spdx license identifier json
json 1 good+evil : the software shall be used for good not evil
json 2 json+license : (?:the )?json license
ms-pl 1 spdx+ms : spdx license identifier ms pl
ms-pl 2 microsoft+public : microsoft public license(?: ms pl)?
ms-rl 1 spdx+ms : spdx license identifier ms rl
ms-rl 2 microsoft+reciprocal : microsoft reciprocal license(?: ms rl)?
apsl 1 spdx+apsl : spdx license identifier apsl [12] [012]
apsl 2 apple+source : apple public source license(?: version [12] [012])?
qpl 1 spdx+qpl : spdx license identifier qpl 1 0
qpl 2 q+license : q public license(?: version)?(?: 1 0)?
sleepycat 1 spdx+sleepycat : spdx license identifier sleepycat
sleepycat 2 sleepycat+license : sleepycat license
afl 1 spdx+afl : spdx license identifier afl [123] [012]
afl 2 academic+license : academic free license(?: version)?(?: [123] [012])?
osl 1 spdx+osl : spdx license identifier osl [123] [012]
osl 2 open+license : open software license(?: version)?(?: [123] [012])?
ecl 1 spdx+ecl : spdx license identifier ecl [12] 0
ecl 2 educational+license : educational community license(?: version)?(?: [12] 0)?
upl 1 spdx+upl : spdx license identifier upl 1 0
upl 2 universal+permissive : universal permissive license(?: v)?(?: 1 0)?
busl 1 spdx+busl : spdx license identifier busl 1 1
busl 2 business+source : business source license(?: version)?(?: 1 1)?
sspl 1 spdx+sspl : spdx license identifier sspl 1 0
sspl 2 server+side : server side public license(?: version)?(?: 1)?
elastic-2 1 spdx+elastic : spdx license identifier elastic 2 0
elastic-2 2 elastic+license : elastic license (?:v ?)?2 0
commons-clause 2 commons+clause : commons clause(?: license condition)?(?: v?1 0)?
polyform 1 spdx+polyform : spdx license identifier polyform (?:noncommercial|small business) 1 0 0
polyform 2 polyform : polyform (?:noncommercial|small business|shield|strict|perimeter)(?: license)?(?: 1 0 0)?
openrail 2 openrail : (?:creativeml )?openrail(?: m| \+\+)?(?: license)?
openrail 2 responsible+ai : responsible ai licen[cs]e
intel 1 spdx+intel : spdx license identifier intel(?: acpi)?
nasa 2 nasa+agreement : nasa open source agreement(?: version)?(?: 1 3)?
lppl 1 spdx+lppl : spdx license identifier lppl 1 [0-3][ac]?
lppl 2 latex+project : latex project public license(?: version)?(?: 1 [0-3][ac]?)?
blueoak 1 spdx+blueoak : spdx license identifier blueoak 1 0 0
blueoak 2 blue+oak : blue oak model license(?: 1 0 0)?
mulan-2 1 spdx+mulanpsl : spdx license identifier mulanpsl 2 0
mulan-2 2 mulan : mulan (?:psl|permissive software license)(?: v?2)?
ogl 2 government+open : open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?
proprietary 1 confidential+proprietary : (?:confidential and proprietary|proprietary and confidential)
proprietary 1 unauthorized+copying : unauthorized copying of this (?:file|software|work) (?:via any medium )?is strictly prohibited
proprietary 2 proprietary+license : (?:a |under )?proprietary license
noncommercial 2 noncommercial+only : for noncommercial use only
noncommercial 2 commercial+only : for non commercial use only
noncommercial 2 personal+only : for personal use only
research-only 2 research+only : for (?:academic )?research (?:purposes|use) only
all-rights-reserved 3 rights+reserved : all rights reserved
all-rights-reserved 3 alle+vorbehalten : alle rechte vorbehalten
all-rights-reserved 3 tous+réservés : tous droits réservés
all-rights-reserved 3 todos+reservados : todos los derechos reservados
"""

#: Phrases whose labels always stand; they are rules of level 0.
BASE = (
    Rule("mit", 0, ("under", "mit", "license"), "under the mit license"),
    Rule("apache-2", 0, ("apache", "license", "version"), "apache license version 2"),
    Rule("cc-by-nc", 0, ("cc", "nc"), "cc by nc"),
)


def parsed(lines: str = SIGNATURES) -> tuple[Rule, ...]:
    """The base phrases and the rules of a table, in order."""
    found = list(BASE)
    for line in lines.strip().splitlines():
        head, pattern = line.split(" : ", 1)
        label, level, gate = head.split()
        found.append(Rule(label, int(level), tuple(gate.split("+")), pattern))
    return tuple(found)


RULES = parsed()
