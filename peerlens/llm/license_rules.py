"""Signature rules of the license scan, written by hand.

A rule is a line `label / class / gate / pattern`. Patterns are regular expressions over words: texts are lower-cased (A-Z), words are separated by one space, and
a match begins and ends at words. The gate is a word that every match has: without it in a text the pattern isn't tried. Classes, in the order of their priority:

    base     phrases of the contract; they always stay
    notice   sentences that grant or refuse rights
    exact    a license by its name and version
    name     a license by its name, a family or an address
    hint     abbreviations and remarks
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: By falling priority, with the confidence of a detection.
CLASSES = {"base": 0.9, "tag": 1.0, "notice": 0.95, "exact": 0.9, "name": 0.7, "hint": 0.4}

# Phrases and labels of the contract.
BASE = r"""
mit / base / mit / under the mit license
apache-2 / base / apache / apache license version 2
cc-by-nc / base / nc / cc by nc
"""

SIGNATURES = r"""
mit / notice / charge / permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit / notice / sell / rights to use copy modify merge publish distribute sublicense and or sell copies
mit / exact / mit / (?:released|licen[sc]ed|available|distributed|published|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
mit / exact / expat / expat (?:mit )?licen[sc]e
mit / name / mit / mit licen[sc]e
mit / name / mit / opensource org licenses? mit(?: license)?(?: php| html)?
mit / hint / mit / licen[sc]e mit
mit-0 / exact / attribution / mit no attribution(?: licen[sc]e)?
mit-0 / hint / mit / mit 0
x11 / exact / x11 / (?:mit )?x11 licen[sc]e
x11 / notice / consortium / the name of the x consortium shall not be used in advertising
apache-2 / notice / apache / licen[sc]ed under the apache licen[sc]e version 2 0(?: the licen[sc]e)?(?: you may not use this file except in compliance with the licen[sc]e)?
apache-2 / notice / warranties / unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis without warranties
apache-2 / exact / apache / apache (?:software )?(?:public )?licen[sc]e (?:version |v )?v?2(?: 0)?
apache-2 / exact / apache / apache (?:asl )?2 0
apache-2 / name / apache / (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 / hint / asl2 / asl2
apache-1-1 / exact / apache / apache software licen[sc]e (?:version |v )?v?1 1
apache-1-1 / notice / developed / this product includes software developed by the apache software foundation
apache-1 / exact / apache / apache licen[sc]e (?:version |v )?v?1 0
apache / name / apache / apache (?:software |public )?licen[sc]e
gpl-1 / exact / general / gnu general public licen[sc]e (?:version |v )?v?1(?: 0)?
gpl-1 / hint / gplv1 / (?:gnu )?gplv1
gpl-2 / notice / redistribute / you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2
gpl-2 / exact / general / (?:gnu )?general public licen[sc]e (?:gnu )?(?:gpl )?(?:version |v )?v?2(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl-2 / exact / gpl / (?:gnu )?gpl (?:version |v )?v?2(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl-2 / hint / gplv2 / (?:gnu )?gplv2(?: 0)?
gpl-2 / name / gpl / gnu org licenses old licenses gpl 2 0(?: html| txt)?
gpl-3 / notice / redistribute / you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3
gpl-3 / exact / general / (?:gnu )?general public licen[sc]e (?:gnu )?(?:gpl )?(?:version |v )?v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl-3 / exact / gpl / (?:gnu )?gpl (?:version |v )?v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl-3 / hint / gplv3 / (?:gnu )?gplv3(?: 0)?
gpl-3 / name / gpl / gnu org licenses gpl 3 0(?: html| txt)?
gpl / notice / copyleft / this program is free software licen[sc]ed under copyleft
gpl / name / general / gnu general public licen[sc]e
gpl / name / gpl / gnu org (?:copyleft|licenses) gpl(?: html)?
gpl / hint / gpl / gnu gpl
gpl / hint / gpl / under (?:the )?gpl
lgpl-2 / exact / library / gnu library general public licen[sc]e (?:version |v )?v?2(?: 0)?
lgpl-2 / exact / lgpl / (?:gnu )?lgpl (?:version |v )?v?2 0
lgpl-2-1 / exact / lesser / (?:gnu )?lesser general public licen[sc]e (?:version |v )?v?2 1(?: or (?:any )?later(?: version)?| only)?
lgpl-2-1 / exact / lgpl / (?:gnu )?lgpl (?:version |v )?v?2 1(?: or (?:any )?later(?: version)?| only)?
lgpl-2-1 / hint / lgplv2 / lgplv2(?: 1)?
lgpl-3 / exact / lesser / (?:gnu )?lesser general public licen[sc]e (?:version |v )?v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
lgpl-3 / exact / lgpl / (?:gnu )?lgpl (?:version |v )?v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
lgpl-3 / hint / lgplv3 / lgplv3(?: 0)?
lgpl / name / lesser / (?:gnu )?lesser general public licen[sc]e
lgpl / name / library / gnu library general public licen[sc]e
lgpl / hint / lgpl / (?:gnu|under(?: the)?) lgpl
agpl-3 / notice / affero / under the terms of the gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3
agpl-3 / exact / affero / (?:gnu )?affero general public licen[sc]e (?:version |v )?v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
agpl-3 / exact / agpl / (?:gnu )?agpl (?:version |v )?v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
agpl-3 / hint / agplv3 / agplv3(?: 0)?
agpl-1 / exact / affero / affero general public licen[sc]e (?:version |v )?v?1(?: 0)?
agpl / name / affero / (?:gnu )?affero general public licen[sc]e
agpl / hint / agpl / (?:gnu|under(?: the)?) agpl
gfdl-1-1 / exact / documentation / gnu free documentation licen[sc]e (?:version |v )?v?1 1
gfdl-1-2 / exact / documentation / gnu free documentation licen[sc]e (?:version |v )?v?1 2
gfdl-1-3 / exact / documentation / gnu free documentation licen[sc]e (?:version |v )?v?1 3
gfdl / notice / invariant / with no invariant sections no front cover texts and no back cover texts
gfdl / name / documentation / gnu free documentation licen[sc]e
gfdl / hint / gfdl / gfdl
bsd-4-clause / notice / advertising / all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause / exact / clause / (?:bsd 4|4|four) clause (?:bsd )?licen[sc]e
bsd-4-clause / hint / bsd / (?:original|old) bsd licen[sc]e
bsd-3-clause / notice / endorse / neither the names? of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause / exact / bsd / bsd (?:3|three) clause(?: licen[sc]e)?
bsd-3-clause / exact / bsd / (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause / hint / bsd / (?:new|modified|revised) bsd licen[sc]e
bsd-2-clause / notice / binary / redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause / exact / bsd / bsd (?:2|two) clause(?: licen[sc]e)?
bsd-2-clause / exact / bsd / (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause / hint / bsd / simplified bsd licen[sc]e
bsd-2-clause / hint / freebsd / freebsd licen[sc]e
bsd-1-clause / exact / bsd / bsd (?:1|one) clause(?: licen[sc]e)?
bsd-0 / exact / bsd / (?:zero clause bsd|bsd zero clause|bsd 0 clause|0 clause bsd)(?: licen[sc]e)?
bsd-0 / notice / fee / permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-0 / hint / 0bsd / 0bsd
bsd / name / bsd / bsd (?:style )?licen[sc]e
bsd / hint / bsd / under (?:the |a )?bsd
isc / exact / isc / isc licen[sc]e
isc / notice / isc / the software is provided as is and isc disclaims all warranties
isc / name / consortium / internet (?:systems|software) consortium licen[sc]e
mpl-1 / exact / mozilla / mozilla public licen[sc]e (?:version |v )?v?1 0
mpl-1-1 / exact / mozilla / mozilla public licen[sc]e (?:version |v )?v?1 1
mpl-1-1 / exact / mpl / mpl (?:version |v )?v?1 1
mpl-2 / notice / mozilla / this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2 / exact / mozilla / mozilla public licen[sc]e (?:version |v )?v?2(?: 0)?
mpl-2 / exact / mpl / mpl (?:version |v )?v?2(?: 0)?
mpl-2 / name / mozilla / mozilla org mpl 2 0
mpl / name / mozilla / mozilla public licen[sc]e
epl-1 / exact / eclipse / eclipse public licen[sc]e (?:version |v )?v?1(?: 0)?
epl-1 / exact / epl / epl (?:version |v )?v?1 0
epl-2 / exact / eclipse / eclipse public licen[sc]e (?:version |v )?v?2(?: 0)?
epl-2 / exact / epl / epl (?:version |v )?v?2 0
epl / name / eclipse / eclipse public licen[sc]e
edl-1 / exact / eclipse / eclipse distribution licen[sc]e(?: (?:version |v )?v?1 0)?
cddl-1 / exact / cddl / cddl (?:version |v )?v?1 0
cddl-1 / exact / distribution / common development and distribution licen[sc]e (?:cddl )?(?:version |v )?v?1 0
cddl-1-1 / exact / cddl / cddl (?:version |v )?v?1 1
cddl / name / distribution / common development and distribution licen[sc]e
cpl-1 / exact / common / common public licen[sc]e (?:version |v )?v?1 0
cpl / name / common / common public licen[sc]e
ipl-1 / name / ibm / ibm public licen[sc]e(?: (?:version |v )?v?1 0)?
eupl-1-1 / exact / eupl / eupl (?:version |v )?v?1 1
eupl-1-2 / exact / eupl / eupl (?:version |v )?v?1 2
eupl / name / union / european union public licen[sc]e
cecill-2 / exact / cecill / cecill (?:version |v )?v?2(?: [01])?
cecill-b / exact / cecill / cecill b
cecill-c / exact / cecill / cecill c
cecill / name / cecill / cecill(?: free software)? licen[sc]e
artistic-1 / exact / artistic / artistic licen[sc]e (?:version |v )?v?1(?: 0)?
artistic-2 / exact / artistic / artistic licen[sc]e (?:version |v )?v?2(?: 0)?
artistic / name / artistic / artistic licen[sc]e
perl / notice / perl / under the same terms as perl itself
psf-2 / exact / python / python software foundation licen[sc]e(?: (?:version |v )?v?2)?
python-2 / exact / python / python licen[sc]e (?:version |v )?v?2 0
psf / hint / psf / psf licen[sc]e
zlib / notice / altered / altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib / exact / zlib / zlib(?: libpng)? licen[sc]e
libpng / name / libpng / libpng licen[sc]e
openssl / exact / openssl / openssl licen[sc]e
openssl / notice / openssl / this product includes software developed by the openssl project
ssleay / notice / eric / this product includes cryptographic software written by eric young
curl / exact / curl / curl licen[sc]e
boost-1 / notice / boost / distributed under the boost software licen[sc]e version 1 0
boost-1 / exact / boost / boost software licen[sc]e(?: (?:version |v )?v?1 0)?
boost-1 / hint / bsl / bsl 1 0
unlicense / notice / unencumbered / this is free and unencumbered software released into the public domain
unlicense / exact / unlicense / the unlicense
unlicense / name / unlicense / unlicense org
wtfpl / exact / wtfpl / wtfpl(?: (?:version |v )?v?2(?: 0)?)?
wtfpl / name / want / do what the (?:fuck|f) you want to public licen[sc]e
beerware / notice / beer / if we meet some day and you think this stuff is worth it you can buy me a beer
beerware / name / ware / beer ware licen[sc]e
cc0-1 / notice / waived / has waived all copyright and related or neighboring rights
cc0-1 / exact / cc0 / cc0(?: 1 0)?(?: universal)?
cc0-1 / name / zero / creative commons zero(?: (?:v )?1 0)?
cc0-1 / name / publicdomain / creativecommons org publicdomain zero(?: 1 0)?
public-domain / notice / domain / (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain / name / publicdomain / creativecommons org publicdomain mark(?: 1 0)?
public-domain / hint / domain / in the public domain
cc-by / notice / attribution / licen[sc]ed under a creative commons attribution(?: [1-4] [05])? (?:international|unported|generic) licen[sc]e
cc-by / exact / by / cc by(?: [1-4] [05])
cc-by / name / by / creativecommons org licenses by [1-4] [05]
cc-by / name / attribution / creative commons attribution(?: [1-4] [05])?
cc-by / hint / by / cc by
cc-by-sa / exact / sa / cc by sa(?: [1-4] [05])?
cc-by-sa / exact / sharealike / (?:creative commons )?attribution sharealike(?: [1-4] [05])?
cc-by-sa / exact / alike / (?:creative commons )?attribution share alike(?: [1-4] [05])?
cc-by-sa / name / sa / creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc / exact / nc / cc by nc(?: [1-4] [05])?
cc-by-nc / exact / noncommercial / (?:creative commons )?attribution noncommercial(?: [1-4] [05])?
cc-by-nc / exact / commercial / (?:creative commons )?attribution non commercial(?: [1-4] [05])?
cc-by-nc / name / nc / creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd / exact / nd / cc by nd(?: [1-4] [05])?
cc-by-nd / exact / noderivatives / (?:creative commons )?attribution noderivatives(?: [1-4] [05])?
cc-by-nd / exact / derivatives / (?:creative commons )?attribution no derivatives(?: [1-4] [05])?
cc-by-nd / name / nd / creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa / exact / nc / cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa / exact / noncommercial / (?:creative commons )?attribution noncommercial share(?: )?alike(?: [1-4] [05])?
cc-by-nc-sa / exact / commercial / (?:creative commons )?attribution non commercial share(?: )?alike(?: [1-4] [05])?
cc-by-nc-sa / name / nc / creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd / exact / nc / cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd / exact / noncommercial / (?:creative commons )?attribution noncommercial no(?: )?derivatives(?: [1-4] [05])?
cc-by-nc-nd / exact / commercial / (?:creative commons )?attribution non commercial no(?: )?derivatives(?: [1-4] [05])?
cc-by-nc-nd / name / nc / creativecommons org licenses by nc nd(?: [1-4] [05])?
cc / hint / creative / (?:under )?(?:a |the )?creative commons licen[sc]e
odbl-1 / exact / database / open (?:data commons )?(?:open )?database licen[sc]e(?: odbl)?(?: (?:version |v )?v?1 0)?
odbl-1 / hint / odbl / odbl(?: 1 0)?
odc-by-1 / exact / odc / odc by(?: (?:version |v )?v?1 0)?
odc-by-1 / name / commons / open data commons attribution licen[sc]e
pddl-1 / exact / pddl / (?:odc )?pddl(?: (?:version |v )?v?1 0)?
pddl-1 / name / dedication / open data commons public domain dedication(?: and)? licen[sc]e
cdla-permissive-1 / exact / cdla / cdla permissive 1 0
cdla-permissive-2 / exact / cdla / cdla permissive 2 0
cdla-sharing-1 / exact / cdla / cdla sharing 1 0
cdla / name / community / community data licen[sc]e agreement
ogl-uk-3 / exact / government / open government licen[sc]e (?:version |v )?v?3(?: 0)?
ogl-uk / name / government / open government licen[sc]e
dl-de-by-2 / name / datenlizenz / datenlizenz deutschland namensnennung(?: version)? 2 0
dl-de-zero-2 / name / datenlizenz / datenlizenz deutschland zero(?: version)? 2 0
licence-ouverte-2 / name / ouverte / licence ouverte(?: open licence)?(?: (?:version |v )?v?2 0)?
etalab-2 / hint / etalab / etalab 2 0
ofl-1-1 / exact / ofl / sil ofl(?: (?:version |v )?v?1 1)?
ofl-1-1 / exact / font / (?:sil )?open font licen[sc]e (?:version |v )?v?1 1
ofl / name / font / (?:sil )?open font licen[sc]e
bitstream-vera / name / vera / bitstream vera fonts? (?:licen[sc]e|copyright)
ubuntu-font-1 / name / ubuntu / ubuntu font licen[sc]e(?: (?:version |v )?v?1 0)?
lppl-1-3c / exact / lppl / lppl (?:version |v )?v?1 3c?
lppl / name / latex / latex project public licen[sc]e
ms-pl / exact / microsoft / microsoft public licen[sc]e
ms-pl / hint / pl / ms pl
ms-rl / exact / reciprocal / microsoft reciprocal licen[sc]e
ms-rl / hint / rl / ms rl
osl-3 / exact / open / open software licen[sc]e (?:version |v )?v?3 0
osl-3 / hint / osl / osl 3 0
osl / name / open / open software licen[sc]e
afl-3 / exact / academic / academic free licen[sc]e(?: (?:version |v )?v?3 0)?
ecl-2 / exact / educational / educational community licen[sc]e(?: (?:version |v )?v?2 0)?
ncsa / exact / ncsa / (?:university of illinois )?ncsa (?:open source )?licen[sc]e
postgresql / exact / postgresql / postgresql licen[sc]e
php-3 / exact / php / php licen[sc]e (?:version |v )?v?3(?: 0)?
php-3-01 / exact / php / php licen[sc]e (?:version |v )?v?3 01
php / name / php / php licen[sc]e
ruby / exact / ruby / ruby licen[sc]e
ruby / notice / ruby / under the same terms as ruby
vim / exact / vim / vim licen[sc]e
w3c / exact / w3c / w3c (?:software )?(?:notice and )?(?:document )?licen[sc]e
unicode / exact / unicode / unicode (?:inc )?licen[sc]e(?: agreement)?
icu / exact / icu / icu licen[sc]e
hpnd / name / historical / historical permission notice and disclaimer
ftl / exact / freetype / freetype (?:project )?licen[sc]e
ijg / name / jpeg / independent jpeg group(?: s)? licen[sc]e
json / notice / evil / the software shall be used for good not evil
sleepycat / exact / sleepycat / sleepycat licen[sc]e
zpl-2-1 / exact / zope / zope public licen[sc]e(?: (?:version |v )?v?2 1)?
cpal-1 / exact / cpal / cpal(?: (?:version |v )?v?1 0)?
cpal-1 / name / common / common public attribution licen[sc]e
apsl-2 / exact / apple / apple public source licen[sc]e(?: (?:version |v )?v?2 0)?
npl / name / netscape / netscape public licen[sc]e(?: (?:version |v )?v?1 [01])?
qpl-1 / exact / q / q public licen[sc]e(?: (?:version |v )?v?1 0)?
rpl-1-5 / name / reciprocal / reciprocal public licen[sc]e(?: (?:version |v )?v?1 5)?
upl-1 / exact / universal / universal permissive licen[sc]e(?: (?:version |v )?v?1 0)?
blueoak-1 / exact / oak / blue oak model licen[sc]e(?: (?:version |v )?v?1 0 0)?
mulan-psl-2 / exact / mulan / mulan (?:permissive software licen[sc]e|psl) (?:version |v )?v?2
parity-7 / name / parity / parity public licen[sc]e(?: 7 0 0)?
sspl-1 / exact / sspl / sspl(?: (?:version |v )?v?1(?: 0)?)?
sspl-1 / name / server / server side public licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?
bsl-1-1 / exact / business / business source licen[sc]e (?:version |v )?v?1 1
bsl / name / business / business source licen[sc]e
elastic-2 / exact / elastic / elastic licen[sc]e (?:version |v )?v?2(?: 0)?
elastic / name / elastic / elastic licen[sc]e
commons-clause / name / clause / commons clause(?: licen[sc]e)?(?: condition)?
polyform-noncommercial-1 / exact / polyform / polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform-small-business-1 / exact / polyform / polyform small business licen[sc]e(?: 1 0 0)?
confluent-1 / name / confluent / confluent community licen[sc]e(?: (?:version |v )?v?1 0)?
hippocratic / name / hippocratic / hippocratic licen[sc]e(?: [23] [01])?
openrail-m / exact / openrail / (?:bigscience |creativeml )?openrail m
openrail-m / exact / rail / (?:bigscience |creativeml )?open rail m
openrail-m / name / rail / (?:bigscience|creativeml) (?:bloom )?rail(?: m)?(?: 1 0)? licen[sc]e
llama-2 / name / llama / llama 2 community licen[sc]e
llama-3 / name / llama / llama 3 (?:[0-9] )?community licen[sc]e
gemma / name / gemma / gemma terms of use
aladdin / name / aladdin / aladdin free public licen[sc]e
ncgl / name / commercial / non commercial government licen[sc]e
free-art-1-3 / exact / libre / licence art libre(?: 1 3)?
free-art-1-3 / name / art / free art licen[sc]e(?: 1 3)?
against-drm / name / drm / against drm(?: 2 0)? licen[sc]e
tapr-ohl / name / tapr / tapr open hardware licen[sc]e
cern-ohl-p-2 / exact / ohl / cern ohl p (?:version |v )?v?2(?: 0)?
cern-ohl-s-2 / exact / ohl / cern ohl s (?:version |v )?v?2(?: 0)?
cern-ohl-w-2 / exact / ohl / cern ohl w (?:version |v )?v?2(?: 0)?
cern-ohl / name / cern / cern open hardware licen[sc]e
solderpad / name / solderpad / solderpad hardware licen[sc]e(?: (?:version |v )?v?(?:0 51|2 1))?
all-rights-reserved / notice / reserved / copyright (?:c )?(?:[^ ]+ ){0,8}all rights reserved
all-rights-reserved / hint / reserved / all rights reserved
proprietary / notice / prohibited / (?:reproduction|redistribution|copying)(?: or (?:reproduction|redistribution|copying|distribution))? (?:[^ ]+ ){0,6}is (?:strictly )?prohibited
proprietary / notice / confidential / (?:proprietary and confidential|confidential and proprietary)
proprietary / name / proprietary / proprietary (?:software )?licen[sc]e
eula / name / end / end user licen[sc]e agreement
research-only / notice / research / for (?:non commercial |noncommercial )?research (?:purposes|use) only
no-commercial-use / notice / commercial / (?:not for commercial use|for non commercial use only)
"""

#: What names a license in a tag, by label; its rule is made from it (see tags()).
IDS = """
mit mit, mit-0 mit 0, x11 x11, apache-2 apache 2 0, apache-1-1 apache 1 1, apache-1 apache 1 0, gpl-1 gpl 1 0, gpl-2 gpl 2 0, gpl-3 gpl 3 0, lgpl-2 lgpl 2 0, lgpl-2-1 lgpl 2 1, lgpl-3 lgpl 3 0,
agpl-3 agpl 3 0, agpl-1 agpl 1 0, gfdl-1-1 gfdl 1 1, gfdl-1-2 gfdl 1 2, gfdl-1-3 gfdl 1 3, bsd-4-clause bsd 4 clause, bsd-3-clause bsd 3 clause, bsd-2-clause bsd 2 clause, bsd-1-clause bsd 1 clause,
bsd-0 0bsd, isc isc, mpl-1 mpl 1 0, mpl-1-1 mpl 1 1, mpl-2 mpl 2 0, epl-1 epl 1 0, epl-2 epl 2 0, cddl-1 cddl 1 0, cddl-1-1 cddl 1 1, cpl-1 cpl 1 0, ipl-1 ipl 1 0, eupl-1-1 eupl 1 1, eupl-1-2 eupl 1 2,
cecill-2 cecill 2 0, cecill-b cecill b, cecill-c cecill c, artistic-1 artistic 1 0, artistic-2 artistic 2 0, psf-2 psf 2 0, python-2 python 2 0, zlib zlib, libpng libpng, openssl openssl, curl curl,
boost-1 bsl 1 0, unlicense unlicense, wtfpl wtfpl, beerware beerware, cc0-1 cc0 1 0, odbl-1 odbl 1 0, odc-by-1 odc by 1 0, pddl-1 pddl 1 0, cdla-permissive-1 cdla permissive 1 0,
cdla-permissive-2 cdla permissive 2 0, cdla-sharing-1 cdla sharing 1 0, ogl-uk-3 ogl uk 3 0, ofl-1-1 ofl 1 1, lppl-1-3c lppl 1 3c, ms-pl ms pl, ms-rl ms rl, osl-3 osl 3 0, afl-3 afl 3 0, ecl-2 ecl 2 0,
ncsa ncsa, postgresql postgresql, php-3 php 3 0, php-3-01 php 3 01, ruby ruby, vim vim, w3c w3c, icu icu, ftl ftl, ijg ijg, json json, sleepycat sleepycat, zpl-2-1 zpl 2 1, cpal-1 cpal 1 0, apsl-2 apsl 2 0,
qpl-1 qpl 1 0, rpl-1-5 rpl 1 5, upl-1 upl 1 0, blueoak-1 blueoak 1 0 0, sspl-1 sspl 1 0, bsl-1-1 busl 1 1, elastic-2 elastic 2 0
"""


@dataclass(frozen=True)
class Rule:
    """`order` is the place in the table and decides between equal spans of a class."""

    order: int
    label: str
    kind: str
    gate: str
    pattern: str

    @property
    def priority(self) -> int:
        return list(CLASSES).index(self.kind)

    @property
    def spaced(self) -> str:
        """The pattern over texts in which every word has a space on either side, so that two matches never share one."""
        return " " + re.sub(r"(?<!\^) ", "  ", self.pattern) + " "


def _lines(table: str) -> list[tuple[str, ...]]:
    return [tuple(x.strip() for x in line.split(" / ", 3)) for line in table.strip().split("\n")]


def tags() -> list[tuple[str, ...]]:
    """A rule for each name in IDS, and for the Creative Commons licenses of all versions."""
    named = [tuple(x.split(" ", 1)) for x in re.split(r",\s+", IDS.strip())] + [(f"cc-{x.replace(' ', '-')}", f"cc {x} [1-4] [05]") for x in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")]
    return [(label, "tag", "spdx", f"spdx licen[sc]e identifier {name}(?: only| or later)?") for label, name in named]


RULES = [Rule(i, *x) for i, x in enumerate([*_lines(BASE), *tags(), *_lines(SIGNATURES)])]
