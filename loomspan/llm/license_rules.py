"""Signature rules of the license scan, written by hand.

A section is a label. A line is a rule: its form, the words that every text with a match holds (the gate; commas part them), and its regex.
In a regex a space stands for any run of white space, punctuation and comment marks (' ?' for one that may be absent), '@' for an SPDX tag up to this id, and '%' for an
optional version word ('version', 'v', 'v.' or nothing). All texts are lower case. Rules match whole words.
"""

RULES = r"""
[mit]
tag | mit | @mit
tag | x11 | @x11
address | licenses,mit | opensource\.org/licenses?/mit(?:-license)?(?:\.php)?
address | mit-license | mit-license\.org
clause | granted,obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software
clause | copyright,substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
grant | mit,under | (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?: x11| expat)? licen[sc]e
grant | mit,licen | licen[sc]e[sd]? under mit
grant | mit,terms | terms of the mit licen[sc]e
name | mit,licen | (?:the )?mit licen[sc]e
name | mit,licen | mit style licen[sc]e
short | mit,licen | licen[sc]e mit
short | mit,expat | mit expat licen[sc]e
short | expat,licen | expat licen[sc]e
short | x11,licen | x11 licen[sc]e
[mit-0]
tag | mit-0 | @mit-0
name | mit,attribution | mit no attribution(?: licen[sc]e)?
[apache-1.1]
tag | apache-1 | @apache-1\.1
address | apache,license-1.1 | apache\.org/licenses/license-1\.1
name | apache,licen | apache (?:software )?licen[sc]e % 1\.1
short | apache-1.1 | apache-1\.1
[apache-2.0]
tag | apache-2 | @apache-2\.0
address | apache,license-2.0 | apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
address | licenses,apache-2.0 | opensource\.org/licenses/apache-2\.0
clause | compliance,file | you may not use this file except in compliance with the licen[sc]e
clause | agreed,writing | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
grant | apache,under | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[sc]e % 2(?:\.0)?
grant | apache,under | licen[sc]ed under apache 2(?:\.0)?
grant | asl,under | licen[sc]ed under (?:the )?asl % 2(?:\.0)?
name | apache,licen | apache (?:software )?licen[sc]e % 2(?:\.0)?
short | apache,licen | apache % 2(?:\.0)? licen[sc]e
short | asl | asl % 2\.0
[apache]
family | apache,licen | apache (?:software )?licen[sc]e
short | apache,licensed | apache licensed
[gpl-1.0]
tag | gpl-1 | @gpl-1\.0(?:-only|-or-later|\+)?
address | gnu,gpl-1.0 | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
name | general,public | gnu general public licen[sc]e % 1(?:\.0)?
short | gplv1 | gplv1
short | gpl | gpl % 1(?:\.0)?
[gpl-2.0]
tag | gpl-2 | @gpl-2\.0(?:-only|-or-later|\+)?
address | gnu,gpl-2.0 | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
clause | free,foundation | general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
clause | foundation,temple | you should have received a copy of the gnu general public licen[sc]e along with this (?:program|library|file|software) if not write to the free software foundation
grant | gpl,under | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gpl % 2(?:\.0)?
grant | general,public,under | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e % 2(?:\.0)?
name | general,public | (?:gnu )?general public licen[sc]e % 2(?:\.0)?
name | gpl,gnu | gnu gpl % 2(?:\.0)?
short | gplv2 | gplv2(?:\.0)?\+?
short | gpl | gpl % 2(?:\.0)?\+?
[gpl-3.0]
tag | gpl-3 | @gpl-3\.0(?:-only|-or-later|\+)?
address | gnu,gpl-3.0 | gnu\.org/licenses/gpl-3\.0
clause | free,foundation | general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
grant | gpl,under | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gpl % 3(?:\.0)?
grant | general,public,under | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e % 3(?:\.0)?
name | general,public | (?:gnu )?general public licen[sc]e % 3(?:\.0)?
name | gpl,gnu | gnu gpl % 3(?:\.0)?
short | gplv3 | gplv3(?:\.0)?\+?
short | gpl | gpl % 3(?:\.0)?\+?
[gpl]
address | gnu,licenses,gpl | gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)?
clause | free,redistribute | is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
clause | merchantability,general | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e
grant | gpl,under | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
grant | general,public,under | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e
family | gnu,general,public | gnu general public licen[sc]e
family | general,public | general public licen[sc]e
short | gpl,licen | gpl licen[sc]e
[lgpl-2.0]
tag | lgpl-2 | @lgpl-2\.0(?:-only|-or-later|\+)?
address | gnu,lgpl-2.0 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
name | library,public | gnu library general public licen[sc]e % 2(?:\.0)?
short | lgplv2 | lgplv2(?:\.0)?
short | lgpl | lgpl % 2\.0
[lgpl-2.1]
tag | lgpl-2 | @lgpl-2\.1(?:-only|-or-later|\+)?
address | gnu,lgpl-2.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
clause | lesser,foundation | lesser general public licen[sc]e as published by the free software foundation either version 2\.1 of the licen[sc]e
grant | lgpl,under | licen[sc]ed under (?:the )?lgpl % 2\.1
name | lesser,public | (?:gnu )?lesser general public licen[sc]e % 2\.1
short | lgplv2.1 | lgplv2\.1\+?
short | lgpl | lgpl % 2\.1\+?
[lgpl-3.0]
tag | lgpl-3 | @lgpl-3\.0(?:-only|-or-later|\+)?
address | gnu,lgpl-3.0 | gnu\.org/licenses/lgpl-3\.0
clause | lesser,foundation | lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e
grant | lgpl,under | licen[sc]ed under (?:the )?lgpl % 3(?:\.0)?
name | lesser,public | (?:gnu )?lesser general public licen[sc]e % 3(?:\.0)?
short | lgplv3 | lgplv3\+?
short | lgpl | lgpl % 3(?:\.0)?\+?
[lgpl]
address | gnu,licenses,lgpl | gnu\.org/(?:licenses|copyleft)/(?:lesser|lgpl)(?:\.html|\.txt)?
clause | lesser,foundation | under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation
family | lesser,public | (?:gnu )?lesser general public licen[sc]e
family | library,public | (?:gnu )?library general public licen[sc]e
short | lgpl,licen | lgpl licen[sc]e
[agpl-3.0]
tag | agpl-3 | @agpl-3\.0(?:-only|-or-later|\+)?
address | gnu,agpl | gnu\.org/licenses/agpl(?:-3\.0)?
clause | affero,foundation | under the terms of the gnu affero general public licen[sc]e as published by the free software foundation
grant | agpl,under | licen[sc]ed under (?:the )?(?:gnu )?agpl % 3(?:\.0)?
name | affero,public | (?:gnu )?affero general public licen[sc]e % 3(?:\.0)?
short | agplv3 | agplv3\+?
short | agpl | agpl % 3(?:\.0)?\+?
[agpl]
family | affero,public | (?:gnu )?affero general public licen[sc]e
short | agpl,licen | agpl licen[sc]e
[gfdl-1.2]
tag | gfdl-1 | @gfdl-1\.2(?:-only|-or-later)?
address | gnu,fdl-1.2 | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
name | documentation,licen | (?:gnu )?free documentation licen[sc]e % 1\.2
short | gfdl | gfdl % 1\.2
[gfdl-1.3]
tag | gfdl-1 | @gfdl-1\.3(?:-only|-or-later)?
address | gnu,fdl-1.3 | gnu\.org/licenses/fdl-1\.3
name | documentation,licen | (?:gnu )?free documentation licen[sc]e % 1\.3
short | gfdl | gfdl % 1\.3
[gfdl]
clause | invariant,sections | with no invariant sections no front cover texts and no back cover texts
family | documentation,licen | gnu free documentation licen[sc]e
short | gfdl | gfdl
[bsd-2-clause]
tag | bsd-2 | @bsd-2-clause(?:-patent|-views)?
address | licenses,bsd-2 | opensource\.org/licenses/bsd-2-clause
name | bsd,clause | bsd 2 clause(?: licen[sc]e)?
name | bsd,clause | (?:2|two) clause bsd(?: licen[sc]e)?
short | simplified,bsd | simplified bsd licen[sc]e
short | freebsd,licen | freebsd licen[sc]e
[bsd-3-clause]
tag | bsd-3 | @bsd-3-clause(?:-clear|-lbnl)?
address | licenses,bsd-3 | opensource\.org/licenses/bsd-3-clause
clause | endorse,contributors | neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products
name | bsd,clause | bsd 3 clause(?: licen[sc]e)?
name | bsd,clause | (?:3|three) clause bsd(?: licen[sc]e)?
short | new,bsd | new bsd licen[sc]e
short | modified,bsd | modified bsd licen[sc]e
short | revised,bsd | revised bsd licen[sc]e
[bsd-4-clause]
tag | bsd-4 | @bsd-4-clause(?:-uc)?
clause | advertising,acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
name | bsd,clause | bsd 4 clause(?: licen[sc]e)?
name | bsd,clause | (?:4|four) clause bsd(?: licen[sc]e)?
short | original,bsd | original bsd licen[sc]e
[0bsd]
tag | 0bsd | @0bsd
address | licenses,0bsd | opensource\.org/licenses/0bsd
name | zero,clause | (?:bsd )?zero clause bsd(?: licen[sc]e)?
name | zero,clause | bsd zero clause(?: licen[sc]e)?
[bsd]
clause | redistribution,binary | redistribution and use in source and binary forms with or without modification are permitted
grant | bsd,under | (?:licen[sc]ed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style| type)? licen[sc]e
family | bsd,licen | (?:the )?bsd(?: style| type)? licen[sc]e
address | licenses,bsd | opensource\.org/licenses/bsd-license(?:\.php)?
short | licen,bsd | licen[sc]e bsd
[isc]
tag | isc | @isc
address | licenses,isc | opensource\.org/licenses/isc(?:-license)?
clause | permission,distribute,fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
grant | isc,under | licen[sc]ed under (?:the )?isc licen[sc]e
name | isc,licen | isc licen[sc]e
short | internet,consortium | internet (?:systems|software) consortium licen[sc]e
[mpl-1.0]
tag | mpl-1 | @mpl-1\.0
name | mozilla,public | mozilla public licen[sc]e % 1\.0
[mpl-1.1]
tag | mpl-1 | @mpl-1\.1
address | mozilla,mpl | mozilla\.org/mpl/1\.1
name | mozilla,public | mozilla public licen[sc]e % 1\.1
short | mpl | mpl % 1\.1
[mpl-2.0]
tag | mpl-2 | @mpl-2\.0(?:-no-copyleft-exception)?
address | mozilla,mpl | mozilla\.org/(?:en-us/)?mpl/2\.0
clause | source,mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e % 2\.0
grant | mpl,under | licen[sc]ed under (?:the )?mpl % 2\.0
name | mozilla,public | mozilla public licen[sc]e % 2(?:\.0)?
short | mpl | mpl % 2\.0
short | mplv2 | mplv2(?:\.0)?
[mpl]
family | mozilla,public | mozilla public licen[sc]e
[epl-1.0]
tag | epl-1 | @epl-1\.0
address | eclipse,epl-v10 | eclipse\.org/legal/epl-v10
name | eclipse,public | eclipse public licen[sc]e % 1(?:\.0)?
short | epl | epl % 1\.0
[epl-2.0]
tag | epl-2 | @epl-2\.0
address | eclipse,epl | eclipse\.org/legal/epl-(?:2\.0|v20)
clause | accompanying,eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e % 2\.0
name | eclipse,public | eclipse public licen[sc]e % 2(?:\.0)?
short | epl | epl % 2\.0
[epl]
clause | accompanying,eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
family | eclipse,public | eclipse public licen[sc]e
[edl-1.0]
name | eclipse,distribution | eclipse distribution licen[sc]e % 1\.0
[cddl-1.0]
tag | cddl-1 | @cddl-1\.0
address | licenses,cddl | opensource\.org/licenses/cddl-?1\.0
name | common,development,distribution | common development and distribution licen[sc]e % 1\.0
short | cddl | cddl % 1\.0
[cddl-1.1]
tag | cddl-1 | @cddl-1\.1
name | common,development,distribution | common development and distribution licen[sc]e % 1\.1
short | cddl | cddl % 1\.1
[cddl]
clause | cddl,subject | the contents of this file are subject to the terms of (?:either the gnu general public licen[sc]e .{1,40}? )?the common development and distribution licen[sc]e
family | common,development,distribution | common development and distribution licen[sc]e
[cpl-1.0]
tag | cpl-1 | @cpl-1\.0
address | licenses,cpl | opensource\.org/licenses/cpl-?1\.0
name | common,public | common public licen[sc]e % 1(?:\.0)?
short | cpl | cpl % 1\.0
[ipl-1.0]
tag | ipl-1 | @ipl-1\.0
name | ibm,public | ibm public licen[sc]e % 1(?:\.0)?
[eupl-1.1]
tag | eupl-1 | @eupl-1\.1
address | licenses,eupl | opensource\.org/licenses/eupl-1\.1
name | european,union,public | european union public licen[sc]e % 1\.1
short | eupl | eupl % 1\.1
[eupl-1.2]
tag | eupl-1 | @eupl-1\.2
address | licenses,eupl | opensource\.org/licenses/eupl-1\.2
clause | eupl,licensed | licen[sc]ed under the eupl % 1\.2
name | european,union,public | european union public licen[sc]e % 1\.2
short | eupl | eupl % 1\.2
[eupl]
family | european,union,public | european union public licen[sc]e
[artistic-1.0]
tag | artistic-1 | @artistic-1\.0(?:-perl|-cl8)?
address | licenses,artistic | opensource\.org/licenses/artistic-license-1\.0
name | artistic,licen | artistic licen[sc]e % 1\.0
short | artistic-1.0 | artistic-1\.0
[artistic-2.0]
tag | artistic-2 | @artistic-2\.0
address | licenses,artistic | opensource\.org/licenses/artistic-license-2\.0
name | artistic,licen | artistic licen[sc]e % 2\.0
short | artistic-2.0 | artistic-2\.0
[artistic]
grant | same,perl | (?:redistribute|distributed).{1,40}? under the same terms as perl itself
family | artistic,licen | (?:perl )?artistic licen[sc]e
[bsl-1.0]
tag | bsl-1 | @bsl-1\.0
address | boost,license_1_0 | boost\.org/license_1_0(?:\.txt)?
clause | granted,organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
grant | boost,distributed | distributed under the boost software licen[sc]e
name | boost,licen | boost software licen[sc]e % 1\.0
short | boost,licen | boost licen[sc]e % 1\.0
[bsl]
family | boost,licen | boost software licen[sc]e
[busl-1.1]
tag | busl-1 | @busl-1\.1
address | mariadb,bsl11 | mariadb\.com/bsl11
name | business,source | business source licen[sc]e % 1\.1
short | busl | busl % 1\.1
[busl]
family | business,source | business source licen[sc]e
[sspl-1.0]
tag | sspl-1 | @sspl-1\.0
address | mongodb,licensing | mongodb\.com/licensing/server-side-public-license
name | server,side,public | server side public licen[sc]e(?: % 1(?:\.0)?)?
short | sspl | sspl % 1(?:\.0)?
[elastic-2.0]
tag | elastic-2 | @elastic-2\.0
address | elastic,licensing | elastic\.co/licensing/elastic-license
name | elastic,licen | elastic licen[sc]e % 2(?:\.0)?
short | elv2 | elv2
[commons-clause]
clause | commons,clause | commons clause licen[sc]e condition
name | commons,clause | commons clause
[cc0-1.0]
tag | cc0-1 | @cc0-1\.0
address | creativecommons,zero | creativecommons\.org/publicdomain/zero/1\.0
name | commons,zero | creative commons zero(?: % 1\.0)?(?: universal)?
short | cc0 | cc0(?: 1\.0)?
[cc-by-2.0]
tag | cc-by-2 | @cc-by-2\.0
address | creativecommons,by | creativecommons\.org/licenses/by/2\.0
name | commons,attribution | creative commons attribution % 2\.0
[cc-by-3.0]
tag | cc-by-3 | @cc-by-3\.0
address | creativecommons,by | creativecommons\.org/licenses/by/3\.0
name | commons,attribution | creative commons attribution % 3\.0
short | by,cc | cc by 3\.0
[cc-by-4.0]
tag | cc-by-4 | @cc-by-4\.0
address | creativecommons,by | creativecommons\.org/licenses/by/4\.0
name | commons,attribution | creative commons attribution % 4\.0
short | by,cc | cc by 4\.0
[cc-by-sa-2.0]
tag | cc-by-sa-2 | @cc-by-sa-2\.0
address | creativecommons,by-sa | creativecommons\.org/licenses/by-sa/2\.0
[cc-by-sa-3.0]
tag | cc-by-sa-3 | @cc-by-sa-3\.0
address | creativecommons,by-sa | creativecommons\.org/licenses/by-sa/3\.0
name | commons,attribution | creative commons attribution share ?alike % 3\.0
short | by,sa | cc by sa 3\.0
[cc-by-sa-4.0]
tag | cc-by-sa-4 | @cc-by-sa-4\.0
address | creativecommons,by-sa | creativecommons\.org/licenses/by-sa/4\.0
name | commons,attribution | creative commons attribution share ?alike % 4\.0
short | by,sa | cc by sa 4\.0
[cc-by-nc-3.0]
tag | cc-by-nc-3 | @cc-by-nc-3\.0
address | creativecommons,by-nc | creativecommons\.org/licenses/by-nc/3\.0
name | commons,attribution | creative commons attribution non ?commercial % 3\.0
short | by,nc | cc by nc 3\.0
[cc-by-nc-4.0]
tag | cc-by-nc-4 | @cc-by-nc-4\.0
address | creativecommons,by-nc | creativecommons\.org/licenses/by-nc/4\.0
name | commons,attribution | creative commons attribution non ?commercial % 4\.0
short | by,nc | cc by nc 4\.0
[cc-by-nd-3.0]
tag | cc-by-nd-3 | @cc-by-nd-3\.0
address | creativecommons,by-nd | creativecommons\.org/licenses/by-nd/3\.0
name | commons,attribution | creative commons attribution no ?deriv(?:ative)?s % 3\.0
[cc-by-nd-4.0]
tag | cc-by-nd-4 | @cc-by-nd-4\.0
address | creativecommons,by-nd | creativecommons\.org/licenses/by-nd/4\.0
name | commons,attribution | creative commons attribution no ?deriv(?:ative)?s % 4\.0
[cc-by-nc-sa-3.0]
tag | cc-by-nc-sa-3 | @cc-by-nc-sa-3\.0
address | creativecommons,by-nc-sa | creativecommons\.org/licenses/by-nc-sa/3\.0
name | commons,attribution | creative commons attribution non ?commercial share ?alike % 3\.0
[cc-by-nc-sa-4.0]
tag | cc-by-nc-sa-4 | @cc-by-nc-sa-4\.0
address | creativecommons,by-nc-sa | creativecommons\.org/licenses/by-nc-sa/4\.0
name | commons,attribution | creative commons attribution non ?commercial share ?alike % 4\.0
[cc-by-nc-nd-3.0]
tag | cc-by-nc-nd-3 | @cc-by-nc-nd-3\.0
address | creativecommons,by-nc-nd | creativecommons\.org/licenses/by-nc-nd/3\.0
name | commons,attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s % 3\.0
[cc-by-nc-nd-4.0]
tag | cc-by-nc-nd-4 | @cc-by-nc-nd-4\.0
address | creativecommons,by-nc-nd | creativecommons\.org/licenses/by-nc-nd/4\.0
name | commons,attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s % 4\.0
[cc]
family | commons,attribution | creative commons attribution(?: (?:share ?alike|non ?commercial|no ?deriv(?:ative)?s))* licen[sc]e
family | creative,commons | creative commons licen[sc]e
[odbl-1.0]
tag | odbl-1 | @odbl-1\.0
address | opendatacommons,odbl | opendatacommons\.org/licenses/odbl
name | open,database | (?:open data commons )?open database licen[sc]e(?: % 1\.0)?
short | odbl | odbl(?: 1\.0)?
[odc-by-1.0]
tag | odc-by-1 | @odc-by-1\.0
address | opendatacommons,by | opendatacommons\.org/licenses/by
name | data,attribution | open data commons attribution licen[sc]e(?: % 1\.0)?
short | odc | odc by 1\.0
[pddl-1.0]
tag | pddl-1 | @pddl-1\.0
address | opendatacommons,pddl | opendatacommons\.org/licenses/pddl
name | dedication,licen | (?:open data commons )?public domain dedication and licen[sc]e
short | pddl | pddl(?: 1\.0)?
[zlib]
tag | zlib | @zlib
address | licenses,zlib | opensource\.org/licenses/zlib(?:-license\.php)?
clause | provided,express | this software is provided '?as is'? without any express or implied warranty
grant | zlib,under | licen[sc]ed under (?:the )?zlib licen[sc]e
name | zlib,licen | zlib licen[sc]e
short | zlib,libpng | zlib libpng licen[sc]e
[libpng-2.0]
tag | libpng-2 | @libpng-2\.0
name | png,reference | png reference library licen[sc]e % 2
[unlicense]
tag | unlicense | @unlicense
address | unlicense | unlicense\.org
clause | unencumbered,domain | this is free and unencumbered software released into the public domain
name | unlicense | the unlicense
short | unlicense | released under the unlicense
[wtfpl]
tag | wtfpl | @wtfpl
address | wtfpl | wtfpl\.net
name | public,want | do what the f\S{3} you want to public licen[sc]e
short | wtfpl | wtfpl
[psf-2.0]
tag | psf-2 | @psf-2\.0
tag | python-2 | @python-2\.0
address | python,license | docs\.python\.org/3/license
name | python,foundation | python software foundation licen[sc]e(?: % 2)?
short | psf,licen | psf licen[sc]e
[postgresql]
tag | postgresql | @postgresql
address | licenses,postgresql | opensource\.org/licenses/postgresql
name | postgresql,licen | postgresql licen[sc]e
[ofl-1.1]
tag | ofl-1 | @ofl-1\.1(?:-rfn|-no-rfn)?
address | sil,ofl | scripts\.sil\.org/ofl
clause | font,sil | this font software is licensed under the sil open font licen[sc]e
name | open,font | (?:sil )?open font licen[sc]e(?: % 1\.1)?
short | ofl | ofl % 1\.1
[ms-pl]
tag | ms-pl | @ms-pl
address | licenses,ms-pl | opensource\.org/licenses/ms-pl
name | microsoft,public | microsoft public licen[sc]e
short | ms-pl | ms-pl
[ms-rl]
tag | ms-rl | @ms-rl
address | licenses,ms-rl | opensource\.org/licenses/ms-rl
name | microsoft,reciprocal | microsoft reciprocal licen[sc]e
short | ms-rl | ms-rl
[ncsa]
tag | ncsa | @ncsa
address | licenses,ncsa | opensource\.org/licenses/ncsa
name | illinois,open | university of illinois(?: ncsa)? open source licen[sc]e
short | ncsa,licen | ncsa licen[sc]e
[upl-1.0]
tag | upl-1 | @upl-1\.0
address | licenses,upl | opensource\.org/licenses/upl
name | universal,permissive | universal permissive licen[sc]e(?: % 1\.0)?
short | upl | upl % 1\.0
[afl-3.0]
tag | afl-3 | @afl-3\.0
address | licenses,afl | opensource\.org/licenses/afl-3\.0
name | academic,free | academic free licen[sc]e % 3(?:\.0)?
short | afl | afl % 3\.0
[afl-2.1]
tag | afl-2 | @afl-2\.1
name | academic,free | academic free licen[sc]e % 2\.1
[osl-3.0]
tag | osl-3 | @osl-3\.0
address | licenses,osl | opensource\.org/licenses/osl-3\.0
name | open,software | open software licen[sc]e % 3(?:\.0)?
short | osl | osl % 3\.0
[ecl-2.0]
tag | ecl-2 | @ecl-2\.0
name | educational,community | educational community licen[sc]e % 2(?:\.0)?
[qpl-1.0]
tag | qpl-1 | @qpl-1\.0
name | public,q | q public licen[sc]e(?: % 1\.0)?
[vim]
tag | vim | @vim
name | vim,licen | vim licen[sc]e
[ruby]
tag | ruby | @ruby
name | ruby,licen | ruby licen[sc]e
[php-3.01]
tag | php-3 | @php-3\.01
name | php,licen | php licen[sc]e % 3\.01
[openssl]
tag | openssl | @openssl
clause | openssl,toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
name | openssl,licen | openssl licen[sc]e
[curl]
tag | curl | @curl
name | curl,licen | curl licen[sc]e
[ijg]
tag | ijg | @ijg
clause | independent,jpeg | this software is based in part on the work of the independent jpeg group
[bzip2-1.0.6]
tag | bzip2-1 | @bzip2-1\.0\.6
name | bzip2,licen | bzip2 licen[sc]e
[mulanpsl-2.0]
tag | mulanpsl-2 | @mulanpsl-2\.0
address | coscl,mulanpsl2 | license\.coscl\.org\.cn/mulanpsl2
name | mulan,permissive | mulan permissive software licen[sc]e % 2
short | mulan,psl | mulan psl % 2
[cecill-2.1]
tag | cecill-2 | @cecill-2\.1
address | cecill,licences | cecill\.info/licences/licence_cecill_v2\.1
name | cecill,free | cecill free software licen[sc]e agreement % 2\.1
short | cecill | cecill % 2\.1
[openrail-m]
tag | openrail | @(?:creativeml-)?openrail(?:-m)?
address | licenses.ai | licenses\.ai
name | responsible,ai | open responsible ai licen[sc]e
short | openrail | (?:creativeml )?openrail(?:-m|\+\+-m)?
[llama-2]
name | llama,community | llama 2 community licen[sc]e(?: agreement)?
[llama-3]
name | llama,community | (?:meta )?llama 3(?:\.\d)? community licen[sc]e(?: agreement)?
[gemma]
name | gemma,terms | gemma terms of use
[polyform]
name | polyform,noncommercial | polyform non ?commercial licen[sc]e % 1\.0\.0
name | polyform,shield | polyform shield licen[sc]e % 1\.0\.0
[proprietary]
clause | rights,reserved | all rights reserved
clause | proprietary,confidential | proprietary and confidential
clause | unauthorized,copying | unauthori[sz]ed copying of this (?:file|software|document).{1,60}? is strictly prohibited
[public-domain]
clause | dedicated,domain | dedicated to the public domain
clause | released,domain | released into the public domain
clause | placed,domain | (?:has been |is )?placed in the public domain
name | work,domain | this work is in the public domain
"""
