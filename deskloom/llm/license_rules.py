"""Signature rules of operator 5: (label, level, words before the keyword, keyword, pattern, base).

A rule's text is a regular expression over lower-case words parted by single spaces, its keyword in braces; what stands
before the keyword has a fixed number of words. Levels order the rules: 0 identifiers, 1 licence texts and addresses, 2
names with a version, 3 names, 4 mere references. Hand-written; identifiers are expanded from lists by two templates.
"""

from __future__ import annotations

from typing import NamedTuple

#: Words of a rule's match, at most.
LONGEST = 24
#: A detection's confidence by level.
CONFIDENCE = (1.0, 0.95, 0.9, 0.8, 0.5)
#: The score of a base phrase.
BASE_CONFIDENCE = 0.8

#: Identifier -> label.
IDENTIFIERS = """
0BSD: 0bsd | AFL-3.0: afl | AGPL-1.0: agpl | AGPL-3.0: agpl | AGPL-3.0-only: agpl | AGPL-3.0-or-later: agpl | Apache-1.0: apache
Apache-1.1: apache | Apache-2.0: apache | APSL-2.0: apsl | Artistic-1.0: artistic | Artistic-2.0: artistic | BlueOak-1.0.0: blueoak
BSD-1-Clause: bsd | BSD-2-Clause: bsd | BSD-3-Clause: bsd | BSD-3-Clause-Clear: bsd | BSD-4-Clause: bsd | BSL-1.0: boost | BUSL-1.1: busl
CAL-1.0: cal | CC0-1.0: cc0 | CC-BY-3.0: cc-by | CC-BY-4.0: cc-by | CC-BY-SA-3.0: cc-by-sa | CC-BY-SA-4.0: cc-by-sa | CC-BY-NC-4.0: cc-by-nc
CC-BY-NC-SA-4.0: cc-by-nc-sa | CC-BY-NC-ND-4.0: cc-by-nc-nd | CC-BY-ND-4.0: cc-by-nd | CDDL-1.0: cddl | CDDL-1.1: cddl | CECILL-2.1: cecill
CPAL-1.0: cpal | CPL-1.0: cpl | ECL-2.0: ecl | Elastic-2.0: elastic | EPL-1.0: epl | EPL-2.0: epl | EUPL-1.1: eupl | EUPL-1.2: eupl
GFDL-1.3: gfdl | GPL-1.0: gpl | GPL-2.0: gpl | GPL-2.0-only: gpl | GPL-2.0-or-later: gpl | GPL-3.0: gpl | GPL-3.0-only: gpl | GPL-3.0-or-later: gpl
HPND: hpnd | ICU: icu | ISC: isc | JSON: json | LGPL-2.0: lgpl | LGPL-2.1: lgpl | LGPL-2.1-only: lgpl | LGPL-2.1-or-later: lgpl
LGPL-3.0: lgpl | LGPL-3.0-only: lgpl | LGPL-3.0-or-later: lgpl | MIT: mit | MIT-0: mit | MPL-1.1: mpl | MPL-2.0: mpl | MS-PL: ms-pl | MS-RL: ms-rl
MulanPSL-2.0: mulan | NCSA: ncsa | ODbL-1.0: odbl | ODC-By-1.0: odc-by | OFL-1.1: ofl | OpenSSL: openssl | OSL-3.0: osl | PDDL-1.0: pddl
PHP-3.01: php | PostgreSQL: postgresql | Python-2.0: python | QPL-1.0: qpl | RPL-1.5: rpl | SSPL-1.0: sspl | UPL-1.0: upl | Unlicense: unlicense
Vim: vim | W3C: w3c | WTFPL: wtfpl | X11: mit | Zlib: zlib | ZPL-2.1: zpl
"""

#: Label; then, parted by "|", signatures of one level.
SIGNATURES = {
    1: """
mit: permission is hereby {granted} free of charge to any person obtaining a copy | opensource org {licenses} mit
mit: the above copyright notice and this permission {notice} shall be included in all copies
isc: permission to use copy modify and or {distribute} this software for any purpose | opensource org {licenses} isc
bsd: redistribution and use in source and {binary} forms with or without modification | opensource org {licenses} bsd( 2| 3)?( clause)?
bsd: nor the names of its {contributors} may be used to endorse | redistributions in {binary} form must reproduce the above copyright notice
apache: www apache org {licenses}( license)? 2 0 | apache org {licenses}( license)? 2 0 | opensource org {licenses} apache 2 0
apache: distributed on an as is {basis} without warranties or conditions of any kind
gpl: www gnu org {licenses}( old licenses)? gpl( [123] 0)? | gnu org {licenses}( old licenses)? gpl( [123] 0)?
gpl: this program is free {software} you can redistribute it and or modify it under the terms of the gnu general public license
lgpl: gnu org {licenses}( old licenses)? lgpl( [23] [01])? | this library is free {software} you can redistribute it and or modify it
agpl: gnu org {licenses} agpl( 3 0)? | gfdl: gnu org {licenses} fdl( 1 [23])?
mpl: mozilla org {mpl}( 2 0)? | this source code form is subject to the terms of the {mozilla} public license( v 2 0)?
cc0: creativecommons org {publicdomain} zero 1 0 | pd: creativecommons org {publicdomain} mark 1 0
cc-by: creativecommons org {licenses} by [1-4] [05] | cc-by-sa: creativecommons org {licenses} by sa [1-4] [05] | cc-by-nd: creativecommons org {licenses} by nd [1-4] [05]
cc-by-nc: creativecommons org {licenses} by nc [1-4] [05] | cc-by-nc-sa: creativecommons org {licenses} by nc sa [1-4] [05] | cc-by-nc-nd: creativecommons org {licenses} by nc nd [1-4] [05]
epl: eclipse org legal {epl}( v)?( [12]0| [12] 0)? | cddl: opensource org {licenses} cddl 1 [01] | artistic: opensource org {licenses} artistic( license)? [12] 0
unlicense: this is free and unencumbered {software} released into the public domain | unlicense: {unlicense} org
zlib: this {software} is provided as is without any express or implied warranty in no event will the authors
boost: www boost org {license} 1 0 txt | boost: boost org {license} 1 0 txt | wtfpl: do what the fuck you {want} to
wtfpl: www {wtfpl} net | ofl: scripts sil org {ofl} | odbl: opendatacommons org {licenses} odbl( 1 0)? | pddl: opendatacommons org {licenses} pddl( 1 0)?
odc-by: opendatacommons org {licenses} by( 1 0)? | eupl: joinup ec europa eu {collection} eupl | json: the {software} shall be used for good not evil
beerware: as long as you retain this {notice} you can do whatever you want with this stuff
""",
    2: """
apache: apache {license} v(ersion)?( )?(1|2)( [01])? | apache: apache {software} license( version)? (1|2)( [01])? | apache: {asl} 2 0 | apache: {apache} (v)?2( 0)?
gpl: general public {license} (v|version )?[123]( 0)?( only| or( any)? later)? | gpl: {gpl} ?(v|version )?[123]( 0)?( only| or later)? | gpl: {gplv2} | gpl: {gplv3}
lgpl: lesser general public {license} (v|version )?[23]( [01])?( only| or( any)? later)? | lgpl: library general public {license} (v|version )?2( [01])?
lgpl: {lgpl} ?(v|version )?[23]( [01])? | lgpl: {lgplv2} | lgpl: {lgplv3} | agpl: affero general public {license} (v|version )?[13]( 0)? | agpl: {agpl} ?(v|version )?[13]( 0)? | agpl: {agplv3}
gfdl: free documentation {license} (v|version )?1 [123] | mpl: mozilla public {license} (v|version )?[12]( [01])? | mpl: {mpl} ?(v|version )?[12]( [01])?
epl: eclipse public {license} (v|version )?[12]( 0)? | eupl: european union public {licen[cs]e} (v|version )?1 [12] | cddl: common development and distribution {license} (v|version )?1 [01]
bsd: [234] clause {bsd}( license)? | bsd: {bsd} [234] clause( license)? | bsd: (two|three|four) clause {bsd}( license)? | bsd: (new|modified|revised|simplified) {bsd}( license)?
cc-by: {cc} by [1-4] [05] | cc-by-sa: {cc} by sa [1-4] [05] | cc-by-nd: {cc} by nd [1-4] [05] | cc-by-nc: {cc} by nc [1-4] [05] | cc-by-nc-sa: {cc} by nc sa [1-4] [05] | cc-by-nc-nd: {cc} by nc nd [1-4] [05]
cc-by: creative commons {attribution} [1-4] [05] | cc-by-sa: creative commons {attribution} share ?alike [1-4] [05] | cc-by-nc: creative commons {attribution} non ?commercial [1-4] [05]
cc-by-nd: creative commons {attribution} no ?deriv(ative)?s [1-4] [05] | cc-by-nc-sa: creative commons {attribution} non ?commercial share ?alike [1-4] [05]
cc-by-nc-nd: creative commons {attribution} non ?commercial no ?deriv(ative)?s [1-4] [05] | cc0: {cc0} 1 0( universal)? | cc0: creative commons {zero} 1 0
artistic: artistic {license} (v|version )?[12] 0 | afl: academic free {license} (v|version )?[23] [01] | osl: open software {license} (v|version )?[123] 0
boost: boost software {license} (v|version )?1 0 | cpl: common public {license} (v|version )?1 0 | ofl: open font {license} (v|version )?1 [01] | zpl: zope public {license} (v|version )?2 [01]
python: psf {license} (v|version )?2 | php: php {license} (v|version )?3 0?1? | sspl: server side public {license} (v|version )?1 | busl: business source {license} (v|version )?1 [01]
elastic: elastic {license} (v|version )?2( 0)? | ms-pl: microsoft public {license} ms pl | ms-rl: microsoft reciprocal {license} ms rl | mulan: mulan psl {v2}
""",
    3: """
mit: mit {licen[cs]e} | mit: {mit} licensed | mit: {expat} licen[cs]e | mit: x11 {licen[cs]e} | isc: isc {licen[cs]e} | bsd: bsd {licen[cs]e} | bsd: bsd style {licen[cs]e} | bsd: {bsd} licensed
apache: apache {licen[cs]e} | apache: apache software {licen[cs]e} | apache: {apache} licensed | gpl: gnu general public {licen[cs]e} | gpl: gnu {gpl} | gpl: {gpl} licensed | gpl: gpl {licen[cs]e}
lgpl: gnu lesser general public {licen[cs]e} | lgpl: lesser general public {licen[cs]e} | lgpl: gnu library general public {licen[cs]e} | lgpl: gnu {lgpl} | lgpl: lgpl {licen[cs]e}
agpl: gnu affero general public {licen[cs]e} | agpl: affero general public {licen[cs]e} | agpl: gnu {agpl} | agpl: agpl {licen[cs]e} | gfdl: gnu free documentation {licen[cs]e} | gfdl: {gfdl}
mpl: mozilla public {licen[cs]e} | epl: eclipse public {licen[cs]e} | eupl: european union public {licen[cs]e} | cddl: common development and distribution {licen[cs]e} | cpl: common public {licen[cs]e}
cc-by: creative commons {attribution}( licen[cs]e)? | cc-by-sa: creative commons {attribution} share ?alike | cc-by-nd: creative commons {attribution} no ?deriv(ative)?s
cc-by-nc: creative commons {attribution} non ?commercial | cc-by-nc-sa: creative commons {attribution} non ?commercial share ?alike | cc-by-nc-nd: creative commons {attribution} non ?commercial no ?deriv(ative)?s
cc-by: {cc} by | cc-by-sa: {cc} by sa | cc-by-nd: {cc} by nd | cc-by-nc: {cc} by nc | cc-by-nc-sa: {cc} by nc sa | cc-by-nc-nd: {cc} by nc nd | cc0: {cc0} | cc0: creative commons {zero}
artistic: artistic {licen[cs]e} | afl: academic free {licen[cs]e} | osl: open software {licen[cs]e} | boost: boost software {licen[cs]e} | ofl: sil open font {licen[cs]e} | ofl: open font {licen[cs]e}
zlib: zlib {licen[cs]e} | zlib: zlib libpng {licen[cs]e} | unlicense: the {unlicense} | wtfpl: {wtfpl} | python: python software foundation {licen[cs]e} | python: psf {licen[cs]e} | php: php {licen[cs]e}
postgresql: postgresql {licen[cs]e} | openssl: openssl {licen[cs]e} | ruby: ruby {licen[cs]e} | vim: vim {licen[cs]e} | ncsa: ncsa {licen[cs]e} | hpnd: historical permission notice and {disclaimer}
odbl: open database {licen[cs]e} | odbl: {odbl} | pddl: public domain dedication and {licen[cs]e} | odc-by: open data commons attribution {licen[cs]e} | ms-pl: microsoft public {licen[cs]e} | ms-rl: microsoft reciprocal {licen[cs]e}
sspl: server side public {licen[cs]e} | busl: business source {licen[cs]e} | elastic: elastic {licen[cs]e} | cecill: cecill {licen[cs]e} | upl: universal permissive {licen[cs]e} | w3c: w3c software {licen[cs]e}
beerware: beer ?ware {licen[cs]e} | json: json {licen[cs]e} | ecl: educational community {licen[cs]e} | cpal: common public attribution {licen[cs]e} | rpl: reciprocal public {licen[cs]e} | qpl: q public {licen[cs]e}
zpl: zope public {licen[cs]e} | apsl: apple public source {licen[cs]e} | blueoak: blue oak model {licen[cs]e} | mulan: mulan permissive software {licen[cs]e} | pd: public {domain} dedication
""",
    4: """
reference: {licensed} under | reference: {released} under (the )?([^ ]+ ){0,4}licen[cs]e | reference: see the {licen[cs]e} file | reference: {licen[cs]e} terms | reference: under the terms of the {licen[cs]e}
reference: subject to the {licen[cs]e} | reference: open source {licen[cs]e} | reference: free software {licen[cs]e} | reference: dual {licensed} | reference: {relicensed} under | reference: {sublicensed} under
pd: in the public {domain} | pd: released to the public {domain} | pd: released into the public {domain} | proprietary: all rights {reserved} | proprietary: {proprietary} and confidential | proprietary: {proprietary} licen[cs]e
proprietary: commercial {licen[cs]e} | proprietary: end user {licen[cs]e} agreement | proprietary: {eula} | creative-commons: creative {commons} | copyleft: {copyleft}
""",
}
#: The base: phrase -> label. Every place counts.
BASE = {"mit {license}": "mit", "apache {license}": "apache", "general public {license}": "gpl"}


class Rule(NamedTuple):
    label: str
    level: int
    before: int
    keyword: str
    pattern: str
    base: bool


def _rule(label: str, level: int, text: str, base: bool = False) -> list[Rule]:
    head, keyword, tail = text.partition("{")[0], text.partition("{")[2].partition("}")[0], text.partition("}")[2]
    if ")?" in head or ".{" in head:
        raise ValueError(f"the words before the keyword must be of a fixed number: {text}")
    spelt = ["license", "licence"] if keyword == "licen[cs]e" else [keyword]
    return [Rule(label, level, head.count(" "), k, f"^{head}{k}{tail}(?= |$)", base) for k in spelt]


def _split(identifier: str) -> str:
    return "".join(c if c.isalnum() else " " for c in identifier.lower())


def rules() -> list[Rule]:
    """All rules, in order; repeats of a pattern are dropped."""
    out: list[Rule] = []
    for phrase, label in BASE.items():
        out += _rule(label, 3, phrase, base=True)
    for entry in IDENTIFIERS.replace("\n", "|").split("|"):
        if entry.strip():
            identifier, label = entry.strip().split(": ")
            out += _rule(label, 0, f"{{spdx}} license identifier {_split(identifier)}")
            out += _rule(label, 0, f"{{license}} {_split(identifier)}")
    for level, lines in SIGNATURES.items():
        for line in lines.strip().split("\n"):
            label = ""
            for entry in line.split(" | "):
                if ": " in entry:
                    label, entry = entry.split(": ", 1)
                out += _rule(label, level, entry)
    return list({(r.label, r.keyword, r.before, r.pattern, r.base): r for r in reversed(out)}.values())[::-1]
