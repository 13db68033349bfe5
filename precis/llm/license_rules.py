"""The ordered rules of the licence scan.

Patterns run over a text's words (lower-case letters, digits and all non-ASCII
characters) joined by single spaces, so line breaks, comment signs and
punctuation do not matter: "GPL-3.0" reads ``gpl 3 0``.  A rule is tried only on
texts that hold one of its gate words.

Every licence of ``LICENCES`` gives up to five rules, one for each form in which
it is named; ``NOTICES`` are passages written out one by one.  Kinds, best
first, with the strength of a detection: a passage of a licence's own notice, a
machine-readable tag, a grant ("licensed under ..."), an address, a name, an
abbreviation.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Kinds in order of priority and the strength of a detection.
KINDS = {"notice": 0.95, "tag": 0.95, "grant": 0.9, "address": 0.8, "name": 0.6, "short": 0.4}


class Rule(NamedTuple):
    label: str
    kind: str
    gates: tuple[str, ...]   # one of these words must be there
    pattern: re.Pattern


L = r"licen[sc]e"
GRANT = (r"(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|shared|covered|issued|placed)"
         r"(?: to you)? (?:under|by|with) (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?")
TAG = r"spdx licen[sc]e identifier (?:\S+ (?:and|or|with) ){0,3}"


def version(*numbers: str) -> str:
    """``2.0`` as ``2 0``, ``2``, ``v2``, ``v 2 0`` or ``version 2 0``, not ``2 1``."""
    out = []
    for n in numbers:
        major, _, minor = n.partition(".")
        tail = f" {minor}" if minor not in ("", "0") else "(?: 0)?"
        out.append(f"{major}{tail}(?! [0-9](?!\\S))")
    return f"(?:version |ver |v |v)?(?:{'|'.join(out)})"


def gnu(label: str, kind: str, short: str, n: str, end: str = "") -> tuple:
    """A licence of the GNU family in one version; ``end`` is ``only`` or ``or later``."""
    v = version(n)
    tail = {"": "", "only": " only", "or later": "(?: or| and)? (?:any )?(?:later|newer)(?: versions?)?"}[end]
    name = rf"(?:gnu )?{kind} {L} {v}{tail}"
    one = n.replace(".", " ")
    marks = {"": "", "only": " only", "or later": " or later"}[end]
    return (label, name, rf"(?:gnu )?{short}(?: |v)?(?:{version(n)}){tail}", rf"{short} {one}{marks}",
            rf"gnu org licenses (?:old licenses )?{short} {one}" if not end else "",
            f"gnu general lesser library affero documentation {short} {short}v{n[0]} {short}{n[0]}")


def creative(code: str, n: str) -> tuple:
    """A Creative Commons licence in one version, or in none."""
    words = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    parts = code.split("-")
    v = f" (?:{version(n)}|{n.replace('.', ' ')})" if n else r"(?! (?:sa|nc|nd|share|sharealike|non|noncommercial|no|noderivs|noderivatives))"
    place = "(?: (?:international|unported|generic|deed))?"
    name = rf"(?:creative commons|cc) {' '.join(words[p] for p in parts)}(?: {L})?{v}{place}(?: {L})?"
    short = rf"cc {' '.join(parts)}(?: {L})?{v}"
    one = f" {n.replace('.', ' ')}" if n else r"(?! (?:sa|nc|nd|\d))"
    return ("cc-" + code + (f"-{n}" if n else ""), name, short, rf"cc {' '.join(parts)}{one}" if n else "",
            rf"creativecommons org licen[sc]es {' '.join(parts)}{one}", "cc creative creativecommons")


VERSIONS = {"gpl": ("general public", "1.0 2.0 3.0"), "lgpl": ("(?:lesser|library)(?: general)? public", "2.0 2.1 3.0"),
            "agpl": ("affero general public", "1.0 3.0"), "gfdl": ("free documentation", "1.1 1.2 1.3")}

#: label, name, abbreviation, tag, address, gate words ("" where a form does not exist).
LICENCES = [
    *[gnu(f"{k}-{n}{e and '-' + e.replace(' ', '-')}", name, k, n, e)
      for e in ("or later", "only", "") for k, (name, all_) in VERSIONS.items() for n in all_.split()],
    ("agpl", rf"(?:gnu )?affero general public {L}", "(?:gnu )?agpl", "agpl", "gnu org licenses agpl", "affero agpl"),
    ("lgpl", rf"(?:gnu )?(?:lesser|library)(?: general)? public {L}", "(?:gnu )?lgpl", "lgpl", "gnu org licenses lgpl", "lesser library lgpl"),
    ("gfdl", rf"(?:gnu )?free documentation {L}", "(?:gnu )?(?:gfdl|fdl)", "gfdl", "gnu org licenses fdl", "documentation gfdl fdl"),
    ("gpl", rf"(?:gnu )?general public {L}s?", "(?:gnu )?gpl", "gpl", "gnu org licenses gpl", "general gpl"),
    ("gpl", rf"licen[cs]e publique générale gnu|licencia pública general de gnu", "", "", "", "gnu"),
    *[creative(c, n) for n in ("4.0", "3.0", "2.5", "2.0", "1.0", "") for c in ("by-nc-sa", "by-nc-nd", "by-sa", "by-nc", "by-nd", "by")],
    ("cc0-1.0", rf"(?:creative commons |cc )?(?:cc0|zero|cc zero)(?: 1 0)? (?:universal|public domain)(?: dedication)?(?: {L})?", "cc0(?: 1 0)?",
     "cc0 1 0", "creativecommons org publicdomain zero 1 0", "cc0 zero creativecommons"),
    ("apache-2.0", rf"apache(?: software)? {L} {version('2.0')}|apache {version('2.0')}(?: {L})?", "asl 2 0", "apache 2 0",
     "apache org licenses license 2 0", "apache asl"),
    ("apache-1.1", rf"apache(?: software)? {L} {version('1.1')}", "", "apache 1 1", "apache org licenses license 1 1", "apache"),
    ("apache-1.0", rf"apache(?: software)? {L} {version('1.0')}", "", "apache 1 0", "apache org licenses license 1 0", "apache"),
    ("apache", rf"apache(?: software)? {L}|{L} apache|licencia apache|apache lizenz", "", "", "apache org licenses", "apache"),
    ("mit", rf"(?:the )?(?:mit|expat|x11) (?:style )?{L}|{L} (?:mit|expat)|licencia mit|mit lizenz", "", "mit|expat", "opensource org licenses mit",
     "license licence licencia lizenz mit expat"),
    ("bsd-4-clause", rf"(?:4|four) clause bsd(?: {L})?|original bsd {L}|bsd (?:4|four) clause(?: {L})?", "", "bsd 4 clause", "", "bsd"),
    ("bsd-3-clause", rf"(?:3|three) clause bsd(?: {L})?|(?:new|modified|revised) bsd {L}|bsd (?:3|three) clause(?: {L})?", "", "bsd 3 clause",
     "opensource org licenses bsd 3 clause", "bsd"),
    ("bsd-2-clause", rf"(?:2|two) clause bsd(?: {L})?|(?:simplified|freebsd) (?:bsd )?{L}|bsd (?:2|two) clause(?: {L})?", "", "bsd 2 clause",
     "opensource org licenses bsd 2 clause", "bsd freebsd simplified"),
    ("0bsd", rf"zero clause bsd(?: {L})?|bsd zero clause {L}", "0bsd", "0bsd", "opensource org licenses 0bsd", "bsd 0bsd"),
    ("bsd", rf"bsd (?:style )?{L}|{L} bsd|licencia bsd|bsd lizenz", "", "", "opensource org licenses bsd", "bsd"),
    ("isc", rf"isc {L}|internet (?:systems|software) consortium {L}", "", "isc", "opensource org licenses isc", "isc consortium"),
    ("mpl-2.0", rf"mozilla public {L} {version('2.0')}", f"mpl {version('2.0')}|mplv2", "mpl 2 0", "mozilla org mpl 2 0", "mozilla mpl mplv2"),
    ("mpl-1.1", rf"mozilla public {L} {version('1.1')}", f"mpl {version('1.1')}", "mpl 1 1", "mozilla org mpl mpl 1 1", "mozilla mpl"),
    ("mpl-1.0", rf"mozilla public {L} {version('1.0')}", f"mpl {version('1.0')}", "mpl 1 0", "", "mozilla mpl"),
    ("mpl", rf"mozilla public {L}", "", "", "mozilla org mpl", "mozilla"),
    ("epl-2.0", rf"eclipse public {L} {version('2.0')}", f"epl {version('2.0')}", "epl 2 0", "eclipse org legal epl (?:2 0|v20)", "eclipse epl"),
    ("epl-1.0", rf"eclipse public {L} {version('1.0')}", f"epl {version('1.0')}", "epl 1 0", "eclipse org legal epl v10", "eclipse epl"),
    ("edl-1.0", rf"eclipse distribution {L}(?: {version('1.0')})?", "", "", "eclipse org org documents edl v10", "eclipse"),
    ("epl", rf"eclipse public {L}", "", "", "", "eclipse"),
    ("cddl-1.1", rf"common development and distribution {L} {version('1.1')}", f"cddl {version('1.1')}", "cddl 1 1", "", "cddl development"),
    ("cddl-1.0", rf"common development and distribution {L} {version('1.0')}", f"cddl {version('1.0')}", "cddl 1 0", "opensource org licenses cddl 1 0", "cddl development"),
    ("cddl", rf"common development and distribution {L}", "cddl", "", "", "cddl development"),
    ("cpl-1.0", rf"common public {L}(?: {version('1.0')})?", "", "cpl 1 0", "", "common cpl"),
    ("ipl-1.0", rf"ibm public {L}(?: {version('1.0')})?", "", "ipl 1 0", "", "ibm ipl"),
    ("osl-3.0", rf"open software {L}(?: {version('3.0')})?", f"osl {version('3.0')}", "osl 3 0", "opensource org licenses osl 3 0", "open osl"),
    ("afl-3.0", rf"academic free {L}(?: {version('3.0')})?", f"afl {version('3.0')}", "afl 3 0", "opensource org licenses afl 3 0", "academic afl"),
    ("artistic-2.0", rf"artistic {L} {version('2.0')}", "", "artistic 2 0", "opensource org licenses artistic 2 0|perlfoundation org artistic license 2 0", "artistic"),
    ("artistic-1.0", rf"artistic {L}(?: {version('1.0')})?", "", "artistic 1 0", "opensource org licenses artistic 1 0", "artistic"),
    ("bsl-1.0", rf"boost software {L}(?: {version('1.0')})?", "", "bsl 1 0", "boost org license 1 0(?: txt)?", "boost bsl"),
    ("busl-1.1", rf"business source {L}(?: {version('1.1')})?", f"(?:busl|bsl) {version('1.1')}", "busl 1 1", "mariadb com bsl11", "business busl bsl mariadb"),
    ("sspl-1.0", rf"server side public {L}(?: {version('1.0', '1')})?", "sspl", "sspl 1 0", "mongodb com licensing server side public license", "sspl server"),
    ("elastic-2.0", rf"elastic {L}(?: {version('2.0')})?", "", "elastic 2 0", "elastic co licensing elastic license", "elastic"),
    ("eupl-1.2", rf"european union public {L}(?: {version('1.2')})?", f"eupl {version('1.2')}", "eupl 1 2", "joinup ec europa eu collection eupl", "european eupl"),
    ("eupl-1.1", rf"european union public {L} {version('1.1')}", f"eupl {version('1.1')}", "eupl 1 1", "", "european eupl"),
    ("cecill-2.1", rf"cecill (?:free software {L} )?{version('2.1')}|{L} cecill {version('2.1')}", "", "cecill 2 1", "", "cecill"),
    ("cecill-b", rf"cecill b(?: {L})?", "", "cecill b", "", "cecill"),
    ("cecill-c", rf"cecill c(?: {L})?", "", "cecill c", "", "cecill"),
    ("cecill", rf"cecill(?: free software)? {L}|{L} cecill", "", "", "cecill info licences", "cecill"),
    ("etalab-2.0", rf"{L} ouverte(?: etalab)?(?: {version('2.0')})?|open {L} etalab", "", "etalab 2 0", "etalab gouv fr licence ouverte", "ouverte etalab"),
    ("odbl-1.0", rf"open (?:data commons )?(?:open )?database {L}(?: {version('1.0')})?", "odbl(?: 1 0)?", "odbl 1 0", "opendatacommons org licenses odbl", "database odbl opendatacommons"),
    ("odc-by-1.0", rf"open data commons attribution {L}(?: {version('1.0')})?", f"odc by(?: {version('1.0')})?", "odc by 1 0", "opendatacommons org licenses by", "odc commons opendatacommons"),
    ("pddl-1.0", rf"public domain dedication and {L}(?: {version('1.0')})?", "pddl", "pddl 1 0", "opendatacommons org licenses pddl", "pddl dedication opendatacommons"),
    ("ogl-3.0", rf"open government {L} {version('3.0')}", f"ogl {version('3.0')}", "ogl uk 3 0", "nationalarchives gov uk doc open government licence version 3", "government ogl nationalarchives"),
    ("ogl", rf"open government {L}", "", "", "nationalarchives gov uk doc open government licence", "government nationalarchives"),
    ("ofl-1.1", rf"(?:sil )?open font {L}(?: {version('1.1')})?", f"(?:sil )?ofl {version('1.1')}", "ofl 1 1", "scripts sil org ofl|openfontlicense org", "font ofl openfontlicense"),
    ("zlib", rf"zlib(?: libpng)? {L}", "", "zlib", "opensource org licenses zlib", "zlib"),
    ("libpng", rf"libpng {L}", "", "libpng", "", "libpng"),
    ("openssl", rf"openssl(?: ssleay)? {L}", "", "openssl", "openssl org source license", "openssl"),
    ("postgresql", rf"postgresql {L}", "", "postgresql", "postgresql org about licence", "postgresql"),
    ("php-3.01", rf"php {L}(?: {version('3.01')})?", "", "php 3 01", "php net license", "php"),
    ("python-2.0", rf"python software foundation {L}(?: {version('2', '2.0')})?|psf {L}", "", "python 2 0|psf 2 0", "docs python org (?:\\S+ )?license", "python psf"),
    ("ruby", rf"ruby {L}", "", "ruby", "", "ruby"),
    ("unlicense", r"(?:the )?unlicense", "", "unlicense", "unlicense org", "unlicense"),
    ("wtfpl", rf"do what the f\S+ you want to public {L}", "wtfpl", "wtfpl", "wtfpl net", "wtfpl want"),
    ("beerware", rf"beer ?ware {L}", "", "beerware", "", "beerware beer"),
    ("ms-pl", rf"microsoft public {L}", "ms pl", "ms pl", "opensource org licenses ms pl", "microsoft ms"),
    ("ms-rl", rf"microsoft reciprocal {L}", "ms rl", "ms rl", "opensource org licenses ms rl", "microsoft ms"),
    ("ncsa", rf"university of illinois (?:ncsa )?open source {L}|illinois open source {L}", "", "ncsa", "opensource org licenses ncsa", "illinois ncsa"),
    ("upl-1.0", rf"universal permissive {L}(?: {version('1.0')})?", f"upl {version('1.0')}", "upl 1 0", "oss oracle com licenses upl", "permissive upl"),
    ("lppl-1.3c", rf"latex project public {L}(?: {version('1.3c')})?", "lppl", "lppl 1 3c", "latex project org lppl", "latex lppl"),
    ("blueoak-1.0.0", rf"blue oak model {L}(?: 1 0 0)?", "", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0", "oak blueoak blueoakcouncil"),
    ("mulan-psl-2.0", rf"mulan (?:psl|permissive software {L})(?: {version('2')})?", "mulanpsl", "mulanpsl 2 0", "license coscl org cn mulanpsl2", "mulan mulanpsl mulanpsl2"),
    ("openrail", rf"(?:creativeml )?open ?rail(?: m)?(?: {L})?", "", "", "", "openrail rail"),
    ("cdla-permissive-2.0", rf"community data {L} agreement permissive(?: {version('2.0')})?", "cdla permissive 2 0", "cdla permissive 2 0", "cdla dev permissive 2 0|cdla io permissive", "cdla community"),
    ("public-domain", r"public domain dedication|public domain mark(?: 1 0)?", "", "", "creativecommons org publicdomain mark", "domain publicdomain"),
]

SOFTWARE = r"(?:this|the) (?:program|software|library|file|package|work|project|code|document|module)"
NAMED = r"(?:\S+ ){1,12}"

#: label, passage, gate words.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", rf"neither the names? of {NAMED}(?:nor the names of its contributors )?may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", "permission"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided", "permission"),
    ("apache-2.0", rf"licensed under the apache {L} {version('2.0')} the {L} you may not use this file except in compliance", "apache"),
    ("apache", rf"licensed to the apache software foundation asf under one or more contributor {L} agreements", "apache"),
    ("apache-2.0", rf"unless required by applicable law or agreed to in writing software distributed under the {L} is distributed on an as is basis", "applicable"),
    *[(f"{k}{'-' + n if n else ''}{'-or-later' if n else ''}",
       rf"free software you can redistribute it and or modify it under the terms of the gnu {VERSIONS[k][0]} {L} as published by the free software foundation"
       + (rf" either {version(n)} of the {L} or at your option any later version" if n else ""), "redistribute")
      for k, ns in (("gpl", "3.0 2.0"), ("lgpl", "3.0 2.1"), ("agpl", "3.0")) for n in [*ns.split(), ""]],
    *[(k, rf"you should have received a copy of the gnu {VERSIONS[k][0]} {L}", "received") for k in ("gpl", "lgpl", "agpl")],
    ("gfdl", rf"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}", "documentation"),
    ("gpl", rf"everyone is permitted to copy and distribute verbatim copies of this {L} document but changing it is not allowed", "verbatim"),
    ("mpl-2.0", rf"this source code form is subject to the terms of the mozilla public {L} {version('2.0')}", "mozilla"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl-1.1", rf"the contents of this file are subject to the mozilla public {L} {version('1.1')}", "mozilla"),
    ("epl", rf"this program and the accompanying materials are made available under the terms of the eclipse public {L}", "eclipse"),
    ("cddl", rf"the contents of this file are subject to the terms of the common development and distribution {L}", "development"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile"),
    ("cc0-1.0", rf"to the extent possible under law {NAMED}(?:has|have) (?:dedicated|waived) all copyright", "waived dedicated"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "permission"),
    ("ofl-1.1", rf"this font software is licensed under the sil open font {L}", "font"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("ncsa", r"neither the names of (?:\S+ ){1,20}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "agreement"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "retain"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("eupl-1.2", rf"licensed under the eupl {version('1.2')} or as soon they will be approved by the european commission", "eupl"),
    ("cecill", r"this software is governed by the cecill(?: b| c)? license under french law", "cecill"),
    ("cecill", r"ce logiciel est régi par la licence cecill", "cecill"),
    ("odbl-1.0", rf"this (?:\S+ ){{1,8}}is made available under the open database {L}", "database"),
    ("ogl-3.0", rf"contains (?:public sector|ordnance survey|parliamentary) information licensed under the open government {L} {version('3.0')}", "government"),
    ("cc-by", r"you are free to share copy and redistribute the material in any medium or format", "redistribute"),
    ("public-domain", rf"{SOFTWARE} (?:is|has been) (?:hereby )?(?:in|placed in|placed into|released (?:in)?to|dedicated to|donated to) the public domain", "domain"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", "domain"),
    ("public-domain", r"no (?:known )?copyright (?:is claimed|restrictions)", "copyright"),
    ("reserved", r"all rights (?:are )?(?:strictly )?reserved|no rights (?:are )?granted", "rights"),
    ("reserved", r"tous droits réservés|tous les droits sont réservés|tous droits reserves", "droits"),
    ("reserved", r"alle rechte vorbehalten|sämtliche rechte vorbehalten", "rechte"),
    ("reserved", r"(?:todos los derechos reservados|reservados todos los derechos)", "derechos"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution)(?: or \S+)? of (?:this|these|the) \S+(?: via any medium)? is strictly prohibited", "unauthorized"),
    ("proprietary", r"no part of this (?:publication|book|document|work|site|website) may be (?:reproduced|copied|stored|transmitted|distributed)", "reproduced copied stored transmitted distributed"),
    ("proprietary", r"may not be (?:reproduced|copied|republished|redistributed|distributed)(?: \S+){0,8} without (?:the )?(?:prior |express |explicit )*(?:written )?(?:permission|consent)", "permission consent"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)(?: information)?", "proprietary"),
    ("proprietary", r"(?:toute )?reproduction (?:même partielle )?(?:est )?(?:strictement )?interdite(?: sans autorisation)?", "interdite"),
    ("proprietary", r"vervielfältigung(?: \S+){0,6} nur mit (?:ausdrücklicher |schriftlicher )*genehmigung", "genehmigung"),
    ("proprietary", r"(?:queda )?prohibida (?:la |su )?reproducción(?: total o parcial)?", "prohibida"),
]


def rules() -> list[Rule]:
    """All rules, best first: by kind, then as listed (versions stand before
    the name without one)."""
    made: dict[str, list] = {k: [] for k in KINDS}
    for label, passage, gates in NOTICES:
        made["notice"].append((label, passage, gates))
    for label, name, short, tag, address, gates in LICENCES:
        if tag:
            made["tag"].append((label, f"{TAG}(?:{tag})(?! \\d(?!\\S))", "spdx"))
        if name:
            made["grant"].append((label, f"{GRANT}(?:{'|'.join(x for x in (name, short) if x)})(?: {L}| lizenz)?", gates))
            made["name"].append((label, name, gates))
        if address:
            made["address"].append((label, address, gates + " opensource gnu"))
        if short:
            made["short"].append((label, short, gates))
    return [Rule(label, kind, tuple(sorted(set(gates.split()))), re.compile(rf"(?<!\S)(?:{p})(?!\S)".encode()))
            for kind in KINDS for label, p, gates in made[kind]]
