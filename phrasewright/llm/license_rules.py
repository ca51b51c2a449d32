"""Signature rules for licence texts, over normalised words.

A rule is a regex over lower-case words with one space between; ``@`` marks the keyword that the
prefilter looks for (``@license``). Clauses of licence texts and notices are written by hand, one regex each
(``license_bodies`` and HAND); how licences are named follows from the families below: each version of each
family gets one rule a template. Longer, more certain wording has the higher priority.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .license_bodies import BODIES, BODY, SHARED


class Rule(NamedTuple):
    order: int
    label: str
    keyword: str
    #: another word the text around the keyword must hold, empty for none
    also: str
    pattern: str
    priority: int
    score: float
    base: bool


#: label: names (a regex), a word that every name holds, versions.
FAMILIES = {
    "apache": ("apache(?: software)?(?: foundation)?", "apache", "1 0|1 1|2 0"),
    "gpl": ("(?:gnu )?(?:general public|gpl)", "", "1|2|3"),
    "lgpl": ("(?:gnu )?(?:lesser general public|library general public|lgpl)", "", "2|2 1|3"),
    "agpl": ("(?:gnu )?(?:affero general public|agpl)", "", "1|3"),
    "gfdl": ("(?:gnu )?free documentation", "documentation", "1 1|1 2|1 3"),
    "mpl": ("mozilla public", "mozilla", "1 0|1 1|2 0"),
    "epl": ("eclipse public", "eclipse", "1 0|2 0"),
    "edl": ("eclipse distribution", "eclipse", "1 0"),
    "cddl": ("common development and distribution", "development", "1 0|1 1"),
    "cpl": ("common public", "common", "1 0"),
    "ipl": ("ibm public", "ibm", "1 0"),
    "eupl": ("european union public", "european", "1 0|1 1|1 2"),
    "osl": ("open software", "software", "1 0|2 0|2 1|3 0"),
    "afl": ("academic free", "academic", "1 1|1 2|2 0|2 1|3 0"),
    "artistic": ("(?:perl )?artistic", "artistic", "1 0|2 0"),
    "zpl": ("zope public", "zope", "1 1|2 0|2 1"),
    "php": ("php", "php", "3 0|3 01"),
    "psf": ("python(?: software foundation)?", "python", "2|2 0"),
    "ruby": ("ruby", "ruby", ""),
    "mit": ("(?:mit|expat|mit x11)", "", ""),
    "x11": ("x11", "x11", ""),
    "isc": ("isc", "isc", ""),
    "bsd-0-clause": ("(?:zero clause bsd|bsd zero clause|0bsd)", "", ""),
    "bsd-2-clause": ("(?:2 clause bsd|two clause bsd|simplified bsd|freebsd|bsd 2 clause)", "", ""),
    "bsd-3-clause": ("(?:3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd|bsd 3 clause)", "", ""),
    "bsd-4-clause": ("(?:4 clause bsd|four clause bsd|original bsd|old bsd|bsd 4 clause)", "", ""),
    "bsd": ("(?:berkeley software distribution|bsd(?: style)?)", "", ""),
    "zlib": ("(?:zlib(?: libpng)?)", "zlib", ""),
    "libpng": ("libpng", "libpng", "1|2"),
    "boost": ("boost software", "boost", "1 0"),
    "ncsa": ("(?:university of illinois ncsa|ncsa)(?: open source)?", "ncsa", ""),
    "postgresql": ("postgresql", "postgresql", ""),
    "openssl": ("(?:openssl|ssleay)", "", ""),
    "w3c": ("w3c software(?: notice and| and document)?", "w3c", ""),
    "vim": ("vim", "vim", ""),
    "json": ("json", "json", ""),
    "unlicense": ("unlicense", "unlicense", ""),
    "wtfpl": ("(?:wtfpl|do what the fuck you want to public)", "", "1|2"),
    "ms-pl": ("microsoft public", "microsoft", ""),
    "ms-rl": ("microsoft reciprocal", "microsoft", ""),
    "lppl": ("latex project public", "latex", "1 0|1 1|1 2|1 3a|1 3c"),
    "ofl": ("(?:sil )?open font", "font", "1 0|1 1"),
    "odbl": ("(?:open data commons )?open database", "database", "1 0"),
    "odc-by": ("open data commons attribution", "commons", "1 0"),
    "pddl": ("public domain dedication and", "dedication", "1 0"),
    "cecill": ("cecill(?: b| c)?", "cecill", "1 0|1 1|2 0|2 1"),
    "upl": ("universal permissive", "permissive", "1 0"),
    "blueoak": ("blue oak model", "oak", "1 0 0"),
    "mulan": ("mulan permissive software", "mulan", "1|2"),
    "bsl": ("business source", "business", "1 0|1 1"),
    "sspl": ("server side public", "server", "1"),
    "elastic": ("elastic", "elastic", "1|2"),
    "cc0": ("(?:cc0|creative commons zero)", "", "1 0"),
    "cc-by": ("creative commons attribution", "creative", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-sa": ("creative commons attribution share ?alike", "creative", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nd": ("creative commons attribution no ?deriv(?:ative)?s?(?: works)?", "creative", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nc": ("creative commons attribution non ?commercial", "creative", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nc-sa": ("creative commons attribution non ?commercial share ?alike", "creative", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nc-nd": ("creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "creative", "1 0|2 0|2 5|3 0|4 0"),
}

_LICENSE = ("license", "licence", "lizenz", "licencia")
_GRANT = ("licensed", "released", "distributed", "published")

#: Further wording, one regex each: label, pattern, priority, score.
HAND = (
    ("cc-by", "@cc by(?: (?:1|2|3|4) [05])?(?: international)?", 40, 0.9),
    ("cc-by-sa", "@cc by sa(?: (?:1|2|3|4) [05])?(?: international)?", 50, 0.9),
    ("cc-by-nd", "@cc by nd(?: (?:1|2|3|4) [05])?(?: international)?", 50, 0.9),
    ("cc-by-nc", "@cc by nc(?: (?:1|2|3|4) [05])?(?: international)?", 50, 0.9),
    ("cc-by-nc-sa", "@cc by nc sa(?: (?:1|2|3|4) [05])?(?: international)?", 60, 0.9),
    ("cc-by-nc-nd", "@cc by nc nd(?: (?:1|2|3|4) [05])?(?: international)?", 60, 0.9),
    ("cc0", "@cc0(?: 1 0)?(?: universal)?", 40, 0.9),
    ("gpl", "@gpl ?v?(?:1|2|3)(?: 0)?(?: or later)?", 40, 0.9),
    ("lgpl", "@lgpl ?v?(?:2|3)(?: [01])?(?: or later)?", 40, 0.9),
    ("agpl", "@agpl ?v?(?:1|3)(?: 0)?(?: or later)?", 40, 0.9),
    ("gpl", "@gplv[123]", 40, 0.9), ("lgpl", "@lgplv[23]", 40, 0.9), ("agpl", "@agplv3", 40, 0.9),
    ("spdx", "@spdx license identifier [a-z0-9]+(?: [a-z0-9]+){0,4}", 20, 0.9),
    ("public-domain", "(?:in|into|to|is) the public @domain", 40, 0.8),
    ("public-domain", "(?:dedicated|released) (?:in|into|to) the public @domain", 50, 0.9),
    ("public-domain", "@gemeinfrei(?:e|es|er)?", 40, 0.7), ("public-domain", "@dominio publico", 40, 0.7),
    ("mit", "@permission is hereby granted free of charge to any person obtaining a copy", 70, 1.0),
    ("isc", "@permission to use copy modify and(?: or)? distribute this software", 70, 0.9),
    ("bsd", "@redistribution and use in source and binary forms", 70, 0.9),
    ("bsd", "@redistributions of source code must retain the above copyright notice", 70, 0.9),
    ("bsd", "neither the name of [a-z0-9 ]{1,60}nor the names of its @contributors", 70, 0.8),
    ("zlib", "this software is provided as is without any express or implied @warranty", 60, 0.7),
    ("no-warranty", "without @warranty of any kind", 30, 0.6), ("no-warranty", "@warranty of merchantability", 30, 0.6),
    ("no-warranty", "provided as is(?: and)? without(?: any)? @warranty", 30, 0.6),
    ("gpl", "free software you can @redistribute it and or modify it under the terms of the gnu general public", 70, 1.0),
    ("wtfpl", "you just do what the @fuck you want to", 60, 0.9),
    ("unlicense", "this is free and unencumbered software released into the public @domain", 70, 1.0),
    ("reserved", "(?:some|no) rights @reserved", 20, 0.5), ("reserved", "tous droits @reserves", 30, 0.6), ("reserved", "alle rechte @vorbehalten", 30, 0.7),
    ("reserved", "todos los derechos @reservados", 30, 0.7),
    ("copyright", "@copyright(?: c)?(?: (?:19|20)[0-9]{2}){1,4}", 20, 0.5), ("copyright", "@copyright by", 10, 0.4), ("copyright", "@copyrighted (?:material|work)s?", 20, 0.5),
    ("copyright", "@copyright holders?", 10, 0.4), ("proprietary", "@proprietary and confidential", 40, 0.7), ("proprietary", "@confidential and proprietary", 40, 0.7),
    ("proprietary", "@unauthorized (?:copying|reproduction|distribution|use)", 30, 0.6), ("proprietary", "may not be @reproduced", 30, 0.6),
    ("license-notice", "(?:this|the) (?:work|software|program|file|document|text|content)s? (?:is|are) @licensed under", 10, 0.4),
    ("license-notice", "under the terms of the @license", 10, 0.4), ("license-notice", "see the @license(?: file)? for", 10, 0.4),
    ("eula", "end user @license agreement", 40, 0.7),
)

#: Base phrases: always reported, never suppressed.
BASE = (("cc-by", "@cc by"), ("gpl", "general public @license"), ("reserved", "all rights @reserved"))


def _rules():
    for label, pattern in BASE:
        yield label, pattern, "", 30, 0.8, True
    for label, pattern, priority, score in HAND:
        yield label, pattern, "", priority, score, False
    for label, clauses in BODIES.items():
        for pattern in clauses:
            yield label, pattern, "", *SHARED.get(label, BODY), False
    for family, (name, also, versions) in FAMILIES.items():
        for v in versions.split("|"):
            label = f"{family}-{v.replace(' ', '.')}" if v else family
            tail = f"(?: version| v)? ?v?{v}(?: 0)?(?: or (?:later|any later version))?" if v else ""
            names = f"(?:{name})"
            for kw in _LICENSE:
                yield label, f"{names} @{kw}{tail}", also, 50 if v else 40, 0.9, False
            for grant in _GRANT[: 1 if v else 4]:
                yield label, f"@{grant} under (?:the |an? )?(?:terms of the )?{names}(?: licen[cs]e)?{tail}", also, 60 if v else 45, 1.0, False
        if versions:
            for kw in _LICENSE[:2]:
                yield family, f"{names} @{kw}", also, 30, 0.8, False


def rules() -> list[Rule]:
    out = []
    for label, pattern, also, priority, score, base in _rules():
        keyword = re.search(r"@([^ ()?|\[]+)", pattern)[1]
        bodies = [(keyword, pattern)]
        if (more := re.search(r"@([a-z0-9]+)((?:v?\[[0-9]+\])|\(\?:e\|es\|er\)\?|s\?)", pattern)) is not None:
            bodies = [(k, pattern.replace(more[0], f"@{k}")) for k in _spellings(more[1], more[2])]
        for kw, body in bodies:
            out.append(Rule(len(out), label, kw, also, body, priority, score, base))
    return out


def _spellings(stem: str, tail: str) -> list[str]:
    """The words that a keyword with a short regex behind it stands for."""
    if tail.startswith("[") or tail.startswith("v["):
        return [stem + tail.split("[")[0] + c for c in tail.split("[")[1].rstrip("]")]
    return [stem, *[stem + x for x in (("s",) if tail == "s?" else ("e", "es", "er"))]]
