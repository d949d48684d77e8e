"""Templates of licenses: whole texts (license_texts) and the standard notices of each license and version.

Names are `SPDX name:form`; the part before the colon is the license. TOLD has, for each template, the
phrases that tell its license from its versions and variants. Each of them must stand in the text word
for word and be aligned; one that begins with ! must not stand there.
"""

from __future__ import annotations

import pkgutil

TEMPLATES: dict[str, str] = {}
TOLD: dict[str, tuple[str, ...]] = {}
#: Licenses that the whole text of another one names without granting them.
MENTIONS = {"GFDL-1.3": {"CC-BY-SA-3.0"}, "MPL-2.0": {"AGPL-3.0", "GPL-2.0", "LGPL-2.1"}}

_LEADS = ("Licensed", "Released", "Distributed", "Available")


def _add(name: str, text: str, *told: str) -> None:
    TEMPLATES[name] = text
    TOLD[name] = told


def _lead(name: str, rest: str, *told: str) -> None:
    """A short notice, which has no word to spare: one template for each usual verb."""
    for verb in _LEADS:
        _add(f"{name}-{verb.lower()}", f"{verb} under {rest}", *told)


#: Of each whole text, what its heading or clauses say and those of its relatives don't.
_TEXTS = {
    "0BSD": ("fee is hereby granted the software is provided",),
    "Apache-2.0": ("apache license version 2 0 january 2004",),
    "Artistic-1.0": ("artistic license",),
    "BSD-2-Clause": ("redistributions in binary form must reproduce", "!endorse or promote", "!advertising materials mentioning"),
    "BSD-3-Clause": ("redistributions in binary form must reproduce", "endorse or promote products derived from this software", "!advertising materials mentioning"),
    "BSL-1.0": ("any person or organization obtaining a copy",),
    "CC-BY-4.0": ("creative commons attribution 4 0 international public license",),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international public license",),
    "CC0-1.0": ("cc0 1 0 universal",),
    "GFDL-1.2": ("gnu free documentation license version 1 2 november 2002",),
    "GFDL-1.3": ("gnu free documentation license version 1 3 3 november 2008",),
    "GPL-1.0": ("gnu general public license version 1 february 1989",),
    "GPL-2.0": ("gnu general public license version 2 june 1991",),
    "GPL-3.0": ("gnu general public license version 3 29 june 2007", "use with the gnu affero general public license"),
    "ISC": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "LGPL-2.0": ("gnu library general public license version 2 june 1991",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1 february 1999",),
    "LGPL-3.0": ("gnu lesser general public license version 3 29 june 2007",),
    "MIT": ("shall be included in all copies or substantial portions of the software", "deal in the software", "!except as contained in this notice"),
    "MPL-1.1": ("mozilla public license version 1 1",),
    "MPL-2.0": ("mozilla public license version 2 0",),
    "NCSA": ("neither the names of", "deal with the software"),
    "OFL-1.1": ("sil open font license version 1 1",),
    "Unicode-3.0": ("unicode license v3",),
    "Unlicense": ("anyone is free to copy modify publish use compile sell or distribute",),
    "Zlib": ("altered source versions must be plainly marked",),
}
for _name, _told in _TEXTS.items():
    _add(f"{_name}:text", pkgutil.get_data(__package__, f"license_texts/{_name}.txt").decode(), *_told)

_bsd3, _mit = TEMPLATES["BSD-3-Clause:text"], TEMPLATES["MIT:text"]
_advertising = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_add("BSD-4-Clause:text", _bsd3.replace("3. Neither", f"3. {_advertising}\n\n4. Neither"), "advertising materials mentioning", "endorse or promote products derived from this software")
_grant = _mit.index("The above copyright notice"), _mit.index("THE SOFTWARE IS PROVIDED")
_add("MIT-0:text", _mit[: _grant[0]].replace(", subject to the following conditions:", ".") + _mit[_grant[1] :], "software is furnished to do so the software is provided as is")
_except = "Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization."
_add("X11:text", f"{_mit}\n{_except}", "shall be included in all copies or substantial portions of the software", "except as contained in this notice")

# GNU licenses: the notices of the Free Software Foundation, and shorter ones. "General" next to "GNU" tells
# the plain license from the Lesser, Library and Affero ones.
_GNU = {"GPL": ("General Public License", ("1", "2", "3")), "AGPL": ("Affero General Public License", ("3",)), "LGPL": ("Lesser General Public License", ("2.1", "3"))}
for _short, (_long, _versions) in [*_GNU.items(), ("LGPL", ("Library General Public License", ("2",))), ("LGPL", ("Lesser General Public License", ("2",)))]:
    for _v in _versions:
        _name, _words = f"{_short}-{_v if '.' in _v else _v + '.0'}", _v.replace(".", " ")
        _form = f"{_name}:{_long.split()[0].lower()}"
        _full, _is = f"gnu {_long}".lower(), (f"version {_words}", *(["!version 2 1"] if _name == "LGPL-2.0" else []))
        _first = {"GPL-3.0": "GPL-3.0", "LGPL-3.0": "LGPL-3.0"}.get(_name, f"{_form}-work")
        _add(_first, f"This {'library' if _short == 'LGPL' else 'work'} is licensed under the GNU {_long}, version {_v}", _full, *_is)
        _lead(_form, f"the GNU {_long}, version {_v}", _full, *_is)
        _lead(f"{_form}-v", f"the GNU {_long} v{_v}", f"{_full} v{_words}", "!v2 1" if _name == "LGPL-2.0" else f"v{_words}")
        _date = {"GPL1": "February 1989", "GPL2": "June 1991", "GPL3": "29 June 2007", "AGPL3": "19 November 2007", "LGPL2": "June 1991", "LGPL2.1": "February 1999", "LGPL3": "29 June 2007"}[_short + _v]
        _add(f"{_form}-heading", f"GNU {_long} Version {_v}, {_date}", f"{_full} version {_words} {_date}".lower())
        _add(f"{_form}-later", f"under the terms of the GNU {_long} as published by the Free Software Foundation; either version {_v} of the License, or (at your option) any later version", _full, *_is)
        _add(f"{_form}-later-version", f"under the terms of the GNU {_long}, version {_v}, or (at your option) any later version, as published by the Free Software Foundation", _full, *_is)
        _add(f"{_form}-only", f"under the terms of the GNU {_long} version {_v} as published by the Free Software Foundation", _full, *_is)
        _add(f"{_form}-of", f"under the terms of version {_v} of the GNU {_long} as published by the Free Software Foundation", _full, *_is)
        if _form.endswith("library"):
            continue
        for _how in (f"{_short}v{_v}", f"{_short} v{_v}", f"{_short} {_v if '.' in _v else _v + '.0'}", f"{_short} version {_v}", f"{_short}{_v}"):
            _key = _how.lower().replace(".", " ")
            _bar = [f"!{_key} 1"] if _name == "LGPL-2.0" and not _key.endswith(" 0") else []
            _lead(f"{_form}-{_key.replace(' ', '-')}", f"the {_how}", _key, *_bar)
            _lead(f"{_form}-gnu-{_key.replace(' ', '-')}", f"the GNU {_how}", f"gnu {_key}", *_bar)

# Creative Commons: every variant and version; the whole phrase must stand in the text.
_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
for _variant in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    _spelled = "-".join(_PARTS[p] for p in _variant.split("-"))
    _longs = dict.fromkeys([_spelled, _spelled.replace("NoDerivatives", "NoDerivs"), _spelled.replace("NonCommercial", "Non-Commercial").replace("ShareAlike", "Share-Alike").replace("NoDerivatives", "No-Derivatives")])
    for _v in ("4.0", "3.0", "2.5", "2.0", "1.0"):
        _name, _words = f"CC-{_variant}-{_v}", _v.replace(".", " ")
        _key = f"cc {_variant} {_v}".lower().replace("-", " ").replace(".", " ")
        _add(_name, f"Licensed under CC {_variant} {_v}", _key)
        _add(f"{_name}:a", f"Licensed under a CC {_variant} {_v} license", _key)
        _add(f"{_name}:the", f"Licensed under the CC {_variant} {_v} license", _key)
        for _i, _long in enumerate(_longs):
            _key = f"creative commons {_long} {_words}".lower().replace("-", " ")
            _kind = {"4.0": " International", "3.0": " Unported"}.get(_v, " Generic")
            _add(f"{_name}:long{_i}", f"Licensed under a Creative Commons {_long} {_v}{_kind} License", _key)
            _add(f"{_name}:short{_i}", f"Licensed under Creative Commons {_long} {_v}", _key)
            _add(f"{_name}:plain{_i}", f"Licensed under the Creative Commons {_long} {_v} License", _key)
            if _v == "4.0":
                _add(f"{_name}:heading{_i}", f"Creative Commons {_long} 4.0 International Public License", _key)
_add("CC0-1.0:waiver", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights")
_lead("CC0-1.0:notice", "CC0 1.0", "cc0 1 0")
_lead("CC0-1.0:universal", "CC0 1.0 Universal", "cc0 1 0 universal")

# Apache, Mozilla, Eclipse, Boost, GFDL: versions
for _v in ("1.0", "1.1", "2.0"):
    _words = _v.replace(".", " ")
    _add("Apache-2.0" if _v == "2.0" else f"Apache-{_v}:notice", f"Licensed under the Apache License, Version {_v}", "apache", _words)
    _lead(f"Apache-{_v}:license", f"the Apache License {_v}", f"apache license {_words}")
    _lead(f"Apache-{_v}:short", f"the Apache {_v} license", f"apache {_words}")
_add("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license", "2 0")
for _v in ("1.0", "1.1"):
    _add(f"MPL-{_v}:notice", f'The contents of this file are subject to the Mozilla Public License Version {_v} (the "License"); you may not use this file except in compliance with the License', f"mozilla public license version {_v.replace('.', ' ')}")
for _v in ("1.0", "1.1", "2.0"):
    _lead(f"MPL-{_v}:short", f"the Mozilla Public License, version {_v}", "mozilla public license", f"version {_v.replace('.', ' ')}")
    _lead(f"MPL-{_v}:v", f"the Mozilla Public License {_v}", f"mozilla public license {_v.replace('.', ' ')}")
    if _v != "1.1":
        _add(f"EPL-{_v}:notice", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {'' if _v == '2.0' else 'v'}{_v}", f"eclipse public license {'' if _v == '2.0' else 'v'}{_v.replace('.', ' ')}")
        _lead(f"EPL-{_v}:short", f"the Eclipse Public License {_v}", f"eclipse public license {_v.replace('.', ' ')}")
        _lead(f"EPL-{_v}:v", f"the Eclipse Public License v{_v}", f"eclipse public license v{_v.replace('.', ' ')}")
for _v in ("1.1", "1.2", "1.3"):
    _add(f"GFDL-{_v}:notice", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {_v}", "gnu free documentation license", f"version {_v.replace('.', ' ')}")
_lead("BSL-1.0:notice", "the Boost Software License, Version 1.0", "boost software license")
_add("OFL-1.1:notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "open font license version 1 1")

# licenses without versions
_add("MIT", "Released under the MIT License", "mit license", "!mit license 0")
_lead("MIT:short", "MIT license", "mit license", "!mit license 0")
for _i, _c in (("2", "Simplified"), ("3", "New"), ("3", "Revised"), ("4", "Original")):
    _lead(f"BSD-{_i}-Clause:{_c.lower()}", f"the {_c} BSD License", f"{_c.lower()} bsd license")
    _lead(f"BSD-{_i}-Clause:bsd-clause", f"the BSD {_i}-Clause License", f"bsd {_i} clause")
    _lead(f"BSD-{_i}-Clause:clause-bsd", f"the {_i}-Clause BSD License", f"{_i} clause bsd")
_lead("ISC:notice", "the ISC License", "isc license")
_lead("Zlib:notice", "the zlib License", "zlib license")
_lead("Unlicense:notice", "the Unlicense", "unlicense")
_add("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain")

# what SPDX asks for in source files
for _name in sorted({n.partition(":")[0] for n in TEMPLATES}):
    _key = f"identifier {_name}".lower().replace("-", " ").replace(".", " ")
    _add(f"{_name}:spdx", f"SPDX-License-Identifier: {_name}", _key, *([f"!{_key} 0"] if _name == "MIT" else []))
