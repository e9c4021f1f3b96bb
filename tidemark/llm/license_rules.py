"""The ordered signature rules of the license scan, over words in lower case parted by one space.

Names of licences are families: a label, a keyword that every match of the name holds, the
name, its versions. A family gives the bare name, the name with each version, and either
within a licensing phrase. Tags are SPDX identifiers. Signatures are sentences that stand in
the texts and headers of licences, written out one by one. A higher priority is a more
specific form.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    keyword: str
    regex: str
    label: str
    priority: int


#: Versions are written with spaces: "2 0" stands for 2.0.
FAMILIES = [
    ("gpl", "gnu general public licen", "gnu general public licen[cs]e", ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gpl", "gpl", ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gplv", "gplv", ["1", "2", "3"]),
    ("lgpl", "lesser general public licen", "(?:gnu )?lesser general public licen[cs]e", ["2 1", "3", "3 0"]),
    ("lgpl", "library general public licen", "(?:gnu )?library general public licen[cs]e", ["2", "2 0"]),
    ("lgpl", "lgpl", "lgplv?", ["2", "2 1", "3", "3 0"]),
    ("agpl", "affero general public licen", "(?:gnu )?affero general public licen[cs]e", ["1", "3", "3 0"]),
    ("agpl", "agpl", "agplv?", ["1", "3", "3 0"]),
    ("gfdl", "gnu free documentation licen", "gnu free documentation licen[cs]e", ["1 1", "1 2", "1 3"]),
    ("apache", "apache licen", "apache licen[cs]e", ["1 0", "1 1", "2 0", "2"]),
    ("apache", "apache software licen", "apache software licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("mit", "mit licen", "mit licen[cs]e", []),
    ("mit", "expat licen", "expat licen[cs]e", []),
    ("bsd", "bsd", "bsd licen[cs]e", []),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)(?: licen[cs]e)?", []),
    ("bsd-3-clause", "bsd", "(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?", []),
    ("bsd-4-clause", "bsd", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?", []),
    ("bsd-0-clause", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", []),
    ("isc", "isc licen", "isc licen[cs]e", []),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", []),
    ("mpl", "mozilla public licen", "mozilla public licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", "mpl", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse public licen", "eclipse public licen[cs]e", ["1 0", "2 0"]),
    ("epl", "epl", "epl", ["1 0", "2 0"]),
    ("cpl", "common public licen", "common public licen[cs]e", ["1 0"]),
    ("ibmpl", "ibm public licen", "ibm public licen[cs]e", ["1 0"]),
    ("cddl", "common development and distribution licen", "common development and distribution licen[cs]e", ["1 0", "1 1"]),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"]),
    ("eupl", "european union public licen", "european union public licen[cs]e", ["1 0", "1 1", "1 2"]),
    ("eupl", "eupl", "eupl", ["1 0", "1 1", "1 2"]),
    ("cecill", "cecill", "cecill(?: licen[cs]e)?", ["1 0", "1 1", "2 0", "2 1"]),
    ("osl", "open software licen", "open software licen[cs]e", ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("afl", "academic free licen", "academic free licen[cs]e", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic licen", "artistic licen[cs]e", ["1 0", "2 0"]),
    ("apsl", "apple public source licen", "apple public source licen[cs]e", ["1 0", "1 1", "1 2", "2 0"]),
    ("bsl", "boost software licen", "boost software licen[cs]e", ["1 0"]),
    ("busl", "business source licen", "business source licen[cs]e", ["1 0", "1 1"]),
    ("sspl", "server side public licen", "server side public licen[cs]e", ["1"]),
    ("elastic", "elastic licen", "elastic licen[cs]e", ["1", "2", "2 0"]),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict) licen[cs]e", ["1 0 0"]),
    ("ms-pl", "microsoft public licen", "microsoft public licen[cs]e", []),
    ("ms-rl", "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e", []),
    ("psf", "python software foundation licen", "python software foundation licen[cs]e", ["2"]),
    ("php", "php licen", "php licen[cs]e", ["3 0", "3 01"]),
    ("ruby", "ruby licen", "ruby licen[cs]e", []),
    ("perl", "same terms as perl itself", "same terms as perl itself", []),
    ("ofl", "sil open font licen", "sil open font licen[cs]e", ["1 0", "1 1"]),
    ("lppl", "latex project public licen", "latex project public licen[cs]e", ["1 0", "1 1", "1 2", "1 3c"]),
    ("wtfpl", "wtfpl", "wtfpl", []),
    ("wtfpl", "what the fuck you want to public licen", "do what the fuck you want to public licen[cs]e", ["2"]),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("upl", "universal permissive licen", "universal permissive licen[cs]e", ["1 0"]),
    ("ncsa", "ncsa open source licen", "(?:university of illinois )?ncsa open source licen[cs]e", []),
    ("w3c", "w3c software", "w3c software (?:notice|licen[cs]e)", []),
    ("vim", "vim licen", "vim licen[cs]e", []),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", []),
    ("openssl", "openssl licen", "openssl licen[cs]e", []),
    ("beerware", "beerware", "beerware(?: licen[cs]e)?", []),
    ("mulan", "mulan permissive software licen", "mulan permissive software licen[cs]e", ["1", "2"]),
    ("odbl", "open database licen", "(?:odc )?open database licen[cs]e", ["1 0"]),
    ("odc-by", "open data commons attribution licen", "open data commons attribution licen[cs]e", ["1 0"]),
    ("pddl", "public domain dedication and licen", "public domain dedication and licen[cs]e", ["1 0"]),
    ("ogl", "open government licen", "open government licen[cs]e", ["1 0", "2 0", "3 0"]),
    ("cc0", "cc0", "cc0", ["1 0"]),
    ("cc0", "cc zero", "cc zero", ["1 0"]),
    ("public-domain", "public domain", "(?:released into|placed in|dedicated to|in) the public domain", []),
    ("proprietary", "all rights reserved", "all rights reserved", []),
    ("llama", "llama", "llama [0-9 ]*community licen[cs]e(?: agreement)?", []),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m| licen[cs]e)?", []),
]
#: Creative Commons: (suffix, long name), each with the short and the long form and each version.
CREATIVE_COMMONS = [
    ("", "attribution"),
    ("-sa", "attribution share ?alike"),
    ("-nc", "attribution non ?commercial"),
    ("-nd", "attribution no ?deriv(?:ative)?s?"),
    ("-nc-sa", "attribution non ?commercial share ?alike"),
    ("-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed) (?:under|by|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


def _family(label: str, keyword: str, name: str, versions: list[str]) -> list[Rule]:
    out = [Rule(keyword, name, label, 1), Rule(keyword, _GRANT + name, label, 3)]
    for v in versions:
        tagged = f"{label}-{v.replace(' ', '.')}"
        out += [Rule(keyword, f"{name} (?:(?:version|v) ?)?{v}(?: only| or later| international| unported)?", tagged, 4)]
        out += [Rule(keyword, f"{_GRANT}{name} (?:(?:version|v) ?)?{v}", tagged, 6)]
    return out


#: SPDX identifiers, a hyphen or point as a space, with the label of each where it is not the identifier itself.
TAGS = {
    "mit": "", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0", "bsd 2 clause": "", "bsd 3 clause": "", "bsd 4 clause": "", "0bsd": "bsd-0-clause", "isc": "", "zlib": "", "gpl 1 0": "gpl-1.0", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0",
    "lgpl 2 0": "lgpl-2.0", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3.0", "agpl 1 0": "agpl-1.0", "agpl 3 0": "agpl-3.0", "gfdl 1 1": "gfdl-1.1", "gfdl 1 2": "gfdl-1.2", "gfdl 1 3": "gfdl-1.3", "mpl 1 0": "mpl-1.0", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0",
    "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "cecill 2 1": "cecill-2.1", "osl 3 0": "osl-3.0", "afl 3 0": "afl-3.0", "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0",
    "bsl 1 0": "bsl-1.0", "busl 1 1": "busl-1.1", "sspl 1 0": "sspl-1", "elastic 2 0": "elastic-2.0", "ms pl": "ms-pl", "ms rl": "ms-rl", "psf 2 0": "psf-2", "python 2 0": "psf-2", "php 3 01": "php-3.01", "ofl 1 1": "ofl-1.1", "lppl 1 3c": "lppl-1.3c", "wtfpl": "", "unlicense": "",
    "upl 1 0": "upl-1.0", "ncsa": "", "vim": "", "postgresql": "", "openssl": "", "beerware": "", "mulanpsl 2 0": "mulan-2", "odbl 1 0": "odbl-1.0", "pddl 1 0": "pddl-1.0", "cc0 1 0": "cc0-1.0", "ruby": "", "w3c": "", "curl": "", "x11": "",
    "cc by 2 0": "cc-by-2.0", "cc by 3 0": "cc-by-3.0", "cc by 4 0": "cc-by-4.0", "cc by sa 3 0": "cc-by-sa-3.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nc 4 0": "cc-by-nc-4.0", "cc by nd 4 0": "cc-by-nd-4.0", "cc by nc sa 4 0": "cc-by-nc-sa-4.0", "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
}
#: Sentences of licence texts and headers: label, priority, words. An asterisk stands for up to eight words.
SIGNATURES = [
    ("mit", 5, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 5, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", 6, "except as contained in this notice the name of * shall not be used in advertising or otherwise to promote the sale"),
    ("bsd", 2, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 2, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 2, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 6, "neither the name of * nor the names of * contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 7, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-0-clause", 6, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", 6, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", 6, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("zlib", 6, "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 6, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("apache-2.0", 7, "you may not use this file except in compliance with the license"),
    ("apache-2.0", 7, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.1", 7, "this product includes software developed by the apache software foundation"),
    ("mpl-2.0", 8, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 8, "if a copy of the mpl was not distributed with this file you can obtain one"),
    ("mpl-1.1", 8, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", 8, "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", 8, "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("gpl", 6, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 6, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", 8, "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", 8, "either version 3 of the license or at your option any later version"),
    ("lgpl", 6, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", 6, "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", 7, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gnu", 2, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gfdl", 6, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("unlicense", 6, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 6, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 6, "you just do what the fuck you want to"),
    ("bsl-1.0", 7, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("artistic", 6, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 7, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms"),
    ("cc0", 6, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", 6, "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc-by", 4, "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", 5, "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", 5, "you may not use the material for commercial purposes"),
    ("cc-by-nd", 5, "if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl", 6, "this font software is licensed under the sil open font license"),
    ("ofl", 6, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("psf", 6, "psf is making python available to licensee on an as is basis"),
    ("openssl", 6, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", 6, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", 6, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("busl", 6, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", 6, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", 6, "you may not provide the software to third parties as a hosted or managed service"),
    ("curl", 6, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("beerware", 6, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cddl", 6, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("lppl", 6, "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("perl", 5, "this library is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("vim", 6, "there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", 6, "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("upl", 6, "the software and any and all copyrights and patent rights * hereby licensed by the licensor"),
    ("ms-pl", 6, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ruby", 6, "you may redistribute your version of the software in object code or binary form"),
    ("odbl", 6, "this * database is made available under the open database license"),
    ("eupl", 6, "licensed under the eupl"),
    ("proprietary", 3, "this software is the confidential and proprietary information of"),
    ("proprietary", 3, "unauthorized copying of this file via any medium is strictly prohibited"),
]


def _signature(label: str, priority: int, words: str) -> Rule:
    """The longest part without an asterisk is the keyword: every match holds it."""
    return Rule(max(words.split(" * "), key=len), words.replace(" *", "(?: [^ ]+){1,8}"), label, priority)


def _tag(name: str, label: str) -> Rule:
    return Rule("spdx", f"spdx licen[cs]e identifier {name}(?: only| or later)?", label or name.replace(" ", "-"), 9)


def rules() -> list[Rule]:
    """All rules, each bounded by spaces, in a fixed order."""
    out = [r for row in FAMILIES for r in _family(*row)] + [_tag(*t) for t in TAGS.items()] + [_signature(*x) for x in SIGNATURES]
    for suffix, long in CREATIVE_COMMONS:
        out += _family(f"cc-by{suffix}", "cc by", f"cc by{suffix.replace('-', ' ')}", CC_VERSIONS)
        out += _family(f"cc-by{suffix}", "creative commons", f"creative commons {long}", CC_VERSIONS)
    # Neighbouring matches may share a space, so the bounds are looked at, not eaten.
    return [r._replace(regex=f"(?<= ){r.regex}(?= )") for r in out]
