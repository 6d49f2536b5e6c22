"""Wordings of public licences: (label, kind, wording) rows for `licenses.scan`.

Words are lower case, without punctuation.  `{a|b|}` stands for each of its alternatives.  A `notice` is the
distinguishing part of a short wording and must stand in the text word for word; whatever surrounds it is free.  A
`passage` is a piece of a licence body or of a long header and may be edited; words in `[ ]` must stand as they are,
where another licence uses the same sentence.  Long bodies are given by their heading and by passages that no other
licence has, short ones by all their characteristic paragraphs, so a cut or partly edited body is still found.
"""
from __future__ import annotations

import re
from itertools import product

_LICENSE = "{license|licence}"
_NC, _SA, _ND = "{noncommercial|non commercial}", "{sharealike|share alike}", "{noderivatives|noderivs|no derivatives|no derivs}"
_V = "{| version| v| ver}"
_CC = "creative commons {attribution|namensnennung|reconocimiento}"

TABLE: list[tuple[str, str, str]] = [
    # Apache
    ("apache-2.0", "notice", f"apache {{|software }}{_LICENSE}{_V} 2"),
    ("apache-2.0", "notice", f"apache {{|software }}{_LICENSE} v2"),
    ("apache-2.0", "notice", "{apache 2 0 license|apache 2 license|apache2 license|apache v2 license|apache lizenz|licence apache|licencia apache|licensed under apache 2|under apache 2 0|asl 2 0}"),
    ("apache-2.0", "notice", "license identifier apache 2"),
    ("apache-2.0", "notice", "apache org licenses license 2 0"),
    ("apache", "notice", f"apache {{|software |public }}{_LICENSE}"),
    ("apache-2.0", "passage", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www [apache org licenses]"),
    ("apache-2.0", "passage", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-2.0", "passage", "if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy of the attribution notices contained within such notice file"),
    # MIT, ISC, zlib, Boost, public domain dedications
    ("mit", "notice", f"mit {_LICENSE}"),
    ("mit", "notice", f"mit x11 {_LICENSE}"),
    ("mit", "notice", "{licence mit|licencia mit|license identifier mit|licensed mit|licensed under mit|released under mit|distributed under mit|mit licensed|license type mit}"),
    ("mit", "passage", "permission is hereby granted free of charge to any person obtaining a copy of this [software and associated documentation files]"),
    ("mit", "passage", "to deal in the [software without restriction] including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "passage", "the above copyright notice and this permission notice shall be included in [all copies or substantial portions of the software]"),
    ("isc", "notice", f"isc {_LICENSE}"),
    ("isc", "notice", "{license identifier isc|licensed under isc|under the isc}"),
    ("isc", "passage", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [provided that the above copyright notice] and this permission notice appear in all copies"),
    ("0bsd", "notice", "{license identifier 0bsd|zero clause bsd|0 clause bsd|0bsd license}"),
    ("zlib", "notice", f"zlib {{|libpng }}{_LICENSE}"),
    ("zlib", "notice", "license identifier zlib"),
    ("zlib", "passage", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "passage", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", "notice", f"boost software {_LICENSE}"),
    ("bsl-1.0", "notice", "license identifier bsl 1 0"),
    ("bsl-1.0", "passage", "obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("unlicense", "notice", "{the unlicense|license identifier unlicense|unlicense org}"),
    ("unlicense", "passage", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "notice", "{do what the fuck you want|license identifier wtfpl|under the wtfpl|wtfpl license}"),
    # BSD
    ("bsd", "notice", f"bsd {_LICENSE}"),
    ("bsd", "notice", "{bsd style license|bsd licensed|licencia bsd|licence bsd|bsd lizenz|under the bsd}"),
    ("bsd-2-clause", "notice", "{bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd license|freebsd license}"),
    ("bsd-3-clause", "notice", "{bsd 3 clause|3 clause bsd|three clause bsd|new bsd license|modified bsd license|revised bsd license}"),
    ("bsd-4-clause", "notice", "{bsd 4 clause|4 clause bsd|original bsd license}"),
    ("bsd", "passage", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "passage", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "passage", "[nor the names of its contributors] may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "passage", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    # GNU
    ("gpl", "notice", f"gnu general public {_LICENSE}"),
    ("gpl", "notice", "{gnu gpl|under the gpl|gpl license|gpl licence|licence gpl|licencia gpl|gpl lizenz|licensed under gpl|licence publique generale gnu|licence publique générale gnu|licencia pública general de gnu}"),
    ("gpl-2.0", "notice", f"general public {_LICENSE}{_V} 2"),
    ("gpl-2.0", "notice", f"general public {_LICENSE} v2"),
    ("gpl-2.0", "notice", "{gnu gpl v2|gnu gpl version 2|gnu gpl 2|license identifier gpl 2|gpl version 2|gpl v2|gpl 2 0|gplv2 license|gnu gplv2|the gplv2|under gplv2}"),
    ("gpl-2.0", "notice", f"general public {_LICENSE} as published by the free software foundation {{either |}}version 2"),
    ("gpl-3.0", "notice", f"general public {_LICENSE}{_V} 3"),
    ("gpl-3.0", "notice", f"general public {_LICENSE} v3"),
    ("gpl-3.0", "notice", "{gnu gpl v3|gnu gpl version 3|gnu gpl 3|license identifier gpl 3|gpl version 3|gpl v3|gpl 3 0|gplv3 license|gnu gplv3|the gplv3|under gplv3}"),
    ("gpl-3.0", "notice", f"general public {_LICENSE} as published by the free software foundation {{either |}}version 3"),
    ("gpl", "passage", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license]"),
    ("gpl-2.0", "passage", "the licenses for most software are designed to take away your freedom to share and change it by contrast the [gnu general public license is] intended to guarantee your freedom to share and change free software"),
    ("gpl-2.0", "passage", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program or any part thereof to be licensed as a whole at no charge to all third parties under the terms of this license"),
    ("gpl-3.0", "passage", "the [gnu general public license is a free copyleft license] for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl", "notice", f"gnu {{lesser|library}} general public {_LICENSE}"),
    ("lgpl", "notice", "{gnu lgpl|under the lgpl|lgpl license|licence lgpl|licencia lgpl|licensed under lgpl}"),
    ("lgpl-2.1", "notice", f"{{lesser|library}} general public {_LICENSE}{_V} 2"),
    ("lgpl-2.1", "notice", f"{{lesser|library}} general public {_LICENSE} as published by the free software foundation {{either |}}version 2"),
    ("lgpl-2.1", "notice", "{license identifier lgpl 2|gnu lgpl v2|lgpl version 2|lgpl v2|lgpl 2 1|the lgplv2|gnu lgplv2}"),
    ("lgpl-3.0", "notice", f"lesser general public {_LICENSE}{_V} 3"),
    ("lgpl-3.0", "notice", f"lesser general public {_LICENSE} as published by the free software foundation {{either |}}version 3"),
    ("lgpl-3.0", "notice", "{license identifier lgpl 3|gnu lgpl v3|lgpl version 3|lgpl v3|lgpl 3 0|the lgplv3|gnu lgplv3}"),
    ("lgpl", "passage", "you can redistribute it and or modify it under the terms of the [gnu lesser general public license]"),
    ("lgpl-2.1", "passage", "this license the [lesser general public license] applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it"),
    ("lgpl-3.0", "passage", "this version of the [gnu lesser general public license] incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("agpl-3.0", "notice", f"{{gnu affero|affero}} general public {_LICENSE}"),
    ("agpl-3.0", "notice", "{gnu agpl|under the agpl|agpl license|agpl v3|agpl 3 0|license identifier agpl 3|gnu agplv3|the agplv3|licensed under agpl}"),
    ("agpl-3.0", "passage", "is a free copyleft license for software and other kinds of works [specifically designed to ensure cooperation] with the community in the case of network server software"),
    ("gfdl", "notice", f"{{gnu free|free}} documentation {_LICENSE}"),
    ("gfdl", "notice", "{gnu fdl|license identifier gfdl}"),
    ("gfdl", "passage", "permission is granted to copy distribute and or modify this document under the terms of the [gnu free documentation license]"),
    # Mozilla, Eclipse, Artistic, European Union
    ("mpl", "notice", f"mozilla public {_LICENSE}"),
    ("mpl-2.0", "notice", f"mozilla public {_LICENSE}{_V} 2"),
    ("mpl-2.0", "notice", "{license identifier mpl 2|mpl 2 0|mpl version 2|mpl v2}"),
    ("mpl-2.0", "passage", "this source code form is subject to the terms of the [mozilla public license v 2 0] if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "passage", "under intellectual property rights other than patent or trademark licensable by such contributor to use reproduce make available modify display perform distribute and otherwise exploit its contributions"),
    ("mpl-1.1", "notice", f"mozilla public {_LICENSE}{_V} 1"),
    ("mpl-1.1", "notice", "{license identifier mpl 1|mpl 1 1}"),
    ("epl", "notice", f"eclipse public {_LICENSE}"),
    ("epl-1.0", "notice", f"eclipse public {_LICENSE}{_V} 1"),
    ("epl-2.0", "notice", f"eclipse public {_LICENSE}{_V} 2"),
    ("epl-1.0", "notice", "{license identifier epl 1|epl 1 0|epl v1}"),
    ("epl-2.0", "notice", "{license identifier epl 2|epl 2 0|epl v2}"),
    ("epl", "passage", "the accompanying program is provided under the terms of this [eclipse public license] agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("artistic", "notice", f"artistic {_LICENSE}"),
    ("artistic-2.0", "notice", f"artistic {_LICENSE}{_V} 2"),
    ("artistic-2.0", "notice", "license identifier artistic 2"),
    ("artistic", "passage", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("eupl", "notice", f"european union public {_LICENSE}"),
    ("eupl", "notice", "{license identifier eupl 1|under the eupl|eupl v1}"),
    # Creative Commons
    ("cc0", "notice", "{cc0 1 0|cc0 license|cc0 universal|under cc0|license identifier cc0 1|creative commons zero|creative commons cc0|publicdomain zero 1|cc zero}"),
    ("cc0", "passage", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights and associated claims and causes of action"),
    ("cc-by", "notice", f"{_CC}"),
    ("cc-by", "notice", "{creative commons by|licenses by 4|licenses by 3}"),
    ("cc-by-sa", "notice", f"{_CC} {_SA}"),
    ("cc-by-sa", "notice", "{cc by sa|creative commons by sa|licenses by sa}"),
    ("cc-by-nd", "notice", f"{_CC} {_ND}"),
    ("cc-by-nd", "notice", "{cc by nd|creative commons by nd|licenses by nd}"),
    ("cc-by-nc", "notice", f"{_CC} {_NC}"),
    ("cc-by-nc", "notice", "{cc by nc|creative commons by nc|licenses by nc}"),
    ("cc-by-nc-sa", "notice", f"{_CC} {_NC} {_SA}"),
    ("cc-by-nc-sa", "notice", "{cc by nc sa|creative commons by nc sa|licenses by nc sa}"),
    ("cc-by-nc-nd", "notice", f"{_CC} {_NC} {_ND}"),
    ("cc-by-nc-nd", "notice", "{cc by nc nd|creative commons by nc nd|licenses by nc nd}"),
]


def wordings(table: list[tuple[str, str, str]] = TABLE) -> dict[str, str]:
    """Every wording with its label; words that must stand as they are keep their brackets."""
    out = {}
    for label, kind, wording in table:
        for choice in product(*[part[1:-1].split("|") if part.startswith("{") else [part] for part in re.split(r"(\{[^}]*\})", wording)]):
            phrase = " ".join("".join(choice).split())
            out[f"[{phrase}]" if kind == "notice" else phrase] = label
    return out
