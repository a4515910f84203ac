"""Licence names, sentences and rules that the scan knows."""

from __future__ import annotations

import re

# Identifier, category, and the names that notices give, normalised.
LICENCES = [
    ("MIT", "permissive", ["mit"]),
    ("ISC", "permissive", ["isc"]),
    ("BSD-2-Clause", "permissive", ["bsd 2 clause", "2 clause bsd", "simplified bsd"]),
    ("BSD-3-Clause", "permissive", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"]),
    ("Apache-2.0", "permissive", ["apache 2 0", "apache license version 2 0", "apache license 2 0", "apache version 2 0"]),
    ("Unlicense", "public-domain", ["unlicense"]),
    ("CC0-1.0", "public-domain", ["cc0 1 0", "cc0", "creative commons zero", "creative commons cc0 1 0 universal"]),
    ("CC-BY-4.0", "permissive", ["cc by 4 0", "creative commons attribution 4 0 international", "creative commons attribution 4 0"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0"]),
    ("CC-BY-NC-4.0", "restricted", ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial 4 0"]),
    ("CC-BY-ND-4.0", "restricted", ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"]),
    ("MPL-2.0", "copyleft", ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"]),
    ("GPL-2.0", "copyleft", ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl v2", "gplv2", "gpl 2 0"]),
    ("GPL-3.0", "copyleft", ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl v3", "gplv3", "gpl 3 0"]),
    ("LGPL-2.1", "copyleft", ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"]),
    ("LGPL-3.0", "copyleft", ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgpl v3", "lgplv3", "lgpl 3 0"]),
    ("AGPL-3.0", "copyleft", ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl v3", "agplv3", "agpl 3 0"]),
    ("Zlib", "permissive", ["zlib"]),
    ("BSL-1.0", "permissive", ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"]),
    ("EPL-1.0", "copyleft", ["eclipse public license version 1 0", "eclipse public license v 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0"]),
    ("EPL-2.0", "copyleft", ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"]),
    ("Artistic-2.0", "permissive", ["artistic license version 2 0", "artistic license 2 0", "artistic 2 0"]),
    ("LicenseRef-Proprietary", "restricted", []),
]

# How notices begin.
NOTICES = ["licensed under", "released under", "distributed under", "available under", "licensed under the terms of", "released under the terms of", "distributed under the terms of", "made available under the terms of"]
SUBJECTS = ["this work is", "this program is", "this software is", "this project is", "this file is", "this document is", "this text is", "this code is", "this program and the accompanying materials are"]

# Sentences of licence texts, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "reserved": "All rights reserved.",
}

# Normalised sentences that name an owner, in at most OWNER words.
OWNER = 16
OWNED = {"bsd-endorse": r"neither the name(?:s)? of {owner} nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission"}

# Rules in the order that they are tried: licence, and identifiers in a row.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-grant", "apache-copy"]),
    ("GPL-3.0", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-2.0", ["gpl2-grant", "gpl-warranty"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-grant"]),
    ("GPL-3.0", ["gpl3-grant"]),
    ("GPL-2.0", ["gpl2-grant"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("AGPL-3.0", ["agpl3-grant"]),
    ("LGPL-3.0", ["lgpl3-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("EPL-1.0", ["epl1-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("LGPL-2.1", ["lgpl21-grant", "lgpl-warranty"]),
    ("LGPL-2.1", ["lgpl21-grant"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("Apache-2.0", ["apache-title"]),
    ("Apache-2.0", ["apache-terms"]),
    ("MPL-2.0", ["mpl-title"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("LicenseRef-Proprietary", ["reserved"]),
]

CATEGORY = {name: category for name, category, _ in LICENCES}


def normal(text: str) -> str:
    """Lower case, runs of what is no ASCII letter or digit as one space."""
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).strip()


def sentence_table() -> dict[bytes, str]:
    """Normalised sentence to identifier: those listed, and every notice of every name."""
    table = {normal(text).encode(): name for name, text in SENTENCES.items()}
    for name, _, titles in LICENCES:
        table[f"spdx license identifier {normal(name)}".encode()] = f"notice:{name}"
        for title in titles:
            named = {title, f"{title} license", f"{title} licence", title.replace("license", "licence")}
            named |= {f"{t} or later" for t in named} | {f"{t} or any later version" for t in named}
            for t in named | {f"the {t}" for t in named}:
                for notice in NOTICES:
                    for subject in ["", *(f"{s} " for s in SUBJECTS)]:
                        table[f"{subject}{notice} {t}".encode()] = f"notice:{name}"
    return table


def owned() -> list[tuple[str, re.Pattern[bytes]]]:
    """Identifiers and patterns of the sentences that name an owner."""
    owner = rf"[0-9a-z]+(?: [0-9a-z]+){{0,{OWNER - 1}}}?"
    return [(name, re.compile(p.replace("{owner}", owner).encode())) for name, p in OWNED.items()]


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """RULES, then each notice alone."""
    return [(name, tuple(ids)) for name, ids in RULES] + [(name, (f"notice:{name}",)) for name, _, _ in LICENCES]
