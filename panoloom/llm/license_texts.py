"""License notices to look for. Public texts, words as their authors publish them.

``TEMPLATES`` are pairs of license and text; licenses of one family differ in few words, which ``KEYS`` and ``BARRED`` name.
"""

from itertools import product

_FIRST = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
                     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution."),
)

#: Licenses that are told by name in one sentence.
_NAMED = (
    ("Apache-1.1", "Apache License, Version 1.1"), ("Apache-1.0", "Apache License, Version 1.0"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("MPL-1.1", "Mozilla Public License, Version 1.1"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0"), ("EPL-1.0", "Eclipse Public License, Version 1.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"), ("Artistic-2.0", "Artistic License, Version 2.0"),
    ("CDDL-1.0", "Common Development and Distribution License, Version 1.0"), ("EUPL-1.2", "European Union Public Licence, Version 1.2"),
    ("ISC", "ISC License"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-4-Clause", "BSD 4-Clause License"),
)

_BSD = _FIRST[8][1]
_ENDORSE = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
            "from this software without specific prior written permission.")
_MIT = _FIRST[3][1]
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

_TEXTS = (
    ("BSD-3-Clause", f"{_BSD} {_ENDORSE}"),
    ("BSD-3-Clause", f"{_BSD} The name of the author may not be used to endorse or promote products derived from this software without "
                     "specific prior written permission."),
    ("BSD-4-Clause", f"{_BSD} All advertising materials mentioning features or use of this software must display the following "
                     f"acknowledgement: This product includes software developed by the organization. {_ENDORSE}"),
    ("MIT-0", _MIT[:_MIT.index(", subject to")] + ". The Software is provided \"as is\", without warranty of any kind."),
    ("ISC", f"{_FEE}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", f"{_FEE}. The software is provided \"as is\" and the author disclaims all warranties."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this "
                "file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
                "is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
             "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
                "and transmit the Software, and to prepare derivative works of the Software."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
              "allowed as long as the name is changed."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is licensed under a Creative Commons Zero 1.0 Universal License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *(("GFDL-" + v, "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
                    f"License, Version {v} or any later version published by the Free Software Foundation.") for v in ("1.1", "1.2", "1.3")),
)


def _gnu():
    """Short notices, headers with and without later versions, and both without a version."""
    for name, kind, v in (("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.0", "Lesser ", "2"),
                          ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
                          ("GPL", "", ""), ("LGPL", "Lesser ", ""), ("AGPL", "Affero ", "")):
        gnu = f"GNU {kind}General Public License"
        yield name, f"This work is licensed under the {gnu}{v and ', version ' + v}."
        for thing in ("program", "library"):
            head = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {gnu}"
            yield name, f"{head}{v and ' version ' + v} as published by the Free Software Foundation."
            if v:
                yield name, (f"{head} as published by the Free Software Foundation, either version {v} of the License, or (at your "
                             "option) any later version.")


def _cc():
    """All six kinds and five versions, in the spellings of their elements."""
    spelled = {"BY": ("Attribution",), "NC": ("NonCommercial", "Non-Commercial"), "SA": ("ShareAlike", "Share-Alike"),
               "ND": ("NoDerivatives", "NoDerivs", "No-Derivatives", "No Derivative Works")}
    for kind in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic")):
            yield f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}."
            for parts in product(*(spelled[k] for k in kind.split("-"))):
                yield f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {'-'.join(parts)} {v} {port} License."


_MORE = (*((n, f"{how} under the {t}.") for n, t in _NAMED for how in ("Licensed", "Released")), *_TEXTS, *_gnu(), *_cc())
TEMPLATES = (*_FIRST, *(t for t in _MORE if t not in _FIRST))

#: Words that a match must hold if its template does, by family ("" for all): names, elements and versions.
KEYS = {
    "": "apache mit isc zlib unlicense bsd mozilla mpl eclipse boost artistic cddl european cc0 zero 1 2 3 4 5".split(),
    "GPL LGPL AGPL": "general lesser affero".split(),
    "GFDL": ["documentation"],
    "CC": ("cc by nc sa nd attribution noncommercial non commercial sharealike share alike noderivatives noderivs no derivatives "
           "derivative").split(),
    "BSD": "endorse advertising".split(),
}
#: Words that tell licenses of a family apart: a match holds none that its template lacks.
BARRED = {
    "GPL LGPL AGPL": "lesser affero".split(),
    "CC": "nc sa nd noncommercial non commercial sharealike share alike noderivatives noderivs no derivatives derivative".split(),
    "BSD": "endorse advertising".split(),
}
