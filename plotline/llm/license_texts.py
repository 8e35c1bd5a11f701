"""Default wordings of the license scan, by SPDX name.

Braces mark naming words, which must be in a text as they are; ``^`` and ``$`` enclose a heading, which has its line for
itself; a word after ``~`` is not part of the wording and must not be among the words added to it.
"""

from __future__ import annotations

_MIT_GRANT = (
    '{Permission is hereby granted, free of charge, to any person obtaining a copy} of this software and associated documentation '
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
    'Software is furnished to do so'
)
_MIT_NOTICE = (
    ', {subject to the following conditions}: {The above copyright notice and this permission notice} shall be included in all '
    'copies or substantial portions of the Software. '
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR '
    'COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, '
    'ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_X11 = (
    ' {Except as contained in this notice, the name of} the copyright holders shall not be used in advertising or otherwise to '
    'promote the sale, use or other dealings in this Software without prior written authorization from the copyright holders.'
)
_BSD_HEAD = (
    '{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following '
    'conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the '
    'following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions '
    'and the following disclaimer in the documentation and/or other materials provided with the distribution. '
)
_BSD_ADS = (
    '3. {All advertising materials mentioning features or use of this software must display} the following acknowledgement: This '
    'product includes software developed by the organization. '
)
_BSD_NAMES = (
    'Neither the name of the copyright holder nor the names of its contributors {may be used to endorse or promote products} '
    'derived from this software without specific prior written permission. ',
    'The name of the author {may not be used to endorse or promote products} derived from this software without specific prior '
    'written permission. ',
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    'BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT '
    'SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR '
    'CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR '
    'PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR '
    'TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE '
    'POSSIBILITY OF SUCH DAMAGE.'
)
_ISC_GRANT = '{Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted}'
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    'WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR '
    'CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, '
    'NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
_APACHE_END = (
    ' (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed '
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    'See the License for the specific language governing permissions and limitations under the License.'
)

# Texts, headers, headings and notices that are no combination of a customary beginning and a name.
_FIXED: dict[str, list[str]] = {
    "0BSD": [_ISC_GRANT + "." + _ISC_END + " ~provided ~retain"],
    "Apache-1.1": ["^{The Apache Software License, Version 1.1}$"],
    "Apache-2.0": [
        "Licensed under the {Apache License, Version 2.0}" + _APACHE_END,
        'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the {Apache License, Version 2.0}' + _APACHE_END,
        "{Apache License Version 2.0, January 2004}",
        "^{Apache License 2.0}$", "^{Apache License, Version 2.0}$",
    ],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_END + " ~endorse ~advertising", "^{BSD 2-Clause License}$", "^{Simplified BSD License}$"],
    "BSD-3-Clause": [
        *(_BSD_HEAD + n + _BSD_END + " ~advertising" for n in _BSD_NAMES),
        "Released under the {BSD 3-Clause License}. Redistribution and use in source and binary forms are permitted.",
        "^{BSD 3-Clause License}$", "^{New BSD License}$",
    ],
    "BSD-4-Clause": [_BSD_HEAD + _BSD_ADS + n + _BSD_END for n in _BSD_NAMES],
    "CC-BY-4.0": ["This work is licensed under a {Creative Commons Attribution 4.0 International License}. Licensed under {CC BY 4.0}."],
    "CC0-1.0": ["^{CC0 1.0 Universal}$", "{Creative Commons Legal Code CC0 1.0 Universal}", "This work is dedicated to the public domain under {CC0 1.0}."],
    "ISC": [_ISC_GRANT + ", {provided that the above copyright notice and this permission notice appear in all copies}." + _ISC_END, "^{ISC License}$"],
    "JSON": [_MIT_GRANT + _MIT_NOTICE + "{The Software shall be used for Good, not Evil}. " + _MIT_END],
    "MIT": [
        _MIT_GRANT + _MIT_NOTICE + _MIT_END + " ~evil ~advertising",
        _MIT_GRANT + ", {subject to the following conditions} ~evil",
        "^{MIT License}$", "^{The MIT License}$", "^{The MIT License (MIT)}$",
    ],
    "MIT-0": [_MIT_GRANT + ". " + _MIT_END + " ~conditions", "^{MIT No Attribution}$"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}.",
        "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "^{Mozilla Public License Version 2.0}$",
    ],
    "Proprietary": ["{All rights reserved}."],
    "Unlicense": [
        "{This is free and unencumbered software released into the public domain}.",
        "{This is free and unencumbered software released into the public domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "X11": [_MIT_GRANT + _MIT_NOTICE + _MIT_END + _X11],
    "Zlib": [
        "{This software is provided 'as-is', without any express or implied warranty}. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. {The origin of this software must not be misrepresented}; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "^{zlib License}$",
    ],
}

# Names that a short notice gives a license.
_NAMES: dict[str, list[str]] = {
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache License v2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause License", "New BSD License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "ISC": ["ISC License"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL 2.0"],
    "Zlib": ["zlib License"],
}
_LEADS = ("Licensed under the", "Released under the", "Distributed under the")
_SHORT_LEADS = (*_LEADS, "Licensed under", "Released under", "Distributed under")

_LATER = ("or (at your option) any later version", "or any later version", "or later")
# Family, its words, its subject in headers, and per version the dates of its text's title.
_GNU = (
    ("GPL", "GNU General Public License", "program", {"2": "June 1991", "3": "29 June 2007"}),
    ("LGPL", "GNU Lesser General Public License", "library", {"2.1": "February 1999", "3": "29 June 2007"}),
    ("AGPL", "GNU Affero General Public License", "program", {"3": "19 November 2007"}),
)
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _gnu(out: dict[str, list[str]]) -> None:
    for short, words, subject, versions in _GNU:
        for v, date in versions.items():
            name = f"{short}-{v if '.' in v else v + '.0'}"
            forms = [f"{words}, version {v}", f"{words} v{v}", f"{short} version {v}", f"{short} v{v}", f"{short}v{v}"]
            if "." not in v:
                forms += [f"{words} v{v}.0", f"{words} version {v}.0", f"{short} v{v}.0"]
            own, later = out.setdefault(name, []), out.setdefault(f"{name}-or-later", [])
            own.append(f"{{{words} Version {v}, {date}}}")
            for form in forms:
                leads = ("This work is licensed under the", *_LEADS) if len(form.split()) > 1 else _SHORT_LEADS
                own += [f"{lead} {{{form}}} ~later" for lead in leads]
                later += [f"{lead} {{{form} {tail}}}" for lead in leads for tail in _LATER[1:]]
            later += [f"This work is licensed under the {{{words}, version {v}, {_LATER[0]}}}"]
            for thing in dict.fromkeys((subject, "program", "file")):
                head = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {{{words}}} as published by the Free Software Foundation, "
                end = (
                    f" This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                    f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {words} for more details. You should have "
                    f"received a copy of the {words} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
                )
                for tail in _LATER[:2]:
                    later += [f"{head}either {{version {v} of the License, {tail}}}.", f"{head}either {{version {v} of the License, {tail}}}.{end}"]
                own += [f"{head}{{version {v} of the License}}. ~later", f"{head}{{version {v} of the License}}.{end} ~later"]


def _creative_commons(out: dict[str, list[str]]) -> None:
    for short, words in _CC.items():
        for v, port in (("3.0", "Unported"), ("4.0", "International")):
            own = out.setdefault(f"CC-{short}-{v}", [])
            full = f"Creative Commons {words} {v} {port}"
            own += [f"Licensed under {{CC {short} {v}}}.", f"Released under {{CC {short} {v}}}.", f"Licensed under {{CC-{short}-{v}}}."]
            own += [f"This work is licensed under a {{{full} License}}.", f"Licensed under the {{{full}}}.", f"{{{full} Public License}}"]


def _default() -> dict[str, tuple[str, ...]]:
    out = {name: list(texts) for name, texts in _FIXED.items()}
    for name, forms in _NAMES.items():
        own = out.setdefault(name, [])
        for form in forms:
            own += [f"{lead} {{{form}}}." for lead in (_LEADS if len(form.split()) > 1 else _SHORT_LEADS)]
    _gnu(out)
    _creative_commons(out)
    return {name: tuple(dict.fromkeys(texts)) for name, texts in sorted(out.items())}


TEMPLATES = _default()
