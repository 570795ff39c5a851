"""Licence templates. Short notices as people write them, and the wording of public licences.

Long licences stand here with a passage that no other licence has, so a text that holds the whole
licence or only that part is found. Creative Commons licences have a short form, a long form and an
address per version; ``cc-nc-*`` are non-commercial notices of any version, or without one. Where
licences differ in few words, a template is so short that a text of the other one holds too little of it.
"""

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""

_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""

_NAMES = {
    "by": ("Attribution",),
    "by-sa": ("Attribution-ShareAlike", "Attribution-Share Alike"),
    "by-nc": ("Attribution-NonCommercial", "Attribution-Non-Commercial"),
    "by-nd": ("Attribution-NoDerivatives", "Attribution-NoDerivs"),
    "by-nc-sa": ("Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-Share Alike"),
    "by-nc-nd": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"),
}


def _creative_commons() -> dict[str, str]:
    found = {
        "cc0-1.0-short": "CC0 1.0",
        "cc0-1.0-long": "CC0 1.0 Universal Public Domain Dedication",
        "cc0-1.0-address": "creativecommons.org/publicdomain/zero/1.0/",
        "cc-nc-short": "CC BY-NC",
        "cc-nc-long": "Creative Commons Attribution-NonCommercial",
        "cc-nc-long-2": "Creative Commons Attribution-Non-Commercial",
    }
    for kind, names in _NAMES.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            found[f"cc-{kind}-{version}-short"] = f"CC {kind.upper()} {version}"
            found[f"cc-{kind}-{version}-address"] = f"creativecommons.org/licenses/{kind}/{version}/"
            for k, name in enumerate(names):
                found[f"cc-{kind}-{version}-long{f'-{k + 1}' if k else ''}"] = f"Creative Commons {name} {version}"
    return found


TEMPLATES = {
    **_creative_commons(),
    "agpl-header": "GNU Affero General Public License as published",
    "agpl-notice": "licensed under the GNU Affero General Public License",
    "agpl-3.0-section-13": """if you modify the Program, your modified version must prominently offer all users interacting
with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the
Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge,
through some standard or customary means of facilitating copying of software.""",
    "apache-2.0-section-2": """Subject to the terms and conditions of this License, each Contributor hereby grants to You a
perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare
Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in
Source or Object form.""",
    "artistic-2.0-notice": "licensed under the Artistic License 2.0",
    "bsd-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.""",
    "bsd-notice": "licensed under the BSD License",
    "bsd-2-clause-notice": "BSD 2-Clause License",
    "bsd-3-clause-notice": "BSD 3-Clause License",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "epl-notice": "under the terms of the Eclipse Public License",
    "eupl-notice": "Licensed under the European Union Public Licence",
    "gpl-2.0-notice": "GNU General Public License, version 2",
    "gpl-or-lgpl-2.0-header": "Free Software Foundation; either version 2 of the License",
    "gpl-1.0-or-2.0-section-0": """This License applies to any program or other work which contains a notice placed by the copyright
holder saying it may be distributed under the terms of this General Public License.""",
    "gpl-3.0-preamble": """The GNU General Public License is a free, copyleft license for software and other kinds of works.
The licenses for most software and other practical works are designed to take away your freedom to share and change the
works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions
of a program--to make sure it remains free software for all its users.""",
    "gpl-2-short": "licensed under the GPLv2",
    "gpl-3-short": "licensed under the GPLv3",
    "isc-notice": "Licensed under the ISC License.",
    "lgpl-2.0-title": "GNU Library General Public License",
    "lgpl-header": "GNU Lesser General Public License as published",
    "lgpl-notice": "licensed under the GNU Lesser General Public License",
    "lgpl-3.0-section": """This version of the GNU Lesser General Public License incorporates the terms and conditions of version
3 of the GNU General Public License, supplemented by the additional permissions listed below.""",
    "mit-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mpl-2.0-notice": "licensed under the Mozilla Public License",
    "non-commercial-notice": "for non-commercial use only",
    "non-commercial-notice-2": "for noncommercial use only",
    "public-domain-notice": "released into the public domain",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely""",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "bsd-clauses": _BSD_TWO,
    "bsd-third-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-grant": _GRANT,
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
}
