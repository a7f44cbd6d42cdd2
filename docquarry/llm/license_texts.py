"""Templates of the license scan: the short notices, and headers, permission texts and wordings of the same licenses.

"Only" and "or any later version" come under the version they name. Copyright lines are not part of a template.
"""

from __future__ import annotations

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_BEGIN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_THIRD = f"3. Neither the name of the copyright holder {_BSD_NAMES}"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str) -> list[str]:
    """The GNU header: the grant, with and without later versions."""
    begin = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
    warranty = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    later = f"either version {version} of the License, or (at your option) any later version."
    return [f"{begin}, {later}", f"{begin}, {later} {warranty}", f"{begin}, version {version} of the License."]


TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", f"{_BSD_BEGIN} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_BEGIN} {_BSD_THIRD} {_BSD_END}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TEXTS += [(f"{short}-{v}", t) for short, name, versions in [("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))] for v in versions for t in _gnu(name, v.removesuffix(".0"))]

# Wordings around a name: "under the" and the name, with a verb where that is less than five words.
_NAMES = [
    ("Apache-2.0", ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"]),
    ("MPL-2.0", ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"]),
    *[(f"{short}-{v}", [f"GNU {name}, version {n}", f"GNU {name} v{v}", f"GNU {name} v{n}"]) for short, name, versions in [("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",))] for v in versions for n in [v.removesuffix(".0")]],
]
WORDINGS = [(i, f"{verb} under the {name} License") for i, name in [("MIT", "MIT"), ("ISC", "ISC")] for verb in ("Licensed", "Distributed", "Published", "Available", "Provided")]
WORDINGS += [(i, f"under the terms of the {name} License") for i, name in [("MIT", "MIT"), ("ISC", "ISC")]]
WORDINGS += [(i, f"under the {name}") for i, names in _NAMES for name in names]
WORDINGS += [(i, f"under the terms of the {name}") for i, names in _NAMES for name in names]
_CC = [("CC-BY", "Attribution"), ("CC-BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC", "Attribution-NonCommercial")]
WORDINGS += [(f"{i}-{v}", t) for i, name in _CC for v in ("2.0", "2.5", "3.0", "4.0") for t in [f"under {i.replace('-', ' ', 1)} {v}", f"Creative Commons {name} {v}"]]
WORDINGS += [("CC0-1.0", "under the CC0 1.0 Universal"), ("CC0-1.0", "under CC0 1.0 Universal"), ("Unlicense", "released into the public domain under the Unlicense")]
WORDINGS = list(dict.fromkeys(WORDINGS))
