"""Known licence texts and one-line notices. These are the public texts themselves."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""

_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

_CREATIVE = ["CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC0 1.0"]
_GNU = [(f"GNU {kind}General Public License", f"{short}GPL") for kind, short in (("", ""), ("Lesser ", "L"), ("Affero ", "A"))]
_SPDX = ["MIT", "ISC", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only"]

LICENSES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
]
#: One-line notices: the forms in which each licence is commonly named.
LICENSES += [(name, f"{verb} under the {title}.") for verb in ("Licensed", "Released", "Distributed", "This work is licensed") for name, title in (("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License, version 2.0"))]
LICENSES += [(x.replace(" ", "-", 1) if x[2] == "0" else x.replace(" ", "-"), f"{verb} under {x}.") for verb in ("Licensed", "Released", "This work is licensed") for x in _CREATIVE]
LICENSES += [(f"{short}-{v}", f"{verb} under the {long}, version {v[0]}.") for verb in ("Licensed", "Released", "This work is licensed") for long, short in _GNU for v in ("2.0", "3.0")]
LICENSES += [(x, f"SPDX-License-Identifier: {x}") for x in _SPDX]
#: Full texts too long to keep here: licence, digest (SHA-256 of the canonical text), length of the canonical text.
#: Texts as distributions carry them; where one ends its terms with END OF TERMS AND CONDITIONS, also up to there.
DIGESTS: list[tuple[str, str, int]] = [
    ("Apache-2.0", "26924b00f8834a1456cd509945dfd38a032c40ee469d6c5abe670ddbfd18dc6d", 8881),
    ("Apache-2.0", "2b84a2593e5db43b337c87c67ba24cb8a529e89f848cea869d1ae0aaa57faefc", 8841),
    ("Apache-2.0", "51c053cebc5bfb1ed05e42ec4868805dd6944edf8695ebfd550d24d738df302d", 8869),
    ("Apache-2.0", "673111ae54c4173bc8433f3200a04f229eb09a971ea46f2b7f31b4669954e9ff", 9880),
    ("Apache-2.0", "8726fe413072114ca343d8f0053974723467cca802aa3e37c088f780f2cab206", 9383),
    ("Apache-2.0", "8abe7e52f36f019d0eef3a517009ebca811a44687f0d0398a6c4f17b5a5647d0", 9892),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93", 5823),
    ("BSL-1.0", "7442addb08927564a6aefb68009afaa4aadf14d9dc8faaae9539cd1b14a7e5e5", 1293),
    ("BlueOak-1.0.0", "3da82a79ef000530e0b1d7b8009c64e93b6654c399c2ea8d5e593474e521607f", 1465),
    ("CC-BY-SA-4.0", "e45e5ebe59ffd98bea05ce34e3fc82d3ada480ba973e82805782bc27e487fd2b", 17245),
    ("CC-BY-SA-4.0", "fe8c455f8610beec5f8e3feec6a328188db60017bb58cd7ed36cd61f35b7a81f", 14680),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "274e3fa4591a80eebc8e3ef47ebbd37d9bdf263d33495c417079920cb6caac2f", 19571),
    ("GFDL-1.3", "5e8b488ff84a1a3e9954cf9b716c8c56e4292049bc7606827bd08842f6de23ea", 21995),
    ("GPL-1.0", "0dd6055657537c68401626873e347732e284f7e1f5d33fbccd8791d47450eb38", 11770),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9", 9412),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0", 14479),
    ("GPL-2.0", "c5626516907c9b28f97a88db36f7dbe90174e04e4e97c6c772f3a44039e7f51d", 17121),
    ("GPL-3.0", "3c60f0626ebfd5047a8fecb7975a87632c398af2ffc3f654b0468267ac29a764", 33388),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b", 30957),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389", 22273),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e", 24126),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97", 23361),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", 25213),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "29e875624ff654dd4ec54fe533df83df152625ff21f26f7c229917a2494754ad", 22474),
    ("MPL-2.0", "48c053e1182a1be98be381314f1e8433c3c46bc995b108845dfce1b28ef797c4", 14344),
    ("Unlicense", "248c77414369ce4b842760d0241cb8184f0805a4354f498a6fb7f7b027ee767e", 1165),
]
