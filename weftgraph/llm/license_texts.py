"""Public licence texts and notices, by SPDX identifier."""

import re

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

#: Entire licence texts, without title and copyright line; of Apache-2.0, MPL-2.0 and GPL-3.0-or-later the header of files (entire: ``LONG``).
TEXTS = {
    "MIT": _MIT_GRANT,
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

""" + _MIT_GRANT[_MIT_GRANT.index("THE SOFTWARE IS") :],
    "X11": _MIT_GRANT.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM") + """

Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.

X Window System is a trademark of X Consortium, Inc.""",
    "BSD-1-Clause": _BSD_HEAD[: _BSD_HEAD.index("2. ")] + _BSD_TAIL,
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.

IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "curl": """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.""",
    "FSFAP": """Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.""",
}

#: Other wordings of these that are in use: who disclaims, marks before the conditions.
VARIANTS = [
    *(("ISC", TEXTS["ISC"].replace("THE AUTHOR ", f"THE {who} ").replace("and/or distribute", verb)) for who in ("AUTHOR", "AUTHORS", "COPYRIGHT HOLDER", "COPYRIGHT HOLDERS") for verb in ("and/or distribute", "and distribute")),
    *(
        (name, (re.sub(r"(?m)^\d\. ", "", TEXTS[name]) if bare else TEXTS[name]).replace("SHALL THE COPYRIGHT HOLDER OR", f"SHALL THE {who} OR"))
        for name in ("BSD-2-Clause", "BSD-3-Clause") for bare in (False, True) for who in ("COPYRIGHT HOLDER", "COPYRIGHT OWNER", "COPYRIGHT HOLDERS")
    ),
]

#: Titles that licence files begin with.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License", "BSD Zero-Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD-2-Clause", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD-3-Clause", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)"],
    "Unlicense": ["The Unlicense", "Unlicense", "The Unlicense (Unlicense)"],
    "MIT-0": ["MIT No Attribution", "MIT-0", "MIT No Attribution License"],
    "BSD-1-Clause": ["BSD 1-Clause License", "BSD-1-Clause"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "PostgreSQL": ["PostgreSQL License", "The PostgreSQL License", "PostgreSQL Database Management System\n(formerly known as Postgres, then as Postgres95)"],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "WTFPL"],
    "curl": ["COPYRIGHT AND PERMISSION NOTICE"],
}
_RESERVED = "All rights reserved."
#: What stands before a text: a title, the line on reserved rights that follows or precedes it, or that line alone.
HEADS = [
    (name, head)
    for name, titles in TITLES.items()
    for head in (_RESERVED, *(h for t in [*titles, f"SPDX-License-Identifier: {name}"] for h in (t, f"{t}\n{_RESERVED}", f"{_RESERVED}\n{t}")))
]
#: All texts, bare and under their heads.
WHOLE = [*TEXTS.items(), *VARIANTS]
TITLED = [(name, f"{head}\n\n{text}") for name, text in WHOLE for of, head in HEADS if of == name]

#: Canonical digests of texts too long to be listed here: as published, and without the advice after (or from) the end of their terms.
LONG = [
    ("Apache-2.0", "0ac0af882f398ccd53e47646d1851582250f53c520fde82b6b28ae95ce3fdfd7"),
    ("Apache-2.0", "237c66fb072fea7bd1521da952b386b67e3115180cd5a08a3159b1e59e6eafca"),
    ("Apache-2.0", "6bf1b72dc212a2aeed6fd92a422e22e595d5230db58fbabfdcf0963978a42f84"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "7b43ee8f1e8c954af35f9a316ad24ee0e263b15c3511a472b7f547619129345e"),
    ("Apache-2.0", "c316cfc64e54611eda93c21e10447bdbbef3f4be56b19e86e39f1ec778d494bc"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0 WITH LLVM-exception", "6162751997524abc581d0e7fd1b10f334ec61e6d7e34d4014bace4371153dbe0"),
    ("Artistic-1.0-Perl", "c9bcba9e70d36ab628a0944e717aa88f7b65f5755a9f3061c584801892429806"),
    ("BlueOak-1.0.0", "b5486f9ab63946843fac3e78bc558bc5c5730f2ac8ad428fa6cc2769ec1d639b"),
    ("CC-BY-SA-4.0", "4cc23a8f446a2cc4a2cb87141452d340e6af0e60a4e1252330d29c821fea9847"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0-only", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0-only", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0-only", "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50"),
    ("GPL-2.0-only", "3417af4a4eb07583be14c0185e9a1834057e320931de2c5bf39c217a03fe79a0"),
    ("GPL-2.0-only", "42a2063beecb82de51a227e52a22e4acf4fa0d052827262e6bb57835e02e10e9"),
    ("GPL-2.0-only", "5cb6370ac80145bff27a54858e51a973da8c42e030e5803cfe2c3953ae0150ac"),
    ("GPL-2.0-only", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0-only", "71f3bc98cacf711b6e2ff997b37641e59cc5bf623e7c0f0e8343aed2626f4ec9"),
    ("GPL-2.0-only", "724c8299687866f11de217ce9f08e16805bc84b71e66d8c4ea1307d371e33a4f"),
    ("GPL-2.0-only", "949d7b0a70d9281ea0bb37fd8aa082f26cd4efcfbb376d0dccad043e772c09a0"),
    ("GPL-2.0-only", "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75"),
    ("GPL-2.0-only", "bdf38469899e13b914cf4555a4606ddcc8b2faddcedc662286f649b36212f225"),
    ("GPL-2.0-only", "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c"),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329"),
    ("GPL-3.0-only", "133f52d70130d8be9966b3c325153b96eab9254b0fe5369439fff044e98c5d3a"),
    ("GPL-3.0-only", "27c7d4a052cb5b68f1b41c3fa933ce9796ace78aeed0819833b4f8102a6eb47b"),
    ("GPL-3.0-only", "607c705f9768e313af3bc7846c6815e61bce971f831a5fd61344a150e8f32b08"),
    ("GPL-3.0-only", "69a19fa00710a84d83ec8e9bb9b15c7f42c9598b02028ac43f385e2eb740206b"),
    ("GPL-3.0-only", "a3befc99a52b31d6651d10d3a5453a64872b0c7adfec0f91a471a9df284d545d"),
    ("GPL-3.0-only", "ad4a8c0f86b40eeaec03087f95684ff7965ffea480d1a58d4d7d9cb5ea929725"),
    ("LGPL-2.0-only", "02fd8287939a10c62ed7dfb331733c7873c728e1fed2a3e9a79e8cf81c9fe955"),
    ("LGPL-2.0-only", "40679bbedb0e4271c9b36600e68469ba09f3d705206f93882cec0f1aa3422edb"),
    ("LGPL-2.0-only", "5b313222545879140519fc4f8ac7558088e9529f29bda08d2b75946987652f50"),
    ("LGPL-2.0-only", "5b76795361ffca92776bfb6f87f31cc8c230526d08f639d965de248bd171ca59"),
    ("LGPL-2.1-only", "6ce9e9dc5005db9536b303ace5104e7d79eb77fa76f5ca2e335ea6401497ea1e"),
    ("LGPL-2.1-only", "7a66b85cae19b2bdebe37a3e5e1a64e3238ac8c8f1ccd2db2f0306d9a294faf5"),
    ("LGPL-2.1-only", "cbddf7ff9772a9e20c7b96361da4118247cfe58a0be3f06d0628c67c221c53b7"),
    ("LGPL-2.1-only", "d5bb785ace385ee65075c046b4207261f5198ebee0406ca35ee526f619582c17"),
    ("LGPL-2.1-only", "e8fff5aab68f3784c88bdf6c7d677d555dbfc3274d7e0a03da4870604bf989ed"),
    ("LGPL-2.1-only", "f71ed154dfc5ed428b3389d785fc8ae6e6cde015405891fcbaec797514b833a0"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("OFL-1.1", "45e4ba7cc392f1a7d1063dfcc959bd936542d70469f45f62c1504e915902ae9a"),
    ("Python-2.0", "2b82c8022632647839ab416153aa8ddb23fb5a7831959b0f4bd96110173de892"),
    ("Python-2.0", "407a643d29d4fde00aa4c5c0a7bc55b31e68b2515184ad2c4df6e03c3244728a"),
    ("Python-2.0", "40b9af19d3437c4c2f45f06eb67193a4aaca7561d9b16269c66b0b33f8330e2e"),
    ("Python-2.0", "967d2e5a6fb0ce1c1d4bf18d1f754988ae765021c24c09300c926217df9022d7"),
    ("Python-2.0", "b2877c73ccffb4803a46322b2c565ea67732e80c6898141a3f1dca3804888dcc"),
    ("Python-2.0", "d57ba8d319837562e25a2c0df49ba3088a4aae734cd16877437c2c7a006eda9d"),
    ("Python-2.0", "eb2a0f6732d9491a99dc29cd643aa926a93f3f918e9f5b87de3463851f309784"),
    ("Unicode-3.0", "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8"),
]

#: Notices of one line, which stand for a licence inside another text.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: Spellings that count as equal (after lower-casing and punctuation).
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("https", "http"),
]
