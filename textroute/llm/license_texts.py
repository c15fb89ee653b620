"""Known licences: full texts of short licences, and the notices by which works point to a licence.

Apache-2.0, MPL-2.0, GPL, LGPL, AGPL, EPL, Unlicense and the Creative Commons licences are known by notice only: a
document that is the whole text of one of them gets no licence unless the user adds that text.

Fixed values: public licence texts. A user adds others as rows of the same table.
"""
from __future__ import annotations

_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
          "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
          "persons to whom the Software is furnished to do so, subject to the following conditions:")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
          "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")
_ISC_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
              "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
              "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
              "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
              "PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met:\n"
             "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
             "disclaimer.\n"
             "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
             "following disclaimer in the documentation and/or other materials provided with the distribution.\n")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.\n")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
              "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
              "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
              "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
              "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
              "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
              "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

TEXTS = [
    ("MIT", f"MIT License\n\n{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            f"substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n\n{_GRANT.replace(', subject to the following conditions:', '.')}\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all "
            f"copies.\n\n{_ISC_AS_IS}"),
    ("0BSD", f"Zero-Clause BSD\n\n{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_THIRD}\n{_BSD_AS_IS}"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute "
              "verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\n"
              "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n"
              "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
             "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
             "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
             "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source "
             "distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

NAMES = [
    ("MIT", ["MIT License"]), ("ISC", ["ISC License"]), ("Zlib", ["zlib License"]), ("Unlicense", ["Unlicense"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0"]),
    *[(f"{short}-{v}.0", [f"GNU {long}General Public License, version {v}", f"GNU {long}General Public License v{v}", f"{short} v{v}"])
      for short, long in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")) for v in (2, 3)],
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"]),
    ("EPL-2.0", ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"]),
    ("CC0-1.0", ["CC0 1.0", "CC0 1.0 Universal"]),
    *[(f"CC-{kind}-4.0", [f"CC {kind} 4.0", f"CC-{kind}-4.0"]) for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
]
_LEADS = [f"{subject}{verb} under {the}" for subject in ("", "This work is ", "This software is ", "This document is ", "This project is ")
          for verb in ("licensed", "released", "distributed", "available") for the in ("", "the ", "the terms of the ")]
NOTICES = [(name, f"{lead}{title}.") for name, titles in NAMES for title in titles for lead in _LEADS]

#: Spellings that count as equal: (as written, as compared). Only whole words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("owner", "holder"),
    ("owners", "holders"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"),
]
