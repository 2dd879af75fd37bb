"""Names and texts of common licences and of the notices that name one.

Full texts are files of ``licence_texts``, each named by its licence. They are known with and without what follows
their terms (how to apply the licence), and with the addresses that the publisher has had.
"""

import re
from itertools import product
from pathlib import Path

NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_TERMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{2}
THIS SOFTWARE IS PROVIDED BY THE {3} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {4} BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_MARKS = (("1. ", "2. ", "3. "), ("* ", "* ", "* "), ("a. ", "b. ", "c. "))
_BSD_PARTIES = (
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
    ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
    ("AUTHOR", "AUTHOR"),
)
_BSD_ENDORSING = (
    *(
        f"Neither the name of the {holder} nor the names of {its} contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
        for holder in ("copyright holder", "University", "author") for its in ("its", "the")
    ),
    "The name of the author may not be used to endorse or promote products derived from this software without specific "
    "prior written permission.",
)
_BSD_TITLES = {
    "BSD-2-Clause": ("", "BSD 2-Clause License\n\n", "The BSD 2-Clause License\n\n", "Simplified BSD License\n\n"),
    "BSD-3-Clause": ("", "BSD 3-Clause License\n\n", "The BSD 3-Clause License\n\n", "New BSD License\n\n", "BSD License\n\n"),
}


def _bsd() -> list[tuple[str, str]]:
    found = []
    for marks, parties in product(_BSD_MARKS, _BSD_PARTIES):
        for name, thirds in (("BSD-2-Clause", [""]), ("BSD-3-Clause", [marks[2] + x + "\n" for x in _BSD_ENDORSING])):
            found += [(name, t + _BSD.format(*marks[:2], x, *parties)) for t, x in product(_BSD_TITLES[name], thirds)]
    return found


_TERMS_END = re.compile(r"^ *END OF TERMS AND CONDITIONS *$|^(?=ADDENDUM: How|EXHIBIT A -|Exhibit A - )", re.M)
_TEMPLATE_LINE = re.compile(r"^ *Copyright \[yyyy\].*\n", re.M)
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
)


def _words(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower())).replace("copyright owner", "copyright holder").replace("https", "http")


def _once(texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of variants with the same words the first: a known digest has one row."""
    return list({_words(body): (name, body) for name, body in reversed(texts)}.values())[::-1]


def _full() -> list[tuple[str, str]]:
    found = []
    for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        forms = [text, _TEMPLATE_LINE.sub("", text)]
        if end := _TERMS_END.search(text):
            forms += [text[: end.end()], text[: end.start()]]
        for form in forms:
            for body in (form, *(_ADDRESS.sub(x, form) for x in _ADDRESSES)):
                found.append((file.stem, body))
    return found


TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TERMS,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n" + _ISC_TERMS,
    ),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    *_once([*_bsd(), *_full()]),
)
