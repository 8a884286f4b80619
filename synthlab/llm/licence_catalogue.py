"""Catalogue of public licences: whole texts with their usual headings, and notices.

``catalogue/`` holds whole texts as published; the short ones are built here.  Each text stands in
the table alone and below each usual heading, with and without its closing part on how to apply it.
Notices are one line each: usual openings before the usual names of each licence.
"""
from __future__ import annotations

import re
from itertools import product
from pathlib import Path

FOLDER = Path(__file__).parent / "catalogue"

#: licence -> the names used in headings and notices (fixed values); the last ones name a family only
NAMES = {
    "MIT": ("MIT License", "MIT", "MIT License (MIT)", "Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"),
    "ISC": ("ISC License", "ISC", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "BSD-2-Clause License",
                     "Simplified BSD License", "FreeBSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "BSD-3-Clause License",
                     "New BSD License", "Modified BSD License", "Revised BSD License",
                     "BSD 3-Clause \"New\" or \"Revised\" License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "BSD-4-Clause", "Original BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License Version 2.0, January 2004",
                   "Apache License v2.0", "Apache-2.0", "Apache-2.0 License", "Apache 2.0", "Apache 2.0 License",
                   "Apache 2 License", "Apache License 2", "Apache Software License 2.0",
                   "Apache Software License, Version 2.0", "Apache License, Version 2.0 (the \"License\")"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, v. 1.1", "Mozilla Public License Version 1.1",
                "MPL 1.1", "MPL-1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0",
                "MPL 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "CC0", "CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
                "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License"),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "Zlib": ("zlib License", "zlib", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0",
                "Boost Software License - Version 1.0"),
    "Artistic-1.0-Perl": ("Artistic-1.0-Perl", "Artistic License 1.0 (Perl)"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0", "EPL-1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0", "EPL-2.0", "EPL 2.0"),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "BSD": ("BSD License", "BSD"), "Apache": ("Apache License", "Apache Software License"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL"),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPL"),
    "MPL": ("Mozilla Public License", "MPL"),
}
for _short, _long, _versions in (("GPL", "General Public License", "123"), ("AGPL", "Affero General Public License", "3"),
                                 ("LGPL", "Lesser General Public License", ("2.1", "3")),
                                 ("LGPL", "Library General Public License", "2"),
                                 ("GFDL", "Free Documentation License", ("1.1", "1.2", "1.3"))):
    for _v in _versions:
        _full = _v if "." in _v else _v + ".0"
        _own = [f"{name} {join}{n}" for name in (f"GNU {_long}", f"GNU {_short}", _short) for n in (_v, _full) for join in ("", "v", "version ")]
        _own += [f"{name} or later" for name in _own] + [f"{_short}-{_full}-only", f"{_short}-{_full}-or-later"]
        NAMES[f"{_short}-{_full}"] = (*NAMES.get(f"{_short}-{_full}", ()), *_own)
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _long in _CC.items():
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _area = "International" if _v == "4.0" else "Unported" if _v == "3.0" else "Generic"
        _own = [f"{cc} {_short} {_v}" for cc in ("CC", "Creative Commons")]
        _own += [f"Creative Commons {_long} {_v}", f"Creative Commons {_long} {_v} {_area}"]
        NAMES[f"CC-{_short}-{_v}"] = (*_own, *[f"{name} License" for name in _own])

_WHAT = ("", "This work is ", "This project is ", "This software is ")
_HOW = ("Licensed under", "Released under", "Distributed under", "Available under", "Licensed under the terms of",
        "Distributed under the terms of")

#: openings of a notice before the name
OPENINGS = tuple(what + how for what, how in product(_WHAT, _HOW)) + ("License:", "SPDX-License-Identifier:")

#: first lines and whole lines of standard notices that name their licence in another way
LINES = (
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Use of this source code is governed by a BSD-style"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
                "this software to the public domain worldwide. This software is distributed without any warranty."),
)

_IF = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following " \
      "conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following " \
          "disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISE = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This " \
             "product includes software developed by {}."
_ENDORSE = "{} may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_PARTIES = (("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
            ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
            ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"),
            ("AUTHOR", "AUTHOR"))
_ENDORSERS = ("Neither the name of the copyright holder nor the names of its contributors",
              "Neither the name of the copyright holders nor the names of its contributors",
              "Neither the names of the copyright holders nor the names of their contributors",
              "Neither the name of the author nor the names of its contributors",
              "Neither the name of the organization nor the names of its contributors",
              "Neither the name of the project nor the names of its contributors",
              "Neither the name of the University nor the names of its contributors",
              "Neither the name of the company nor the names of its contributors", "The name of the author")
_MAKERS = ("the organization", "the University of California, Berkeley and its contributors")


def _listed(first: str, clauses: tuple[str, ...], last: str) -> list[str]:
    """With numbers, and with bullets, which the canonical form does not keep."""
    return ["\n".join([first, *[f"{i}. {c}" for i, c in enumerate(clauses, 1)], last]), "\n".join([first, *clauses, last])]


def _bsd() -> list[tuple[str, str]]:
    out = []
    for parties in _PARTIES:
        end = _DISCLAIMER.format(*parties)
        out += [("BSD-2-Clause", t) for t in _listed(_IF, (_SOURCE, _BINARY), end)]
        for who in _ENDORSERS:
            third = _ENDORSE.format(who) if who.startswith("Neither") else f"{who} may not" + _ENDORSE.removeprefix("{} may")
            out += [("BSD-3-Clause", t) for t in _listed(_IF, (_SOURCE, _BINARY, third), end)]
            if "rs nor" not in who and who.startswith("Neither"):
                out += [("BSD-4-Clause", t) for maker in _MAKERS
                        for t in _listed(_IF, (_SOURCE, _BINARY, _ADVERTISE.format(maker), third), end)]
    return out


_STREET = r"51\s+Franklin\s+Street,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA"


def _published(name: str) -> list[str]:
    """The text of a file, its terms without the part on how to apply them, and the same with other
    addresses of its publisher, as they were printed over the years."""
    text = (FOLDER / f"{name}.txt").read_text(encoding="utf-8")
    out = [text]
    if re.search(_STREET, text):
        out += [re.sub(_STREET, old, text) for old in ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
                                                       "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
                                                       "675 Mass Ave, Cambridge, MA 02139, USA")]
        new = re.sub(r"write\s+to\s+the\s+Free\s+Software\s+Foundation,\s+Inc\.,\s+" + _STREET, "see <https://www.gnu.org/licenses/>", text)
        out += [re.sub(_STREET, "<https://fsf.org/>", new), re.sub(_STREET, "<https://fsf.org/>", new).replace("Ty Coon", "Moe Ghoul")]
    for mark in ("END OF TERMS AND CONDITIONS", "How to use this License for your documents", "Exhibit A - Source Code Form License Notice"):
        for whole in list(out):
            if mark in whole:
                terms = whole[:whole.index(mark)]
                out += [terms, terms + mark] if mark.startswith("END") else [terms.rstrip("-= \n").removesuffix("ADDENDUM:")]
    return out


def _between(name: str, start: str, end: str) -> str:
    text = (FOLDER / f"{name}.txt").read_text(encoding="utf-8")
    at = text.index(start)
    return text[at:text.index(end, at) + len(end)]


def _notices() -> list[tuple[str, str]]:
    """Standard notices of several lines, from the texts that state them."""
    out = [("Apache-2.0", _between("Apache-2.0", "Licensed under the Apache License, Version 2.0", "limitations under the License.")),
           ("MPL-2.0", _between("MPL-2.0", "This Source Code Form is subject", "http://mozilla.org/MPL/2.0/."))]
    for name, start in (("GPL-2", "This program is free software"), ("GPL-3", "This program is free software"),
                        ("LGPL-2.1", "This library is free software"), ("LGPL-2", "This library is free software")):
        end = "<https://www.gnu.org/licenses/>." if name == "GPL-3" else "USA"
        notice = _between(name, start, end)
        out += [(name if "." in name else name + ".0", re.sub(_STREET, a, notice)) for a in
                ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")]
    return out


#: whole texts in ``catalogue/`` -> licence
FILES = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0",
         "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0",
         "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl", "Unlicense": "Unlicense",
         "Zlib": "Zlib", "BSL-1.0": "BSL-1.0"}
#: texts so long that their own heading is the only usual one
LONG = 4_000


def catalogue(short: list[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """(licence, text) rows; ``short`` are further whole texts, without headings."""
    whole = [*short, *_bsd(), *[(licence, text) for name, licence in FILES.items() for text in _published(name)]]
    rows = list(whole)
    for licence, text in whole:
        if len(text) < LONG:
            rows += [(licence, f"{name}\n\n{text}") for name in NAMES[licence][:6]]
            rows += [(licence, f"The {name}\n\n{text}") for name in NAMES[licence][:6] if licence in ("MIT", "ISC")]
    rows += [*LINES, *_notices()]
    rows += [(licence, f"{opening} {the}{name}") for licence, names in NAMES.items() for name in names for opening in OPENINGS
             for the in ("", "the ")]
    seen: dict[tuple[str, str], tuple[str, str]] = {}
    for licence, text in rows:                         # names that differ in case or signs only
        seen.setdefault((licence, " ".join(re.findall(r"\w+", text.lower()))), (licence, text))
    return tuple(seen.values())
