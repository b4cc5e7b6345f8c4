"""Licence scans by canonical digest: whole texts are normalised, digested and hash-joined to the digests of known licence texts. DataFrame functions only.

Normal form: notice lines go (copyright before a sign or a year, a sign before copyright or a year; with an "all rights reserved" line right below), as do usual title lines at the top,
both also behind comment marks. ASCII letters become lower case, every run of other ASCII characters than letters and digits becomes one blank, equivalent spellings become one, blanks at
the ends go. Other lines that begin with "copyright" belong to the body and stay. Null text is empty. An empty normal form matches nothing. The known texts are constants, so their join is
a broadcast of a proven size.

The SQL has a plainer normal form (every line that begins with "copyright", "(c)" or a sign goes, titles stay) and only the texts of KNOWN: it is comparable on tables that hold no such
lines, as the given ones.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, pick

#: Fixed values: (id, text) of known licences and standard notices.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("notice-MIT", "Released under the MIT License."),
    ("notice-Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice-GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice-CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Whole texts of more licences, <license_id>.txt each.
TEXTS = Path(__file__).with_name("license_texts")
#: Spellings held equivalent.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("non infringement", "noninfringement"))
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a lower-cased text with a line feed before it. Java and Python read both patterns alike. The first one ends before a line's end, the second one needs a line after it.
_MARKS = r"[ \t#/*;%!-]*"
_SIGN, _YEAR = r"(?:\(c\)|©|&copy;)", r"[\[<{(]?(?:[0-9]{4}|yyyy|year)"
_REAL_NOTICE = rf"[\r\n]{_MARKS}(?:copyright[ \t:]*(?:{_SIGN}|{_YEAR})|{_SIGN}[ \t]*(?:copyright|{_YEAR}))[^\r\n]*(?:(?:[\r\n]{_MARKS}){{1,4}}all rights reserved[ \t.*/#-]*(?![^\r\n]))?"
_BSD = r"(?:new |modified |simplified |revised )?bsd(?:[ -][0-4][ -]clause)?(?: \"?(?:new|simplified|original)\"?(?: or \"?(?:revised|freebsd|old)\"?)?)?"
_TITLE = rf"^(?:[\r\n \t#/*;%!=_~-]*(?:the )?(?:(?:mit|expat|x11|isc|zlib|zlib/libpng|0bsd|bsd zero[ -]clause|zero[ -]clause bsd|{_BSD}) licen[sc]e|unlicen[sc]e)(?: \([a-z0-9 -]{{1,20}}\))?[ \t.:*/#=-]*(?=[\r\n])){{1,2}}"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(ascii_lower(F.concat(F.lit("\n"), F.coalesce(text, F.lit("")))), _REAL_NOTICE, "")
    out = F.regexp_replace(F.regexp_replace(out, _TITLE, ""), _OTHER, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def normal(text: str) -> str:
    """What `canonical` gives, for the known texts."""
    out = ("\n" + text).translate({c: c + 32 for c in range(65, 91)})
    for pattern, by in ((_REAL_NOTICE, ""), (_TITLE, ""), (_OTHER, " ")):
        out = re.sub(pattern, by, out)
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out.strip(" ")


def _forms(name: str, text: str) -> list[str]:
    """The usual forms of a licence's file: without what follows the terms, with either scheme in addresses, BSD items without numbers and for the Regents."""
    out = [text]
    if "END OF TERMS AND CONDITIONS" in text:
        terms = text.split("END OF TERMS AND CONDITIONS")[0]
        out += [terms, terms + "END OF TERMS AND CONDITIONS"]
    if name.startswith("BSD-"):
        out += [x.replace("the copyright holder nor", "the University nor").replace("COPYRIGHT HOLDERS", "REGENTS").replace("COPYRIGHT HOLDER", "REGENTS") for x in out]
        out += [re.sub(r"(?m)^\s*[0-9]\. ", "* ", x) for x in out]
    return [x for y in out for x in (y, y.replace("https://", "http://"), y.replace("http://", "https://"))]


@lru_cache(maxsize=1)
def known() -> dict[str, str]:
    """Digest to license_id of every known text and form; ids in order, the first one wins."""
    out: dict[str, str] = {}
    for name, text in [*KNOWN, *((p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt")))]:
        for form in _forms(name, text):
            out.setdefault(hashlib.sha256(normal(form).encode()).hexdigest(), name)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, digest (of the normal form), license_id (null if not known), matched."""
    rows = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id")) for d, i in known().items()])
    table = docs.sparkSession.range(1).select(F.explode(rows).alias("k")).select("k.license_id", "k.digest")
    d = pick(docs, "doc_id", "text").select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return d.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("matched"))


#: Of the SQL alone.
_NOTICE = r"\n[ \t]*(copyright|\(c\)|©)[^\n]*"


def _sql(text: str) -> str:
    out = f"""regexp_replace(translate(chr(10) || coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NOTICE}', '', 'g')"""
    out = f"regexp_replace({out}, '{_OTHER}', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256(trim({out}, ' '))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH k AS (SELECT license_id, {_sql('t')} AS digest FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in KNOWN)}) v(license_id, t)),
d AS (SELECT doc_id, {_sql('text')} AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license_id, k.license_id IS NOT NULL AS matched FROM d LEFT JOIN k ON d.digest = k.digest
"""
