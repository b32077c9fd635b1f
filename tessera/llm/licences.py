"""License scans by canonical digests.

A text is brought to a canonical form (case, copyright lines, punctuation, white space and
equivalent spellings) and its SHA-256 is looked up among those of known licences, which are
computed by the same expression. Whole texts are joined by digest with the table of known
licences; besides, each line that could be a licence notice is looked up among the notices.
Whole texts of the larger licences lie in ``licence_texts``, a file for each, named by its identifier; those with an appendix on how to
apply them are known without it, too.

Defined results: a null text has null digest, licence and notices; an empty text has the digest of
the empty form and no licence; repeated rows and ties give repeated results; columns other than
``doc_id`` and ``text`` are ignored; an empty table gives an empty result. The known table has
a fixed number of rows, so it is broadcast; nothing else is dealt out.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of public licences and customary notices, and spellings that count as equal.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ISC = ISC_GRANT + """, provided that the above copyright notice and this permission notice appear in all copies.

""" + ISC_DISCLAIMER
ZERO_BSD = ISC_GRANT + """.

""" + ISC_DISCLAIMER
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
LICENCES = {
    "MIT": [MIT, "MIT License\n\n" + MIT, "The MIT License\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT],
    "ISC": [ISC, "ISC License\n\n" + ISC],
    "0BSD": [ZERO_BSD, "BSD Zero Clause License\n\n" + ZERO_BSD],
    "BSD-2-Clause": [BSD_HEAD + BSD_TAIL, "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL],
    "BSD-3-Clause": [BSD_HEAD + BSD_THIRD + BSD_TAIL, "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL],
    "Zlib": [ZLIB, "zlib License\n\n" + ZLIB],
    "Unlicense": [UNLICENSE],
    "Apache-2.0": [APACHE_HEADER],
    "GPL-3.0": [GPL3_HEADER],
}
#: Ends the terms of licences that have an appendix.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "Unlicense": ["Released under the Unlicense."],
}
SPELLINGS = [
    ("licence", "license"), ("favour", "favor"), ("honour", "honor"), ("colour", "color"), ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("fulfil ", "fulfill "), ("judgement", "judgment"), ("organisation", "organization"),
    ("recognise", "recognize"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
]
#: Every notice has it, in any spelling; other lines need no digest.
NOTICE_MARK = "licen"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Lines of their own that name a holder or a year, and the customary reservation; "(c)" alone is an item of a list.
COPYRIGHT_LINES = r"^[^a-z0-9\n]*(copyright[^a-z0-9\n]+(c\)|©|[0-9]{4}|by )|\(c\)[^a-z0-9\n]*[0-9]{4}|©|all rights reserved[^a-z0-9\n]*$)[^\n]*$"
JOINTS = r"[\x00-\x20\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f“”‘’«»–—…©]+"


def canonical(text: Column) -> Column:
    """The form of a text that its digest is taken of."""
    # d: lines end with a line feed only, as they do for the driver and in SQL
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), F.lit("(?md)" + COPYRIGHT_LINES), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, "https://", "http://"), JOINTS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def canonical_text(text: str) -> str:
    """``canonical`` on the driver, for the table of known texts."""
    import re

    out = re.sub("(?m)" + COPYRIGHT_LINES, "", text.translate(str.maketrans(UPPER, LOWER)))
    out = re.sub(JOINTS, " ", out.replace("https://", "http://"))
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out.strip(" ")


def all_licences() -> dict[str, list[str]]:
    """Texts by licence: those above and the files."""
    out = {k: list(v) for k, v in LICENCES.items()}
    for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms, end, _ = text.partition(END_OF_TERMS)
        out.setdefault(file.stem, []).extend([text, terms + end, terms] if end else [text])
    return out


def known(texts: dict[str, list[str]]) -> dict[str, str]:
    """Digest to licence."""
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, all_ in texts.items() for t in all_}


def license_scan(docs: DataFrame, licences: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: the digest of its canonical form, the licence it is in whole, and the licences that its lines name."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list(known(licences or all_licences()).items()), "digest string, license string")
    marks = known(notices or NOTICES)
    lookup = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(F.translate(x, UPPER, LOWER), F.lit(NOTICE_MARK)))
    named = F.filter(F.transform(lines, lambda x: F.element_at(lookup, digest(x))), lambda x: x.isNotNull())
    out = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.when(F.col("text").isNotNull(), F.array_join(F.array_sort(F.array_distinct(named)), ",")).alias("notices"))
    return out.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license", "notices")


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {quoted("(?m)" + COPYRIGHT_LINES)}, '', 'g')"
        out = f"regexp_replace(replace({out}, 'https://', 'http://'), {quoted(JOINTS)}, ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"sha256(trim({out}, ' '))"

    rows = lambda texts: ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in known(texts).items())
    return f"""
WITH lic(digest, license) AS (VALUES {rows(all_licences())}), mark(digest, license) AS (VALUES {rows(NOTICES)}),
d AS (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents),
line AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d),
named AS (
    SELECT row_no, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
    FROM line JOIN mark ON {form("line")} = mark.digest WHERE contains(translate(line, '{UPPER}', '{LOWER}'), '{NOTICE_MARK}') GROUP BY row_no
), h AS (SELECT *, {form("text")} AS digest FROM d)
SELECT doc_id, h.digest, license, CASE WHEN text IS NOT NULL THEN coalesce(notices, '') END AS notices
FROM h LEFT JOIN lic ON h.digest = lic.digest LEFT JOIN named ON h.row_no = named.row_no
"""
