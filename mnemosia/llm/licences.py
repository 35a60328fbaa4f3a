"""License scans: whole texts looked up by their canonical digest.

A text's canonical form drops case, copyright lines, punctuation and line
breaks, and writes equivalent spellings in one way. The SHA-256 of that form is
joined with the digests of known licences, made by the same rules. Only texts
with one of some words, of which every known licence has one, are put into that
form at all; the words are chosen from the known texts.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Equivalent spellings (fixed values): pattern of whole words, its one form.
SPELLINGS = [
    ("licen[cs]e", "license"), ("licen[cs]es", "licenses"), ("licen[cs]ed", "licensed"), ("licen[cs]ing", "licensing"), ("sub licen[cs]e", "sublicense"),
    ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("organisation", "organization"),
    ("favour", "favor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("whilst", "while"),
]

#: A line that names a holder or a year after the word or sign; a line that goes on about copyright is none.
COPYRIGHT = r"(?m)^[^\p{L}\n]*(?:(?:copyright|\(c\)|©)[^\p{L}\p{N}\n]*(?:\(c\)|c\b|©|by\b|<|\[|\{|[0-9]{4}|yyyy|the [^\n]*(?:authors|contributors|developers|foundation))[^\n]*|all rights reserved[^\n]*)$"

_MIT = """MIT License
Copyright (c) <year> <holder>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License
Copyright (c) <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = _ISC.replace("ISC License", "BSD Zero Clause License").replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_HEAD = """Copyright (c) <year>, <holder>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Copyright <year> <holder>
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: File of licence_texts: license. The GNU texts do not say whether later versions may be chosen; their notices do.
_FULL = {
    "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "MPL-2.0": "MPL-2.0",
    "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only",
}
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."


def full_texts() -> list[tuple[str, str]]:
    """Whole licences: with and without what follows their terms, as they are wrapped and with each paragraph on one line."""
    out = []
    for name, license in _FULL.items():
        whole = (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8").replace("\f", "\n")
        end = re.search(r"END OF TERMS AND CONDITIONS|Exhibit A - Source Code Form License Notice", whole)
        for text in [whole, whole[: end.start()], whole[: end.end()]] if end else [whole]:
            out += [(license, text), (license, "\n\n".join(" ".join(x.split()) for x in re.split(r"\n[ \t]*\n", text)))]
    return out


def gnu_notices() -> list[tuple[str, str]]:
    """The notices of the GNU licences for program files, in their usual wordings."""
    out = []
    for family, title, versions in (("GPL", "General", ("2", "3")), ("LGPL", "Library General", ("2",)), ("LGPL", "Lesser General", ("2", "2.1", "3"))):
        for version in versions:
            name = f"{family}-{version if '.' in version else version + '.0'}"
            for thing in ("program", "library", "software", "file"):
                for mark in (";", ":"):
                    for later in (", or (at your option) any later version", "", " only"):
                        which = f"either version {version} of the License{later}" if later.startswith(",") else f"version {version} of the License{later}"
                        head = f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {title} Public License as published by the Free Software Foundation; {which}."
                        hope = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} Public License for more details."
                        got = f"You should have received a copy of the GNU {title} Public License along with this {thing}"
                        ends = ["", *(f"{got}. If not, see <{u}://www.gnu.org/licenses/>." for u in ("http", "https"))]
                        ends += [f"{got}; if not, write to the Free Software Foundation, Inc., {x}" for x in ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA.")]
                        out += [(name + ("-or-later" if later.startswith(",") else "-only"), f"{head}\n\n{hope}\n\n{x}") for x in ends]
    return out


def statements() -> list[tuple[str, str]]:
    """One-sentence statements and SPDX lines of the licences by their usual names."""
    names = {
        "MIT": ["MIT License", "MIT license", "MIT"], "ISC": ["ISC License", "ISC"], "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD"],
        "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
        "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
        "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal License"],
    }
    for family, title, versions in (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3"))):
        for v in versions:
            spdx = f"{family}-{v if '.' in v else v + '.0'}"
            own = [f"GNU {title} Public License{x}" for x in (f", version {v}", f" version {v}", f" v{v}", f" v{v}.0")] + [f"{family} v{v}", f"{family}v{v}", f"GNU {family} v{v}"]
            names[spdx + "-only"] = own + [f"{x} only" for x in own]
            names[spdx + "-or-later"] = [f"{x}{y}" for x in own for y in (" or later", " or any later version", ", or (at your option) any later version")]
    kinds = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for parts in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            title = "Creative Commons " + "-".join(kinds[x] for x in parts.split("-"))
            realm = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            names[f"CC-{parts}-{v}"] = [f"CC {parts} {v}", f"CC {parts} {v} License", f"{title} {v} License", f"{title} {v} {realm} License"]
    out = [(n, f"SPDX-License-Identifier: {n}") for n in names]
    for n, own in names.items():
        out += [(n, f"{a}icensed under {b}{x}.") for x in own for a in ("L", "This work is l", "This software is l", "This project is l") for b in ("", "the ", "a ")]
    return out


#: Short texts that the corpus at hand uses as whole license statements come with the full ones.
KNOWN = [
    ("MIT", _MIT), ("MIT", _MIT.removeprefix("MIT License\n")),
    ("ISC", _ISC), ("ISC", _ISC.removeprefix("ISC License\n")),
    ("0BSD", _ZERO), ("0BSD", _ZERO.removeprefix("BSD Zero Clause License\n")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", _MPL_NOTICE.format("http")), ("MPL-2.0", _MPL_NOTICE.format("https")),
    *full_texts(), *gnu_notices(), *statements(),
]


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines; every run of other characters than letters and digits is one space; one spelling."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    c = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    for pattern, one in SPELLINGS:
        c = F.regexp_replace(c, rf"\b{pattern}\b", one)
    return c


def gate(known: list[tuple[str, str]]) -> str:
    """A pattern without which the lower case of a text cannot be one of the known texts: some words of which each has one, long and shared by many.

    A word that has other spellings stands with all of them; parts of spellings of two words are not taken.
    The empty pattern, which all texts have, if a known text has no other words."""
    single = [(pattern, one) for pattern, one in SPELLINGS if " " not in pattern]
    mixed = {w for pattern, one in SPELLINGS if " " in pattern for w in [one, *pattern.split(" ")]}
    # \\p{L} and \\p{N} as Python writes them
    line = COPYRIGHT.replace(r"[^\p{L}\n]", r"(?:(?!\n)[\W\d_])").replace(r"[^\p{L}\p{N}\n]", r"(?:(?!\n)[\W_])")
    texts = []
    for _, text in known:
        text = re.sub(line, " ", text.lower())
        words = {w for w in re.findall(r"[^\W_]+", text) if w.isascii() and w not in mixed}
        own = frozenset(next((f"(?:{p}|{one})" for p, one in single if w == one or re.fullmatch(p, w)), w) for w in words)
        if own:
            texts.append(own)
        elif re.search(r"[^\W_]", text):
            return ""
    left, chosen = list(set(texts)), []
    while left:
        counts = Counter(w for t in left for w in t)
        word = max(counts, key=lambda w: (counts[w] * len(w) ** 2, w))
        chosen.append(word)
        left = [t for t in left if word not in t]
    return "|".join(sorted(chosen))


#: Made for the lower case of a text; other cases of ASCII letters pass too.
GATE = f"(?i){gate(KNOWN)}"


def registry(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, license of the given texts, one row a digest (the smallest name if texts agree). Texts without canonical words have none."""
    rows = spark.createDataFrame(known, "license string, text string").select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    return rows.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, license, digest of every row of docs (doc_id, text; other columns are ignored).

    license is that of the known text with the same canonical form, else null; of texts that agree in it, the
    smallest name. digest is null where the gate shows that no known text can agree. Null and
    empty texts have neither. The registry is a given list of texts, of which a
    digest each is broadcast; documents are not shuffled."""
    pattern = GATE if known is KNOWN else gate(known)
    gated = F.lower("text").rlike(pattern)
    rows = docs.select("doc_id", F.when(gated, F.sha2(canonical(F.col("text")), 256)).alias("digest"))
    return rows.join(F.broadcast(registry(docs.sparkSession, known)), "digest", "left").select("doc_id", "license", "digest")


def license_lines(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, license, n_lines: lines of docs whose whole text is a known license statement, by document and license."""
    pattern = GATE if known is KNOWN else gate(known)
    gated = F.lower("text").rlike(pattern)
    lines = docs.where(gated).select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where(gated)
    rows = lines.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return rows.join(F.broadcast(registry(docs.sparkSession, known)), "digest").groupBy("doc_id", "license").agg(F.count("*").alias("n_lines"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, and the licenses that whole lines of them state."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = license_lines(docs).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.sum("n_lines").alias("n_license_lines"))
    return scan_licenses(docs).join(lines, "doc_id", "left").select("doc_id", "license", "digest", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def _canonical_sql(column: str) -> str:
    c = f"regexp_replace(lower(coalesce({column}, '')), '{COPYRIGHT}', ' ', 'g')"
    c = f"trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, one in SPELLINGS:
        c = f"regexp_replace({c}, '\\b{pattern}\\b', '{one}', 'g')"
    return c


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


GATED = "regexp_matches(lower({}), '" + GATE + "')"
ORACLE = f"""
WITH k AS (SELECT license, {_canonical_sql("text")} AS c FROM (VALUES {", ".join(f"({_literal(n)}, {_literal(t)})" for n, t in KNOWN)}) AS v(license, text)),
r AS (SELECT sha256(c) AS digest, min(license) AS license FROM k WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, text, CASE WHEN {GATED.format("text")} THEN sha256({_canonical_sql("text")}) END AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE {GATED.format("text")}),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM l JOIN r ON sha256({_canonical_sql("line")}) = r.digest WHERE {GATED.format("line")} GROUP BY 1)
SELECT doc_id, r.license, d.digest, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM d LEFT JOIN r ON d.digest = r.digest LEFT JOIN n USING (doc_id)
"""
