"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines, every run of other characters than letters and
digits one space, equivalent spellings made one.  The digest of a whole document's form is joined with the digests of
known licence texts; so is the digest of each of its lines, for licence notices, which are texts of one line.  The join
is an equality of digests with the small table of known texts; lines are never paired with licences.

Whole files have a second form, which doesn't depend on where lines break: only statements of copyright are left out, not
lines of the terms that begin with the word, and the parts of a licence that its users fill in are made one.  Titles and
appendices that may be absent are further digests of a known text.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.llm.common import as_docs

# Spellings that count as equal, each with the form it takes here.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "customise": "customize",
    "emphasise": "emphasize", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "licence": "license", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Known notices (one line) and licence texts, copyright lines left out.
_GRANT = ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
          "Software.")
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TERMS + "\n" + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TERMS + "\n" + _BSD_NAMES + "\n" + _BSD_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
""" + _GRANT + """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
]

# Whole licences as files; how their files, and the texts above, may be headed.
TEXTS = Path(__file__).with_name("licence_texts")
TITLES = {
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License", "BSD Zero-Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License",
                     "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
                     "Modified BSD License", "Revised BSD License", "The BSD 3-Clause License", "BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
OWN_TITLE = {"BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003"}   # may be absent
END_OF_TERMS = "END OF TERMS AND CONDITIONS"   # what follows is an appendix

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|all rights reserved|\(c\)|©)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _statement() -> str:
    """A line that states a copyright: not of the terms, where one of _prose() follows the word."""
    return (r"(?m)^[^\p{L}\p{N}\n_]*(?:copyright\b(?!\s*\(c\)\s*_)(?![^\p{L}\p{N}]*(?:" + "|".join(_prose()) + r")\b)[^\n]*"
            r"|\(c\)\s*[0-9]{4}[^\n]*|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$")


def _prose() -> list[str]:
    """What follows "copyright" in the terms of the known texts; a holder's name may begin with "the" too."""
    found = set(re.findall(r"\bcopyright[^a-z0-9]+((?:the\W+)?[a-z]+)", "\n".join(t for _, t in KNOWN + file_texts()).lower()))
    # The GNU licences' examples are terms: lines of them may break before the word.
    found |= {"c year name of author", "c 19yy name of author", "c 19xx name of author", "c year your name", "owners", "holders", "notices"}
    return sorted({re.sub(r"\W+", r"[^\\p{L}\\p{N}]+", x) for x in found - {"c", "yyyy", "year", "by"}})


# Parts of a whole file that differ between its users, each with the form it takes here.
FILLED_IN = [
    (r"\bhttps\b", "http"), (r" copyright owners? or contributors ", " copyright holder or contributors "),
    (r" neither the names? of .{1,200}? nor the names of ", " neither the name of the copyright holder nor the names of "),
    (r" (?:51 franklin st(?:reet)? (?:fifth floor |suite 500 )?boston ma 02110 1301 usa|59 temple place (?:suite 330 )?boston ma "
     r"02111 1307 usa|675 mass ave cambridge ma 02139 usa) ", " "),
]


def file_texts() -> list[tuple[str, str]]:
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]


def file_variants() -> list[tuple[str, str]]:
    """(licence, text): the whole licences, with and without the parts that may be absent."""
    out = []
    for name, text in [(n, t) for n, t in KNOWN if "\n" in t] + file_texts():
        body = text.replace(OWN_TITLE.get(name, ""), "", 1)
        bodies = {text, body, re.sub(r"(?m)^[0-9][.] ", "", text) if name.startswith("BSD-") else text}
        if END_OF_TERMS in text:
            terms = text.split(END_OF_TERMS)[0]
            bodies |= {terms, f"{terms}\n{END_OF_TERMS}"}
        out += [(name, head + b) for b in sorted(bodies) for head in ("", *(f"{t}\n" for t in TITLES.get(name, ())))]
    return out


def file_form(text: Column) -> Column:
    """The form of a whole file, in one line; empty if nothing is left of it."""
    low = F.regexp_replace(F.lower(text), _statement(), "")
    out = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    out = reduce(lambda c, s: F.regexp_replace(c, *s), FILLED_IN, F.regexp_replace(out, " +", " "))
    return F.trim(reduce(lambda c, s: F.replace(c, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), sorted(SPELLINGS.items()), out))


def may_be_file(text: Column) -> Column:
    """False only for texts that are none of ``file_variants``: each of those has one of these words."""
    low = F.lower(text)
    return low.contains("warrant") | low.contains("lesser")


def canonical(text: Column) -> Column:
    """The canonical form, with line breaks: words separated by one space, a space at both ends of a line."""
    low = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(low, NOT_WORD, " "), F.lit(" ")), r" ?\n ?", " \n ")
    return reduce(lambda c, s: F.replace(c, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), sorted(SPELLINGS.items()), out)


def _lines(form: Column) -> Column:
    return F.filter(F.transform(F.split(form, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text, in_lines): the built-in table; in_lines: the text also counts as a notice."""
    return spark.createDataFrame([(*k, True) for k in KNOWN] + [(*k, False) for k in file_variants()],
                                 "licence string, text string, in_lines boolean")


def _digest(lines: Column) -> Column:
    """Digest of a whole text; null if nothing is left of it."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def _file_unit(text: Column) -> Column:
    form = file_form(text)
    return F.when(form != "", F.concat(F.lit("file "), F.sha2(form, 256)))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, licence, n_notice_lines, notices) of every row.

    digest: SHA-256 of the whole text's canonical form, null if that is empty; licence: the known text it equals in that form,
    else in the form of whole files, null if none (of several names the least); n_notice_lines: lines that equal a known text; notices: their names in order, each
    once, joined by commas, empty if none.  known: (licence, text), by default the built-in table, which alone is broadcast.
    A null text is empty; a null id stays null; repeated rows give repeated results; an empty table gives an empty result;
    other columns are not read.
    """
    own = known is None
    table = known_licences(docs.sparkSession) if own else known.select("licence", "text", F.lit(True).alias("in_lines"))
    # Units of whole files have a prefix: a line that equals one is no notice.
    whole = _file_unit(F.col("text"))
    table = (table.where("in_lines").select("licence", _digest(_lines(canonical(F.col("text")))).alias("unit"))
             .union(table.select("licence", whole.alias("unit"))).where("unit is not null")
             .groupBy("unit").agg(F.min("licence").alias("found")))
    if own:
        whole = F.when(may_be_file(F.col("text")), whole)
    units = (as_docs(docs, id_col, text_col)
             .select("doc_id", F.monotonically_increasing_id().alias("row"),
                     _lines(canonical(F.coalesce("text", F.lit("")))).alias("lines"), whole.alias("whole"))
             .select("doc_id", "row", F.explode(F.concat(
                 F.array(F.struct(F.lit(-1).alias("no"), _digest(F.col("lines")).alias("unit")),
                         F.struct(F.lit(-2).alias("no"), F.col("whole").alias("unit"))),
                 F.transform("lines", lambda x, i: F.struct(i.alias("no"), F.sha2(x, 256).alias("unit"))))).alias("u"))
             .select("doc_id", "row", "u.no", "u.unit"))
    met = units.join(F.broadcast(table) if own else table, "unit", "left")
    is_line = F.col("no") >= 0
    return (met.groupBy("row", "doc_id")
            .agg(F.max(F.when(F.col("no") == -1, F.col("unit"))).alias("digest"),
                 F.coalesce(*(F.max(F.when(F.col("no") == k, F.col("found"))) for k in (-1, -2))).alias("licence"),
                 F.sum((is_line & F.col("found").isNotNull()).cast("long")).alias("n_notice_lines"),
                 F.array_join(F.sort_array(F.collect_set(F.when(is_line, F.col("found")))), ",").alias("notices"))
            .drop("row"))


def oracle() -> str:
    """The same in DuckDB's SQL, without the form of whole files."""
    def form(text):
        out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
        out = f"' ' || regexp_replace({out}, '{NOT_WORD}', ' ', 'g') || ' '"
        out = f"regexp_replace({out}, ' ?\\n ?', ' ' || chr(10) || ' ', 'g')"
        for a, b in sorted(SPELLINGS.items()):
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    quoted = ", ".join(f"('{a}', '{b}')" for a, b in ((a, b.replace("'", "''")) for a, b in KNOWN))
    digest = "case when len(ls) > 0 then sha256(array_to_string(ls, ' ')) end"
    return f"""
WITH known AS (SELECT unit, min(licence) AS found FROM (
       SELECT licence, {digest} AS unit FROM (SELECT licence, {form('text')} AS ls FROM (VALUES {quoted}) t(licence, text)))
     WHERE unit IS NOT NULL GROUP BY unit),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {form("coalesce(text, '')")} AS ls FROM documents),
whole AS (SELECT rid, doc_id, {digest} AS digest FROM docs),
hit AS (SELECT rid, count(found) AS n, string_agg(DISTINCT found, ',' ORDER BY found) AS names
        FROM (SELECT rid, sha256(unnest(ls)) AS unit FROM docs) JOIN known USING (unit) GROUP BY rid)
SELECT doc_id, digest, found AS licence, CAST(coalesce(n, 0) AS BIGINT) AS n_notice_lines, coalesce(names, '') AS notices
FROM whole LEFT JOIN known ON digest = unit LEFT JOIN hit USING (rid)"""
