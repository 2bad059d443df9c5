"""Licence scan (operator 1): canonical digests, joined to those of known licences.

A text is brought to a canonical form: lower case, spellings that mean the
same made equal, copyright statements out, punctuation to blanks, blanks
squeezed. A copyright statement is a line with the word copyright or a sign
for it and what only a statement has: the sign, (c), a year or a placeholder;
a line of a licence's body that begins with the word copyright stays, however
the text is wrapped. The SHA-256 of the whole canonical text is hash-joined to
the digests of the known licences. Texts that hold a licence among other
matter are found by their lines: the digests of canonical lines are looked up
among those of known one-line notices.

All of it is DataFrame functions, in one pass over the texts. The table of
known texts is a parameter; the join broadcasts it while it is checked to be
small and is left to Spark beyond that. Notices are a map literal while they
are few; beyond that lines are exploded and joined by the digest of the text
that they are from, so no row needs a number.

Only lines that could be a notice by their first word are digested, which
loses none, and equal lines of a text collapse first.

Edge cases: null texts have a null digest and no licence; texts that are blank
after canonicalising have the digest of the empty text and match nothing.
Rows are handled one by one, so repeated rows give repeated results; where the
table of known licences has one text under several names, the first name in
order counts. Without known texts nothing matches. Columns besides the id and
the text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known one-line notices: name, text. Fixed values.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
]

#: Known whole licences: name, text. Fixed values.
LICENCES = [
    (
        "MIT",
        "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
]

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
_BSD = (
    "Copyright (c) <year>, <holder>\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n\n"
)
_FREELY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "
    "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE."
)
LICENCES += [
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _AS_IS),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _NAMES + _AS_IS),
    ("BSD-3-Clause", _BSD + _NAMES + _AS_IS),
    ("0BSD", "Copyright (c) <year> <holder>\n\n" + _FREELY),
    ("0BSD", "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n" + _FREELY),
    (
        "Zlib",
        "zlib License\n\nCopyright (c) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    (
        "Apache-2.0",
        "Copyright <year> <holder>\n\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "Copyright (C) <year> <holder>\n\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
]

#: Spellings with one meaning, as patterns over lower-case text and what stands for them. Fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub-licens", "sublicens"),
    ("non[- \n]{0,3}commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("https://", "http://"),
    ("&", " and "),
    ("v(ersion)? ?([0-9])", "version $2"),
]

#: Rows of the table of known licences that may be broadcast, and notices that may be a literal.
BROADCAST_ROWS = 20_000
LITERAL_ROWS = 500

#: Copyright statements: a line that says copyright and has a sign, a year or a placeholder, one that begins with a
#: sign, and the reservation of all rights at a line's end. Fixed values; both engines read them alike.
STATEMENTS = [
    r"(?m)^[^a-z\n]*copyright[^\n]*(\(c\)|©|[0-9]{4}|<[a-z ]+>|\[[a-z ]+\])[^\n]*$",
    r"(?m)^[ \t]*(\(c\)|©)[^\n]*$",
    r"(?m)all rights reserved[^a-z\n]*$",
]


def canonical_lines(text: Column) -> Column:
    """The text in canonical form with its line ends kept and a blank at most before and after each line."""
    out = F.lower(text)
    for pattern, instead in SPELLINGS:
        if pattern.replace("-", "").replace("/", "").replace(":", "").replace("&", "").isalpha():
            out = F.replace(out, F.lit(pattern), F.lit(instead))
        else:
            out = F.regexp_replace(out, pattern, instead)
    # Statements go while (c) and the sign can still be told from letters.
    for pattern in STATEMENTS:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def _squeezed(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, r"[ \n]+", " "))


def known_table(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """Columns known_digest, known_license, first_word of known texts."""
    if not entries:
        return spark.range(0).select(F.lit("").alias("known_digest"), F.lit("").alias("known_license"), F.lit("").alias("first_word"))
    literals = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in entries])
    rows = spark.range(1).select(F.explode(literals).alias("e")).select("e.*").select("license", _squeezed(canonical_lines(F.col("text"))).alias("c"))
    rows = rows.where("c <> ''").select("license", F.sha2("c", 256).alias("known_digest"), F.split("c", " ")[0].alias("first_word"))
    return rows.groupBy("known_digest").agg(F.min("license").alias("known_license"), F.min("first_word").alias("first_word"))


def _names_by_literal(rows: DataFrame, known: list) -> DataFrame:
    """rows with the sorted names of their lines' notices, looked up in a map."""
    names = F.create_map(*[F.lit(x) for r in known for x in (r["known_digest"], r["known_license"])]) if known else F.create_map().cast("map<string,string>")
    found = F.filter(F.transform("line_digests", lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull())
    return rows.withColumn("names", F.array_sort(F.array_distinct(found)))


def _names_by_join(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same by a join, for notices beyond a literal; equal texts are looked up once."""
    lines = rows.where(F.size("line_digests") > 0).select("lines_key", F.explode("line_digests").alias("known_digest")).distinct()
    found = lines.join(known.select("known_digest", "known_license"), "known_digest").groupBy("lines_key").agg(F.array_sort(F.collect_set("known_license")).alias("names"))
    return rows.join(found, "lines_key", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, licences: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", literal_rows: int = LITERAL_ROWS) -> DataFrame:
    """Columns doc_id, digest, license (of the whole text, else null), notices (of lines, sorted), n_notices."""
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    licences = LICENCES if licences is None else licences
    lines = known_table(spark, notices)
    own = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("c"))
    few = len(notices) <= literal_rows
    known = lines.orderBy("known_digest").collect() if few else []
    each = F.transform(F.split("c", " ?\n ?"), lambda x: F.trim(x))
    if few:
        # A line that begins otherwise has no known digest.
        starts = sorted({r["first_word"] for r in known})
        each = F.filter(each, lambda x: F.substring_index(x, " ", 1).isin(starts))
    rows = own.select("doc_id", F.sha2(_squeezed(F.col("c")), 256).alias("digest"), F.transform(F.array_distinct(each), lambda x: F.sha2(x, 256)).alias("line_digests"), *([] if few else [F.sha2("c", 256).alias("lines_key")]))
    named = _names_by_literal(rows, known) if few else _names_by_join(rows, lines)
    whole = known_table(spark, licences + notices).select("known_digest", F.col("known_license").alias("license"))
    whole = F.broadcast(whole) if len(notices) + len(licences) <= BROADCAST_ROWS else whole
    found = named.join(whole, named.digest == whole.known_digest, "left")
    return found.select("doc_id", "digest", "license", F.coalesce(F.array_join("names", ","), F.lit("")).alias("notices"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_notices"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest and the licences that its whole text or its lines are."""
    from stratagrid.session import load

    return scan(load(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, instead in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{instead.replace('$', chr(92))}', 'g')"
    for pattern in STATEMENTS:
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def oracle() -> str:
    """The scan of documents in DuckDB SQL."""
    quoted = lambda rows: ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in row)) for row in rows)
    whole = r"trim(regexp_replace(c, '[ \n]+', ' ', 'g'))"
    return f"""
WITH known_lines AS (SELECT sha256({whole}) AS dg, min(license) AS license FROM (SELECT license, {_sql_canonical('text')} AS c FROM (VALUES {quoted(NOTICES)}) t(license, text)) GROUP BY 1),
known AS (SELECT sha256({whole}) AS dg, min(license) AS license FROM (SELECT license, {_sql_canonical('text')} AS c FROM (VALUES {quoted(LICENCES + NOTICES)}) t(license, text)) GROUP BY 1),
d AS (SELECT doc_id, {_sql_canonical('text')} AS c FROM documents),
lines AS (SELECT DISTINCT doc_id, sha256(trim(x)) AS dg FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS x FROM d)),
n AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices, count(*) AS n FROM (SELECT DISTINCT doc_id, license FROM lines JOIN known_lines USING (dg)) GROUP BY doc_id)
SELECT e.doc_id, e.digest, known.license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices
FROM (SELECT doc_id, sha256({whole}) AS digest FROM d) e LEFT JOIN known ON e.digest = known.dg LEFT JOIN n USING (doc_id)
"""
