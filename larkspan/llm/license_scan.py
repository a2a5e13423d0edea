"""Licence scan by canonical digest (DataFrame functions only).

Case, punctuation, copyright lines, white space and equivalent spellings are normalised
away, the whole canonical text is hashed with SHA-256, and the digest is hash-joined to
the digests of known licence texts. The same lookup runs over every line of the text, so a
one-line notice inside a longer document is found too: a line counts when all of it is a
known text. Known texts are a fixed list, with the digests alone of long licences (or the
caller's table, which is broadcast only if its row count is at most ``broadcast_rows``).
Lines are looked up within their own row, and only those as long as a known text are hashed;
over ``few`` known texts they meet the digests in a join instead.

Defined results:

* null text counts as empty; an empty canonical text (no letters or digits, or copyright
  lines alone) matches nothing and has a null digest
* an empty table gives an empty result; one row per row of the input otherwise
* the same notice on several lines counts once in ``notices`` and in full in ``n_lines``
* a text equal to several known texts gets the smallest licence name
* whole texts are read, whatever their length; extra columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources import materialize, table

# Public licence texts and customary one-line notices, by SPDX name.
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n"
)
KNOWN_TEXTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
        "whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_TWO + _WARRANTY_BSD),
    (
        "BSD-3-Clause",
        _BSD_TWO
        + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.\n" + _WARRANTY_BSD,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
        "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
]

# Digests of the canonical form of long public licence texts, as Debian ships them, by SPDX name.
KNOWN_DIGESTS = [
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
]

# Spellings that count as equal, applied in this order to lower-case text without punctuation.
EQUIVALENT_SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("non commercial", "noncommercial"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("recognis", "recogniz"),
    ("whilst", "while"),
    ("copyright owner", "copyright holder"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WIDE_MARKS = "‘’“”–—…«» ­"
_COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|\x{A9}|[0-9<\[{]|by )|\(c\)[ \t]*[0-9a-z]|\x{A9}|all rights reserved)[^\n]*$"
)
_MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of ``text``: lower case, words parted by one space, no copyright lines."""
    out = F.translate(text, _UPPER + _WIDE_MARKS, _LOWER + " " * len(_WIDE_MARKS))
    out = F.regexp_replace(out, F.lit(_COPYRIGHT_LINE), F.lit(""))
    out = F.regexp_replace(out, F.lit(_MARKS), F.lit(" "))
    for old, new in EQUIVALENT_SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.filter(F.transform(F.split(out, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """``digest, license, length``: one row per canonical text and its length; ``known`` has the columns ``license, text``.

    Without ``known``, the fixed texts and, for long licences, the fixed digests (their length is null: they are no one-line notices).
    """
    fixed = known is None
    if fixed:
        rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in KNOWN_TEXTS])
        known = spark.range(1).select(F.inline(rows))
    whole = F.array_join(canonical_lines(F.coalesce("text", F.lit(""))), " ")
    out = known.select(F.sha2(whole, 256).alias("digest"), "license", F.length(whole).alias("length"))
    if fixed:
        long_ = F.array(*[F.struct(F.lit(digest).alias("digest"), F.lit(name).alias("license"), F.lit(None).cast("int").alias("length")) for name, digest in KNOWN_DIGESTS])
        out = out.unionByName(spark.range(1).select(F.inline(long_)))
    return out.groupBy("digest").agg(F.min("license").alias("license"), F.min("length").alias("length"))


def _notices_in_row(lines: DataFrame, digests: DataFrame, few: int) -> DataFrame | None:
    """``lines`` with ``found``, the licences of lines that are known texts; None if over ``few`` texts are known."""
    listed = digests.limit(few + 1).collect()
    if len(listed) > few:
        return None
    names = F.create_map(*[F.lit(x) for r in listed for x in (r["digest"], r["license"])])
    lengths = sorted({r["length"] for r in listed if r["length"]})
    named = F.transform(F.filter("lines", lambda x: F.length(x).isin(lengths)), lambda x: F.try_element_at(names, F.sha2(x, 256)))
    return lines.withColumn("found", F.filter(named, lambda x: x.isNotNull()))


def _notices_by_join(lines: DataFrame, digests: DataFrame) -> DataFrame:
    """The same for any number of known texts: lines meet digests in a join, under a number that is written with each row."""
    numbered = materialize(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    met = numbered.select("row", F.explode("lines").alias("line")).join(digests.select(F.col("digest").alias("d"), "license"), F.sha2("line", 256) == F.col("d"))
    found = met.groupBy("row", "license").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy(F.col("row").alias("f_row")).agg(F.flatten(F.collect_list(F.array_repeat("license", F.col("n").cast("int")))).alias("found"))
    return numbered.join(found, F.col("row") == F.col("f_row"), "left").select("doc_id", "lines", F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def scan(
    docs: DataFrame,
    known: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = 20_000,
    few: int = 500,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_digest, license, notices, n_lines``."""
    spark = docs.sparkSession
    digests = known_digests(spark, known)
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("lines"))
    noted = _notices_in_row(lines, digests, few)
    noted = _notices_by_join(lines, digests) if noted is None else noted
    side = digests.select(F.col("digest").alias("known_digest"), "license")
    if known is None or known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        side = F.broadcast(side)
    texts = noted.select(
        "doc_id",
        F.when(F.size("lines") > 0, F.sha2(F.array_join("lines", " "), 256)).alias("text_digest"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
        F.size("found").cast("long").alias("n_lines"),
    )
    return texts.join(side, F.col("text_digest") == F.col("known_digest"), "left").select("doc_id", "text_digest", "license", "notices", "n_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    marks = f"translate({text}, {_sql_text(_UPPER + _WIDE_MARKS)}, {_sql_text(_LOWER + ' ' * len(_WIDE_MARKS))})"
    out = f"regexp_replace({marks}, {_sql_text(_COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace({out}, {_sql_text(_MARKS)}, ' ', 'g')"
    for old, new in EQUIVALENT_SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


ORACLE = f"""
WITH known AS (
  SELECT digest, min(l) AS license FROM (
    SELECT sha256(array_to_string({_canonical_sql("t")}, ' ')) AS digest, l FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN_TEXTS)}) v(l, t)
    UNION ALL SELECT d, l FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN_DIGESTS)}) w(l, d)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS row, doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
t AS (SELECT row, doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS text_digest FROM d),
n AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_lines
      FROM (SELECT row, unnest(lines) AS line FROM d) x JOIN known ON sha256(line) = digest GROUP BY row)
SELECT t.doc_id, t.text_digest, k.license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n_lines, 0) AS BIGINT) AS n_lines
FROM t LEFT JOIN known k ON k.digest = t.text_digest LEFT JOIN n ON n.row = t.row
"""
