"""License scans by canonical digest lookup.

A text is normalised (case, punctuation and white space, copyright lines,
equivalent spellings) and hashed whole; the digest is joined to those of known
licences, normalised alike. The lines of a text are looked up the same way, as
entire texts of their own, which finds notices of one line; only lines as long
as some known text are hashed. Only built-in functions are used, and only the
table of known digests, which is a parameter of the job, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Equivalent spellings, the second taking the first's place. Texts have spaces for punctuation by then.
SPELLINGS = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copy right", "copyright"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("fulfilment", "fulfillment"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https", "http"),
]

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_TWO = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_BODY = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\n'
    "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n"
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
    "and limitations under the License."
)

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
    "binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    "software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_END = "END OF TERMS AND CONDITIONS"

#: Known licence texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_THREE + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_THREE + _BSD_TAIL),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"),
]

#: Licence, length and SHA-256 of the normalised entire text, with its appendix and up to its end of terms. ``digests_of`` gives them.
DIGESTS: list[tuple[str, int, str]] = [
    ("Apache-2.0", 8866, "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", 9882, "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", 5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0-only", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0-only", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0-only", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0-only", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1-only", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22447, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def digests_of(spark: SparkSession, texts: list[tuple[str, str]]) -> list[tuple[str, int, str]]:
    """(license_id, length, digest) of licence texts: each one whole and, where it says so, up to the end of its terms."""
    ends = [(i, t[: t.index(_END) + len(_END)]) for i, t in texts if _END in t]
    return sorted((r["license_id"], r["length"], r["digest"]) for r in known_digests(spark, [*texts, *ends]).collect())

#: Lines that name a holder by a sign or a year, or reserve rights, as they are after case and punctuation. A line of a licence's own
#: prose may begin with the word as well, depending on where it was broken, so the word alone tells nothing but at the head of a text.
_COPYRIGHT = "^(copyright (c|year|yyyy|[0-9]+)( .*)?|all rights reserved)$"
#: The first lines of a text, in which "copyright" and any name make a copyright line: at its head or right after a title.
_HEAD = 2
#: A sign in brackets before a year, at the beginning of a line.
_SIGN = r"(?m)^[ \t*#/]*\(c\)[ \t]*([0-9])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_lines(text: Column) -> Column:
    """The normalised lines of text: no empty ones, no copyright lines. Joined, they are the same wherever its prose was broken."""
    t = F.replace(F.translate(F.translate(text, _UPPER, _LOWER), "\r", "\n"), F.lit("©"), F.lit("(c)"))
    t = F.when(F.contains(t, F.lit("(c)")), F.regexp_replace(t, _SIGN, "copyright $1")).otherwise(t)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    filled = F.filter(lines, lambda x: x != "")
    return F.filter(filled, lambda x, i: ~(x.rlike(_COPYRIGHT) | ((i < _HEAD) & F.startswith(x, F.lit("copyright ")))))


def joined(lines: Column) -> Column:
    """One text of normalised lines; spellings of two words may have been broken between lines."""
    t = F.array_join(lines, " ")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new)) if " " in old else t
    return t


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, length), one row per digest, of the known texts, normalised as any other, and by default of DIGESTS."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known or KNOWN])
    whole = spark.range(1).select(F.explode(rows).alias("k")).select("k.license_id", joined(canonical_lines(F.col("k.text"))).alias("t"))
    each = whole.select(F.sha2("t", 256).alias("digest"), "license_id", F.length("t").alias("length"))
    if known is None:
        more = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id"), F.lit(n).alias("length")) for i, n, d in DIGESTS])
        each = each.union(spark.range(1).select(F.explode(more).alias("k")).select("k.*"))
    return each.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("length").alias("length"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, text_digest, license_id, notices).

    text_digest is of the normalised whole text, license_id the known licence
    that it is, or null; notices are the known licences that lines of the text
    are, sorted and joined by commas, empty if none. Null texts count as empty
    and are no licence. Every row is judged by itself, whatever its id: repeated
    rows are repeated, ids may be null. An empty table gives no rows; other
    columns are ignored. Long texts, and texts of very many lines, cost as
    their length. Where prose was broken into lines makes no difference, save
    that copyright lines have to be lines of their own. Only a whole text is
    a license_id: a licence within a header of code is none.
    """
    found = known_digests(docs.sparkSession, known)
    listed = found.collect()  # a row for each known text, all of which are parameters
    names = F.create_map(*[F.lit(x) for r in listed for x in (r["digest"], r["license_id"])])
    lengths = [F.lit(n) for n in sorted({r["length"] for r in listed})]
    rows = docs.select(F.col(id_col).alias("id"), canonical_lines(text_or_empty(text_col)).alias("lines"))
    hits = F.transform(F.filter("lines", lambda x: F.length(x).isin(lengths)), lambda x: F.element_at(names, F.sha2(x, 256)))
    notices = F.array_join(F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))), ",")
    whole = rows.select("id", F.sha2(joined(F.col("lines")), 256).alias("digest"), notices.alias("notices"))
    out = whole.join(F.broadcast(found), "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("text_digest"), "license_id", "notices")


def oracle_sql() -> str:
    """DuckDB SQL for ``scan`` of documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = lambda t: f"replace(translate(translate({t}, '{_UPPER}', '{_LOWER}'), chr(13), chr(10)), '©', '(c)')"
    line = lambda t: f"regexp_replace(regexp_replace({low(t)}, {quote(_SIGN)}, 'copyright \\1', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    def spelled(t: str, spellings: list[tuple[str, str]]) -> str:
        for old, new in spellings:
            t = f"replace({t}, {quote(old)}, {quote(new)})"
        return t

    # Copyright lines are told by their words here, one row a line, and texts are put together again.
    def kept(table: str, key: str, text: str) -> str:
        return f"""
            SELECT {key}, x, i FROM (
                SELECT {key}, trim(raw) AS x, row_number() OVER (PARTITION BY {key} ORDER BY place) AS i
                FROM (SELECT {key}, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM (SELECT {key}, {spelled(line(text), SPELLINGS)} AS t FROM {table}))
                WHERE trim(raw) <> ''
            ) WHERE x <> 'all rights reserved' AND NOT (
                split_part(x, ' ', 1) = 'copyright' AND split_part(x, ' ', 2) <> ''
                AND (i <= {_HEAD} OR split_part(x, ' ', 2) IN ('c', 'year', 'yyyy') OR split_part(x, ' ', 2) SIMILAR TO '[0-9]+')
            )"""

    whole = spelled("coalesce(string_agg(x, ' ' ORDER BY i), '')", [(old, new) for old, new in SPELLINGS if " " in old])
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    digests = ", ".join(f"({quote(d)}, {quote(i)})" for i, _, d in DIGESTS)
    return f"""
        WITH v AS (
            SELECT row_number() OVER () AS m, license_id, text FROM (VALUES {known}) AS v(license_id, text)
        ), vl AS ({kept("v", "m", "text")}
        ), k AS (
            SELECT sha256(joined) AS digest, min(license_id) AS license_id
            FROM (SELECT m, {whole} AS joined FROM vl GROUP BY m) JOIN v USING (m) GROUP BY 1
            UNION ALL SELECT * FROM (VALUES {digests}) AS v(digest, license_id)
        ), d AS (
            SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
        ), dl AS ({kept("d", "n", "text")}
        ), w AS (
            SELECT d.n, d.doc_id, sha256({whole}) AS text_digest FROM d LEFT JOIN dl USING (n) GROUP BY 1, 2
        ), h AS (
            SELECT n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
            FROM (SELECT n, sha256(x) AS digest FROM dl) JOIN k USING (digest) GROUP BY 1
        )
        SELECT w.doc_id, w.text_digest, k.license_id, coalesce(h.notices, '') AS notices
        FROM w LEFT JOIN k ON k.digest = w.text_digest LEFT JOIN h ON h.n = w.n
    """
