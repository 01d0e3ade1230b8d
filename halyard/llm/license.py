"""License scans by canonical digests; DataFrame functions only.

Texts are brought to a canonical form: lower case, curly quotes and dashes plain, copyright lines gone, equivalent
spellings made one, everything but letters and digits a single space. The SHA-256 of the whole canonical text is then
joined to the digests of known licences, canonicalised by the same functions; the same is done for each line, as a
licence is often named by a one-line notice, and there the known digests (a fixed list) are looked up in place.

Cases: null text has a null digest and no licence; the empty text, and one of punctuation or copyright lines only, has
the digest of nothing and no licence; very long texts and lines are canonicalised whole; a null doc_id is
kept; repeated rows stay rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import table

#: Characters and their plain forms, one for one.
PLAIN = ("“”‘’–— \r", "\"\"''-- \n")
#: (pattern, replacement) in order, on lower-case text; groups as \1.
RULES = [
    (r"(?m)^[ \t#*/;!%-]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$", ""),
    (r"\b(sub)?licenc(e|es|ed|ing|ee|ees|or|ors)\b", r"\1licens\2"),
    (r"\b(organ|author|util|recogn|initial|minim|maxim|optim|special|real)is(e|es|ed|er|ers|ing|ation|ations)\b", r"\1iz\2"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\b(non|sub|redis|war)-(commercial|license|tribut|rant)", r"\1\2"),
    (r"\bhttps://", "http://"),
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2 = _BSD.format("")
_BSD3 = _BSD.format("\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: (licence, text): whole licences, file headers and one-line notices.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", "SPDX-License-Identifier: ISC"), ("0BSD", _ZERO), ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("Zlib", "SPDX-License-Identifier: Zlib"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]


#: (licence, digest of its canonical text): whole licences too long to be held here, as they are published.
DIGESTS = [
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("Artistic-1.0-Perl", "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("LGPL-2.0", "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135"),
    ("LGPL-2.1", "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    c = F.lower(F.translate(text, *PLAIN))
    for pattern, to in RULES:
        c = F.regexp_replace(c, pattern, to.replace("\\1", "$1").replace("\\2", "$2"))
    return F.trim(c)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """license, digest of the known texts: the fixed lists, and of `more` (license, text) where it is given; one row a digest."""
    rows = spark.createDataFrame(KNOWN, "license string, text string")
    if more is not None:
        rows = rows.unionByName(more.select("license", "text"))
    rows = rows.select("license", digest(F.col("text")).alias("digest")).union(spark.createDataFrame(DIGESTS, "license string, digest string"))
    return rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license")).select("license", "digest")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), notices (licences of single lines, comma-joined in order).

    more: further known texts (license, text), of any number, for whole texts; lines are looked up in the fixed list.
    """
    spark = docs.sparkSession
    of = {r.digest: r.license for r in known(spark).collect()}  # a fixed list
    lookup = F.create_map(*[F.lit(x) for pair in sorted(of.items()) for x in pair])
    table_ = known(spark, more)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t"))
    line = F.transform(F.filter(F.split(F.translate("_t", "\r", "\n"), "\n"), lambda x: F.length(x) > 0), lambda x: F.element_at(lookup, digest(x)))
    rows = rows.select("doc_id", digest(F.col("_t")).alias("digest"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(line)), ","), F.lit("")).alias("notices"))
    hit = table_.select(F.col("digest").alias("_d"), "license")
    hit = F.broadcast(hit) if more is None else hit  # more of them join by size
    return rows.join(hit, rows["digest"] == hit["_d"], "left").select("doc_id", "digest", "license", "notices")


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(x: str) -> str:
    plain = "".join(f"chr({ord(c)}) || " for c in PLAIN[0])[:-4], "".join(f"chr({ord(c)}) || " for c in PLAIN[1])[:-4]
    c = f"lower(translate({x}, {plain[0]}, {plain[1]}))"
    for pattern, to in RULES:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"sha256(trim({c}))"


_DIGESTS = ", ".join(f"('{a}', '{d}')" for a, d in DIGESTS)
_VALUES = ", ".join("('{}', '{}')".format(a, t.replace("'", "''")) for a, t in KNOWN)
ORACLES = {
    "op6_license": f"""
WITH k AS (SELECT DISTINCT license, {_sql('text')} digest FROM (VALUES {_VALUES}) v(license, text) UNION SELECT license, digest FROM (VALUES {_DIGESTS}) w(license, digest)),
 d AS (SELECT row_number() OVER () r, doc_id, text FROM documents),
 l AS (SELECT r, {_sql('x')} dg FROM (SELECT r, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) x FROM d) WHERE length(x) > 0),
 n AS (SELECT r, string_agg(license, ',' ORDER BY license) notices FROM (SELECT DISTINCT r, license FROM l JOIN k ON l.dg = k.digest) GROUP BY r)
SELECT doc_id, {_sql('d.text')} AS digest, license, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON {_sql('d.text')} = k.digest LEFT JOIN n ON d.r = n.r"""
}
QUERIES = {"op6_license": op6_license}
