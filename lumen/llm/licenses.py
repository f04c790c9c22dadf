"""Operator 8: licence scan by canonical digests. DataFrame functions only.

A text is brought to a canonical form: lower case, without copyright lines, one spelling for words that licence
matching treats as equal, no punctuation, single spaces. The SHA-256 of the whole canonical text and of each of its
lines is joined with the digests of known licence texts.

Defined results: a null text is empty and matches nothing; every row gives one row, repeated and null ids too; a line
that is found twice counts twice in n_license_lines; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.plans.durable import stored

#: Notices of well-known licences as they are usually written.
KNOWN = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Spellings that licence matching treats as equal.
SPELLINGS = {"licenc": "licens", "organis": "organiz", "favour": "favor", "per cent": "percent", "copyright holder": "copyright owner", "acknowledgement": "acknowledgment", "non-commercial": "noncommercial", "sub-licens": "sublicens"}
#: Fixed values: (license, usual title, text) of short licences and headers; known with the title before it and without.
TEXTS = [
    ('MIT', 'MIT License', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ('MIT', 'The MIT License (MIT)', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ('ISC', 'ISC License', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ('BSD-2-Clause', 'BSD 2-Clause License', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ('BSD-2-Clause', 'BSD 2-Clause License', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ('BSD-3-Clause', 'BSD 3-Clause License', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ('BSD-3-Clause', 'BSD 3-Clause License', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. * Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ('Apache-2.0', 'Apache License 2.0', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
]
#: Canonical digests of the full texts of long licences, in their usual lines.
DIGESTS = {
    "Apache-2.0": "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100",
    "GPL-2.0": "5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a",
    "GPL-3.0": "cb5f59a029e32a15e38100789cb143d107c2bceba85f0885e3c5261b3161bd1f",
    "LGPL-2.1": "775b78fea7d86d7b01dfe3028892476b10fc3f78b22fd69513911710f16d8da6",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    "MPL-1.1": "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
}
#: Names in notices. Each is known after the usual verbs, and its key in the SPDX form.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"], "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "MPL-1.1": ["Mozilla Public License 1.1"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC0-1.0": ["CC0 1.0"], "Unlicense": ["Unlicense"],
}
COPYRIGHT = "(^|\\n)[^\\p{L}\\p{N}\\n]*(copyright|\\(c\\)|©)[^\\n]*"
#: Known digests beyond this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000


def canonical_lines(text: Column) -> Column:
    """The canonical lines that are not empty."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "$1")
    for a, b in SPELLINGS.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, "[^\\p{L}\\p{N}\\n]+", " ")
    return F.filter(F.transform(F.split(x, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def notices() -> list[tuple[str, str]]:
    """(license, notice) of all that is known besides DIGESTS."""
    out = [*KNOWN.items(), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')]
    for license, names in NAMES.items():
        out += [(license, f"SPDX-License-Identifier: {license}")]
        for start in ("Licensed", "Released", "Distributed", *(f"This {x} is {y}" for x in ("project", "software", "work", "file") for y in ("licensed", "released", "distributed"))):
            out += [(license, f"{start} under {the}{name}") for the in ("", "the ") for name in names]
    for license, title, text in TEXTS:
        out += [(license, text), (license, f"{title}\n{text}")]
    return out


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of the canonical form of each known text; by default of all notices, with DIGESTS."""
    rows = spark.createDataFrame(list(known.items()) if known else notices(), "license string, text string")
    rows = rows.select("license", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"))
    return rows if known else rows.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license string, digest string"))


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_sha256 (canonical), license (that the whole text is; else null), n_license_lines, line_licenses."""
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.groupBy("digest").agg(F.min("license").alias("license"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(docs[doc_id].alias("doc_id"), canonical_lines(docs[text]).alias("lines"))
    rows = stored(rows.select(
        F.expr("uuid()").alias("row"), "doc_id", F.sha2(F.array_join("lines", " "), 256).alias("text_sha256"),
        F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))).alias("lines")))
    units = rows.select("row", F.explode(F.concat(
        F.transform("lines", lambda x: F.struct(F.lower(F.hex(x)).alias("digest"), F.lit(False).alias("whole"))),
        F.array(F.struct(F.col("text_sha256").alias("digest"), F.lit(True).alias("whole"))))).alias("u")).select("row", "u.digest", "u.whole")
    hits = units.join(known, "digest").groupBy("row").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"), F.count_if(~F.col("whole")).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("line_licenses"))
    return rows.select("row", "doc_id", "text_sha256").join(hits, "row", "left").select(
        "doc_id", "text_sha256", "license", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def scan_sql() -> str:
    """The same in DuckDB's SQL, over documents with different ids."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    texts = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in notices())
    digests = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in DIGESTS.items())
    form = "regexp_replace(lower(coalesce(text, '')), '(^|\\n)[^\\p{L}\\p{N}\\n]*(copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
    for a, b in SPELLINGS.items():
        form = f"replace({form}, {quoted(a)}, {quoted(b)})"
    form = f"list_filter(list_transform(string_split(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"""
WITH known AS (SELECT min(license) AS license, digest FROM (SELECT license, sha256(array_to_string({form}, ' ')) AS digest FROM (VALUES {texts}) v(license, text)
  UNION ALL SELECT * FROM (VALUES {digests}) v(license, digest)) GROUP BY digest),
d AS (SELECT doc_id, {form} AS lines FROM documents),
w AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_sha256 FROM d),
l AS (SELECT doc_id, license FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest)),
g AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS found FROM l GROUP BY 1)
SELECT w.doc_id, text_sha256, license, coalesce(n, 0) AS n_license_lines, coalesce(found, '') AS line_licenses
FROM w LEFT JOIN known ON digest = text_sha256 LEFT JOIN g ON g.doc_id = w.doc_id
"""
