"""License scan by canonical digests of units and of runs of words.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white
space) and its digest is looked up among the digests of known licence texts. The
looked-up units are each whole document and each of its lines: a unit matches only if
its entire text equals a known one after normalisation. Known texts of ``RUN`` words or
more are also found wherever they stand in a document, however its lines are broken: as
runs of normalised words with equal 128 hash bits.
"""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm._shared import bounded_batches, read
from lamella.llm._words import word_hashes
from lamella.llm.line_dedup import _hash, _lanes

RUN = 20
LONG_BYTES = 64_000_000
HEAD = 8  # words of a run by which candidates are found

# Spellings that licence matching treats as equal (right becomes left).
SPELLINGS = {
    "license": "licence", "acknowledgment": "acknowledgement", "analog": "analogue", "analyze": "analyse", "authorization": "authorisation",
    "authorized": "authorised", "center": "centre", "copyright holder": "copyright owner", "favor": "favour", "fulfil": "fulfill",
    "initialize": "initialise", "judgment": "judgement", "labeling": "labelling", "noncommercial": "non-commercial", "organization": "organisation",
    "organize": "organise", "recognized": "recognised", "https:": "http:",
}

# Notices, and short licence texts. TEXTS below has the long ones.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies."
)
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
]

_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAME = (
    "{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


# Short licences as (id, title, text), and the notices that long ones ask to be put into each file.
SHORT = [
    ("0BSD", "BSD Zero Clause License",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("Unlicense", "The Unlicense",
     "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
     "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, "
     "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public "
     "at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
     "this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
     "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "zlib License",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
     "acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented "
     "as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003",
     "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
     "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
     "Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this "
     "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
     "derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
     "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
     "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
     "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Notice",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
     "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((f"{i}-or-later" if later else i, "Notice",
       f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} "
       f"either version {version} of the License, or (at your option) any later version.")
      for i, name, version, mark, comma, later in (("GPL-2.0", "General Public License", "2", ";", ";", True), ("GPL-3.0", "General Public License", "3", ":", ",", True),
                                                   ("AGPL-3.0", "Affero General Public License", "3", ":", ",", True), ("LGPL-3.0", "Lesser General Public License", "3", ":", ",", True))),
    ("MPL-2.0", "Notice",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def _forms(text: str) -> list[str]:
    """A licence file with and without its title, and with and without what follows its terms."""
    blocks = text.strip().split("\n\n")
    k = next(i for i, b in enumerate(blocks) if len(b.split()) >= RUN)
    wholes = [text, "\n\n".join(blocks[k:])]
    return wholes + [w.split("END OF TERMS AND CONDITIONS")[0] + end for w in wholes for end in ("", "END OF TERMS AND CONDITIONS") if "END OF TERMS AND CONDITIONS" in w]


def texts() -> list[tuple[str, str]]:
    """Whole licence texts: (id, text), some in several forms."""
    out = [(p.stem, form) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")) for form in _forms(p.read_text("utf-8"))]
    short = [*((i, title, text) for i, title, text in SHORT), ("MIT", "MIT License", _MIT), ("MIT", "The MIT License", _MIT), ("MIT", "The MIT License (MIT)", _MIT), ("ISC", "ISC License", f"{_ISC}\n\n{_ISC_END}")]
    for marks in (("", "", ""), ("1. ", "2. ", "3. ")):
        short.append(("BSD-2-Clause", "BSD 2-Clause License", (_BSD + _BSD_END).format(*marks[:2])))
        short.append(("BSD-3-Clause", "BSD 3-Clause License", (_BSD + _BSD_NAME + _BSD_END).format(*marks)))
    return out + [(i, form) for i, title, text in short for form in (text, f"{title}\n\n{text}")]


# A copyright line begins with the word or sign and names a year or repeats the sign; licence terms that happen
# to begin a line with "copyright" (as in COPYRIGHT HOLDERS BE LIABLE) are no such line.
_COPYRIGHT = r"(^|\n)[ \t]*((copyright|\(c\)|©)[^\n]*([0-9]{4}|<year>|\[yyyy\]|\(c\)|©)|all rights reserved)[^\n]*"
_NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The comparable form of a text; empty if nothing but notices and marks is left."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    for one, other in SPELLINGS.items():
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(out, _NOT_WORD, " "))


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + texts(), "license_id string, text string")


def _find_runs(known: list):
    """(doc_id, digest, license_id, whole) of the known texts in canonical documents; one inside a longer one does not count."""
    by_head = defaultdict(list)
    for license_id, text, digest in known:
        for _, _, words, _ in word_hashes(pa.array([text])):
            n = np.array([len(words)])
            a, b = _lanes(words, np.array([0]), n)
            by_head[_hash(words, np.array([0]), np.array([HEAD]))[0]].append((len(words), a[0], b[0], license_id, bytes(digest)))
    heads = np.array(sorted(by_head), np.uint64)

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for first, _, words, offsets in word_hashes(batch.column(1)):
                begin = np.arange(max(0, len(words) - HEAD + 1))
                head = _hash(words, begin, begin + HEAD)
                starts = np.flatnonzero(np.isin(head, heads))
                row = np.searchsorted(offsets, starts, side="right") - 1
                tries = [(s, s + k[0], r, k) for s, r in zip(starts, row) for k in by_head[head[s]] if s + k[0] <= offsets[r + 1]]
                if not tries:
                    continue
                a, b = _lanes(words, np.array([t[0] for t in tries]), np.array([t[1] for t in tries]))
                equal = [t for t, x, y in zip(tries, a, b) if t[3][1] == x and t[3][2] == y]
                reached = 0
                for s, e, r, k in sorted(equal, key=lambda t: (t[0], -t[1])):
                    if e > reached:
                        reached = e
                        rows.append(int(first + r))
                        found.append((k[4], k[3], bool(s == offsets[r] and e == offsets[r + 1])))
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["doc_id", "digest", "license_id", "whole"])

    return run


def license_scan(df: DataFrame, known: DataFrame | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document that has a licence: ``doc_id, licenses, n_units, whole_text``.

    ``licenses`` are the sorted distinct ids joined by commas, ``n_units`` the matching
    lines (a line repeated counts each time; a whole-text match counts once) and of runs
    that are neither, and ``whole_text`` whether the entire document is one licence. ``known`` has
    ``license_id, text``; of ids with one canonical text the smallest counts. The join
    is left to the planner: a short list of digests is broadcast by its size, a long one
    is shuffled by digest. Null and empty texts match nothing; rows that repeat an id
    are one document; an empty table gives an empty result; extra columns are not read. Known
    texts of RUN words or more are held by every task, so a list of over LONG_BYTES of them is refused.
    """
    known = known_table(df.sparkSession) if known is None else known
    bounded_batches(df.sparkSession)
    digests = known.select("license_id", canonical(F.col("text")).alias("c")).filter("c <> ''")
    digests = digests.groupBy(F.unhex(F.sha2("c", 256)).alias("digest"), "c").agg(F.min("license_id").alias("license_id"))
    long_texts = digests.filter(F.size(F.split("c", " ")) >= RUN).select("license_id", "c", "digest")
    size = long_texts.agg(F.sum(F.octet_length("c"))).first()[0] or 0
    if size > LONG_BYTES:
        raise ValueError(f"long known texts of {size} bytes; every task holds them, {LONG_BYTES} at most")
    long_ones = long_texts.collect()
    digests = digests.drop("c")
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x: _digest(x))
    whole = F.array(_digest(F.col(text_col)))
    units = F.when(F.instr(text_col, "\n") > 0, F.concat(whole, lines)).otherwise(whole)
    found = df.select(F.col(id_col).alias("doc_id"), F.posexplode(units).alias("place", "digest")).join(digests, "digest")
    found = found.select("doc_id", "digest", "license_id", (F.col("place") == 0).alias("whole"), F.lit(False).alias("run"))
    rows = df.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("c"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, license_id string, whole boolean"
    runs = rows.mapInArrow(_find_runs([tuple(r) for r in long_ones]), schema).withColumn("run", F.lit(True))
    n_whole, n_line, n_run = (F.count_if(x) for x in (F.expr("whole AND NOT run"), F.expr("NOT whole AND NOT run"), F.col("run")))
    n = n_whole + n_line + F.greatest(F.lit(0), n_run - F.greatest(n_whole, n_line))  # a run can be a line or the whole text
    each = found.union(runs).groupBy("doc_id", "digest", "license_id").agg(n.alias("n"), F.bool_or("whole").alias("whole"))
    return each.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"), F.sum("n").alias("n_units"), F.bool_or("whole").alias("whole_text")
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(canonical(text), 256))


def op3(spark, sf_dir):
    return license_scan(read(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{_COPYRIGHT}', '', 'g')"
    for one, other in SPELLINGS.items():
        out = f"replace({out}, '{other}', '{one}')"
    return f"trim(regexp_replace({out}, '{_NOT_WORD}', ' ', 'g'))"


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
QUERIES = {"op3_license_scan": op3}
ORACLE = {
    "op3_license_scan": f"""
    WITH known AS (SELECT {_sql_canonical("t")} AS c, min(i) AS license_id FROM (VALUES {_VALUES}) v(i, t) GROUP BY 1 HAVING c <> ''),
    units AS (
      SELECT doc_id, text AS u, 0 AS place FROM documents
      UNION ALL
      SELECT doc_id, unnest(string_split(text, chr(10))), 1 FROM documents WHERE contains(text, chr(10)))
    SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses, count(*) AS n_units, bool_or(place = 0) AS whole_text
    FROM units JOIN known ON {_sql_canonical("u")} = known.c GROUP BY doc_id"""
}
