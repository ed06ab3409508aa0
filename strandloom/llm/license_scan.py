"""License scans by canonical digest lookup, with DataFrame functions only.

A text is brought to a canonical form (lower case; lines that are a copyright notice as a whole dropped; equivalent
spellings made one; everything but letters and digits one space), digested whole, and looked up
among the digests of known licence texts, which went through the same expressions. Equal digests
mean equal canonical texts, whole text against whole text: a licence inside a longer document is not
a match.

Edge cases: a null text has a null digest and matches nothing; a text without letters or digits
counts as empty, has the digest of the empty string and matches nothing; repeated rows each give a
row; a null id is carried along; an empty table gives no rows; a very long text goes through the
expressions whole, a row by itself; extra columns of the input are not read unless asked for by
``keep``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts, without their copyright lines where they carry one.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence id, text): the texts that are looked for. Documents only match as a whole.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_TAIL}"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

#: The whole canonical form, as (pattern, replacement) in order, on lower-cased text. The patterns
#: only use what Java's and RE2's syntax share, so SQL can check them. The spellings
#: that licence matching guidelines treat as the same word.
RULES: list[tuple[str, str]] = [
    (r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*", r"\1"),
    (r"[^\p{L}\p{N}]+", " "),
    (r"\b(sub ?)?licen[cs](e|ed|es|ing|or|ee)\b", r"\1licens\2"),
    (r"\bsub licens", "sublicens"),
    (r"\b(non) (commercial|infringement|exclusive)", r"\1\2"),
    (r"(organ|author|recogn|util|initial|custom|final|real|capital|general)is(e|ed|es|ing|ation|ations)\b", r"\1iz\2"),
    (r"\b(favo|behavio|hono|colo|labo)ur", r"\1r"),
    (r"\b(acknowledg|judg)ement", r"\1ment"),
    (r"\b(fulfil|instal|cancel|label)(l?)(ed|ing|ment)\b", r"\1\3"),
    (r"\bwhilst\b", "while"),
    (r"\bcopyright (owner|holder)(s?)\b", r"copyright holder\2"),
    (r"\bhttps?\b", "http"),
]


#: Words of statements: a line that begins like a notice and holds one of them is a term, not a notice.
STATEMENTS = "is|are|was|were|be|may|must|shall|should|can|cannot|will|would|do|does|not|no|never|only|if|unless|without|except|you|your|owe|pay|use|uses|used|using|forbidden|prohibited|permitted|allowed|required|granted|subject|provided|agree|this|that|these|any|all(?! rights reserved)"
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "inc|ltd|corp|co|jr|sr|dr|mr|ms|st|univ|dept|al"
_RIGHTS = r"all rights reserved"

#: What Spark applies in place of the first rule. A line is a notice only as a whole: a copyright sign or the word,
#: then years and holders (160 characters at most), perhaps 'all rights reserved' there or on the next line. A line
#: with a word of ``STATEMENTS``, with a second sentence, or that goes on as a licence's own text does when it is
#: wrapped ('copyright notice', 'copyright holders') stays. RE2 has no lookahead, so SQL keeps the first rule; both
#: agree on texts without such lines.
NOTICES: list[tuple[str, str]] = [
    (
        r"(^|\n)[^\p{L}\p{N}\n(©]*(?:copyright(?![\p{L}\p{N}])|\(c\)|©)(?!s?\s+(?:notice|holder|owner|licen[cs]e|law|interest|statement)s?\b)"
        rf"(?![^\n]*\b(?:{STATEMENTS})\b)(?![^\n]*\b(?!(?:{ABBREVIATIONS})\b)\p{{L}}{{2,}}[.;!?]+[ \t]+(?!{_RIGHTS})[\p{{L}}]{{2}})"
        rf"[^\n]{{0,160}}(?=\n|$)(\n[^a-z0-9\n]*{_RIGHTS}[^a-z0-9\n]*(?=\n|$))?",
        r"\1",
    ),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    out = F.lower(text)
    for pattern, by in NOTICES + RULES[1:]:
        out = F.regexp_replace(out, pattern, _java(by))
    return F.trim(out)


def _java(replacement: str) -> str:
    return replacement.replace("\\", "$")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id), a row for each canonical text; its rows are those of the constant list,
    so it may be broadcast."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "license_id string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(documents: DataFrame, known: list[tuple[str, str]] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``digest`` (SHA-256 of the canonical text, hexadecimal) and
    ``license_id`` (null where the whole text is no known licence). One pass over the rows; the
    other side is the constant list, so neither a hot text nor a hot licence gathers anywhere."""
    spark = documents.sparkSession
    rows = documents.select(*keep, F.sha2(canonical(F.col(text)), 256).alias("digest"))
    return rows.join(F.broadcast(known_digests(spark, known)), "digest", "left").select(*keep, "digest", "license_id")


# ---------------------------------------------------------------- query and SQL


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(col: str) -> str:
    out = f"lower({col})"
    for pattern, by in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(i) AS license_id FROM (VALUES {rows}) k(i, t) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license_id FROM (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents) d LEFT JOIN known k USING (digest)"""


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE_SQL = {"op10_license_scan": _sql()}
