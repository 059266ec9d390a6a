"""License scans: canonical digest lookup of entire texts, and of single lines for short notices."""

from __future__ import annotations

import csv
import hashlib
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, small_side, stored
from .exact import ascii_lower

# Published licence texts and notices, and one-line statements of a licence (see TEXTS).
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>
"""
#: Identifier and text; several texts may share an identifier.
TEXTS = (
    ("MIT", MIT),
    ("MIT", MIT.split("\n", 1)[1]),
    ("ISC", ISC),
    ("ISC", ISC.split("\n", 1)[1]),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Unlicense", UNLICENSE),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
)
#: Spellings held to be equal, once case and punctuation are gone.
SPELLINGS = (
    (r"\b(sub)?licenc(e|es|ed|ing)\b", "$1licens$2"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bnon ?commercial\b", "noncommercial"),
    (r"\bnon ?infringement\b", "noninfringement"),
    (r"\b(organ|author|recogn)is(e|es|ed|ing|ation)\b", "$1iz$2"),
    (r"\b(judg|acknowledg)ement", "$1ment"),
    (r"\bhttps\b", "http"),
)
# end of fixed values

COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*"
COPYRIGHT_NEEDS = ("copyright", "(c)", "©", "all rights reserved")
#: Of each spelling in turn, texts of which one must occur for it to apply.
NEEDED = (("licenc",), ("copyright owner",), ("commercial",), ("infringement",), ("organis", "authoris", "recognis"), ("judgement", "acknowledgement"), ("https",))
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spelled(texts: Column) -> Column:
    """An array of texts with their spellings united; a pattern is tried only where what it needs occurs."""
    for (pattern, to), needed in zip(SPELLINGS, NEEDED, strict=True):
        texts = F.transform(texts, lambda x: F.when(_any(x, needed), F.regexp_replace(x, pattern, to)).otherwise(x))  # noqa: B023  called at once
    return texts


def _any(text: Column, needed: tuple) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(n)) for n in needed))


def canonical_lines(text: Column) -> Column:
    """The lines of a text in lower case (A-Z), copyright lines and blank ones gone, runs of ASCII punctuation and blanks as one space.

    Joined by spaces, and with spellings united, they are the text's canonical form; see canonical_text.
    """
    lines = F.transform(F.split(text, "\n"), ascii_lower)
    lines = F.transform(lines, lambda x: F.when(_any(x, COPYRIGHT_NEEDS), F.regexp_replace(x, COPYRIGHT_LINE, "$1")).otherwise(x))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, PUNCTUATION, " ")))
    return F.filter(lines, lambda x: x != "")


def canonical_text(text: str) -> str:
    """The canonical form of one text in Python; used for the known licences."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    text = re.sub(COPYRIGHT_LINE, r"\1", text, flags=re.ASCII)
    text = re.sub(PUNCTUATION, " ", text)
    for pattern, to in SPELLINGS:
        text = re.sub(pattern, lambda m, to=to: re.sub(r"\$(\d)", lambda g: m[int(g[1])] or "", to), text, flags=re.ASCII)
    return text.strip(" ")


def _listed() -> tuple[tuple[str, str, int], ...]:
    """Identifier, digest and length of the canonical forms in license_digests.tsv, too long to hold here."""
    with Path(__file__).with_name("license_digests.tsv").open(encoding="utf-8") as file:
        return tuple((r["license_id"], r["canonical_sha256"], int(r["canonical_chars"])) for r in csv.DictReader(file, delimiter="\t"))


#: The longer licences: digests of full texts and notices, where each was taken from being in the file.
DIGESTS = _listed()


def known_digests(texts=TEXTS, digests=DIGESTS) -> dict[str, str]:
    """SHA-256 of each known text's canonical form, to its identifier."""
    return {d: name for name, d, _ in digests} | {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, t in texts}


def scan_licenses(docs: DataFrame, texts=TEXTS, digests=DIGESTS) -> DataFrame:
    """doc_id, canonical_sha256, license_id and notices for every row of docs (doc_id, text; others are ignored).

    license_id names the known licence whose canonical text is the whole of the document's, or is null; notices
    lists, sorted and without repeats, the licences whose canonical text is one line of the document. Both come from
    one hash join of digests each with the known ones, tables in code, so that their broadcast is bounded by them. Null
    and blank texts have the digest of the empty text and match nothing. Repeated rows stay. An empty table gives no
    rows. Documents are read once; written are digests, of the whole text and of those lines whose length is that
    of a known text. No text is shuffled.
    """
    known = known_digests(texts, digests)
    known.pop(hashlib.sha256(b"").hexdigest(), None)
    pairs = [F.struct(F.lit(d).alias("digest"), F.lit(name).alias("license_id")) for d, name in (known or {"": ""}).items()]
    table = F.broadcast(docs.sparkSession.range(1).select(F.inline(F.array(*pairs))))
    lengths = sorted({len(canonical_text(t)) for _, t in texts} | {n for *_, n in digests}) or [0]
    # uniting spellings adds at most one character to fifteen and takes at most one of five
    near = F.filter("lines_", lambda x: F.length(x).between(lengths[0] * 15 // 16, lengths[-1] * 5 // 4))
    # only the digest of a line of a known length can be known
    near = F.filter(_spelled(near), lambda x: F.length(x).isin(*lengths))
    whole = _spelled(F.array(F.array_join("lines_", " ")))[0]
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.coalesce(F.col("text"), F.lit(""))).alias("lines_"))
        .select("doc_id", F.sha2(whole.cast("binary"), 256).alias("digest"), F.array_distinct(F.transform(near, lambda x: F.sha2(x.cast("binary"), 256))).alias("of_lines"))
        .withColumn("row", F.xxhash64("doc_id", "digest", "of_lines"))
    )
    found = rows.select("row", F.explode("of_lines").alias("digest")).join(table, "digest").groupBy("row").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    none = F.array().cast("array<string>")
    return (
        rows.drop("of_lines").join(table, "digest", "left").join(small_side(stored(found)), "row", "left")
        .select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", F.coalesce("notices", none).alias("notices"))
    )
