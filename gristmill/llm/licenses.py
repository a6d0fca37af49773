"""Licence scans by canonical digest lookup, in DataFrame functions only.

The canonical form of a text lower-cases A-Z, drops copyright lines, writes equivalent spellings one way and
turns every run of punctuation and blanks into one space. The SHA-256 of a whole canonical text is joined to
the digests of known licence texts; the digest of each single line is looked up among known one-line notices.
The known tables are fixed and small (`TEXTS`, `NOTICES`, or the caller's own); document texts never shuffle.

`TEXTS` holds the short permissive licences. Long ones (Apache, GPL, MPL, CC legal codes) are known by their notices
and identifiers only; a caller who has their texts passes them as `texts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence texts, without their copyright lines and placeholders.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEXTS = {
    "MIT": _MIT,
    "MIT-0": _MIT.replace(""", subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""", "."),
    "Unlicense": _UNLICENSE,
    "Zlib": _ZLIB,
    "BSL-1.0": _BSL,
    "ISC": _ISC,
    "0BSD": _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
}
#: One-line notices that name a licence.
NOTICES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense"],
    "Zlib": ["SPDX-License-Identifier: Zlib"],
}
#: Spellings that mean the same, and the one that stands for them.
SPELLINGS = {"licence": "license", "acknowledgement": "acknowledgment", "fulfilment": "fulfillment", "favour": "favor", "organisation": "organization", "https:": "http:"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright line begins with the word or the mark and goes on with a year, the mark, "by" or a colon; so a licence's
#: own sentences, wrapped before "copyright holders", stay. So does "all rights reserved" alone on a line.
_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:(?:copyright[ \t:]*(?:\(c\)|©|by[ \t]|[0-9]{4})|copyright:|\(c\)[ \t]*(?:copyright|by[ \t]|[0-9]{4})|©)[^\n]*|all rights reserved[^a-z0-9\n]*)$"
_MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F©“”‘’«»–—•…]+"


def lines(text: Column) -> Column:
    """The non-empty lines of a text in canonical form; none for null and empty text."""
    out = F.translate(text, _UPPER, _LOWER)
    out = F.regexp_replace(out, _COPYRIGHT, "")
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.split(F.regexp_replace(out, _MARKS, " "), "\n", -1)
    return F.coalesce(F.filter(F.transform(out, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known(spark, texts: dict[str, str]) -> DataFrame:
    """license_id and digest of each known text."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, body string")
    return rows.select(digest(F.array_join(lines(F.col("body")), " ")).alias("digest"), "license_id")


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", texts: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row of `docs`: the id, canonical_sha256, license_id (of the known text that the whole text equals, else
    null) and notices (licences that single lines name, sorted, comma-joined; '' for none).

    Null and empty texts have the digest of the empty text and match nothing; repeated rows each get their row."""
    spark = docs.sparkSession
    names = [(k, v) for k, vs in sorted((NOTICES if notices is None else notices).items()) for v in vs]
    line = F.array_join(lines(F.col("body")), " ")
    told = spark.createDataFrame(names, "license_id string, body string").select(digest(line).alias("digest"), F.length(line).alias("n"), "license_id").distinct().collect()
    longest = max((r["n"] for r in told), default=0)
    by_digest = F.create_map(*(F.lit(x) for r in told for x in (r["digest"], r["license_id"])))
    canonical = docs.select(F.col(doc_id).alias("doc_id"), lines(F.col(text)).alias("lines"))
    short = F.filter("lines", lambda x: F.length(x) <= longest)
    named = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(short, lambda x: F.element_at(by_digest, digest(x))), lambda x: x.isNotNull()))), ",")
    out = canonical.select("doc_id", digest(F.array_join("lines", " ")).alias("digest"), named.alias("notices"))
    whole = F.broadcast(known(spark, TEXTS if texts is None else texts))  # one row a known text
    return out.join(whole, "digest", "left").select(F.col("doc_id").alias(doc_id), F.col("digest").alias("canonical_sha256"), "license_id", "notices")


def oracle_sql() -> str:
    """The same query in SQL, over `documents`."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    body = f"translate(body, '{_UPPER}', '{_LOWER}')"
    body = f"regexp_replace({body}, {quote(_COPYRIGHT)}, '', 'g')"
    for a, b in SPELLINGS.items():
        body = f"replace({body}, {quote(a)}, {quote(b)})"
    split = f"list_filter(list_transform(string_split(regexp_replace({body}, {quote(_MARKS)}, ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    rows = lambda items: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in items)
    return f"""
with t(license_id, body) as (values {rows(TEXTS.items())}), n(license_id, body) as (values {rows((k, v) for k, vs in NOTICES.items() for v in vs)}),
known as (select license_id, sha256(array_to_string({split}, ' ')) as digest from t),
told as (select distinct license_id, array_to_string({split}, ' ') as line from n),
d as (select doc_id, coalesce({split}, []) as lines from (select doc_id, text as body from documents)),
named as (select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices from (select doc_id, unnest(lines) as line from d) join told using (line) group by doc_id)
select doc_id, sha256(array_to_string(lines, ' ')) as canonical_sha256, license_id, coalesce(notices, '') as notices
from d left join known on digest = sha256(array_to_string(lines, ' ')) left join named using (doc_id)
"""
