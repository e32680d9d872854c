"""Licence scans by canonical digest, in built-in expressions.

A text is brought to a canonical form: lower case, without copyright lines, without punctuation, words of equivalent
spelling made one. Whole texts are looked up by the digest of that form in a table of known licences, which may hold texts
or, for long ones, digests alone. Lines that mention a licence are looked up the same way among known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that licence texts use for one another, spelled as on the right.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: Whole texts of known licences.
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
LICENCES["Unlicense"] = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
LICENCES["BSD-3-Clause"] = LICENCES["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", f"{_THIRD}\n\nTHIS SOFTWARE IS PROVIDED")

#: Titles above published texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License"],
}

#: Canonical digests of long licences, as published whole in plain text.
DIGESTS = {
    "Apache-2.0": ["f5c47c90353103b1d90e3acddc15b332dab82b6dfd8f262e29d501ba8cb47d21"],
    "Artistic-1.0": ["df5112a5044a37bae26eb65c864696a0495de64523f3013f0e463fdf828a7bcf"],
    "CC0-1.0": ["85ecef89c0122e868b86bc7a79554a2fb3820f078c8a08fff28ee2c887322762"],
    "GFDL-1.2": ["c451b790aa73e4852fab190de773a491fc4b0b4eb325658e018fdde714b0090b"],
    "GFDL-1.3": ["6524bed4ba8b75085bd65a4dc4c57049c10ff83ccfe91252e99030c6f712cd2e"],
    "GPL-1.0": ["681b26fd1b64491cd4180e979055cc3975dfcee687db788b5b5db9a412e2df49"],
    "GPL-2.0": ["f4ddbd240d18264236442ffe123799c3ca11186c744ca33e78976b6111dbd44f"],
    "GPL-3.0": ["b2ac68bce942bc6215543ed71771c9842d216ca8aeacfab909a6516342209813"],
    "LGPL-2.0": ["c6e6b0a0ce4ab489489f5ad3185cf82033a795e32ab6c4ab311b49928cd3c683"],
    "LGPL-2.1": ["509a0466853f728518479e10c0b839140f7440e8ea7bd892fb11de7a27ce69ff"],
    "LGPL-3.0": ["1857db73f9412dbec47942f7abc52681d05e566c78c44eeafffc69a4ce796042"],
    "MPL-1.1": ["dbe46e5d8b387387dd18e2a708d1af4af7014aa6cab60c78c07450a4cd6beb33"],
    "MPL-2.0": ["0eddc56545c945b1fb5de02f17fc5ca484ee9a1b24932ae9a60628b570000094"],
}

#: Names of licences as notices give them, besides the ids and titles above.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

#: How a notice begins before the name.
OPENINGS = [
    "Licensed under", "Released under", "Distributed under", "Published under", "Available under", "This work is licensed under",
    "This project is licensed under", "This software is licensed under", "SPDX-License-Identifier:",
]


def notices(names: dict[str, list[str]]) -> dict[str, list[str]]:
    """One-line notices by licence: every opening with every name, with and without "the"."""
    return {
        licence: [f"{opening} {article}{name}" for opening in OPENINGS for name in dict.fromkeys([*own, licence]) for article in ("", "the ")]
        for licence, own in names.items()
    }


#: The notices known by default: of every licence above by its id, its titles and its names.
NOTICES = notices({k: [*TITLES.get(k, []), *NAMES.get(k, [])] for k in [*TITLES, *NAMES]})

#: A copyright statement in a line of its own. "Copyright" before one of these words is a wrapped line of the licence itself.
_BODY = "notices?|holders?|owners?|licen[cs]es?|laws?|statements?|and|or|in|to|of|is|are|as"
_COPYRIGHT = (
    rf"(?md)^[^a-z0-9\n]*(?:copyright\b(?=[^\n]*[\p{{L}}\p{{N}}])(?![^\p{{L}}\p{{N}}\n]*(?:{_BODY})\b)|\(c\)|©|all rights reserved)[^\n]*$"
)


def canonical(text: Column) -> Column:
    """Canonical form of a text: words with single spaces; empty for null, for empty texts and for copyright lines alone.

    A line is a copyright line if it begins with the word or sign, after anything but letters a-z and digits, and a year, (c)
    or a holder follows the word, so that a wrapped line "copyright notice and this ..." stays. Hyphens,
    apostrophes and soft hyphens vanish, so that "sub-license" is "sublicense"; all other punctuation separates words.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "")
    joined = F.regexp_replace(plain, "[-‐‑­'’]", "")
    words = F.split(F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " ")), " ")
    same = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(same[w], w)), " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: dict[str, list[str]], digests: dict[str, list[str]] | None = None) -> DataFrame:
    """`known_digest`, `licence`: one row per canonical form of the texts and digests by licence, the first licence by name."""
    texts_of, digests_of = ([(k, x) for k, of in d.items() for x in of] for d in (texts, digests or {}))
    told = spark.createDataFrame(texts_of, "licence string, text string").select(digest(F.col("text")).alias("known_digest"), "licence")
    given = spark.createDataFrame(digests_of, "licence string, known_digest string").select("known_digest", "licence")
    return told.union(given).groupBy("known_digest").agg(F.min("licence").alias("licence"))


def built_in() -> dict[str, list[str]]:
    """The short licences, bare and under each of their titles."""
    return {k: [text, *[f"{t}\n\n{text}" for t in TITLES.get(k, [])]] for k, text in LICENCES.items()}


def scanned(
    docs: DataFrame, licences: dict[str, list[str]] | None = None, digests: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None, text_col: str = "text"
) -> DataFrame:
    """All columns of `docs` plus the struct `scan`: `canonical_sha256` of the whole text, `licence` if that is a known
    licence, `notices`: ids of the known notices among the text's lines, each once and sorted.

    The three tables are parameters, texts, canonical digests and notice lines by licence; those of a caller replace the
    built-in ones. They are lists on the driver, and broadcast. A null text counts as empty and matches nothing, as does a text
    of copyright lines alone. Of known texts with one canonical form the first id by name is given. Repeated rows are scanned
    each. A column `scan` of `docs` is replaced.
    """
    spark = docs.sparkSession
    whole = known(spark, built_in() if licences is None else licences, (DIGESTS if licences is None else {}) if digests is None else digests)
    lines = known(spark, NOTICES if notices is None else notices)
    notice_of = F.create_map(*[F.lit(x) for r in lines.collect() for x in (r["known_digest"], r["licence"])]) if lines.count() else F.lit(None).cast("map<string,string>")
    own = [c for c in docs.columns if c != "scan"]
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    naming = F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)licen[cs]"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")).withColumns(
        {"canonical_sha256": digest(text), "seen": F.transform(naming, digest)}
    )
    found = F.array_sort(F.array_distinct(F.filter(F.transform("seen", lambda d: notice_of[d]), lambda x: x.isNotNull())))
    return rows.join(F.broadcast(whole), F.col("canonical_sha256") == F.col("known_digest"), "left").select(
        "row.*", F.struct("canonical_sha256", "licence", found.alias("notices")).alias("scan")
    )
