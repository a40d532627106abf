"""License scans by canonical digest lookup.

A text is normalised (case, copyright notices, list markers, punctuation, equivalent spellings), and the digest of the entire
normalised text is joined to the digests of known texts: license texts, the headers by which the longer licenses are applied, and the
sentences that name a license. The texts looked up are every line of a document, every sentence in a line, and every run of consecutive lines,
so that a license of several paragraphs is found inside a longer document, too, with or without blank lines around it. Lines and sentences without any word of
a notice, and runs that do not open like a known text or with a copyright notice, are passed over before they are normalised. The known table is small by
construction (the lists below), so its broadcast is bounded.

Known by their whole text: MIT, ISC, BSD-2-Clause, BSD-3-Clause, Zlib, Unlicense, BSL-1.0, 0BSD, and as published (`LONG`) Apache-2.0, GPL-2.0, GPL-3.0, LGPL-2.1,
LGPL-3.0, MPL-2.0, CC0-1.0. By the header that applies them: Apache-2.0, GPL, LGPL, AGPL, MPL-2.0. All of these and the Creative Commons licenses: by
name, in a sentence of the forms below. A bare name is a notice only if it holds a version or the word license; "MIT" alone is none.

Defined cases: null and blank texts match nothing; a license found in several texts counts once for each, and once in a line; a run has two
lines at least; every row is a document, whether its id is null, repeated or not; texts are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.llm.common import ROW, broadcast_if_small, keyed, let, materialize

#: First words of known texts, where a copyright notice on the same line ends.
OPENINGS = (
    "permission is hereby", "permission to use", "redistribution and use", "licensed under the", "this program is", "this library is", "this file is",
    "this software is provided", "this is free", "this source code form", "boost software license",
)
_SIGN = r"(copyright[ \t]*(\(c\)|©)|copyright[ \t,]*(19|20)[0-9][0-9]|\(c\)[ \t]*(19|20)[0-9][0-9]|©)"
BEGINNERS = "work software program project file code document text content page package library article".split()
#: Normalising steps, in order: pattern and replacement.
STEPS = (
    (_SIGN + r"[^\n]*?(\n|" + "|".join(OPENINGS) + r"|$)", " $5"),
    (r"all rights reserved\.?", " "),
    (r"(^|\n)[^a-z0-9\n]*([0-9a-z]\)|[0-9]\.)[ \t]+", "$1"),  # behind the signs of a comment, too
    (r"https?://", " "),
    (r"[^a-z0-9]+", " "),
    (r"\b(sub ?)?licenc(e|es|ed|ing)\b", "$1licens$2"),
    (r"\bsub licens", "sublicens"),
    (r"\bcopyright (owner|holder)s?\b", "copyright holder"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\b(author|organ|util|real|recogn|initial)is(e|ed|es|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(behavi|fav|lab|hon)our", "$1or"),
    (r"\bwhilst\b", "while"),
    (r"\bwilful\b", "willful"),
    (r"\b(version|ver|v) ?([0-9])", "$2"),
    (r"\b([0-9]) 0\b", "$1"),
    (r"\b([0-9]) (international|unported|universal|generic)( public license)?\b", "$1"),
    (r"\bcreative commons zero\b", "cc0"),
    (r"\bcreative commons attribution\b", "cc by"),
    (r"\b(non commercial|noncommercial)\b", "nc"),
    (r"\b(share alike|sharealike)\b", "sa"),
    (r"\b(no derivatives|noderivatives|no derivs|noderivs)\b", "nd"),
    (r"\b(the )?gnu (lesser|library) general public license\b", "lgpl"),
    (r"\b(the )?gnu affero general public license\b", "agpl"),
    (r"\b(the )?gnu general public license\b", "gpl"),
    (r"\bgnu (l|a)?gpl\b", "$1gpl"),
    (r"\bunder the terms of\b", "under"),
    (r"\b(released|distributed|published|available|made available|provided|covered) (under|by)\b", "licensed under"),
    (r"\bunder the\b", "under"),
    (rf"^ ?(this|the) ({'|'.join(BEGINNERS)}) is licensed under\b", "licensed under"),
    (r" +", " "),
)

#: Names by which a notice may state a license (fixed values).
NOTICES = {
    "MIT": ("MIT", "MIT/Expat", "Expat"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2", "Apache-2.0", "ASL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "2-clause BSD", "Simplified BSD", "FreeBSD"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-clause BSD", "New BSD", "Modified BSD"),
    "ISC": ("ISC",),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL 3", "AGPLv3"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib", "zlib/libpng"),
    "BSL-1.0": ("Boost Software License 1.0", "BSL-1.0"),
    "0BSD": ("Zero-Clause BSD", "0BSD"),
}

#: Sentences that name a license, as they are left by the steps.
SENTENCES = ("{} license", "the {} license", "licensed under {}", "licensed under {} license", "license {}", "license {} license")

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_NO_WARRANTY = """This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details.

"""
_COPY = "You should have received a copy of the {0} along with this {1}. If not, see <https://www.gnu.org/licenses/>."
_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.\n\n"


def _header(thing: str, name: str, version: str) -> str:
    return _FREE.format(thing, name, version) + _NO_WARRANTY.format(thing, name) + _COPY.format(name, thing)


#: Whole license texts and the headers that apply the longer ones (fixed values).
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": _CONDITIONS + _DISCLAIMER,
    "BSD-3-Clause": _CONDITIONS
    + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
    + _DISCLAIMER,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0": _header("program", "GNU General Public License", "2"),
    "GPL-3.0": _header("program", "GNU General Public License", "3"),
    "LGPL-2.1": _header("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _header("library", "GNU Lesser General Public License", "3"),
    "AGPL-3.0": _header("program", "GNU Affero General Public License", "3"),
}
#: Letters of the first words of a long text by which a run is taken for a copy of it.
HEAD_LETTERS = 24
#: Whole texts of the longer licenses as published, without and with what is behind their terms (fixed values): least and most letters of its lines, normalised one
#: by one (line by line to word by word), first letters, digest of the normalised text, license id.
LONG = (
    (8199, 8363, "apachelicense2january200", "0cc04caad0d15cc9f74aa2d96ecc841f", "Apache-2.0"),
    (7345, 7491, "apachelicense2january200", "2f15986cdf74db20285804b86477174d", "Apache-2.0"),
    (13742, 14261, "gpl2june199151franklinst", "bc4535b78849be9f247a42743104f2f1", "GPL-2.0"),
    (11727, 12072, "gpl2june199151franklinst", "e8371a6211a37c34f809daf2d0f108ac", "GPL-2.0"),
    (27093, 27842, "gpl329june2007everyoneis", "4788b032d572e334b21da647a508f718", "GPL-3.0"),
    (25277, 25833, "gpl329june2007everyoneis", "df8ac9faae03c9793bcbb35b910ff91d", "GPL-3.0"),
    (20338, 20946, "lgpl21february199951fran", "0093d83680e14d3308a19f04898ff90d", "LGPL-2.1"),
    (18937, 19404, "lgpl21february199951fran", "859224ed77d40566e03068feb593c14b", "LGPL-2.1"),
    (5428, 5979, "lgpl329june2007everyonei", "e3c05a458ca17c9817964402efe91ed4", "LGPL-3.0"),
    (11577, 11966, "mozillapubliclicense2def", "4c595807e032edc06ed4deeda0abf4fe", "MPL-2.0"),
    (11033, 11420, "mozillapubliclicense2def", "4c7d7c22ef42e0356bb629b362a30dd1", "MPL-2.0"),
    (5532, 5664, "creativecommonslegalcode", "1d2a2969b791499c1ec949ae2339f3bd", "CC0-1.0"),
)
#: Titles that may stand above a text.
TITLES = ("{} License", "The {} License", "{}")


def canonical_text(text: str) -> str:
    out = text.lower()
    for pattern, by in STEPS:
        out = re.sub(pattern, by.replace("$", "\\"), out)
    return out.strip(" ")


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def known_texts() -> list[tuple[str, str]]:
    """(normalised text, license id) of every known text, each text once."""
    found: dict[str, str] = {}
    for ident, names in NOTICES.items():
        for name in names:
            plain = canonical_text(name)
            for sentence in SENTENCES:
                found.setdefault(sentence.format(plain), ident)
            if re.search(r"[0-9]|license", plain):
                found.setdefault(plain, ident)
        found.setdefault(canonical_text(f"SPDX-License-Identifier: {ident}"), ident)
    for ident, text in TEXTS.items():
        plain = canonical_text(text)
        found.setdefault(plain, ident)
        for name in NOTICES[ident]:
            for title in TITLES:
                found.setdefault(f"{canonical_text(title.format(name))} {plain}", ident)
                found.setdefault(f"{canonical_text(title.format(name))} {canonical_text(name)} {plain}", ident)  # "MIT License (MIT)"
    return list(found.items())


def known_digests() -> list[tuple[str, str]]:
    """(digest, license id) of every known text."""
    return sorted([*((hashlib.md5(text.encode()).hexdigest(), ident) for text, ident in known_texts()), *((digest, ident) for *_, digest, ident in LONG)])


def most_letters() -> int:
    """Letters that the lines of a text in known_texts() can have together, normalised one by one: those of the longest text, and what steps over the
    seams of lines would have taken away (no text has more than ten phrases of several words, and none is shortened by more than 50 letters)."""
    return max(len(t.replace(" ", "")) for t, _ in known_texts()) + 10 * 50


#: What every line that is a notice holds: a word of a sentence, or of a name that is a notice by itself.
NOTICE_SIGN = r"(?i)licen[cs]|under|spdx|covered by|\b(apache|asl|mozilla|mpl|[al]?gpl|gnu|cc|creative|boost|bsl|0?bsd)"


def _openings() -> str:
    """Pattern of texts that open like a known one, in any spelling that the steps make equal, or with a copyright notice or a title."""
    gap = "[^a-z0-9]+"
    words = {gap.join(re.findall("[a-z0-9]+", text.lower())[:2]) for text in TEXTS.values()}
    verbs = "licen[cs]ed|released|distributed|published|available|made available|provided|covered"
    titles = {gap.join(re.findall("[a-z0-9]+", t.format(n).lower())[: 2 if t.startswith("The") else 1]) for names in NOTICES.values() for n in names for t in TITLES}
    starts = "|".join([verbs, "all rights", *sorted(words), *sorted(titles)])
    return rf"^[^a-z0-9]*(https?://)?([0-9a-z][^a-z0-9]+)?({starts})\b|^[^a-z0-9\n]*{_SIGN}"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_notices (lines, sentences and runs of lines that are a license), license_ids (sorted, comma-joined), whole_text (one is the document)."""
    spark = docs.sparkSession
    known = spark.createDataFrame(known_digests(), "digest string, license_id string").hint("broadcast")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(raw.contains("\r"), F.regexp_replace(raw, r"\r\n?", "\n")).otherwise(raw)
    rows = keyed(docs)
    texts = rows.select(ROW, F.trim(text, F.lit(" \t\n")).alias("text"))
    single = ~F.col("text").contains("\n")
    pieces = lambda t: F.array_distinct(F.concat(F.array(t), F.filter(F.split(t, r"[.!?;]\s+"), lambda x: x.rlike(NOTICE_SIGN))))
    lines = F.filter(F.split("text", "\n"), lambda t: t.rlike(NOTICE_SIGN))
    of_lines = let(single, lambda one: F.flatten(F.transform(lines, lambda t, i: F.transform(
        pieces(t), lambda x: F.struct(x.alias("t"), (-1 - i).alias("at"), (one & (x == t)).alias("whole"))
    ))))
    opens = _openings()
    longest = most_letters()

    def runs(raw):
        """Runs of lines that open like a known text and have as many letters as one may have; lines of which normalising leaves nothing are passed over."""
        # A letter ahead keeps the step that is for a text's beginning from a line inside a run.
        count = lambda b: F.length(F.regexp_replace(canonical(F.concat(F.lit("x\n\n"), b)), " ", "")) - 1
        sized = lambda counted: F.transform(raw, lambda b, i: F.struct(
            b.alias("t"), F.get(counted, i).alias("n"), ((i > 0) & (F.get(counted, i - 1) == 0) & F.lower(F.get(raw, i - 1)).rlike(opens)).alias("led")
        ))
        told = F.filter(let(F.transform(raw, count), sized), lambda x: x["n"] > 0)

        def of_start(told):
            joined = lambda i, m: F.array_join(F.transform(F.slice(told, i + 1, m), lambda x: x["t"]), "\n")

            def ends(i, least, most):
                """Numbers of lines from i on that have so many letters together; each has one at least."""
                seen = lambda acc, x: F.struct(
                    (acc["sum"] + x["n"]).alias("sum"), (acc["m"] + 1).alias("m"),
                    F.when((acc["sum"] + x["n"]).between(least, most), F.concat(acc["of"], F.array(acc["m"] + 1))).otherwise(acc["of"]).alias("of"),
                )
                start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m"), F.array().cast("array<int>").alias("of"))
                return F.aggregate(F.slice(told, i + 1, F.lit(most)), start, seen, lambda acc: acc["of"])

            def of_long(i):
                """Ends of the long texts whose first letters stand at i."""
                begun = lambda head: F.flatten(F.array(*(
                    F.when(head.startswith(first), ends(i, least, most)).otherwise(F.array().cast("array<int>")) for least, most, first, _, _ in LONG
                )))
                return let(F.regexp_replace(canonical(joined(i, F.lit(HEAD_LETTERS))), " ", ""), begun)

            ahead = lambda b: F.when(b["led"], F.lit("\n\n")).otherwise(F.lit(""))  # noqa: E731  of a copyright notice, of which nothing is left
            many = F.aggregate(told, F.lit(0), lambda acc, x: acc + x["n"]) >= min(least for least, *_ in LONG)
            all_ends = lambda i: F.array_distinct(F.concat(ends(i, 1, longest), F.when(many, of_long(i)).otherwise(F.array().cast("array<int>"))))
            start = lambda b, i: F.when(b["led"] | F.lower(b["t"]).rlike(opens), F.transform(all_ends(i), lambda m: F.struct(
                F.concat(ahead(b), joined(i, m)).alias("t"), (i + m).alias("at"), ((i == 0) & (m == F.size(told))).alias("whole"),
            )))
            return F.filter(F.flatten(F.filter(F.transform(told, start), lambda x: x.isNotNull())), lambda u: u["t"].contains("\n"))

        opened = F.exists(raw, lambda b: F.lower(b).rlike(opens))
        return F.when(opened, let(told, of_start)).otherwise(none_found)

    none_found = F.expr("array()").cast("array<struct<t:string,at:int,whole:boolean>>")
    of_runs = F.when(~single, let(F.split("text", r"\n\s*"), runs)).otherwise(none_found)
    listed = texts.select(ROW, F.explode(F.concat(of_lines, of_runs)).alias("u"))
    digests = listed.select(ROW, F.col("u.at").alias("at"), F.col("u.whole").alias("whole"), F.md5(canonical(F.col("u.t"))).alias("digest"))
    # Runs that end at the same line hold the same license, with and without the notices above it: once.
    hits = digests.join(known, "digest").groupBy(ROW, "at", "license_id").agg(F.max("whole").alias("whole"))
    found = hits.groupBy(ROW).agg(
        F.count(F.lit(1)).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("license_ids"),
        F.max("whole").alias("whole_text"),
    )
    return rows.select(ROW, F.col(id_col).alias("doc_id")).join(broadcast_if_small(materialize(found)), ROW, "left").select(
        "doc_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("license_ids", F.lit("")).alias("license_ids"),
        F.coalesce("whole_text", F.lit(False)).alias("whole_text"),
    )


def oracle_sql() -> str:
    """DuckDB SQL of the scan by another way: one pattern a license for lines, and squeezed texts of blocks for whole licenses (without titles)."""
    quote = lambda s: s.replace("'", "''")
    spell = lambda name: re.sub(r"[^a-z0-9]+", r"[^a-z0-9]+", re.sub(r"\b(version|v) ?(?=[0-9])", "", name.lower().replace(".0", "")).replace("gplv", "gpl"))
    gap, lead = r"[^a-z0-9]+", r"((this|the) [a-z]+ is )?(licensed|released|distributed|published|available|made available|provided|covered) (under|by)( the terms of)?( the)? "
    rules = []
    for ident, names in NOTICES.items():
        spelt = sorted({re.sub(r"(?<=[^0-9.])(\[\^a-z0-9\]\+)?([0-9])$", r"[^a-z0-9]*\2([.]0)?", spell(n)) for n in names}, key=lambda x: (-len(x), x))
        any_name = "(" + "|".join(spelt) + ")"
        rules.append((rf"^[^a-z0-9]*({lead}{any_name}( international| unported)?( licen[cs]e)?|(the )?{any_name} licen[cs]e|licen[cs]e{gap}{any_name}( licen[cs]e)?|spdx{gap}license{gap}identifier{gap}{spell(ident)}([.]0)?)[^a-z0-9]*$", ident))
    lines = ", ".join(f"('{quote(p)}', '{i}')" for p, i in rules)
    squeeze = lambda t: re.sub("[^a-z]+", "", t.lower())
    texts = ", ".join(f"('{squeeze(t)}', '{i}')" for i, t in TEXTS.items())
    return rf"""
WITH rule(pattern, license_id) AS (VALUES {lines}), whole_license(squeezed, license_id) AS (VALUES {texts}),
d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, NOT contains(text, chr(10)) AS whole FROM d),
b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t]*\n\s*')) AS t, text FROM d WHERE contains(text, chr(10))),
h AS (
  SELECT doc_id, whole, license_id FROM (SELECT * FROM l WHERE regexp_matches(lower(t), 'licen[cs]|under|spdx')) l JOIN rule
    ON regexp_matches(regexp_replace(replace(lower(t), 'gplv', 'gpl'), '\b(version|ver|v) ?([0-9])', '\2', 'g'), pattern)
  UNION ALL
  SELECT doc_id, t = text, license_id FROM b JOIN whole_license ON regexp_replace(lower(t), '[^a-z]+', '', 'g') = squeezed WHERE contains(t, chr(10))
),
f AS (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS license_ids, bool_or(whole) AS whole_text
  FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_notices, 0) AS n_notices, coalesce(license_ids, '') AS license_ids, coalesce(whole_text, false) AS whole_text
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""
