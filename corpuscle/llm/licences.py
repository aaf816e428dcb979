r"""Operator 7: licence scans by canonical digests, in DataFrame functions only.

A text becomes canonical by lower case, dropped copyright notices, one blank for all that is neither letter nor digit,
and equivalent spellings: where its lines break does not matter, as long as notices stand on lines of their own. Known licences are a table (licence, kind, text); their digests are taken
the same way and hash-joined to the digests of entire texts (kind "text") and of entire lines (kind
"notice"). Nothing is matched by substring.

Defined results: null and empty texts have the digest of "" and match nothing; null doc_id is an ordinary
value; repeated rows are each reported; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

# Equivalent spellings, each brought to the second form in canonical text, one after the other. A blank at an end
# stands for the end of a word.
SPELLINGS = (
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    (" sub license", " sublicense"),
    (" non commercial", " noncommercial"),
    (" non infringement", " noninfringement"),
    (" copyright owner", " copyright holder"),
    (" https ", " http "),
    (" lgpl 3 0 ", " gnu lesser general public license version 3 "),
    (" agpl 3 0 ", " gnu affero general public license version 3 "),
    (" gpl 3 0 ", " gnu general public license version 3 "),
    (" lgplv3 ", " gnu lesser general public license version 3 "),
    (" agplv3 ", " gnu affero general public license version 3 "),
    (" gplv3 ", " gnu general public license version 3 "),
    (" creative commons attribution noncommercial 4 0 ", " cc by nc 4 0 "),
    (" version 2 0 ", " version 2 "),
)

# Texts of well-known licences and of the short notices that stand for them; the SQL knows these.
KNOWN = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        "text",
        'MIT License\n\nCopyright (c) year holder\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        "text",
        'ISC License\n\nCopyright (c) year holder\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "0BSD",
        "text",
        'BSD Zero Clause License\n\nCopyright (c) year holder\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "Zlib",
        "text",
        "zlib License\n\nCopyright (c) year holder\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
)

#: Bodies of licences with the titles they go under, and the wording of notices; ``known_texts`` makes the catalogue of them.
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts.json")


def _bodies(body: str) -> set[str]:
    """The body as it is, and without its usual optional parts: appendix, address of the publisher, item marks."""
    ends = re.search(r"(?m)^\W*END OF TERMS AND CONDITIONS\W*$", body)
    out = {body} | ({body[: ends.start()], body[: ends.end()]} if ends else set())
    out |= {re.sub(r"\A([^\n]*\n)[ \t]*\d+ Franklin[^\n]*\n", r"\1", x) for x in out}
    if body.startswith("Redistribution and use"):
        bare = re.sub(r"(?m)^[ \t]*[1-4][.)][ \t]+", "", body)
        marks = iter(range(1, 9))
        out |= {bare, re.sub(r"(?m)^\W*(?=Redistributions |Neither )", lambda _: f"\n{next(marks)}. ", bare)}
        out |= {"All rights reserved.\n" + x for x in out}
    return out


@cache
def known_texts() -> tuple[tuple[str, str, str], ...]:
    """(licence, kind, text): KNOWN and the data file, each body under each of its titles and under none."""
    with open(DATA, encoding="utf-8") as f:
        data = json.load(f)
    rows = dict.fromkeys(KNOWN)
    for x in data["texts"]:
        rows |= dict.fromkeys((x["licence"], "text", f"{title}\n\n{body}") for title in ["", *x["titles"]] for body in sorted(_bodies(x["body"])))
    for licence, names in data["notice_names"].items():
        rows |= dict.fromkeys((licence, "notice", form.format(name)) for form in data["notice_forms"] for name in names)
    return (*rows, *((x, "notice", f"SPDX-License-Identifier: {x}") for x in data["spdx"]))


# Notices that are part of licences' own texts, with years of any number, and the blanks in forms to fill in.
_OWN = (
    r"copyright[ \t]*(?:\(c\)|©)[\s,0-9]*free\s+software\s+foundation,\s+inc\.",
    r"copyright\s*(?:\(c\))?\s*(?:<year>|19yy|yyyy|year|\[yyyy\])\s+(?:<name\s+of\s+author>|name\s+of\s+author|your\s+name|\[name\s+of\s+copyright\s+owner\])",
)
# Any other notice: a line of some 120 characters at most that opens with the word and a mark or year, or with a mark and a
# year. "(c)" alone is the mark of a list's item, and "copyright" alone begins any sentence.
_NOTICE = r"[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[12][0-9]{3}|[<\[{]?(?:year|yyyy))|©|\(c\)[ \t]*(?:copyright|[12][0-9]{3}))[^\n]{0,120}"
COPYRIGHT = "|".join((*_OWN, f"^{_NOTICE}$"))
NOT_WORD = r"[^\p{L}\p{N}]+"
#: By so many characters at most the spellings shorten a notice.
SLACK = 24


def _spelt(words: Column) -> Column:
    """Equivalent spellings, for words with one blank between them and at either end."""
    return F.trim(reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, words))


def canonical(text: Column) -> Column:
    """Words in lower case and one spelling, without copyright notices. Where lines break inside a paragraph changes nothing."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT, " ")
    return _spelt(F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, " "))


def _short_lines(text: Column, most: int) -> Column:
    """Canonical forms of the lines that may be as long as some notice; only they are spelt anew."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    near = F.filter(F.split(flat, "\n"), lambda x: F.length(x) <= most + SLACK)
    return F.transform(near, lambda x: _spelt(F.concat(F.lit(" "), F.trim(x), F.lit(" "))))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def catalogue(spark: SparkSession, known=None) -> DataFrame:
    """(kind, digest, licence, size): one row per known digest and kind, with the length of its canonical text."""
    rows = spark.createDataFrame(list(known_texts() if known is None else known), "licence string, kind string, text string")
    return rows.groupBy("kind", digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"), F.first(F.length(canonical(F.col("text")))).alias("size"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text_digest, licence (null: no known text), n_notices, notices.

    Entire texts and lines are hash-joined to the catalogue. Only lines as long as some notice are digested; the digests
    are written with those of the texts, so that every text is read once, and no text is shuffled. ``known`` is a
    catalogue(): a table of fixed size, whose notices' lengths come to the driver.
    """
    spark = docs.sparkSession
    known = catalogue(spark) if known is None else known
    texts = known.where("kind = 'text'").select(F.col("digest").alias("d"), F.col("licence").alias("text_licence"))
    notices = known.where("kind = 'notice'").select("digest", "licence")
    sizes = sorted(r.size for r in known.where("kind = 'notice'").select("size").distinct().collect())
    lines = F.filter(_short_lines(F.col("text"), max(sizes, default=-SLACK - 1)), lambda x: F.length(x).isin(sizes))
    rows = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("k"), digest(F.col("text")).alias("text_digest"), F.transform(lines, lambda x: F.sha2(x.cast("binary"), 256)).alias("lines")
    )
    rows = materialise(rows, "licence-digests")
    # Rows that repeat doc_id and text share one answer.
    once = rows.where("size(lines) > 0").dropDuplicates(["k", "text_digest"]).select("k", "text_digest", F.explode("lines").alias("digest"))
    hits = once.join(notices, "digest").groupBy("k", "text_digest").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    rows = rows.drop("lines").join(hits, ["k", "text_digest"], "left").join(texts, F.col("text_digest") == F.col("d"), "left")
    return rows.select("doc_id", "text_digest", F.col("text_licence").alias("licence"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def op7_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def _sql_canonical(x: str, whole: bool = True) -> str:
    low = f"lower(coalesce({x}, ''))"
    low = f"regexp_replace({low}, '(?m){COPYRIGHT}', ' ', 'g')" if whole else low
    words = f"regexp_replace(' ' || {low} || ' ', '{NOT_WORD}', ' ', 'g')"
    return f"sha256(trim({reduce(lambda t, s: f'replace({t}, {_sql_text(s[0])}, {_sql_text(s[1])})', SPELLINGS, words)}, ' '))"


OP7_SQL = f"""
WITH k AS (SELECT kind, {_sql_canonical('t')} AS digest, min(licence) AS licence
           FROM (VALUES {', '.join(f'({_sql_text(a)}, {_sql_text(b)}, {_sql_text(c)})' for a, b, c in KNOWN)}) v(licence, kind, t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rn, doc_id, text, {_sql_canonical('text')} AS text_digest FROM documents),
l AS (SELECT rn, {_sql_canonical('line', False)} AS digest FROM (SELECT rn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)),
n AS (SELECT rn, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
      FROM l JOIN k ON k.kind = 'notice' AND k.digest = l.digest GROUP BY rn)
SELECT doc_id, text_digest, k.licence, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN n ON n.rn = d.rn LEFT JOIN k ON k.kind = 'text' AND k.digest = d.text_digest
"""
