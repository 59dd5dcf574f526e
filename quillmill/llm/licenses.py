"""License scans by a positional rare-token index, in DataFrame functions only.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.

1. Index: of the words that stand once in a template, the ``RARE`` of highest
   inverse document frequency, counted over all documents, are posted with their
   places in it.
2. Lookup: a document's words that are posted vote, place by place and posting by
   posting, for a template and the relative position at which it would start.
3. Relative positions are counted in steps of ``STEP`` words, two neighbouring
   steps together, so a name put into the wording moves no vote away. Those in
   which most posted words meet, one of the template's two rarest among them, give
   its share; a template with ``SHARE`` of its words or more is a candidate.
4. Verification: a candidate is a match if all its mandatory phrases stand in
   the document.

``score`` is the highest share of any template, verified or not, so a mutilated
notice has a score between 0 and 1 and no label of the method. Base phrases are counted at every
place. A document without one of a template's two rarest words and without a
base phrase's rarest has neither labels nor votes that count and is not looked up. Null text counts as empty; a
document without findings has empty labels, null places and score 0. Rows that
repeat are scanned each, those with a null doc_id too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import let, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, SHARE, STEP = 8, 0.8, 8

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# The wording of public licences and of their standard notices, as words in lower case.
DISCLAIMER = "is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
MIT_TEXT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    f"the software {DISCLAIMER} in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC_TEXT = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
    "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
APACHE_NOTICE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license"
)
ZLIB_TEXT = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
)
BOOST_TEXT = (
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
    "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
)
UNLICENSE_TEXT = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
)
MPL_NOTICE = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
GNU_NOTICE = "is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
GPL, LGPL, AGPL = "general public license", "lesser general public license", "affero general public license"

#: label, text, mandatory phrases
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("agpl-3.0", GNU_NOTICE.format(AGPL, 3), ("gnu affero general public license as published by the free software foundation either version 3 of the license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", APACHE_NOTICE, ("apache license version 2 0", "in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("bsd-2-clause", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}", ("redistribution and use in source and binary forms", "following conditions are met", "redistributions in binary form must reproduce")),
    ("bsl-1.0", BOOST_TEXT, ("any person or organization obtaining a copy of the software and accompanying documentation",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", GNU_NOTICE.format(GPL, 2), ("gnu general public license as published by the free software foundation either version 2 of the license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", GNU_NOTICE.format(GPL, 3), ("gnu general public license as published by the free software foundation either version 3 of the license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("isc", ISC_TEXT, ("permission to use copy modify and or distribute this software", "with or without fee", "appear in all copies")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", GNU_NOTICE.format(LGPL, 3), ("gnu lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", MIT_TEXT, ("permission is hereby granted free of charge to any person obtaining a copy", "without restriction")),
    ("mpl-2.0", MPL_NOTICE, ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("unlicense", UNLICENSE_TEXT, ("free and unencumbered software",)),
    ("zlib", ZLIB_TEXT, ("must not be misrepresented", "may not be removed or altered from any source distribution")),
)


def _strings(items) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def worded(docs: DataFrame) -> DataFrame:
    """doc_id and __w, the words of the text.

    Full lower-casing is several times as fast as mapping A-Z and makes the same
    ASCII words: but for the Kelvin sign, which is put aside first, no other
    character becomes an ASCII one alone, and non-ASCII letters match nothing.
    """
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return docs.select("doc_id", F.array_remove(F.split(text, BETWEEN), "").alias("__w"))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()} | {w for p, _ in BASE for w in p.split()})


def frequency(words: DataFrame, vocab: list[str]) -> dict[str, int]:
    """In how many documents each word stands; the driver sees a row for each word of the templates.

    Falling inverse document frequency is rising frequency, so this orders words alike.
    """
    held = words.select(F.explode(F.array_intersect("__w", _strings(vocab))).alias("w")).groupBy("w").count()
    return {w: 0 for w in vocab} | {r[0]: r[1] for r in held.collect()}


def _starts(phrase: str) -> Column:
    own = phrase.split()
    rest = lambda i: [F.get("__w", i + k) == w for k, w in enumerate(own) if k]

    def at(x, i):
        fits = x == own[0]
        for c in rest(i):
            fits = fits & c
        return F.when(fits, i)

    return F.filter(F.transform("__w", at), lambda i: i.isNotNull())


def unique(text: str) -> list[tuple[str, int]]:
    """The words that stand once in a template, with their places."""
    own = text.split()
    return [(w, i) for i, w in enumerate(own) if own.count(w) == 1]


def index(templates, held: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """Postings: rare word to (template, place in it, bit: 1 for the rarest, 2 for the next, and so on)."""
    posts: dict[str, list[tuple[int, int, int]]] = {}
    for t, (_, text, _) in enumerate(templates):
        for k, (w, i) in enumerate(sorted(unique(text), key=lambda x: (held[x[0]], x[0]))[:RARE]):
            posts.setdefault(w, []).append((t, i, 1 << k))
    return posts


def _fullest(votes: Column) -> Column:
    """at, n: how many posted words of each template meet in its fullest two neighbouring steps, from votes (t, o, bit) put in order."""
    zero = F.struct(F.lit(-1).alias("t"), F.lit(0).cast("bigint").alias("o"), F.lit(0).alias("run"), F.lit(0).alias("last"), F.lit(0).alias("best"), F.array().cast("array<struct<at:int,n:int>>").alias("done"))
    met = lambda bits: F.when(bits.bitwiseAND(F.lit(3)) != 0, F.bit_count(bits)).otherwise(0)

    def closed(a):
        return F.when(a["t"] < 0, a["done"]).otherwise(F.array_append(a["done"], F.struct(a["t"].alias("at"), a["best"].alias("n"))))

    def step(a, x):
        same = a["t"] == x["t"]
        here = same & (a["o"] == x["o"])
        run = F.when(here, a["run"].bitwiseOR(x["bit"])).otherwise(x["bit"])
        last = F.when(here, a["last"]).when(same & (a["o"] + 1 == x["o"]), a["run"]).otherwise(0)
        now = met(run.bitwiseOR(last))
        best = F.when(same, F.greatest(a["best"], now)).otherwise(now)
        return F.struct(x["t"].alias("t"), x["o"].alias("o"), run.alias("run"), last.alias("last"), best.alias("best"), F.when(same, a["done"]).otherwise(closed(a)).alias("done"))

    return F.aggregate(F.sort_array(votes), zero, step, closed)


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    words, vocab = worded(docs), vocabulary(templates)
    held = frequency(words, vocab)
    posts = index(templates, held)
    due = [sum(t == k for p in posts.values() for t, _, _ in p) for k in range(len(templates))]
    rarest = lambda phrase: min(phrase.split(), key=lambda w: (held[w], w))
    keys = sorted({w for w, p in posts.items() if any(b & 3 for _, _, b in p)} | {rarest(p) for p, _ in BASE})
    looked = F.col("__looked")
    no_ints = F.array().cast("array<int>")
    placed = F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    posted = F.create_map(*[x for w, p in sorted(posts.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(b).alias("bit")) for t, i, b in p)))])
    votes = F.flatten(F.transform("__hits", lambda h: F.transform(F.element_at(posted, h["w"]), lambda p: F.struct(p["t"].alias("t"), F.floor((h["i"] - p["i"]) / STEP).alias("o"), p["bit"].alias("bit")))))
    of = lambda values, kind, c: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), c)
    must = F.array(*(_strings(f" {p} " for p in phrases) for _, _, phrases in templates))
    scores = F.transform("__best", lambda b: F.struct(b["at"].alias("at"), (b["n"] / of(due, "int", b["at"])).alias("score")))
    verified = F.filter("__s", lambda s: F.when(s["score"] >= SHARE, F.forall(F.get(must, s["at"]), lambda p: F.col("__norm").contains(p))).otherwise(F.lit(False)))
    found = F.array_compact(F.array(*(F.when(F.size(f"__b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))))
    out = (
        words.withColumns({"n_words": F.size("__w").cast("bigint"), "__looked": F.arrays_overlap("__w", _strings(keys))})
        .withColumn("__w", F.when(looked, F.col("__w")))  # the others' words are done with
        .withColumns({f"__b{k}": F.when(looked, _starts(p)).otherwise(no_ints) for k, (p, _) in enumerate(BASE)})
        .withColumns({"__own": F.when(looked, F.array_intersect("__w", _strings(sorted(posts)))), "__norm": F.when(looked, F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" ")))})
        .withColumn("__hits", F.when(F.size("__own") > 0, F.filter(placed, lambda h: F.array_contains("__own", h["w"]))))
        .withColumn("__best", F.when(looked, _fullest(votes)))
        .withColumn("__s", F.coalesce(scores, F.array().cast("array<struct<at:int,score:double>>")))
        .withColumn("__labels", F.transform(verified, lambda s: of([label for label, _, _ in templates], "string", s["at"])))
        .withColumns({"__starts": F.concat(*(F.col(f"__b{k}") for k in range(len(BASE)))), "__base": found})
    )
    joined = lambda some: F.array_join(F.sort_array(F.array_distinct(some)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("__starts").cast("bigint").alias("n_base"),
        F.array_min("__starts").cast("bigint").alias("first_word"),
        F.array_max("__starts").cast("bigint").alias("last_word"),
        joined(F.col("__base")).alias("base_labels"),
        joined(F.concat("__base", "__labels")).alias("labels"),
        F.coalesce(F.array_max(F.transform("__s", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql(templates=TEMPLATES) -> str:
    """The same in DuckDB's SQL: places and votes as rows."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    posts = ", ".join(f"({t}, {q(w)}, {i})" for t, (_, text, _) in enumerate(templates) for w, i in unique(text))
    labels = ", ".join(f"({t}, {q(label)})" for t, (label, _, _) in enumerate(templates))
    must = ", ".join(f"({t}, {q(f' {p} ')})" for t, (_, _, phrases) in enumerate(templates) for p in phrases)
    base = ", ".join(f"({q(label)}, [{', '.join(map(q, p.split()))}])" for p, label in BASE)
    return rf"""
WITH told(t, w, p) AS (VALUES {posts}), label(t, label) AS (VALUES {labels}), must(t, phrase) AS (VALUES {must}), base(label, phrase) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
v AS (SELECT r, unnest(list_distinct(ws)) AS w FROM d),
df AS (SELECT w, count(*) AS n FROM v WHERE w IN (SELECT w FROM told) GROUP BY w),
rare AS (SELECT t, w, 1 << (k - 1) AS bit FROM (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w) AS k FROM (SELECT DISTINCT t, w FROM told) LEFT JOIN df USING (w)) WHERE k <= {RARE}),
post AS (SELECT t, w, p, bit FROM told JOIN rare USING (t, w)),
due AS (SELECT t, count(*) AS due FROM post GROUP BY t),
place AS (SELECT r, i, ws[i] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE r IN (SELECT r FROM v WHERE w IN (SELECT w FROM post)))),
step AS (SELECT r, t, floor((i - 1 - p) / {STEP})::BIGINT AS spot, bit_or(bit) AS bits FROM place JOIN post USING (w) GROUP BY ALL),
vote AS (SELECT r, t, max(CASE WHEN bits & 3 <> 0 THEN bit_count(bits) ELSE 0 END) AS n FROM (SELECT r, t, bit_or(bits) OVER (PARTITION BY r, t ORDER BY spot RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS bits FROM step) GROUP BY r, t),
score AS (SELECT r, t, vote.n / due.due AS score FROM vote JOIN due USING (t)),
ok AS (SELECT r, t FROM score JOIN d USING (r) JOIN must USING (t) WHERE score >= {SHARE} GROUP BY r, t HAVING bool_and(contains(' ' || array_to_string(ws, ' ') || ' ', phrase))),
b AS (SELECT r, label, i - 1 AS spot FROM (SELECT r, ws, label, phrase, unnest(range(1, len(ws) + 2 - len(phrase))) AS i FROM d, base WHERE list_has_any(ws, phrase[1:1])) WHERE ws[i : i + len(phrase) - 1] = phrase),
named AS (SELECT r, label FROM b UNION SELECT r, label FROM ok JOIN label USING (t))
SELECT doc_id, len(ws)::BIGINT AS n_words, (SELECT count(*) FROM b WHERE b.r = d.r) AS n_base, (SELECT min(spot) FROM b WHERE b.r = d.r) AS first_word, (SELECT max(spot) FROM b WHERE b.r = d.r) AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM b WHERE b.r = d.r), '') AS base_labels, coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM named WHERE named.r = d.r), '') AS labels,
  coalesce((SELECT max(score) FROM score WHERE score.r = d.r), 0.0) AS score
FROM d
"""


OP8_SQL = _sql()
