"""Licence scans: passages compared with licence notices and texts by their word pairs.

A text is normalised to lower-case words of letters and digits; the Dice coefficient of
two sets A and B of neighbouring word pairs is 2 |A n B| / (|A| + |B|). A passage is a run
of words of one document, over any line breaks, that begins anywhere and ends with a clause
or a line, as notices do. It can reach t only if it has at least t / (2 - t) of a template's
pairs, so most documents and words are never compared. DataFrame operations only, no shuffle.

A pair that the template has never lowers a passage's coefficient, so only passages that
begin where a run of such pairs begins, and end with the clause where one ends, are tried;
of at most (2 - t) / t times the template's words up to that clause. Of overlapping passages
the one counts whose common pairs exceed what t asks for by most, then the first by name.

Null and empty texts have no findings. Every row is a document; repeated rows repeat
their findings.
"""

from __future__ import annotations

from fractions import Fraction
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
}
LEAST_PERCENT = 90

CLAUSE_END = r"[.,;:!?)\]\"'](?=[^a-z0-9]|$)|[(\[<]"
"""Ends a clause in a lower-cased line; not the points in numbers and addresses."""


def licence_texts() -> list[tuple[str, str]]:
    """Whole licences, and the headers they ask for (`<licence>.header.txt`)."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return [(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text()) for f in files]


def template_words(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isascii() and c.isalnum() else " " for c in lowered).split()


def pairs_of(text: str) -> list[str]:
    """The word pairs of a template, by the rule that `words_of` has for columns."""
    words = template_words(text)
    return list(dict.fromkeys(" ".join(two) for two in zip(words, words[1:])))


def words_of(line: Column) -> Column:
    """Runs of a-z and 0-9 of a lower-cased line; anything else is as good as a space."""
    return F.split(F.trim(F.regexp_replace(line, "[^a-z0-9]+", " ")), " ")


def size_bounds(size: int, least_percent: int) -> tuple[int, int]:
    """Least and greatest number of pairs a line may have for a template of so many."""
    low = Fraction(least_percent, 200 - least_percent) * size
    high = Fraction(200 - least_percent, least_percent) * size
    return -int(-low // 1), int(high // 1)


def needed_words(pairs: list[str], least_common: int, groups: int = 8) -> list[list[str]]:
    """Groups of words; every passage with so many common pairs has a word of each group.

    A passage without any word of a group lacks all their pairs, which is more than can be
    lacking. Few words make a group: long ones where there are few pairs to spare, else
    those of most pairs.
    """
    of_word: dict[str, set[str]] = {}
    for pair in pairs:
        for word in pair.split():
            of_word.setdefault(word, set()).add(pair)
    spare, found = len(pairs) - least_common, []
    orders = (lambda w: (-len(w), w), lambda w: (len(w) < 6, -len(of_word[w]), w))
    left = set(of_word)
    while len(found) < groups:
        tried = []
        for order in orders:
            lacking: set[str] = set()
            group = []
            for word in sorted(left, key=order):
                if len(lacking) > spare:
                    break
                group.append(word)
                lacking |= of_word[word]
            if len(lacking) > spare:
                tried.append(group)
        if not tried:
            break
        found.append(min(tried, key=len))
        left -= set(found[-1])
    return found


def tokens_of(whole: Column) -> Column:
    """Words in order, each with its line and how many words follow in its clause."""

    def of_clause(clause: Column, line: Column) -> Column:
        words = F.filter(words_of(clause), lambda w: w != "")
        # an array of one, so that a clause is cut once
        each = F.transform(
            F.array(words),
            lambda ws: F.transform(
                ws,
                lambda w, i: F.struct(
                    w.alias("word"), line.alias("line"), (F.size(ws) - 1 - i).alias("rest")
                ),
            ),
        )
        return F.flatten(each)

    lines = F.transform(
        F.split(whole, "\n", -1),
        lambda of, line: F.flatten(
            F.transform(F.split(of, CLAUSE_END, -1), lambda clause: of_clause(clause, line))
        ),
    )
    return F.flatten(lines)


def bound(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def passages(tokens: Column, pairs: Column, template: Column, least_percent: int) -> Column:
    """Passages that match one template: margin, licence, common, sizes, first and last pair."""

    def of_common(common: Column) -> Column:
        places = F.filter(
            F.transform(pairs, lambda p, i: F.when(F.array_contains(common, p), i)),
            lambda i: i.isNotNull(),
        )
        return bound(places, lambda at: of_places(common, at))

    def of_places(common: Column, at: Column) -> Column:
        ranked = F.transform(at, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
        starts = F.filter(ranked, lambda x: (x.k == 0) | (F.get(at, x.k - 1) < x.p - 1))
        ends = F.filter(
            ranked, lambda x: (x.k == F.size(at) - 1) | (F.get(at, x.k + 1) > x.p + 1)
        )
        runs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
        return bound(runs, lambda r: F.flatten(F.transform(r, lambda s, j: of_start(common, r, s, j))))

    def of_start(common: Column, runs: Column, start: Column, j: Column) -> Column:
        a = start["a"]
        near = F.slice(runs, j + 1, template.most)
        tried = F.transform(
            near,
            # a run longer than the template is tried up to the template's length
            lambda r, i: F.struct(
                F.when(i == 0, F.least(r["b"].p, a.p + template.n_places - 1))
                .otherwise(r["b"].p)
                .alias("p"),
                (r["b"].k - a.k + 1).alias("hits"),
            ),
        )
        tried = F.filter(
            tried, lambda e: (e.p - a.p < template.most) & (e.hits >= template.least)
        )
        scored = F.transform(
            F.array_distinct(F.transform(tried, lambda e: e.p + F.get(tokens, e.p + 1).rest)),
            lambda last: bound(
                F.array_distinct(F.slice(pairs, a.p + 1, last - a.p + 1)),
                lambda own: bound(
                    F.size(F.array_intersect(own, common)),
                    lambda c: F.struct(
                        (least_percent * (F.size(own) + template.n) - 200 * c).alias("order"),
                        template.licence.alias("licence"),
                        a.p.alias("first"),
                        last.alias("last"),
                        c.cast("long").alias("common"),
                        (F.size(own) + template.n).cast("long").alias("sizes"),
                    ),
                ),
            ),
        )
        return F.filter(scored, lambda m: m.order <= 0)

    return bound(F.array_intersect(pairs, template.own), of_common)


def not_overlapping(found: Column) -> Column:
    """Of matches in ascending order, those that overlap none taken before."""
    none = F.filter(found, lambda m: F.lit(False))
    return F.aggregate(
        found,
        none,
        lambda taken, m: F.when(
            F.exists(taken, lambda t: (t["first"] <= m["last"] + 1) & (m["first"] <= t["last"] + 1)),
            taken,
        ).otherwise(F.concat(taken, F.array(m))),
    )


def licence_lines(
    documents: DataFrame,
    templates: dict[str, str] | None = None,
    least_percent: int = LEAST_PERCENT,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per passage that matches: id, `line` it begins in (from 0), `licence`,
    `common`, `sizes`.

    The Dice coefficient is 2 common / sizes. No shuffle: passages are compared where they
    are read, with templates that are part of the plan.
    """
    named = list(templates.items()) if templates else [*TEMPLATES.items(), *licence_texts()]
    needed: set[str] = set()
    rows = []
    for name, template in sorted(named):
        own, places = pairs_of(template), len(template_words(template)) - 1
        least = size_bounds(len(own), least_percent)[0]
        some = needed_words(own, least)
        needed.update(some[0])
        fields = {
            "licence": F.lit(name),
            "own": F.split(F.lit("|".join(own)), "[|]"),
            "needed": F.array(*(F.split(F.lit("|".join(g)), "[|]") for g in some)),
            "n": F.lit(len(own)),
            "least": F.lit(least),
            "n_places": F.lit(places),
            "most": F.lit(size_bounds(places, least_percent)[1]),
        }
        rows.append(F.struct(*(c.alias(n) for n, c in fields.items())))
    whole = F.lower(F.coalesce(F.col(text), F.lit("")))
    # one pass over the words, however many are asked for
    asked = F.split(F.lit("|".join(sorted(needed))), "[|]")
    may_match = F.arrays_overlap(F.split(whole, "[^a-z0-9]+"), asked)

    def near(words: Column, pairs: Column) -> Column:
        """Templates that the document may hold, by its words and pairs alone."""
        return F.filter(
            F.array(*rows),
            lambda t: (F.size(pairs) >= t.least)
            & F.forall(t.needed, lambda group: F.arrays_overlap(group, words))
            & (F.size(F.array_intersect(pairs, t.own)) >= t.least),
        )

    def in_tokens(tokens: Column, pairs: Column, able: Column) -> Column:
        found = F.flatten(F.transform(able, lambda t: passages(tokens, pairs, t, least_percent)))
        kept = bound(F.array_sort(found), not_overlapping)
        return F.transform(
            kept,
            lambda m: F.struct(
                F.get(tokens, m["first"]).line.cast("long").alias("line"),
                m.licence.alias("licence"), m.common.alias("common"), m.sizes.alias("sizes"),
            ),
        )

    def of_words(words: Column, pairs: Column) -> Column:
        # lines and clauses matter only where a template is near
        return bound(
            near(words, pairs),
            lambda able: F.when(
                F.size(able) > 0,
                bound(tokens_of(whole), lambda tokens: in_tokens(tokens, pairs, able)),
            ),
        )

    def pairs_in(words: Column) -> Column:
        left = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
        right = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
        return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))

    words = F.filter(words_of(whole), lambda w: w != "")
    found = bound(words, lambda w: bound(pairs_in(w), lambda pairs: of_words(w, pairs)))
    return documents.where(may_match).select(F.col(id).alias(id), F.inline(found))


def licence_report(documents: DataFrame) -> DataFrame:
    """Every finding with its Dice coefficient in millionths, rounded down."""
    found = licence_lines(documents.select("doc_id", "text"))
    return found.select(
        "doc_id", "line", "licence",
        F.expr("CAST(2000000 * common DIV sizes AS BIGINT)").alias("dice_ppm"),
    )


def _oracle() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))
    words = (
        "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '),"
        " lambda w: w <> '')"
    )
    pairs = (
        "list_distinct(list_transform(range(1, greatest(len(w), 1)), "
        "lambda i: w[i] || ' ' || w[i + 1]))"
    )
    return f"""
WITH templates AS (
    SELECT licence, {pairs} AS own
    FROM (SELECT licence, {words.format('notice')} AS w FROM (VALUES {rows}) AS t(licence, notice))
),
lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS of,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
    FROM documents
),
cut AS (
    SELECT doc_id, line, {pairs} AS pairs
    FROM (SELECT doc_id, line, {words.format('of')} AS w FROM lines)
),
compared AS (
    SELECT doc_id, line, licence, len(list_intersect(pairs, own)) AS common,
           len(pairs) + len(own) AS sizes
    FROM cut JOIN templates ON len(pairs) BETWEEN 1 AND 20
)
SELECT doc_id, CAST(line AS BIGINT) AS line, licence,
       CAST(2000000 * common // sizes AS BIGINT) AS dice_ppm
FROM compared
WHERE 200 * common >= {LEAST_PERCENT} * sizes
QUALIFY row_number() OVER (
    PARTITION BY doc_id, line ORDER BY -(2.0 * common) / sizes, licence) = 1
"""


ORACLE = _oracle()
