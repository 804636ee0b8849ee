"""Licence scan: canonical digests of whole texts and whole lines, looked up among known licences."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, functions as F

from coratings.llm.staging import BROADCAST_TEXT_ROWS, cut, sized, text_columns

# Notices by which well-known licences are granted.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

# Headings that short licences are given under; none is one of them.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
}
# Long licences are also given without what follows their terms.
ENDS = r"(?s)(.*END OF TERMS AND CONDITIONS)"

# Spellings that mean the same.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("https", "http"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)


# A line that states a copyright: the word or sign, then a year, a sign or a place to fill one in.
STATEMENT = r"^[^\p{L}\p{N}]*(copyright|\(c\)|©)[^\p{L}\p{N}]*(c\)|copyright|[12][0-9]{3}|yyyy|year)"
# In a paragraph of nothing else also lines like these.
LOOSE = STATEMENT + r"|^[^\p{L}\p{N}]*(copyright|all rights reserved[^\p{L}\p{N}]*$)"
# Texts without any of these have one canonical form.
SIGNS = r"(?i)copyright|\(c\)|©|all rights reserved"
PARAGRAPHS = r"\n[ \t\r]*\n"


def words_of(line: Column) -> Column:
    """A line as its words: lower case, one space apart, equivalent spellings unified."""
    # Two spaces apart, so that each word has both of its spaces to itself.
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for other, usual in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines of a text that have words and state no copyright."""
    stated = lambda x: F.lower(x).rlike(STATEMENT)
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(stated(x), F.lit("")).otherwise(words_of(x)))
    return F.filter(lines, lambda x: x != "")


def canonical_paragraphs(text: Column) -> Column:
    """Canonical forms of paragraphs, without those of copyright statements alone: how paragraphs are wrapped plays no part."""
    alone = lambda p: F.forall(F.split(p, "\n"), lambda x: F.lower(x).rlike(LOOSE) | ~x.rlike(r"[\p{L}\p{N}]"))
    parts = F.transform(F.split(text, PARAGRAPHS), lambda p: F.when(alone(p), F.lit("")).otherwise(words_of(p)))
    return F.filter(parts, lambda x: x != "")


def digest(lines: Column) -> Column:
    """SHA-256 of the whole canonical text; null where nothing is left of it."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def digests(text: Column, lines: Column) -> Column:
    """Digests of a text, given its canonical lines too: without the lines that state a copyright, without paragraphs of them, and of all its words."""
    every = F.filter(F.array(words_of(text)), lambda x: x != "")
    several = F.array(digest(lines), digest(canonical_paragraphs(text)), digest(every))
    found = F.when(text.rlike(SIGNS), several).otherwise(F.array(digest(lines)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def known_digests(known: DataFrame) -> DataFrame:
    """license, digest of every known text (columns license, text); of equal texts the least name."""
    lines = known.select("license", "text", canonical_lines(F.col("text")).alias("lines"))
    return lines.select("license", F.explode(digests(F.col("text"), F.col("lines"))).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the whole licences in ``license_texts``, in the forms they are usually given in.

    Those are: with or without a heading, "All rights reserved", numbers before
    the clauses and the part after the terms.
    """
    found = set()
    for file in resources.files("coratings.llm").joinpath("license_texts").iterdir():
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        bodies = [text, *re.findall(ENDS, text)]
        if name in TITLES:
            bodies += [re.sub(r"(?m)^\d\. ", "", text)]
            bodies += [f"All rights reserved.\n\n{body}" for body in bodies]
            bodies += [f"{title}\n\n{body}" for title in TITLES[name] for body in bodies]
        found |= {(name, body) for body in bodies}
    return sorted(found)


def built_in(spark) -> DataFrame:
    """Notices and whole licences."""
    return spark.createDataFrame([*KNOWN, *full_texts()], "license string, text string")


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, whole_license, licenses, n_license_lines per row of ``docs``.

    whole_license is the licence that the entire text is; licenses, sorted and
    distinct, are those that an entire line or the entire text is; both by
    equal canonical digests. A text has up to three: without the lines that state a
    copyright (text_digest), without paragraphs of nothing else, and of all
    its words, so that neither statements nor the width of lines matter; the
    first that is known tells the licence. Texts are never searched for parts of a notice.

    The table of known digests is joined by hash: broadcast while it is small,
    else shuffled. Lines of a text are looked up together with it, and equal
    lines of all documents meet as counts, not as rows.

    Null and empty texts: digest null, no licences. Repeated rows and null
    doc_ids give a row each. A very long text is taken apart in one row, which
    takes some twenty bytes of memory a byte. Of licences with one digest the
    least name counts. Other columns of ``docs`` play no part. Without known texts nothing is found; no rows give none.
    """
    spark = docs.sparkSession
    lookup = known_digests(known if known is not None else built_in(spark))
    lines = text_columns(docs).select(
        "doc_id", "text", F.monotonically_increasing_id().alias("rid"), canonical_lines(F.col("text")).alias("lines")
    )
    hashed = lines.select("rid", "doc_id", digest(F.col("lines")).alias("text_digest"), digests(F.col("text"), F.col("lines")).alias("digests"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines"))
    hashed = cut(hashed)
    lookup = sized(cut(lookup), BROADCAST_TEXT_ROWS)
    by_line = (
        hashed.select("rid", F.explode("lines").alias("digest"))
        .join(lookup, "digest")
        .groupBy("rid")
        .agg(F.collect_set("license").alias("found"), F.count("*").alias("n_license_lines"))
    )
    whole = (
        hashed.select("rid", F.posexplode("digests").alias("form", "digest")).join(lookup, "digest")
        .groupBy("rid").agg(F.min_by("license", "form").alias("whole_license"))
    )
    own = F.when(F.col("whole_license").isNotNull(), F.array("whole_license")).otherwise(F.array().cast("array<string>"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return (
        hashed.drop("lines", "digests")
        .join(sized(cut(whole), BROADCAST_TEXT_ROWS), "rid", "left")
        .join(sized(cut(by_line), BROADCAST_TEXT_ROWS), "rid", "left")
        .select(
            "doc_id", "text_digest", "whole_license",
            F.array_join(F.array_sort(F.array_union(found, own)), ",").alias("licenses"),
            F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        )
    )


def license_sql() -> str:
    """The same scan of the documents table by the built-in notices and whole licences, in DuckDB's SQL."""
    quoted = lambda x: x.replace("'", "''")

    def words(x: str) -> str:
        out = rf"(' ' || trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' ')"
        for other, usual in SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {usual.replace(' ', '  ')} ')"
        return f"trim(replace({out}, '  ', ' '))"

    line = f"CASE WHEN regexp_matches(lower(x), '{STATEMENT}') THEN '' ELSE {words('x')} END"
    lines = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {line}), lambda x: x <> '')"
    alone = f"len(list_filter(string_split(p, chr(10)), lambda y: NOT regexp_matches(lower(y), '{LOOSE}') AND {words('y')} <> '')) = 0"
    paragraphs = f"list_filter(list_transform(string_split_regex(t, '{PARAGRAPHS}'), lambda p: CASE WHEN {alone} THEN '' ELSE {words('p')} END), lambda x: x <> '')"
    joined = lambda parts: f"nullif(array_to_string({parts}, ' '), '')"
    forms = f"[{joined(lines)}, {joined(paragraphs)}, nullif({words('t')}, '')]"
    values = ", ".join(f"('{quoted(name)}', '{quoted(text)}')" for name, text in [*KNOWN, *full_texts()])
    return f"""
WITH texts AS (SELECT license, {forms} AS forms FROM (VALUES {values}) AS k(license, t)),
known AS (
  SELECT digest, min(license) AS license FROM (SELECT license, sha256(f) AS digest FROM (SELECT license, unnest(forms) AS f FROM texts) WHERE f IS NOT NULL) GROUP BY digest),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {lines} AS lines, {forms} AS forms FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
found AS (
  SELECT rid, list(license) AS licenses, count(*) AS n FROM (
    SELECT rid, unnest(list_transform(lines, lambda x: sha256(x))) AS digest FROM docs) JOIN known USING (digest) GROUP BY rid),
whole AS (
  SELECT rid, min_by(license, form) AS license FROM (SELECT rid, unnest([0, 1, 2]) AS form, sha256(unnest(forms)) AS digest FROM docs) JOIN known USING (digest) GROUP BY rid)
SELECT doc_id, sha256(forms[1]) AS text_digest, w.license AS whole_license,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(f.licenses, []), CASE WHEN w.license IS NULL THEN [] ELSE [w.license] END))), ',') AS licenses,
  coalesce(f.n, 0) AS n_license_lines
FROM docs LEFT JOIN whole w USING (rid) LEFT JOIN found f USING (rid)
"""
