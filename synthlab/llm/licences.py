"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form: one case, lines that state a copyright dropped, equivalent
spellings made one, everything but letters and digits made single spaces.  Its SHA-256 is looked up
in the digests of known licences, brought to the same form, by a hash join.  Whole texts are
compared, so a match is exact up to the canonical form.  The same lookup runs over each line of a
text, which finds known notices inside longer texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlab.llm.licence_catalogue import FOLDER, catalogue  # noqa: F401
from synthlab.session import materialise

#: equivalent spellings as they stand after punctuation became spaces, applied in order (fixed values);
#: two words may stand on two lines
SPELLINGS = (
    (r"\bcopyright[ \n]+owner", "copyright holder"), (r"\bsub[ \n]+licen[cs]e", "sublicense"), (r"\blicence", "license"),
    (r"\bnon[ \n]+commercial", "noncommercial"), (r"\bnon[ \n]+infringement", "noninfringement"),
    (r"\bper[ \n]+cent\b", "percent"),
    (r"\backnowledgement", "acknowledgment"), (r"\bfavour", "favor"), (r"\bjudgement", "judgment"),
    (r"\bwhilst\b", "while"), (r"\borganisation", "organization"), (r"\bhttps\b", "http"),
)
#: what the one-line form must hold for any of them to apply (the patterns without their edges)
SPELLING_SIGNS = ("copyright owner", "sub licen", "licence", "non commercial", "non infringement", "per cent",
                  "acknowledgement", "favour", "judgement", "whilst", "organisation", "https")
#: what follows "copyright" in licence prose, where a header has a holder or a year (fixed values: the
#: words of the catalogue's texts, and their plurals)
PROSE = ("also", "and", "are", "claim", "claims", "disclaimer", "doctrines", "holder", "holders", "if", "in", "interest", "interests",
         "is", "law", "laws", "licence", "licences", "license", "licenses", "like", "line", "lines", "notice", "notices", "of", "on",
         "or", "owner", "owners", "ownership", "patent", "patents", "permission", "protection", "resulting", "statement", "statements", "the library", "the software",
         "those", "to", "trademark", "trademarks", "treaty")


def _other_than(phrases: tuple[str, ...], start: str = "") -> str:
    """Pattern for the beginning of a line's rest that is none of ``phrases``, nor cut off within one
    between words.  Neither engine needs lookahead, which RE2 has not."""
    after = {p[len(start)] for p in phrases if p.startswith(start) and p != start}
    letters = "".join(sorted(after - {" "}))
    if start in phrases:
        away = [rf"[^{letters}\W]"]                    # a longer word
    elif not start:
        away = [rf"[^{letters}\W]"]
    elif start.endswith(" "):
        away = [rf"[^{letters}\s]"]
    else:
        away = [rf"[^{letters}\s]"] if " " in after else [rf"[^{letters}\n]", "$"]
    more = [(r"[^\S\n]+" if c == " " else c) + _other_than(phrases, start + c) for c in sorted(after)]
    return "(?:" + "|".join(away + more) + ")"


#: a line that states a copyright, or that all rights are reserved, in lower case (fixed value): a
#: sign or a year, or a word that licence prose does not have there; "(c)" alone may number a clause,
#: so a holder's name after it needs a year
COPYRIGHT_LINE = (r"(?m)^[^\n\w]*(?:(?:portions[^\S\n]+)?(?:copyright[^\S\n]*(?:\(c\)|©|[0-9])|copyright[^\w\n]+" + _other_than(PROSE)
                  + r"|\(c\)[^\S\n]*[0-9]|\(c\)[^\n]*\b(?:19|20)[0-9][0-9]\b|©)|all rights reserved)[^\n]*$")
COPYRIGHT_SIGNS = ("copyright", "(c)", "©", "all rights")
#: largest table of known digests that is sent to every task, in rows of about 100 bytes
BROADCAST_ROWS = 200_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"

_OLD_ISC = _ISC.replace("and/or distribute", "and distribute")
_MIT_0 = _MIT.replace(", subject to the following conditions:", ".").replace("""The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

""", "")
_NEXT = _MIT.replace("this permission notice shall", "this permission notice (including the next paragraph) shall")

#: known licences and notices (fixed values: their public texts)
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC.format(_NOTICE)),
    ("ISC", "ISC License\n\n" + _ISC.format(_NOTICE)),
    ("0BSD", _ISC.format("")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    *catalogue([("MIT", _MIT), ("MIT", _NEXT), ("MIT-0", _MIT_0), ("ISC", _ISC.format(_NOTICE)), ("ISC", _OLD_ISC.format(_NOTICE)),
                ("0BSD", _ISC.format(""))]),
)


def _any_of(text: Column, signs: tuple[str, ...]) -> Column:
    """Most texts hold none of the signs, and plain searches are much cheaper than a pattern."""
    found = F.lit(False)
    for sign in signs:
        found = found | F.contains(text, F.lit(sign))
    return found


def canonical_lines(text: Column) -> Column:
    """Canonical form with the line breaks kept; null counts as empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(_any_of(out, COPYRIGHT_SIGNS), F.regexp_replace(out, COPYRIGHT_LINE, " ")).otherwise(out)
    return F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", " ")


def spelled(form: Column) -> Column:
    """Equivalent spellings made one; two words of one spelling on two lines join the lines."""
    out = form
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return out


def one_line(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \n]+", " "))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def forms(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``form``, the canonical form of ``text`` with its lines, and ``flat``, the same on
    one line."""
    found = _any_of(F.col("flat"), SPELLING_SIGNS)
    return (rows.withColumn("form", canonical_lines(F.col(text))).withColumn("flat", one_line(F.col("form")))
            .withColumn("form", F.when(found, spelled(F.col("form"))).otherwise(F.col("form")))
            .withColumn("flat", F.when(found, one_line(F.col("form"))).otherwise(F.col("flat"))))


def known_licences(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """(digest, licence): one row per digest; if two licences share one, the smaller name.  Texts of
    an empty form are left out."""
    rows = spark.createDataFrame(list(texts), "licence string, text string")
    table = forms(rows, "text")
    return (table.where("flat <> ''").groupBy(_sha(F.col("flat")).alias("digest")).agg(F.min("licence").alias("licence")))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_digest, licence, n_notices long, notices string), one row per row of ``docs``.

    ``licence`` is the known licence that the whole text equals in canonical form, else null;
    ``n_notices`` counts lines that equal a known text in canonical form, ``notices`` has their
    licences, distinct, sorted, comma-joined (empty for none).  Null and empty texts, and texts of
    copyright lines only, have the digest of the empty form, which no licence has.  Repeated rows
    and equal texts get equal results; null keys are keys; other columns are dropped; an empty table
    gives an empty table.
    """
    known = materialise(known, "known")
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    shaped = forms(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t")
    whole = shaped.select("k", "form", _sha(F.col("flat")).alias("text_digest"))
    # place 0 is the whole text, the lines follow; the outer form keeps Spark from pushing a filter
    # on the pieces down to the text, which would compute them twice
    pieces = F.concat(F.array("text_digest"), F.transform(F.split("form", "\n"), lambda line: _sha(F.trim(line))))
    each = (whole.select("k", "text_digest", pieces.alias("pieces"))
            .select("k", "text_digest", F.posexplode_outer("pieces").alias("at", "digest")))
    line = F.when(F.col("at") > 0, F.col("licence"))
    per_text = (each.join(side, "digest", "left").groupBy("k", "text_digest")
                .agg(F.count_if(F.col("at") == 0).alias("copies"),
                     F.max(F.when(F.col("at") == 0, F.col("licence"))).alias("licence"),
                     F.count(line).alias("lines"), F.sort_array(F.collect_set(line)).alias("names")))
    # rows equal in key and form were counted together
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return (per_text.select("*", copy)
            .select(F.col("k").alias(key), "text_digest", "licence",
                    (F.col("lines") / F.col("copies")).cast("long").alias("n_notices"),
                    F.array_join("names", ",").alias("notices")))
