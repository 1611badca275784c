"""Licence scans by canonical digests (operator 8), in DataFrame functions only.

A text is brought to canonical form (copyright lines out, one case, equal spellings, no punctuation)
and its SHA-256 is joined with the digests of known licences, made the same way.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of terms that begin like a notice (their first word is not taken as one), and
#: lines that name a holder of rights and no terms.
TERMS_LINE = r"(?m)^([^\n\p{L}\p{N}]*)Copyright([^\n\p{L}\p{N}]+(?:[Hh]older|[Oo]wner|[Nn]otice|[Ll]aw|[Ll]icen[cs]e|[Aa]ct|[Ss]tatement)s?(?:[^\p{L}\p{N}]|$))"
COPYRIGHT_LINE = (
    r"(?im)^[^\n\p{L}\p{N}]*(?:copyright(?:ed)?[^\n\p{L}\p{N}]*(?:\(c\)|©|\p{N}{4}|by[^\p{L}\p{N}])"
    r"|(?-i:Copyright[^\n\p{L}\p{N}]+\p{Lu})"
    r"|\(c\)[^\n\p{L}\p{N}]*(?:copyright[^\p{L}\p{N}]|\p{N}{4})|[^\n\p{L}\p{N}]*©|all rights reserved)[^\n]*$"
)
#: Fixed value: what stands between words.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Spellings that licence matching takes as equal, and the one that stays.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("maximise", "maximize"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
#: Full texts as published, a file each, by SPDX identifier.
TEXTS = Path(__file__).parent / "license_texts"
#: Texts without a file and short notices of well-known licences.
LICENSES = [
    ("MIT", f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_WARRANTY}"),
    ("ISC", f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_TERMS}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TERMS}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def canonical(text: Column) -> Column:
    """Words of the text in lower case with one space between, lines that name a holder left out and
    each word in one spelling; null texts count as empty."""
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), TERMS_LINE, "$1copyright$2"), COPYRIGHT_LINE, "")
    # Two spaces between words, so that neighbours are both replaced.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(kept), BETWEEN, "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(_wide(a)), F.lit(_wide(b)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _wide(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def plain_form(text: str) -> str:
    """``canonical`` of one text, word by word; for the registered SQL's digests and for tests."""
    kept = regex.sub(COPYRIGHT_LINE, "", regex.sub(TERMS_LINE, r"\1copyright\2", text))
    found = [w for w in regex.split(BETWEEN, kept.lower()) if w]
    for a, b in SPELLINGS:
        old, at = a.split(), 0
        while at < len(found):
            if found[at : at + len(old)] == old:
                found[at : at + len(old)] = b.split()
            at += 1
    return " ".join(found)


def built_in() -> list[tuple[str, str]]:
    """Identifier and text of each licence of the built-in list."""
    return [*LICENSES, *((p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt")))]


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(built_in(), "license string, text string")


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, canonical_sha256, license)`` for each row; license is null if its text isn't one.

    ``licenses`` has ``license`` and ``text``; if several have one digest, the smallest name counts;
    those without a word are left out.  Null texts count as empty and are no licence; repeated rows
    and null ids pass through; other columns are not read.  The list of licences is broadcast if it
    is the built-in one, whose size is fixed; a given one is joined as the optimizer sees fit.
    """
    table = known(docs.sparkSession) if licenses is None else licenses
    table = table.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    table = table.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))
    table = F.broadcast(table) if licenses is None else table
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    return rows.join(table, rows.canonical_sha256 == table.digest, "left").select(F.col("id").alias(id_col), "canonical_sha256", "license")


def sql() -> str:
    """``scan`` of ``documents`` in DuckDB's SQL; the digests of the list are made by ``plain_form``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kept = f"regexp_replace(regexp_replace(coalesce(text, ''), {quote(TERMS_LINE)}, '\\1copyright\\2', 'g'), {quote(COPYRIGHT_LINE)}, '', 'g')"
    form = f"' ' || trim(regexp_replace(lower({kept}), {quote(BETWEEN)}, '  ', 'g')) || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, {quote(_wide(a))}, {quote(_wide(b))})"
    digests: dict[str, str] = {}
    for name, text in built_in():
        digest = hashlib.sha256(plain_form(text).encode()).hexdigest()
        digests[digest] = min(name, digests.get(digest, name))
    rows = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in sorted(digests.items()))
    return f"""
        WITH known AS (SELECT * FROM (VALUES {rows}) v(digest, license))
        SELECT doc_id, canonical_sha256, license
        FROM (SELECT doc_id, sha256(trim(replace({form}, '  ', ' '))) AS canonical_sha256 FROM documents) d LEFT JOIN known ON canonical_sha256 = digest
    """
