"""License scanning by sentences, in DataFrame operations only.

Comment marks at the begins of lines are taken away, the text is cut into sentences,
sentences are normalised (lower case, letters, digits and single spaces) and mapped to
identifiers of known licence sentences; licence rules, longest first, are then matched
against the sequence of identifiers, and what a rule has used is not used again.

A sentence ends at its mark, an empty line, or before a line that begins as a licence
does; it may be wrapped at any width. If it isn't known, it is cut before each line that
begins with a capital, as headings and lists have no mark at their ends; its parts stand
for it if one of them is known. An SPDX line gives an identifier for each licence of its
expression. Where a known sentence leaves words open inside, they may have
``MOST_BETWEEN`` characters, and between two identifiers of a rule up to ``GAP`` others may
stand: that is how the sentences and rules are defined, at every size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import let

#: Each sentence as it is normalised; ``*`` stands for any words.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy * to deal in the software without restriction *"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice * shall be included in all copies or substantial portions of the software"),
    ("MIT_WARRANTY", "the software is provided as is without warranty of any kind *"),
    ("MIT_LIABILITY", "in no event shall the authors or copyright holders be liable for any claim damages or other liability *"),
    ("ISC_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *"),
    ("ISC_WARRANTY", "the software is provided as is and the author disclaims all warranties *"),
    ("BSD_GRANT", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met *"),
    ("BSD_SOURCE", "* redistributions of source code must retain the above copyright notice *"),
    ("BSD_BINARY", "* redistributions in binary form must reproduce the above copyright notice *"),
    ("BSD_ENDORSE", "* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_WARRANTY", "this software is provided by the * as is and any express or implied warranties *"),
    ("BSD_REF", "* under * bsd license *"),
    ("BSD_REF", "* governed by a bsd style license *"),
    ("DUAL_MIT_APACHE2", "* either of * apache license version 2 0 * or * mit license *"),
    ("DUAL_MIT_APACHE2", "* licensed under either of apache license version 2 0 or mit license *"),
    ("APACHE2_REF", "* licensed under the apache license version 2 0 *"),
    ("APACHE2_TITLE", "apache license version 2 0 january 2004 *"),
    ("GPL3_TITLE", "gnu general public license version 3 29 june 2007 *"),
    ("GPL2_TITLE", "gnu general public license version 2 june 1991 *"),
    ("APACHE2_OBEY", "you may not use this file except in compliance with the license"),
    ("APACHE2_COPY", "you may obtain a copy of the license at *"),
    ("APACHE2_WARRANTY", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis *"),
    ("GPL3_REF", "* licensed under the gnu general public license version 3"),
    ("GPL2_REF", "* licensed under the gnu general public license version 2"),
    ("GPL_GRANT", "* redistribute it and or modify it under the terms of the gnu general public license *"),
    ("LGPL_GRANT", "* redistribute it and or modify it under the terms of the gnu lesser general public license *"),
    ("GPL_WARRANTY", "* distributed in the hope that it will be useful but without any warranty *"),
    ("GPL_COPY", "you should have received a copy of the gnu general public license *"),
    ("LGPL_COPY", "you should have received a copy of the gnu lesser general public license *"),
    ("MIT_REF", "* released under the mit license *"),
    ("MIT_REF", "* licensed under the mit license *"),
    ("GPL3_REF", "* under the gplv3 *"),
    ("GPL2_REF", "* under the gplv2 *"),
    ("CC_BY_NC_REF", "* creative commons attribution noncommercial 4 0 international license *"),
    ("CC_BY_SA_REF", "* creative commons attribution sharealike 4 0 international license *"),
    ("CC_BY_REF", "* creative commons attribution 4 0 international license *"),
    ("CC_BY_NC_REF", "licensed under cc by nc 4 0"),
    ("CC_BY_SA_REF", "licensed under cc by sa 4 0"),
    ("CC_BY_REF", "licensed under cc by 4 0"),
    ("CC0_REF", "* cc0 1 0 universal * public domain dedication *"),
    ("MPL2_REF", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL2_COPY", "if a copy of the mpl was not distributed with this file you can obtain one at *"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("COPYRIGHT", "copyright * all rights reserved"),
    ("BSD_LIABILITY", "in no event shall the copyright * be liable for any direct indirect incidental *"),
    ("AGPL_GRANT", "* redistribute it and or modify it under the terms of the gnu affero general public license *"),
    ("AGPL_COPY", "you should have received a copy of the gnu affero general public license *"),
    ("ZLIB_WARRANTY", "this software is provided as is without any express or implied warranty *"),
    ("ZLIB_GRANT", "permission is granted to anyone to use this software for any purpose *"),
    ("BOOST_GRANT", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software *"),
    ("EPL2_REF", "* made available under the terms of the eclipse public license 2 0 *"),
    ("CC_BY_ND_REF", "licensed under cc by nd 4 0"),
    ("MIT_REF", "* licensed under the terms of the mit license"),
    ("APACHE2_REF", "* released under the apache license version 2 0"),
    ("BSD3_REF", "* licensed under the bsd 3 clause license"),
)

#: Licences that have a short identifier of their own in SPDX lines.
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0+", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
    "MIT-0", "MPL-2.0", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
)

#: Licences and the ordered identifiers that show them; tried in this order.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_WARRANTY")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_WARRANTY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY", "MIT_LIABILITY")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_OBEY", "APACHE2_COPY", "APACHE2_WARRANTY")),
    ("LGPL", ("LGPL_GRANT", "GPL_WARRANTY", "LGPL_COPY")),
    ("GPL", ("GPL_GRANT", "GPL_WARRANTY", "GPL_COPY")),
    ("ISC", ("ISC_GRANT", "ISC_WARRANTY")),
    ("MPL-2.0", ("MPL2_REF", "MPL2_COPY")),
    ("Apache-2.0", ("APACHE2_REF",)),
    ("GPL-3.0", ("GPL3_REF",)),
    ("GPL-2.0", ("GPL2_REF",)),
    ("GPL", ("GPL_GRANT",)),
    ("LGPL", ("LGPL_GRANT",)),
    ("MIT", ("MIT_REF",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_REF",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_REF",)),
    ("CC-BY-4.0", ("CC_BY_REF",)),
    ("CC0-1.0", ("CC0_REF",)),
    ("BSD", ("BSD_REF",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("Unlicense", ("UNLICENSE",)),
    ("AGPL", ("AGPL_GRANT", "GPL_WARRANTY", "AGPL_COPY")),
    ("AGPL", ("AGPL_GRANT",)),
    ("Zlib", ("ZLIB_WARRANTY", "ZLIB_GRANT")),
    ("BSL-1.0", ("BOOST_GRANT",)),
    ("EPL-2.0", ("EPL2_REF",)),
    ("CC-BY-ND-4.0", ("CC_BY_ND_REF",)),
    ("BSD-3-Clause", ("BSD3_REF",)),
    ("MIT-OR-Apache-2.0", ("DUAL_MIT_APACHE2",)),
    ("Apache-2.0", ("APACHE2_TITLE",)),
    ("GPL-3.0", ("GPL3_TITLE",)),
    ("GPL-2.0", ("GPL2_TITLE",)),
)


def spdx_identifier(licence: str) -> str:
    """The identifier of the sentence that names a licence in an SPDX line."""
    return "SPDX_" + re.sub("[^A-Z0-9]+", "_", licence.upper())


def known_sentences() -> tuple[tuple[str, str], ...]:
    return SENTENCES + tuple((spdx_identifier(x), "spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower())) for x in SPDX)


def known_rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    return RULES + tuple((x, (spdx_identifier(x),)) for x in SPDX)



#: An SPDX line, and the licences of its expression: those joined by OR and AND; of WITH the licence, not the exception.
SPDX_LINE = r"(?i)spdx-license-identifier:[ \t]*([^\n]*)"
SPDX_TERM = r"(?<![A-Z0-9.+-])(?:" + "|".join(re.escape(x.upper()) for x in sorted(SPDX, key=len, reverse=True)) + r")(?![A-Z0-9.+-])"
#: A normalised sentence that denies a licence is not known.
DENIAL = r"\b(?:not|never|isn t|aren t) (?:yet |be |been )?(?:licensed|released|distributed|made available) under\b"
#: Each known sentence holds one of these; only sentences that do are listed.
KEYWORDS = r"licen|copyright|permission|warrant|redistribut|public\s+domain|mpl\s+was\s+not|gplv[23]"
#: The same for text in which comment marks may stand between two words.
RAW_KEYWORDS = r"licen|copyright|permission|warrant|redistribut|public\W+domain|mpl\W+was\W+not|gplv[23]"
UNKNOWN = "UNKNOWN"
#: Marks of comments at the begin of a line, and the end of a block comment.
COMMENT_MARKS = r"(?m)^[ \t]*(?://+!?|#+|;+|--+|%+|/\*+|\*+/|\*+|<!--)[ \t]*|(?<!\*)\*+/[ \t]*$|-->[ \t]*$"
#: How a line begins that begins a sentence of a licence, whatever stands before it.
LINE_BEGINS = (
    r"licensed under|released under|this (?:work|program|file|software|project|library|code) is|spdx-license|copyright (?:\(c\)|©|[0-9])|permission (?:is|to)|redistribution and use"
    "|redistributions (?:of|in)|unless required|you (?:may|should have)|the above copyright notice and|the software is provided|in no event shall|neither the name"
)
#: A sentence ends at its mark before white space (but not before a number, nor within a copyright line),
#: at an empty line, or before a line that begins as above.
SENTENCE_END = rf"(?<=[.!?;])\s+(?![0-9]|(?i:all\s+rights\s+reserved))|\n\s*\n|\n(?=\s*(?i:{LINE_BEGINS}))"
#: Where a sentence that isn't known is cut.
LINE_END = r"\n(?=\s*\p{Lu}\p{Ll})"
#: Characters that an asterisk between words stands for at most.
MOST_BETWEEN = 400
#: Between two identifiers of a rule so many others may stand.
GAP = 2


def sentence_pattern(sentence: str) -> str:
    """The regular expression of a known sentence, anchored at both ends."""
    inner = sentence.removeprefix("* ").removesuffix(" *").replace(" * ", "(?: .{0,%d})? " % MOST_BETWEEN)
    return "^" + "(?:.* )?" * sentence.startswith("* ") + inner + "(?: .*)?" * sentence.endswith(" *") + "$"


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{Nd}]+", " "))


def identify(normalised: Column) -> Column:
    """The identifier of a normalised sentence; UNKNOWN if there is none."""
    known = F.coalesce(*[F.when(normalised.rlike(sentence_pattern(s)), F.lit(k)) for k, s in known_sentences()], F.lit(UNKNOWN))
    return F.when(normalised.rlike(DENIAL), F.lit(UNKNOWN)).otherwise(known)


def expression(sentence: Column) -> Column:
    """The identifiers of the licences in a sentence's SPDX line; none if it has no such line."""
    terms = F.regexp_extract_all(F.upper(F.regexp_extract(sentence, SPDX_LINE, 1)), F.lit(SPDX_TERM), F.lit(0))
    return F.transform(terms, lambda x: F.concat(F.lit("SPDX_"), F.regexp_replace(x, "[^A-Z0-9]+", "_")))


def match_rules(ids: Column) -> Column:
    """The licences that the sequence of identifiers shows, in order of their place."""
    # " A B C " with a licence written as "=MIT" where its identifiers stood
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    for name, seq in known_rules():
        gap = r"(?: (?!=)\S+){0,%d}?" % GAP
        line = F.regexp_replace(line, r"(?<= )" + (gap + " ").join(seq) + r"(?= )", "=" + name)
    return F.transform(F.filter(F.split(line, " ", -1), lambda x: x.startswith("=")), lambda x: F.substr(x, F.lit(2)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``sentences`` (identifiers) and ``licenses``.

    ``sentences`` lists the identifiers of the sentences with a licence keyword,
    UNKNOWN for those that are not known; ``licenses`` the licences in the order
    of their place, repeats included. A null or empty text has none. Rows are
    neither joined nor grouped, so null ids, ties and repeated rows are kept as
    they are; further columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    likely = lambda parts: F.filter(parts, lambda s: s.rlike(f"(?i){KEYWORDS}"))
    identified = lambda parts: F.transform(likely(parts), lambda s: let(normalise(s), identify))

    def of_sentence(sentence: Column) -> Column:
        def or_parts(known: Column) -> Column:
            parts = let(identified(F.split(sentence, LINE_END, -1)), lambda x: F.when(F.exists(x, lambda k: k != UNKNOWN), x).otherwise(F.array(F.lit(UNKNOWN))))
            return F.when((known != UNKNOWN) | ~sentence.rlike(LINE_END), F.array(known)).otherwise(parts)

        plain = let(let(normalise(sentence), identify), or_parts)
        return F.when(sentence.rlike(SPDX_LINE), let(expression(sentence), lambda x: F.when(F.size(x) > 0, x).otherwise(plain))).otherwise(plain)

    def ids(whole: Column) -> Column:
        plain = F.regexp_replace(whole, COMMENT_MARKS, "")
        return F.flatten(F.transform(likely(F.split(plain, SENTENCE_END, -1)), of_sentence))

    none = F.array().cast("array<string>")
    found = F.when(text.rlike(f"(?i){RAW_KEYWORDS}"), ids(text)).otherwise(none)
    result = let(found, lambda x: F.struct(x.alias("sentences"), F.when(F.size(x) > 0, match_rules(x)).otherwise(none).alias("licenses")))
    return docs.select(F.col(id_col).alias("doc_id"), result.alias("__scan")).select("doc_id", "__scan.sentences", "__scan.licenses")
