"""Licence scan by sentence rules, native DataFrame functions only (operator 2).

Texts that hold a cue word are normalised (lower case, other characters than letters, digits, line
ends and the points that end sentences become one space), and known sentences in them get their
identifier. A sentence begins and ends where a line or sentence does; inside, it may be wrapped over
lines, each with a comment prefix, but not over an empty line. What stands between two known sentences is UNKNOWN if it holds
a sentence of its own, which two words side by side tell; markers of lists, lone words and comment signs are none. The sequence of
identifiers and UNKNOWN marks is then rewritten by ordered licence rules: full licence texts before headers before references,
each rule turning its unbroken sequence of identifiers into the licence's name. Identifiers that no rule takes are counted.

Everything is row by row without a shuffle; the tables below are the only thing sent along. A null
or empty text has no sentence and no licence; repeated rows are scanned each; where rules tie the
earlier one wins; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions.text import let

#: Identifiers of licence sentences in their normalised form, from the public licence texts.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliability",
    "licensed under the apache license version 2.0": "ApacheRef",
    "licensed under the apache license version 2.0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 3": "GPL3ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "see the gnu general public license for more details": "GPLsee",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDpre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDasis",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSDliability",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "LGPL21later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LGPLwarranty",
    "see the gnu lesser general public license for more details": "LGPLsee",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPLcopy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3later",
    "see the gnu affero general public license for more details": "AGPLsee",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLcopy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "MPL2copy",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0waive",
    "spdx license identifier mit": "MITref",
    "spdx license identifier apache 2.0": "ApacheRef",
    "spdx license identifier gpl 2.0 or later": "GPL2spdx",
    "spdx license identifier gpl 3.0 or later": "GPL3spdx",
    "spdx license identifier bsd 3 clause": "BSD3spdx",
    "spdx license identifier mpl 2.0": "MPL2ref",
    "all rights reserved": "AllRights",
    "licensed under cc by nc 4.0": "CCBYNC4ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "CCBY4ref",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "MPL2ref",
    "http www.apache.org licenses license 2.0": "ApacheURL",
    "https www.apache.org licenses license 2.0": "ApacheURL",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "ZlibOrigin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "distributed under the boost software license version 1.0": "BoostRef",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseFree",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CCBYSA4ref",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CCBYNC4ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at": "EPL2ref",
    "licensed under the bsd 3 clause license": "BSD3spdx",
    "licensed under the isc license": "ISCref",
    "licensed under the mozilla public license version 2.0": "MPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 of the license or at your option any later version": "LGPL2later",
}
#: Identifiers of licences that a short tag may name.
TAGGED = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "Unlicense", "WTFPL", "Zlib"]
SENTENCES |= {f"spdx license identifier {name.lower().replace('-', ' ')}": f"tag:{name}" for name in TAGGED}
#: Licence rules in order; the first that matches at a place takes its identifiers.
RULES = [
    ("MIT", ["MITgrant", "MITnotice", "MITwarranty", "MITliability"]),
    ("MIT", ["MITgrant", "MITnotice", "MITwarranty"]),
    ("MIT", ["MITgrant", "MITnotice"]),
    ("ISC", ["ISCgrant", "ISCwarranty"]),
    ("ISC", ["ISCgrant"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy", "ApacheURL", "ApacheWarranty", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy", "ApacheURL"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy", "ApacheWarranty", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy"]),
    ("GPL-3.0-or-later", ["GPL3later", "GPLwarranty", "GPLsee", "GPLcopy"]),
    ("GPL-3.0-or-later", ["GPL3later"]),
    ("GPL-2.0-or-later", ["GPL2later", "GPLwarranty", "GPLsee", "GPLcopy"]),
    ("GPL-2.0-or-later", ["GPL2later"]),
    ("LGPL-3.0-or-later", ["LGPL3later", "LGPLwarranty", "LGPLsee", "LGPLcopy"]),
    ("LGPL-3.0-or-later", ["LGPL3later"]),
    ("LGPL-2.1-or-later", ["LGPL21later", "LGPLwarranty", "LGPLsee", "LGPLcopy"]),
    ("LGPL-2.1-or-later", ["LGPL21later"]),
    ("AGPL-3.0-or-later", ["AGPL3later", "GPLwarranty", "AGPLsee", "AGPLcopy"]),
    ("AGPL-3.0-or-later", ["AGPL3later"]),
    ("BSD-3-Clause", ["BSDpre", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis", "BSDliability"]),
    ("BSD-3-Clause", ["BSDpre", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis"]),
    ("BSD-2-Clause", ["BSDpre", "BSDsource", "BSDbinary", "BSDasis", "BSDliability"]),
    ("BSD-2-Clause", ["BSDpre", "BSDsource", "BSDbinary", "BSDasis"]),
    ("MPL-2.0", ["MPL2ref", "MPL2copy"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiability", "ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiability", "ZlibGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("Unlicense", ["Unlicense", "UnlicenseFree"]),
    ("GPL-2.0-only", ["GPL2only", "GPLwarranty", "GPLsee", "GPLcopy"]),
    ("GPL-2.0-only", ["GPL2only"]),
    ("LGPL-2.0-or-later", ["LGPL2later", "LGPLwarranty", "LGPLsee", "LGPLcopy"]),
    ("LGPL-2.0-or-later", ["LGPL2later"]),
    ("MIT", ["MITref"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("GPL-3.0", ["GPL3ref"]),
    ("GPL-3.0-or-later", ["GPL3spdx"]),
    ("GPL-2.0-or-later", ["GPL2spdx"]),
    ("BSD-3-Clause", ["BSD3spdx"]),
    ("CC-BY-4.0", ["CCBY4ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"]),
    ("CC0-1.0", ["CC0waive"]),
    ("Unlicense", ["Unlicense"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("BSL-1.0", ["BoostRef"]),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"]),
    ("EPL-2.0", ["EPL2ref"]),
    ("ISC", ["ISCref"]),
    ("Proprietary", ["AllRights"]),
]
RULES += [(name, [f"tag:{name}"]) for name in TAGGED]
#: Every known sentence holds one of these.
CUES = ["licen", "permission", "copyright", "warrant", "liable", "redistribut", "gnu general", "rights reserved", "public domain", "copy of the mpl", "misrepresented", "this notice may", "free to copy"]
assert all(any(c in s for c in CUES) for s in SENTENCES)

#: In normalised text: what stands before a line's or sentence's first word, between two words, and after the last.
PREFIX = r"(?:rem|dnl|c) "
START = rf"(?:^|\n|[.!?:;] ) ?[.!?:;]*+(?:{PREFIX}|[a-z0-9] )?"
BETWEEN = rf"(?=[ !?:;\n])[ !?:;]*+(?:\n[ .!?:;]*+(?:{PREFIX})?)?"
END = r"(?=[ .!?:;]*(?:\n|$|[.!?:;] ))"


#: Two words side by side within a sentence and line: something is said there that isn't known. In normalised text, and as the SQL has it.
SAID = r"[a-z]{2,}(?: |[!?:;](?! ))+[a-z]{2,}"
SAID_SQL = "[a-z]{2,}[ !?:;]+[a-z]{2,}"
UNKNOWN = "UNKNOWN"


def cue_pattern() -> str:
    """Any cue word in any case, wrapped or not."""
    return "(?i)" + "|".join(c.replace(" ", r"[^a-z0-9]+(?:(?:rem|dnl|c)[^a-z0-9]+)?") for c in CUES)


def known_pattern() -> str:
    """Any known sentence as a group, longer ones first."""
    known = sorted(SENTENCES, key=len, reverse=True)
    return START + "(" + "|".join(s.replace(".", r"\.").replace(" ", BETWEEN) for s in known) + ")" + END


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), r"[^a-z0-9.!?:;\n]+", " ")


def one_line(sentence: Column) -> Column:
    """A known sentence as found, in the form of SENTENCES."""
    return F.regexp_replace(sentence, rf"[ !?:;]*\n[ .!?:;]*(?:{PREFIX})?|[ !?:;]+", " ")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """`doc_id, sentence_ids, licenses, n_sentences, n_unmatched` of each row.

    sentence_ids (with UNKNOWN between two known sentences that others stand between) and licenses are in the order of the text,
    the former joined by `;`, the latter by `,`; the counts are of known sentences.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    text = F.coalesce(F.col("text"), F.lit(""))

    def sequence(x):
        named = F.filter(F.transform(x["found"], lambda s, i: F.struct(F.try_element_at(known, one_line(s)).alias("id"), F.get(x["gaps"], i).alias("gap"))), lambda n: n["id"].isNotNull())
        return F.flatten(F.transform(named, lambda n, i: F.when((i > 0) & n["gap"].rlike(SAID), F.array(F.lit(UNKNOWN), n["id"])).otherwise(F.array(n["id"]))))

    def searched(t):
        return let(F.struct(F.regexp_extract_all(t, F.lit(known_pattern()), F.lit(1)).alias("found"), F.split(t, known_pattern()).alias("gaps")), sequence)

    # texts without a cue word aren't searched at all
    found = F.when(text.rlike(cue_pattern()), let(normalised(text), searched))
    ids = docs.select(F.col("doc_id").cast("long"), F.coalesce(found, F.array().cast("array<string>")).alias("ids"))
    tokens = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    named = reduce(lambda c, rule: F.replace(c, F.lit("".join(f"<{i}>" for i in rule[1])), F.lit(f"[{rule[0]}]")), RULES, tokens)
    out = ids.select("doc_id", F.concat_ws(";", "ids").alias("sentence_ids"), named.alias("named"), F.size(F.array_remove("ids", UNKNOWN)).cast("long").alias("n_sentences"))
    return out.select(
        "doc_id", "sentence_ids", F.concat_ws(",", F.expr(r"regexp_extract_all(named, '\\[([^\\]]*)\\]', 1)")).alias("licenses"), "n_sentences",
        F.size(F.array_remove(F.expr(r"regexp_extract_all(named, '<([^>]*)>', 1)"), UNKNOWN)).cast("long").alias("n_unmatched"),
    )


def oracle() -> str:
    """The scan in DuckDB's SQL, for texts whose sentences stand on one line each and have no break inside."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    named = "tokens"
    for name, ids in RULES:
        named = f"replace({named}, '{''.join(f'<{i}>' for i in ids)}', '[{name}]')"
    return f"""
        with known(s, id) as (values {values}),
        cut as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?:;])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) as ss from documents),
        each as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as k from cut),
        said as (select doc_id, k, regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') as s, regexp_matches(regexp_replace(lower(s), '[^a-z0-9.!?:;]+', ' ', 'g'), '{SAID_SQL}') as words from each),
        told as (select doc_id, k, id, words from said left join known using (s)),
        numbered as (select *, sum(case when id is null and words then 1 else 0 end) over (partition by doc_id order by k) as others from told),
        found as (select doc_id, k, id, others > lag(others) over (partition by doc_id order by k) as apart from numbered where id is not null),
        seq as (select doc_id, string_agg(case when apart then '{UNKNOWN};' else '' end || id, ';' order by k) as sentence_ids, string_agg(case when apart then '<{UNKNOWN}>' else '' end || '<' || id || '>', '' order by k) as tokens, count(*) as n from found group by doc_id),
        named as (select doc_id, sentence_ids, {named} as named, n from seq)
        select d.doc_id, coalesce(sentence_ids, '') as sentence_ids,
               coalesce(array_to_string(regexp_extract_all(named, '\\[([^\\]]*)\\]', 1), ','), '') as licenses,
               coalesce(n, 0)::bigint as n_sentences, coalesce(len([x for x in regexp_extract_all(named, '<([^>]*)>', 1) if x <> '{UNKNOWN}']), 0)::bigint as n_unmatched
        from documents d left join named using (doc_id)"""
