"""Licence recognition by sentences, in DataFrame functions only.

A text is cut into sentences (at end marks before white space and at blank lines; the
lines of a wrapped sentence are looked at too), each is normalised to lower-case words,
stock lead-ins and references ("this software is released under", "see LICENSE") and the
holder's name in the third BSD clause are taken away, a sentence or an SPDX tag that joins
several licences is taken apart, and those which are known licence sentences become
identifiers. A licence is recognised if a rule's identifiers occur in
the rule's order (one walk along them, however long the text); of two rules of which one begins with the other, the longer one wins.

Defined results: a null or empty text has no sentences, no identifiers and no licence;
repeated rows are judged alike; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: licences by the names that sentences call them by, normalised, and their SPDX identifiers (fixed values)
NAMES = {
    "MIT": ("the mit license", "mit license", "the mit licence", "spdx license identifier mit"),
    "Apache-2.0": ("the apache license version 2 0", "apache license version 2 0", "the apache license 2 0", "apache license 2 0", "spdx license identifier apache 2 0"),
    "GPL-2.0": ("the gnu general public license version 2", "gnu general public license version 2", "the gnu gpl version 2", "the gpl v2", "gplv2", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later", "spdx license identifier gpl 2 0"),
    "GPL-3.0": ("the gnu general public license version 3", "gnu general public license version 3", "the gnu gpl version 3", "the gpl v3", "gplv3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later", "spdx license identifier gpl 3 0"),
    "LGPL-2.1": ("the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1", "the lgpl v2 1", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "gnu lesser general public license version 3", "the lgpl v3", "spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "gnu affero general public license version 3", "the agpl v3", "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"),
    "MPL-2.0": ("the mozilla public license version 2 0", "mozilla public license version 2 0", "the mozilla public license 2 0", "the mpl 2 0", "spdx license identifier mpl 2 0"),
    "BSD-2-Clause": ("the bsd 2 clause license", "bsd 2 clause license", "the simplified bsd license", "spdx license identifier bsd 2 clause"),
    "BSD-3-Clause": ("the bsd 3 clause license", "bsd 3 clause license", "the new bsd license", "the modified bsd license", "spdx license identifier bsd 3 clause"),
    "ISC": ("the isc license", "isc license", "spdx license identifier isc"),
    "Unlicense": ("the unlicense", "unlicense", "spdx license identifier unlicense"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 universal license", "spdx license identifier cc0 1 0"),
    "Artistic-2.0": ("the artistic license 2 0", "artistic license 2 0", "spdx license identifier artistic 2 0"),
    "CC-BY-4.0": ("cc by 4 0", "the creative commons attribution 4 0 international license", "a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "the creative commons attribution sharealike 4 0 international license", "a creative commons attribution sharealike 4 0 international license", "spdx license identifier cc by sa 4 0"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "the creative commons attribution noncommercial 4 0 international license", "a creative commons attribution noncommercial 4 0 international license", "spdx license identifier cc by nc 4 0"),
}

#: known sentences of licence texts, normalised, and their identifiers (fixed values)
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2 0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "see the gnu general public license for more details": "gpl-details",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "see the gnu affero general public license for more details": "agpl-details",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-disclaimer",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-deed",
    "the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "all rights reserved": "all-rights",
}

#: rules: a licence and the identifiers to be met in this order (fixed values)
TEXT_RULES = (
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-head", "apache-compliance", "apache-copy")),
    ("GPL-2.0", ("gpl2-grant", "gpl-details")),
    ("GPL-3.0", ("gpl3-grant", "gpl-details")),
    ("LGPL-2.1", ("lgpl21-grant", "lgpl-details")),
    ("LGPL-3.0", ("lgpl3-grant", "lgpl-details")),
    ("AGPL-3.0", ("agpl3-grant", "agpl-details")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("ISC", ("isc-grant", "isc-disclaimer")),
    ("Unlicense", ("unlicense-head", "unlicense-grant")),
    ("CC0-1.0", ("cc0-deed",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("all-rights-reserved", ("all-rights",)),
)

#: stock words before and after a licence's name, and a holder's name in the third BSD clause
LEAD = r"^((this|the|these|our|all) ([a-z0-9]+ ){1,4}(is|are) |(is|are) )?(dual |also |hereby )?(licensed|released|distributed|published|made available|available|provided) under (the terms of |the terms and conditions of )?"
TAIL = r" (see|refer to) (the )?(accompanying |included )?(license|licence|copying|notice)( (license|licence|copying|notice))?( (md|txt|rst))?( files?)?( for (more |full |further )?(details|information))?$"
#: several licences in one sentence: how they are joined, and words that belong to none
JOINED = " (or|and) "
AROUND = "^either (of )?| at your option$| with [a-z0-9 ]*exception.*$"
LISTS = ("licensed under ", "spdx license identifier ")
HOLDER = r"^neither the names? of .* nor the names of"

#: names that stand only behind "licensed under" or alone in an SPDX tag (fixed values)
SHORT_NAMES = {
    "MIT": ("mit", "the mit", "the expat license"), "Apache-2.0": ("apache 2 0", "the apache 2 0 license", "apache 2 0 license", "the apache 2 license", "apache v2", "the apache license v2 0"),
    "GPL-2.0": ("the gplv2", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later", "the gpl 2 0"), "GPL-3.0": ("the gplv3", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later", "the gpl 3 0", "the gnu gplv3"),
    "LGPL-2.1": ("lgpl 2 1", "lgpl 2 1 or later", "the lgplv2 1"), "LGPL-3.0": ("lgpl 3 0", "lgpl 3 0 or later", "the lgplv3"), "AGPL-3.0": ("agpl 3 0", "agpl 3 0 or later", "the agplv3", "agplv3"),
    "MPL-2.0": ("mpl 2 0",), "BSD-2-Clause": ("bsd 2 clause",), "BSD-3-Clause": ("bsd 3 clause",), "ISC": ("isc", "the isc"),
}

SENTENCES = {f"licensed under {n}": f"{name}-name" for name, names in SHORT_NAMES.items() for n in names}
SENTENCES |= {f"licensed under {n}": f"{name}-name" for name, names in NAMES.items() for n in names if not n.startswith("spdx")}
SENTENCES |= {n: f"{name}-name" for name, names in NAMES.items() for n in names if len(n.split()) > 2 or n.startswith("spdx")}
SENTENCES |= TEXTS
RULES = tuple((name, (f"{name}-name",)) for name in NAMES) + TEXT_RULES


def _longer(ids: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The rules of which ``ids`` is only the beginning."""
    return [other for _, other in RULES if len(other) > len(ids) and other[: len(ids)] == ids]


_SPACE = r"\x20\x09-\x0D"


def _pattern(ids: tuple[str, ...]) -> str:
    return "(^|,)" + ",(.*,)?".join(ids) + "(,|$)"


def sentences(text: Column) -> Column:
    """Normalised sentences; the lines of those that span several follow them."""
    tag = F.lit("spdx-license-identifier")
    marked = F.regexp_replace(F.replace(F.lower(text), F.concat(tag, F.lit(":")), tag), rf"[.!?;:]+([{_SPACE}]|$)|\n[{_SPACE}]*\n", "\x01$1")
    plain = F.regexp_replace(marked, "[^a-z0-9\x01\n]+", " ")

    def words(s: Column) -> Column:
        return F.trim(F.regexp_replace(s, "[ \n]+", " "))

    def with_lines(s: Column) -> Column:
        # the newline that came with an end mark stands first and makes no second line
        lines = F.filter(F.split(s, "\n"), lambda x: F.trim(x) != "")
        return F.when(F.size(lines) > 1, F.concat(F.array(words(s)), F.transform(lines, F.trim))).otherwise(F.array(words(s)))

    def bare(s: Column) -> Column:
        led = F.regexp_replace(F.regexp_replace(s, TAIL, ""), LEAD, "licensed under ")
        return F.when(s.contains("licen") | s.contains("under "), led).when(s.startswith("neither"), F.regexp_replace(s, HOLDER, "neither the name of nor the names of")).otherwise(s)

    def several(s: Column) -> Column:
        """The sentence, or one of each licence that it joins."""
        lead = F.when(s.startswith(LISTS[0]), LISTS[0]).when(s.startswith(LISTS[1]), LISTS[1])
        rest = F.replace(F.regexp_replace(F.substr(s, F.char_length(lead) + 1), AROUND, ""), F.lit(" or later"), F.lit(" orlater"))
        pieces = F.transform(F.split(rest, JOINED), lambda p: F.concat(lead, F.replace(p, F.lit(" orlater"), F.lit(" or later"))))
        return F.when(lead.isNotNull() & s.rlike(JOINED), pieces).otherwise(F.array(s))

    parts = F.filter(F.flatten(F.transform(F.split(plain, "\x01"), with_lines)), lambda s: s != "")
    return F.flatten(F.transform(F.transform(parts, bare), several))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (known sentences), sentence_ids (comma-joined, in order) and
    licences (comma-joined, by name)."""
    known = F.filter(sentences(F.coalesce("text", F.lit(""))), lambda s: s.isin(*SENTENCES))
    names = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    rows = docs.select("doc_id", F.transform(known, lambda s: names[s]).alias("ids"))
    rows = rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"))

    def met(rule: tuple[str, ...]) -> Column:
        """Whether the identifiers occur in this order: one walk along the sequence."""
        wanted = F.array(*[F.lit(x) for x in rule])
        at = F.aggregate("ids", F.lit(0), lambda k, x: k + F.coalesce(F.get(wanted, k) == x, F.lit(False)).cast("int"))
        return F.array_contains("ids", rule[0]) if len(rule) == 1 else F.array_contains("ids", rule[-1]) & (at == len(rule))

    def hit(ids: tuple[str, ...]) -> Column:
        return reduce(and_, [~met(x) for x in _longer(ids)], met(ids))

    hits = [F.when(hit(ids), F.lit(name)) for name, ids in RULES]
    found = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",")
    return rows.withColumn("licences", F.when(F.col("n_known") > 0, found).otherwise(F.lit(""))).drop("ids")


def oracle_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = ", ".join(f"('{name}', '{_pattern(ids)}', '{_pattern(_longer(ids)[0]) if _longer(ids) else '^never$'}')" for name, ids in RULES)
    return f"""
with known(s, id) as (values {known}), rules(licence, pattern, longer) as (values {rules}),
d as (
  select doc_id, string_split(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), 'spdx-license-identifier:', 'spdx-license-identifier'),
         '[.!?;:]+([{_SPACE}]|$)|\\n[{_SPACE}]*\\n', chr(1) || '\\1', 'g'), '[^a-z0-9\\x01\\n]+', ' ', 'g'), chr(1)) as parts
  from documents),
p as (select doc_id, generate_subscripts(parts, 1) as i, unnest(parts) as part from d),
l as (select doc_id, i, part, list_filter(string_split(part, chr(10)), lambda x: trim(x) <> '') as lines from p),
s as (select doc_id, i, 0 as j, trim(regexp_replace(part, '[ \\n]+', ' ', 'g')) as s from l
      union all select doc_id, i, generate_subscripts(lines, 1) as j, trim(unnest(lines)) as s from l where len(lines) > 1),
b0 as (select doc_id, i, j, case when contains(s, 'licen') or contains(s, 'under ') then regexp_replace(regexp_replace(s, '{TAIL}', ''), '{LEAD}', 'licensed under ')
        when starts_with(s, 'neither') then regexp_replace(s, '{HOLDER}', 'neither the name of nor the names of') else s end as s from s where s <> ''),
b1 as (select *, case when starts_with(s, '{LISTS[0]}') then '{LISTS[0]}' when starts_with(s, '{LISTS[1]}') then '{LISTS[1]}' end as lead from b0),
b2 as (select doc_id, i, j, case when lead is not null and regexp_matches(s, '{JOINED}') then list_transform(regexp_split_to_array(replace(regexp_replace(s[length(lead) + 1:], '{AROUND}', '', 'g'), ' or later', ' orlater'), '{JOINED}'),
        lambda p: lead || replace(p, ' orlater', ' or later')) else [s] end as ss from b1),
b as (select doc_id, i, j, generate_subscripts(ss, 1) as k, unnest(ss) as s from b2),
h as (select s.doc_id, count(*)::bigint as n_known, string_agg(known.id, ',' order by i, j, k) as sentence_ids from b as s join known on s.s = known.s group by s.doc_id),
f as (select doc_id, string_agg(distinct licence, ',' order by licence) as licences from h join rules on regexp_matches(h.sentence_ids, rules.pattern) and not regexp_matches(h.sentence_ids, rules.longer) group by doc_id)
select d.doc_id, coalesce(h.n_known, 0)::bigint as n_known, coalesce(h.sentence_ids, '') as sentence_ids, coalesce(f.licences, '') as licences
from documents d left join h using (doc_id) left join f using (doc_id)"""
