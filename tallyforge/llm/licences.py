"""Licence recognition by sentences and rules, in DataFrame functions alone.

A text is cut into sentences, each is normalised and looked up in a table of known licence
sentences. The identifiers found, in order, form a sequence; ordered rules are matched
against it and each rule takes the identifiers that it used, so that later rules see only
what is left. Licence sentences that no rule explains are reported as such; so is, as ``Mention``, a sentence that speaks of a
licence but is no known one ("licensed under the Foo License"). Mentions take no part in the rules.

Comment marks at line starts are dropped. Sentences end at stops, at blank lines and at colons before a line end;
line ends inside one may be wrapping or not. So a sentence is looked up whole; if that finds
nothing, each of its lines is, and what lines are left is looked up joined. All that is found counts, in order of place (lines
found by themselves before the joined rest of their sentence).

Null and empty text: no sentences, no licences. Texts of any length are looked at whole. A sentence that fits several patterns
(a tie) has the first. Repeated rows and all other columns, whatever their names, pass through. No shuffle; the tables are fixed literals.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import let, table

_THIS, _GIVEN = r"(?:th(?:is|e) (?:file|work|software|project|code|program|library|text|source code|package|module) is )?", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"
_LATER = r"[,;]? ?(?:either )?(?:version|v) ?{v}(?:\.0)?(?: of the license)?,? or \(?(?:at your option\)? )?any later version.*"
_GNU = {"GPL": ("general", ("2", "3")), "LGPL": ("(?:lesser|library) general", ("2", "2\\.1", "3")), "AGPL": ("affero general", ("3",))}
_FIXED = {
    "Apache2": _THIS + _GIVEN + r"apache(?: license)?,? (?:version |v ?)?2(?:\.0)?(?: \(the license\))?(?:[;,].*)?",
    "ApacheTitle": r"apache license,? version 2\.0(?:, january 2004)?(?: http.*)?",
    "ApacheUse": r"you may not use this file except in compliance with the license",
    "ApacheCopy": r"you may obtain a copy of the license at(?: .*)?",
    "AsIsLicense": r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis,? without warranties or conditions of any kind,? either express or implied",
    "SeeLicense": r"see the license for the specific language governing permissions and limitations under the license",
    "MITref": _THIS + _GIVEN + r"mit(?:/x11)? license(?: \(mit\))?",
    "MITtitle": r"(?:the )?mit license(?: \(mit\))?",
    "MITgrant": r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files \(the software\),? to deal in the software without restriction.*",
    "MITnotice": r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software",
    "MITasis": r"the software is provided as is,? without warranty of any kind.*",
    "MITliable": r"in no event shall the authors or copyright holders be liable for any claim,? damages or other liability.*",
    "BSDref": _THIS + _GIVEN + r"(?:(?:new |modified |simplified )?bsd license|bsd-style license.*)",
    "BSD2ref": _THIS + _GIVEN + r"(?:2-clause bsd license|bsd 2-clause license.*)",
    "BSD3ref": _THIS + _GIVEN + r"(?:3-clause bsd license|bsd 3-clause license.*)",
    "BSDtitle": r"(?:the )?bsd [23]-clause (?:simplified |new or revised |new |revised )?license",
    "BSDgrant": r"redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met:?",
    "BSDsource": r"(?:\d\. )?redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer",
    "BSDbinary": r"(?:\d\. )?redistributions in binary form must reproduce the above copyright notice,? this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSDnames": r"(?:\d\. )?neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSDasis": r"this software is provided by .* as is and any express or implied warranties.*",
    "BSDliable": r"in no event shall .* be liable for any direct,? indirect,? incidental,? special.*",
    "MPL2": r"this source code form is subject to the terms of the mozilla public license,? v ?2\.0",
    "MPL2ref": _THIS + _GIVEN + r"mozilla public license,? (?:version |v ?)?2\.0",
    "MPLtitle": r"mozilla public license,? version 2\.0",
    "MPLcopy": r"if a copy of the mpl was not distributed with this file,? you can obtain one at .*",
    "ISCref": _THIS + _GIVEN + r"isc license",
    "ISCtitle": r"(?:the )?isc license(?: \(isc\))?",
    "ISCgrant": r"permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice and this permission notice appear in all copies",
    "ISCasis": r"the software is provided as is and .* disclaims all warranties.*",
    "CC0": r"(?:this (?:file|work|text) is )?(?:dedicated to the public domain under|released under|licensed under) cc0(?: 1\.0)?(?: universal)?",
    "Unlicense": r"this is free and unencumbered software released into the public domain",
    "GNUhope": r"this (?:program|library) is distributed in the hope that it will be useful,? but without any warranty.*",
    "GNUsee": r"see the gnu (?:lesser |library |affero )?general public license for more details",
    "GNUcopy": r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license.*",
    "Reserved": r"(?:copyright .*)?all rights reserved",
    "Copyright": r"(?:portions )?copyright (?:\(c\)|©)? ?(?:\d{4}|<year>|\[yyyy\]).*",
}
_CC = {"BY": "attribution", "BY-SA": "attribution-sharealike", "BY-NC": "attribution-noncommercial", "BY-ND": "attribution-noderivatives", "BY-NC-SA": "attribution-noncommercial-sharealike", "BY-NC-ND": "attribution-noncommercial-noderivatives"}
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
# Further sentences of licence texts.
_MORE = {
    "ZlibAsis": r"this software is provided as-is,? without any express or implied warranty",
    "ZlibLiable": r"in no event will the authors? be held liable for any damages arising from the use of this software",
    "ZlibGrant": r"permission is granted to anyone to use this software for any purpose,? including commercial applications,? and to alter it and redistribute it freely.*",
    "BSLtitle": r"boost software license - version 1\.0 - august 17th,? 2003",
    "BSLgrant": r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*",
    "BSLfile": r"\(?see accompanying file license_1_0\.txt or copy at .*",
}
_NUM = r",?[ -]?(?:version |v\.? ?)?"
# How prose names a licence, by its public identifier.
_NAMES = {
    "Apache-2.0": rf"(?:the )?(?:apache(?: software)?(?: licen[sc]e)?|asl|al){_NUM}2(?:\.0)?",
    "MIT": r"(?:mit(?:/x11)?|x11/mit|expat)",
    "BSD-2-Clause": r"(?:bsd[ -]2[ -]clause|(?:2|two)[ -]clause bsd|simplified bsd|freebsd)",
    "BSD-3-Clause": r"(?:bsd[ -]3[ -]clause|(?:3|three)[ -]clause bsd|(?:new|modified|revised) bsd)",
    "BSD": r"bsd(?:-style)?",
    "MPL-2.0": rf"(?:mozilla public licen[sc]e|mpl){_NUM}2(?:\.0)?",
    "MPL-1.1": rf"(?:mozilla public licen[sc]e|mpl){_NUM}1\.1",
    "EPL-2.0": rf"(?:eclipse public licen[sc]e|epl)(?: -)?{_NUM}2(?:\.0)?",
    "EPL-1.0": rf"(?:eclipse public licen[sc]e|epl)(?: -)?{_NUM}1(?:\.0)?",
    "CDDL-1.0": rf"(?:common development and distribution licen[sc]e|cddl){_NUM}1(?:\.0)?",
    "EUPL-1.2": rf"(?:european union public licen[sc]e|eupl){_NUM}1\.2",
    "BSL-1.0": rf"(?:boost software licen[sc]e|boost|bsl)(?:{_NUM}1(?:\.0)?)?",
    "Artistic-2.0": rf"artistic(?: licen[sc]e)?{_NUM}2(?:\.0)?",
    "OFL-1.1": rf"(?:sil )?(?:open font licen[sc]e|ofl){_NUM}1\.1",
    "Zlib": r"zlib(?:/libpng)?", "ISC": r"isc", "WTFPL": r"wtfpl", "Unlicense": r"unlicense", "CC0-1.0": r"cc0(?:[ -]1\.0)?(?: universal)?", "PostgreSQL": r"postgresql",
}
_GNU_NAMES = {"LGPL": r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", "AGPL": r"(?:gnu )?(?:affero general public licen[sc]e|agpl)", "GPL": r"(?:gnu )?(?:general public licen[sc]e|gpl)"}
_OR_LATER = r"(?:\+|,?[ -]?or[ -](?:\(at your option\) |at your option,? )?(?:any )?(?:later|newer|greater|above)(?: version)?)"
#: What comes before a name in prose, and what may follow it.
_SUBJECT = r"(?:(?:(?:this|the|these|all|our) (?:[^ ]+ ){0,6}?|[^ ]+ )(?:is|are) )?(?:(?:dual|also)[ -])?(?:made )?"
_GIVER = r"(?:re)?(?:licensed|released|distributed|available|published|provided)"
_UNDER = _GIVER + r"(?: to you)? under (?:an? |the )?(?:terms (?:and conditions )?of )?(?:(?:either|both)(?: of)? )?(?:an? |the )?"
_GOVERNED = r"use of this [^ ]+(?: [^ ]+)? is governed by (?:an? |the )?"
_LABEL = r"(?:[^ ]+ )?licen[sc]e ?[:=]{1,2} ?(?:osi approved ?::? ?)?(?:the )?"
_TAIL = (
    r"(?: licen[sc]es?)?(?:,? ?(?:\([^)]*\)|<[^>]*>|\[[^\]]*\]))*"
    r"(?:[,;:]? (?:at your option|see|which|that can|that is|found|contained|included|a copy|as (?:described|found|given|stated)|in the|for details|for more|details|available|[–—-]+)(?: .*)?)?,?"
)
#: A sentence that speaks of a licence, looked for where no known sentence was found; "licensed under either of" alone heads a list of them.
MENTION = rf"licensed under (?:[^e ]|e[^i ]|[^ ]+ [^o])|{_GIVER} under [^.]{{0,200}}(?:licen[sc]e|gpl)|governed by [^.]{{0,200}}licen[sc]e|^licen[sc]e ?[:=] ?[^ ]|^spdx-license-identifier"


def _names() -> dict[str, str]:
    """public identifier -> pattern of its names; those of the GNU family with and without later versions."""
    out = dict(_NAMES)
    for name, words in _GNU_NAMES.items():
        for v in _GNU[name][1]:
            shown = f"{name}-{v.replace(chr(92), '')}{'' if '.' in v else '.0'}"
            numbered = rf"{words}(?: licen[sc]e)?(?: \([a-z]*\))?{_NUM}{v}(?:\.0)?"
            out[f"{shown}-or-later"] = numbered + _OR_LATER
            out[f"{shown}-only"] = rf"{numbered}(?:[ -]only)?"
        out[name] = words
    return out


def _known() -> dict[str, str]:
    """identifier -> pattern of the normalised sentence; those of families of licences and versions are made from a rule."""
    out = dict(_FIXED)
    for name, (words, versions) in _GNU.items():
        for v in versions:
            tag, public = f"{name}{v.replace(chr(92), '')}", rf"gnu {words} public license"
            later = _LATER.format(v=v)
            out[f"{tag}grant"] = rf"(?:this (?:program|library|file|software)|[^ ]+(?: [^ ]+)?) is free software[:;]? you can redistribute it and/or modify it under the terms of the {public} as published by the free software foundation{later}"
            out[f"{tag}only"] = rf"(?:this (?:program|library|file|software)|[^ ]+(?: [^ ]+)?) is free software[:;]? you can redistribute it and/or modify it under the terms of the {public},? (?:version {v}(?:\.0)?,? )?as published by the free software foundation(?:[,;]? version {v}(?:\.0)?(?: of the license)?)?"
            out[f"{tag}laterref"] = rf"{_THIS}{_GIVEN}{public}{later}"
            out[f"{tag}ref"] = rf"{_THIS}{_GIVEN}{public},? (?:version|v) ?{v}(?:\.0)?(?: only)?"
            out[f"{tag}title"] = rf"{public},? version {v}(?:\.0)?,? \d* ?[a-z]+ \d{{4}}"
    for short, words in _CC.items():
        for v in _CC_VERSIONS:
            dotted = v.replace(".", r"\.")
            out[f"CC{short}{v}"] = rf"(?:this (?:file|work|text|document) is )?licensed under (?:a |the )?(?:cc {short.lower()} {dotted}|creative commons {words} {dotted}(?: (?:international|unported|generic))?(?: license)?)"
    for name, pattern in _names().items():
        out[f"Name:{name}"] = rf"(?:{_SUBJECT}{_UNDER}|{_GOVERNED}|{_LABEL})(?:{pattern}){_TAIL}|(?:{pattern})[ -]licensed"
    return out | _MORE


# Public identifiers beside those of the families and of the texts above.
_SPDX_MORE = (
    "0BSD", "AFL-3.0", "Apache-1.0", "Apache-1.1", "Artistic-1.0", "Artistic-2.0", "Beerware", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CDDL-1.0", "CDDL-1.1",
    "CECILL-2.1", "CPL-1.0", "curl", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-1.0-or-later", "HPND", "ICU", "IJG", "IPL-1.0", "JSON", "LPPL-1.3c",
    "Libpng", "MIT-0", "MPL-1.0", "MPL-1.1", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "NTP", "ODbL-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "QPL-1.0", "Ruby",
    "Sleepycat", "SSPL-1.0", "TCL", "Unicode-3.0", "Unicode-DFS-2016", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)


def _spdx() -> list[str]:
    gnu = [f"{n}-{v.replace(chr(92), '')}{'' if '.' in v else '.0'}-{how}" for n, (_, vs) in _GNU.items() for v in vs for how in ("or-later", "only")]
    return [*gnu, *(f"CC-{s}-{v}" for s in _CC for v in _CC_VERSIONS), "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "Unlicense", *_SPDX_MORE]


def _made_rules() -> tuple:
    """Rules of the families: a grant with what goes with it, else a reference or title."""
    gnu = []
    for name, (_, versions) in _GNU.items():
        for v in versions:
            tag, shown = f"{name}{v.replace(chr(92), '')}", f"{name}-{v.replace(chr(92), '')}{'' if '.' in v else '.0'}"
            gnu += [((f"{tag}grant", "GNUhope?", "GNUsee?", "GNUcopy?"), f"{shown}-or-later"), ((f"{tag}laterref", "GNUhope?"), f"{shown}-or-later")]
            gnu += [((f"{tag}only", "GNUhope?", "GNUsee?", "GNUcopy?"), f"{shown}-only"), ((f"{tag}ref", "GNUhope?"), f"{shown}-only"), ((f"{tag}title",), shown)]
    return (*gnu, *(((f"CC{s}{v}",), f"CC-{s}-{v}") for s in _CC for v in _CC_VERSIONS), *(((f"SPDX:{x}",), x) for x in _spdx()), *(((f"Name:{x}",), x) for x in _names()))


#: identifier -> normalised sentence, as a pattern on lower-case words.
SENTENCES = {f"SPDX:{x}": r"spdx-license-identifier: \(?" + x.lower().replace(".", r"\.").replace("-or-later", r"(?:-or-later|\+)").replace("-only", "(?:-only)?") + r"\)?(?: with [a-z0-9.-]+\)?)?" for x in _spdx()} | _known()
# Ordered rules, identifier sequence -> licence; ? marks identifiers that may be absent. A title alone counts where no sentence of its licence follows.
_RULES = (
    (("Apache2", "ApacheUse", "ApacheCopy?", "AsIsLicense?", "SeeLicense?"), "Apache-2.0"),
    (("Apache2",), "Apache-2.0"),
    (("ApacheTitle",), "Apache-2.0"),
    (("MITtitle?", "Copyright?", "Reserved?", "MITgrant", "MITnotice?", "MITasis?", "MITliable?"), "MIT"),
    (("MITref",), "MIT"),
    (("MITtitle",), "MIT"),
    (("BSDtitle?", "Copyright?", "Reserved?", "BSDgrant", "BSDsource", "BSDbinary", "BSDnames", "BSDasis?", "BSDliable?"), "BSD-3-Clause"),
    (("BSDtitle?", "Copyright?", "Reserved?", "BSDgrant", "BSDsource", "BSDbinary", "BSDasis?", "BSDliable?"), "BSD-2-Clause"),
    (("BSD3ref",), "BSD-3-Clause"),
    (("BSD2ref",), "BSD-2-Clause"),
    (("BSDref",), "BSD"),
    (("MPL2", "MPLcopy?"), "MPL-2.0"),
    (("MPL2ref",), "MPL-2.0"),
    (("MPLtitle",), "MPL-2.0"),
    (("ISCtitle?", "Copyright?", "ISCgrant", "ISCasis?"), "ISC"),
    (("ISCref",), "ISC"),
    (("ISCtitle",), "ISC"),
    (("CC0",), "CC0-1.0"),
    (("Unlicense",), "Unlicense"),
    (("ZlibAsis?", "ZlibLiable?", "ZlibGrant"), "Zlib"),
    (("BSLtitle?", "BSLgrant"), "BSL-1.0"),
    (("BSLtitle",), "BSL-1.0"),
    (("Name:BSL-1.0", "BSLfile?"), "BSL-1.0"),
    *_made_rules(),
)
#: Rights reserved right before a licence are no refusal of it.
RULES = (*((parts if "Reserved?" in parts else ("Copyright?", "Reserved?", *parts), name) for parts, name in _RULES), (("Reserved",), "Proprietary"))
#: Every known sentence has one of these, and so has any text that is looked at further.
ANCHOR = r"licen[sc]e|copyright|permission|redistribution|warrant|free software|rights reserved|cc0|public domain|liable|mpl was not|neither the name|any later version|cc by|gpl|(?:released|distributed|available|published|provided)\s+under"
_ANY_NAME = "|".join(p.replace(" ", r"\s") for p in _names().values())

#: What is done to a text before it is cut, in order; \x01 marks a sentence's end.
CUTS = (
    (r"\r\n?", "\n"),
    (r"(?:^|\n)[ \t/*#;!>%-]+", "\n"),
    (r"(?i)\bv\.\s+([0-9])", "v$1"),
    (r"(?i)(spdx-license-identifier:\s*\(?[a-z0-9.+-]+\)?)[ \t]+(?:or|and)[ \t]+", "$1\x01SPDX-License-Identifier: "),
    (r"(?i)(spdx-license-identifier:\s*\(?[a-z0-9.+-]+\)?)[ \t]+(?:or|and)[ \t]+", "$1\x01SPDX-License-Identifier: "),
    (rf"(?i)({_GIVER}\s+under\s+(?:the\s+terms\s+of\s+)?)(?:(?:either|both)(?:\s+of)?\s+)?(?:the\s+)?((?:{_ANY_NAME})(?:\s+licen[sc]e)?(?:\s+\([^)]*\))?)\s*,?\s+(?:or|and)\s+(?:the\s+)?((?:{_ANY_NAME}))", "$1$2\x01$1$3"),
    (r"\n\s*\n", "\x01"),
    (r":[ \t]*\n", "\x01"),
    (r"([.!?])\s+", "$1\x01"),
)
#: And to a sentence or line, after lower-casing.
NORMALISE = ((r"^[\s/*#;!-]+|[\"“”'`*]|[\s.;!?:/*-]+$", ""), (r"\s+", " "))


def normalised(sentence: Column) -> Column:
    """Lower case, no comment marks or quotes, one space between words, no stop at the end."""
    s = F.lower(sentence)
    for pattern, new in NORMALISE:
        s = F.regexp_replace(s, pattern, new)
    return F.trim(s)


def _sentences(text: Column) -> Column:
    """Sentences of text, as written, line ends in them kept."""
    for pattern, new in CUTS:
        text = F.regexp_replace(text, pattern, new)
    return F.split(text, "\x01", -1)


def family(name: str) -> str:
    """A pattern that is found in every sentence of the identifier's family, so that others needn't try it."""
    if name.startswith("SPDX:"):
        return "^spdx-license-identifier"
    if name.startswith("Name:"):
        return "under|governed by|licen[sc]e ?[:=]|licensed"
    if re.match("[AL]?GPL[23]", name):
        return "general public license"
    return "cc by|creative commons" if name.startswith("CCBY") else ANCHOR


def _families(sentences: dict) -> list[tuple[str, list[str]]]:
    return [(anchor, list(names)) for anchor, names in groupby(sentences, family)]


def _identifier(sentence: Column, sentences: dict) -> Column:
    """The first known identifier whose pattern fits the whole normalised sentence; null if none does."""

    def chain(s: Column, names: list[str]) -> Column:
        out = F.lit(None).cast("string")
        for name in reversed(names):
            out = F.when(s.rlike(f"^(?:{sentences[name]})$"), F.lit(name)).otherwise(out)
        return out

    def first(s: Column) -> Column:
        return F.when(s.rlike(ANCHOR), F.coalesce(*(F.when(s.rlike(anchor), chain(s, names)) for anchor, names in _families(sentences))))

    return let(normalised(sentence), first)


def _found(sentence: Column, sentences: dict) -> Column:
    """Identifiers in a sentence: its own, else those of its lines and of what lines are left, joined; else that it mentions a licence."""
    none = F.array().cast("array<string>")
    one = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(none)

    def by_line(lines: Column) -> Column:
        named = F.transform(lines, lambda x: F.struct(x.alias("line"), _identifier(x, sentences).alias("id")))

        def put(all_lines: Column) -> Column:
            known = F.filter(all_lines, lambda y: y["id"].isNotNull())
            left = F.array_join(F.transform(F.filter(all_lines, lambda y: y["id"].isNull()), lambda y: y["line"]), " ")
            return F.concat(F.transform(known, lambda y: y["id"]), F.when(F.size(known) > 0, one(_identifier(left, sentences))).otherwise(none))

        return let(named, put)

    mention = F.when(normalised(sentence).rlike(MENTION), F.array(F.lit("Mention"))).otherwise(none)
    or_mention = lambda ids: F.when(F.size(ids) > 0, ids).otherwise(mention)
    whole = lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(let(let(F.split(sentence, "\n", -1), by_line), or_mention))
    return F.when(F.lower(sentence).rlike(ANCHOR), let(_identifier(sentence, sentences), whole)).otherwise(none)


def _rule_pattern(parts: tuple) -> str:
    each = (p.replace(".", r"\.") for p in parts)
    return "(?<= )" + "".join(f"(?:{p[:-1]} )?" if p.endswith("?") else f"{p} " for p in each)


def recognise(docs: DataFrame, text: str = "text", sentences: dict = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """docs with ``licence_sentences`` (identifiers in order), ``licences`` (sorted, distinct) and ``licence_unmatched`` (identifiers no rule used)."""
    t, none = F.col(text).cast("string"), F.array().cast("array<string>")
    worth = F.coalesce(F.lower(t).rlike(ANCHOR), F.lit(False))
    ids = F.when(worth, F.flatten(F.transform(_sentences(t), lambda s: _found(s, sentences)))).otherwise(none)
    out = docs.withColumn("licence_sentences", ids)
    table_of_rules = F.array(*(F.struct(F.lit(_rule_pattern(parts)).alias("p"), F.lit(name).alias("n")) for parts, name in rules))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["left"], rule["p"])
        return F.struct(F.when(hit, F.call_function("regexp_replace", acc["left"], rule["p"], F.lit("_ "))).otherwise(acc["left"]).alias("left"), F.when(hit, F.array_append(acc["names"], rule["n"])).otherwise(acc["names"]).alias("names"))

    def matched(found: Column) -> Column:
        known = F.filter(found, lambda x: x != "Mention")
        mentions = F.filter(found, lambda x: x == "Mention")
        state = F.struct(F.concat(F.lit(" "), F.array_join(known, " "), F.lit(" ")).alias("left"), none.alias("names"))

        def shown(end: Column) -> Column:
            rest = F.filter(F.split(F.trim(F.regexp_replace(end["left"], "_", "")), " +"), lambda x: (x != "") & (x != "Copyright"))
            return F.struct(F.array_sort(F.array_distinct(end["names"])).alias("names"), F.concat(rest, mentions).alias("rest"))

        return F.when(F.size(found) > 0, let(F.aggregate(table_of_rules, state, apply), shown)).otherwise(F.struct(none.alias("names"), none.alias("rest")))

    hit = let(F.col("licence_sentences"), matched)
    return out.withColumn("licences", hit).withColumn("licence_unmatched", F.col("licences.rest")).withColumn("licences", F.col("licences.names"))


def op3_licences(spark, sf_dir: str) -> DataFrame:
    found = recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("licences", "licence_sentences", "licence_unmatched")), F.size("licences").cast("long").alias("n_licences"))


def oracle(sentences: dict = SENTENCES, rules: tuple = RULES) -> str:
    """The same in DuckDB SQL: sentences and lines unnested with their places, identifiers by the same patterns, rules in order."""
    esc = lambda s: s.replace("'", "''")
    whens = lambda names: " ".join(f"WHEN regexp_full_match(s, '{esc(sentences[k])}') THEN '{k}'" for k in names)
    first = ", ".join(f"CASE WHEN regexp_matches(s, '{anchor}') THEN (CASE {whens(names)} END) END" for anchor, names in _families(sentences))
    identifier = f"CASE WHEN regexp_matches(s, '{ANCHOR}') THEN coalesce({first}) END"
    literal = lambda p: "'" + esc(p).replace("\x01", "' || chr(1) || '").replace("\n", "' || chr(10) || '") + "'"

    def normal(s: str) -> str:
        s = f"lower({s})"
        for pattern, new in NORMALISE:
            s = f"regexp_replace({s}, '{esc(pattern)}', '{new}', 'g')"
        return f"trim({s})"

    cut = "text"
    for pattern, new in CUTS:
        cut = f"regexp_replace({cut}, '{esc(pattern)}', {literal(new.replace('$', chr(92)))}, 'g')"
    ctes = [
        f"worth AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE regexp_matches(lower(text), '{ANCHOR}'))",
        f"cut AS (SELECT r, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM (SELECT r, string_split({cut}, chr(1)) AS p FROM worth))",
        f"whole AS (SELECT r, i, raw, {identifier} AS id FROM (SELECT r, i, raw, {normal('raw')} AS s FROM cut WHERE regexp_matches(lower(raw), '{ANCHOR}')))",
        f"lines AS (SELECT r, i, j, line, {identifier} AS id FROM (SELECT r, i, j, line, {normal('line')} AS s FROM (SELECT r, i, unnest(p) AS line, generate_subscripts(p, 1) AS j FROM (SELECT r, i, string_split(raw, chr(10)) AS p FROM whole WHERE id IS NULL))))",
        f"rest AS (SELECT r, i, {identifier} AS id FROM (SELECT r, i, {normal('l')} AS s FROM (SELECT r, i, string_agg(line, ' ' ORDER BY j) FILTER (WHERE id IS NULL) AS l FROM lines GROUP BY r, i HAVING count(id) > 0)))",
        "known AS (SELECT r, i, 0 AS j, id FROM whole UNION ALL SELECT r, i, j, id FROM lines UNION ALL SELECT r, i, 1000000000, id FROM rest)",
        f"mentions AS (SELECT r, i, 0 AS j, 'Mention' AS id FROM whole WHERE (r, i) NOT IN (SELECT (r, i) FROM known WHERE id IS NOT NULL) AND regexp_matches({normal('raw')}, '{MENTION}'))",
        "found AS (SELECT * FROM known UNION ALL SELECT * FROM mentions)",
        "seqs AS (SELECT r, ids, ' ' || array_to_string(list_filter(ids, lambda x: x <> 'Mention'), ' ') || ' ' AS l, []::VARCHAR[] AS names FROM (SELECT r, list(id ORDER BY i, j) AS ids FROM found WHERE id IS NOT NULL GROUP BY r))",
    ]
    last = "seqs"
    for k, (parts, name) in enumerate(rules):
        p = esc(_rule_pattern(parts).replace("(?<= )", " "))
        ctes.append(f"r{k} AS (SELECT r, ids, CASE WHEN regexp_matches(l, '{p}') THEN regexp_replace(l, '{p}', ' _ ', 'g') ELSE l END AS l, CASE WHEN regexp_matches(l, '{p}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"r{k}"
    return (
        f"WITH {', '.join(ctes)} SELECT d.doc_id, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences, coalesce(array_to_string(ids, ','), '') AS licence_sentences, "
        "coalesce(array_to_string(list_concat(list_filter(string_split_regex(trim(replace(l, '_', '')), ' +'), lambda x: x <> '' AND x <> 'Copyright'), list_filter(ids, lambda x: x = 'Mention')), ','), '') AS licence_unmatched, "
        f"coalesce(len(list_distinct(names)), 0)::BIGINT AS n_licences FROM documents d LEFT JOIN worth USING (doc_id) LEFT JOIN {last} f ON f.r = worth.r"
    )
