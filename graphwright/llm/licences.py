"""Licence scan by sentence rules, in DataFrame functions only.

1. A text is cut into sentences at blank lines and at . ; : ! ? before white space, and each sentence is
   normalised: lower case, runs of other characters than letters and digits as one space. Comment signs
   at the starts of lines go first, so a line of nothing else is blank. Single line ends are kept as marks.
2. Whole lines of a sentence, one or several in a row, that equal a known licence sentence become its
   identifier; the longest one counts, so wrapped sentences are found as well as titles on lines of their
   own. What is left is text, line by line. The sequence keeps the order;
   identifiers that follow each other directly are joined by ``,``, others by ``;`` (text came between).
3. Ordered rules match the sequence. The first rule that matches takes its part of it, and later rules
   see what is left, so a text can have several licences; identifiers that no rule takes are ``unmatched``.

The tables of sentences and rules are constants of the plan, so the scan needs no join and no shuffle;
each row is judged alone, and no group of rows can be large.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, as they stand in licence texts and notices, by identifier.
SENTENCES = {
    "apacheRef": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0."],
    "apacheUse": ["you may not use this file except in compliance with the License."],
    "apacheCopy": ["You may obtain a copy of the License at"],
    "asIsApache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mitRef": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This work is licensed under the MIT License.", "MIT License"],
    "mitPerm": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mitAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "gpl3Ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3."],
    "gpl2Ref": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "gplFree": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gplHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsdPerm": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ccByRef": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "Released under CC BY 4.0."],
    "ccBySaRef": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "Released under CC BY-SA 4.0."],
    "ccByNcRef": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0."],
    "cc0Ref": ["Released under CC0 1.0.", "Licensed under CC0 1.0.", "This work is dedicated to the public domain."],
    "mplRef": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "reserved": ["All rights reserved."],
}
#: Sentences of further licences. They and MORE_RULES come after the others, which see no identifier of theirs.
MORE_SENTENCES = {
    "gplTerms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgplTerms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "v2Later": ["either version 2 of the License, or (at your option) any later version."],
    "v21Later": ["either version 2.1 of the License, or (at your option) any later version."],
    "v3Later": ["either version 3 of the License, or (at your option) any later version."],
    "gpl2Free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "lgpl21Free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3Free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3Free": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgplHope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "iscRef": ["ISC License", "Licensed under the ISC License.", "Released under the ISC License."],
    "iscPerm": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "iscAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "unlicRef": ["This is free and unencumbered software released into the public domain."],
    "unlicUse": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Rules in the order in which they are tried; a name in a rule stands for an identifier.
RULES = [
    ("MIT", "(?:mitRef[,;])?mitPerm[,;]mitNotice(?:[,;]mitAsIs)?"),
    ("BSD-3-Clause", "bsdPerm[,;]bsdSource[,;]bsdBinary[,;]bsdEndorse"),
    ("BSD-2-Clause", "bsdPerm[,;]bsdSource[,;]bsdBinary"),
    ("Apache-2.0", "apacheRef[,;]apacheUse(?:[,;]apacheCopy)?(?:[,;]asIsApache)?"),
    ("GPL-3.0-or-later", "gplFree(?:[,;]gplHope)*"),
    ("Apache-2.0", "apacheRef"),
    ("MIT", "mitRef"),
    ("GPL-3.0", "gpl3Ref"),
    ("GPL-2.0", "gpl2Ref"),
    ("CC-BY-4.0", "ccByRef"),
    ("CC-BY-SA-4.0", "ccBySaRef"),
    ("CC-BY-NC-4.0", "ccByNcRef"),
    ("CC0-1.0", "cc0Ref"),
    ("MPL-2.0", "mplRef"),
    ("all-rights-reserved", "reserved"),
]
_HOPE = "(?:[,;](?:gplHope|lgplHope))*"
#: As RULES, tried after them. Before version 3 the notice has a ; between the terms and the version.
MORE_RULES = [
    ("GPL-3.0-or-later", "gplTerms[,;]v3Later" + _HOPE),
    ("GPL-2.0-or-later", "(?:gplTerms[,;]v2Later|gpl2Free)" + _HOPE),
    ("LGPL-3.0-or-later", "(?:lgplTerms[,;]v3Later|lgpl3Free)" + _HOPE),
    ("LGPL-2.1-or-later", "(?:lgplTerms[,;]v21Later|lgpl21Free)" + _HOPE),
    ("AGPL-3.0-or-later", "agpl3Free" + _HOPE),
    ("ISC", "(?:iscRef[,;])?iscPerm(?:[,;]iscAsIs)?"),
    ("ISC", "iscRef"),
    ("Unlicense", "unlicRef(?:[,;]unlicUse)?"),
]
#: SPDX identifiers and the names that notices use for them, without a leading "the".
NAMED = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "AFL-3.0": ["Academic Free License v3.0", "Academic Free License version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "Apache-1.1": ["Apache License 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License v2.0"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "3-Clause BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "BSD 4-Clause \"Original\" or \"Old\" License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0", "Blue Oak Model License"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0"],
    "CECILL-2.1": ["CeCILL Free Software License Agreement v2.1", "CeCILL License v2.1"],
    "CPL-1.0": ["Common Public License 1.0", "Common Public License, Version 1.0"],
    "ECL-2.0": ["Educational Community License v2.0", "Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"],
    "EUPL-1.1": ["European Union Public License 1.1", "European Union Public Licence v1.1"],
    "EUPL-1.2": ["European Union Public License 1.2", "European Union Public Licence v1.2"],
    "GFDL-1.3": ["GNU Free Documentation License v1.3", "GNU Free Documentation License, Version 1.3"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "HPND": ["Historical Permission Notice and Disclaimer"],
    "IPL-1.0": ["IBM Public License v1.0", "IBM Public License Version 1.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "LPPL-1.3c": ["LaTeX Project Public License v1.3c", "LaTeX Project Public License, version 1.3c"],
    "MIT": ["MIT License", "MIT license (MIT)", "Expat License"],
    "MIT-0": ["MIT No Attribution License", "MIT No Attribution"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "MulanPSL-2.0": ["Mulan Permissive Software License, Version 2", "Mulan PSL v2"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODC-By-1.0": ["Open Data Commons Attribution License v1.0", "Open Data Commons Attribution License"],
    "ODbL-1.0": ["Open Data Commons Open Database License v1.0", "Open Database License"],
    "OFL-1.1": ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"],
    "OSL-3.0": ["Open Software License 3.0", "Open Software License version 3.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python License 2.0", "Python Software Foundation License Version 2"],
    "QPL-1.0": ["Q Public License 1.0", "Q Public License Version 1.0"],
    "Ruby": ["Ruby License"],
    "Sleepycat": ["Sleepycat License"],
    "Unlicense": ["Unlicense"],
    "UPL-1.0": ["Universal Permissive License v1.0", "Universal Permissive License v 1.0"],
    "Vim": ["Vim License"],
    "W3C": ["W3C Software Notice and License"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "X11": ["X11 License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "ZPL-2.1": ["Zope Public License 2.1", "Zope Public License (ZPL) Version 2.1"],
}
#: What notices say before a licence's name.
NOTICES = [
    "Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under the", "Distributed under the terms of the", "Available under the",
    "This project is licensed under the", "This work is licensed under the", "This work is licensed under a", "This work is licensed under", "This software is licensed under the",
    "This program is licensed under the", "This library is licensed under the", "This code is licensed under the", "This file is licensed under the",
    "This project is licensed under the terms of the", "This software is released under the", "This program and the accompanying materials are made available under the terms of the",
    "This Font Software is licensed under the", "Licensed under the terms of the",
]
#: Sentences of licence texts that no notice names.
BODIES = {
    "zlibAsIs": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlibLiable": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlibPerm": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bslPerm": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "zeroBsdPerm": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "wtfplCopy": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "bsdAdvert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "mitZeroPerm": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "postgresPerm": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "eplAt2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution"],
    "eplAt1": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
}
#: Rules over them, tried after MORE_RULES.
BODY_RULES = [
    ("Zlib", "(?:xZlib[,;])?zlibAsIs[,;]zlibLiable(?:[,;]zlibPerm)?"),
    ("BSL-1.0", "(?:xBSL10[,;])?bslPerm"),
    ("BSD-4-Clause", "bsdPerm[,;]bsdSource[,;]bsdBinary[,;]bsdAdvert(?:[,;]bsdEndorse)?"),
    ("0BSD", "(?:x0BSD[,;])?zeroBsdPerm"),
    ("WTFPL", "(?:xWTFPL[,;])?wtfplCopy"),
    ("MIT-0", "(?:xMIT0[,;])?mitZeroPerm"),
    ("PostgreSQL", "(?:xPostgreSQL[,;])?postgresPerm"),
    ("EPL-2.0", "eplAt2"),
    ("EPL-1.0", "eplAt1"),
]
_BREAK = r"[\n\r]+|[.;:!?]+(?=[ \t\n\r]|$)"
#: The line that names a licence by its identifier; its colon ends no sentence.
_SPDX = "spdx-license-identifier:"


def _name_of(spdx: str) -> str:
    return "x" + re.sub(r"[^A-Za-z0-9]", "", spdx)


def spdx_sentences() -> dict[str, list[str]]:
    """Sentence identifier -> forms of the line that names a licence by its SPDX identifier."""
    line = "SPDX-License-Identifier "
    own = {_name_of(i): [line + i] + ([line + i + "-only"] if "GPL" in i else []) for i in NAMED}
    return own | {_name_of(i) + "later": [line + i + "-or-later", line + i + "+"] for i in NAMED if "GPL" in i}


def licence_names() -> dict[str, str]:
    """Normalised name, with and without the SPDX identifier after it -> sentence identifier."""
    return {_normal(form): _name_of(i) for i, names in NAMED.items() for n in names for form in (n, f"{n} ({i})")}


def titles() -> dict[str, str]:
    """Names that say what they are, so that they count on a line of their own."""
    return {n: i for n, i in licence_names().items() if re.search("licen[cs]e", n)}


def named_rules() -> list[tuple[str, str]]:
    return [(i, _name_of(i)) for i in NAMED] + [(i + "-or-later", _name_of(i) + "later") for i in NAMED if "GPL" in i]


def _normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


ALL_SENTENCES = SENTENCES | MORE_SENTENCES | BODIES | spdx_sentences()
ALL_RULES = RULES + MORE_RULES + BODY_RULES + named_rules()


def known_sentences(table: dict[str, list[str]] = ALL_SENTENCES) -> dict[str, str]:
    """Normalised sentence -> identifier. A known sentence with a break inside (v. 2.0) is known by its longest part; of two
    identifiers for one sentence the first counts."""
    out: dict[str, str] = {}
    for name, forms in table.items():
        for form in forms:
            parts = [_normal(p) for p in re.split(_BREAK, form)]
            out.setdefault(max(parts, key=len), name)
    return out


#: Capitals are free for marks in a lower-case text: B is the end of a sentence, a line feed a single line end. The steps need no
#: look-around, so that SQL says the same.
STEPS = [
    ("\r\n?", "\n"),
    (_SPDX, "spdx-license-identifier "),
    ("(?m)^[^\\p{L}\\p{N}\n]+", ""),
    ("\n\n+", "B"),
    ("[.;:!?]+([ \tB\n]|$)", "B"),
    ("[^a-z0-9B\n]+", " "),
    ("[ \n]*B[ B\n]*", "B"),
    ("[ \n]*\n[ \n]*", "\n"),
    ("^[ \n]+|[ \n]+$", ""),
]


def anchors(known: dict[str, str]) -> list[str]:
    """Words of which every known sentence has one: each time the word of most sentences left, longer words first."""
    left, out = set(known), []
    while left:
        words = {w for s in left for w in s.split()}
        out.append(max(words, key=lambda w: (sum(w in s.split() for s in left) * (len(w) > 4), len(w), w)))
        left = {s for s in left if out[-1] not in s.split()}
    return out


def _longest_first(forms) -> str:
    """A pattern of any of the forms, with a line end at any of their spaces."""
    return "|".join(f.replace(" ", "[ \n]") for f in sorted(forms, key=len, reverse=True))


def _sequence(text: Column, known: dict[str, str]) -> Column:
    """``;``-led sequence of identifiers: ``,`` before one whose sentence follows the one before directly."""
    marked = F.lower(text)
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern.replace("(?m)", "(?md)"), to)
    # Known sentences come before notices with a name; each starts and ends at a mark, as lines do.
    names, alone, notices = licence_names(), titles(), sorted({_normal(n) for n in NOTICES}, key=len, reverse=True)
    whole = f"{_longest_first(known)}|(?:{_longest_first(notices)})[ \n](?:{_longest_first(names)})|(?:the[ \n])?(?:{_longest_first(alone)})"
    parts = F.regexp_extract_all(marked, F.lit(f"(?:{whole})(?=[B\n]|$)|[^B\n]+"), F.lit(0))
    lists = [sorted(x) for x in (known, names, alone)]
    labels = F.array(*[F.lit(table[s]) for table, forms in zip((known, names, alone), lists, strict=True) for s in forms])
    most = max(max(map(len, known)), max(map(len, names)) + len(notices[0]) + 1)

    def place(part: Column) -> Column:
        """The place of a part's label, 0 for none."""
        line = F.translate(part, "\n", " ")
        named, bare = F.regexp_replace(line, f"^(?:{'|'.join(notices)}) ", ""), F.regexp_replace(line, "^the ", "")
        found, offset = [], 0
        for forms, form, asked in zip(lists, (line, named, bare), (F.lit(True), named != line, F.lit(True)), strict=True):
            at = F.array_position(F.array(*[F.lit(s) for s in forms]), form)
            found.append(F.when(asked & (at > 0), at + offset))
            offset += len(forms)
        return F.when(F.length(part) <= most, F.coalesce(*found, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    at = F.transform(parts, place)

    def joined(places: Column) -> Column:
        """Each place says by itself what stands before it, so that the sequence is put together once."""
        before = lambda i: F.when((i > 0) & (F.get(places, i - 1) > 0), F.lit(",")).otherwise(F.lit(";"))
        return F.array_join(F.transform(places, lambda x, i: F.when(x > 0, F.concat(before(i), F.element_at(labels, x.cast("int")))).otherwise(F.lit(""))), "")

    return F.element_at(F.transform(F.array(at), joined), 1)


def scan_licences(docs: DataFrame, text_col: str = "text", table: dict[str, list[str]] = ALL_SENTENCES, rules: list[tuple[str, str]] = ALL_RULES) -> DataFrame:
    """``docs`` with ``sentence_ids`` (the identifier sequence), ``licences`` (array of the matched rules' names,
    each once, in rule order) and ``unmatched`` (number of identifiers that no rule took).

    A null or empty text has an empty sequence and no licences. Each input row gives one output row; columns
    of these three names are replaced, all others pass through.
    """
    known = known_sentences(table)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("sentence_ids", "licences", "unmatched")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # A text without any anchor word has no known sentence; only the others are cut into sentences.
    low = F.lower(text)
    words = anchors(dict.fromkeys([*known, *titles(), *map(_normal, NOTICES)], ""))
    possible = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    out = docs.select(*kept, F.when(possible, _sequence(text, known)).otherwise(F.lit("")).alias("sentence_ids"))
    # The last rules that are an identifier each are looked up, all at once, in what the others leave.
    n = next((i for i in range(len(rules), 0, -1) if not re.fullmatch("[A-Za-z0-9]+", rules[i - 1][1])), 0)
    plain: dict[str, str] = {}
    for name, identifier in rules[n:]:
        plain.setdefault(identifier, name)
    bounded = [(name, "(?<=[,;])" + pattern + "(?![A-Za-z0-9])") for name, pattern in rules[:n]]
    # A rule sees the sequence with the parts that earlier rules took replaced by #.
    left = reduce(lambda c, rule: F.regexp_replace(c, rule[1], "#"), bounded, F.col("sentence_ids"))
    views, view = [], F.col("sentence_ids")
    for name, pattern in bounded:
        views.append(F.when(F.rlike(view, F.lit(pattern)), F.lit(name)))
        view = F.regexp_replace(view, pattern, "#")
    has = F.col("sentence_ids") != ""
    none = F.array().cast("array<string>")
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rest = F.filter(F.split(left, "[,;]"), lambda x: (x != "") & (x != "#"))
    taken = F.transform(F.array_intersect(texts(plain), rest), lambda x: F.element_at(texts(plain.values()), F.array_position(texts(plain), x).cast("int")))
    found = F.concat(F.array_compact(F.array(*views).cast("array<string>")), taken) if plain else F.array_compact(F.array(*views))
    return out.withColumns(
        {
            "licences": F.when(has, F.array_distinct(found)).otherwise(none),
            "unmatched": F.when(has, F.size(F.filter(rest, lambda x: ~F.array_contains(texts(plain), x)))).otherwise(F.lit(0)),
        }
    )


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """Licences of every one of ``documents``, with the sequence of sentence identifiers that they were told by."""
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "sentence_ids", F.array_join("licences", ",").alias("licences"), F.col("unmatched").cast("long").alias("unmatched"))


def op9_sql() -> str:
    """The same by relations: lines, the longest known sentence that begins at each, the lines taken from left to right, then the rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda x: ", ".join(f"({quote(s)}, {quote(n)})" for s, n in x.items())
    notices = ", ".join(f"({quote(_normal(x))})" for x in NOTICES)
    marked = "lower(coalesce(text, ''))"
    for pattern, to in STEPS:
        marked = f"regexp_replace({marked}, {quote(pattern)}, {quote(to)}, 'g')"
    names, taken = [], []
    for i, (name, pattern) in enumerate(ALL_RULES):
        p = quote("([,;])" + pattern + "\\b")
        names.append(f"CASE WHEN regexp_matches(v{i}, {p}) THEN {quote(name)} END")
        taken.append(f"v{i} AS MATERIALIZED (SELECT *, regexp_replace(v{i}, {p}, '\\1#', 'g') AS v{i + 1} FROM {'q' if i == 0 else 'v' + str(i - 1)})")
    n = len(ALL_RULES)
    return (
        f"WITH RECURSIVE k1(s, i) AS (VALUES {table(known_sentences())}), k2(s, i) AS (VALUES {table(licence_names())}), k3(s, i) AS (VALUES {table(titles())}), k4(s) AS (VALUES {notices}), "
        "k5 AS (SELECT s, i, 1 AS o FROM k1 UNION ALL SELECT k4.s || ' ' || k2.s, i, 0 FROM k2, k4 UNION ALL SELECT s, i, 0 FROM k3 UNION ALL SELECT 'the ' || s, i, 0 FROM k3), "
        # Known sentences come before notices with a name; then the longest counts.
        "k AS MATERIALIZED (SELECT s, arg_max(i, o) AS i, split_part(s, ' ', 1) AS w, length(s) AS n, length(s) + 10000 * max(o) AS worth FROM k5 GROUP BY s), "
        f"c AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {marked} AS m FROM documents), "
        "g AS (SELECT r, unnest(string_split(m, 'B')) AS seg, generate_subscripts(string_split(m, 'B'), 1) AS b FROM c), "
        "l AS (SELECT r, b, seg, unnest(string_split(seg, chr(10))) AS line, generate_subscripts(string_split(seg, chr(10)), 1) AS p FROM g WHERE seg != ''), "
        "o AS MATERIALIZED (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY r, b ORDER BY p) - length(line) AS BIGINT) AS start FROM l), "
        # A known sentence may have a line end at any space, and ends with a line.
        "h AS (SELECT r, b, p, i, k.worth, substr(seg, start, k.n) AS part FROM o JOIN k ON k.w = split_part(line, ' ', 1) AND translate(substr(seg, start, k.n), chr(10), ' ') = k.s "
        "AND substr(seg, start + k.n, 1) IN ('', chr(10))), "
        "e AS MATERIALIZED (SELECT r, b, p, arg_max(i, worth) AS i, arg_max(length(part) - length(replace(part, chr(10), '')), worth) + 1 AS many FROM h GROUP BY r, b, p), "
        "t(r, b, p, i, many) AS (SELECT o.r, o.b, o.p, e.i, coalesce(e.many, 1) FROM o LEFT JOIN e USING (r, b, p) WHERE o.p = 1 "
        "UNION ALL SELECT o.r, o.b, o.p, e.i, coalesce(e.many, 1) FROM t JOIN o ON o.r = t.r AND o.b = t.b AND o.p = t.p + t.many LEFT JOIN e ON e.r = o.r AND e.b = o.b AND e.p = o.p), "
        "u AS (SELECT r, b, p, i, lag(i) OVER (PARTITION BY r ORDER BY b, p) AS before FROM t), "
        "a AS (SELECT r, string_agg(CASE WHEN before IS NULL THEN ';' ELSE ',' END || i, '' ORDER BY b, p) AS sentence_ids FROM u WHERE i IS NOT NULL GROUP BY r), "
        "q AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(sentence_ids, '') AS v0 FROM c LEFT JOIN a USING (r)), "
        + ", ".join(taken)
        + f" SELECT doc_id, sentence_ids, array_to_string(list_distinct_in_order, ',') AS licences, len(list_filter(regexp_split_to_array(v{n}, '[,;]'), lambda x: x != '' AND x != '#'))::BIGINT AS unmatched "
        f"FROM (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter([{', '.join(names)}], lambda x: x IS NOT NULL), lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS list_distinct_in_order FROM v{n - 1})"
    )
