"""Licences as projects ship them, plain, wrapped anew and in comments. The texts are public licence texts and notices."""

import textwrap

import pytest

from tallyforge.llm import licences

GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT = f"""MIT License

Copyright (c) 2020 Some Body

{GRANT}

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{names}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
NAMES = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ISC = """ISC License

Copyright (c) 2018 Some Body

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""


def gnu(kind, version, mark, later=True):
    name = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}[kind]
    what = "library" if kind == "LGPL" else "program"
    either = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This {what} is free software{":" if mark == "," else ";"} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{mark} {either}.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
KNOWN = {
    "MIT": MIT, "BSD-2-Clause": BSD.format(names=""), "BSD-3-Clause": BSD.format(names=NAMES), "ISC": ISC, "Apache-2.0": APACHE, "MPL-2.0": MPL, "GPL-2.0-or-later": gnu("GPL", "2", ";"), "GPL-3.0-or-later": gnu("GPL", "3", ","),
    "GPL-2.0-only": gnu("GPL", "2", ";", False), "LGPL-2.1-or-later": gnu("LGPL", "2.1", ";"), "LGPL-3.0-or-later": gnu("LGPL", "3", ","), "AGPL-3.0-or-later": gnu("AGPL", "3", ","),
}


def shapes(text):
    """As one line a paragraph, wrapped, and wrapped in comments; some without blank lines between paragraphs."""
    wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 70, break_long_words=False)) if "\n" not in p else p for p in text.split("\n\n"))
    yield text
    yield wrapped
    yield "\n".join(f"# {x}".rstrip() for x in wrapped.split("\n")) + "\nimport os\n"
    yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in wrapped.split("\n")) + "\n */\nint main() { return 0; }"
    yield "\r\n".join(f"// {x}" for x in wrapped.split("\n"))
    yield "\n".join(x for x in wrapped.split("\n") if x.strip())


def found(spark, texts):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, _hit string")
    return {r.doc_id: r for r in licences.recognise(rows).collect()}


def test_shipped_texts_in_all_shapes(spark):
    cases = [(name, shape) for name, text in KNOWN.items() for shape in shapes(text)]
    got = found(spark, [t for _, t in cases])
    bad = [(name, got[i].licences, got[i].licence_sentences, t[:60]) for i, (name, t) in enumerate(cases) if name not in got[i].licences or set(got[i].licences) - {name, "Proprietary"}]
    assert not bad
    assert all(r._hit == "kept" for r in got.values())


def test_several_licences_and_short_forms(spark):
    cases = {
        "Licensed under the Apache License,\nVersion 2.0.\nReleased under the MIT License\nmore text": ["Apache-2.0", "MIT"],
        f"{MIT}\n\n{'some prose. ' * 50}\n\n{MPL}": ["MIT", "MPL-2.0"],
        "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode": ["Apache-2.0", "MIT"],
        "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
        "/* SPDX-License-Identifier: (LGPL-2.1-only AND BSD-3-Clause) */": ["BSD-3-Clause", "LGPL-2.1-only"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"],
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": ["GPL-3.0"],
        "Licensed under CC BY-SA 3.0.": ["CC-BY-SA-3.0"],
        "This text is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": ["CC-BY-NC-ND-4.0"],
        "All rights reserved.": ["Proprietary"], "no licence here": [], "": [], None: [],
        "x" * 300_000 + ". " + MIT: ["MIT"],
    }
    got = found(spark, list(cases))
    assert [got[i].licences for i in range(len(cases))] == list(cases.values())


SHORT = {
    "Licensed under the MIT license (https://opensource.org/licenses/MIT).": ["MIT"],
    "This project is licensed under the MIT License - see the LICENSE.md file for details": ["MIT"],
    "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.": ["MIT"],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
    "Licensed under either of\n\n * Apache License, Version 2.0\n   (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license\n   (LICENSE-MIT or http://opensource.org/licenses/MIT)\n\nat your option.": ["Apache-2.0", "MIT"],
    "Released under the MIT and\nGPLv2 licenses.": ["GPL-2.0-only", "MIT"],
    "Licensed under the GNU GPL v3": ["GPL-3.0-only"], "Released under the GPLv3.": ["GPL-3.0-only"], "Distributed under the GNU LGPL, version 2.1 or later.": ["LGPL-2.1-or-later"], "license: GPL-3.0+": ["GPL-3.0-or-later"],
    "This plugin is released under the GPL.": ["GPL"], "License: MIT": ["MIT"], '"license": "ISC",': ["ISC"], "License :: OSI Approved :: MIT License": ["MIT"], "MIT licensed.": ["MIT"],
    "SPDX-License-Identifier: EPL-2.0": ["EPL-2.0"], "// SPDX-License-Identifier: BSL-1.0 OR Zlib": ["BSL-1.0", "Zlib"], "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": ["Apache-2.0"],
    "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.": ["BSD"],
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)": ["BSL-1.0"],
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": ["Zlib"],
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html": ["EPL-1.0"],
    "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/": ["EPL-2.0"],
    "Copyright 2020 X. All rights reserved. Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "The house is available under the bridge. A licence to kill.": [], "It is not licensed for use.": [],
}


def test_short_forms(spark):
    got = found(spark, list(SHORT))
    bad = [(t, got[i].licences, got[i].licence_sentences) for i, t in enumerate(SHORT) if got[i].licences != SHORT[t] or got[i].licence_unmatched]
    assert not bad


def test_mentions_are_reported(spark):
    texts = ["Licensed under the Foo Bar License.", "SPDX-License-Identifier: LicenseRef-Own", "x. License: proprietary, see file", f"Licensed under the Apache License 2.0 with strings attached. {MIT}", "no more words"]
    got = found(spark, texts)
    assert [got[i].licence_unmatched for i in range(5)] == [["Mention"], ["Mention"], ["Mention"], ["Mention"], []]
    assert [got[i].licences for i in range(5)] == [[], [], [], ["MIT"], []]


def test_sql_of_short_forms(spark):
    """The registered SQL gives the same on shipped texts, short forms and mentions."""
    import duckdb
    import pandas as pd

    texts = [*SHORT, *(x for t in KNOWN.values() for x in shapes(t)), "Licensed under the Foo License.", "", None]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841  read by name
    want = {r[0]: r[1:] for r in duckdb.sql(licences.oracle()).fetchall()}
    got = found(spark, texts)
    joined = {i: (*(",".join(r[c]) for c in ("licences", "licence_sentences", "licence_unmatched")), len(r.licences)) for i, r in got.items()}
    assert [(texts[i], joined[i], want[i]) for i in joined if joined[i] != want[i]] == []


def test_families_hold_their_sentences():
    """Every pattern's own words hold its family's pattern, so that no family keeps a sentence from its own identifiers."""
    import re

    for name, p in licences.SENTENCES.items():
        anchor = licences.family(name)
        if anchor != licences.ANCHOR and not name.startswith("Name:"):
            plain = re.sub(r"\((?:\?:)?|[)\\?]", "", p).replace("lesser|library ", "")
            assert re.search(anchor, plain), name


def test_what_no_rule_explains(spark):
    got = found(spark, ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."])
    assert (got[0].licences, got[0].licence_unmatched) == ([], ["MITnotice"])


@pytest.mark.parametrize("name", KNOWN)
def test_every_known_sentence_has_an_anchor(spark, name):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(KNOWN[name],)], "text string").select(F.explode(licences._sentences(F.col("text"))).alias("s")).select(licences.normalised(F.col("s")).alias("s")).collect()
    import re

    for r in rows:
        if any(re.fullmatch(p, r.s) for p in licences.SENTENCES.values()):
            assert re.search(licences.ANCHOR, r.s), r.s


def test_anchors_of_patterns():
    """A pattern's own words hold an anchor wherever it matches: some anchor is in its fixed part."""
    import re

    for name, p in licences.SENTENCES.items():
        plain = re.sub(r"\(\?:|[()\\?]", "", p)
        assert re.search(licences.ANCHOR, plain), name
