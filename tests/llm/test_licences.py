"""Published licence texts, wrapped at any width or not at all, behind comment signs or not."""

import textwrap
from pathlib import Path

import pytest

from strandframe.llm import licences

MIT = '''Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'''
BSD2 = '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'''
BSD3 = BSD2 + '''

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'''
GPL = '''This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.'''
TEXTS = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0": GPL.format(":", ",", 3), "GPL-2.0": GPL.format(";", ";", 2)}


def wrapped(text, width, sign=""):
    paragraphs = [textwrap.fill(p, width) for p in text.split("\n\n")]
    return "\n".join(f"{sign} {line}".rstrip() if sign else line for line in "\n\n".join(paragraphs).split("\n"))


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licences.scan_licences(docs, licences.known_sentences(spark), licences.known_rules(spark)).collect()
    return [r.licences for r in sorted(got)]


def test_texts_and_notices(spark):
    want, texts = [], []
    for name, text in TEXTS.items():
        for form in (text, wrapped(text, 72), wrapped(text, 40), wrapped(text, 79, "#"), wrapped(text, 70, " *"), wrapped(text, 70, "//"), "some prose\n\n" + wrapped(text, 60).replace("\n", "\r\n")):
            want.append(name)
            texts.append(form)
    assert scan(spark, texts) == want


def test_notices_on_lines_of_their_own(spark):
    assert scan(spark, ["prose without an end\nReleased under the MIT License.\nand more prose", "All rights reserved.\nLicensed under CC BY-NC 4.0.", "the license of this is not known.", ""]) == ["MIT", "CC-BY-NC-4.0,all-rights-reserved", "", ""]


@pytest.mark.parametrize(("name", "licence"), [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("BSD", "BSD-3-Clause")])
def test_whole_texts(spark, name, licence):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("the system has no licence texts")
    assert licence in scan(spark, [path.read_text()])[0].split(",")


GNU = """This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation{b} either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details.

You should have received a copy of the GNU {kind} General Public License along with this {what}."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""


@pytest.mark.parametrize("holder", ["Acme LLC", "the University of Somewhere", "Acme, Inc", "Acme, Inc.", "the Regents", "Jörg Müller & Söhne GmbH"])
@pytest.mark.parametrize("mark", ["3.", "*", "(3)", "-"])
def test_any_holder_of_three_clauses(spark, holder, mark):
    endorse = f"{mark} Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    text = BSD2 + "\n\n" + endorse
    assert scan(spark, [text, wrapped(text, 72), wrapped(text, 66, "//"), BSD2]) == ["BSD-3-Clause"] * 3 + ["BSD-2-Clause"]


def test_notices_of_more_licences(spark):
    forms = {
        "LGPL-2.1": GNU.format(what="library", a=";", b=";", kind="Lesser", version="2.1"), "LGPL-3.0": GNU.format(what="program", a=":", b=",", kind="Lesser", version="3"), "AGPL-3.0": GNU.format(what="program", a=":", b=",", kind="Affero", version="3"), "Zlib": ZLIB,
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\nCREATIVE COMMONS CORPORATION IS NOT A LAW FIRM",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    }
    want = [name for name in forms for _ in range(3)]
    assert scan(spark, [form for text in forms.values() for form in (text, wrapped(text, 72), wrapped(text, 70, "#"))]) == want


def test_spdx_tags(spark):
    tags = {"MIT": "// SPDX-License-Identifier: MIT\nint main() {}", "GPL-2.0": "/* SPDX-License-Identifier: GPL-2.0-only */\n#include <x.h>", "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0\nimport os\n", "LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1-or-later"}
    assert scan(spark, list(tags.values())) == list(tags)
    assert scan(spark, ["MIT\nis a school", "see Apache-2.0"]) == ["", ""]
