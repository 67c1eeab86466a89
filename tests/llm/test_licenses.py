"""Licence scans on the licences' genuine texts: as written, wrapped at other widths, unwrapped, and behind comment marks."""

from __future__ import annotations

import textwrap

import pytest

from signal_lake.llm import license_scan

MIT = [
    "MIT License",
    "Copyright (c) 2020 A. N. Author",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
TEXTS = {
    "MIT": MIT,
    "Apache-2.0": APACHE,
    "BSD-2-Clause": [*BSD, AS_IS],
    "BSD-3-Clause": [*BSD, THIRD, AS_IS],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


@pytest.fixture(scope="module")
def found(spark):
    forms = {
        "unwrapped": lambda ps: "\n\n".join(ps),
        "wrapped": lambda ps: "\n\n".join(textwrap.fill(p, 72) for p in ps),
        "narrow": lambda ps: "\r\n \t\n\n".join(textwrap.fill(p, 40) for p in ps),
        "marks": lambda ps: "x = 1\n\n" + "\n".join(" * " + line for p in ps for line in [*textwrap.wrap(p, 70), ""]) + "\ny = 2",
    }
    rows = [(f"{name}/{form}", make(ps)) for name, ps in TEXTS.items() for form, make in forms.items()]
    rows += [(f"{name}/spdx", f"// SPDX-License-Identifier: {name}\n// and code\nint x") for name in license_scan.SPDX]
    rows += [("MIT/line", "Prose goes on\nReleased under the MIT License\nwithout a stop"), ("none", "Prose. More prose\n\nand more"), ("null", None), ("null", None)]
    rows += [(f"{name}/title", f"A tool of mine\nCopyright 2021 Some One <one@example.org>\n" + textwrap.fill(" ".join(p for p in ps if p != "MIT License" and not p.startswith("Copyright")), 76)) for name, ps in TEXTS.items()]
    classic = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    for k, point in enumerate([*(t[3:] for t in BSD), THIRD[3:].replace("copyright holder", "<organization>")]):
        classic += textwrap.fill(point, 70, initial_indent="    * ", subsequent_indent="      ") + "\n"
    rows += [("BSD-3-Clause/classic", f"Copyright (c) <year>, <owner>\nAll rights are kept.\n\n{classic}\n{textwrap.fill(AS_IS, 72)}")]
    rows += [("none/prose", "He said that all rights reserved means little.\nIt is as good as the mit license, or released under the mit license they say, and more"), ("none/part", "software is provided as is, as we know\npermission is hereby granted")]
    rows += [("none/long", "word " * 200_000 + "\n" * 50_000 + ". " * 50_000)]
    out = license_scan.scan(spark.createDataFrame(rows, "name string, text string")).select("name", "licenses", "n_sentences").collect()
    assert len(out) == len(rows)
    return out


def test_each_licence_is_found_alone_in_every_form(found):
    for row in found:
        name = row.name.split("/")[0]
        assert row.licenses == ("" if name in ("none", "null") else name), row.name


def test_texts_without_sentences_count_none(found):
    assert {row.n_sentences for row in found if row.name == "null"} == {0}
