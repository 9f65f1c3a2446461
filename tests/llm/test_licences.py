"""Licences of public texts and notices that the test tables don't hold."""

from staylens.llm import licenses

GNU = """{0} is free software{1} you can redistribute it and/or modify
 * it under the terms of the GNU {2} Public License as published by
 * the Free Software Foundation{3} either version {4} of the License, or
 * (at your option) any later version.
 *
 * {0} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
CASES = [
    ("This file is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under the GNU General Public License v3.0", "GPL-3.0"),
    ("The software is distributed under the GPLv2.", "GPL-2.0"), ("Released under LGPL v2.1.", "LGPL-2.1"),
    (GNU.format("This library", ";", "Lesser General", ";", "2.1"), "LGPL-2.1-or-later"), (GNU.format("This program", ":", "General", ",", "2"), "GPL-2.0-or-later"),
    (GNU.format("This program", ":", "Affero General", ",", "3"), "AGPL-3.0-or-later"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("This work is released under CC0 1.0.", "CC0-1.0"),
    ("This work is licensed under a thing of its own.", ""), ("This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under the Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only\n#include <x.h>", "GPL-2.0"), ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"), ("/* SPDX-License-Identifier: EPL-2.0 */", "EPL-2.0"),
    (BSD + "\n3. Neither the name of Example Labs, Inc nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.", "BSD-3-Clause,BSD-2-Clause"),
    ("It is not licensed under the MIT License.", ""),
]


def test_common_licences(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: ",".join(r["licenses"]) for r in licenses.scan(docs).collect()}
    assert [(t, set(got[i].split(","))) for i, (t, _) in enumerate(CASES)] == [(t, set(w.split(","))) for t, w in CASES]
