import textwrap

from llm_tables import frame, prose

from driftline.llm import licenses

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
)


def test_sentences_and_ordered_rules(spark, awkward):
    rows = [
        *awkward, (50, prose(1, 20) + ".\nReleased under the MIT License.\n" + prose(2, 9)), (51, MIT),
        (52, "Licensed under the Apache License,   Version 2.0. LICENSED UNDER CC BY 4.0! Licensed under my own license."),
        (53, MIT.replace("The above", "x.\nThe above")), (54, "Released under the MIT License.\n" * 3),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect() if r.doc_id and r.doc_id >= 50}
    assert got[50].licenses == ["MIT"] and got[50].sentence_ids == ["mit_short"]
    assert got[51].licenses == ["MIT"] and got[51].sentence_ids == ["mit_grant", "mit_notice"]
    assert got[52].licenses == ["Apache-2.0", "CC-BY-4.0"] and got[52].n_unknown == 1
    assert got[53].licenses == ["MIT"]
    assert got[54].licenses == ["MIT"] and len(got[54].sentence_ids) == 3
    assert licenses.license_scan(frame(spark, rows)).count() == len(rows)


# Notices as they stand in files, wrapped and commented.
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GNU = """ * This {what} is free software; you can redistribute it and/or modify it
 * under the terms of the GNU {kind}General Public License as published by the
 * Free Software Foundation; either version {version} of the License, or (at your
 * option) any later version.
"""
AGPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Affero General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
"""
ZLIB = """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:
"""


def test_wrapped_and_commented_notices(spark):
    wrapped = "\n".join(textwrap.wrap(MIT.split("\n\n")[0], 78)) + "\n\n" + "\n".join(textwrap.wrap(MIT.split("\n\n")[1], 60))
    commented = "\n".join(" * " + line for line in wrapped.split("\n"))
    texts = {
        "MIT": (wrapped, "/*\n" + commented + "\n */", MIT), "BSD-2-Clause": (BSD3,), "BSD-3-Clause": (BSD3 + NAMES, "-- " + (BSD3 + NAMES).replace("\n", "\n-- ")),
        "Apache-2.0": (APACHE, "/* SPDX-License-Identifier: Apache-2.0 */\nint x;", "x\n# SPDX-License-Identifier: Apache-2.0\nimport os"),
        "GPL-2.0-or-later": (GNU.format(what="program", kind="", version="2"), "// SPDX-License-Identifier: GPL-2.0-or-later"),
        "GPL-3.0-or-later": (GNU.format(what="program", kind="", version="3"), AGPL.replace("Affero ", "")),
        "LGPL-2.1-or-later": (GNU.format(what="library", kind="Lesser ", version="2.1"),), "LGPL-3.0-or-later": (AGPL.replace("Affero", "Lesser"),),
        "AGPL-3.0-or-later": (AGPL,), "Zlib": (ZLIB,), "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",),
    }
    rows = [(i, text, name) for i, (name, text) in enumerate((n, t) for n, own in texts.items() for t in own)]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    for i, text, name in rows:
        assert got[i].licenses == [name], (name, text, got[i])


def test_unknown_sentences_count_once(spark):
    rows = [
        (1, "This license is long\nand my own license\ntoo."), (2, "Some license here\nReleased under the MIT License\nanother license there"),
        (3, "SPDX-License-Identifier: Apache-2.0 OR MIT"),
    ]
    got = {r.doc_id: (r.licenses, r.n_unknown) for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert got == {1: ([], 1), 2: (["MIT"], 2), 3: ([], 1)}


def test_consumed_sentences_do_not_join_their_neighbours(spark):
    known = {"a": "alpha license", "b": "beta license", "c": "gamma license"}
    rules = (("B", ("b",)), ("AC", ("a", "c")), ("A", ("a",)))
    rows = [(1, "Alpha license. Beta license. Gamma license."), (2, "Alpha license. Gamma license."), (3, "gamma license")]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(frame(spark, rows), known, rules).collect()}
    assert got == {1: ["B", "A"], 2: ["AC"], 3: []}


def test_known_sentences_are_normalised_and_rules_name_them():
    assert all(text == " ".join(text.split()) and text == text.lower() for text in licenses.SENTENCES.values())
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)


def test_empty_table(spark):
    assert licenses.license_scan(frame(spark, [])).count() == 0
