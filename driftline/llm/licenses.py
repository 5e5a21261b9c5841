"""License scans by sentence rules.

A text is cut behind . ! ? : ; and at blank lines into sentences, whose lines are
joined, so that wrapped and commented texts read as plain ones. A sentence is
normalised, and known ones get an identifier. Where a sentence of several lines is
not known, its lines are looked up one by one, as notices often stand on a line of their
own without a stop. The identifiers of a text, in their order, are matched against
the rules, also in order: a rule that finds its sequence consumes it, so longer
and more specific rules stand first. Sentences that speak of a license but are
not known are counted.

Only texts with a clue word are cut up; the known sentences are a fixed table,
which is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import ASCII_LOWER, ASCII_UPPER, stored

# Public license texts, sentence by sentence, normalised.
SENTENCES = {
    "apache2_short": "licensed under the apache license version 2 0",
    "apache2_the_license": "licensed under the apache license version 2 0 the license",
    "apache2_may_not_use": "you may not use this file except in compliance with the license",
    "apache2_obtain": "you may obtain a copy of the license at",
    "apache2_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_short": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero_bsd_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_no_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_no_names_of": "neither the name of the nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "gnu_program": "this program is free software",
    "gnu_library": "this library is free software",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2_only_terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gnu_version2": "either version 2 of the license or at your option any later version",
    "gnu_version21": "either version 2 1 of the license or at your option any later version",
    "gnu_version3": "either version 3 of the license or at your option any later version",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_origin": "the origin of this software must not be misrepresented",
    "zlib_altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib_notice": "this notice may not be removed or altered from any source distribution",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost_short": "distributed under the boost software license version 1 0",
    "epl2_short": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "wtfpl": "you just do what the fuck you want to",
    "bsd_short": "licensed under the bsd license",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl3_short": "this work is licensed under the gnu general public license version 3",
    "gpl2_short": "this work is licensed under the gnu general public license version 2",
    "mpl2_form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2_form_v": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2_obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc_by_nc4": "licensed under cc by nc 4 0",
    "cc_by4": "licensed under cc by 4 0",
    "cc_by_sa4": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Identifiers of licenses as they stand behind the tag that names them.
TAGGED = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
SENTENCES |= {f"tag_{re.sub('[^a-z0-9]+', '_', x.lower())}": f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', x.lower())}" for x in TAGGED}
# Fixed values: (license, sequence of sentences), the first that fits wins.
RULES = (
    ("Apache-2.0", ("apache2_the_license", "apache2_may_not_use", "apache2_obtain", "apache2_as_is")),
    ("Apache-2.0", ("apache2_the_license", "apache2_may_not_use")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-4-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_advertising")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_no_names")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_no_names_of")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("AGPL-3.0-or-later", ("agpl3_terms",)),
    ("LGPL-3.0-or-later", ("lgpl3_terms",)),
    ("LGPL-3.0-or-later", ("lgpl_terms", "gnu_version3")),
    ("LGPL-2.1-or-later", ("lgpl21_terms",)),
    ("LGPL-2.1-or-later", ("lgpl_terms", "gnu_version21")),
    ("GPL-3.0-or-later", ("gpl3_terms",)),
    ("GPL-3.0-or-later", ("gpl_terms", "gnu_version3")),
    ("GPL-2.0-or-later", ("gpl2_terms",)),
    ("GPL-2.0-or-later", ("gpl_terms", "gnu_version2")),
    ("GPL-2.0-only", ("gpl2_only_terms",)),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_short",)),
    ("EPL-2.0", ("epl2_short",)),
    ("0BSD", ("zero_bsd_grant", "isc_as_is")),
    ("WTFPL", ("wtfpl",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("MPL-2.0", ("mpl2_form", "mpl2_obtain")),
    ("MPL-2.0", ("mpl2_form",)),
    ("MPL-2.0", ("mpl2_form_v", "mpl2_obtain")),
    ("MPL-2.0", ("mpl2_form_v",)),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache2_the_license",)),
    ("Apache-2.0", ("apache2_short",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_licensed",)),
    ("BSD", ("bsd_short",)),
    ("GPL-3.0-only", ("gpl3_short",)),
    ("GPL-2.0-only", ("gpl2_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4",)),
    ("CC-BY-4.0", ("cc_by4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    *((name, (f"tag_{re.sub('[^a-z0-9]+', '_', name.lower())}",)) for name in TAGGED),
)
CLUE = "licen[sc]e|redistribut|permission|copyright|warrant|conditions|mpl|public domain|compliance|free software|do what the"
SPEAKS_OF_LICENSE = "licen[sc]e"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


TAG = r"spdx-license-identifier:"
BREAK = "\x01"


def runs_of(text: Column) -> Column:
    """Sentences as arrays of their normalised lines: cut behind . ! ? : ; before white space, and at lines without a-z and 0-9."""
    plain = F.regexp_replace(lowered(text), TAG, "spdx license identifier ")
    stopped = F.regexp_replace(plain, r"([.!?:;])[\x20\x09\x0D\n]+", f"$1{BREAK}")
    parted = F.regexp_replace(stopped, r"\n[^a-z0-9\n\x01]*\n", BREAK)
    line = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.transform(F.split(parted, BREAK), lambda run: F.filter(F.transform(F.split(run, "\n"), line), lambda s: s != ""))


def apply_rules(sequence: Column, rules: tuple = RULES) -> Column:
    """Licenses of a text, in rule order, from its identifiers joined as ',a,b,'."""
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(ids) + ",").alias("ids")) for name, ids in rules
    ])
    state = F.struct(sequence.alias("open"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(
        table, state,
        lambda s, rule: F.struct(
            F.replace(s["open"], rule["ids"], F.lit(",;,")).alias("open"),
            F.when(F.contains(s["open"], rule["ids"]), F.concat(s["found"], F.array(rule["name"]))).otherwise(s["found"]).alias("found"),
        ),
        lambda s: F.array_distinct(s["found"]),
    )


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, licenses, sentence_ids (in order) and n_unknown of every row.

    ``n_unknown`` counts sentences that speak of a license without being known,
    by lines where some line of the sentence is known. Null and empty texts
    have none of all. Repeated rows get a row each, an empty table gives none. A
    sentence counts each time it stands in a text.
    """
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(text, name) for name, text in sentences.items()], "sentence string, name string"))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id",
        F.when(lowered(F.col("text")).rlike(CLUE), runs_of(F.col("text"))).alias("runs"),
    ))
    each = rows.select("_row", F.posexplode("runs").alias("run", "lines")).filter(F.size("lines") > 0)
    # Place 0 is the whole sentence, its lines follow if there are several.
    parts = each.select("_row", "run", F.posexplode(F.when(
        F.size("lines") > 1, F.concat(F.array(F.array_join("lines", " ")), "lines")
    ).otherwise(F.col("lines"))).alias("at", "sentence"))
    found = parts.join(known, "sentence", "left").withColumn(
        "speaks", F.col("name").isNull() & F.col("sentence").rlike(SPEAKS_OF_LICENSE)
    ).filter(F.col("name").isNotNull() | F.col("speaks"))
    # Few parts are left here; those of one sentence meet.
    by_run = found.groupBy("_row", "run").agg(
        F.max(F.when(F.col("at") == 0, F.col("name"))).alias("whole"),
        F.array_sort(F.collect_list(F.when((F.col("at") > 0) & F.col("name").isNotNull(), F.struct("at", "name")))).alias("lines"),
        F.count_if(F.col("speaks") & (F.col("at") > 0)).alias("open_lines"), F.count_if(F.col("speaks")).alias("open"),
    ).select(
        "_row", "run",
        F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.transform("lines", lambda k: k["name"])).alias("names"),
        F.when(F.col("whole").isNotNull(), 0).when(F.size("lines") > 0, F.col("open_lines")).otherwise((F.col("open") > 0).cast("long")).alias("open"),
    )
    merged = by_run.groupBy("_row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "names"))), lambda k: k["names"])).alias("sentence_ids"),
        F.sum("open").alias("n_unknown"),
    )
    none = F.array().cast("array<string>")
    whole = rows.select("_row", "doc_id").join(merged, "_row", "left").select(
        "doc_id", F.coalesce("sentence_ids", none).alias("sentence_ids"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown")
    )
    # What a rule consumes leaves a mark, so sentences on its two sides do not become neighbours.
    sequence = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    return whole.select("doc_id", F.when(F.size("sentence_ids") > 0, apply_rules(sequence, rules)).otherwise(none).alias("licenses"), "sentence_ids", "n_unknown")
