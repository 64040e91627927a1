"""Operator 1: license scan, MinHash bands over overlapping windows, exact shingle check (native).

Text is lower-cased and split on everything but letters, digits, ``.`` and ``-`` inside words.
A window is ``WINDOW`` consecutive five-word shingles, one window per shingle position. Each of
``bands(...)`` bands is the minimum of one seeded hash over the window; template windows at every
offset (and single shingles) are hashed alike and a shared band value retrieves the template. The
number of bands makes a window that shares one shingle of two with a template window collide with
probability >= ``TARGET``; windows of two template shingles collide always, and single document shingles
are hashed as well, so that a contained shingle is retrieved with certainty. Notices of 2 to 4 words are
one shingle of their own size. Retrieved windows are then compared as text: a template is found when
the distinct template shingles found in the document are at least 0.8 of the template's. Each row of the
template table is one wording; the best found one of a licence is reported.

Defined cases: null or empty texts match nothing; repeated rows of one doc_id are taken together;
templates of a single word match nothing; an empty table on either side gives no rows. Templates are broadcast only after a counted size check.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsql.session import maybe_broadcast

SHINGLE, WINDOW, TARGET, MIN_CONTAINMENT = 5, 2, 0.99, 0.8
_GNU = "under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License"
_SPDX = ("MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib Unlicense BSL-1.0 0BSD MPL-2.0 EPL-2.0 GPL-2.0 GPL-2.0-only "
         "GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
         "LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0").split()
_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
# (licence, wording): notices, headings and short full texts; a licence is found by any of its wordings.
WORDINGS = (
    *((x, f"SPDX-License-Identifier: {x}") for x in _SPDX),
    *((name, text) for kind, short, versions in (("General Public License", "GPL", ("2", "3")), ("Lesser General Public License", "LGPL", ("2.1", "3")),
                                                 ("Affero General Public License", "AGPL", ("3",)))
      for v in versions for name in [f"{short}-{v}" if "." in v else f"{short}-{v}.0"]
      for text in (_GNU.format(kind, v), f"GNU {kind} version {v}", f"GNU {kind}, v{v}", f"GNU {short} v{v}", f"GNU {short}v{v}", f"GNU {short} version {v}")),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "MIT License"),
    ("MIT-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
     "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS"),
    ("BSD", "BSD License"),
    ("BSD-2-Clause", "BSD 2-Clause"),
    ("BSD-2-Clause", "2-Clause BSD"),
    ("BSD-3-Clause", "BSD 3-Clause"),
    ("BSD-3-Clause", "3-Clause BSD"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
     "and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Boost Software License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "The Unlicense"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License v2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
    *((f"CC-{x.upper()}-{v}", text) for x, spelled in (
        ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
        ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
      for v in ("3.0", "4.0") for text in (f"CC {x} {v}", f"CC-{x} {v}", f"Creative Commons {spelled} {v}",
                                           f"Creative Commons {spelled} License {v}", f"creativecommons.org/licenses/{x}/{v}")),
    ("All-rights-reserved", "All rights reserved."),
)
TEMPLATES = (
    *WORDINGS,
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bands(similarity: float = 1 / WINDOW, target: float = TARGET) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - similarity))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "license string, text string")


def _words(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))),
                                                 F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0)).alias("_w"))


def _shingles(words: DataFrame, *keys: str) -> DataFrame:
    return words.where(F.size("_w") >= SHINGLE).select(*keys, F.transform(
        F.sequence(F.lit(0), F.size("_w") - SHINGLE),
        lambda i: F.concat_ws(" ", *[F.col("_w")[i + k] for k in range(SHINGLE)])).alias("_s"))


def _windows(shingles: DataFrame, *keys: str) -> DataFrame:
    return shingles.select(*keys, F.explode(F.transform(
        F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.slice("_s", i + 1, WINDOW))).alias("_win"))


def _starts(shingle):
    """The short notices that may begin where the shingle does: its first 2, 3 ... words."""
    return [F.substring_index(shingle, " ", k) for k in range(2, SHINGLE)]


def _short_key(phrase):
    return F.xxhash64(phrase, F.lit("short"))


def _banded(windows: DataFrame, n_bands: int, *keys: str, docs: bool = False) -> DataFrame:
    """One row per (window, band): the minimum of the band's hash over the window's shingles. Bands
    have seeds of their own, so the minimum alone is the key; plain expressions, no lambdas. For
    documents also the first band of the window's first shingle alone and its short beginnings."""
    hashed = windows.select(*keys, "_win", *[
        F.when(F.get("_win", F.lit(k)).isNotNull(), F.xxhash64(F.get("_win", F.lit(k)))).alias(f"_h{k}")
        for k in range(WINDOW)])

    def minimum(band: int):
        return F.least(*[F.when(F.col(f"_h{k}").isNotNull(), F.xxhash64(f"_h{k}", F.lit(band))) for k in range(WINDOW)])

    alone = [F.xxhash64("_h0", F.lit(0)), *map(_short_key, _starts(F.get("_win", F.lit(0))))] if docs else []
    return hashed.select(*keys, "_win", F.explode(F.array(*[minimum(b) for b in range(n_bands)], *alone)).alias("_min"))


def scan_licenses(docs: DataFrame, templates: DataFrame, min_containment: float = MIN_CONTAINMENT,
                  target: float = TARGET) -> DataFrame:
    """(doc_id, license, n_shared, n_template, containment) of each licence's best contained wording."""
    n_bands = bands(1 / WINDOW, target)
    t_words = _words(templates.select("license", "text").withColumn("_t", F.md5(F.concat_ws("\n", "license", "text"))), "license", "_t")
    short = t_words.where(F.size("_w").between(2, SHINGLE - 1)).select("license", "_t", F.concat_ws(" ", "_w").alias("_x"))
    ts = _shingles(t_words, "license", "_t")
    t_one = ts.select("_t", F.explode(F.transform("_s", lambda s: F.array(s))).alias("_win"))
    t_bands = _banded(_windows(ts, "_t").unionByName(t_one), n_bands, "_t").select("_t", "_min").unionByName(
        short.select("_t", _short_key(F.col("_x")).alias("_min"))).distinct()
    all_sh = ts.select("license", "_t", F.array_distinct("_s").alias("_all")).unionByName(
        short.select("license", "_t", F.array("_x").alias("_all"))).dropDuplicates(["_t"])
    t_sh = all_sh.select("license", "_t", F.size("_all").cast("long").alias("n_template"), F.explode("_all").alias("_x"))
    # empty words at the end, so that every word begins a shingle; no template shingle has one
    padded = _words(docs.select("doc_id", "text"), "doc_id").where(F.size("_w") > 0).withColumn(
        "_w", F.concat("_w", F.array_repeat(F.lit(""), SHINGLE - 1)))
    d_win = _windows(_shingles(padded, "doc_id"), "doc_id")
    found = _banded(d_win, n_bands, "doc_id", docs=True).join(maybe_broadcast(t_bands), "_min").select(
        "doc_id", "_t", F.explode(F.concat("_win", F.array(*_starts(F.get("_win", F.lit(0)))))).alias("_x"))
    exact = found.join(maybe_broadcast(t_sh, row_bytes=256), ["_t", "_x"]).groupBy(
        "doc_id", "license", "_t", "n_template").agg(F.count_distinct("_x").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_template")
    best = exact.where(share >= min_containment).groupBy("doc_id", "license").agg(
        F.max(F.struct(share.alias("c"), "n_shared", "n_template")).alias("_b"))
    return best.select("doc_id", "license", "_b.n_shared", "_b.n_template", F.col("_b.c").alias("containment"))
