"""License scans by diagonal voting.

All rolling k-grams of words of each text are joined with the positions of the same k-grams in license
templates (broadcast up to MOST_BROADCAST k-grams).  A match votes for the diagonal text position - template position;
votes are counted per document, template and diagonal, neighbouring diagonals (insertions and deletions of a
few words) are merged, and a merged span is verified by the words that its k-grams hold: they must cover enough
both of the template and of the span, and hold all numbers of the template, so that a notice of another version is none.  Of
overlapping spans the best stays.  A span says that the words of a notice stand there: "not licensed under the MIT License"
holds those of one.

Beside the templates' labels there are base phrases, found wherever their words stand consecutively.

Null, empty and wordless texts have no places, no labels and score 0.  Repeated rows are scanned one by one.
Other columns are left out, so their names don't matter.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytesops as B
from .common import as_text, keyed, saved

K, SLACK, COVER = 4, 3, 0.7
MOST_BROADCAST = 200_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public license notices, as their authors ask for them to be given.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1"),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offs, B.ALNUM)
    return B.span_digest(data, starts, ends), first


def _hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def template_table(spark, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(gram, template, label, place, n_words) of all k-grams of the templates."""
    rows = []
    for t, (label, text) in enumerate(templates):
        h = _hashed(text)
        flat, _ = B.grams(h, np.array([0, len(h)]), k)
        rows += [(g, t, label, i, len(h)) for i, g in enumerate(flat.view(np.int64).tolist())]
    table = spark.createDataFrame(rows, "gram long, template int, label string, place int, n_words int")
    return F.broadcast(table) if len(rows) <= MOST_BROADCAST else table


def decisive_words(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, decisive): the places of a template's numbers."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER)) for _, text in templates]
    return F.broadcast(spark.createDataFrame([(t, [i for i, w in enumerate(own) if w.isdigit()]) for t, own in enumerate(words)], "template int, decisive array<int>"))


def tokenized(rows: DataFrame, phrases: dict[str, str], k: int) -> DataFrame:
    """(_rid, n_words, places array<struct<start, label>>, grams array<long>)."""
    wanted = [(label, _hashed(p)) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in B.text_blocks(batch, "text"):
                h, first = word_hashes(data, offs)
                places: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for label, p in wanted:
                    at = np.flatnonzero(h[: max(len(h) - len(p) + 1, 0)] == p[0])
                    for j in range(1, len(p)):
                        at = at[h[at + j] == p[j]]
                    text = np.searchsorted(first, at, "right") - 1
                    for d, a in zip(text.tolist(), at.tolist(), strict=True):
                        if a + len(p) <= first[d + 1]:
                            places[d].append({"start": a - int(first[d]), "label": label})
                flat, ptr = B.grams(h, first, k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_rid"), pa.array(np.diff(first)), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))), B.list_array(flat.view(np.int64), ptr, pa.int64())],
                    ["_rid", "n_words", "places", "grams"],
                )

    return rows.select("_rid", "text").mapInArrow(run, "_rid long, n_words long, places array<struct<start: long, label: string>>, grams array<long>")


def spans(tokens: DataFrame, templates: DataFrame, decisive: DataFrame, k: int, slack: int, cover: float) -> DataFrame:
    """Verified spans: (_rid, template, label, first_word, last_word, cover), the best of those that overlap.

    cover is the number of template words that matched k-grams hold in place, as a share of the words of the template or of the
    span, whichever is more: words that the text lacks, adds or changes lower it, so of two similar notices the
    one that differs in a word loses against the one that doesn't.
    """
    votes = tokens.select("_rid", F.posexplode("grams").alias("at", "gram")).join(templates, "gram")
    diagonals = votes.groupBy("_rid", "template", "label", "n_words", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("place").alias("held")
    )
    by_diagonal = Window.partitionBy("_rid", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) <= slack, 0).otherwise(1)
    run = F.sum("apart").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0))
    words = F.array_distinct(F.flatten(F.transform("held", lambda p: F.sequence(p, p + (k - 1)))))
    merged = diagonals.withColumn("apart", apart).withColumn("run", run).groupBy("_rid", "template", "label", "n_words", "run").agg(
        F.min("low").alias("first_word"), (F.max("high") + (k - 1)).alias("last_word"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("held")
    )
    merged = merged.withColumn("words", words).join(decisive, "template").where(F.size(F.array_except("decisive", "words")) == 0)
    share = (F.size("words") / F.greatest(F.col("n_words"), F.col("last_word") - F.col("first_word") + 1)).alias("cover")
    good = merged.select("_rid", "template", "label", "first_word", "last_word", share, "n_words").where(F.col("cover") >= cover)
    # spans that overlap, directly or by others, stand together: at most a few for each place of a text
    by_place = Window.partitionBy("_rid").orderBy("first_word", "template").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("first_word") <= F.max("last_word").over(by_place), 0).otherwise(1)
    group = F.sum("fresh").over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    of = F.struct("cover", "n_words", (-F.col("template")).alias("order"), "template", "label", "first_word", "last_word")
    together = good.withColumn("fresh", fresh).withColumn("group", group).groupBy("_rid", "group").agg(F.collect_list(of).alias("all"))
    best = F.filter("all", lambda x: ~F.exists("all", lambda y: (y > x) & (y.first_word <= x.last_word) & (x.first_word <= y.last_word)))
    return together.select("_rid", F.explode(best).alias("s")).select("_rid", "s.template", "s.label", "s.first_word", "s.last_word", "s.cover")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """One row per document: doc_id, n_words, places (of phrases), found (verified spans), score.

    score = 1 - (1 - best cover of a template) * (1/2 if there is a base place, else 1).
    """
    rows = keyed(as_text(docs), "text").drop("_row")
    tokens = tokenized(rows, phrases, k)
    verified = spans(tokens, template_table(docs.sparkSession, templates, k), decisive_words(docs.sparkSession, templates), k, slack, cover)
    found = verified.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("first_word", "last_word", "label", "cover"))).alias("found"), F.max("cover").alias("best"))
    # the scan of the texts is cheap against storing their k-grams: it runs once for the votes and once for the rows
    base = tokenized(rows, phrases, k).select("_rid", "n_words", "places")
    out = rows.select("_rid", "doc_id").join(base, "_rid").join(found, "_rid", "left")
    score = 1 - (1 - F.coalesce("best", F.lit(0.0))) * F.when(F.size("places") > 0, 0.5).otherwise(1.0)
    return out.select("doc_id", "n_words", "places", "found", score.alias("score"))
