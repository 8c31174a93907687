"""Licence scans with a trained paragraph classifier, in built-in functions and Spark ML only.

Word n-grams of known notices are the sparse features of a multinomial logistic regression over
licence families and an unknown class. It is fitted on damaged copies of the notices, ordinary
paragraphs of the scanned table and fragments. What is scored are single lines and, for wrapped notices,
runs of lines that all hold words of notices, so that a blank line ends a run; a second regression on held-out examples turns its
margin into a calibrated probability. A prediction is confirmed by comparison with the notices: one of
the family must be half there with its name and version, and no other family's may be closer.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, staged, table, text_of

# The opening notices of public licences.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "This project is released under the Apache 2.0 license"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD", "Licensed under the BSD 3-Clause License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY", "Licensed under CC BY 4.0"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal Public Domain Dedication"),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1"),
    ("BSD", "Licensed under the BSD 2-Clause License"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "Released under the Unlicense"),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("Proprietary", "All rights reserved"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
]
UNKNOWN = "unknown"
BUCKETS = 1 << 14
ORDINARY = 2000  # ordinary paragraphs used for fitting at most, by hash
VARIANTS = 60  # damaged copies of each notice
# Everyday words of the notices. All others are anchors: no notice has half of its word pairs without one.
EVERYDAY = frozenset(
    "a all and any are as at be by can charge clause code deal either except extent file files following for forms general"
    " has in is it law may met no not of only or part person possible provided related that the this to under universal use v version with"
    " without work you your".split()
)
# Words of licence names: a notice that has one is confirmed only where the text has it too.
NAMES = frozenset(
    "affero apache attribution attribution-noderivatives attribution-noncommercial attribution-noncommercial-noderivatives"
    " attribution-noncommercial-sharealike attribution-sharealike boost bsd by-nc by-nc-nd by-nc-sa by-nd by-sa cc cc0"
    " commons creative eclipse general gnu isc lesser mit mozilla unlicense".split()
)
LEAST_PROBABILITY = 0.5
LEAST_OVERLAP = 0.5  # share of a notice's word pairs that confirms a prediction
GRAMS = 3


def _tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots, plus or minus signs; 2.0 and v2 are written 2."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+")
    found = F.filter(F.transform(found, lambda w: F.btrim(w, F.lit(".-+"))), lambda w: w != "")
    return F.transform(found, lambda w: F.regexp_replace(w, r"^v?([0-9]+)(\.0)?$", "$1"))


def _grams(words: Column, longest: int = GRAMS) -> Column:
    """Distinct n-grams of one to ``longest`` words."""

    def of(n: int) -> Column:
        # element_at of a slice never reaches beyond the array: the sequence ends in time. The function
        # takes one argument only: Spark passes the index as a second one, default or not.
        grams = F.transform(
            F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")
        )
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    every = [words, *[of(n) for n in range(2, longest + 1)]]
    return F.array_distinct(F.concat(*every))


def _notices(spark: SparkSession) -> DataFrame:
    """``notice, family, words, pairs, grams, signature``: the signature is a notice's name words, and its numbers
    where its family is one version of a licence."""
    rows = [(i, family, text) for i, (family, text) in enumerate(NOTICES)]
    known = spark.createDataFrame(rows, "notice int, family string, text string")
    known = known.withColumn("words", _tokens(F.col("text")))
    pairs = F.filter(_grams(F.col("words"), 2), lambda g: F.contains(g, F.lit(" ")))
    names = F.array(*[F.lit(w) for w in sorted(NAMES)])
    number = lambda w: w.rlike("^[0-9]") & F.contains(F.col("family"), F.concat(F.lit("-"), w))
    signature = F.filter("words", lambda w: F.array_contains(names, w) | number(w))
    return known.select(
        "notice",
        "family",
        "words",
        pairs.alias("pairs"),
        _grams(F.col("words")).alias("grams"),
        F.array_distinct(signature).alias("signature"),
    )


def _ordinary(docs: DataFrame) -> DataFrame:
    """A bounded sample of paragraphs with at least three words: ``words``."""
    # Only hashes are ranked; the few texts they stand for are fetched by a bounded broadcast.
    hashed = docs.select(text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    least = hashed.select("h").orderBy("h").limit(ORDINARY).distinct()
    picked = hashed.join(F.broadcast(least), "h", "left_semi")
    lines = picked.select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select(_tokens(F.col("line")).alias("words")).where(F.size("words") > 2)
    # Distinct, so that a line repeated throughout the table is one example.
    return lines.distinct().orderBy(F.xxhash64("words"), F.array_join("words", " ")).limit(ORDINARY)


def _share(own: Column, pairs: Column) -> Column:
    return F.size(F.array_intersect(pairs, own)) / F.size(pairs)


def _overlap(own: Column, templates: Column) -> Column:
    """The largest share of a template's word pairs that ``own`` holds."""
    return F.array_max(F.transform(templates, lambda t: _share(own, t)))


def _examples(notices: DataFrame, ordinary: DataFrame) -> DataFrame:
    """``family, words, number``: damaged notices, fragments of them, and ordinary paragraphs."""
    copies = notices.select("notice", "family", "words", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    draw = lambda i: F.pmod(F.xxhash64("notice", "v", i), F.lit(100))
    # Nine variants of ten lose up to 35 % of their words; the tenth keeps a fifth and is unknown.
    fragment = F.col("v") % 10 == 9
    lost = F.when(fragment, 80).otherwise((F.col("v") % 10) * 4)
    kept = F.filter("words", lambda w, i: draw(i) >= lost)
    damaged = copies.select(
        F.when(fragment, UNKNOWN).otherwise(F.col("family")).alias("family"), kept.alias("words"), F.col("v").alias("number")
    )
    plain = ordinary.select(
        F.lit(UNKNOWN).alias("family"), "words", F.pmod(F.xxhash64("words"), F.lit(1000)).cast("int").alias("number")
    )
    return damaged.unionByName(plain).where(F.size("words") > 0)


class LicenceModel:
    """Fitted regressions and the words that make a paragraph worth scoring."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.notices = _notices(spark)
        known = self.notices.select("family", "words", "pairs", "grams").collect()  # the fixed notices above
        self.pairs = [(row["family"], row["pairs"]) for row in known]
        self.grams = sorted({g for row in known for g in row["grams"]})
        words = sorted({w for row in known for w in row["words"]})
        # Written with its pairs, which a filter would make anew for each template.
        ordinary = staged(_ordinary(docs).withColumn("own", _grams(F.col("words"), 2)), "ordinary-paragraphs")
        # The notices alone decide which paragraphs are scored, however frequent their words are in the table.
        self.anchors = [w for w in words if w not in EVERYDAY and not w[0].isdigit()]
        self.families = sorted({family for family, _ in NOTICES})
        self.hashing = HashingTF(inputCol="features_in", outputCol="features", numFeatures=BUCKETS, binary=True)
        # Ordinary paragraphs with several anchors or much of a notice may be notices: they would teach the
        # wrong class.
        anchors = F.array(*[F.lit(w) for w in self.anchors])
        templates = F.array(*[F.array(*[F.lit(g) for g in row["pairs"]]) for row in known])
        clean = ordinary.where(F.size(F.array_intersect("words", anchors)) < 2)
        clean = clean.where(_overlap(F.col("own"), templates) < LEAST_OVERLAP)
        examples = staged(self._features(_examples(self.notices, clean)), "licence-examples")
        number = F.coalesce(
            F.element_at(F.create_map(*[x for i, f in enumerate(self.families) for x in (F.lit(f), F.lit(i + 1.0))]), F.col("family")),
            F.lit(0.0),
        )
        examples = examples.withColumn("label", number)
        half = F.pmod(F.xxhash64("number", "words"), F.lit(2))
        train, held = examples.where(half == 0), examples.where(half == 1)
        self.classifier = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(train)
        scored = self._margin(self.classifier.transform(held))
        scored = scored.select("margin", (F.col("label") > 0).cast("double").alias("label"))
        assemble = VectorAssembler(inputCols=["margin"], outputCol="margin_vector")
        platt = LogisticRegression(featuresCol="margin_vector", regParam=1e-3)
        fitted = platt.fit(assemble.transform(scored))
        self.slope, self.offset = float(fitted.coefficients[0]), float(fitted.intercept)

    def _features(self, rows: DataFrame) -> DataFrame:
        """Sparse n-gram vectors; n-grams of no notice carry no weight and are left out."""
        return self.hashing.transform(self._known_grams(rows))

    def _known_grams(self, rows: DataFrame) -> DataFrame:
        known = F.array(*[F.lit(g) for g in self.grams])
        return rows.withColumn("features_in", F.array_intersect(_grams(F.col("words")), known))

    def _margin(self, scored: DataFrame) -> DataFrame:
        """Log odds of the best family against the unknown class, and that family."""
        p = vector_to_array("probability")
        scored = scored.withColumn("p", p)
        best = F.array_max(F.slice("p", 2, len(self.families)))
        scored = scored.withColumn("best", best)
        names = F.array(*[F.lit(f) for f in self.families])
        place = F.array_position(F.slice("p", 2, len(self.families)), F.col("best")).cast("int")
        odds = F.log(F.greatest("best", F.lit(1e-12)) / F.greatest(F.get("p", F.lit(0)), F.lit(1e-12)))
        return scored.withColumn("family", F.element_at(names, place)).withColumn("margin", odds)

    def scan(self, docs: DataFrame) -> DataFrame:
        anchors = F.array(*[F.lit(w) for w in self.anchors])
        # Repeated rows are told apart by a number, which the written lines fix.
        rows = docs.select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
        # A paragraph without any of the anchors is unknown. The longest plain part of each anchor
        # is looked for first, so that few documents and lines are taken to pieces carefully.
        part = lambda w: max(re.findall("[a-z0-9]+", w), key=lambda x: (x not in EVERYDAY, len(x)))
        plain = sorted({part(w) for w in self.anchors})
        plain = F.array(*[F.lit(w) for w in plain])
        hint = lambda text: F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), plain)
        rows = rows.where(hint(F.col("text")))
        lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_no", "paragraph"))
        lines = lines.where(hint(F.col("paragraph")))
        # Half of a notice holds a pair with an anchor; in German, "mit" alone tells nothing.
        close = sorted({g for _, pairs in self.pairs for g in pairs if not set(self.anchors).isdisjoint(g.split(" "))})
        close = F.array(*[F.lit(g) for g in close])
        # A filter on a column of words would be pushed below it and take the paragraph to pieces again for
        # each of its pairs; as the one element of an array, its words are taken once.
        worth = lambda words: F.arrays_overlap(words, anchors) & F.arrays_overlap(_grams(words, 2), close)
        lines = lines.where(F.exists(F.array(_tokens(F.col("paragraph"))), worth))
        lines = lines.withColumn("words", _tokens(F.col("paragraph")))
        # Written, for the filter on the probability would be pushed below the n-grams and take the
        # paragraph to pieces again for each of its words.
        units = staged(self._known_grams(_with_runs(staged(lines, "licence-lines"))), "licence-units")
        scored = self._margin(self.classifier.transform(self.hashing.transform(units)))
        chance = 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("margin") + F.lit(self.offset))))
        scored = scored.withColumn("probability", F.round(chance, 6)).where(F.col("probability") >= LEAST_PROBABILITY)
        scored = scored.select("row", "run", "lines", "doc_id", "paragraph_no", "paragraph", "words", "family", "probability")
        # One array of notices per family: as many rows as NOTICES has families.
        templates = self.notices.groupBy("family").agg(F.collect_list(F.struct("pairs", "signature")).alias("templates"))
        # Written, for a pair list would be made anew for every notice it is held against.
        # Only pairs of some notice matter there, so a long run is held against few.
        of_notices = F.array(*[F.lit(g) for g in sorted({g for _, pairs in self.pairs for g in pairs})])
        own = F.array_intersect(_grams(F.col("words"), 2), of_notices)
        scored = staged(scored.withColumn("own", own), "licence-predictions")
        near = scored.join(F.broadcast(templates), "family")
        known = F.array(
            *[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(g) for g in pairs]).alias("pairs")) for f, pairs in self.pairs]
        )
        others = F.filter(known, lambda t: t["family"] != F.col("family"))
        near = near.withColumn("rival", _overlap(F.col("own"), F.transform(others, lambda t: t["pairs"])))
        confirms = lambda t: (
            (_share(F.col("own"), t["pairs"]) >= F.greatest(F.lit(LEAST_OVERLAP), F.col("rival")))
            & (F.size(F.array_except(t["signature"], F.col("words"))) == 0)
        )
        overlap = _overlap(F.col("own"), F.transform("templates", lambda t: t["pairs"]))
        near = near.withColumn("overlap", F.round(overlap, 6)).withColumn("confirmed", F.exists("templates", confirms))
        return _lines_or_runs(near).select(
            "doc_id",
            F.col("paragraph_no").cast("long").alias("paragraph_no"),
            F.btrim("paragraph", F.lit(BLANKS)).alias("paragraph"),
            "family",
            "probability",
            "overlap",
            "confirmed",
        )


def _with_runs(lines: DataFrame) -> DataFrame:
    """The lines of each ``row``, and every run of two or more that follow on each other as one unit:
    ``run`` and ``lines`` (how many) beside the columns of a line. A window holds one document's lines."""
    place = F.row_number().over(Window.partitionBy("row").orderBy("paragraph_no"))
    lines = lines.withColumn("run", F.col("paragraph_no") - place)
    parts = F.sort_array(F.collect_list(F.struct("paragraph_no", "paragraph", "words")))
    runs = lines.groupBy("row", "run").agg(F.count("*").alias("lines"), F.first("doc_id").alias("doc_id"), parts.alias("parts"))
    runs = runs.where("lines > 1").select(
        "row",
        "doc_id",
        F.col("parts")[0]["paragraph_no"].alias("paragraph_no"),
        F.array_join("parts.paragraph", "\n").alias("paragraph"),
        F.flatten("parts.words").alias("words"),
        "run",
        "lines",
    )
    return lines.withColumn("lines", F.lit(1).cast("bigint")).unionByName(runs)


def _lines_or_runs(found: DataFrame) -> DataFrame:
    """A run stands for its lines where it is confirmed as a family that none of them is; else they do."""
    within = Window.partitionBy("row", "run")
    is_run = F.col("lines") > 1
    family = F.max(F.when(is_run & F.col("confirmed"), F.col("family"))).over(within)
    of_lines = F.collect_set(F.when(~is_run & F.col("confirmed"), F.col("family"))).over(within)
    found = found.withColumn("wrapped", family.isNotNull() & ~F.array_contains(of_lines, F.coalesce(family, F.lit(""))))
    return found.where(F.when(is_run, F.col("confirmed") & F.col("wrapped")).otherwise(F.col("confirmed") | ~F.col("wrapped")))


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, paragraph, family, probability, overlap, confirmed``: one row for each
    line that is probably a licence notice, or for the run of lines over which one is wrapped (the number is
    that of its first line, counted from 0).

    NULL and empty texts have none; a NULL ``doc_id`` stays NULL; repeated rows repeat their lines;
    other columns are ignored; an empty table gives an empty table (the notices alone are learned).
    """
    return LicenceModel(docs).scan(docs)


def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of every whole text of ``documents``; see :func:`scan_licences`."""
    return scan_licences(table(spark, folder, "documents"))
