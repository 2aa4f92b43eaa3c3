"""License scans by diagonal voting.

Each run of words of a document is hashed and joined to the places of the same
run in the templates. A hit at word p of the document and word q of the template
votes for the diagonal p - q; votes are summed by diagonal, diagonals a few
words apart (words were put in or left out) are merged, and a merged span is
verified: by the share of the template's words, or of its own if it has more,
that its hits cover, each word once. Each diagonal is verified by itself and with those within a
bounded distance above it, and of what overlaps the best is taken. Long templates, texts and notices of licenses, vote
with runs of five words; phrases that name a license vote with runs of two and
must be there whole, on one diagonal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, utf8, written
from .repeats import _powers

K, SHARE = 5, 0.5
#: Runs of phrases; words of a template up to which all of it must be found; words of a template for each word put in or left out.
PAIR, SHORT, SLACK = 2, 20, 3
#: Up to so many places of templates are sent to every task; beyond, they are joined.
SENT_PLACES = 500_000

#: Phrases that name a license, and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Passages of well-known licenses and notices, and the label of each.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "as-is-disclaimer": """The software is provided "as is", without warranty of any kind, express or implied, including but
        not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no
        event shall the authors or copyright holders be liable for any claim, damages or other liability.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "agpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "epl-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "bsl-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so""",
    "cc0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work""",
    "cc-by-4.0-notice": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a
        copy of this license, visit http://creativecommons.org/licenses/by/4.0/""",
    "cc-by-sa-4.0-notice": """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International
        License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "apache-2.0-text": """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby
        grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to
        reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and
        such Derivative Works in Source or Object form.""",
    "gpl-2.0-text": """The licenses for most software are designed to take away your freedom to share and change it. By contrast,
        the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure
        the software is free for all its users.""",
    "gpl-3.0-text": """The GNU General Public License is a free, copyleft license for software and other kinds of works. The
        licenses for most software and other practical works are designed to take away your freedom to share and change the
        works.""",
    "mpl-2.0-text": """Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual
        property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available,
        modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with
        Modifications, or as part of a Larger Work""",
    "cc-by-4.0-text": """By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and
        conditions of this Creative Commons Attribution 4.0 International Public License""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "cc-by-4.0": "licensed under CC BY 4.0",
    "cc-by-nc-4.0": "licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under CC BY-SA 4.0",
}
#: Templates that share most of their words; of a family, a text gets those of the largest share.
FAMILIES = {"gpl-notice": "gnu", "lgpl-notice": "gnu", "agpl-notice": "gnu", "cc-by-4.0-notice": "cc", "cc-by-sa-4.0-notice": "cc"}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some texts (bytes between offsets), and the text of each."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD[data]
    fresh = np.ones(n, bool)
    fresh[1:] = ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    fresh[begins] = True
    starts = np.flatnonzero(inside & fresh)
    over = np.ones(n, bool)
    over[:-1] = ~inside[1:]
    stops = offsets[1:-1]
    over[stops[stops > 0] - 1] = True
    ends = np.flatnonzero(inside & over) + 1
    words, up, down = _powers(3, n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words[_LOWER[data]] * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h, np.searchsorted(offsets, starts, "right") - 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
            out ^= out >> np.uint64(27)
    return out


def _of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return hashed_words(data, np.array([0, len(data)]))[0]


def _hashed(columns, per_text):
    """Runs per_text(hashes of all words of a slice, text of each word, number of texts) and puts its columns beside the given ones."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in slices(at):
                h, of = hashed_words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                part = batch.slice(i, j - i)
                out = per_text(h, of, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *out.values()], [*columns, *out])

    return run


def _counts(h, of, n):
    return {"n_words": pa.array(np.bincount(of, minlength=n))}


def _runs(k: int):
    """For each word of a text, the hashes of the k and of the PAIR words that begin with it; where there are fewer, zero."""

    def per_text(h, of, n):
        both = np.zeros((len(h), 2), np.uint64)
        for c, size in enumerate((k, PAIR)):
            g = grams(h, size)
            both[: len(g), c] = np.where(of[: len(g)] == of[size - 1 :][: len(g)], g, 0)
        sizes = 2 * np.bincount(of, minlength=n)
        return {"runs": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(both.ravel().view(np.int64)))}

    return per_text


def _pick(values: Sequence, t: str = "t") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(t) + 1)


def votes(docs: DataFrame, templates: Sequence[tuple[str, int]], k: int = K) -> DataFrame:
    """k1, k2, t, d, first, last and at for each diagonal d with hits of template t, a text and the length of its runs (k or
    PAIR): the document's words p of the first and last hit, and the template's words q that the hits begin with. docs: k1, k2, text."""
    rows = [(int(g.view(np.int64)), t, q) for t, (text, size) in enumerate(templates) for q, g in enumerate(grams(_of(text), size))]
    places = docs.sparkSession.createDataFrame(rows, "g long, t int, q int")
    found = docs.select("k1", "k2", "text").mapInArrow(_hashed(["k1", "k2"], _runs(k)), "k1 long, k2 long, runs array<long>")
    hits = found.select("k1", "k2", F.posexplode("runs").alias("p", "g")).join(F.broadcast(places) if len(rows) <= SENT_PLACES else places, "g")
    hits = hits.withColumn("p", F.floor(F.col("p") / 2).cast("long"))
    return hits.groupBy("k1", "k2", "t", (F.col("p") - F.col("q")).alias("d")).agg(F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("q").alias("at"))


def named(votes: DataFrame, first: int, sizes: Sequence[int]) -> DataFrame:
    """k1, k2, t and word for each place where a phrase stands: a diagonal that all its pairs vote for. Phrases are the templates from number first on."""
    whole = votes.where(F.col("t") >= first).where(F.size("at") == _pick([*[0] * first, *(n - PAIR + 1 for n in sizes)]))
    return whole.select("k1", "k2", (F.col("t") - first).alias("t"), F.col("d").alias("word"))


def spans(votes: DataFrame, sizes: Sequence[int], labels: Sequence[str], k: int = K, share: float = SHARE) -> DataFrame:
    """k1, k2, label, first, last (words of the document) and share of each verified span of long templates (the first ones) of so many
    words. Of diagonals that lie close the best run is a span: one by itself, or all within the template's words / SLACK above one."""
    wide = _pick([max(1, n // SLACK) for n in sizes])
    order = Window.partitionBy("k1", "k2", "t").orderBy("d")
    apart = F.coalesce(F.col("d") - F.lag("d").over(order) > wide, F.lit(True)).cast("int")
    long = votes.where(F.col("t") < len(sizes)).withColumn("new", apart).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    band = Window.partitionBy("k1", "k2", "t").orderBy("scaled").rangeBetween(0, 1 << 20)
    runs = long.withColumn("scaled", F.floor(F.col("d") * (1 << 20) / wide)).select("k1", "k2", "t", "group", "at", "first", "last", F.flatten(F.collect_list("at").over(band)).alias("all"), F.min("first").over(band).alias("from"), F.max("last").over(band).alias("to"))
    each = runs.select("k1", "k2", "t", "group", F.explode(F.array(F.struct("at", "first", "last"), F.struct(F.array_distinct("all").alias("at"), F.col("from").alias("first"), F.col("to").alias("last")))).alias("run")).select("k1", "k2", "t", "group", "run.at", "run.first", (F.col("run.last") + k - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda q: F.sequence(q, q + (k - 1))))))
    length = F.greatest(_pick(sizes).cast("long"), F.col("last") - F.col("first") + 1)  # words put in count against a span
    verified = each.withColumn("share", covered / length).where(F.col("share") >= _pick([1.0 if n <= SHORT else share for n in sizes]))
    found = verified.groupBy("k1", "k2", "t", "group").agg(F.max(F.struct("share", (-F.col("first")).alias("early"), "first", "last")).alias("best")).select("k1", "k2", "t", "best.*")
    family = Window.partitionBy("k1", "k2", "family")
    best = found.withColumn("family", _pick([FAMILIES.get(x, x) for x in labels])).withColumn("most", F.max("share").over(family)).where("share = most")
    return best.select("k1", "k2", _pick(labels).alias("label"), "first", "last", "share")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs (doc_id, text).

    A null text is empty: no words, no labels (empty strings), null places and
    score 0. score is the largest share of a template or phrase that was found.
    Phrases have two words at least, templates five. Repeated rows and null ids
    are rows of their own; other columns are not read.
    """
    many, long = [len(_of(x)) for x in phrases], [len(_of(x)) for x in templates.values()]
    if min([*many, PAIR]) < PAIR or min([*long, K]) < K:
        raise ValueError(f"phrases have {PAIR} words at least, templates {K}")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), F.col("doc_id").isNull(), "doc_id", text).alias("k2"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = keyed.mapInArrow(_hashed(["doc_id", "k1", "k2"], _counts), f"doc_id {kind}, k1 long, k2 long, n_words long")
    voted = written(votes(keyed, [*((x, K) for x in templates.values()), *((x, PAIR) for x in phrases)]))
    at = named(voted, len(long), many).select("k1", "k2", "word", _pick(list(phrases.values())).alias("base"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("share"))
    more = spans(voted, long, list(templates)).select("k1", "k2", F.lit(None).cast("long").alias("word"), F.lit(None).cast("string").alias("base"), "label", "share")
    found = at.unionByName(more).groupBy("k1", "k2").agg(F.count("word").alias("n_base"), F.min("word").alias("first_word"), F.max("word").alias("last_word"), F.collect_set("base").alias("base"), F.collect_set("label").alias("label"), F.max("share").alias("share"))
    joined = counted.join(found, ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    base, label = F.coalesce("base", none), F.coalesce("label", none)
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", listed(base).alias("base_labels"), listed(F.array_union(base, label)).alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
