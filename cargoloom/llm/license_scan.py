"""Licence wording in texts, found by votes on diagonals.

Every run of K words of every text is joined, by its hash, to the places where the templates have it.  A hit
votes for a diagonal: word number in the text less word number in the template.  Votes are added up per text,
template and diagonal; neighbouring diagonals (words put in or left out) are merged to spans; a span counts if
enough of the template's words stand in it and it isn't much longer than the template.

Exact phrases need no tolerance: a phrase stands where one diagonal has all of its runs, and the diagonal is the
number of its first word.

A null text is empty: no words, no labels, score 0.  Each row is scanned by itself, repeated ones too; a null id stays null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_named, in_arrow, steps, texts
from .words import LOWER, NOT_ALNUM, byte_sums, grams, span_hash, spans

K = 3
#: Phrases that count where they stand word by word.
PHRASES = {"mit": ("under the mit license",), "apache-2": ("apache license version 2",), "cc-by-nc": ("cc by nc",)}
#: Wording that counts if most of it is there.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "released under the terms of the mit license"),
    "apache-2": ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
                 "licensed under the apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "gpl": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation",),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",),
    "all-rights-reserved": ("no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission",),
}
#: Neighbouring diagonals, share of the template's words, and longest span as a multiple of the template.
GAP, LEAST_COVER, LONGEST = 3, 0.8, 1.5
#: The template side is broadcast up to so many runs of words; beyond, both sides are shuffled.
BROADCAST_RUNS = 200_000


def word_runs(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the runs, their rows' first runs, words of each row)."""
    data = LOWER[data]
    start, end, first = spans(data, offsets, NOT_ALNUM)
    runs, begin = grams(span_hash(byte_sums(data), start, end), first, k)
    return runs.astype(np.int64), begin, np.diff(first)


def template_rows(phrases: Mapping[str, tuple[str, ...]], templates: Mapping[str, tuple[str, ...]], k: int = K) -> list[tuple]:
    """(hash, template number, label, exact, place, words) of each run of each template."""
    rows = []
    listed = [(label, text, exact) for exact, source in ((True, phrases), (False, templates)) for label, some in source.items() for text in some]
    for number, (label, text, exact) in enumerate(listed):
        raw = np.frombuffer(text.encode(), np.uint8)
        runs, _, words = word_runs(raw, np.array([0, len(raw)]), k)
        if words[0] < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(int(h), number, label, exact, place, int(words[0])) for place, h in enumerate(runs)]
    return rows


def _hits(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    """A row for each hit of a run of words on a template place, and one without template for each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(column_named(batch, "text")):
                runs, begin, words = word_runs(data, offsets, k)
                runs = np.insert(runs, begin[:-1], 0)  # the text's own row comes first
                cut = (begin + np.arange(len(begin))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column_named(batch, "row")[a:b], column_named(batch, "doc_id")[a:b], pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array(runs))],
                                                 names=["row", "doc_id", "n_words", "runs"])
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    runs = in_arrow(numbered, run, "row long, doc_id long, n_words long, runs array<long>") \
        .select("row", "doc_id", "n_words", F.posexplode("runs").alias("at", "hash"))
    places = docs.sparkSession.createDataFrame(rows, "hash long, template int, label string, exact boolean, place int, words int")
    side = F.broadcast(places) if len(rows) <= BROADCAST_RUNS else places
    return runs.join(side, "hash", "left").where(F.col("template").isNotNull() | (F.col("at") == 0))


def _spans(hits: DataFrame, k: int) -> DataFrame:
    """One row per text, template and span, and one without template for each text; exact phrases keep their diagonals apart."""
    diagonals = hits.withColumn("at", F.col("at") - 1).groupBy("row", "doc_id", "template", "label", "exact", "words", (F.col("at") - F.col("place")).alias("diagonal")) \
        .agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("place").alias("places"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal", 1, -1 << 30).over(along) > GAP)
    runs = diagonals.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(along))
    merged = runs.groupBy("row", "doc_id", "template", "label", "exact", "words", "span").agg(
        F.max("n_words").alias("n_words"), F.min("diagonal").alias("diagonal"), F.sum("votes").alias("votes"), F.min("lo").alias("first_word"),
        (F.max("hi") + k - 1).alias("last_word"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    cover = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1))))) / F.col("words")
    return merged.withColumn("cover", cover)


def _found(k: int) -> Column:
    """Whether a span counts: an exact phrase with all its runs on one diagonal, or enough of a template in a span of about its length."""
    length = F.col("last_word") - F.col("first_word") + 1
    return F.when(F.col("exact"), F.col("votes") == F.col("words") - k + 1).otherwise((F.col("cover") >= LEAST_COVER) & (length <= F.col("words") * LONGEST))


def license_spans(docs: DataFrame, phrases: Mapping[str, tuple[str, ...]] = PHRASES, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, label, exact, first_word, last_word, cover) of every span that counts."""
    found = _spans(_hits(texts(docs), template_rows(phrases, templates, k), k), k).where(F.col("template").isNotNull() & _found(k))
    return found.select("doc_id", "label", "exact", "first_word", "last_word", "cover")


def license_scan(docs: DataFrame, phrases: Mapping[str, tuple[str, ...]] = PHRASES, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, k: int = K) -> DataFrame:
    """One row per document: words, places of exact phrases, labels, and as score the largest share of a template that stands in one span."""
    scanned = _spans(_hits(texts(docs), template_rows(phrases, templates, k), k), k)
    found = F.coalesce(_found(k), F.lit(False))
    base = F.coalesce(F.col("exact") & found, F.lit(False))
    listed = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return scanned.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(found).alias("labels"), F.coalesce(F.max(F.when(F.col("cover").isNotNull(), F.least("cover", F.lit(1.0)))), F.lit(0.0)).alias("score")).drop("row")
