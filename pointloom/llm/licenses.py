"""Operator 5: licence scans with DataFrame functions only.

A positional index holds, for each licence template, its words of highest IDF (document frequencies are
counted over all documents). A scan probes every word of a file; a posting that matches fixes where the
template would start, the template's mandatory phrase is compared there word by word, and all postings that
agree on a start are summed up, however many templates a file holds. Each template's own rarest word is among
its postings, so no place where a phrase stands is missed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, stage, table

#: Phrase and label of the base rules.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, words and mandatory phrase of the paragraphs of further licences, and of usual notices.
TEMPLATES = [
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free license"),
    ("agpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "the apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "unless required by applicable law or agreed to in writing"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so", "any person or organization obtaining a copy"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", "to endorse or promote products derived from this software"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "provided by the copyright holders and contributors"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("eupl-1.2", "licensed under the european union public licence version 1 2", "european union public licence"),
    ("gpl-header", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl-header", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "in the hope that it will be useful"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages", "the author disclaims all warranties"),
    ("lgpl-header", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "the software is provided as is without warranty of any kind"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "software developed by the openssl project"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "permission is granted to anyone to use this software"),
]
#: Index words of a template.
ANCHORS = 8
MIN_SHARE = 0.5
MARK = "\x00"


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates() -> list[dict]:
    listed = [(label, phrase, phrase, True) for phrase, label in BASE.items()] + [(*t, False) for t in TEMPLATES]
    out = []
    for i, (label, text, phrase, base) in enumerate(listed):
        words, key = text.split(), phrase.split()
        out.append({"tid": i, "label": label, "words": words, "key": key, "key_at": _find(words, key), "base": base})
    return out


def _rows(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("th"), alnum_words(F.col("text")).alias("words"))


def idf(docs: DataFrame) -> dict[str, float]:
    """IDF of the templates' words over all documents; the result has a row for each such word."""
    vocabulary = sorted({w for t in templates() for w in t["words"]})
    known = F.array(*map(F.lit, vocabulary), F.lit(MARK))
    seen = _rows(docs).select(F.explode(F.array_intersect(F.concat(F.array(F.lit(MARK)), "words"), known)).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in seen.collect()}
    n = counts.get(MARK, 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def index(spark, weights: dict[str, float]) -> DataFrame:
    """Postings ``(word, tid, label, base, at, weight, key_at, key)``: the ANCHORS words of highest IDF of
    each template, weights summing to 1; of base phrases the rarest. A row for MARK keeps every file."""
    rows = [(MARK, -1, "", False, 0, 0.0, 0, [])]
    for t in templates():
        order = sorted(range(len(t["words"])), key=lambda i: (-weights[t["words"][i]], i))
        inside = [i for i in order if t["key_at"] <= i < t["key_at"] + len(t["key"])]
        chosen = inside[:1] if t["base"] else list(dict.fromkeys([inside[0], *order]))[:ANCHORS]
        total = sum(weights[t["words"][i]] for i in chosen)
        rows += [(t["words"][i], t["tid"], t["label"], t["base"], i, weights[t["words"][i]] / total, t["key_at"], t["key"]) for i in chosen]
    return spark.createDataFrame(rows, "word string, tid int, label string, base boolean, at int, weight double, key_at int, key array<string>")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document row: ``(doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score)``; ``score`` is the largest share of a verified template's index weight.

    Null and empty texts have no words and no label. Rows that repeat a doc_id are judged each by its own
    text, equal rows alike; null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    postings = F.broadcast(index(spark, idf(docs)))  # a fixed number of rows
    words = _rows(docs).select("doc_id", "th", "words", F.posexplode(F.concat(F.array(F.lit(MARK)), "words")).alias("at1", "word"))
    found = words.join(postings, "word")
    start = F.col("at1") - 1 - F.col("at")
    verified = F.slice("words", F.greatest(start + F.col("key_at") + 1, F.lit(1)), F.greatest(F.size("key"), F.lit(1))) == F.col("key")
    found = found.select("doc_id", "th", F.size("words").cast("long").alias("n_words"), "at", "tid", "label", "base", "weight", start.cast("long").alias("start"), ((F.col("tid") < 0) | ((start + F.col("key_at") >= 0) & verified)).alias("ok"))
    found = stage(found.filter("ok").drop("ok"), "licences")
    # equal rows of one doc_id repeat each posting: count them once, by their number of marks
    starts = found.groupBy("doc_id", "th", "n_words", "tid", "label", "base", "start", "at").agg(F.max("weight").alias("weight"), F.count("*").alias("copies"))
    starts = starts.groupBy("doc_id", "th", "n_words", "tid", "label", "base", "start").agg(F.sum("weight").alias("share"), F.max("copies").alias("copies"))
    taken = F.col("base") | (F.col("share") >= MIN_SHARE)
    is_base = F.col("base") & (F.col("tid") >= 0)
    # phrases differ in length, so two of them may share a start: count the pairs of phrase and start
    out = starts.groupBy("doc_id", "th", "n_words").agg(
        F.sum(F.when(is_base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("tid") >= 0) & taken, F.col("label")))), ",").alias("labels"),
        F.least(F.round(F.coalesce(F.max(F.when((F.col("tid") >= 0) & taken, F.when(is_base, 1.0).otherwise(F.col("share")))), F.lit(0.0)), 6), F.lit(1.0)).alias("score"),
        F.max(F.when(F.col("tid") < 0, F.col("copies"))).cast("int").alias("copies"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies", "th")


def op5_license_scans(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
