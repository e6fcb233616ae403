"""License scans: phrase places, and notice templates found by an exact set-similarity join. DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import ascii_lower, read

#: The phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The notices that a text block is held against, and their labels.
TEMPLATES = {
    "released under the mit license": "mit-notice",
    "licensed under the apache license version 2.0": "apache-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "licensed under cc by-nc 4.0": "cc-by-nc-notice",
    "all rights reserved": "rights-reserved-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "this program is free software you can redistribute it and or modify it": "gpl-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-clause",
    "you may not use this file except in compliance with the license": "apache-terms",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
}
THRESHOLD = 0.8
#: A template list with more prefix entries than this is joined by shuffling, not by broadcasting.
MOST_BROADCAST = 10_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(low: Column) -> Column:
    """The words of a lower-cased text: runs of digits, a-z and all that is not ASCII."""
    return F.array_remove(F.split(low, _GAP), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(words: Column, phrase: str) -> Column:
    """Indexes (from 0) at which the phrase's words stand one after another."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def at(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit &= F.get(words, i + k) == p
        return hit

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<int>"))


def phrase_places(low: Column, phrases: Mapping[str, str]) -> Column:
    """Struct n_words, n_base, first_word, last_word, base (labels): places of the phrases in a lower-cased text.

    The places are looked for only in texts that hold the last word of some phrase.
    """
    likely = F.lit(False)
    for last in sorted({p.split(" ")[-1] for p in phrases}):
        likely |= low.contains(last)

    def full(w: Column) -> Column:
        hits = F.transform(F.array(*(F.struct(F.lit(label).alias("label"), _starts(w, p).alias("at")) for p, label in phrases.items())), lambda x: x)
        return _let(F.filter(hits, lambda h: F.size(h["at"]) > 0), lambda h: _let(F.flatten(F.transform(h, lambda x: x["at"])), lambda a: F.struct(F.size(w).cast("long").alias("n_words"), F.size(a).cast("long").alias("n_base"), F.array_min(a).cast("long").alias("first_word"), F.array_max(a).cast("long").alias("last_word"), F.array_distinct(F.transform(h, lambda x: x["label"])).alias("base"))))

    none = F.struct(F.size(words_of(low)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base"))
    return F.when(likely, _let(words_of(low), full)).otherwise(none) if phrases else none


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(_GAP, text.lower()) if w]


def _bounds(words: list[str], threshold: float) -> tuple[int, int, int]:
    """Of a template: how many distinct words it has, how many of them a block must hold, and how many words a block has."""
    n = len(set(words))
    return n, max(1, math.ceil(threshold * n - 1e-9)), math.ceil(len(words) / threshold - 1e-9)


def template_matches(texts: DataFrame, keys: list[str], templates: Mapping[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(keys, label, containment) where a block of `texts` (keys, low) holds at least `threshold` of a template's distinct words; once for
    each place that leads to one.

    A block is any run of as many words as the template has, divided by the threshold, wherever lines break; at the text's end it may be
    shorter. Words that no template has cannot add to an overlap. Those of the templates are ordered by how often they stand in the
    texts, rarest first; that table is as long as the templates' vocabulary and goes through the driver. A template's prefix is as many
    of its rarest words as it may miss, and one: a block that reaches the threshold holds one of them. So only places of prefix words
    are looked at, each with the words about it. A block and a template are met at the rarest word they share: what is rarer does not
    count there, and enough must be left (positional filter); what stands about the place must be enough at all (length filter). Then
    every block over the place is counted. The index of prefixes is broadcast only while it has at most MOST_BROADCAST entries.
    """
    said = {t: ws for t in templates if (ws := _template_words(t))}
    spark = texts.sparkSession
    if not said:
        return texts.select(*keys, F.lit("").alias("label"), F.lit(0.0).alias("containment")).where("false")
    vocabulary = sorted({w for ws in said.values() for w in ws})
    held = texts.select(F.explode(F.filter(words_of(F.col("low")), lambda w: w.isin(*vocabulary))).alias("word"))
    frequency = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index, reach, least = [], 0, len(vocabulary)
    for t, ws in said.items():
        n, need, block = _bounds(ws, threshold)
        ranks = sorted({rank[w] for w in ws})
        reach, least = max(reach, block), min(least, need)
        index += [(r, n, need, block, templates[t], ranks[i:]) for i, r in enumerate(ranks[: n - need + 1])]
    prefixes = spark.createDataFrame(index, "rank int, n int, need int, size int, label string, left array<int>")
    prefixes = F.broadcast(prefixes) if len(index) <= MOST_BROADCAST else prefixes
    first = [w for w in vocabulary if any(e[0] == rank[w] for e in index)]
    ranks_by_word = F.create_map(*(F.lit(v) for w in vocabulary for v in (w, rank[w])))
    ranked = lambda w: F.when(w.isin(*vocabulary), F.try_element_at(ranks_by_word, w)).otherwise(F.lit(-1))
    begin = lambda i: F.greatest(i - (reach - 1), F.lit(0))

    def place(ws: Column) -> Callable[[Column, Column], Column]:
        about = lambda i: F.transform(F.slice(ws, begin(i) + 1, F.lit(2 * reach - 1)), ranked)
        return lambda w, i: F.when(w.isin(*first), _let(about(i), lambda near: F.when(F.size(F.array_except(near, F.array(F.lit(-1)))) >= least, F.struct(F.try_element_at(ranks_by_word, w).alias("rank"), (i - begin(i)).alias("at"), near.alias("near")))))

    found = _let(words_of(F.col("low")), lambda ws: F.filter(F.transform(ws, place(ws)), lambda p: p.isNotNull()))
    probes = texts.select(*keys, F.explode(found).alias("p")).select(*keys, "p.*")
    near = probes.join(prefixes, "rank").where(F.size(F.array_intersect("near", "left")) >= F.col("need"))
    starts = F.filter(F.sequence(F.lit(0), F.col("at")), lambda o: (o + F.col("size") > F.col("at")) & F.array_contains("left", F.get("near", o)))
    best = F.array_max(F.transform(starts, lambda o: F.size(F.array_intersect(F.slice(F.col("near"), o + 1, F.col("size")), F.col("left")))))
    counted = near.select(*keys, "label", "n", "need", F.explode(F.array(best)).alias("best"))
    return counted.where("best >= need").select(*keys, "label", (F.col("best") / F.col("n")).alias("containment"))


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document.

    Words are those of the whole text with A-Z lower-cased. `labels` adds the labels of the templates that some block, a run of
    words, reaches. The score is 1 where a phrase stands, else the largest containment that reaches the threshold, else 0. Null texts are
    empty. Repeated rows are each answered; rows with one doc_id and different texts are kept apart. Other columns are not
    read. Without phrases, templates or rows there are no places, labels or rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    keyed = rows.select("doc_id", F.xxhash64("low").alias("text_key"), "low")
    matched = template_matches(keyed, ["doc_id", "text_key"], templates, threshold)
    found = matched.groupBy(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = keyed.select("doc_id", "text_key", F.explode(F.array(phrase_places(F.col("low"), phrases))).alias("p")).select("doc_id", "text_key", "p.*")
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
    text = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    every = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(every).alias("labels"), score.alias("score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def _sql() -> str:
    gap = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = ", ".join(
        "list_transform(list_filter(range(0, greatest(len(w) - {k}, 0)), lambda i: {cond}), lambda i: {{'l': '{label}', 'i': i}})".format(k=len(p.split()) - 1, label=label, cond=" and ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())))
        for p, label in PHRASES.items()
    )
    notices = ", ".join(f"('{label}', {sorted(set(ws))!r}, {n}, {need}, {block})" for t, label in TEMPLATES.items() for ws in [_template_words(t)] for n, need, block in [_bounds(ws, THRESHOLD)])
    return f"""
with d as (select row_number() over () as r, doc_id, {low} as low from documents),
w as (select r, doc_id, low, regexp_extract_all(low, {gap}) as w from d),
h as (select r, doc_id, w, flatten([{hits}]) as h from w),
t(label, words, n, need, size) as (values {notices}),
tw as (select label, n, need, size, unnest(words) as word from t),
x as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from w),
b as (select r, label, n, need, count(distinct word) over (partition by r, label order by i range between current row and size - 1 following) as c from x join tw using (word)),
m as (select r, label, max(c::double / n) as c from b where c >= need group by all),
f as (select r, list(label) as found, max(c) as best from m group by r)
select doc_id, len(w)::bigint as n_words, len(h)::bigint as n_base,
  list_min(list_transform(h, lambda x: x.i))::bigint as first_word, list_max(list_transform(h, lambda x: x.i))::bigint as last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(h, lambda x: x.l))), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(h, lambda x: x.l), coalesce(found, [])))), ','), '') as labels,
  case when len(h) > 0 then 1.0::double else coalesce(best, 0)::double end as score
from h left join f using (r)
"""


OP7_SQL = _sql()
