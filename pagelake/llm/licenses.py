"""License scans by diagonal voting (operator 12); DataFrame functions only.

Templates are short license notices. Every rolling four-word gram of every
document meets the positions of the templates through a join on the hash of
its first two words, where the words themselves are then compared. What is
found is gathered by diagonal (place in the document less place in the
template) as one bit for each place of the template; neighbouring diagonals
are united, so a word put in or left out doesn't end a match, and a span counts
if the grams found there cover enough of the template.

Phrases of two or three words are templates of two-word grams that must all
stand on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases of the contract and opening words of public license notices, each with its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)
TEMPLATES = [(words, label, 2) for words, label in PHRASES] + [(words, label, 4) for words, label in NOTICES]
#: The row of a document itself goes through the join like a gram, under this number.
WHOLE = len(TEMPLATES)
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def grams() -> list[tuple[int, int, int, str]]:
    """(template, place, words in the gram, gram) of all templates; their number is fixed by TEMPLATES, under 300."""
    out = [(WHOLE, 0, 4, "")]
    for number, (words, _, k) in enumerate(TEMPLATES):
        split = words.split()
        out += [(number, at, k, " ".join(split[at : at + k])) for at in range(len(split) - k + 1)]
    return out


def _template_grams(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({n}, {at}, {k}, '{gram}')" for n, at, k, gram in grams())
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, place, k, known)")
    return table.withColumn("hash", F.xxhash64(F.substring_index("known", " ", 2)))


def _rolling(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, at, gram): four words from each place on, fewer at the end, and one row with n_words and an empty gram."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.array_remove(F.split(lowered, SEPARATOR), "")

    def rolled(of: Column) -> Column:
        gram = lambda w, i: F.struct(i.cast("long").alias("at"), of["crc"].alias("crc"), F.array_join(F.slice(of["words"], i + 1, 4), " ").alias("gram"))
        own = F.struct(F.size(of["words"]).cast("long").alias("at"), of["crc"].alias("crc"), F.lit("").alias("gram"))
        return F.concat(F.array(own), F.transform(of["words"], gram))

    # Words and hash are bound once by the outer array: no place splits the text again, and no row of a place carries it.
    bound = F.array(F.struct(split.alias("words"), F.xxhash64(text).alias("crc")))
    return docs.select("doc_id", F.explode(F.flatten(F.transform(bound, rolled))).alias("g")).select("doc_id", "g.crc", "g.at", "g.gram")


def _of_template(values: list) -> Column:
    return F.array(*map(F.lit, values))[F.col("template")]


def scan(docs: DataFrame, gap: int = 3, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of docs.

    n_base counts the places of the phrases, first_word and last_word are
    their smallest and largest start (null without one). labels are those of
    the phrases and of the notices of which at least the share `least` is
    found on diagonals within `gap` words; score is the largest share found, 1
    with a phrase. Labels are distinct, sorted and joined by a comma, empty if
    there are none. A null text has no words. Repeated rows each give a row;
    rows of a null id are told apart by their text. An empty table gives no
    rows. Other columns are not read.
    """
    key = ["doc_id", "crc"]
    known = F.broadcast(_template_grams(docs.sparkSession))  # under 300 rows, whatever the corpus
    same = (F.xxhash64(F.substring_index("gram", " ", 2)) == F.col("hash")) & (F.call_function("substring_index", F.col("gram"), F.lit(" "), F.col("k")) == F.col("known"))
    met = _rolling(docs).join(known, same).select(*key, "template", (F.col("at") - F.col("place")).alias("diagonal"), "place")
    votes = met.groupBy(*key, "template", "diagonal").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("votes"), F.count("*").alias("n"))
    near = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(0, gap)
    sizes = [len(words.split()) for words, _, _ in TEMPLATES] + [1]
    merged = votes.withColumn("merged", F.bit_or("votes").over(near))
    covered = F.col("merged")
    for i in range(1, 4):
        covered = covered.bitwiseOR(F.shiftleft("merged", i))
    phrase = F.col("template") < len(PHRASES)
    own = F.col("template") == WHOLE
    full = _of_template([(1 << (n - k + 1)) - 1 for n, (_, _, k) in zip(sizes, TEMPLATES, strict=False)] + [1])
    share = F.when(phrase, (F.col("votes") == full).cast("double")).when(~own, F.bit_count(covered) / _of_template(sizes)).otherwise(0.0)
    spans = merged.withColumn("share", share)
    label = _of_template([label for _, label, _ in TEMPLATES] + [""])
    place = phrase & (F.col("share") == 1.0)
    joined = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, label))), ",")  # noqa: E731  as many as there are labels
    out = spans.groupBy(*key).agg(
        F.max(F.when(own, F.col("diagonal"))).alias("n_words"),
        F.max(F.when(own, F.col("n"))).alias("copies"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).alias("last_word"),
        joined(place).alias("base_labels"),
        joined(~own & (F.col("share") >= least)).alias("labels"),
        F.max("share").alias("score"),
    )
    each = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle_sql(gap: int = 3, least: float = 0.6) -> str:
    """The rows of scan() over documents: places by position, not by diagonals kept as bits."""
    values = ", ".join(f"({n}, {place}, {k}, '{gram}')" for n, place, k, gram in grams() if n != WHOLE)
    about = ", ".join(f"({n}, '{label}', {len(words.split())}, {len(words.split()) - k + 1}, {n < len(PHRASES)})" for n, (words, label, k) in enumerate(TEMPLATES))
    return f"""
WITH g(template, place, k, gram) AS (VALUES {values}), about(template, label, size, grams, phrase) AS (VALUES {about}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (SELECT r, i, array_to_string(w[i : i + 1], ' ') AS two, array_to_string(w[i : i + 3], ' ') AS four FROM p),
h AS (SELECT r, template, i - 1 - place AS diagonal, place FROM q JOIN g ON k = 2 AND two = gram UNION ALL SELECT r, template, i - 1 - place, place FROM q JOIN g ON k = 4 AND four = gram),
f AS (SELECT r, diagonal, label FROM h JOIN about USING (template) WHERE phrase GROUP BY r, template, diagonal, label HAVING count(DISTINCT place) = any_value(grams)),
s AS (SELECT a.r, a.template, a.diagonal, count(DISTINCT b.place + x.x) AS covered
      FROM (SELECT DISTINCT r, template, diagonal FROM h) a JOIN h b ON a.r = b.r AND a.template = b.template AND b.diagonal BETWEEN a.diagonal AND a.diagonal + {gap}, range(4) x(x) GROUP BY ALL),
v AS (SELECT r, label, covered / size AS share FROM s JOIN about USING (template) WHERE NOT phrase),
b AS (SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM f GROUP BY r),
l AS (SELECT r, array_to_string(list_sort(list(DISTINCT label) FILTER (share >= {least})), ',') AS labels, max(share) AS score FROM (SELECT r, label, 1.0::DOUBLE AS share FROM f UNION ALL SELECT r, label, share FROM v) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r)"""
