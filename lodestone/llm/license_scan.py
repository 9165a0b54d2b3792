"""Licence scan: sparse TF-IDF cosine to templates, then inheritance down the directories.

Every line of a file is compared as a header, and the whole file as a licence file. Words
that no template has weigh as much as a word no file has, so they lower the cosine without
being counted over the corpus. Only lines with a telling word are taken apart: without one,
the cosine to any template stays below the threshold. A file without a licence of its own
takes that of the nearest directory above it that holds a licence file. DataFrame functions
do all of the work.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, table

# Usual statements of the licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "Proprietary": ("All rights reserved.",),
}
THRESHOLD = 0.6

_BREAK = "[^a-z0-9]+"


def _words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")


def _statements(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, str, dict[str, int]]]:
    """Licence, name and word counts of each template."""
    out = []
    for licence, texts in sorted(templates.items()):
        for number, text in enumerate(texts):
            words = [w for w in re.split(_BREAK, text.lower()) if w]
            out.append((licence, f"{licence}#{number}", {w: words.count(w) for w in set(words)}))
    return out


def telling_words(statements, idf: dict[str, float], threshold: float) -> set[str]:
    """Words without any of which the cosine to every template is below the threshold.

    For each template its lightest words are left out as long as their part of its length
    is under the threshold: by Cauchy-Schwarz they can't reach it by themselves.
    """
    telling: set[str] = set()
    for _, _, counts in statements:
        weights = sorted((n * idf[w], w) for w, n in counts.items())
        limit, used = threshold**2 * sum(v * v for v, _ in weights) * (1 - 1e-9), 0.0
        for value, word in weights:
            used += value * value
            if used >= limit:
                telling.add(word)
    return telling


def inverse_frequencies(texts: DataFrame, text: str, words: list[str]) -> tuple[dict[str, float], float]:
    """ln((N + 1) / (n + 1)) + 1 over all texts, for each template word and for unknown words."""
    own = F.array_intersect(_words(F.col(text)), F.array(*[F.lit(w) for w in words]))
    counts = dict(texts.select(F.explode(own).alias("w")).groupBy("w").count().collect())
    rows = texts.count()
    return {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) + 1 for w in words}, math.log(rows + 1) + 1


def cosines(parts: DataFrame, keys: list[str], statements, idf: dict[str, float], unknown: float) -> DataFrame:
    """``keys, licence, score``: the best template of each part (keys, words) that shares a word."""
    spark = parts.sparkSession
    weight = spark.createDataFrame(
        [
            (word, licence, name, n * idf[word] ** 2 / math.sqrt(sum((k * idf[w]) ** 2 for w, k in counts.items())))
            for licence, name, counts in statements for word, n in counts.items()
        ],
        "word string, licence string, name string, weight double",
    )
    rarity = spark.createDataFrame(list(idf.items()), "word string, idf double")
    counted = parts.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(
        F.count(F.lit(1)).alias("n")
    )
    # Both small tables are made of the templates alone, whatever the corpus.
    weighed = counted.join(F.broadcast(rarity), "word", "left").withColumn(
        "own", F.col("n") * F.coalesce("idf", F.lit(unknown))
    )
    lengths = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("length"))
    dots = counted.join(F.broadcast(weight), "word").groupBy(*keys, "licence", "name").agg(
        F.sum(F.col("n") * F.col("weight")).alias("dot")
    )
    scored = dots.join(lengths, keys).withColumn("score", F.round(F.col("dot") / F.col("length"), 6))
    best = F.max(F.struct("score", F.col("licence").alias("licence"))).alias("best")
    return scored.groupBy(*keys).agg(best).select(*keys, "best.licence", "best.score")


def scan(
    files: DataFrame,
    *,
    path: str = "path",
    text: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``files`` with ``licence, licence_score, licence_from, licence_directory``.

    ``licence_from`` is "header" (best line), "file" (the whole text is a licence text),
    "directory" (inherited from ``licence_directory``) or "none". Equal scores go to the
    licence that is last by name; of several licence files in a directory the best score wins.
    Null and empty texts have no licence of their own, a null path inherits nothing; rows that
    repeat a path are judged one by one. An empty table gives no rows. Columns of the input
    with these names are replaced.
    """
    spark = files.sparkSession
    space = Workspace(spark, "licences")
    added = ["licence", "licence_score", "licence_from", "licence_directory"]
    plain = files.drop(*added)
    names = [f"c{i}" for i in range(len(plain.columns))]
    at, body = (names[plain.columns.index(c)] for c in (path, text))
    rows = plain.toDF(*names)
    statements = _statements(templates)
    words = sorted({w for _, _, counts in statements for w in counts})
    idf, unknown = inverse_frequencies(rows.select(body), body, words)
    telling = sorted(telling_words(statements, idf, threshold))
    pattern = f"(?i)(^|[^a-z0-9])({'|'.join(telling)})($|[^a-z0-9])"
    tagged = rows.withColumns(
        {"_row": F.monotonically_increasing_id(), "_able": F.coalesce(F.col(body).rlike(pattern), F.lit(False))}
    )
    # Row numbers are used on both sides of joins, so they are written once.
    able = space.write("able", tagged.filter("_able").select("_row", F.col(body).alias("text")))
    every = space.write("every", tagged.drop("_able"))
    lines = able.select("_row", F.posexplode(F.split("text", "\n")).alias("line", "part")).filter(
        F.col("part").rlike(pattern)
    )
    best = F.max(F.struct("score", "licence")).alias("best")
    headers = (
        cosines(lines.select("_row", "line", _words(F.col("part")).alias("words")), ["_row", "line"],
                statements, idf, unknown)
        .filter(F.col("score") >= threshold).groupBy("_row").agg(best)
        .select("_row", F.col("best.licence").alias("header"), F.col("best.score").alias("header_score"))
    )
    whole = (
        cosines(able.select("_row", _words(F.col("text")).alias("words")), ["_row"], statements, idf, unknown)
        .filter(F.col("score") >= threshold)
        .select("_row", F.col("licence").alias("file"), F.col("score").alias("file_score"))
    )
    own = space.write("own", headers.join(whole, "_row", "full"))
    directory = F.regexp_replace(at, "/?[^/]*$", "")
    placed = every.withColumn("_dir", directory)
    # One row per directory with licence files, and one per directory that has any files: a
    # directory with many files is one row in the joins up the tree.
    holders = (
        placed.select("_row", "_dir").filter(F.col("_dir").isNotNull())
        .join(own.filter(F.col("file").isNotNull()), "_row")
        .groupBy("_dir").agg(F.max(F.struct(F.col("file_score").alias("score"), F.col("file").alias("licence"))).alias("best"))
    )
    steps = F.split("_dir", "/")
    above = placed.select("_dir").filter(F.col("_dir").isNotNull()).distinct().select(
        "_dir",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(steps)),
                lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")),
            )
        ).alias("a"),
    )
    nearest = (
        above.select("_dir", "a.depth", "a.up")
        .join(holders.withColumnRenamed("_dir", "up"), "up")
        .groupBy("_dir").agg(F.max(F.struct("depth", "up", "best")).alias("near"))
        .select("_dir", F.col("near.best.licence").alias("inherited"), F.col("near.up").alias("_up"))
    )
    nearest = space.write("nearest", nearest)
    joined = placed.join(own, "_row", "left").join(nearest, "_dir", "left")
    by_file = F.col("file").isNotNull() & (F.col("header").isNull() | (F.col("file_score") >= F.col("header_score")))
    result = joined.withColumns(
        {
            "licence": F.coalesce(F.when(by_file, F.col("file")), "header", "inherited"),
            "licence_score": F.coalesce(F.when(by_file, F.col("file_score")), "header_score"),
            "licence_from": F.when(by_file, "file").when(F.col("header").isNotNull(), "header")
            .when(F.col("inherited").isNotNull(), "directory").otherwise("none"),
            "licence_directory": F.when(F.col("header").isNull() & F.col("file").isNull(), F.col("_up")),
        }
    )
    return result.select(*names, *added).toDF(*plain.columns, *added)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all of ``documents``; a document's path is source/lang/hundred/doc_id."""
    piece = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang")]
    hundred = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_"))
    path = F.concat_ws("/", *piece, hundred, F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return scan(files).drop("text")


def _sql_list(values) -> str:
    return ", ".join(f"({', '.join(repr(v) if isinstance(v, str) else str(v) for v in row)})" for row in values)


OP1_SQL = f"""
WITH template(licence, name, word, n) AS (VALUES {_sql_list(
    [(licence, name, w, n) for licence, name, counts in _statements(TEMPLATES) for w, n in sorted(counts.items())])}),
file AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path,
    concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR)) AS dir, source, source || '/' || lang AS two,
    coalesce(text, '') AS text FROM documents
), total AS (SELECT count(*) AS rows FROM documents),
seen AS (
  SELECT word, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM file)
  WHERE word IN (SELECT word FROM template) GROUP BY word
), idf AS (
  SELECT word, ln((rows + 1) / (coalesce(seen.n, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT word FROM template) LEFT JOIN seen USING (word), total
), norm AS (SELECT name, sqrt(sum(pow(n * idf, 2))) AS length FROM template JOIN idf USING (word) GROUP BY name),
part AS (
  SELECT doc_id, line, unnest(regexp_split_to_array(lower(part), '[^a-z0-9]+')) AS word FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS line
    FROM file UNION ALL SELECT doc_id, text, 0 FROM file)
), counted AS (SELECT doc_id, line, word, count(*) AS n FROM part WHERE word <> '' GROUP BY ALL),
length AS (
  SELECT doc_id, line, sqrt(sum(pow(n * coalesce(idf, ln(rows + 1) + 1), 2))) AS length
  FROM counted LEFT JOIN idf USING (word), total GROUP BY ALL
), dot AS (
  SELECT c.doc_id, c.line, t.licence, t.name, sum(c.n * t.n * pow(idf, 2) / norm.length) AS dot
  FROM counted c JOIN template t USING (word) JOIN idf USING (word) JOIN norm USING (name) GROUP BY ALL
), scored AS (
  SELECT doc_id, line, licence, round(dot / length, 6) AS score FROM dot JOIN length USING (doc_id, line)
), hit AS (SELECT * FROM scored WHERE score >= {THRESHOLD}),
header AS (SELECT doc_id, max(struct_pack(score, licence)) AS h FROM hit WHERE line > 0 GROUP BY doc_id),
whole AS (SELECT doc_id, max(struct_pack(score, licence)) AS w FROM hit WHERE line = 0 GROUP BY doc_id),
holder AS (SELECT dir, max(w) AS w FROM file JOIN whole USING (doc_id) GROUP BY dir),
joined AS (
  SELECT doc_id, path, h, whole.w AS w, holder.w AS up, holder.dir AS up_dir FROM file LEFT JOIN header USING (doc_id)
  LEFT JOIN whole USING (doc_id) LEFT JOIN holder ON holder.dir = file.dir
)
SELECT doc_id, path,
  CASE WHEN w IS NOT NULL AND (h IS NULL OR w.score >= h.score) THEN w.licence
    ELSE coalesce(h.licence, up.licence) END AS licence,
  CASE WHEN w IS NOT NULL AND (h IS NULL OR w.score >= h.score) THEN w.score ELSE h.score END AS licence_score,
  CASE WHEN w IS NOT NULL AND (h IS NULL OR w.score >= h.score) THEN 'file' WHEN h IS NOT NULL THEN 'header'
    WHEN up IS NOT NULL THEN 'directory' ELSE 'none' END AS licence_from,
  CASE WHEN w IS NULL AND h IS NULL THEN up_dir END AS licence_directory
FROM joined
"""
