"""License scans with native expressions: MinHash bands retrieve, exact containment verifies.

Words are lower-cased runs of a-z and 0-9; shingles are WORDS words. A template
of m shingles belongs to the class of the least power of two s >= m, and texts
are read in windows of 2 s shingles at every s-th, so that some window holds
any s shingles in a row. A window that contains CONTAINMENT of a template has
a Jaccard similarity to it of at least ``similarity()``; with bands of one
minimum each, ``bands()`` of them miss such a window with a probability of at
most MISS. Windows without any template shingle cannot share a minimum with a
template, so a join on the shingles comes first, and only windows over its
places get a signature; it changes the work, not what the bands retrieve. What
they retrieve is kept if the window holds CONTAINMENT of the template's
shingles, counted exactly.

Templates are a parameter, and their shingles and minima are sent to the tasks
as tables: at most TEMPLATE_SHINGLES of them, checked.

Null and empty texts, and texts of fewer than WORDS words, match nothing; texts
without a match, and an empty table, have no row. A very long text is read whole,
its windows one by one. Equally good windows are all counted, the first is
reported. Rows of one doc_id are reported together, repeated rows once. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch
from .license_templates import TEMPLATES
from .quality import let

WORDS = 5
CONTAINMENT = 0.75
MISS = 1e-4
TEMPLATE_SHINGLES = 100_000


def similarity() -> float:
    """The least Jaccard similarity of a template of m > s / 2 shingles and a window of 2 s that contains enough of it."""
    return CONTAINMENT / 2 / (2 + (1 - CONTAINMENT) / 2)


def bands() -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity()))


def size_class(shingles: int) -> int:
    return 1 << max(0, (shingles - 1).bit_length())


def shingles(text: Column) -> Column:
    """The hashes of a text's shingles, in order."""
    plain = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WORDS))))
    return let(F.split(plain, " "), lambda w: F.when(F.size(w) >= WORDS, hashes(w)).otherwise(F.array().cast("array<bigint>")))


def _signature(window: Column, n: int) -> Column:
    """(band, minimum) of a window, for every band."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(window, lambda x: F.xxhash64(x, j))).alias("least")))


def _windows(all_: Column, hits: Column, classes: list[int]) -> Column:
    """The windows over the places in hits: class, start and shingles of each, once."""
    at = lambda i: F.array(*(F.struct(F.lit(s).alias("s"), F.greatest(F.lit(0), (F.floor(i / s).cast("int") - back) * s).alias("start")) for s in classes for back in (0, 1)))
    places = F.array_distinct(F.flatten(F.transform(hits, at)))
    return F.transform(places, lambda x: F.struct(x["s"].alias("s"), x["start"].alias("start"), F.slice(all_, x["start"] + 1, 2 * x["s"]).alias("window")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, containment, first_word and n_windows, for each document and each template it contains."""
    spark, templates = docs.sparkSession, templates or TEMPLATES
    n_words = {k: max(0, len(re.findall("[a-z0-9]+", v.lower())) - WORDS + 1) for k, v in templates.items()}
    if sum(n_words.values()) > TEMPLATE_SHINGLES:
        raise ValueError("scan the templates in parts: too many shingles to send to every task")
    if short := [k for k, n in n_words.items() if not n]:
        raise ValueError(f"templates of fewer than {WORDS} words: {short}")
    known = spark.createDataFrame(list(templates.items()), "template string, body string").select("template", F.array_distinct(shingles(F.col("body"))).alias("needed"))
    rows = known.collect()  # at most TEMPLATE_SHINGLES numbers
    sizes = {r.template: size_class(len(r.needed)) for r in rows}
    every = spark.createDataFrame([(x,) for x in sorted({x for r in rows for x in r.needed})], "shingle long")
    n = bands()
    wanted = spark.createDataFrame([(r.template, r.template.split("/")[0], sizes[r.template], r.needed) for r in rows], "template string, license string, s int, needed array<bigint>")
    minima = wanted.select("template", "license", "s", "needed", F.explode(_signature(F.col("needed"), n)).alias("m")).select("template", "license", "s", "needed", "m.*")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    key = F.xxhash64("doc_id", "text")  # two rows of one key only get each other's places, too
    places = read.select(key.alias("key"), F.posexplode(shingles(F.col("text"))).alias("at", "shingle")).join(F.broadcast(every), "shingle")
    scratch = Scratch(spark, "licenses")
    places = scratch.write(places.groupBy("key").agg(F.collect_set("at").alias("hits")), "places")
    found = places.count()
    some = read.withColumn("key", key).join(F.broadcast(places) if found <= BROADCAST_ROWS // 4 else places, "key")
    some = some.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), shingles(F.col("text")).alias("all"), "hits")
    seen = some.select("doc_id", "digest", F.explode(_windows(F.col("all"), F.col("hits"), sorted(set(sizes.values())))).alias("w")).select("doc_id", "digest", "w.*")
    signed = seen.select("doc_id", "digest", "s", "start", "window", F.explode(_signature(F.col("window"), n)).alias("m")).select("doc_id", "digest", "s", "start", "window", "m.*")
    found = signed.join(F.broadcast(minima), ["s", "band", "least"]).dropDuplicates(["doc_id", "digest", "s", "start", "template"])
    share = F.size(F.array_intersect("window", "needed")) / F.size("needed")
    first = F.array_position(F.transform("window", lambda x: F.array_contains("needed", x)), True)
    checked = found.withColumn("containment", share).filter(F.col("containment") >= CONTAINMENT).withColumn("first_word", F.col("start") + first - 1)
    return checked.groupBy("doc_id", "license", "template").agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"), F.count("*").alias("n_windows"))


def from_folder(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from files named by SPDX identifier, for whole bodies of long licences."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()  # as many as scan() takes
    return {f"{r.name.removesuffix('.txt')}/body": r.value for r in rows}


def sql(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for the rows of scan(), by exact containment in all windows."""
    cut = lambda x: f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    gram = f"array_to_string(ws[i : i + {WORDS - 1}], ' ')"
    rows = ", ".join("('{}', '{}', {}, '{}')".format(k, k.split("/")[0], size_class(_distinct(v)), v.replace("'", "''")) for k, v in (templates or TEMPLATES).items())
    return f"""
WITH t(template, license, s, body) AS (VALUES {rows}),
need AS (SELECT DISTINCT template, license, s, {gram} AS gram FROM (SELECT template, license, s, ws, unnest(range(1, len(ws) - {WORDS - 2})) AS i FROM (SELECT *, {cut("body")} AS ws FROM t))),
size AS (SELECT template, count(*) AS m FROM need GROUP BY template),
g AS (SELECT doc_id, i - 1 AS p, {gram} AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WORDS - 2})) AS i FROM (SELECT doc_id, {cut("text")} AS ws FROM documents) WHERE len(ws) >= {WORDS})),
h AS (SELECT doc_id, p, gram, template, license, s, unnest([p // s * s, (p // s - 1) * s]) AS start FROM g JOIN need USING (gram)),
w AS (SELECT doc_id, license, template, start, count(DISTINCT gram) AS k, min(p) AS first FROM h WHERE start >= 0 GROUP BY ALL)
SELECT doc_id, license, template, max(k / m) AS containment, CAST(min(first) AS BIGINT) AS first_word, count(*) AS n_windows
FROM w JOIN size USING (template) WHERE k >= {CONTAINMENT} * m GROUP BY doc_id, license, template
"""


def _distinct(body: str) -> int:
    w = re.findall("[a-z0-9]+", body.lower())
    return len({tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)})
