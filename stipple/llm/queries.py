"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm import heavy, leakage, packing, seen, topn, truncation
from stipple.session import load

FINGERPRINT_BITS = 64
STRID_SHARE, TILE_SHARE = 0.005, 0.03
CONTAINER = 2048
#: Beginnings of cues that are credits or adverts, a parameter of p8 and p9 for files of this kind; the operators know none.
#: In p8 such cues may stand within a passage; in p9 they end a file, which is also learned where many files have them.
CREDITS = (
    "subtitles by", "captions by", "captions at", "synced by", "synced and corrected", "ripped for", "ripped by", "encoded by", "support us", "advertise your", "to be continued",
    "end of part",
)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose strid was seen before."""
    return seen.seen_before(load(spark, d, "sbcd_recs"), load(spark, d, "seen_strids"), key="strid", record_id="rec_id", bits=FINGERPRINT_BITS)


def p2_wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    """The measured share of wrong answers with the fingerprints of p2_found and, where some can be seen, with 32 bits; a row each."""
    records, earlier = load(spark, d, "sbcd_recs"), load(spark, d, "seen_strids")
    measured = [seen.wrong_answers(records, earlier, key="strid", record_id="rec_id", bits=bits) for bits in (32, FINGERPRINT_BITS)]
    return measured[0].unionByName(measured[1])


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same records as p2_found, in two batches against an index kept between them; earlier runs are its first batch."""
    records, index = load(spark, d, "sbcd_recs"), seen.SeenIndex(spark, bits=FINGERPRINT_BITS)
    earlier = load(spark, d, "seen_strids").select("strid", F.xxhash64("strid").alias("rec_id"))
    index.probe(earlier, key="strid", record_id="rec_id")
    half = records.agg(F.percentile_approx("rec_id", 0.5)).first()[0] or 0
    first = index.probe(records.filter(F.col("rec_id") <= half), key="strid", record_id="rec_id")
    return first.unionByName(index.probe(records.filter(F.col("rec_id") > half), key="strid", record_id="rec_id"))


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_hitters(load(spark, d, "sbcd_recs"), {"strid": STRID_SHARE, "tile": TILE_SHARE})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent values of strid and tile."""
    return _heavy(spark, d).select("field", "val")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same with their exact counts."""
    return _heavy(spark, d).select("field", "val", "n", "total")


def _top_features(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "de_entries").filter((F.col("chi2") >= 0) & (F.col("chi2") < float("inf")))
    return topn.top_n(rows, F.col("factor"), F.col("feature"), F.col("chi2"), 5)


def _top_factors(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "pixel_factors").select("pix_id", F.explode(F.arrays_zip("factors", "probs")).alias("z"))
    return topn.top_n(rows, F.col("pix_id"), F.col("z.factors"), F.col("z.probs"), 2)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The features with the highest chi2 of each factor, and the factors with the highest probability of each pixel."""
    de = _top_features(spark, d).select(F.lit("de").alias("kind"), F.col("grp"), F.col("item"))
    pix = _top_factors(spark, d).select(F.lit("pix").alias("kind"), F.col("grp").cast("string").alias("grp"), F.col("item").cast("string").alias("item"))
    return de.unionByName(pix)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every subtitle file, or piece of one that is larger than a container, with its container of 2,048 tokens."""
    return packing.pack_texts(load(spark, d, "documents"), "doc_id", "text", CONTAINER)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p7_containers: every file and piece once, no container too full, few containers.

    Few is 11/9 of what any packing needs at least, by room or by pieces of more than half a container, and one.
    """
    packed = p7_containers(spark, d)
    room = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("k"), F.max("piece").alias("last"), F.count_if((F.col("n_tokens") < CONTAINER)).alias("part"))
    whole = (F.col("n") == F.col("k")) & (F.col("last") == F.col("n") - 1) & (F.col("part") <= 1)
    files = pieces.agg(F.count(F.lit(1)).alias("files"), F.count_if(~whole).alias("broken_files"))
    used = room.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count_if(F.col("n") > CONTAINER).alias("o"))
    large = packed.agg(F.count_if(F.col("n_tokens") > CONTAINER / 2).alias("l")).scalar()
    few = F.col("c") <= F.greatest(F.col("t") / CONTAINER, large) * 11 / 9 + 1
    return files.withColumns({"too_full": used.select("o").scalar(), "few": used.select(few).scalar()})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that reproduce at least 14 consecutive words of an evaluation item, or all of it."""
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"), phrases=CREDITS).select("doc_id", "item_id")


#: Letter runs in a row that count as verbatim in p8_verbatim; more than a passage's words, as apostrophes divide words.
RUNS = 20


def p8_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Those of p8_found's pairs that share RUNS runs of ASCII letters in a row as they stand; SQL finds all there are."""
    runs = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda v: F.lower(v))
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - RUNS + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, RUNS), " "))
    docs = load(spark, d, "documents").select("doc_id", runs("text").alias("w"))
    items = load(spark, d, "eval_items").select("item_id", runs("text").alias("v")).filter(F.size("v") >= RUNS)
    pairs = p8_found(spark, d).join(items, "item_id").join(docs, "doc_id").filter(F.size("w") >= RUNS)
    return pairs.filter(F.arrays_overlap(windows(F.col("w")), windows(F.col("v")))).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of files that reproduce it."""
    return leakage.leaked_items(p8_found(spark, d), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that were cut off before their end."""
    return truncation.judge(load(spark, d, "documents"), phrases=CREDITS).filter("cut").select("doc_id")


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each source were cut off, and their share."""
    return truncation.by_source(truncation.judge(load(spark, d, "documents"), phrases=CREDITS))


def p9_signs(spark: SparkSession, d: str) -> DataFrame:
    """How many files each sign decides; those that begin with 'prefix' are the prefix joins."""
    return truncation.judge(load(spark, d, "documents"), phrases=CREDITS).filter("cut").groupBy("why").agg(F.count(F.lit(1)).alias("n_files"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which the files of a source pile up, in characters (c) and bytes (b)."""
    return truncation.length_limits(load(spark, d, "documents"))


def p9_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    """The join of p9 over the names of features: how often each occurs, and longer ones that begin with it."""
    names = load(spark, d, "features").filter("name <> ''").select(F.col("name").alias("value"), F.lit(1).alias("n"))
    return truncation.occurrences(names, names)


def p9_strict_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The join of p9 over the names of features: those that are strict prefixes of others."""
    return truncation.strict_prefixes(load(spark, d, "features").select(F.col("name").alias("body"), F.array().cast("array<int>").alias("halts"))).select("value")


_ALL = (
    p2_found, p2_batches, p2_wrong_answers, p3_found, p3_counts, p6_found, p7_containers, p7_fill, p8_found, p8_verbatim, p8_leaked_items, p9_found, p9_by_source, p9_signs, p9_limits,
    p9_prefix_counts, p9_strict_prefixes,
)
QUERIES = {f.__name__: f for f in _ALL}

_P3 = """
WITH r AS (SELECT 'strid' AS field, strid AS val, 0.005 AS share FROM sbcd_recs UNION ALL SELECT 'tile', CAST(tile AS VARCHAR), 0.03 FROM sbcd_recs),
t AS (SELECT count(*) AS total FROM sbcd_recs), c AS (SELECT field, val, count(*) AS n, any_value(share) AS share FROM r WHERE val IS NOT NULL GROUP BY field, val)
"""

ORACLES = {
    "p2_found": """
SELECT rec_id FROM (SELECT rec_id, strid, min(rec_id) OVER (PARTITION BY strid) AS first FROM sbcd_recs WHERE strid IS NOT NULL)
WHERE rec_id > first OR strid IN (SELECT strid FROM seen_strids)""",
    "p2_wrong_answers": """
SELECT bits, (SELECT count(*) FROM sbcd_recs) AS records, (SELECT count(DISTINCT strid) FROM sbcd_recs WHERE strid NOT IN (SELECT strid FROM seen_strids)) AS new_keys,
0::BIGINT AS wrong, 0.0::DOUBLE AS wrong_rate FROM (VALUES (32), (64)) t(bits)""",
    "p7_fill": "SELECT count(*) AS files, 0::BIGINT AS broken_files, 0::BIGINT AS too_full, true AS few FROM documents",
    "p8_verbatim": """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda v: lower(v)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda v: lower(v)) AS v FROM eval_items WHERE text IS NOT NULL),
a AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda k: list_aggregate(w[k:k + 19], 'string_agg', ' '))) AS s FROM d WHERE len(w) >= 20),
b AS (SELECT item_id, unnest(list_transform(range(1, len(v) - 18), lambda k: list_aggregate(v[k:k + 19], 'string_agg', ' '))) AS s FROM i WHERE len(v) >= 20)
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (s)""",
    "p9_limits": """
WITH f AS (SELECT DISTINCT source, text FROM documents WHERE regexp_matches(text, '\\S')), n AS (SELECT source, length(rtrim(text, chr(13) || chr(10))) AS c, strlen(rtrim(text, chr(13) || chr(10))) AS b FROM f),
l AS (SELECT source, 'c' AS unit, c AS n, count(*) AS files FROM n GROUP BY ALL UNION ALL SELECT source, 'b', b, count(*) FROM n GROUP BY ALL), m AS (SELECT *, n // 40 AS k FROM l),
s AS (SELECT source, unit, k, sum(files) AS t FROM m GROUP BY ALL)
SELECT m.source, m.unit, m.n FROM m JOIN s ON m.source = s.source AND m.unit = s.unit AND s.k BETWEEN m.k - 1 AND m.k + 1
GROUP BY m.source, m.unit, m.n, m.files HAVING m.files >= 4 AND m.files >= 8 * ((sum(s.t) - m.files) / 120.0 + 0.2) AND m.n >= 100""",
    "p9_prefix_counts": """
WITH f AS (SELECT name AS value FROM features WHERE name <> '')
SELECT a.value, CAST(count_if(b.value = a.value) AS BIGINT) AS total, CAST(count_if(b.value <> a.value) AS BIGINT) AS longer FROM (SELECT DISTINCT value FROM f) a JOIN f b ON starts_with(b.value, a.value) GROUP BY a.value""",
    "p9_strict_prefixes": "SELECT DISTINCT a.name AS value FROM features a JOIN features b ON b.name <> a.name AND starts_with(b.name, a.name) WHERE a.name <> ''",
    "p3_found": _P3 + "SELECT field, val FROM c, t WHERE n >= share * total",
    "p3_counts": _P3 + "SELECT field, val, n, total FROM c, t WHERE n >= share * total",
    "p6_found": """
WITH d AS (SELECT factor, feature, max(chi2) AS s FROM de_entries WHERE factor IS NOT NULL AND feature IS NOT NULL AND chi2 >= 0 AND chi2 < 'inf'::DOUBLE GROUP BY ALL),
z AS (SELECT pix_id, unnest(factors) AS f, unnest(probs) AS p FROM pixel_factors),
q AS (SELECT pix_id, f, max(p) AS s FROM z WHERE f IS NOT NULL AND p IS NOT NULL AND NOT isnan(p) GROUP BY ALL)
SELECT 'de' AS kind, factor AS grp, feature AS item FROM d QUALIFY row_number() OVER (PARTITION BY factor ORDER BY s DESC, feature) <= 5
UNION ALL SELECT 'pix', CAST(pix_id AS VARCHAR), CAST(f AS VARCHAR) FROM q QUALIFY row_number() OVER (PARTITION BY pix_id ORDER BY s DESC, f) <= 2""",
}
ORACLES["p2_batches"] = ORACLES["p2_found"]
