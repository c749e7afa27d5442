"""Quality rules: Jensen-Shannon distance of a document's histograms to language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise, words_of

#: Frequent function words of each language.
COMMON = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero",
}
#: In turns by rank, so that a search in order ends early on frequent words.
LISTED = tuple(dict.fromkeys(w for ranked in zip(*(x.split() for x in COMMON.values()), strict=False) for w in ranked))
CODES = [chr(33 + i) for i in range(94)]
SYMBOLS = r"#*$%&|<>"
#: Character classes counted by pattern; what no class holds, lower-case letters above all, is the last.
CLASSES = (r"\x20\x09-\x0D", SYMBOLS, r"\p{Lu}", r"\p{Nd}", r".,;:?'\"()\-", "!")
LEAST_WORDS, REPEATED_PERCENT = 50, 50


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, wherever ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def count_class(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]++", ""))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words covered by windows that the text has twice or more.

    Hashes of the windows, with the places in their low bits, are sorted; those beside an equal hash
    are then compared as texts, so the count is exact. n log n in one row, no shuffle. A text of 2 ** 24
    words or more has 31 bits for places, which leaves fewer for hashes and more to compare.
    """
    return F.when(F.size(words) < 1 << 24, windows_twice(words, width, 24)).otherwise(windows_twice(words, width, 31))


def windows_twice(words: Column, width: int, low: int) -> Column:
    """``repeated_words`` with ``low`` bits for a place."""
    twice = lambda at, same: lambda x, k: F.coalesce(same(x, at(k - 1)), F.lit(False)) | F.coalesce(same(x, at(k + 1)), F.lit(False))

    def of(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.shiftleft(F.xxhash64(*(F.get(w, i + k) for k in range(width))), low).bitwiseOR(i.cast("long")))
        near = lambda s: F.filter(s, twice(lambda k: F.get(s, k), lambda x, y: F.shiftright(x, low) == F.shiftright(y, low)))

        def windows(kept: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.lit((1 << low) - 1)).cast("int")
            return F.transform(kept, lambda x: F.struct(F.concat_ws(" ", *(F.get(w, place(x) + k) for k in range(width))).alias("w"), place(x).alias("i")))

        def covered(s: Column) -> Column:
            same = F.filter(s, twice(lambda k: F.get(s, k)["w"], lambda x, y: x["w"] == y))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(*(x["i"] + k for k in range(width)))))))

        exact = lambda kept: F.when(F.size(kept) == 0, 0).otherwise(let(F.sort_array(windows(kept)), covered))
        return F.when(F.size(w) < width + 1, 0).otherwise(let(F.sort_array(keys), lambda s: let(near(s), exact)))

    return let(words, of).cast("long")


def word_codes(words: Column) -> Column:
    """One character for each common word of a text, in order; counts of a word are then counts of its character."""
    table = F.create_map(*(F.lit(x) for w, code in zip(LISTED, CODES, strict=False) for x in (w, code)))
    written = sorted({*LISTED, *map(str.capitalize, LISTED)})
    return F.array_join(F.transform(F.filter(words, lambda w: w.isin(*written)), lambda w: F.element_at(table, F.lower(w))), "")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms that sum to one."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) / 2
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), F.lit(0.0), lambda s, x: s + x)))


def measured(docs: DataFrame) -> DataFrame:
    """A slim row a document: base counts and the two histograms."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counted = split.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"),
        F.array(*(count_class(F.col("text"), c).cast("long") for c in CLASSES)).alias("classes"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), word_codes(F.col("words")).alias("codes"),
    )
    rest = F.col("n_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    common = F.array(*(F.length("codes") - F.length(F.replace("codes", F.lit(code), F.lit(""))) for code in CODES[: len(LISTED)]))
    return counted.select("doc_id", "lang", "n_words", (F.col("n_chars") - F.get("classes", F.lit(0))).alias("word_chars"), F.get("classes", F.lit(1)).alias("n_symbols"), "n_dup_lines", "n_repeat_words", "n_chars", F.concat("classes", F.array(rest)).alias("classes"), common.cast("array<long>").alias("common"), F.length("codes").cast("long").alias("n_common"))


def divergence_rules(docs: DataFrame, most_class: float = 0.26, some_class: float = 0.115, some_common: float = 0.25, least_words: int = 100) -> DataFrame:
    """Base counts, base_failed, both distances and kept, a row a document.

    References are the mean histograms of all documents of a language that pass the base rules and
    have ``least_words`` words; a document is held to the nearest reference of the known languages,
    its own if its lang is one of them. A class distance over ``most_class`` fails a document; one over
    ``some_class`` does if the common words also differ by ``some_common``. Below ``least_words`` that
    second limit rises, as the histograms of short texts say little.

    Null text: no words, base_failed, not kept. Null or unknown lang: the nearest reference. A corpus
    without references keeps what passes the base rules. Repeated rows count as they come. Empty
    table: no rows. Other columns are ignored.
    """
    rows = materialise(measured(docs), "rules")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    p_class = F.transform("classes", lambda x: x / F.greatest("n_chars", F.lit(1)))
    p_common = F.transform(F.concat("common", F.array(F.col("n_words") - F.col("n_common"))), lambda x: x / F.greatest("n_words", F.lit(1)))
    rows = rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), p_class.alias("p_class"), p_common.alias("p_common"))
    n_class, n_common = len(CLASSES) + 1, len(LISTED) + 1
    means = [F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in (("p_class", n_class), ("p_common", n_common)) for i in range(n)]
    found = rows.where(~F.col("base_failed") & (F.col("n_words") >= least_words) & F.col("lang").isin(*COMMON)).groupBy("lang").agg(*means).collect()  # a row a known language
    refs = {r.lang: [F.array(*(F.lit(float(r[f"{c}{i}"])) for i in range(n))) for c, n in (("p_class", n_class), ("p_common", n_common))] for r in sorted(found, key=lambda r: r.lang)}

    def nearest(column: str, at: int) -> Column:
        if not refs:
            return F.lit(0.0)
        by = {lang: distance(F.col(column), ref[at]) for lang, ref in refs.items()}
        out = F.least(*by.values()) if len(by) > 1 else next(iter(by.values()))
        for lang, d in by.items():
            out = F.when(F.col("lang") == lang, d).otherwise(out)
        return F.when(F.col("n_words") == 0, 1.0).otherwise(out)

    rows = rows.withColumn("class_distance", nearest("p_class", 0)).withColumn("common_distance", nearest("p_common", 1))
    guard = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("n_words") / least_words) * 0.25
    kept = ~F.col("base_failed") & (F.col("class_distance") <= most_class) & ((F.col("class_distance") <= some_class) | (F.col("common_distance") <= some_common + guard))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "common_distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_distance", "common_distance")


def sql(most_class: float = 0.26, some_class: float = 0.115, some_common: float = 0.25, least_words: int = 100) -> str:
    """The same rows in SQL: windows as rows, references as averages of unnested histograms."""
    text_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    listed, n_class, n_common = text_list(LISTED), len(CLASSES) + 1, len(LISTED) + 1
    written = text_list(sorted({*LISTED, *map(str.capitalize, LISTED)}))
    classes = ", ".join("length(regexp_replace(text, '[^" + c.replace("'", "''") + "]+', '', 'g'))" for c in CLASSES)
    half = lambda a, b: f"CASE WHEN {a}[i] > 0 THEN {a}[i] * log2(2 * {a}[i] / ({a}[i] + {b}[i])) / 2 ELSE 0 END"
    distance_sql = lambda p, q, n: f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: {half(p, q)} + {half(q, p)}))))"
    mean = lambda p: f"(SELECT list(m ORDER BY i) FROM (SELECT i, avg(x) AS m FROM (SELECT unnest({p}) AS x, unnest(range(1, len({p}) + 1)) AS i FROM good g WHERE g.lang = l.lang) GROUP BY i))"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS k, CAST(doc_id AS BIGINT) AS doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
places AS (SELECT k, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM split),
threes AS (SELECT k, i, w, lead(w) OVER t AS w2, lead(w, 2) OVER t AS w3 FROM places WINDOW t AS (PARTITION BY k ORDER BY i)),
windows AS (SELECT k, i, count(*) OVER (PARTITION BY k, w, w2, w3) AS times FROM threes WHERE w3 IS NOT NULL),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE times > 1) GROUP BY k),
counted AS (SELECT s.k, doc_id, lang, words, CAST(len(words) AS BIGINT) AS n_words, length(text) AS n_chars, [{classes}] AS classes,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  list_transform(list_filter(words, lambda w: list_contains({written}, w)), lambda w: lower(w)) AS codes FROM split s LEFT JOIN covered c ON s.k = c.k),
base AS (SELECT k, doc_id, lang, n_words, CAST(n_chars - classes[1] AS BIGINT) AS word_chars, CAST(classes[2] AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
  list_transform(list_append(classes, n_chars - list_sum(classes)), lambda x: x / greatest(n_chars, 1)) AS p_class,
  list_transform(list_append(list_transform({listed}, lambda l: len(list_filter(codes, lambda w: w = l))), n_words - len(codes)), lambda x: x / greatest(n_words, 1)) AS p_common FROM counted),
good AS (SELECT * FROM base WHERE NOT base_failed AND n_words >= {least_words} AND list_contains({text_list(COMMON)}, lang)),
refs AS (SELECT l.lang, {mean("p_class")} AS q_class, {mean("p_common")} AS q_common FROM (SELECT DISTINCT lang FROM good) l),
near AS (SELECT b.k, max(CASE WHEN r.lang = b.lang THEN r.a END) AS own_a, max(CASE WHEN r.lang = b.lang THEN r.b END) AS own_b, min(r.a) AS least_a, min(r.b) AS least_b
  FROM base b JOIN (SELECT k, r.lang, {distance_sql("p_class", "q_class", n_class)} AS a, {distance_sql("p_common", "q_common", n_common)} AS b FROM base CROSS JOIN refs r) r ON b.k = r.k GROUP BY b.k),
judged AS (SELECT b.*, coalesce(own_a, least_a, 0) AS a, coalesce(own_b, least_b, 0) AS b FROM base b LEFT JOIN near n ON b.k = n.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND a <= {most_class} AND (a <= {some_class} OR b <= {some_common} + greatest(0, 1 - n_words / {least_words}) * 0.25) AS kept FROM judged"""


QUERIES = {"op5_divergence_rules": query}
ORACLES = {"op5_divergence_rules": sql()}
