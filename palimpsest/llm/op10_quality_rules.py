"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Spark SQL expression over the whole text, so the rules run inside the scan
without user functions, shuffles or Python. Null and empty texts have no words and fail the base rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for on with as was by be are this at or an "
    "le la les de des du et un une en que qui pour dans est sur pas par au avec "
    "der die das und ist nicht ein eine von zu den mit sich auf für im dem als auch "
    "el los las y un una que por con para no se del lo su al como es"
).split()
#: Letters outside the alphabets of these languages: a text that has any is in another one, and its stop words are not known.
FOREIGN = r"[^\x00-\x{BF}ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜàáâäçèéêëíîïñóôöùúûüßÿŸœŒæÆ’‘“”„–—…€•]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` where the measure is known; an open end is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict's thresholds, over the columns that `measures` makes.
RULES = (
    Rule("mean word length", "word_chars / n_words", 1.5, 25.0),
    Rule("symbols per word", "n_symbols / n_words", None, 0.25),
    Rule("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("different stop words to 100 words, in texts of 50 words and more without foreign letters", "CASE WHEN n_words >= 50 AND NOT foreign THEN 100 * n_stop_words / least(n_words, 200) END", 1.0, None),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A window's place in its text takes the low bits of a number, its hash the others.
PLACE_BITS = 20


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of ``size`` words that the text holds twice or more, the first one included.

    Windows are sorted as numbers, by hash and place. Where neighbours of equal hash hold different words,
    or the text has more windows than places, they are sorted by their words instead.
    """
    at = F.sequence(F.lit(0), F.size(words) - size)
    window = lambda i: [F.get(words, (i + k).cast("int")) for k in range(size)]
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    head = lambda x: F.shiftright(x, PLACE_BITS)
    twice = lambda a, same: F.filter(a, lambda x, j: F.coalesce(same(x, F.get(a, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(a, j + 1)), F.lit(False)))
    sequence = lambda i: F.concat_ws(" ", *window(i))

    def length(starts: Column) -> Column:
        nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        add = lambda a, i: F.struct((a["n"] + i + size - F.greatest(i, a["end"])).alias("n"), (i + size).alias("end"))
        return F.aggregate(starts, nothing, add, lambda a: a["n"])

    def exact() -> Column:
        both = F.array_sort(F.transform(at, lambda i: F.struct(sequence(i).alias("s"), i.cast("long").alias("i"))))
        return let(both, lambda a: length(F.sort_array(F.transform(twice(a, lambda x, y: x["s"] == y["s"]), lambda x: x["i"]))))

    def checked(found: Column) -> Column:
        differ = F.filter(found, lambda x, j: F.coalesce((head(x) == head(F.get(found, j - 1))) & (sequence(place(x)) != sequence(place(F.get(found, j - 1)))), F.lit(False)))
        return F.when(F.size(found) == 0, F.lit(0).cast("long")).when(F.size(differ) > 0, exact()).otherwise(length(F.sort_array(F.transform(found, place))))

    packed = F.sort_array(F.transform(at, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long"))))
    quick = let(let(packed, lambda a: twice(a, lambda x, y: head(x) == head(y))), checked)
    n = F.size(words)
    shifted = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(size)])
    hashes = F.slice(F.transform(shifted, lambda x: F.xxhash64(x)), F.lit(1), F.greatest(n - size + 1, F.lit(0)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    # equal windows have equal hashes: a text whose hashes all differ repeats nothing
    quick = F.when(repeats, quick).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) <= size, F.lit(0).cast("long")).when(F.size(words) - size >= 1 << PLACE_BITS, exact()).otherwise(quick)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measured columns of each text after the input's columns, which they replace if names clash."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+", -1), "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)]))).cast("long").alias("n_stop_words"),
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long")
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "foreign")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    of_word, of_line = fresh(docs, "_words", "_lines")
    made = docs.select(*kept, counted.alias(of_word), of_lines.alias(of_line), symbols.alias("n_symbols"), whole.rlike(FOREIGN).alias("foreign"))
    parts = {"n_symbols": "n_symbols", "foreign": "foreign", "n_lines": f"{of_line}.n_lines", "n_dup_lines": f"{of_line}.n_dup_lines"}
    return made.select(*kept, *[F.col(parts.get(c, f"{of_word}.{c}")).alias(c) for c in new])


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One condition of the whole table of thresholds; a measure that is unknown passes."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.expr(rule.measure)
        for bound, ok in ((rule.low, value >= F.lit(rule.low)), (rule.high, value <= F.lit(rule.high))):
            if bound is not None:
                verdict = verdict & F.coalesce(ok, F.lit(True))
    return verdict


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of each document; rows are neither dropped nor joined."""
    measured = measures(docs.drop("base_failed", "kept"), text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("kept", F.when(base, F.lit(False)).otherwise(F.when(F.col("n_words") > 0, passes(rules)).otherwise(F.lit(False))))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
  FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 5)) AS u(k) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_intersect(w, [{_STOPS}]))::BIGINT AS n_stop_words, regexp_matches(t, '{FOREIGN}') AS "foreign"
  FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.25
       AND coalesce(n_dup_lines / n_lines <= 0.5, true) AND (n_words < 50 OR "foreign" OR 100 * n_stop_words / least(n_words, 200) >= 1) AS kept
FROM b
"""
