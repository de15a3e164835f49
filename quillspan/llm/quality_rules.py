"""Quality rules: a table of thresholds compiled into one projection of Spark expressions.

Words are runs of [^space, \\t \\n \\v \\f \\r]. Stop words are found without case and without marks around them. Every measure is made within its own row, with built-in functions only, so no row
travels and a hot source or a very long text costs its own length and nothing more. A null text counts as empty; an
empty text has no words and fails. Input columns that share a name with a measure are replaced.

The measures leave `measured` through a generator of one row. A filter on them, or on the verdict, stays above it: pushed below
the projections it would repeat every measure within the next.

n_repeat_words compares 64-bit hashes of a text's 3-word windows; two different windows of one text would have to share a hash to be miscounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
_MARKS = ".,;:!?\"'()[]«»“”„…-"

#: Fixed values: frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as at this by from are or an was "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an er so dass "
    "le la les de des et un une du en que qui dans pour pas sur est au par avec il ce se plus "
    "el los las del y por con una su para al lo como más o pero sus"
).split()
#: A longer word, marks included, is not looked up among them.
_STOP_BYTES = 2 * max(len(w.encode()) for w in STOP_WORDS)

#: name: (measure, least, most). A text is kept if every measure lies within its bounds; None: no bound.
RULES: dict[str, tuple[str, float | None, float | None]] = {
    "length": ("n_words", 50, None),
    "mean_word_length": ("word_chars / greatest(n_words, 1)", 2, 12),
    "symbols": ("n_symbols / greatest(n_words, 1)", None, 0.3),
    "stop_words": ("n_stop_words / greatest(n_words, 1)", 0.005, None),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", None, 0.5),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the MEASURES (long)."""
    base = df.select(F.struct(*scratch_columns(df)).alias("row"), F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(_SPACE)).alias("txt"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("raw"))
    words = F.when(F.col("txt") == "", F.array().cast("array<string>")).otherwise(F.split("txt", "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("raw", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    a = base.select("row", words.alias("w"), lines.alias("lines"))
    after = lambda i: F.get("w", i)  # noqa: E731
    windows = F.when(F.size("w") >= 3, F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.xxhash64(x, after(i + 1), after(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    joined = F.array_join("w", "")
    b = a.select(
        "row", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        joined.alias("joined"), windows.alias("win"), F.size(F.filter("w", lambda x: (F.octet_length(x) <= _STOP_BYTES) & F.lower(F.btrim(x, F.lit(_MARKS))).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
    )  # fmt: skip
    # Most texts repeat no window; only the others are sorted.
    again = F.size(F.array_distinct("win")) < F.size("win")
    c = b.withColumn("s", F.when(again, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: (x.h == F.get("s", j - 1).h) | (x.h == F.get("s", j + 1).h)  # noqa: E731
    places = F.transform(F.filter("s", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x.i)
    d = c.withColumn("p", F.sort_array(places))
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3)))), F.lit(0), lambda n, x: n + x)
    chars = F.char_length("joined")
    made = d.select(
        "row", "n_words", chars.cast("long").alias("word_chars"), (chars - F.char_length(F.regexp_replace("joined", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_stop_words",
    )  # fmt: skip
    one = made.select("row", F.explode(F.array(F.struct(*MEASURES))).alias("m"))
    return one.select(*[F.col(f"row.`{x}`") for x in df.columns if x.lower() not in MEASURES], *[F.col(f"m.{x}").alias(x) for x in MEASURES])


def scratch_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def verdict(rules: dict[str, tuple[str, float | None, float | None]] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    ok = F.lit(True)
    for measure, least, most in rules.values():
        value = F.expr(measure)
        ok = ok & (value >= least if least is not None else F.lit(True)) & (value <= most if most is not None else F.lit(True))
    return ok


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judged(df: DataFrame, text: str = "text", rules: dict[str, tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """measured() with base_failed and kept."""
    rest = measured(df.drop("base_failed", "kept"), text)
    return rest.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """df's rows that pass, with df's columns."""
    own = df.select(F.struct(*scratch_columns(df)).alias("__row"), F.col(f"`{text}`").alias("__text"))
    return judged(own, "__text").filter("kept").select("__row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WINDOWS = "list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
OP4_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw FROM documents),
     a AS (SELECT doc_id, list_filter(regexp_split_to_array(raw, '[ 	-]+'), lambda x: x <> '') AS w, list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM t),
     g AS (SELECT doc_id, unnest({_WINDOWS}) AS gram, generate_subscripts({_WINDOWS}, 1) AS i FROM a),
     again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
     p AS (SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
     m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
                  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                  len(list_filter(w, lambda x: octet_length(encode(x)) <= {_STOP_BYTES} AND list_contains({_listed(sorted(set(STOP_WORDS)))}, lower(trim(x, '{_MARKS.replace("'", "''")}'))))) AS n_stop_words
           FROM a LEFT JOIN p ON p.doc_id = a.doc_id),
     f AS (SELECT *, {BASE_FAILED} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"({measure.replace('/', '::DOUBLE /')}) {sign} {bound}" for measure, least, most in RULES.values() for sign, bound in ((">=", least), ("<=", most)) if bound is not None)} AS kept FROM f
"""
