"""Operator 2: quality rules as a short-circuit cascade, with DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the sample for costs and rejections has on average. It decides the order of rules, never a verdict.
SAMPLE_ROWS = 2000
#: Seed of the sample, a share of each partition's rows.
SEED = 2

#: White space between words: space and U+0009 to U+000D, as SQL string parts.
_BLANKS = r"' \t\n\u000B\u000C\r'"

#: Words of a text that has been trimmed of white space at both ends; none of an empty one.
_WORDS = f"if(trim(BOTH {_BLANKS} FROM __t) = '', array(), split(trim(BOTH {_BLANKS} FROM __t), '[\\\\x20\\\\x09-\\\\x0D]+'))"

#: Words inside 3-word windows that occur twice or more: windows as 64-bit hashes, sorted with their starts; equal
#: neighbours are repeats; each start adds up to three words that no earlier window had.
_REPEATED = """
if(size(w) < 4, 0L,
  transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), tri ->
    if(size(array_distinct(tri)) = size(tri), 0L,
      transform(array(sort_array(transform(tri, (h, i) -> struct(h, i)))), p ->
        aggregate(
          sort_array(transform(
            filter(p, (x, k) -> (k > 0 AND get(p, k - 1).h = x.h) OR coalesce(get(p, k + 1).h = x.h, false)),
            x -> x.i)),
          struct(0L AS n, -3 AS last),
          (a, x) -> struct(a.n + least(3, x - a.last) AS n, x AS last),
          a -> a.n))[0]))[0])
"""


@dataclass(frozen=True)
class Rule:
    """passes: SQL over n_words, word_chars, n_symbols, n_dup_lines, n_lines and the text __t. True keeps the document.

    per_row and per_char: nanoseconds of one core that it takes for a document and for each of its characters, measured
    once by repeated runs over prose. With the lengths of the sample's documents they give what the rule costs here.
    """

    name: str
    passes: str
    per_row: float = 20.0
    per_char: float = 0.0


RULES = (
    Rule("symbols", "100 * n_symbols <= 15 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines <= 30 * n_lines"),
    Rule("word_length", "word_chars BETWEEN 2 * n_words AND 15 * n_words"),
    Rule("capitals", "100 * (length(__t) - length(translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) <= 40 * word_chars", 200.0, 9.0),
    Rule("exclamations", "100 * (length(__t) - length(translate(__t, '!', ''))) <= 30 * n_words", 200.0, 9.0),
    Rule("letters", r"100 * regexp_count(__t, '(?<!\\S)[^\\p{L}\\s]+(?!\\S)') <= 30 * n_words", 500.0, 40.0),
)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the base measures n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and the text as __t."""
    one = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    one = one.withColumn("__m", F.expr(f"transform(array({_WORDS}), w -> struct(CAST(size(w) AS BIGINT) AS n, {_REPEATED} AS r))[0]"))
    one = one.withColumn("__l", F.expr(r"transform(array(filter(split(__t, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')), l -> struct(CAST(size(l) AS BIGINT) AS n, CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS d))[0]"))
    return one.withColumns({
        "n_words": F.col("__m.n"),
        "word_chars": F.expr(f"CAST(length(translate(__t, {_BLANKS}, '')) AS BIGINT)"),
        "n_symbols": F.expr("CAST(length(__t) - length(translate(__t, '#*$%&|<>', '')) AS BIGINT)"),
        "n_dup_lines": F.col("__l.d"),
        "n_lines": F.col("__l.n"),
        "n_repeat_words": F.col("__m.r"),
    }).drop("__m", "__l")


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def profile(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[int, int, int]]:
    """(rules failed, as bits; documents; their characters) of a sample's documents that pass the base.

    One job with one aggregate: at most a row for each combination of rules. Each partition gives a share of its own
    rows, so nothing but these sums is shuffled, however many partitions there are, and a hot source gives its share too.
    """
    text = df.select(text_col)
    n = text.count()
    sample = measures(text.sample(min(1.0, rows / max(n, 1)), SEED), text_col).where(f"NOT ({BASE_FAILED})")
    bits = " + ".join(f"IF({r.passes}, 0L, {1 << k}L)" for k, r in enumerate(rules)) or "0L"
    found = sample.select(F.expr(bits).alias("mask"), F.length("__t").cast("long").alias("chars")).groupBy("mask").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return [tuple(r) for r in found.collect()]


def order(rules: tuple[Rule, ...], found: list[tuple[int, int, int]]) -> list[Rule]:
    """Rules by what they reject per cost, of the documents that no rule before them has rejected; ties by name."""
    left, out = list(found), []
    rest = list(enumerate(rules))
    while rest:
        n, chars = sum(x[1] for x in left), sum(x[2] for x in left)

        def gain(x: tuple[int, Rule]) -> tuple[float, float, str]:
            cost = n * x[1].per_row + chars * x[1].per_char
            return (-sum(m for mask, m, _ in left if mask >> x[0] & 1) / max(cost, 1.0), x[1].per_char, x[1].name)

        best = min(rest, key=gain)
        rest.remove(best)
        out.append(best[1])
        left = [x for x in left if not x[0] >> best[0] & 1]
    return out


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, cascade: list[Rule] | None = None) -> DataFrame:
    """df with the measures, base_failed and kept.

    kept is false for a document that fails the base or any rule. Rules stand in one CASE in the order of the
    cascade, so that later ones are not evaluated for what an earlier one rejects; the verdict is the same in any
    order. The measures are columns of the result, so they are taken of each document, whatever rejects it. Null text
    counts as no words, and so fails; every row, repeated or not, is judged by itself; a narrow map without shuffle.
    Measures that df has under the same names are replaced, also n_lines; a column __t goes.
    """
    cascade = cascade if cascade is not None else order(rules, profile(df, text_col, rules))
    whens = " ".join(f"WHEN NOT ({r.passes}) THEN false" for r in cascade)
    return (
        measures(df, text_col)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", F.expr(f"CASE WHEN base_failed THEN false {whens} ELSE true END"))
        .drop("__t")
    )


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS c FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
  CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= 15 * n_words AND 100 * n_dup_lines <= 30 * n_lines
  AND word_chars BETWEEN 2 * n_words AND 15 * n_words
  AND 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) <= 40 * word_chars
  AND 100 * (length(t) - length(replace(t, '!', ''))) <= 30 * n_words
  AND 100 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) <= 30 * n_words AS kept
FROM b
"""
