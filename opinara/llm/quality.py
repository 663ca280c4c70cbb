"""Quality rules as a bitmask ledger: measured once, judged by any policy afterwards.

`ledger` reads each text once and stores one failure bit per rule next to the measurements.
A policy is a versioned set of bits, so judging documents under another version, or asking
what a rule alone removes, is integer work on the ledger and never reads text again.

Defined results: null and empty texts have zero words, fail `few_words` and no other rule;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import BLANK, WORD, scratch

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_stutter")
# Rules in bit order: name and SQL over the measurements. Whole numbers only, so engines agree.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("stutter", "2 * n_stutter > n_words"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "v1": ("few_words", "repeated_windows", "word_length", "symbols"),
    "v2": tuple(name for name, _ in RULES),
}


def bit(name: str) -> int:
    return 1 << [rule for rule, _ in RULES].index(name)


def mask(rules: tuple[str, ...] | str) -> int:
    """The bits of a policy version or of named rules."""
    names = POLICIES[rules] if isinstance(rules, str) else rules
    return reduce(lambda bits, name: bits | bit(name), names, 0)


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more, from the sorted window digests `_sorted`."""
    twin = lambda x, i: (
        F.coalesce(F.get(F.col("_sorted"), i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col("_sorted"), i + 1)["h"] == x["h"], F.lit(False))
    )
    return F.sort_array(F.transform(F.filter("_sorted", twin), lambda x: x["i"]))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements as long, fail_bits): one row per input row, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    d = docs.select(
        F.col(id_col),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        lines.alias("_lines"),
    )
    d = d.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    ).drop("_lines", "_words")
    echo = F.filter("_hashes", lambda h, i: F.coalesce(F.get(F.col("_hashes"), i - 1) == h, F.lit(False)))
    d = d.withColumn("n_stutter", F.size(echo).cast("long"))
    window = F.transform("_hashes", lambda _, i: F.xxhash64(F.slice(F.col("_hashes"), i + 1, WINDOW)))
    count = F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))
    d = d.withColumn("_windows", F.when(count > 1, F.slice(window, F.lit(1), count)))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(repeated, pairs)).drop("_windows", "_hashes")
    d = d.withColumn("_at", F.when(F.size("_sorted") > 0, _repeat_words())).drop("_sorted")
    covered = F.aggregate(
        F.transform(
            "_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW)))
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    bits = reduce(
        lambda a, b: a.bitwiseOR(b), [F.when(F.expr(sql), F.lit(bit(n))).otherwise(F.lit(0)) for n, sql in RULES]
    )
    return d.select(id_col, *MEASURES, bits.cast("int").alias("fail_bits"))


def judge(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds `base_failed` and `kept` under one policy version."""
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    base = hit(mask(BASE))
    return book.withColumn("base_failed", base).withColumn("kept", ~base & ~hit(mask(policy)))


def report(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """(doc_id, measurements, base_failed, kept, further measurements, fail_bits) from a ledger that is
    written once; any number of policies could be judged from it."""
    judged = judge(scratch(ledger(docs)), policy)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in first])


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """(rule, n_failed, n_only): documents a rule fails, and those that only this rule removes.

    One grouping by the bit pattern (at most 2^rules groups) answers every rule at once.
    """
    spark = book.sparkSession
    chosen = mask(policy)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(name, bit(name)) for name in POLICIES[policy]], "rule string, b int")
    hit = F.col("bits").bitwiseAND(F.col("b")) != 0
    return (
        rules.join(patterns, hit, "left")  # the rules next to their 2^rules patterns
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("b"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )


SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{BLANK}]')) AS ls
  FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS x
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
cover AS (
  SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper,
    len(list_filter(ws, lambda x, i: i > 1 AND ws[i - 1] = x))::BIGINT AS n_stutter
  FROM w LEFT JOIN cover USING (r)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {sql} THEN {bit(n)} ELSE 0 END" for n, sql in RULES)})::INTEGER AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_stutter, fail_bits,
  (fail_bits & {mask(BASE)}) <> 0 AS base_failed, (fail_bits & {mask(BASE) | mask("v2")}) = 0 AS kept FROM b
"""
