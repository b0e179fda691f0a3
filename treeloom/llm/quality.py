"""Rule bitmask ledger: every quality rule evaluated once, policies applied to stored bits.

``ledger`` measures each document in one scan and stores the failures of all rules as the
bits of one long next to the measurements. ``apply_policy`` then decides by ``mask & bits``
for any versioned policy without touching a text again, and ``ablation`` counts what each
rule rejects alone and what a policy would keep without it.

All of it is built-in column expressions inside one projection: no shuffle, no Python.
Null text counts as empty: no words, so every document with it fails ``few_words``.
Repeated rows are judged alike, empty tables give empty ledgers, and extra columns of any name
pass through ``apply_policy``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

#: Rules in bit order: name, failing condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting", "2 * n_upper > n_letters AND n_letters >= 20"),
    ("exclaiming", "2 * n_exclaims > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
]
#: Versioned policies: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "2024.1": ["few_words", "repeated_windows", "many_symbols", "shouting", "exclaiming", "duplicate_lines", "long_words", "short_words"],
}
DEFAULT_POLICY = "2024.1"


def rule_mask(names: list[str]) -> int:
    known = [name for name, _ in RULES]
    return sum(1 << known.index(name) for name in set(names))


def _let(value: Column, body) -> Column:
    """Evaluate value once and bind it, where a lambda would evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_pairs(h: Column, step: int) -> Column:
    """Hash each element with the one step places on; the result is step shorter."""
    n = F.size(h) - step
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order."""

    def starts(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        same = lambda x, at: F.coalesce(F.get(sorted_pairs, at)["h"] == x["h"], F.lit(False))
        hit = F.filter(sorted_pairs, lambda x, i: ((i > 0) & same(x, i - 1)) | ((i < n - 1) & same(x, i + 1)))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def union_length(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, lambda p: _let(starts(p), lambda s: F.when(F.size(s) > 0, union_length(s)).otherwise(F.lit(0))))


def _repeat_words(words: Column) -> Column:
    def over(h: Column) -> Column:
        pairs = _let(_window_pairs(h, 1), lambda a: _let(_window_pairs(a, 2), lambda b: _window_pairs(b, 4)))
        return _let(pairs, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, _let(hashed, over)).otherwise(F.lit(0))


def measurements(text: Column) -> Column:
    """One struct of everything the rules read.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    equal an earlier line), n_lines (lines with a word), n_repeat_words (words in 8-word windows
    found twice or more), n_letters, n_upper, n_exclaims (words that hold ``!!``).
    Windows are compared by 64-bit hashes built by doubling (1, 2, 4, 8 words).
    """
    text = F.coalesce(text, F.lit(""))
    # Separators at the ends would give empty words; elsewhere the split leaves none.
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, SEPARATORS, "")) > 0)
    solid = F.translate(text, SEPARATORS, "")

    def counted(w: Column) -> Column:
        return _let(solid, lambda s: _let(lines, lambda ls: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(s).cast("long").alias("word_chars"),
            (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(ls).cast("long").alias("n_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            (F.length(s) - F.length(F.translate(s, UPPER, ""))).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(s, r"[^A-Za-z]+", "")).cast("long").alias("n_letters"),
            F.when(F.contains(s, F.lit("!!")), F.size(F.filter(w, lambda x: F.contains(x, F.lit("!!"))))).otherwise(0).cast("long").alias("n_exclaims"),
        )))

    return _let(words, counted)


def ledger(docs: DataFrame, text: str = "text", into: str = "_ledger") -> DataFrame:
    """docs with a struct column of the measurements and ``bits``, the failed rules.

    A column of docs that is named like the struct is left out.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != into]
    # A generator is evaluated once; a filter on a plain column would be pushed down and repeat it.
    measured = docs.select(*kept, F.explode(F.array(measurements(F.col(f"`{text}`")))).alias(into))
    bits = F.lit(0).cast("long")
    fields = [f.name for f in measured.schema[into].dataType.fields]
    for i, (_, failing) in enumerate(RULES):
        condition = failing
        for name in sorted(fields, key=len, reverse=True):
            condition = _qualify(condition, name, into)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn(into, F.col(into).withField("bits", bits))


def _qualify(condition: str, name: str, into: str) -> str:
    return re.sub(rf"(?<![\w.]){name}(?!\w)", f"{into}.{name}", condition)


def passes(bits: Column, policy: str = DEFAULT_POLICY) -> Column:
    """Whether a ledger's bits pass a versioned policy."""
    return bits.bitwiseAND(F.lit(rule_mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The documents a policy keeps, with docs' own columns."""
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").alias("_text"))
    return ledger(inside, "_text").where(passes(F.col("_ledger.bits"), policy)).select("_doc.*")


def ablation(ledgers: DataFrame, policy: str = DEFAULT_POLICY, into: str = "_ledger") -> DataFrame:
    """For each rule of a policy: documents failing it, failing only it, and kept without it.

    One aggregation over distinct bit patterns (at most 2^rules rows leave each task).
    """
    mask = rule_mask(POLICIES[policy])
    patterns = ledgers.groupBy(F.col(f"{into}.bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    both = patterns.withColumn("r", F.explode(F.array(*rules))).select("bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return both.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(fails & (rest == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = F.col("_ledger")
    return ledger(docs).select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(m["bits"], "base")).alias("base_failed"),
        passes(m["bits"]).alias("kept"),
        m["bits"].alias("rule_bits"),
    )


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """What each rule of the default policy rejects, alone and with others, over all documents."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
