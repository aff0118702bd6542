"""Quality rules as a ledger: each rule is evaluated once per document, policies are masks over its failure bits.

A ledger row holds a document's measurements and one long whose bit ``i`` says that rule ``i`` fails. A policy is a
version name and a set of rules; applying one, or asking what a policy would do without one of its rules, only
combines bits and never reads a text again. Column expressions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: Rules in the order of their bits: what fails, over the measurements. Add at the end only; stored ledgers keep bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "upper_case": "2 * n_upper > n_letters",
    "few_letters": "10 * n_letters < 6 * word_chars",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BASE = ("few_words", "repeated_words")

#: Versioned policies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "upper_case"),
    "v2": tuple(RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def mask(rules: Sequence[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _size(values: Column) -> Column:
    return F.size(values).cast("long")


def _measure(rows: DataFrame, text: str) -> DataFrame:
    """Steps are columns of their own, so that none is computed twice."""
    t = F.col(text)
    w, h, s, p = (f"{text}_{k}" for k in ("words", "hashes", "sorted", "places"))
    rows = rows.withColumn(w, F.filter(F.split(t, SPACE), lambda x: x != ""))
    rows = rows.withColumn(f"{text}_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # three-word windows; those found again are neighbours once hashes are sorted with their places
    window = F.transform(F.col(w), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    rows = rows.withColumn(h, F.slice(window, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    pairs = F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    again = F.size(F.array_distinct(F.col(h))) < F.size(F.col(h))
    rows = rows.withColumn(s, F.when(again, F.sort_array(pairs)))
    same = lambda x, i: (x.h == F.get(F.col(s), i - 1).h) | (x.h == F.get(F.col(s), i + 1).h)
    marked = F.transform(F.col(s), lambda x, i: F.when(F.coalesce(same(x, i), (x.h == F.get(F.col(s), i - 1).h),
                                                                  (x.h == F.get(F.col(s), i + 1).h), F.lit(False)), x.i))
    rows = rows.withColumn(p, F.sort_array(F.array_compact(marked)))
    # a window adds its three words, less those of the next one
    step = F.transform(F.col(p), lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col(p), i + 1) - x, F.lit(3))))
    return rows.withColumns({
        "n_words": _size(F.col(w)),
        "word_chars": _left(t, SPACE),
        "n_symbols": _left(t, r"[^#*$%&|<>]+"),
        "n_lines": _size(F.col(f"{text}_lines")),
        "n_dup_lines": _size(F.col(f"{text}_lines")) - _size(F.array_distinct(F.col(f"{text}_lines"))),
        "n_repeat_words": F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
        "n_upper": _left(t, r"\P{Lu}+"),
        "n_letters": _left(t, r"\P{L}+"),
    })


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the MEASURES (long) and ``failures``, a long of failed rules' bits.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines lie between ``\\n``. A null text counts as empty: it measures 0
    everywhere and fails few_words. Null ids and repeated rows are kept as they are, an empty table gives no rows, and
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("ledger_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("ledger_text"))
    measured = _measure(rows, "ledger_text").select("ledger_id", *MEASURES)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.withColumn("failures", failures.cast("long")).withColumnRenamed("ledger_id", id_col)


def passes(policy: str, policies: Mapping[str, Sequence[str]] = POLICIES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policies[policy])).cast("long")) == 0


def apply_policies(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Adds a column ``passes_<version>`` for each policy."""
    return rows.withColumns({f"passes_{name}": passes(name, policies) for name in policies})


def ablations(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """(version, rule, n_docs, n_failed, n_sole): how many documents fail a policy's rule, and how many fail that
    rule alone, so that the policy without it would keep them. One pass over the ledger, sums only."""
    parts = []
    for name, rules in policies.items():
        own = F.col("failures").bitwiseAND(F.lit(mask(rules)).cast("long"))
        for rule in rules:
            bit = F.lit(mask([rule])).cast("long")
            parts.append(F.struct(F.lit(name).alias("version"), F.lit(rule).alias("rule"), F.count("*").alias("n_docs"),
                                  F.coalesce(F.sum((own.bitwiseAND(bit) != 0).cast("long")), F.lit(0)).alias("n_failed"),
                                  F.coalesce(F.sum((own == bit).cast("long")), F.lit(0)).alias("n_sole")))
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def keep_passing(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their own columns only.

    A row is judged where it stands, so nothing is joined back and repeated ids cause no confusion.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole_row"))
    rows = whole.withColumn("ledger_text", F.coalesce(F.col(f"whole_row.`{text_col}`").cast("string"), F.lit("")))
    chosen = mask(POLICIES[policy])
    failed = [F.expr(rule) for k, rule in enumerate(RULES.values()) if chosen >> k & 1]
    bad = failed[0]
    for f in failed[1:]:
        bad = bad | f
    # a generator, since a filter would be pushed below the measurements and compute each of them once more
    kept = F.explode(F.when(~bad, F.array("whole_row"))).alias("whole_row")
    return _measure(rows, "ledger_text").select(kept).select("whole_row.*")
