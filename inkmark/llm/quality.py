"""Quality rules as a bitmask ledger: every rule evaluated once, policies and ablations from the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmark.llm.common import WORD, let, stored

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Bit by place. A rule fails where its condition holds; the first two are the base.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "shouting": "100 * n_upper > 40 * word_chars",
    "same_lines": "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines",
    "long_words": "word_chars > 20 * n_words",
}

#: Versions of the policy: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeats"),
    "2025-1": ("few_words", "repeats", "symbols", "shouting"),
    "2025-2": ("few_words", "repeats", "symbols", "shouting", "same_lines", "long_words"),
}
CURRENT = "2025-2"


def mask(policy: str = CURRENT) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[policy])


def _repeated(words: Column) -> Column:
    """How many of the words stand in a window of three words that the text has twice or more."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))

    def covered(by_hash: Column) -> Column:
        again = F.filter(by_hash, lambda x, i: F.get(by_hash, i - 1)["h"].eqNullSafe(x["h"]) | F.get(by_hash, i + 1)["h"].eqNullSafe(x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["at"]))
        none = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, none, lambda a, at: F.struct(at.alias("last"), (a["n"] + F.least(F.lit(3), at - a["last"])).alias("n")), lambda a: a["n"])

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return let(windows, count)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measures, fail_bits): one row per row of docs, without a shuffle.

    Null and empty texts have no words and fail the base. Null ids stay, repeated rows give repeated rows, an empty
    table gives none; other columns of docs are left alone. Windows of words are compared by 64-bit hashes, in one
    document only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def measures(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        found = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
            found.alias("lines"),
        )

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.select("id", let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), measures).alias("m"))
    own = own.select("id", *[F.col(f"m.{x}") for x in ("n_words", "word_chars", "n_symbols")], F.col("m.lines.dup").alias("n_dup_lines"), "m.n_repeat_words", F.col("m.lines.n").alias("n_lines"), "m.n_upper")
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return own.withColumn("fail_bits", bits.cast("long"))


def keep_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, written to the shared folder and read again: verdicts and ablations of any policy read no text.

    Rows, nulls, repeats and empty tables are those of ledger().
    """
    return stored(ledger(docs, id_col, text_col), "ledger")


def passes(bits: Column, policy: str = CURRENT) -> Column:
    """Whether the policy keeps a row of a ledger. Null bits give null; a ledger has none."""
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(found: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept_without): for each rule of each policy, from the ledger's bits alone.

    n_failed counts the rows that the rule rejects, n_only those that no other rule of the policy rejects, and
    n_kept_without those that the policy would keep without it. The ledger is first counted by its bits, of which there
    are 2 ** rules at most. Repeated rows and null ids count as rows, other columns are left alone, an empty ledger
    gives no rows.
    """
    counts = found.groupBy("fail_bits").agg(F.count("*").alias("n"))
    arms = [(p, name, 1 << i, mask(p)) for p in policies for i, name in enumerate(RULES) if name in POLICIES[p]]
    arm = [F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"), F.lit(all_).cast("long").alias("mask")) for p, name, bit, all_ in arms]
    rows = counts.select("n", "fail_bits", F.explode(F.array(*arm)).alias("arm"))
    bit, held = F.col("arm.bit"), F.col("fail_bits").bitwiseAND(F.col("arm.mask"))

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return rows.groupBy(F.col("arm.policy").alias("policy"), F.col("arm.rule").alias("rule")).agg(
        counted(held.bitwiseAND(bit) != 0).alias("n_failed"),
        counted(held == bit).alias("n_only"),
        counted((held == 0) | (held == bit)).alias("n_kept_without"),
    )


def ablation(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without) of one policy: see ablations()."""
    return ablations(found, (policy,)).drop("policy")


def kept(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that the policy rejects; rules are evaluated once, row by row, without a join.

    Null and empty texts go, rows with a null id are judged as others, repeated rows stay or go together, very long
    texts are measured whole, an empty table gives none, and columns may have any names.
    """
    names = docs.columns
    found = ledger(docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(text_col).alias("text")), "row", "text")
    return found.where(passes(F.col("fail_bits"), policy)).select(*[F.col("id")[n].alias(n) for n in names])
