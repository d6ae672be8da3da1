"""Quality rules as a bitmask ledger, in Spark SQL functions only.

``ledger`` evaluates every rule once for each document and stores its measurements and one bit
for each rule that it fails. Policies are versioned sets of rules; applying one is a bitwise
test of the ledger, and so is counting what each rule of a policy rejects alone. The heavy part
(word windows that repeat) compares 64-bit hashes first; only texts in which two hashes are
equal compare the windows themselves, so the counts are exact.

Defined results: null and empty texts have no words, so they fail the rules on too few words
only; documents of fewer than five words have no window; repeated rows give repeated rows; an
empty table gives an empty ledger and an ablation without rows; columns that are not asked for
are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda variable, which no optimiser inlines."""
    return F.transform(F.array(value), use)[0]


def _repeated_starts(words: Column, n: Column) -> Column:
    """Starts of windows that occur twice or more, in order; by the windows themselves."""
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i")))
    return let(
        F.array_sort(windows),
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, k: F.coalesce(x["w"] == F.get(s, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text."""

    def count(n: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
        distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        covered = let(
            _repeated_starts(words, n),
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
            ),
        )
        return F.when(n < WINDOW, 0).when(distinct, 0).otherwise(covered)

    return let(F.size(words), count).cast("long")


def measurements(text: Column) -> Column:
    """All measurements of a text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, _SPACES, "") != "")
    plain = F.regexp_replace(text, _SPACES, "")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def of_plain(p: Column) -> Column:
        chars, symbols = F.length(p), F.length(p) - F.length(F.translate(p, _SYMBOLS, ""))
        shouted = F.length(p) - F.length(F.regexp_replace(p, r"[A-Z]+", ""))
        small = F.length(p) - F.length(F.regexp_replace(p, r"[a-z]+", ""))
        marks = F.length(p) - F.length(F.translate(p, "!?", ""))
        return F.struct(*[c.cast("long").alias(n) for c, n in ((chars, "word_chars"), (symbols, "n_symbols"), (shouted, "n_upper"), (small, "n_lower"), (marks, "n_marks"))])

    def of_lines(a: Column) -> Column:
        return F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))

    return F.struct(let(words, of_words).alias("w"), let(plain, of_plain).alias("c"), let(lines, of_lines).alias("l"))


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` (SQL over the measurements) is true."""

    name: str
    fails: str


#: Bit i of a mask belongs to rule i. Rules are only ever appended, so stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "20 * n_symbols > word_chars"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "n_upper > 2 * n_lower and n_upper >= 20"),
    Rule("marks", "20 * n_marks > word_chars"),
    Rule("word_length", "n_words > 0 and (word_chars > 15 * n_words or word_chars < 2 * n_words)"),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks")

BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "symbols", "repeated_lines", "shouting", "marks"),
}


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in names)


def ledger(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ``keep`` columns, every measurement, and ``fail_mask`` with a bit for each failed rule."""
    measured = docs.select(F.struct(*[docs[c] for c in keep]).alias("_kept"), let(docs[text_col], measurements).alias("_m"))
    flat = measured.select("_kept", F.inline(F.array(F.struct("_m.w.*", "_m.c.*", "_m.l.*"))))
    mask = None
    for i, rule in enumerate(rules):
        bit = F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return flat.select("_kept.*", *MEASURES, mask.alias("fail_mask"))


def apply_policy(rows: DataFrame, policy: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``kept`` is true where no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_mask").bitwiseAND(F.lit(mask_of(POLICIES[policy], rules))) == 0)


def ablation(rows: DataFrame, policy: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects.

    Documents are first counted by their mask, of which there are 2^rules at most.
    """
    of_policy = mask_of(POLICIES[policy], rules)
    masks = rows.groupBy(F.col("fail_mask").bitwiseAND(F.lit(of_policy)).alias("mask")).agg(F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in POLICIES[policy]])
    failed, alone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask") == F.col("bit")
    return masks.select("mask", "n", F.inline(listed)).groupBy("rule").agg(F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("rejected_alone"))


#: The base measurements and the verdict of policy v2, in DuckDB SQL.
ORACLE = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') as lines,
        regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') as plain from t),
p as (select rid, i, words[i:i + 4] as win from (select rid, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as n from p) where n > 1),
c as (select rid, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words
      from (select rid, i, lead(i) over (partition by rid order by i) as nxt from r) group by rid),
m as (select doc_id, len(words)::bigint as n_words, length(plain)::bigint as word_chars,
        length(regexp_replace(plain, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
        length(regexp_replace(plain, '[^A-Z]', '', 'g'))::bigint as n_upper,
        length(regexp_replace(plain, '[^a-z]', '', 'g'))::bigint as n_lower,
        length(regexp_replace(plain, '[^!?]', '', 'g'))::bigint as n_marks
      from w left join c using (rid)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        (case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
        + (case when 20 * n_symbols > word_chars then 4 else 0 end)
        + (case when n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines then 8 else 0 end)
        + (case when n_upper > 2 * n_lower and n_upper >= 20 then 16 else 0 end)
        + (case when 20 * n_marks > word_chars then 32 else 0 end)
        + (case when n_words > 0 and (word_chars > 15 * n_words or word_chars < 2 * n_words) then 64 else 0 end) as fail_mask from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_mask & 63 = 0 as kept, fail_mask::bigint as fail_mask from f
"""
