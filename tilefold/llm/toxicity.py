"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over words, one of toxic and one of ordinary documents, score
an expression (a word, or a word behind another) by the log of the ratio of its likelihoods. Words
are compared in lower case and without ASCII punctuation and digits at their ends.

- A word's count in a class is the number of distinct words before it there (continuation count).
  Its probability is the discounted count's share, and the mass that discounting frees is spread by
  the continuation counts of both classes together. A word of fewer than ``RARE`` continuations has
  the probability of the shared counts in both classes, so that alone it tells nothing.
- A word's probability behind another is the discounted number of documents that hold both in this
  order, as a share of that number for all words behind the first. The mass that is left goes first
  to the same discounted share in both classes together, and what is left there to all words by
  their probability above. Pairs that fewer than ``RARE`` toxic documents hold are pruned: their
  mass is left too, so the probabilities behind every word still sum to 1.

A text's log-likelihoods are normalised by length over the whole text and over its best stretches
of ``STRETCHES`` words, so that a short expression is not drowned in a long text; a logistic curve,
fitted on documents that the counts have not seen, turns them into a probability.

Every labelled training row is counted: tasks emit their distinct pairs of words, and Spark adds
them up and derives the words from them; no two expressions share a count (they are known by
64-bit hashes). The listed expressions are broadcast, so the model has no fixed size.

Folds by crc32(doc_id) mod 4: 0 and 1 are counted, 3 calibrates, 2 is held out.

Defined results: null and empty texts have no words and get the score of no evidence; rows
with a null doc_id are scored and never learnt from; labels that are null or not 0 or 1 are
left out, and of several labels of a document each is used; without labels of both classes
every score is the prior (0.5 without labels); repeated rows give repeated results.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, Words, as_text, mix, scratch, slices, split_words, written

DISCOUNT = 0.75
#: Continuations that a word, and toxic documents that a pair needs to have counts of its own.
RARE = 3
#: Texts are looked at in slices of about so many UTF-8 bytes, to bound a worker's arrays.
SLICE = 2 << 20
#: Words of the stretches that are looked at besides the whole text.
STRETCHES = (1, 4, 16)
#: Bits of the filter that keeps unlabelled texts out of the shuffle (8 MB, whatever the input).
FILTER_BITS = 1 << 26
#: Rows that the calibration curve is fitted on, at most (the smallest by a hash of doc_id).
CALIBRATION_ROWS = 20_000

_EDGES = string.punctuation + string.digits


def word_codes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: their hashes, those of the words before them (0 at a text's start), and each text's first."""
    words = split_words(texts)
    bare = pc.utf8_trim(pc.utf8_lower(words.distinct), _EDGES)
    hashes = Words(words.codes, bare, words.first).hashes()
    kept = np.asarray(pc.not_equal(bare, ""), bool)[words.codes]
    code = hashes[words.codes][kept]
    first = np.concatenate([[0], np.cumsum(kept)])[words.first]
    before = np.concatenate([[np.uint64(0)], code[:-1]]) if len(code) else code
    before[first[:-1][first[:-1] < len(code)]] = 0
    return code, before, first


def pair_codes(before: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(before * MIX_A + code + MIX_B)


def count_texts(texts: pa.StringArray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of words, and in how many ordinary and (in the upper 32 bits) toxic texts each stands."""
    code, before, first = word_codes(texts)
    if not len(code):
        return code, code, np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(toxic)), np.diff(first))
    pair = pair_codes(before, code)
    _, at, number = np.unique(pair, return_index=True, return_inverse=True)
    seen = np.unique(text * len(at) + number)  # a pair counts once for each document
    counts = [np.bincount(seen[toxic[seen // len(at)] == c] % len(at), minlength=len(at)) for c in (0, 1)]
    return before[at], code[at], counts[0] | counts[1] << 32


def _found(table: tuple[np.ndarray, np.ndarray], own: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
    """The values of ``own`` in a table of sorted codes and values, and ``otherwise`` for those that it does not list."""
    codes, value = table
    if not len(codes):
        return np.zeros(len(own)) + otherwise
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    return np.where(codes[at] == own, value[at], otherwise)


@dataclass
class Model:
    """Logs of toxic over ordinary values by sorted codes: the probability of words, the mass left behind a word, and the probability of pairs' last words."""

    words: tuple[np.ndarray, np.ndarray]
    behind: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    curve: np.ndarray | None = None

    def ratios(self, code: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each word in its place; a pair that is not listed has the mass left behind its first word and the last one's probability."""
        backed_off = _found(self.behind, before, 0.0) + _found(self.words, code, 0.0)
        return _found(self.pairs, pair_codes(before, code), backed_off)

    def features(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the curve sees of each text, and its log-likelihood ratio and number of words.

        Those are the ratio by length over the whole text and over its best stretches, and the length.
        """
        code, before, first = word_codes(texts)
        sums = np.concatenate([[0], np.cumsum(self.ratios(code, before))])
        n = np.diff(first)
        total = sums[first[1:]] - sums[first[:-1]]
        columns, full = [total / np.maximum(n, 1)], np.flatnonzero(n)
        for width in STRETCHES:
            size = np.repeat(np.minimum(width, n), n)
            start = np.arange(len(code))
            inside = start + size <= np.repeat(first[1:], n)
            value = np.full(len(code), -np.inf)
            value[inside] = (sums[(start + size)[inside]] - sums[start[inside]]) / size[inside]
            best = np.zeros(len(n))
            if len(full):
                best[full] = np.maximum.reduceat(value, first[:-1][full])
            columns.append(best)
        return np.stack([*columns, np.log1p(n), np.ones(len(n))], axis=1), total, n


def fit(pairs: DataFrame) -> Model:
    """The model of the counts of pairs (``before``, ``code``, and ``n`` as ``count_texts`` packs it)."""
    n = [F.col("n").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("n", 32)]
    summed = pairs.groupBy("before", "code").agg(F.sum(n[0]).alias("n0"), F.sum(n[1]).alias("n1"))
    # One exchange of the pairs serves all three: words, words that others stand behind, and the pairs that are listed.
    none = F.lit(None).cast("long")
    words = summed.groupBy("code").agg(*[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)])
    firsts = summed.groupBy("before").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)])
    parts = words.select(none.alias("before"), "code", "n0", "n1"), firsts.select("before", none.alias("code"), "n0", "n1"), summed.select("before", "code", "n0", "n1")
    table = written(parts[0].unionByName(parts[1].where(F.col("n1") >= RARE)).unionByName(parts[2].where(F.col("n1") >= RARE)), "expressions")
    words = table.where("before is null").select("code", F.col("n0").alias("k0"), F.col("n1").alias("k1"))
    firsts = table.where("code is null").select("before", F.col("n0").alias("s0"), F.col("n1").alias("s1"))
    listed = table.where("before is not null and code is not null")

    common = F.col("k0") + F.col("k1") >= RARE
    total = words.agg(
        F.sum(F.col("k0") + F.col("k1")).alias("all"),
        *[F.sum(F.when(common, F.col(f"k{c}"))).alias(f"k{c}") for c in (0, 1)],
        *[F.sum((common & (F.col(f"k{c}") > 0)).cast("long")).alias(f"v{c}") for c in (0, 1)],
    ).first()
    k, v = ([getattr(total, f"{x}{c}") or 0 for c in (0, 1)] for x in "kv")
    if not all(k):  # a class without common words: no evidence
        return Model(*[(np.zeros(0, np.uint64), np.zeros(0))] * 3)
    shared = (F.col("k0") + F.col("k1")) / F.lit(float(total["all"]))
    kept = [F.greatest(F.col(f"k{c}") - DISCOUNT, F.lit(0.0)) / k[c] * (sum(k) / total["all"]) for c in (0, 1)]
    words = words.select("code", common.alias("common"), *[F.when(common, kept[c] + DISCOUNT * v[c] / k[c] * shared).otherwise(shared).alias(f"p{c}") for c in (0, 1)])

    own = [F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) for c in (0, 1)]
    either = F.col("n0") + F.col("n1") - DISCOUNT
    used = listed.groupBy("before").agg(*[F.sum(own[c]).alias(f"u{c}") for c in (0, 1)], F.sum(either).alias("u"))
    left = [F.when(F.col(f"s{c}") > 0, 1 - F.col(f"u{c}") / F.col(f"s{c}")).otherwise(1.0).alias(f"left{c}") for c in (0, 1)]
    behind = used.hint("merge").join(firsts, "before").select("before", "s0", "s1", *left, (1 - F.col("u") / (F.col("s0") + F.col("s1"))).alias("left"))
    likely = [F.when(F.col(f"s{c}") > 0, own[c] / F.col(f"s{c}")).otherwise(0.0) + F.col(f"left{c}") * (either / (F.col("s0") + F.col("s1")) + F.col("left") * F.col(f"p{c}")) for c in (0, 1)]
    joined = listed.hint("merge").join(words, "code").hint("merge").join(behind, "before")

    def in_order(rows: DataFrame, *names: str) -> tuple[np.ndarray, np.ndarray]:
        found = rows.toArrow()
        codes = [np.asarray(found.column(name)).view(np.uint64) for name in names]
        code = pair_codes(*codes) if len(codes) > 1 else codes[0]
        order = np.argsort(code)
        return code[order], np.asarray(found.column("ratio"))[order]

    return Model(
        in_order(words.where("common").select("code", F.log(F.col("p1") / F.col("p0")).alias("ratio")), "code"),
        in_order(behind.select("before", F.log(F.col("left1") / F.col("left0")).alias("ratio")), "before"),
        in_order(joined.select("before", "code", F.log(likely[1] / likely[0]).alias("ratio")), "before", "code"),
    )


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps on scaled and centred features: centre, scale and weights."""
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1)
        return np.stack([np.zeros(width), np.ones(width), np.append(np.zeros(width - 1), np.log(prior / (1 - prior)))])
    centre, scale = np.append(x[:, :-1].mean(0), 0), np.append(x[:, :-1].std(0) + 1e-9, 1)
    z, w = (x - centre) / scale, np.zeros(width)
    ridge = np.diag([1.0] * (width - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.stack([centre, scale, w])


def apply_curve(curve: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(((x - curve[0]) / curve[1]) @ curve[2], -30, 30)))


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def maybe_labelled(texts: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``_id`` may be one of ``labelled``; a join decides, this only spares its shuffle.

    A bit for each hash of a labelled id, in rows of 4 KB: at most ``FILTER_BITS`` bits are broadcast.
    """
    key = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS))
    bits = labelled.groupBy(F.bitmap_bucket_number(key).alias("_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("_bits"))
    at = F.bitmap_bit_position(key).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1
    return texts.withColumn("_row", F.bitmap_bucket_number(key)).join(F.broadcast(bits), "_row").where(hit).select(*texts.columns)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Counts over all labelled rows of folds 0 and 1, then the curve on rows of fold 3."""
    spark = docs.sparkSession
    labelled = labels.select(labels[id_col].try_cast(docs.schema[id_col].dataType).alias("_id"), labels[label_col].cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            before, code, n = count_texts(as_text(batch.column("_text")), np.asarray(batch.column("_y")))
            yield pa.RecordBatch.from_arrays([pa.array(before.view(np.int64)), pa.array(code.view(np.int64)), pa.array(n)], ["before", "code", "n"])

    # A sort-merge join whatever the size of the labels: what is shuffled follows the labelled part of the input.
    learnt = labelled.where(fold(F.col("_id")) < 2)
    counted = maybe_labelled(texts.where(fold(F.col("_id")) < 2), learnt).hint("merge").join(learnt, "_id").select("_y", "_text")
    with scratch(spark):
        model = fit(counted.mapInArrow(count, "before long, code long, n long"))
    sample = labelled.where(fold(F.col("_id")) == 3).orderBy(F.xxhash64("_id"), "_id", "_y").limit(CALIBRATION_ROWS)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            x, _, _ = shared.value.features(as_text(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("_y")], ["x", "y"])

    judged = texts.join(F.broadcast(sample), "_id").select("_y", "_text").mapInArrow(judge, "x array<double>, y int").toArrow().to_pylist()
    shared.unpersist()
    judged.sort(key=lambda r: (r["x"], r["y"]))
    model.curve = fit_curve(np.array([r["x"] for r in judged]).reshape(len(judged), len(STRETCHES) + 3), np.array([r["y"] for r in judged], float))
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with its ``log_ratio``, ``n_words`` and ``score``. No shuffle.

    ``text_col`` may be a field of a kept struct (``row.text``); the texts then go to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    path = text_col.split(".") if text_col not in docs.columns else [text_col]
    inside = path[0] in keep

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_kept") if inside else batch.column("_text")
            for name in path if inside else ():
                text = text.field(name)
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), text], ["_kept", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(with_text(batches), "_text", SLICE):
            x, ratio, n = shared.value.features(as_text(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(ratio), pa.array(n.astype(np.int64)), pa.array(apply_curve(shared.value.curve, x))], ["_kept", "_ratio", "_n", "_score"])

    picked = docs.select(F.struct(*[docs[c] for c in keep]).alias("_kept"), *([] if inside else [docs[text_col].alias("_text")]))
    out = picked.mapInArrow(run, f"_kept {picked.schema['_kept'].dataType.simpleString()}, _ratio double, _n long, _score double")
    return out.select("_kept.*", F.col("_ratio").alias("log_ratio"), F.col("_n").alias("n_words"), F.col("_score").alias("score"))
