"""The pipeline's stages on the smallest tables, each on its own input, against brute-force versions."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_small import brute_dedup, brute_links, brute_secrets
from tilefold.llm import packing, secret_scan, toxicity
from tilefold.llm.common import table, written


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """(stage, input, output) with every output stored."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), name, lasting=True)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps, spark, sf_dir):
    names = table(spark, sf_dir, "documents").columns
    assert all(after.columns == names for name, (_, after) in steps.items() if name != "packing")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "jaccard_join", "suffix_dedup", "secret_scan", "packing"]


def test_toxicity(spark, sf_dir, steps):
    before, after = steps["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.score(before, toxicity.train(before, table(spark, sf_dir, "labels"))).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, s in scores.items() if s < pipeline.TOXIC)
    kept = by_id(after)
    assert all(kept[d] == r for d, r in by_id(before).items() if d in kept)


def test_near_duplicates(steps):
    before, after = steps["jaccard_join"]
    rows = by_id(before)
    expected = [d for d, _, c in brute_links([(d, r.text or "") for d, r in rows.items()], 5, 80) if d == c]
    assert sorted(r.doc_id for r in after.collect()) == sorted(expected) and len(expected) < len(rows)
    assert all(rows[d] == r for d, r in by_id(after).items())


def test_repeats(steps):
    before, after = (by_id(x) for x in steps["suffix_dedup"])
    assert set(before) == set(after)
    cut = {d: (n, runs) for d, n, runs, _ in brute_dedup([(d, r.text or "") for d, r in before.items()])}
    for d, r in before.items():
        raw, gone = (r.text or "").encode(), {i for a, b in cut[d][1] for i in range(a, b)}
        at, text = 0, []
        for c in r.text or "":
            size = len(c.encode())
            if not all(at + k in gone for k in range(size)):
                text.append(c)
            at += size
        assert at == len(raw) and (after[d].text or "") == "".join(text)


def test_secrets(steps):
    before, after = (by_id(x) for x in steps["secret_scan"])
    for d, r in before.items():
        spans = [s for s in secret_scan.scan_texts([r.text or ""])[0]]
        assert [s for s in spans if s[0] in secret_scan.BASE_KINDS] == brute_secrets(r.text or "")
        assert (after[d].text or "") == secret_scan.redact(r.text or "", spans)
        if not spans:
            assert after[d] == r


def test_packing(steps, spark, sf_dir):
    before, after = steps["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes, used = {d: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in by_id(before).items()}, defaultdict(int)
    sequences = defaultdict(int)
    for p in after.collect():
        used[p.doc_id] += p.length
        sequences[p.sequence_id] += p.length
    assert used == sizes
    lengths = np.array(list(sequences.values()))
    assert lengths.max() <= packing.WINDOW and not (lengths & (lengths - 1)).any()


def odd_rows(spark):
    """Nulls, empty and repeated rows, an id of two texts, links through a null id, and columns named like results."""
    words = [f"word{i}" for i in range(120)]
    one, two, other = " ".join(words), " ".join(["start", *words]), " ".join(f"other{i}" for i in range(60))
    bridge = [" ".join(words[:100] + [f"new{k}{i}" for i in range(k)]) for k in (0, 9, 18)]  # neighbours are alike, the ends are not
    rows = [(1, one), (5, one), (5, other), (7, "repeated row of its own words " * 3), (7, "repeated row of its own words " * 3), (8, None), (8, None), (9, ""), (None, two), (10, "password=abcdefgh1 x")]
    rows += [(20, " ".join(f"b{w}" for w in bridge[0].split())), (None, " ".join(f"b{w}" for w in bridge[1].split())), (22, " ".join(f"b{w}" for w in bridge[2].split()))]
    names = ["lang", "source", "n_chars", "spans", "kept", "n_bytes", "score", "n_words", "row", "redacted"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} {'long' if n == 'n_chars' else 'string'}" for n in names)
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *"abcdefg") for d, t in rows], schema)


def test_stages_on_odd_rows(spark, sf_dir):
    docs = odd_rows(spark).repartition(3)
    kept = {name: stage(spark, docs, sf_dir) for name, stage in pipeline.STAGES[1:2]}["jaccard_join"].collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept) == [(1, "word0"), (5, "other"), (7, "repea"), (8, ""), (8, ""), (9, ""), (10, "passw"), (20, "bword")]
    assert all((r.spans, r.kept, r.row) == ("a", "b", "f") for r in kept)
    for name, stage in pipeline.STAGES[:-1]:
        if name != "jaccard_join":
            after = stage(spark, docs, sf_dir)
            assert after.columns == docs.columns
            rows = after.collect()
            assert len(rows) == 13 and sum(r.text is None for r in rows) == 2
            assert all((r.spans, r.n_bytes, r.score, r.row, r.redacted) == ("a", "c", "d", "f", "g") for r in rows)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0


def test_results_outlive_other_runs(spark, sf_dir):
    """What one operator's lazy result reads is not deleted by another's run."""
    from tilefold.llm import jaccard_join, queries

    docs = odd_rows(spark)
    linked, packed = jaccard_join.link_documents(docs, pipeline.NEAR), queries.packed_pieces(docs)
    assert pipeline.cut_repeats(spark, docs, sf_dir).count() == 13 and pipeline.redact_secrets(spark, docs, sf_dir).count() == 13
    assert linked.count() == 13 and packed.select("doc_id").count() >= 13
    ids = {r.doc_id: r.component_id for r in linked.collect() if r.doc_id in (20, 22)}
    assert ids == {20: 20, 22: 20}  # linked through a row without an id


def test_stages_leave_each_other_alone(spark, sf_dir):
    """A held stage result survives later stages, runs and threads; an owner can delete what it reads."""
    import os
    from threading import Thread

    from tilefold.llm.common import delete, recorded

    docs = odd_rows(spark)
    a = pipeline.drop_near_duplicates(spark, docs, sf_dir)
    pipeline.redact_secrets(spark, docs, sf_dir)
    other = Thread(target=lambda: pipeline.cut_repeats(spark, docs, sf_dir).count())
    mine: list[str] = []
    with recorded(mine):
        b = pipeline.cut_repeats(spark, docs, sf_dir)
        other.start()
        other.join()
    held = [p for p in mine if not p.startswith("table ")]
    assert a.count() == 8 and b.count() == 13
    alive = [p for p in held if os.path.exists(p)]
    assert len(alive) == 2 and not any("lists" in p for p in alive)  # blocks and what goes, of this call alone
    delete(spark, mine)
    assert not any(os.path.exists(p) for p in held) and a.count() == 8
