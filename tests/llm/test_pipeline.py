"""The pipeline's stages against what they promise, and its result whole."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import common, decontam, quality, secret_scan, simhash_dedup, tokens

from ..conftest import SF
from .test_llm import AWKWARD, check_packing, edit_distance_in


def five_words(text: str | None) -> set[bytes]:
    words = simhash_dedup.words_of(text)
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = common.keep(stage(spark, before, SF))
        kept[name] = before
        if name != "packing":
            assert before.columns == docs.columns
    # quality: what goes scores low
    machine = quality.train(docs, common.table(spark, SF, "labels"))
    scored = quality.with_scores(docs, machine)
    assert {r.doc_id for r in scored.where("score >= 0.7").collect()} == {r.doc_id for r in kept["quality"].collect()}
    # near copies: one of each group, by brute force
    rows = {r.doc_id: r.text for r in kept["quality"].collect()}
    sets = {i: five_words(t) for i, t in rows.items()}
    left, ids = set(), sorted(rows)
    seen = {}
    for i in ids:
        group, queue = {i}, [i]
        if i in seen:
            continue
        while queue:
            x = queue.pop()
            for y in ids:
                if y not in group and alike(sets[x], sets[y]) >= 0.8:
                    group.add(y)
                    queue.append(y)
        left.add(min(group))
        seen |= dict.fromkeys(group, min(group))
    assert {r.doc_id for r in kept["near_dedup"].collect()} == left
    # decontamination: no passage is left, and what went has one
    items = [r.text.lower().split() for r in common.table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    for i in left - set(clean):
        words = rows[i].lower().split()
        assert any(edit_distance_in(item, words) <= decontam.edits_allowed(len(item), 0.2) for item in items)
    assert not any(r.text in t for t in clean.values() for r in common.table(spark, SF, "benchmark").collect())
    # secrets: masked, nothing else changed
    safe = {r.doc_id: r for r in kept["secrets"].collect()}
    for i, t in clean.items():
        assert safe[i].text == secret_scan.masked(t, secret_scan.find(t)) and safe[i].n_chars == len(safe[i].text)
    # packing: whole documents in sequences
    packed = kept["packing"].collect()
    check_packing(packed, 1024)
    library = tokens.library(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in safe.values())
    assert {r.doc_id for r in packed} == set(safe)


def test_near_dedup_keeps_texts_that_share_an_id(spark):
    copy = "one two three four five six"
    rows = [(1, copy, "en", "s", 1)] * 2 + [(5, copy, "en", "s", 1), (5, "a text of its own under the same id", "en", "s", 1), (None, copy, "en", "s", 1), (None, "seven", "en", "s", 1), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup_stage(spark, df, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, copy), (5, "a text of its own under the same id"), (None, "seven"), (3, None)], key=str)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names, and no rows at all, through all stages."""
    rows = [*AWKWARD, (11, "word another " * 60_000, "en", "s", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("score", "k1", "n", "grp", "words", "_score", "a.b", "x`y", "c0", "text.length")})
    for df in (odd, odd.limit(0)):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality" and docs.isEmpty() is False:  # whatever the score, all go on to the next stage here
                assert stage(spark, docs, SF).columns == docs.columns
                continue
            docs = common.keep(stage(spark, docs, SF))
            assert name == "packing" or docs.columns == df.columns
        assert docs.where("piece = 0").count() == (0 if df.isEmpty() else len({(t or "").strip() for _, t, *_ in rows}))


def test_run_gives_what_the_stages_give(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 50
    assert np.isfinite(got.agg({"sequence_id": "max"}).first()[0])
