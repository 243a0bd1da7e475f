"""The corpus pipeline, stage by stage and as a whole, on a small table."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(9)
    word = lambda v: "".join(rng.choice(c) for c in ("bdklmn", v, "rst"))
    line = lambda v, n: " ".join(word(v) for _ in range(n))
    rows = []
    for i in range(60):
        v, lang = ("ao", "xx") if i % 2 else ("éi", "yy")
        rows.append([i, "\n".join(["SUBSCRIBE NOW", *(line(v, 12) for _ in range(5))]), lang, "s1"])
    copied = line("ao", 80)
    rows += [[60, copied, "xx", "s2"], [61, copied, "xx", "s2"], [62, copied + " " + line("ao", 2), "xx", "s3"]]
    rows += [[63, "12345 !!! 678", "xx", "s3"], [64, None, "xx", "s3"], [65, "", None, None]]
    rows += [[66, line("éi", 30) + ' password = "abcdefabcdef0123"', "yy", "s2"]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, folder)
    assert kept.columns == COLUMNS and {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()} == {63, 64, 65}
    lines = stages["line_dedup"](spark, kept, folder)
    texts = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == COLUMNS and lines.count() == kept.count()
    assert all("SUBSCRIBE" not in r["text"] and r["n_chars"] == len(r["text"]) for r in texts.values())
    single = stages["ngram_jaccard_join"](spark, lines, folder)
    assert {r[0] for r in lines.select("doc_id").collect()} - {r[0] for r in single.select("doc_id").collect()} == {61, 62}
    clean = stages["secret_scan"](spark, single, folder)
    assert clean.columns == COLUMNS and clean.where("doc_id = 66").first()["text"].endswith('[assign]"')
    assert clean.where("doc_id <> 66").exceptAll(single.where("doc_id <> 66")).isEmpty()


def test_language_id_rejects_texts_rather_than_ids(spark):
    rows = [(0, "bad dab lad", None), (1, "12345 !", None), (2, None, None), (3, "", None), (3, "kad nad bal", None), (None, "mar dar", None), (None, "77", None)]
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    clean = sorted(t for _, t, _ in rows if t and any(map(str.isalpha, t)))
    for lang in (None, "xx"):
        docs = spark.createDataFrame([(i, t, lang) for i, t, _ in rows], "doc_id long, text string, lang string")
        assert sorted(r["text"] for r in stage(spark, docs, "").collect()) == clean


def test_language_id_rejects_other_languages_and_names_the_rest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = random.Random(4)
    foreign = " ".join("".join(rng.choice("гджзклмнпрстфхцчшщ") for _ in range(7)) for _ in range(40))
    own = docs.where("doc_id = 8").first()["text"]
    more = spark.createDataFrame([(900, foreign, None, "s1", 1), (901, own, None, "s1", 1), (902, "Ж", None, "s1", 1)], docs.schema)
    got = {r["doc_id"]: r["lang"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(more), folder).where("doc_id >= 900").collect()}
    # A short text says too little to be rejected.
    assert got.keys() == {901, 902} and got[901] == "yy" if docs.where("doc_id = 8").first()["lang"] == "yy" else got[901] == "xx"


def test_near_copies_of_a_dense_group_keep_their_lines(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("bdklmnaoei") for _ in range(5)) for _ in range(12))
    shared = [line() for _ in range(12)]
    copies = ["\n".join(shared)] * 10 + ["\n".join([*shared, "READ MORE", line()]) for _ in range(10)]
    others = ["\n".join(["READ MORE", *(line() for _ in range(4))]) for _ in range(40)]
    quoting = "\n".join([shared[0], *(line() for _ in range(4))])
    rows = [(i, t, "xx", "s", len(t)) for i, t in enumerate([*copies, *others, quoting])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, "")
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t.replace("READ MORE\n", "") for i, t, *_ in rows}
    assert {r[0] for r in stages["ngram_jaccard_join"](spark, lines, "").select("doc_id").collect()} == {0, *range(20, 61)}


def test_run_packs_what_is_left(spark, folder):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert set(packed.doc_id) == set(range(61)) | {66}
    tokenizer = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    text = next(t for i, t, *_ in corpus() if i == 7).replace("SUBSCRIBE NOW\n", "")
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    for r in packed[packed.doc_id == 7].itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
