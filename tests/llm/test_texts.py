"""Operators on documents against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from vigilframe.llm import fingerprints, jaccard_join, language_id, license_scan, line_dedup, packing, secret_scan, sentencepiece_codec, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, label int, bucket int, count long"


def docs(spark, texts):
    """Documents with further columns whose names operators might use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


EDGE = [(0, None), (1, ""), (2, "word"), (3, "a b c d"), (4, "same text here again now"), (5, "same text here again now"), (5, "same text here again now"), (None, "no id at all here"), (7, "é日本 🎉 x" * 3), (8, "long " * 30_000), (9, "   \n\t\n ")]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# op1


def test_line_dedup_drops_what_a_site_repeats(spark):
    rows = [(i, "hot" if i < 8 else "cold", f"head\nown {i}\n\nhead\n tail ", 1) for i in range(10)] + [(10, None, "head\nx", 1), (11, "hot", None, 1), (12, "hot", "", 1)]
    pages = spark.createDataFrame(rows, "id int, host string, text string, n int")
    for most in (100_000, 0):
        got = {r["id"]: r for r in line_dedup.drop_site_lines(pages, "host", "text", 0.5, 3, most, ("before", "gone")).collect()}
        assert got[0]["text"] == "own 0\n" and (got[0]["before"], got[0]["gone"]) == (4, 3)
        # Two pages are too few for a site's line to count as boilerplate.
        assert got[8]["text"] == "head\nown 8\n\nhead\n tail " and got[8]["gone"] == 0
        assert got[10]["text"] == "head\nx" and got[11]["text"] is None and got[12]["text"] == ""
        assert len(got) == len(rows)
    assert line_dedup.drop_site_lines(pages.limit(0), "host", "text").count() == 0


def test_line_dedup_may_keep_whole_copies(spark):
    pages = spark.createDataFrame([(i, "h", "copy\ncopied" if i < 5 else f"copy\nown {i}") for i in range(8)], "id int, host string, text string")
    got = {r["id"]: r["text"] for r in line_dedup.drop_site_lines(pages, "host", "text", 0.3, 3, keep_whole=True).collect()}
    assert got[0] == "copy\ncopied" and got[7] == "own 7"


def test_line_dedup_at_the_ratio(spark):
    rows = [(i, "h", "x\ny" if i < 5 else "y") for i in range(10)]
    pages = spark.createDataFrame(rows, "id int, host string, text string")
    got = {r["id"]: r["text"] for r in line_dedup.drop_site_lines(pages, "host", "text", 0.5, 3).collect()}
    # Exactly half is not more than half.
    assert got[0] == "x" and got[9] == ""


# op2


def test_spans_and_extensions_equal_brute_force():
    rng = random.Random(3)
    a = "".join(rng.choice("abé") for _ in range(300))
    b = a[100:250] + "zz" + a[:50]
    x, y = fingerprints.prefixes(a), fingerprints.prefixes(b)
    for _ in range(500):
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randint(1, min(len(a) - i, len(b) - j, 6))
        assert (fingerprints.span_hash(x, i, n)[0] == fingerprints.span_hash(y, j, n)[0]) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert fingerprints.common_extension(x, i, y, j) == k
    assert (fingerprints.spliced(x, 70, y, 33) == fingerprints.prefixes(a[:70] + b[:33])).all()


def test_fingerprints_of_edits(spark):
    rng = random.Random(5)
    texts = [(3 * i, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 1, 3, 40, 900])))) for i in range(60)] + [(400, None), (401, "日本" * 50), (402, "日本" * 50)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs(spark, texts), buckets=7).collect()}
    order = [(i, t or "") for i, t in sorted(texts)]
    assert len(got) == len(texts)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        edit = t[: len(t) - k] + after[:k]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(fingerprints.prefixes(t)) and r["edited_fingerprint"] == fingerprints.fingerprint(fingerprints.prefixes(edit))
        common = next((n for n, (a, b) in enumerate(zip(t, edit)) if a != b), min(len(t), len(edit)))  # noqa: B905
        assert r["shared_prefix"] == common and 0 <= r["near_next"] <= 1
        grams = lambda s: {s[j : j + 16] for j in range(max(1, len(s) - 15))}
        if len(t) > 500:
            assert abs(r["near_edited"] - len(grams(t) & grams(edit)) / len(grams(t) | grams(edit))) < 0.25
    assert got[401]["fingerprint"] == got[402]["fingerprint"] and got[401]["near_next"] == 1.0


def test_an_edit_shares_the_spans_before_it():
    """Hashes of spans that an edit leaves alone are the text's own, not computed again."""
    some = random.Random(4)
    for n in (*range(40), 300):
        a, b = ("".join(some.choice("ab é") for _ in range(size)) for size in (n, 37))
        k = min(n // 4, len(b))
        m = n - n // 4
        g, edit = fingerprints.prefixes(a), fingerprints.prefixes(a[:m] + b[:k])
        assert (fingerprints.mixed_edit(fingerprints.mixed(g), m, edit) == fingerprints.mixed(edit)).all()
        assert fingerprints.fingerprint(edit, fingerprints.mixed(edit)) == fingerprints.fingerprint(edit)


def test_fingerprints_edge_cases(spark):
    assert fingerprints.fingerprint_edits(docs(spark, EDGE), buckets=3).count() == len(EDGE)
    assert fingerprints.fingerprint_edits(empty(spark), buckets=3).count() == 0
    only = fingerprints.fingerprint_edits(docs(spark, [(1, "abcdefgh")]), buckets=3).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


# op4

TOKEN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in TOKEN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_equal_brute_force():
    rng = random.Random(1)
    bits = ["password", "Token", "api_key", "apikey", "ſecret", "toKen", "=", ": ", '"', "'", " ", "abcdefabcdef0123", "AKIA", "ABCDEFGH12345678", "deadbeef", "x", "é", "=="]
    for _ in range(3_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert [s for s in secret_scan.spans_of(text) if s[1] < secret_scan.BASE] == plain_spans(text), text


def test_every_language_is_learned(spark):
    texts = [(4 * i, " ".join(chr(0x4E00 + 7 * k + d) * 3 for d in range(6)), f"l{k:03}") for i, k in enumerate([k for k in range(104) for _ in range(3)])]
    rows = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    assert model.languages == tuple(sorted({lang for i, _, lang in texts if zlib.crc32(str(i).encode()) % 4 != 2})) and len(model.languages) > 100
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(rows, model).collect()}
    assert all(got[i] == lang for i, _, lang in texts if lang in model.languages)


def test_weak_parts_have_no_longest_length():
    opaque, account = "aB3" * 100, "user" * 40
    text = f"AKIA{'Q' * 16} {opaque} login={account} x"
    found = {secret_scan.KINDS[k]: text[a:b] for a, k, b in secret_scan.spans_of(text)}
    assert found["opaque"] == opaque and found["account"] == f"login={account}"
    linked = ",".join(f"{a}:{k}:{b}" for a, k, b in secret_scan.spans_of(text) if k >= secret_scan.BASE)
    assert secret_scan._replaced(text, linked) == "[access] [opaque] [account] x"


def test_weak_parts_need_their_complements(spark):
    opaque, key = "Zx9kQ2mW8vB4nL7pR1tY6sD3" + "fG5", "AKIA" + "Q" * 16
    texts = [
        (0, f"login: bob {opaque}"),
        (1, f"just {opaque} alone"),
        (2, f"{key} and {opaque} at https://db.example.com"),
        (3, "see https://db.example.com and user = bob"),
        (4, f"{opaque} " + "y " * 200 + f"{key}"),
        (5, f"user=bob " + "y " * 20 + "password=hunter2hunter2"),
    ]
    got = {r["doc_id"]: [secret_scan.KINDS[s["kind"]] for s in r["spans"]] for r in secret_scan.scan(docs(spark, texts)).collect()}
    assert got == {0: ["account", "opaque"], 1: [], 2: ["access", "opaque", "endpoint"], 3: [], 4: ["access"], 5: ["account", "assign"]}


def test_linking_equals_all_pairs(spark):
    rng = random.Random(5)
    parts = ["AKIA" + "Z9" * 8, "password=abcdefgh1234", "login: someone", "https://host.example:80", "aB3" * 9, "user=x" + "y" * 300, "0a" * 10]
    texts = [(i, "".join(" " * rng.choice([1, 20, 90]) + rng.choice(parts) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows = secret_scan.scan(docs(spark, texts)).collect()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows}
    links = {r["doc_id"]: {tuple(s)[:3]: s["with"] for s in r["links"]} for r in rows}
    wanted = {3: lambda r: 2 in r, 4: lambda r: 1 in r, 5: lambda r: {1, 2} <= r}
    role = {0: 2, 1: 1, 2: 2, 3: 1, 4: 2, 5: 4}
    for i, text in texts:
        spans = secret_scan.spans_of(text)
        near = lambda s: {role[k] for a, k, b in spans if a - s[2] <= 200 and s[0] - b <= 200}  # noqa: B023, E731
        assert got[i] == [s for s in spans if s[1] < 3 or wanted[s[1]](near(s))], text
        # Each reported span tells the kinds of the complementary parts in its scope.
        needs = {1: {0, 2, 4}, 3: {0, 2, 4}, 0: {1, 3}, 2: {1, 3}, 4: {1, 3}, 5: {0, 1, 2, 3, 4}}
        beside = {s: {k for a, k, b in spans if k in needs[s[1]] and a - s[2] <= 200 and s[0] - b <= 200} for s in got[i]}
        assert links[i] == {s: sum(1 << k for k in kinds) for s, kinds in beside.items() if kinds}, text


def test_redaction_keeps_rows_and_columns(spark):
    rows = docs(spark, [*EDGE, (20, "é password=abcdefabcdef0123 end"), (21, "login: bob and password=abcdefabcdef0123")])
    out = secret_scan.redact(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    assert out.where("doc_id = 20").first()["text"] == "é [assign] end"
    assert out.where("doc_id = 21").first()["text"] == "[account] and [assign]"
    assert out.where("doc_id = 4").first()["text"] == "same text here again now" and out.where("doc_id = 0").first()["text"] is None
    assert secret_scan.redact(empty(spark)).count() == 0 and secret_scan.scan(empty(spark)).count() == 0


# op5


def speech(seed, vowels):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(c) for c in ("bdklmn", vowels, "rst")) for _ in range(40))


def test_languages_are_told_apart(spark):
    rows = [(i, speech(i, "ao" if i % 2 else "éi"), "xx" if i % 2 else "yy") for i in range(200)]
    table = spark.createDataFrame([*rows, (300, None, "xx"), (301, "123 !!", "xx"), (302, speech(1, "ao"), None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(table, language_id.fit(table, per_language=60, landmarks=16)).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert (got[300]["lang_pred"], got[300]["score"], got[301]["lang_pred"], got[302]["lang_pred"]) == ("und", 0.0, "und", "xx")


def test_language_edge_cases(spark):
    table = docs(spark, EDGE)
    assert language_id.predict(table, language_id.fit(table)).count() == len(EDGE)
    nothing = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(table, nothing).collect()} == {"und"}


def test_folded_scores_equal_the_kernel():
    texts = [speech(i, "ao" if i % 2 else "éi") for i in range(12)]
    rows = [language_id.presence(t) for t in texts]
    for a, b in combinations(rows[:4], 2):
        kernel = (a & b).sum() / np.sqrt(a.sum() * b.sum())
        assert 0 <= kernel <= 1
    grams = {t[i : i + n].lower() for t in texts[:1] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert abs(int(rows[0].sum()) - len(grams)) <= 2


# op6


def near_copies(seed, groups=12, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 14, 30, words]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy) + (" " + passage if g % 3 == 0 else ""))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def by_brute_force(texts):
    sets = {i: set(jaccard_join.shingles(t).tolist()) for i, t in texts}
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("sizes", [{}, {"pairwise": 2, "block": 4}])
def test_components_equal_brute_force(spark, sizes):
    texts = near_copies(4)
    got = jaccard_join.components(docs(spark, texts).repartition(6), **sizes).collect()
    want, sizes_ = by_brute_force(texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes_


def test_components_do_not_depend_on_batches(spark):
    texts = [*near_copies(11), *((10_000 + i, t) for i, t in near_copies(11)[:20])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = jaccard_join.components(docs(spark, texts).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"]: r["component_id"] for r in got} == by_brute_force(texts)[0]


def test_repeated_ids_lose_no_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    kept = jaccard_join.deduplicate(docs(spark, [(4, a), (5, a), (5, b)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5]


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for n in [*range(5, 40), 77, 150, 400, 1500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            d = rng.integers(0, n // 5 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[d:]], rng.integers(0, 2**63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)]))
            if jaccard_join.similar(a, b, 80) and len(np.setxor1d(a, b)):
                assert np.isin(jaccard_join.signatures(a), jaccard_join.signatures(b)).any(), (n, d)


def test_jaccard_edge_cases(spark):
    got = jaccard_join.components(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} >= {(0, 0, 0), (1, 0, 1), (2, 1, 2), (4, 1, 4), (5, 1, 4), (9, 0, 9)}
    assert jaccard_join.components(empty(spark)).count() == 0
    kept = jaccard_join.deduplicate(docs(spark, EDGE))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 7, 8, 9] and kept.where("doc_id is null").count() == 1


# op7

MODEL = None


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, float):
        import struct

        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model():
    """A small unigram model with byte fallback, written field by field."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -float(i) / 3 - 1, 1) for i, p in enumerate(["▁", "▁the", "he", "t", "h", "e", "▁t", "cat", "c", "a", "at", "▁cat", "s", "▁s"])]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2)
    return data + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


TEXTS = ["the cat sat", "  the   cats ", "é the 🎉", "", "t", "cat\nthe\ttc", "▁the cat", "the the " * 50]


def test_unigram_models_have_parity():
    from sentencepiece import SentencePieceProcessor

    data = unigram_model()
    tokenizer, processor = sentencepiece_codec.build(data), SentencePieceProcessor(model_proto=data)
    for text in TEXTS:
        assert tokenizer.encode(text, add_special_tokens=False).ids == processor.encode(text) or not text


def test_bpe_model_has_parity_and_round_trips(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    texts = [*EDGE, *enumerate(TEXTS, 100)]
    got = sentencepiece_codec.encode_decode(docs(spark, texts), tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(texts) and all(r["same_word_ids"] for r in got)
    # The marker itself stands for a blank, so a text that holds it comes back with blanks.
    assert all(r["round_trip"] or r["doc_id"] == 106 for r in got)
    assert sentencepiece_codec.encode_decode(empty(spark), tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_markers_in_texts_keep_parity():
    tokenizers = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    path, rng = tokenizers.path("piece_bpe_32k.model"), random.Random(4)
    texts = ["".join(rng.choice(["a", "▁", " ", "the", "é", "\n", "<s>", "日"]) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    got, same = sentencepiece_codec.encode(texts, sentencepiece_codec._loaded(path, 1), 1)
    want = SentencePieceProcessor(model_file=path).encode(texts)
    assert all(same) and [np.frombuffer(g, "<u4").tolist() for g in got] == want


# op8


def test_packing_covers_every_id_once(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    texts = [*EDGE, *((100 + i, " ".join(rng.choice(["The", "cat's", "sat.", "naïve,", "x1y", "don't", "<|endoftext|>", "ΣΑΣ", "İx", "é.", "a b"]) for _ in range(rng.randint(0, 900)))) for i in range(80))]
    pieces = packing.pack(docs(spark, texts).repartition(5), path).toPandas()
    whole = Tokenizer.from_file(path)
    ids = {}
    for i, t in texts:
        ids[i] = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    for i, part in pieces.groupby("doc_id"):
        if i == 5:
            continue
        part = part.sort_values("start")
        assert part.start.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() == len(ids[i]) == part.doc_tokens.iloc[0]
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    assert set(pieces.doc_id.dropna()) == {i for i, _ in texts if i is not None} and (pieces[pieces.doc_id == 5].start == 0).sum() == 2
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        total = int(part.length.sum())
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and total <= 2048 and total & (total - 1) == 0
    assert packing.pack(empty(spark), path).count() == 0
    # Most documents stay whole.
    assert len(pieces) < 2 * len(texts)


def test_different_chunks_are_looked_up_and_encoded_once():
    tokenizers = pytest.importorskip("public_tokenizers")
    from vigilframe.llm.common import Known

    class Counted(dict):
        gets = 0

        def get(self, *a):
            self.gets += 1
            return super().get(*a)

    words, known = ["sat", "naïve", "entionblein"], Known()
    held = known.young = Counted()
    got = packing.encode_by_chunk([" ".join(w + m for w in [*words, *map(str.capitalize, words)] for m in ("", ".", ",", "!?"))] * 50, tokenizers.path("word_bpe_49k.json"), known)
    # Small and capital letters and marks make no further chunks, and a chunk is looked up once for all its 1,200 places.
    assert set(held) == {*words, ".", ",", "!?"} and held.gets == 6 and len(set(got)) == 1


def test_chunks_give_the_ids_of_whole_texts():
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from vigilframe.llm.common import Known

    path, rng, known = tokenizers.path("word_bpe_49k.json"), random.Random(7), Known(300)
    plain = ["The", "CAT's", "'LL,", "don't,", "\u2019s", "a_b.c", "x1y,", "1,", "NA\u00cfVE,", "\u00df", "a\u00d7b", "A.B.", "(X)", "&&&", "\u0130x", "\u03a3\u0391\u03a3", "\u65e5", "\u212a", "\ufb01", "\x00", "\x85", "", " ", "\n", "\t", "\u00a0", "\u2028"]
    # Composed with what stands before them, also across another mark; added tokens, which are not such in capitals.
    odd = ["\u0301", "\u0331", "\u20d2", "\u0338", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rng.choice(atoms) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 20))) for atoms in (plain, plain + odd) for _ in range(3000)]
    got = [x for at in range(0, len(texts), 50) for x in packing.encode_by_chunk(texts[at : at + 50], path, known)]
    want = Tokenizer.from_file(path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [want.encode(t, add_special_tokens=False).ids for t in texts]


def test_classes_take_whole_documents():
    packer = packing.Packer(64, 0)
    for i in range(6):
        packer.add((i, 0, bytes(4 * 20), 20))
    packer.add((6, 0, bytes(4 * 4), 4))
    # Twenty tokens are of class 3: three documents a sequence, and a later one that fits in the gap.
    assert [(r[0], r[2], r[5], r[6]) for r in packer.taken()] == [(0, 20, 0, 0), (1, 20, 0, 20), (2, 20, 0, 40), (6, 4, 0, 60)]
    packer.end()
    # What is open at a worker's end, sixty tokens here, is cut at powers of two, so that nothing is padded.
    rest = packer.taken()
    sizes: dict[int, int] = {}
    for doc, start, length, _, _, number, at in rest:
        assert sizes.get(number, 0) == at
        sizes[number] = at + length
    assert sorted(sizes.values()) == [4, 8, 16, 32] and [sum(r[2] for r in rest if r[0] == d) for d in (3, 4, 5)] == [20, 20, 20]


# op9


def plain_features(text):
    """The features by their definitions, one word at a time."""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”’‘…–—"
    words = "".join(" " if c in marks else c for c in text.lower()).split()
    places = [i for i, w in enumerate(words) if w in toxicity.LEXICON]
    near = [i for i in places if any(0 <= j < len(words) and words[j] in toxicity.SECOND for j in range(i - 6, i + 7))]
    n, size = len(words) or 1, len(text) or 1
    runs = sum(a != b and b == c for a, b, c in zip(" " + text, text, text[1:], strict=False) if b in "!?#$%&*.")
    shouted = [w for w in text.split() if w.isupper() and len(w) > 2]
    ascii_marks = [c for c in text if c in marks and c.isascii()]
    capitals = [c for c in text if c.isupper() and ord(c) < 0x250]
    return {"words": len(words), "hits": len(places), "hit_share": len(places) / n, "hit_kinds": len({words[i] for i in places}), "near_share": len(near) / (len(places) or 1), "near_hits": len(near), "capitals": len(capitals) / size, "shouted": len(shouted) / n, "exclaims": text.count("!") / size, "questions": text.count("?") / size, "marks": len(ascii_marks) / size, "repeats": runs / n, "word_length": sum(map(len, words)) / n}


def test_toxicity_features_equal_plain_ones():
    rng = random.Random(8)
    some = ["You", "idiot!!", "IDIOT", "the", "cat's", "moron.", "DU", "«dumm»", "...", "?!", "Élan", "a" * 40, "$$$", "your", "ok"]
    for text in ["", "!", "LOUD WORDS " * 3, *(" ".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(200)), "calm " * 150_000 + "LOUD"]:
        got = dict(zip(toxicity.NAMES, toxicity.features(text), strict=True))
        want = plain_features(text)
        assert {k: got[k] for k in want} == pytest.approx(want), text[:80]


def test_toxicity_learns_one_text_of_an_id(spark):
    rows = [(i, t) for i in range(40) for t in (["a calm text", "you stupid idiot"] if i == 3 else [f"you idiot {i}" if i % 2 else f"calm {i}"])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    both = [sorted(map(tuple, toxicity.score(docs(spark, x), labels).collect())) for x in (rows, rows[::-1])]
    assert both[0] == both[1]


def test_toxic_texts_score_higher(spark):
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice(["river", "stone", "green", "walks", "house", "the", "of"]) for _ in range(60))
    bad = lambda: clean() + " you idiot, " + clean() + " worthless m0ron you clown " + clean()
    rows = [(i, bad() if i % 4 == 0 else clean()) for i in range(400)]
    labels = spark.createDataFrame([*((i, int(i % 4 == 0)) for i, _ in rows), (5, None), (None, 1)], "doc_id long, toxic int")
    table = docs(spark, [*rows, (900, None), (901, ""), (None, "you idiot")])
    got = {r["doc_id"]: r for r in toxicity.score(table, labels, trees=5).collect()}
    out = [i for i, _ in rows if got[i]["held_out"]]
    assert sorted(out) == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"] < 0.5


def test_toxicity_without_both_classes(spark):
    labels = spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs(spark, EDGE), labels).count() == len(EDGE)
    assert toxicity.score(empty(spark), labels.limit(0)).count() == 0


# op10


def test_license_places_and_blocks_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["mit", "license", "MIT", "apache", "Licensed", "under", "the", "general", "public", "version", "2", "0", "released", "x", "é", "gnu", "this", "work", "is"]
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 64, 65, 200])))) for i in range(80)] + [(200, "Released under the MIT License."), (201, "x " * 500 + "Licensed under the Apache License, Version 2.0 " + "y " * 90)]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, t in texts:
        low = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
        places = sorted((k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(low)) if low[k : k + len(phrase.split())] == phrase.split())
        assert got[i]["n_words"] == len(low) and sorted((p["word"], p["label"]) for p in got[i]["places"]) == places
        want = set()
        for a, b in license_scan._blocks(len(low)):
            for number, template in enumerate(license_scan.TEMPLATES):
                tokens = set(template.split())
                spans = [low[c : min(b, c + 2 * len(template.split()))] for c in range(a, b)]
                if any(len(tokens & set(some)) >= 0.8 * len(tokens) - 1e-9 for some in spans):
                    want.add((a, number))
        assert {(m["start"], m["template"]) for m in got[i]["matches"]} == want
    # Words of a short template that are scattered over a block are no match.
    scattered = "licensed " + "a " * 9 + "under " + "b " * 9 + "cc by " + "c " * 9 + "nc 4 0"
    (row,) = license_scan.scan(docs(spark, [(1, scattered)])).collect()
    assert not row["matches"] and license_scan.tightest([0, 5, 6, 9], [1, 2, 1, 3], {1, 2, 3}, 3) == 5 and license_scan.tightest([0], [1], {1, 2}, 2) is None
    assert not license_scan.scan(docs(spark, texts[-2:]), templates={}).where("size(matches) > 0").count()
    assert got[201]["matches"] and license_scan.scan(empty(spark)).count() == 0 and license_scan.scan(docs(spark, EDGE)).count() == len(EDGE)
