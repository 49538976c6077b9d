"""Operators against their plain versions on the smallest tables, and on odd rows."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tracelake.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return [tuple(r) for r in queries.table(spark, SF, name).select(*columns).collect()]


def result(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_decontamination(spark):
    want = brute.op1(rows(spark, "documents", "doc_id", "text"), rows(spark, "benchmark", "item_id", "text"))
    assert result(queries.op1_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


def test_near_duplicates(spark):
    want = brute.op6(rows(spark, "documents", "doc_id", "text"))
    assert result(queries.op6_minhash_dedup(spark, SF), "doc_id", "n_shingles", "component_id", "kept") == sorted(tuple(r) for r in want)


@pytest.mark.parametrize("name", ["op9_warc"])
def test_archives(spark, name):
    want = brute.op9(rows(spark, "pages", "page_id", "html"))
    got = result(queries.queries()[name](spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(want)


def test_repeated_bytes(spark):
    want = brute.op2(rows(spark, "documents", "doc_id", "text"))
    assert result(queries.op2_suffix_dedup(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def test_personal_data(spark):
    want = [(d, *brute.op3(t)) for d, t in rows(spark, "documents", "doc_id", "text")]
    assert result(queries.op3_pii(spark, SF), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want)


def test_personal_data_spans_keep_the_base(spark):
    for r in queries.op3_pii(spark, SF).collect():
        found = [x.split(":")[0] for x in r["spans"].split(",") if x]
        assert [found.count(k) for k in ("email", "ip", "card", "phone")] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]


def test_near_vectors(spark):
    want = brute.op4(rows(spark, "embeddings", "vec_id", "embedding"))
    assert result(queries.op4_embedding_dedup(spark, SF), "vec_id", "n_links", "component_id", "kept") == sorted(want)


def test_mixture(spark):
    source = dict(rows(spark, "documents", "doc_id", "source"))
    got = queries.op5_mixing(spark, SF).collect()
    targets, sizes = brute.op5_targets([(source[r.doc_id], r.size) for r in got])
    taken = dict.fromkeys(targets, 0)
    largest = dict.fromkeys(targets, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(targets[s]) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op5_mixing(spark, SF).collect()))


def test_license_places(spark):
    want = [(d, *brute.op7(t)) for d, t in rows(spark, "documents", "doc_id", "text")]
    df = queries.op7_license_scan(spark, SF)
    got = [tuple(r) for r in df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    assert sorted(got) == sorted(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in df.collect())


def test_token_files(spark):
    want = brute.op8(rows(spark, "documents", "doc_id", "text"))
    assert result(queries.op8_token_output(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want)


def test_toxicity_on_held_out_labels(spark):
    """The 20 times larger tables hold enough held-out labels for a stable figure."""
    folder = SF.replace("0.001", "0.01")
    label = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
    got = queries.op10_toxicity(spark, folder).collect()
    assert len(got) == queries.table(spark, folder, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    scores = [(r.score, label[r.doc_id]) for r in got if r.held_out and label.get(r.doc_id) is not None]
    bad, good = ([s for s, y in scores if y == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.8


ODD = [
    (1, None, "a", "x"),
    (2, "", "a", "x"),
    (3, "word", None, "x"),
    (4, "One two three four five six seven eight. " * 2000, None, None),
    (5, "mail a.b@c.de or +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.1; CC-BY", "b", "y"),
    (6, "mail a.b@c.de or +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.1; CC-BY", "b", "y"),
    (7, "h\u00e9 \U0001f600 \u4e2d\u6587 " * 40, "b", "y"),
]


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated texts and columns whose names clash with inner ones."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as component", "'k' as key", "2 as n", "3 as label", "4 as size")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, None), (4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = [(d, t) for d, t, *_ in ODD]
    known, at = queries.queries(), str(tmp_path)
    assert result(known["op1_decontamination"](spark, at), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.op1(texts, [(1, "one two three"), (2, None), (3, "")]))
    assert result(known["op2_suffix_dedup"](spark, at), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op2(texts))
    assert result(known["op3_pii"](spark, at), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted((d, *brute.op3(t)) for d, t in texts)
    assert result(known["op6_minhash_dedup"](spark, at), "doc_id", "n_shingles", "component_id", "kept") == sorted(tuple(r) for r in brute.op6(texts))
    assert len(known["op5_mixing"](spark, at).collect()) == len(known["op7_license_scan"](spark, at).collect()) == len(known["op10_toxicity"](spark, at).collect()) == len(ODD)
    assert result(known["op8_token_output"](spark, at), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.op8(texts))


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
        queries.table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {k: q(spark, str(tmp_path)).count() for k, q in queries.queries().items()} == dict.fromkeys(queries.queries(), 0) | {"op11_chat_format": 1}


def test_pipeline(spark):
    """Each stage against the plain version of its operator on its own input, and run() against the stages."""
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        given = docs
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert docs.columns == columns and set(after) <= set(before), name
        kept[name] = sorted(d for d, _ in after)
        if name == "toxicity":
            clean = {r.doc_id for r in queries.table(spark, SF, "labels").where("toxic = 0").collect()}
            assert len(clean & set(kept[name])) >= 0.9 * len(clean & {d for d, _ in before}) and len(after) >= 0.8 * len(before)
        if name == "near_duplicates":
            assert kept[name] == sorted(d for d, _, _, stays in brute.op6(before, k=5) if stays)
        if name == "decontamination":
            assert kept[name] == sorted(r[0] for r in brute.op1(before, rows(spark, "benchmark", "item_id", "text")) if not r[5])
        if name == "mixing":
            from tracelake.llm import mixing

            copies = {r.doc_id: r.copies for r in mixing.mix(given).collect() if r["size"]}
            assert kept[name] == sorted(d for d, n in copies.items() for _ in range(n))
    out = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert out == sorted(brute.op8(rows_of(docs)))


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_pieces_give_the_ids_of_whole_texts():
    import random

    import numpy as np
    from tracelake.llm import bytesops, token_output

    from tokenizers import Tokenizer

    encoder, plain = token_output.Encoder(token_output.public_tokenizer()), Tokenizer.from_file(token_output.public_tokenizer())
    rng = random.Random(3)
    letters = ["a", "b", "'s", "1", " ", " ", "\n", "\t", "\r", "\x00", "\x7f", "\x85", "\xa0", " ", " ", "　", "é", "漢", "🙂", "<|endoftext|>", ".", "word", "́", "​"]
    for _ in range(30):
        texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 5, 300]))) for _ in range(60)]
        raw = [t.encode() for t in texts]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
        ids, ptr = encoder.encode(data, offs)
        for k, text in enumerate(texts):
            assert ids[ptr[k] : ptr[k + 1]].tolist() == [*plain.encode(text, add_special_tokens=False).ids, token_output.END]
