"""Archives, vectors, toxicity, the pipeline, and the registered queries with an oracle."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from booklog.llm import cap_filters, registry, toxicity, warc
from booklog.session import scratch_folder
from tests.comparison import differences, oracle_connection

from . import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_oracle(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert differences(df, oracle_connection(SF_DIR), entry.oracle_sql()[name]) is None


def test_pages_survive_the_archives(spark):
    same, small = "<p>same</p>" * 20, "tiny"
    pages = [
        (5, "http://a/\r\nX: y", same), (2, None, same), (9, "http://b/", same), (None, "u", same), (1, "u", small), (3, "u", small),
        (4, "u", None), (6, "u", ""), (7, "ü", "é\0" * 5000), (2, None, same), (None, "u", "only without ids " * 9),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in pages], "page_id long, url string, html string, digest string")
    folder = scratch_folder(spark, "archives")
    warc.write_archives(df, folder)
    found = warc.read_archives(spark, folder).collect()
    expected = Counter()
    for page_id, _, html in pages:
        body = (html or "").encode()
        original = 2 if html == same else None
        kind = "revisit" if html == same and page_id != 2 else "response"
        expected[page_id, len(body), hashlib.sha256(body).hexdigest(), kind, original if kind == "revisit" else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    assert {bytes(r.payload) for r in found if r.payload is not None} == {(h or "").encode() for _, _, h in pages}
    assert {r.url for r in found if r.page_id == 5} == {"http://a/%0D%0AX:%20y"}
    empty = scratch_folder(spark, "archives")
    warc.write_archives(df.filter("false"), empty)
    assert warc.read_archives(spark, empty).collect() == []


def archive(*records):
    import zstandard

    dictionary = b"some shared words " * 50
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.dictionary_frame(dictionary) + b"".join(packer.compress(r) + warc.EMPTY_FRAME for r in records)


def test_archives_are_validated():
    body = b"x" * 300
    good = warc.record(1, "u", body, hashlib.sha256(body).hexdigest(), None)
    whole = archive(good, good)
    assert [warc.parse_record(x)[0] for x in warc.archive_records(whole)] == [1, 1]
    without = whole[8 + int.from_bytes(whole[4:8], "little") :]
    for bad in (whole[:-20], without, whole[:60] + b"\x00" * 8 + whole[68:], archive(good) + b"rubbish!"):
        with pytest.raises(ValueError):
            list(warc.archive_records(bad))
    for bad in (
        good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"Content-Length: 3", b"Content-Length: 4"),
        good.replace(b"xxx", b"xyx", 1), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
        good.replace(b"WARC-Date", b"WARC-Type"),
    ):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def vectors(spark, rows):
    return spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, label int, class string")


def brute_vectors(rows, cosine):
    usable = [
        None if v is None or label is None or None in v or not v or not np.isfinite(v).all() or not np.any(v) else np.array(v)
        for _, v, label in rows
    ]

    def linked(a, b):
        u, v = usable[a], usable[b]
        if u is None or v is None or rows[a][2] != rows[b][2] or len(u) != len(v):
            return False
        return float(u @ v) >= cosine * float(np.linalg.norm(u) * np.linalg.norm(v))

    of = brute.groups(len(rows), linked)
    least = {}
    for k, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[of[k]] = min(least.get(of[k], vec_id), vec_id)
    return {
        (rows[k][0], sum(k != j and linked(max(k, j), min(k, j)) for j in range(len(rows))), least.get(of[k]))
        for k in range(len(rows))
    }


@pytest.mark.parametrize("bucket_rows", [4096, 12])
def test_near_vectors_match_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(cap_filters, "BUCKET_ROWS", bucket_rows)
    random = np.random.default_rng(9)
    rows = []
    for group in range(8):
        centre = random.standard_normal(32)
        for k in range(int(random.integers(1, 30))):
            rows.append((1000 - len(rows), (centre + 0.15 * random.standard_normal(32)).tolist(), group % 3))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], 9), (2002, rows[0][1], None), (None, rows[0][1], rows[0][2])]
    rows += [(3000, None, 1), (3001, [0.0] * 32, 1), (3002, [float("nan")] * 32, 1), (3003, [None] * 32, 1), (3004, [], 1), (3005, [1e300, 2e300], 1), (3006, [1.0, 2.0], 1)]
    found = cap_filters.near_duplicate_vectors(vectors(spark, rows)).collect()
    expected = brute_vectors([(a, [x / 1e300 for x in v] if a == 3005 else v, c) for a, v, c in rows], cap_filters.COSINE)
    same = sum((r.vec_id, r.n_links, r.component_id) in expected for r in found)
    assert len(found) == len(rows) and same >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert cap_filters.near_duplicate_vectors(vectors(spark, [])).collect() == []


def test_filters_are_listed_whole_and_found_by_near_pairs():
    random = np.random.default_rng(2)
    u = random.standard_normal((800, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = random.standard_normal((800, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    left, right = cap_filters.filters(u), cap_filters.filters(v)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(left, right, strict=True)]) >= 0.95
    rotation, books = cap_filters.code(64, cap_filters.CODEWORDS)
    turned = u[0] @ rotation
    scores = (books[0] @ turned[:32])[:, None] + (books[1] @ turned[32:])[None, :]
    assert left[0].tolist() == np.flatnonzero(scores.ravel() >= cap_filters.CAP / 8).tolist()


def toxic_corpus(count):
    random = np.random.default_rng(12)
    common = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for doc_id in range(count):
        text = random.choice(common, 60).tolist()
        toxic = doc_id % 5 == 0
        if toxic:
            text[int(random.integers(60))] = str(random.choice(["vile", "rotten", "hateful"]))
        docs.append((doc_id, " ".join(text)))
        if doc_id % 2 == 0:
            labels.append((doc_id, 1, int(toxic)))
    return docs, labels


def test_toxicity_is_learnt_from_the_training_part(spark, documents):
    docs, labels = toxic_corpus(1500)
    docs += [(None, None), (5000, ""), (0, docs[0][1])]
    labels += [(None, 1, 1), (7, None, None), (0, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(docs), marks)
    found = toxicity.score(documents(docs), model).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert 0.25 < len(held) / 1500 < 0.42
    assert np.mean([(r.predicted == 1) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in found)
    # The labels of held-out documents change nothing.
    held_ids = {r.doc_id for r in found if r.held_out}
    flipped = spark.createDataFrame(
        [(a, b, None if c is None else 1 - c) if a in held_ids else (a, b, c) for a, b, c in labels], marks.schema
    )
    assert (toxicity.fit(documents(docs), flipped).weights == model.weights).all()
    kept = toxicity.without_toxic(documents(docs), model)
    assert kept.columns == documents(docs).columns
    assert kept.count() == sum(r.predicted == 0 for r in found)


def test_toxicity_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents([(1, "a b")]), none)
    assert [r.predicted for r in toxicity.score(documents([(1, "a b")]), model).collect()] == [0]
    assert toxicity.score(documents([]), toxicity.fit(documents([]), none)).collect() == []


def test_long_training_texts_are_counted_whole(spark, documents):
    common = [f"common{k}" for k in range(5000)]
    slot_of = {}
    for k in range(2000):
        data = np.frombuffer(f"telling{k}".encode(), np.uint8)
        slot_of[f"telling{k}"] = int(toxicity.distinct_features(data, np.array([0, len(data)]))[0][0])
    word = max(slot_of, key=slot_of.get)
    docs = [(k, " ".join([*common, word] if k < 40 else common)) for k in range(100)]
    marks = spark.createDataFrame([(k, 1, 1) for k in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(documents(docs), marks).weights[slot_of[word]] > 0


def test_training_samples_have_a_row_per_id(spark, documents):
    docs = [(k % 10, f"text {k}") for k in range(200)]
    marks = spark.createDataFrame([(k, 1, 1) for k in range(5)], "doc_id long, quality int, toxic int")
    toxic, unlabelled, _ = toxicity.training_rows(documents(docs), marks)
    for sample in (toxic, unlabelled):
        rows = sample.collect()
        assert rows and len(rows) == len({row.doc_id for row in rows})
        assert all(row.text == max(text for doc_id, text in docs if doc_id == row.doc_id) for row in rows)


def test_pipeline_packs_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF_DIR)
        folder = scratch_folder(spark, name)
        kept.write.parquet(folder)
        kept = spark.read.parquet(folder)
        assert kept.columns == docs.columns
        if name != "suffix_array":
            assert kept.exceptAll(before).count() == 0 and 0 < kept.count() <= before.count()
        else:
            assert kept.count() == before.count()
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    total = packed.agg({"length": "sum"}).first()[0]
    assert packed.agg({"sequence_id": "max"}).first()[0] == (total - 1) // 2048
