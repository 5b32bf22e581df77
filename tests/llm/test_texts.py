"""Tokens, licenses, decontamination, repeats and near duplicates against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from booklog.llm import (
    bpe,
    components,
    decontaminate,
    licenses,
    minhash,
    packing,
    simple8b,
    suffix_dedup,
    suffixes,
    token_counts,
    token_files,
)
from booklog.session import scratch_folder

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
# A null id and text, empty and long texts, ties and repeated rows.
AWKWARD = [(None, None), (None, ""), (3, ""), (3, ""), (1, "A b c"), (1, "A b c"), (2, "x " * 3000), (5, "é" * 700)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows_of(df):
    return Counter(tuple(row) for row in df.collect())


def test_pieces_give_the_ids_of_the_library(library):
    chosen = random.Random(5)
    signs = ["'s", "'t", "'re", "'", "''", " ", "  ", "\n", "\t", "\r\n", "a", "B", "re", "1", ".", "é", "中", " ",
             "　", "😀", "İ", "́", "<|endoftext|>", "​", "½", "٣", "՘", "꟎"]
    texts = ["".join(chosen.choices(signs, k=chosen.randint(0, 40))) for _ in range(3000)]
    encoder = bpe.Encoder(PATH, bpe.character_kinds())
    expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == expected
    assert encoder.counts(texts) == [len(x) for x in expected]


def test_long_texts_are_cut_where_no_piece_crosses(library, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    text = "It's  one 22 thing,\n\n and 'another'   one. " * 40 + "a" * 200
    assert len(bpe.safe_parts(text, 50)) > 5
    found = bpe.Encoder(PATH, bpe.character_kinds()).encode([text, "", text])
    expected = library.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in found] == [expected, [], expected]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_are_counted_by_their_library(spark, documents, name):
    path = public_tokenizers.path(name)
    found = token_counts.count_tokens(documents([(1, "Hello there"), (2, None)]), scratch_folder(spark, "cache"), path)
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {1: bpe.Encoder(path, None).counts(["Hello there"])[0], 2: 0}


def test_token_counts_use_and_fill_the_cache(spark, documents, library):
    cache = scratch_folder(spark, "cache")
    docs = [*AWKWARD, (9, "It's new. <|endoftext|>")]
    expected = Counter(
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512)
        for i, t in docs
    )
    for _ in range(2):
        assert rows_of(token_counts.count_tokens(documents(docs), cache, PATH)) == expected
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in docs})
    assert token_counts.count_tokens(documents([]), cache, PATH).collect() == []


def test_simple8b_round_trips_every_width():
    random_ = np.random.default_rng(3)
    for bits in range(1, 65):
        values = random_.integers(0, 2**64, 777, dtype=np.uint64) >> np.uint64(64 - bits)
        values[::5] = 0
        words, offsets, raw = simple8b.encode(values)
        assert (simple8b.decode(words, raw) == values).all()
        low, high = int(offsets[1]), int(offsets[2])
        assert (simple8b.decode(words[low:high], raw) == values[256:512]).all()
    words, offsets, raw = simple8b.encode(np.zeros(0, np.uint64))
    assert len(words) == 0 and len(simple8b.decode(words, raw)) == 0


def test_token_files_hold_documents_in_order(spark, documents, library):
    folder = scratch_folder(spark, "files")
    token_files.write_token_files(documents(AWKWARD), folder, PATH)
    found = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in AWKWARD), key=lambda x: -1 if x is None else x)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    sums = Counter(
        (i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))
        for i, t in AWKWARD
    )
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == sums
    empty = scratch_folder(spark, "files")
    token_files.write_token_files(documents([]), empty, PATH)
    assert token_files.read_token_files(spark, empty).collect() == []


@pytest.mark.parametrize("harm", [lambda b: b[:-4], lambda b: b[:60] + b"\xff" + b[61:], lambda b: b"x" + b])
def test_damaged_token_files_are_refused(harm):
    whole = token_files.frame([1, None], [np.arange(300), np.arange(2)]) + token_files.FRAME_END
    assert [x.tolist() for x in next(token_files.frames(whole))[1]] == [list(range(300)), [0, 1]]
    with pytest.raises(ValueError):
        list(token_files.frames(harm(whole)))


def test_wrong_offsets_of_blocks_are_refused():
    whole = token_files.frame([1], [np.arange(600)])
    at = 8 * (7 + 3 + 1)
    assert np.frombuffer(whole, "<u8", 1, at)[0] > 0
    moved = np.frombuffer(whole, "<u8", 1, at) + 1
    body = whole[56:at] + moved.astype("<u8").tobytes() + whole[at + 8 :]
    harmed = whole[:48] + np.array([zlib.crc32(body)], "<u8").tobytes() + body
    assert len(list(token_files.frames(whole + token_files.FRAME_END))) == 1
    with pytest.raises(ValueError, match="offsets"):
        list(token_files.frames(harmed + token_files.FRAME_END))


def test_packing_cuts_one_gapless_stream(documents, library):
    window = 16
    pieces = packing.pack(documents(AWKWARD), PATH, window=window, with_ids=True).collect()
    pieces.sort(key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * window + r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in pieces)
    stream = b"".join(r.ids for r in pieces)
    expected = Counter(
        (i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in AWKWARD
    )
    found, at = Counter(), 0
    for row in pieces:
        if row.start == 0:
            found[row.doc_id, stream[at : at + 4 * row.doc_tokens]] += 1
        at += 4 * row.length
    assert found == expected
    assert packing.pack(documents([]), PATH).collect() == []


def test_license_labels_places_and_score(documents):
    mit = licenses.TEMPLATES["mit-text"]
    docs = [
        (11, "Released under the MIT License."), (12, "mit-LICENSE x General\nPublic, License; mit license"), (13, "licence"),
        (14, "nothing " * 70 + mit), (15, "KIT Klicense MİT license"), *AWKWARD,
    ]
    found = licenses.scan_licenses(documents(docs)).collect()
    by_id = {r.doc_id: tuple(r)[1:] for r in found}
    assert len(found) == len(docs)
    assert by_id[11] == (5, 1, 3, 3, "mit", "mit,mit-notice", 1.0)
    assert by_id[12] == (8, 3, 0, 6, "gpl,mit", "gpl,mit", 1.0)
    assert by_id[14][1:6] == (0, None, None, "", "mit-text") and by_id[14][6] == 1.0
    assert by_id[15][1:] == (0, None, None, "", "", 0.0)
    assert by_id[None] == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan_licenses(documents([])).collect() == []


def random_docs(seed, count=40, alphabet=4, most=60):
    chosen = random.Random(seed)
    made = [" ".join(chosen.choices("abcdefgh"[:alphabet], k=chosen.randint(0, most))) for _ in range(count)]
    return list(enumerate(made)) + AWKWARD[:7]


@pytest.mark.parametrize("blocks", [1, 3])
def test_contamination_matches_brute_force(spark, documents, monkeypatch, blocks):
    docs = random_docs(1)
    items = [(1, "a b c d a"), (2, "B"), (2, "a a b b a a c"), (None, "d d d d"), (4, None), (5, "c d"), (5, "c d"), (6, "zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (4, 20))
    report = decontaminate.contamination(documents(docs), benchmark, 4)
    expected = brute.contamination(docs, items, 4)
    assert rows_of(decontaminate.digest_columns(report)) == expected
    kept = decontaminate.decontaminated(documents(docs), benchmark, 4)
    assert kept.columns == documents(docs).columns
    assert kept.count() == sum(n for row, n in expected.items() if not row[-1])


def test_longest_matches_and_nothing_to_look_for(spark, documents):
    docs = [(1, "p q a b c d e f r"), (2, "a b c d x"), (3, "s a b c d e f g")]
    benchmark = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string")
    report = decontaminate.contamination(documents(docs), benchmark, 3)
    found = {r.offset: (r.length, r.doc_id, r.start) for r in decontaminate.longest_matches(report).collect()}
    assert found[0] == (7, 3, 1) and found[4] == (3, 3, 5)
    nothing = decontaminate.contamination(documents(docs), benchmark.filter("false"))
    assert not any(r.contaminated for r in decontaminate.digest_columns(nothing).collect())
    assert decontaminate.contamination(documents([]), benchmark).collect() == []


def test_suffix_arrays_are_in_order():
    chosen = random.Random(8)
    for _ in range(150):
        text = bytes(chosen.choices(b"abcd"[: chosen.randint(1, 4)], k=chosen.randint(1, 150)))
        data, depth = np.frombuffer(text * chosen.randint(1, 2), np.uint8), chosen.choice([9, 40, 400])
        array = suffixes.suffix_array(data, depth, suffixes.byte_sums(data)).tolist()
        heads = [data.tobytes()[k : k + depth] for k in array]
        assert sorted(array) == list(range(len(data))) and heads == sorted(heads)


@pytest.mark.parametrize("group_bytes", [1 << 20, 100])
def test_removals_match_brute_force(documents, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    docs = [*random_docs(2, alphabet=2), (70, "same words here " * 30), (71, "é" * 90)]
    for length, gram in ((20, 8), (30, 12)):
        expected = brute.removals(docs, length)
        assert rows_of(suffix_dedup.removals(documents(docs), length, gram)) == expected
    kept = suffix_dedup.without_repeats(documents(docs), 20, 8)
    assert kept.columns == documents(docs).columns and kept.count() == len(docs)
    assert suffix_dedup.removals(documents([])).collect() == []


def test_near_duplicates_match_brute_force(documents):
    chosen = random.Random(4)
    docs = list(AWKWARD)
    for group in range(12):
        base = [f"w{group}x{k}" for k in range(60)]
        for copy in range(chosen.randint(1, 8)):
            changed = list(base)
            for _ in range(chosen.randint(0, 4)):
                changed[chosen.randrange(60)] = f"new{chosen.random()}"
            docs.append((1000 - 10 * group - copy, " ".join(changed)))
    docs += [(None, docs[-1][1]), docs[-1]]
    assert rows_of(minhash.near_duplicates(documents(docs), 3)) == brute.near_duplicates(docs, 3)
    kept = minhash.one_of_each(documents(docs).coalesce(1), 3)
    expected = brute.near_duplicates(docs, 3)
    groups = {row[2] for row in expected if row[1]}
    assert kept.count() == len(groups) + sum(n for row, n in expected.items() if not row[1])
    assert kept.columns == documents(docs).columns
    assert minhash.near_duplicates(documents([])).collect() == []


def test_no_group_of_near_duplicates_grows_with_the_bucket(documents, monkeypatch):
    chosen, by_bucket, most = random.Random(8), minhash._by_bucket, 64

    def bounded(*arguments):
        for rows in by_bucket(*arguments):
            if rows.num_rows > most:
                raise ValueError(f"a group of {rows.num_rows} rows")
            yield rows

    monkeypatch.setattr(minhash, "_by_bucket", bounded)
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 24, raising=False)
    monkeypatch.setattr(minhash, "HUBS", 4, raising=False)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for doc_id in range(240):
        changed = list(base)
        for _ in range(chosen.randint(0, 5)):
            changed[chosen.randrange(60)] = f"new{chosen.random()}"
        docs.append((doc_id, " ".join(changed)))
    expected = brute.near_duplicates(docs, 3)
    assert 1 < len({row[2] for row in expected}) < 240
    assert rows_of(minhash.near_duplicates(documents(docs), 3)) == expected


def test_estimates_are_corrected_for_chance():
    random_ = np.random.default_rng(6)
    table = minhash.signatures(random_.integers(0, 2**32, (200, minhash.HASHES), dtype=np.uint32))
    matches = minhash.equal_patterns(table[:100], table[100:])
    assert abs(np.mean([minhash.estimate(x) for x in matches.ravel()])) < 0.03
    assert (minhash.equal_patterns(table, table).diagonal() == minhash.HASHES).all()
    assert minhash.estimate(minhash.HASHES) == 1.0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (5, 4)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 130)}
