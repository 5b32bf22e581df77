"""Word vocabularies, spelling variants and vector codes against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from booklog.llm import anchors, variants, word_bpe

from . import brute
from .conftest import CLASHING

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = (
    "a B ' s t re 1 23 é É e ́ . !! <|endoftext|> <|ENDOFTEXT|> <| |> 中文 ß İ K σΣ < ̸ ½ don't it's I'LL 😀 ‍ _ # Å å 's 've d ﬁ ٣"
).split() + [" ", "  ", "\n", "　", "\x1c", "\x85", " ", "\x00"]


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def brute_word_bpe(docs):
    library = Tokenizer.from_file(PATH)
    found = Counter()
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        digests = (hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), decoded))
        found[doc_id, len(ids), *digests] += 1
    return found


def test_words_encode_and_decode_as_the_library_does(documents, monkeypatch):
    drawn = random.Random(3)
    docs = [(k, "".join(drawn.choices(PARTS, k=drawn.choice((0, 1, 3, 10, 40))))) for k in range(800)]
    docs += [(None, "x y"), (7, None), (7, None), (8, ""), (9, " \n\t"), (10, "word, " * 40000), (11, "x" * 3000)]
    for block in (word_bpe.BLOCK_BYTES, 1 << 10):
        monkeypatch.setattr(word_bpe, "BLOCK_BYTES", block)
        assert rows_of(word_bpe.encode_and_decode(documents(docs), PATH)) == brute_word_bpe(docs)
    assert word_bpe.encode_and_decode(documents([]), PATH).collect() == []


def test_each_distinct_word_is_encoded_once(spark):
    words = spark.createDataFrame([(b, s, f"word{s}".encode()) for b in range(40) for s in range(30)], "block long, slot int, word binary")
    coded = word_bpe.encode_words(words, PATH)
    ids = {(r.slot, bytes(r.ids)) for r in coded.collect()}
    assert coded.count() == 1200 and len(ids) == 30


def test_other_vocabularies_are_refused(documents):
    with pytest.raises(ValueError, match="lower-casing"):
        word_bpe.encode_and_decode(documents([]), public_tokenizers.path("byte_bpe_50k.json"))


def brute_variants(docs):
    import re

    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return Counter((w, form[w], root(w), n[w], len(found[w]), n.get(form[w])) for w in n)


def test_variants_match_a_comparison_of_all_words(documents, monkeypatch):
    drawn = random.Random(11)
    stems = ["".join(drawn.choices("abcdeéßÿÀ×", k=drawn.choice((4, 5, 5, 6, 9)))) for _ in range(30)]
    words = list(stems)
    for stem in stems * 4:
        at = drawn.randrange(len(stem))
        words.append(drawn.choice((stem[:at] + stem[at + 1 :], stem[:at] + "b" + stem[at:], stem[:at] + "é" + stem[at + 1 :])))
    shares = [drawn.choice((1, 2, 4, 9)) for _ in words]
    docs = [(k, drawn.choice(" \n.3").join(drawn.choices(words, shares, k=60))) for k in range(60)]
    docs += [(None, "AAAAA aaaaa aaaaa aaaab"), (3, None), (4, ""), (4, "x" * 5000 + " " + "x" * 5001), (5, "Ünïts ünïts ünïts"), (60, docs[0][1]), (60, docs[0][1])]
    expected = brute_variants(docs)
    assert sum(x[1] is not None for x in expected) > 20 and any(x[1] != x[2] and x[1] for x in expected)
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    for rows in (variants.TILE_ROWS, 3):
        monkeypatch.setattr(variants, "TILE_ROWS", rows)
        monkeypatch.setattr(variants, "SLICE_WORDS", rows * 8)
        assert rows_of(variants.spelling_variants(documents(docs)).select(*columns)) == expected
    assert variants.spelling_variants(documents([])).collect() == []
    assert variants.spelling_variants(documents([(1, "a bc"), (2, None)])).collect() == []


def test_chains_of_forms_lead_to_their_end(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)], "word string, form string")
    assert {tuple(r) for r in variants._roots(forms).collect()} == {(f"w{k}", "w11") for k in range(11)}


def brute_codes(rows):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return Counter()
    width = len(kept[0][1]) // 16
    cut = [[v[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:64]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p, book in enumerate(list(books)):
            owners = [nearest(p, x[p])[1] for x in cut]
            new = list(book)
            for k in range(len(book)):
                mine = [x[p] for x, o in zip(cut, owners, strict=True) if o == k]
                if mine:
                    new[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
            books[p] = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [[nearest(p, x[p]) for p in range(16)] for x in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    of_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        of_label[label] += e
    return Counter(
        (i, "".join(f"{k:02x}" for _, k in c), e, of_label[label], digest)
        for (i, _, label), c, e in zip(kept, coded, errors, strict=True)
    )


def vectors(spark, rows):
    more = [x for x in CLASHING if x not in ("label", "vec_id")]
    schema = "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{x}` string" for x in more)
    return spark.createDataFrame([(*x, *more) for x in rows], schema)


@pytest.mark.parametrize("size", [0, 1, 40, 700])
def test_codes_match_plain_k_means(spark, size, monkeypatch):
    drawn = random.Random(size)
    centres = [[drawn.uniform(-1, 1) for _ in range(32)] for _ in range(20)]
    rows = [(k, [x + drawn.gauss(0, 0.05) for x in drawn.choice(centres)], drawn.choice((None, 1, 2))) for k in range(size)]
    # Equal vectors, equal distances, a constant vector, and everything that is dropped.
    rows += [(k + 1000, rows[k][1], 2) for k in range(0, size, 9)] + rows[:3]
    if size > 1:
        rows += [(None, [0.0] * 32, 1), (2000, [0.5] * 32, None), (2001, [-0.25, 0.25] * 16, 3)]
    bad = ([None, *[0.0] * 31], [float("nan")] * 32, [float("inf")] * 32, None, [])
    expected = brute_codes(rows)
    for block, leaf in ((2048, 32), (64, 4)):
        monkeypatch.setattr(anchors, "BLOCK_ROWS", block)
        monkeypatch.setattr(anchors, "LEAF_ROWS", leaf)
        found = anchors.vector_codes(vectors(spark, rows + [(-k, v, 1) for k, v in enumerate(bad)]))
        assert rows_of(found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")) == expected


def test_trees_give_every_point_to_its_nearest_entry():
    drawn = np.random.default_rng(5)
    owned_balls = 0
    for points, spread in itertools.product((1, 33, 600, 2048), (2, 60)):
        cloud = drawn.integers(-spread, spread, (12, 4))[drawn.integers(0, 12, points)] * 8 + drawn.integers(-3, 3, (points, 4))
        entries = np.vstack([cloud[:20], cloud[:2], drawn.integers(-400, 400, (20, 4))])
        tree = anchors.build_tree(cloud)
        assert sorted(tree.order.tolist()) == list(range(points))
        codes, errors = anchors._codes(tree, entries)
        exact = ((cloud[:, None, :] - entries[None]) ** 2).sum(2)
        assert (codes == exact.argmin(1)).all() and (errors == exact.min(1)).all()
        totals = anchors._totals(tree, entries)
        assert (totals[:, 0] == np.bincount(codes, minlength=len(entries))).all() and (totals[:, 1:].sum(0) == cloud.sum(0)).all()
        owned_balls += sum(len(which) for kind, which, _ in anchors.owned(tree, entries) if kind == "balls")
    assert owned_balls > 20


def test_vectors_that_cannot_be_cut_or_counted_are_refused(spark):
    with pytest.raises(ValueError, match="equal parts"):
        anchors.vector_codes(vectors(spark, [(1, [0.0] * 30, 1)]))
    with pytest.raises(Exception, match="or more"):
        anchors.vector_codes(vectors(spark, [(1, [1e9] * 16, 1)])).collect()
