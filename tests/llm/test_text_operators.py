"""Operators on documents against plain versions, over odd rows and the small table."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import LONG, PASSAGE, ROWS, groups, lm_scores, remove_repeats, simhash, words
from pyspark.sql import functions as F

from runforge.llm import exact_dedup, lm_scoring, packing, pieces, quality, queries, simhash as sh, substring_dedup, token_counts
from runforge.llm.common import resource

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CLASHES = "'x' as fingerprint, 1 as _fp, 2 as chunk, 3 as id, 4 as row, 5 as _sha, 6 as _maybe, 'y' as kept, 7 as score, 8 as _spans, 9 as _word"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", *CLASHES.split(", ")).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


def test_lm_scores(odd, none, docs):
    for df, order, low in ((odd, 3, 2), (odd, 1, 2), (odd, 2, 1), (docs, 3, 2), (docs, 4, 3)):
        rows = df.select("doc_id", "text").collect()
        want = lm_scores([r.text for r in rows], order, low, 0.4)
        got = lm_scoring.score_documents(df, order, low, 0.4, chunk_bytes=100_000).collect()
        assert sorted(((r.doc_id, len(words(r.text)), round(w, 5)) for r, w in zip(rows, want)), key=key) == \
            sorted(((r.doc_id, r.n_words, round(r.log_score, 5)) for r in got), key=key)
        assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lm_scoring.score_documents(none).count() == 0


def test_exact_copies(odd, none):
    got = exact_dedup.exact_copies(odd).collect()
    assert len(got) == len(ROWS)
    plain = [(i, "".join(c for c in t or "" if c not in " \t\n\x0b\f\r"), len(t or "")) for i, t in ROWS]
    same = defaultdict(list)
    for i, t, n in plain:
        same[t].append((-n, i is None, i))
    want = [(i, min(same[t], key=lambda x: (x[0], x[1], x[2] or 0))[2], len(same[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in plain]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted([2, 5, 6, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18])
    assert exact_dedup.exact_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_copies_in_a_crowded_filter(docs):
    """With less than a bit for each row nearly all rows are taken for copies; the result is the same."""
    a, b = (sorted(map(str, exact_dedup.exact_copies(docs, bits).collect())) for bits in (64, 1))
    assert a == b


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_simhash(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    fps = [simhash(t) for _, t in rows]
    label = groups(fps, 4)
    first = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    want = [(i, f"{fp:016x}", first.get(g)) for (i, _), fp, g in zip(rows, fps, label)]
    for leaf in (4096, 16):
        got = [tuple(r) for r in sh.near_copies(df, leaf_points=leaf, sample=1024).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    left = sh.drop_near_copies(df)
    assert left.columns == df.columns
    kept = {i for i, _, c in want if i == c or i is None}
    assert {r.doc_id for r in left.collect()} == kept


def test_simhash_of_no_rows(none):
    assert sh.near_copies(none).count() == 0


def test_vantage_points_find_every_link():
    """Chains and clusters of fingerprints near leaf boundaries, through small trees and small leaves."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, size=60, dtype=np.uint64)
    points = [*centres]
    for c in centres[:30]:
        x = c
        for _ in range(20):
            for b in rng.integers(0, 64, size=rng.integers(1, 6)):
                x = x ^ np.uint64(1 << int(b))
            points.append(x)
    points = np.unique(np.array(points, dtype=np.uint64))
    want = groups([int(x) for x in points], 4)
    tree = sh.fit_tree(points[::2], 24, 4)
    assert len(tree) >= 10
    who, leaf, visits = sh.place(points, tree, 4)
    assert sorted(who[~visits].tolist()) == list(range(len(points)))
    label = {int(x): int(x) for x in points}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k in np.unique(leaf):
        for small in (4,):
            for u, v in sh.forest(points[who[(leaf == k) & ~visits]], points[who[(leaf == k) & visits]], 4, small):
                a, b = sorted((root(int(u)), root(int(v))))
                label[b] = a
    got = [root(int(x)) for x in points]
    pairs = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == g) for g in set(labels)}
    assert pairs(got) == pairs(want)


def test_components_of_long_chains(spark):
    links = spark.range(200).selectExpr("id as u", "id + 1 as v").union(spark.sql("select 1000L, 1001L")).repartition(5)
    got = {r.node: r.root for r in sh.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_substring_dedup(odd, none, docs):
    for df in (odd.where("doc_id is not null"), docs):
        rows = [tuple(r) for r in df.select("doc_id", "text").distinct().collect()]
        want = dict(zip((i for i, _ in rows), remove_repeats(rows)))
        done = substring_dedup.remove_repeats(df, chunk_bytes=200_000)
        assert [c for c in done.columns if c != "_spans"] == [c for c in df.columns if c != "_spans"]
        got = done.selectExpr("doc_id", "text", "_spans.*").collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == df.count()
        for r in got:
            assert r.removed_chars == len(dict(rows)[r.doc_id] or "") - len(r.text)
            assert (r.n_removed > 0) == bool(r.first_ids)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).selectExpr("doc_id", "text", "_spans.*").collect()}
    assert PASSAGE in got[10].text and PASSAGE[:40] not in got[11].text and got[12].text == ""
    assert got[11].text == "Quite another start it has, this one.\nWith a different end." and got[11].first_ids == [10]
    assert substring_dedup.remove_repeats(none).count() == 0


def longest_shared(texts, n=50):
    """Places of runs of ``n`` words that an earlier text or place holds too."""
    seen, again = set(), 0
    for t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            run = tuple(w[i:i + n])
            again += run in seen
            seen.add(run)
    return again


def test_substring_dedup_within_sentences(spark, tmp_path):
    """Passages of 50 words and more inside other sentences, next to edits and without sentence ends."""
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    inside, plain, long = some(50), some(60), some(38) + ". " + some(38)
    rows = [(1, f"{some(5)} {inside} {some(4)}. End."), (2, f"Begin. {some(7)}\xa0 {inside}  {some(3)} last."), (3, f"{some(300)} {plain} {some(300)}"),
            (4, f"{some(20)} {plain} {some(900)}"), (5, f"One {long} two. {some(9)}"), (6, f"\n Other {long} too. {some(9)}"),
            (7, some(49)), (8, f"{plain}, {plain}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for done in (queries.QUERIES["op5_substring_dedup"](spark, str(tmp_path)),
                 substring_dedup.remove_repeats(df, word_runs=True, chunk_bytes=100).select("*", "_spans.*")):
        got = {r.doc_id: r for r in done.collect()}
        assert longest_shared([t for _, t in rows]) > 20 and longest_shared([r.text for r in got.values()]) == 0
        assert all(got[i].text == t and not got[i].first_ids for i, t in rows if i in (1, 3, 5, 7))
        assert [got[i].first_ids for i in (2, 4, 6, 8)] == [[1], [3], [5], [3]]
        for i, t in rows:
            own, own_kept = t.split(), got[i].text.split()
            assert len(own) - len(own_kept) <= 130 and got[i].removed_chars == len(t) - len(got[i].text)
            left = iter(own)
            assert all(w in left for w in own_kept)  # in their order


def test_substring_dedup_of_repeated_rows(spark):
    """Rows of one id, or of no id and one text, keep a passage's first place, in one chunk and in two."""
    rows = [(1, PASSAGE), (1, PASSAGE), (2, "Start. " + PASSAGE), (None, PASSAGE[::-1]), (None, PASSAGE[::-1])]
    for parts, size in ((1, 1 << 20), (5, 1)):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        for word_runs in (False, True):
            got = substring_dedup.remove_repeats(df, word_runs=word_runs, chunk_bytes=size).select("doc_id", "text").collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, [*rows[:2], (2, "Start. "), *rows[3:]]))


def test_token_counts(odd, none):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=resource("piece_bpe_32k.model"))
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in ROWS)
    for chunk, overlap in ((32768, 256), (64, 8), (700, 2)):
        got = token_counts.count_tokens(odd, limit=100, chunk_chars=chunk, overlap_chars=overlap).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(none).count() == 0


def test_splicing_is_exact():
    sp, size = token_counts.model(resource("piece_bpe_32k.model"))
    rng = random.Random(4)
    parts = ["a", "b", "the ", " ", "  ", "\n", "é", "漢", "字", "𝄞", "▁", "xxxxx", "ing ", "Ünï", "0", "<s>", ".", "\x00"]
    for _ in range(1500):
        some = rng.sample(parts, rng.randint(1, 6))
        text = "".join(rng.choice(some) for _ in range(rng.randint(20, 300)))
        assert token_counts.count_long(sp, size, text, rng.choice([16, 32, 64]), rng.choice([2, 4, 8])) == len(sp.encode(text)), text


def check_packing(rows, texts, capacity=4096):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(resource("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at.bit_count() == 1  # nothing is padded
        assert all(r.sequence_tokens == at for r in own)


def test_packing(odd, none, docs):
    unique = odd.where("doc_id is not null and doc_id <> 7")
    check_packing(packing.pack(unique).collect(), [(i, t) for i, t in ROWS if i not in (None, 7)])
    check_packing(packing.pack(docs.repartition(2)).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(odd).groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id = 7").first().n == 4
    assert packing.pack(none).count() == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2000, size=3000)
    rows = packing.assign(lengths, 4096, 1.0, 1 / 4096)
    assert rows[:, 2].sum() == lengths.sum() == packing.capacities(int(lengths.sum()), 4096).sum()
    cost = np.bincount(rows[:, 3], weights=rows[:, 2] + rows[:, 2] ** 2 / 4096)[:lengths.sum() // 4096]
    assert cost.std() / cost.mean() < 0.05
    assert len(rows) < 1.3 * len(lengths)


def test_word_encoder_is_the_library():
    rng = random.Random(2)
    enc = packing.WordEncoder(resource("word_bpe_49k.json"))
    parts = ["a", "B", "'s", "'S", ".", " ", ",", "\n", "é", "É", "́", "İ", "ſ", "Σ", "σ", "<|", "<|endoftext|>", "|>", "1", "23", "!",
             "漢", " ", "　", "\t", "don't", "they'll", "\x1f", "\x85", "ß", "ŉ"]
    import pyarrow as pa
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, bounds = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == enc.whole(t).tolist(), t


def test_pieces_round_trip(odd, none, docs):
    for df in (odd, docs):
        got = pieces.decode(pieces.encode(df)).collect()
        want = sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in df.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.text) for r in got) == want
    assert pieces.decode(pieces.encode(none)).count() == 0


def best_path(p, word, score):
    """Plain Viterbi: of equal paths the one with the longer last piece."""
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(e - p.longest, 0), e):
            part = word[s:e]
            got = score.get(part)
            ids = [got[0]] if got else [p.bytes[b] for b in part.encode()]
            x = got[1] if got else p.missing if e - s == 1 else None
            if x is not None and (best[e] is None or best[s][0] + x > best[e][0]):
                best[e] = (best[s][0] + x, best[s][1] + ids)
    return best[-1][1]


def test_pieces_against_plain_viterbi():
    import pyarrow as pa
    import sentencepiece
    path = resource("piece_bpe_32k.model")
    p = pieces.Pieces(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {sp.id_to_piece(int(i)): (int(i), s) for i, s in zip(p.ids, p.scores)}
    rng = random.Random(3)
    some = [" ", "  ", "the", "ing", "é", "漢", "𝄞", "\n", "x", "▁", "THE", "1", "."]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", " ", "  ", "a" * 300]
    ids, bounds = p.encode(pa.array(texts))
    for i, t in enumerate(texts):
        want = [x for w in pieces.WORD.findall("▁" + t.replace(" ", "▁")) for x in best_path(p, w, score)] if t else []
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want, t


def test_pieces_against_the_library(docs, tmp_path):
    """The library's own Viterbi: the file with its model type set to unigram.

    Its scores of -1e9 become -40000, because the library adds them up in single precision.
    """
    import struct

    import pyarrow as pa
    import sentencepiece
    data = open(resource("piece_bpe_32k.model"), "rb").read()
    data = data.replace(b"\x15" + struct.pack("<f", -1e9), b"\x15" + struct.pack("<f", -40000.0)) + b"\x12\x02\x18\x01"
    (tmp_path / "unigram.model").write_bytes(data)
    uni = sentencepiece.SentencePieceProcessor(model_proto=data)
    p = pieces.Pieces(str(tmp_path / "unigram.model"))
    seen = sorted({w for r in docs.collect() for w in r.text.split()} | {"  two  spaces ", "漢字🙂", "a\nb"})
    ids, bounds = p.encode(pa.array(seen))
    assert all(ids[bounds[i]:bounds[i + 1]].tolist() == uni.encode(w) for i, w in enumerate(seen))


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    auc = np.mean([(b < np.array(good)).mean() + (b == np.array(good)).mean() / 2 for b in bad])
    accuracy = np.mean([r.predicted == r.quality for r in test])
    print("held out", len(test), "auc", auc, "accuracy", accuracy)
    assert auc > 0.97 and accuracy > 0.95
    assert np.mean([r.predicted for r in test if r.quality == 1]) > 0.98


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    lied = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs, x).collect()} for x in (labels, lied))
    assert a == b


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 1), (15, 0), (16, 0), (None, 1), (2, None), (99, 1), (10, 1), (10, 1)], "doc_id long, quality int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in quality.score_quality(odd, labels.where("quality = 1")).collect()}) == 1
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
    assert quality.score_quality(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0


def test_long_rows_are_whole():
    assert len(LONG) > 32768
