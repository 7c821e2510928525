"""Operators over documents against brute force, odd cases included."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from litlake.llm import common, decontamination, mixing, near_duplicates, quality, suffix_dedup, toxicity
from litlake.llm.components import components
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("few, block, broadcast", [(16, 500_000, 10**6), (1, 300, 0)])
@pytest.mark.parametrize("size, num", [(5, 8), (3, 9), (2, 5)])
def test_duplicate_groups(docs, rows, few, block, broadcast, size, num, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(near_duplicates, "BLOCK_NODES", 4096 if block > 300 else 2)
    monkeypatch.setattr(near_duplicates, "FEW", few)
    got = near_duplicates.duplicate_groups(docs, size, Fraction(num, 10))
    got = got.select("doc_id", "n_shingles", "component_id")
    assert cases.same(plain(got), cases.duplicate_groups(rows, size, num))


def test_duplicate_groups_of_nothing(docs):
    assert plain(near_duplicates.duplicate_groups(cases.empty(docs))) == []


def test_near_copies_of_one_text(spark):
    """A hundred copies with a word changed each: links pass through the original only."""
    base = cases.prose(8, 70).split()
    texts = [" ".join(base)]
    for i in range(100):
        words = list(base)
        words[3 + i * 29 % 60] = f"new{i}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts, start=5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates.duplicate_groups(docs).select("doc_id", "n_shingles", "component_id")
    assert cases.same(plain(got), cases.duplicate_groups(rows))


def without_ids():
    """Near copies, two of them without an id; one of these alone links 1 and 2."""
    base = cases.prose(31, 200).split()
    changed = [" ".join([*base[:at], *(f"x{at + k}" for k in range(n)), *base[at + n :]]) for at, n in ((0, 24), (0, 12), (0, 0))]
    other = cases.prose(32, 90)
    rows = [(1, changed[0]), (None, changed[1]), (2, changed[2]), (5, other), (None, other + " end")]
    return [*rows, (None, cases.prose(33, 90)), (None, cases.prose(33, 90) + " end")]


@pytest.mark.parametrize("few, block, broadcast", [(16, 500_000, 10**6), (1, 300, 0)])
def test_near_copies_without_id(spark, few, block, broadcast, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(near_duplicates, "BLOCK_NODES", 4096 if block > 300 else 2)
    monkeypatch.setattr(near_duplicates, "FEW", few)
    rows = without_ids()
    expected = cases.duplicate_groups(rows, 3, 8)
    assert [c for _, _, c in expected] == [1, 1, 1, 5, 5, None, None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.duplicate_groups(docs, 3, Fraction(8, 10))
    assert cases.same(plain(got.select("doc_id", "n_shingles", "component_id")), expected)


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(8, 10), Fraction(9, 10)])
def test_parts_bound_the_difference(t):
    bands = near_duplicates.Bands(t)
    for n in [*range(1, 400), 5000, 123_457]:
        for m in {n, int(n / t), int(n * (1 + t) / 2 / t)}:
            if m >= n >= t * m:
                shared = set(bands.of(n)) & set(bands.of(m))
                most = (n + m) * (1 - t) / (1 + t)
                assert shared and any(bands.apart(b) >= int(most) and bands.parts(b) > most for b in shared)


def token_sets(rng, n):
    return np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(8, 10), Fraction(9, 10)])
def test_similar_sets_share_a_key(t):
    """Every pair just similar enough meets in some part, however small or uneven the sets."""
    bands, rng = near_duplicates.Bands(t), np.random.default_rng(4)
    for n in [*range(1, 60), 97, 200, 350, 1500]:
        for _ in range(12):
            both = token_sets(rng, n)
            union = n * t.denominator // t.numerator
            more = token_sets(rng, max(union - n, 0))
            cut = rng.integers(0, len(more) + 1)
            a, b = np.union1d(both, more[:cut]), np.union1d(both, more[cut:])
            assert near_duplicates.similar(a, b, t)
            keys = [near_duplicates.part_keys(x, bands) for x in (a, b)]
            assert len(np.intersect1d(*keys))
            sketches = [near_duplicates.sketch(x) for x in (a, b)]
            width = min(map(len, sketches))
            bits = np.bitwise_count(np.bitwise_xor(*(near_duplicates.folded(x, width) for x in sketches))).sum()
            assert bits <= near_duplicates.most_apart(len(a) + len(b), t)


def test_folded_sketches_are_sketches():
    tokens = token_sets(np.random.default_rng(6), 5000)
    whole = near_duplicates.sketch(tokens)
    assert len(whole) == 8192 // 64
    for bits in (4096, 1024):
        assert (near_duplicates.folded(whole, bits // 64) == near_duplicates.sketch(tokens, bits)).all()


@pytest.mark.parametrize("t", [Fraction(8, 10), Fraction(9, 10)])
def test_unrelated_sets_meet_nowhere(t):
    """Parts without shingles are no keys: 5,000 unrelated sets share next to none."""
    bands, rng = near_duplicates.Bands(t), np.random.default_rng(5)
    sizes = rng.integers(1, 400, 5000)
    keys = np.concatenate([near_duplicates.part_keys(token_sets(rng, n), bands) for n in sizes])
    _, times = np.unique(keys, return_counts=True)
    assert times.max() <= 2 and (times > 1).sum() < 50


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 400, 150).astype(np.uint64) * np.uint64(2654435761)) for _ in "ab")
        differ = len(np.setxor1d(a, b))
        bits = np.bitwise_count(near_duplicates.sketch(a) ^ near_duplicates.sketch(b)).sum()
        assert bits <= differ


def test_near_duplicate_stage(spark, docs, rows):
    kept = near_duplicates.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    groups = cases.duplicate_groups(rows)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in groups} | {None}


def test_near_duplicates_of_one_id(spark):
    """An id with many texts: rows are told apart, one of each component stays."""
    texts = [cases.prose(40 + i // 2, 90) + (" end" if i % 2 else "") for i in range(12)]
    rows = [(3, t) for t in texts] + [(2, texts[0]), (2, texts[0]), (None, texts[5]), (None, ""), (3, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.duplicate_groups(docs).select("doc_id", "n_shingles", "component_id")
    assert cases.same(plain(got), cases.duplicate_groups(rows))
    kept = plain(near_duplicates.drop_near_duplicates(spark, docs, ""))
    assert (None, "") in kept and (2, texts[0]) in kept and len(kept) == 7
    assert len({t[:60] for _, t in kept}) == 7


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7), (9, 8)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(1, 41)}) == 1 and got[100] == got[150] == got[200] != got[1]


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 1])
def test_repeated_bytes(docs, rows, many):
    assert cases.same(plain(suffix_dedup.repeated_bytes(docs, many)), cases.repeated_bytes(rows))


def test_repeated_bytes_of_nothing(docs):
    assert plain(suffix_dedup.repeated_bytes(cases.empty(docs))) == []


def test_small_blocks_and_strides(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "STRIDE", 300)
    found = suffix_dedup.pieces(cases.LONG[:5000].encode())
    assert found[2].sum() == 5000 - suffix_dedup.LENGTH + 1


def test_cover_has_every_difference():
    found = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert found == set(range(suffix_dedup.PERIOD))


def test_sorted_windows_with_anchors_on_several_residues():
    """Offsets that don't line equal windows up still find them, through the cover."""
    text = cases.prose(12, 120).encode()[:700]
    parts = [text[:500], b"x" * 7 + text[:430], text[100:600]]
    counts = [len(p) - suffix_dedup.LENGTH + 1 for p in parts]
    for offsets in ([0, 0, 0], [0, 3, 17], [30, 1, 2]):
        marks = suffix_dedup.repeated_windows(parts, counts, offsets)
        seen = {}
        for p, n in zip(parts, counts, strict=True):
            for i in range(n):
                w = p[i : i + suffix_dedup.LENGTH]
                seen[w] = seen.get(w, 0) + 1
        for p, n, mark in zip(parts, counts, marks, strict=True):
            assert mark.tolist() == [seen[p[i : i + suffix_dedup.LENGTH]] > 1 for i in range(n)]


def test_suffix_stage(spark, docs, rows):
    kept = suffix_dedup.remove_repeats(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(rows)
    removed = {d: n for d, _, n, _, _ in cases.repeated_bytes(rows)}
    for r in kept.where("doc_id is not null").collect():
        before = cases.TEXTS[r.doc_id]
        if not removed[r.doc_id]:
            assert r.text == before
        else:
            assert len(r.text) == r.n_chars < len(before)


ITEMS = [
    (0, cases.PASSAGE),
    (10, " ".join(cases.prose(4, 50).split()[:20])),
    (2, "One two"),
    (2, "漢字"),
    (3, None),
    (4, ""),
    (None, "one"),
]


@pytest.mark.parametrize("index_bytes", [decontamination.INDEX_BYTES, 300])
def test_contamination(spark, docs, rows, index_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hits", F.lit(1))
    got = decontamination.contamination(docs, bench, index_bytes)
    assert cases.same(plain(got), cases.contamination(rows, ITEMS))


def test_contamination_of_and_by_nothing(spark, docs, rows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert plain(decontamination.contamination(cases.empty(docs), bench)) == []
    got = decontamination.contamination(docs, cases.empty(bench))
    assert cases.same(plain(got), cases.contamination(rows, []))


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "keep this, Alpha beta. GAMMA! and that"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert got == {1: "keep this, ! and that", 2: None}


def test_decontamination_stage_keeps_clean_rows(spark, tmp_path, docs, rows):
    spark.createDataFrame(ITEMS[:2], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontamination.drop_contaminated(spark, docs, str(tmp_path))
    clean = [d for d, *_, bad in cases.contamination(rows, ITEMS[:2]) if not bad]
    assert cases.same([r.doc_id for r in kept.collect()], clean) and kept.columns == docs.columns


def test_mix_reaches_its_targets(docs, rows):
    got = plain(mixing.mix(docs, block=16, shard_words=500))
    assert len(got) == len(rows)
    taken, target, sizes = {}, {}, {}
    for _, size, of, aim, n in got:
        key = (of, aim)
        taken[key] = taken.get(key, 0) + n
        target[key], sizes[key] = aim, of
        assert 0 <= n <= 3 * size
    for key in taken:
        assert abs(taken[key] - target[key]) <= max(64, 0.02 * target[key])
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert cases.same(got, plain(mixing.mix(docs.repartition(5), block=16, shard_words=500)))


def test_mix_of_nothing(docs):
    assert plain(mixing.mix(cases.empty(docs))) == []
    assert {r.taken for r in mixing.mix(docs.where("doc_id < 3")).collect()} == {0}


def test_highest_quotients(spark):
    aims = [7.3, 0.2, 3.6, 3.6, 12.9, 1.49, 1.49, 1.49, 1.49]
    rows = [("0s", i, 100, a * 10) for i, a in enumerate(aims)]
    cells = spark.createDataFrame(rows, "source_key string, shard long, cell_size long, target double")
    got = {r.shard: r.quota for r in mixing.apportion(cells, 10).collect()}
    seats = [0] * len(aims)
    for _ in range(round(sum(aims))):
        best = max(range(len(aims)), key=lambda i: (aims[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    assert [got[i] for i in range(len(aims))] == seats


def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 3 == 0, i % 4 == 0
        text = cases.prose(i, 120)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            words = text.split()
            for k in range(5, 120, 12):
                words[k] = ("vilegoon", "rottenpig", "dirtyfool")[(i + k) % 3]
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize(
    "operator, label, modulus, rest", [(toxicity.toxicity, "toxic", 5, 0), (quality.quality, "quality", 4, 2)]
)
def test_held_out_accuracy(spark, operator, label, modulus, rest):
    import zlib

    docs, labels = labelled(spark)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    got = operator(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_scores_of_odd_rows(spark, docs, rows, operator):
    _, labels = labelled(spark)
    for marks in (labels, cases.empty(labels)):
        got = operator(docs, marks).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert operator(cases.empty(docs), labels).collect() == []


def test_labels_outside_training_change_nothing(spark):
    docs, labels = labelled(spark)
    held = toxicity.held_out("doc_id", 5, 0)
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert plain(toxicity.toxicity(docs, labels).orderBy("doc_id")) == plain(toxicity.toxicity(docs, other).orderBy("doc_id"))


@pytest.mark.parametrize(
    "operator, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")]
)
def test_training_reads_whole_texts(spark, operator, label):
    """What marks a class stands behind the first 4,096 characters, in training and in held-out texts."""
    docs, labels = labelled(spark)
    lead = F.udf(lambda i: cases.prose(1000 + i, 700)[:5000] + " ", "string")
    docs = docs.withColumn("text", F.concat(lead("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 3)))
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in operator(docs, labels).collect() if r.held_out]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


def test_training_sample_bounds_rows_not_texts(spark, monkeypatch):
    rows = [(i, f"{i} " + "word " * 2000) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    for most, count in ((toxicity.SAMPLE_BYTES, 5), (10_000, 1), (25_000, 3)):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", most)
        got = toxicity.training_sample(docs, labels, "toxic", F.lit(True), {1: 5, 0: 5})
        assert [len(got[m]) for m in (0, 1)] == [count, count]
        assert set(got[0] + got[1]) <= {t for _, t in rows}


@pytest.mark.parametrize("marks", ["false", "quality = 1", "quality = 0"])
def test_quality_stage_without_both_classes(spark, tmp_path, marks):
    docs, labels = labelled(spark)
    labels.where(marks).write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.drop_low_quality(spark, docs, str(tmp_path)).count() == docs.count()
