"""Alignment, packing and the prefix trie against brute force, odd cases included."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from litlake.llm import alignment, packing, prefix_trie, tokens
from tests.llm import cases

SPECIAL = [
    "<|endoftext|>",
    "a<|endoftext|>b <|startoftext|> <s> </s> <unk> <0x41>",
    "two  spaces   three\tand\n\nlines \r\n end ",
    " leading and trailing ",
    "don't we'll I'M 3.14 20000",
    "underscore ▁ piece",
    "no break​zero é İstanbul ﬁ \x00 \x1c x",
    "漢字かな交じり文 без кириллицы 🙂🙃",
    "x" * 5000,
    "a ~ b a~b ~~ ~",
    "End. Of, a.b; c...d (e) it's!I é. x.é U.S.A. 3.5.x <=\u0338 .\u0301a a.\u0301",
    "-" * 3000 + " " * 400 + ".",
]


@pytest.fixture(scope="module")
def docs(spark):
    more = [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(SPECIAL)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = spark.createDataFrame(more, names)
    return cases.documents(spark).unionByName(extra, allowMissingColumns=True).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_words_are_encoded_as_in_their_text(rows):
    """Ids of whole texts are those of their words, for all three tokenizers."""
    texts = [t for _, t in rows if t]
    model = tokens.tokenizer(packing.VOCABULARY, False)
    for text, parts in zip(texts, packing._encoder(packing.VOCABULARY).texts(texts), strict=True):
        expected = model.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(parts), "<u2").tolist() == expected


def test_remembered_words_come_back(monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 8)
    asked = Counter()

    def compute(ws):
        asked.update(ws)
        return [w.upper() for w in ws]

    memory = tokens.Remembered(compute, remember=6)
    texts = ["a b c", "a d", "e f g", "a b", "", "h " + "y" * 99]
    assert [" ".join(x) for x in memory.texts(texts)] == [t.upper() for t in texts]
    assert len(memory.known) <= 9 and "y" * 99 not in memory.known


def brute_alignment(rows):
    """Per row the numbers of the contract, tokens of whole texts walked one by one."""
    bytes_a = alignment.bytes_of_a(alignment.VOCABULARY_A)
    bytes_b = alignment.bytes_of_b(alignment.VOCABULARY_B)
    a_model = tokens.tokenizer(alignment.VOCABULARY_A, True)
    b_model = tokens.piece_model(alignment.VOCABULARY_B)
    found, count = [], Counter()
    for _, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            found.append(None)
            continue
        spans = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            ends = np.cumsum([len(of[i]) for i in ids])
            spans.append(list(zip(np.r_[0, ends[:-1]], ends, ids)))
        links, j = [], 0
        for start, end, i in spans[0]:
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < end:
                links.append((i, spans[1][k][2]))
                k += 1
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for end in shared:
            sides = [",".join(str(i) for s, e, i in side if last <= s and e <= end) for side in spans]
            groups.append("|".join(sides))
            last = end
        count.update(links)
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, i), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, _), x in zip(rows, found, strict=True):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = sum(count[p] == best[p[1]] for p in x[3])
        digest = hashlib.sha256(";".join(x[2]).encode()).hexdigest()
        out.append((doc_id, x[0], x[1], len(x[2]), len(x[3]), n_best, sum(count[p] for p in x[3]), digest))
    return out


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def shorter(docs, rows):
    """Without the very long prose, which the walk takes minutes for."""
    return docs.where("coalesce(length(text), 0) < 20000"), [r for r in rows if len(r[1] or "") < 20_000]


@pytest.mark.parametrize("entries", [1_000_000, 40])
def test_alignment(shorter, entries):
    docs, rows = shorter
    got = plain(alignment.align(docs, entries=entries))
    assert cases.same(got, brute_alignment(rows))


def test_alignment_of_nothing(docs):
    assert plain(alignment.align(cases.empty(docs))) == []
    assert plain(alignment.align(docs.where("text is null or text = ''")))[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_pair_counts(shorter):
    docs, rows = shorter
    found = alignment.pair_counts(alignment.postings(docs, entries=100))
    links = sum(r[4] for r in brute_alignment(rows))
    assert found.agg({"n_links": "sum"}).first()[0] == links
    assert found.where("n_docs > n_links or n_docs < 1").count() == 0


def test_bitmaps():
    """Sparse and dense bitmaps give their places back."""
    rng = np.random.default_rng(3)
    sets = {7: np.arange(5000), 9: np.array([0, 65_535]), 12: np.sort(rng.permutation(65_536)[:4096])}
    pairs = np.concatenate([np.full(len(v), k, "<u4") for k, v in sets.items()])
    places = np.concatenate(list(sets.values())).astype("<u2")
    seen = {}
    for names, n, held in alignment.bitmaps(pairs, places):
        back = alignment.places_of(n.to_numpy(), held)
        at = np.r_[0, np.cumsum(n.to_numpy())]
        for i, name in enumerate(names.to_pylist()):
            assert len(held[i].as_py()) <= 8192
            seen[name] = back[at[i] : at[i + 1]]
    assert seen.keys() == sets.keys()
    assert all((seen[k] == sets[k]).all() for k in sets)


def check_pieces(rows, got, length):
    model = tokens.tokenizer(packing.VOCABULARY, False)
    expected = Counter()
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, packing.END]
        expected[(doc_id, tuple(ids))] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    for doc_id in by_doc:
        ids = sorted(i for d, i in expected.elements() if d == doc_id)
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, ids))
        if len(ids) == 1:  # repeated ids can't be told apart by piece
            whole = b"".join(p.ids for p in sorted(by_doc[doc_id], key=lambda p: p.start))
            assert np.frombuffer(whole, "<u4").tolist() == list(ids[0])
            assert all(p.doc_tokens == len(ids[0]) for p in by_doc[doc_id])
    assert by_doc.keys() == {d for d, _ in rows}
    return padding, total


@pytest.mark.parametrize("length, group", [(4096, 1 << 20), (64, 500), (4, 10)])
def test_packing(docs, rows, length, group):
    got = packing.pack(docs, length, group).collect()
    padding, total = check_pieces(rows, got, length)
    assert padding <= packing.LEAST_CUT * (total / length + 1)


def test_packing_checksums(docs):
    for p in packing.packed_pieces(docs.where("doc_id = 6")).collect():
        ids = tokens.tokenizer(packing.VOCABULARY, False).encode(cases.TEXTS[6], add_special_tokens=False).ids
        assert p.ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4")[p.start : p.start + p.length].tobytes())


def test_packing_of_nothing(docs):
    assert packing.packed_pieces(cases.empty(docs)).collect() == []


def test_first_fit_decreasing():
    """The tree finds the bins that a plain scan finds; nothing is lost when gaps are filled."""
    draw = random.Random(5)
    for size in (7, 64, 4096):
        lengths = [draw.randint(1, size) for _ in range(300)]
        rooms, expected = [], []
        for i in sorted(range(300), key=lambda i: -lengths[i]):
            at = next((k for k, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
            if at == len(rooms):
                rooms.append(size)
                expected.append([])
            rooms[at] -= lengths[i]
            expected[at].append((i, 0, lengths[i]))
        found = packing.first_fit_decreasing(lengths, size)
        assert found == expected
        bins = packing.without_gaps(found, size)
        spans = sorted(c for b in bins for c in b)
        for i in range(300):
            at = 0
            for _, start, n in [c for c in spans if c[0] == i]:
                assert start == at
                at += n
            assert at == lengths[i]
        levels = [sum(n for *_, n in b) for b in bins]
        assert all(n <= size and (n & (n - 1) == 0 or size - n < packing.LEAST_CUT) for n in levels)


def brute_trie(rows):
    """Rows (conv_id, turn, role, text) to the nodes of the trie of rebuilt conversations."""
    original = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            original[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(ts)] for c, ts in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = [*original.get(c - c % 5, [])[:h], *own[h:]]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, cs in members.items():
        below = [w for w in members if w[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(k))
        saved = sum((len(members[w]) - 1) * len(w[-1][1].encode()) for w in below if w)
        parent = min(members[k[:-1]]) if k else None
        leaves = sum(children[w] == 0 for w in below)
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(cs), len(k), parent, len(cs), children[k], leaves, saved, digest))
    return out


def conversation_rows(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 40), 1003, 1004, 2000]:
        for t in range(draw.choice([0, 1, 2, 3, 5, 9, 14])):
            text = draw.choice(["hello", "hello", "", None, "é" * 3, f"own {c}"])
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None]), text))
    for c in range(50, 90):  # one common conversation and a long one with many copies
        rows += [(c, t, "user", "same") for t in range(4 if c % 2 else 23)]
    rows += [(7, 1, "user", "twice"), (7, 1, "user", "twice"), (None, 0, "user", "nobody")]
    rows += [(60, 100 + t, "user", str(t % 3)) for t in range(30)]
    return rows


@pytest.mark.parametrize("seed, piece, run", [(1, 1 << 16, 1 << 16), (2, 8, 3), (3, 4, 1)])
def test_prefix_trie(spark, seed, piece, run, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", run)
    rows = conversation_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for name in ("place", "depth", "n1", "lo", "size", "h", "use", "n", "least", "items"):
        df = df.withColumn(name, df["role"])
    assert cases.same(plain(prefix_trie.rebuilt_trie(df)), brute_trie(rows))


def test_prefix_trie_of_little(spark):
    kinds = "conv_id long, turn long, role string, text string"
    nothing = spark.createDataFrame([(None, 0, "user", "x")], kinds)
    assert plain(prefix_trie.rebuilt_trie(nothing)) == []
    for rows in ([(5, None, None, None)], [(2, 0, "user", "h is 8 or less")], [(1, 0, "a", "b"), (6, 0, "a", "b")]):
        df = spark.createDataFrame(rows, kinds)
        assert cases.same(plain(prefix_trie.rebuilt_trie(df)), brute_trie(rows))


