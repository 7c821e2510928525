"""Small tables with the odd cases, and brute-force versions of the operators."""

import hashlib
import re

CLASHING = (
    "d th h cd place node key salt size score predicted hits spans n_words base block text_ "
    "keys host path rule payload digest kind b q width asks source_key shard"
).split()

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 7] + str(x >> 16 & 63))
    return " ".join(out)


PASSAGE = prose(99, 60)
LONG = " ".join(prose(s, 900) for s in range(40))

TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "one two",
    "One TWO",
    "Ä ö ß é 漢字 \U0001f600 x",
    prose(1, 80),
    prose(1, 80),
    prose(1, 79) + " changed",
    prose(2, 300),
    prose(2, 299) + " x1",
    prose(2, 150) + " y " + prose(2, 300)[-900:],
    PASSAGE + " " + prose(3, 40),
    prose(4, 50) + " " + PASSAGE,
    PASSAGE.upper() + " " + prose(5, 20),
    "a" * 1000,
    "ab" * 450,
    LONG,
    LONG[:90_000] + " end",
    "é" * 400,
]


def documents(spark, extra=True):
    rows = [
        (i, t, "en", None if i % 5 == 0 else f"src{i % 3}", None if t is None else len(t))
        for i, t in enumerate(TEXTS)
    ]
    rows += [rows[7], (None, prose(1, 80), None, None, None), (None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, names).repartition(3)
    if extra:
        for name in CLASHING:
            df = df.withColumn(name, df["lang"])
    return df


def empty(df):
    return df.where("false")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def duplicate_groups(rows, size=5, num=8, den=10):
    """(doc_id, n_shingles, component_id) by comparing all pairs of sets."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (least.get(root(i)), doc_id) if x is not None]
        least[root(i)] = min(known) if known else None
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def repeated_bytes(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, _), b in zip(rows, data, strict=True):
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((doc_id, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, window=13):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, of = set(), set()
        for key, ids in windows.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    of |= ids
        digest = hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(of), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def same(got, expected):
    return sorted(map(repr, got)) == sorted(map(repr, expected))
