import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import frame

from spanloom.llm import components, exact_dedup, jaccard, line_dedup, paragraph_dedup, simhash, suffix_dedup

SPACE = re.compile("[\x20\x09-\x0d]")


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("counters", [2, 4096])
def test_exact_dedup(spark, rows, counters):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i, k))
    want = [(g[3] and g[2] if False else g[2], min(v)[2], len(v), g == min(v), s) for s, v in groups.items() for g in v]
    got = exact_dedup.exact_dedup(frame(spark, rows), counters=counters).collect()
    assert by_key(got) == by_key(want)
    kept = exact_dedup.keep_distinct(frame(spark, rows))
    assert len(kept.columns) == 10 and by_key((r.doc_id, r.text) for r in kept.collect()) == by_key(rows[min(g)[3]] for g in groups.values())


def test_exact_dedup_at_the_least_id(spark):
    least = -(2**63)
    got = exact_dedup.exact_dedup(frame(spark, [(least, "a"), (5, "a"), (None, "a"), (least, "b"), (None, "b ")])).collect()
    assert by_key((r.doc_id, r.keep_id, r.kept) for r in got) == by_key([(least, least, True), (5, least, False), (None, least, False), (least, None, False), (None, None, True)])


def test_misra_gries_finds_every_frequent_item():
    r = np.random.default_rng(0)
    items = np.concatenate([np.repeat([7, 9], 4000), r.integers(100, 10**6, 12_000)])
    r.shuffle(items)
    found = exact_dedup.MisraGries(8)
    for part in np.array_split(items, 10):
        found.add(part)
    assert {7, 9} <= set(found.counts) and len(found.counts) <= 8
    assert 4000 - len(items) / 9 <= found.counts[7] <= 4000


def cover(rows, match):
    starts = Counter(b[i : i + match] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - match + 1))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if starts[b[i : i + match]] > 1:
                gone[i : i + match] = b"\1" * match
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        yield d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("k, hot", [(8, 1024), (16, 6), (8, 2)])
def test_suffix_dedup(spark, k, hot):
    r = random.Random(5)
    passages = ["".join(r.choice("abcdé ") for _ in range(90)) for _ in range(4)]
    piece = lambda: r.choice([r.choice(passages)[r.randrange(10) : r.randrange(30, 90)], "".join(r.choice("abc") for _ in range(r.randrange(20))), "a" * 25])
    rows = [(i, "".join(piece() for _ in range(r.randrange(7)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, passages[0]), (5, passages[0]), (5, passages[0]), (None, "x" * 60)]
    got = suffix_dedup.removals(frame(spark, rows), match=40, k=k, hot=hot).collect()
    assert by_key(got) == by_key(cover(rows, 40))


def test_suffix_dedup_at_full_length(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    small = [x for x in rows if len(x[1] or "") < 60_000]
    assert by_key(suffix_dedup.removals(frame(spark, small)).collect()) == by_key(cover(small, 400))
    kept = {(r[0], r[1]) for r in suffix_dedup.without_repeats(frame(spark, small)).select("doc_id", "text").collect()}
    assert (200, None) in kept and (203, "日本語 テキスト 😀") in kept and len(kept) == len(set((i, t) for i, t in kept))


def test_chunks_don_t_matter():
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    starts, ends = np.array([0, 1200, 1250]), np.array([1200, 1250, 5000])
    for chunk in (300, 1 << 19):
        windows = defaultdict(int)
        for part in suffix_dedup.anchors_of(data, starts, ends, 40, 8, chunk):
            for doc, _, _, _, place, lo, hi in zip(*part):
                for o in range(lo, hi + 1):
                    windows[int(doc), int(place - o)] += 1
        assert windows == {(d, p): 1 for d, (s, e) in enumerate(zip(starts, ends)) for p in range(e - s - 39)}


def test_maximal_repeats():
    rows = [(b"ba", b"cde1"), (b"ba", b"cde2"), (b"bx", b"cde3"), (b"ba", b"cdz")]
    groups = sorted((left, right, sorted(m)) for left, right, m in suffix_dedup.maximal_repeats(rows, 3))
    assert groups == [(1, 3, [0, 1, 2]), (2, 2, [0, 1, 3]), (2, 3, [0, 1])] or (1, 2, [0, 1, 2, 3]) in groups
    for left, right, m in groups:
        assert len({rows[i][0][:left] + rows[i][1][:right] for i in m}) == 1


def lines_of(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for n, (d, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add((d is not None, d or 0, n))
    gone = {k: max(v)[:2] for k, v in held.items() if len(v) >= 3}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == (d is not None, d or 0)]
        yield d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup_and_its_reversal(spark, rows):
    docs = frame(spark, rows)
    assert by_key(line_dedup.line_dedup(docs).collect()) == by_key(lines_of(rows))
    part = frame(spark, rows[:30])
    index = line_dedup.LineIndex.build(part, shards=4)
    whole = index.insert(frame(spark, rows[30:]))
    assert by_key(line_dedup.line_dedup(docs, whole).collect()) == by_key(lines_of(rows))
    back = whole.delete(frame(spark, rows[30:]))
    assert by_key(back.frequent.collect()) == by_key(index.frequent.collect())
    assert by_key(back.drops().select("rd").collect()) == by_key(index.drops().select("rd").collect())
    count = lambda x: sum(int((line_dedup.Cuckoo.frombytes(bytes(r[1])).slots > 0).sum()) for r in x.filters.collect())
    assert count(back) == count(index) == index.frequent.count()


@pytest.mark.parametrize("shards", [4, None])
def test_line_index_grows(spark, shards):
    """Insertions of ten times the keys: filters that are full are built anew, and nothing is lost."""
    line = lambda k: f"line number {k} of the common ones"
    batch = lambda a, b, ids: [(i, "\n".join(line(k) for k in range(a, b))) for i in ids]
    index = line_dedup.LineIndex.build(frame(spark, batch(0, 100, range(3))), shards=shards)
    rows = batch(0, 100, range(3))
    for a, b, ids in ((100, 200, range(3, 6)), (200, 1400, range(6, 9))):
        index = index.insert(frame(spark, batch(a, b, ids)))
        rows += batch(a, b, ids)
    assert index.frequent.count() == 1400 and index.filters.where("filter is null").count() == 0
    assert by_key(line_dedup.line_dedup(frame(spark, rows), index).collect()) == by_key(lines_of(rows))


def test_cuckoo_filter():
    r = np.random.default_rng(2)
    a, b = r.integers(-(2**62), 2**62, (2, 3000)), r.integers(-(2**62), 2**62, (2, 3000))
    f = line_dedup.Cuckoo(6000).insert(*a).insert(*b)
    assert f.contains(*a).all() and f.contains(*b).all()
    f = line_dedup.Cuckoo.frombytes(f.delete(*b).tobytes())
    assert f.contains(*a).all() and f.contains(*b).mean() < 0.01


def print_of(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, rows):
    prints = [(i, print_of(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    want = [(i, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(prints)]
    assert by_key(simhash.near_dedup(frame(spark, rows)).collect()) == by_key(want)


def test_keep_one_goes_by_rows(spark):
    """Unrelated texts without an id, or under one id, all stay; a copy without an id goes."""
    texts = [" ".join(f"{w}{k}" for k in range(30)) for w in ("red", "green", "blue", "grey", "pink")]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (9, texts[2]), (7, texts[2])]
    got = simhash.keep_one(frame(spark, rows)).select("doc_id", "text").collect()
    assert by_key(got) == by_key([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])])


@pytest.mark.parametrize("bucket", [2, 1024])
def test_covering_tables_lose_no_pair(spark, bucket):
    assert simhash.covered(3, 1) and simhash.covered(3, 2)
    r = random.Random(1)
    prints = [r.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = r.choice(prints)
        for _ in range(r.randrange(5)):
            x ^= 1 << r.randrange(64)
        prints.append(x)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = components.connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=bucket)).collect()
    comp = {p: p for p in signed}
    for _ in range(20):
        for a in signed:
            comp[a] = min(comp[b] for b in signed if ((a ^ b) % 2**64).bit_count() <= 3)
    linked = {p: c for p, c in comp.items() if sum(x == c for x in comp.values()) > 1}
    assert dict((r[0], r[1]) for r in got) == linked


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert dict(components.connected_components(edges).collect()) == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def sets_of(rows):
    for n, (d, t) in enumerate(rows):
        for k, line in enumerate((t or "").encode().lower().split(b"\n")):
            w = line.split()
            if len(w) >= 5:
                yield n, d, k, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def joined_by(found, near):
    """The least number of what all pairs connect, by a plain fixed point."""
    comp = list(range(len(found)))
    pairs = [(i, j) for i in range(len(found)) for j in range(i) if near(found[i], found[j])]
    before = None
    while comp != before:
        before = list(comp)
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def paragraphs_of(rows, least=20):
    found = list(sets_of(rows))
    comp = joined_by([x[3] for x in found], alike)
    size, first = Counter(comp), {}
    for i, (n, d, k, _) in enumerate(found):
        first[comp[i]] = min(first.get(comp[i], (True, 2**60, 0)), (d is not None, d or 0, k))
    copies = {(n, k) for i, (n, d, k, _) in enumerate(found) if size[comp[i]] > 1 and first[comp[i]] != (d is not None, d or 0, k)}
    for n, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        gone, k = set(), 0
        while k < len(lines):
            run = 0
            while (n, k + run) in copies:
                run += 1
            if sum(len(x.split()) for x in lines[k : k + run]) >= least:
                gone |= set(range(k, k + run))
            k += run + 1
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        yield d, kept, len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("bucket", [3, 1024])
def test_paragraph_dedup(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    got = paragraph_dedup.paragraph_dedup(frame(spark, rows)).drop("clusters").collect()
    assert by_key(got) == by_key(paragraphs_of(rows))


def test_paragraphs_of_a_table(spark, tmp_path):
    """op6 over whole documents against all pairs of lines that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = paragraph_dedup.op6_paragraph_minhash(spark, "/root/testdata/sf0.001").drop("clusters").collect()
    want = {r[0]: r for r in paragraphs_of(rows)}
    wrong = [r.doc_id for r in got if tuple(r) != want[r.doc_id]]
    assert len(got) == len(rows) and len(wrong) <= len(rows) // 100  # a pair has a chance of 0.2 % to share no band
    assert sum(r.n_removed for r in got) > 0


def near_texts(sizes, copies, seed=11):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = []
    for size in sizes:
        base = [word() for _ in range(size)]
        texts.append(base)
        for _ in range(copies):
            near = list(base)
            for at in r.sample(range(size), max(1, size // 50)):
                near[at] = word()
            texts.append(near)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("bucket", [2, 5, 1024])
def test_large_buckets_lose_no_pair(spark, monkeypatch, bucket):
    """Whatever the bound, all pairs of 0.8 that share a band are linked; many share one band only, and that with others."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rows = list(enumerate(near_texts([60] * 30 + [24, 40, 90, 200], 7)))
    sets = [s for _, t in rows for _, s in paragraph_dedup.Shingler().paragraphs(t.encode())]
    keys = [paragraph_dedup.band_keys(s).tolist() for s in sets]
    near = lambda i, j: any(a == b for a, b in zip(keys[i], keys[j])) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    comp = joined_by(list(range(len(sets))), near)
    size = Counter(comp)
    got = paragraph_dedup.paragraph_clusters(frame(spark, rows)).select("rd", "first_rd").collect()
    assert by_key(got) == [(i, c) for i, c in enumerate(comp) if size[c] > 1]


@pytest.mark.parametrize("bucket", [3, 8, 1024])
def test_one_bucket_of_all(spark, bucket):
    """All sets share one key: links are just those of all pairs, though chains and several groups meet there."""
    r = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        base = r.integers(0, 1 << 60, 40).astype(np.uint64)
        for k in range(9):  # each is like the next, the first and last are not alike
            sets.append(np.unique(np.concatenate([base[k:], r.integers(0, 1 << 60, k).astype(np.uint64)])))
    common = r.integers(0, 1 << 60, 30).astype(np.uint64)  # in all sets, so that rarest shingles and blocks count
    sets = [np.unique(np.concatenate([s, common])) for s in sets] + [np.unique(s) for s in r.integers(0, 1 << 60, (5, 30)).astype(np.uint64)]
    comp = joined_by([frozenset(s.tolist()) for s in sets], alike)
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "cid long, shingles binary")
    keys = spark.createDataFrame([(i, 0, 7) for i in range(len(sets))], "cid long, band int, key long")
    got = dict(jaccard.links(keys, lambda cids: table, bucket).collect())
    assert got == {i: c for i, c in enumerate(comp) if Counter(comp)[c] > 1}


def test_paragraph_query_takes_wrapped_paragraphs(spark, tmp_path):
    """A text wrapped to lines of five to seven words is found again; a line of four words has no shingle, a short line alone stays."""
    lines = ["one two three four five", "six seven eight nine ten eleven", "b1 b2 b3 b4 b5 b6", "k l m n o p q", "a b c d", "e1 e2 e3 e4 e5"]
    frame(spark, [(1, "\n".join(lines)), (2, "\n".join(["own", *lines]))]).write.parquet(f"{tmp_path}/documents.parquet")
    got = paragraph_dedup.op6_paragraph_minhash(spark, str(tmp_path)).select("doc_id", "n_removed", "text").collect()
    assert by_key(got) == [(1, 0, "\n".join(lines)), (2, 4, "own\na b c d\ne1 e2 e3 e4 e5")]


def kept_of_near(rows):
    """Of each group of texts of a Jaccard of 0.8, on five words or the whole of fewer, the first row."""
    words = [tuple((t or "").encode().lower().split()) for _, t in rows]
    sets = [frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) for w in words]
    comp = joined_by(sets, alike)
    best = {}
    for k, (d, t) in enumerate(rows):
        best[comp[k]] = min(best.get(comp[k], (True, 2**63, 0, "", None)), (d is None, d or 0, -len(t or ""), hashlib.sha256((t or "").encode()).hexdigest(), t))
    return [(None if lone else d, t or "") for lone, d, _, _, t in best.values()]


@pytest.mark.parametrize("bucket", [3, 1024])
def test_keep_one_against_all_pairs(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rows = rows + [(1000 + i, t) for i, t in enumerate(near_texts([120, 300, 80], 6, 2))]
    got = [(r.doc_id, r.text or "") for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert by_key(got) == by_key(kept_of_near(rows))


def test_near_copies_are_found(spark):
    """Recall of the pipeline's stage, over a whole table: pairs of 0.8 by all that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {" ".join((r.text or "").lower().split()): r.doc_id for r in docs.orderBy("doc_id", ascending=False).collect()}
    sets = [frozenset(w[i : i + 5] for i in range(len(w) - 4)) for t in texts for w in [tuple(t.split())] if len(w) > 4]
    ids = [i for t, i in texts.items() if len(t.split()) > 4]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((i, j) for own in holders.values() if 1 < len(own) < 400 for i in own for j in own if i < j)
    pairs = [(ids[i], ids[j]) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    comp = {r.doc_id: r.component for r in simhash.similar_classes(docs).collect()}
    assert len(pairs) > 3 and sum(comp[a] == comp[b] for a, b in pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("hot", [1024, 3])
def test_repeat_groups(spark, hot):
    r = random.Random(5)
    passages = ["".join(r.choice("abcdé ") for _ in range(90)) for _ in range(3)]
    piece = lambda: r.choice([r.choice(passages)[r.randrange(10) : r.randrange(30, 90)], "".join(r.choice("abc") for _ in range(r.randrange(20)))])
    rows = [(i, "".join(piece() for _ in range(r.randrange(7)))) for i in range(50)] + [(60, passages[0]), (60, passages[0] + "x"), (None, passages[0])]
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t.encode())
    found = suffix_dedup.repeat_groups(frame(spark, rows), match=40, k=8, hot=hot).collect()
    groups, covered = defaultdict(set), defaultdict(set)
    keys = {(g.doc_id, g.rk) for g in found}
    text_of = {}
    for d, k in keys:
        text_of[d, k] = [t for t in texts[d] if all(g.e <= len(t) for g in found if (g.doc_id, g.rk) == (d, k))]
    for g in found:
        groups[g.grp].add((g.doc_id, g.rk, g.s, g.e))
        covered[g.doc_id, g.rk] |= set(range(g.s, g.e))
    count = lambda x: sum(1 for _, t in rows for i in range(len(t.encode())) if t.encode()[i : i + len(x)] == x)
    for members in groups.values():
        strings = [{t[s:e] for t in text_of[d, k]} for d, k, s, e in members]
        same = set.intersection(*strings)
        assert same and len(members) > 1 and all(e - s >= 40 for _, _, s, e in members)
        if hot == 1024:
            assert count(same.pop()) == len(members)
    want = sum(n for _, _, n, *_ in cover(rows, 40))
    assert sum(len(x) for x in covered.values()) == want


def removed_passages(rows, match, least):
    starts = Counter(b[i : i + match] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - match + 1))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if starts[b[i : i + match]] > 1:
                gone[i : i + match] = b"\1" * match
        out, i = b"", 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j] == gone[i]:
                j += 1
            if not gone[i] or len(b[i:j].split()) < least:
                out += b[i:j]
            i = j
        yield d, out.decode(errors="ignore")


def test_without_repeats(spark, rows):
    small = [x for x in rows if len(x[1] or "") < 60_000]
    for match, k, least in ((200, 64, 50), (400, 128, 0)):
        got = suffix_dedup.without_repeats(frame(spark, small), match, k, least_words=least).collect()
        assert by_key((r.doc_id, r.text or "") for r in got) == by_key(removed_passages(small, match, least))
        assert {r.doc_id for r in got if r.text is None} == {200, None}


def test_suffix_query_takes_passages(spark, rows, tmp_path):
    """Passages of 50 words that are shorter than 400 bytes go from the text; the contract's columns are as before."""
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(n))
    passages, long = [prose(55) for _ in range(3)], "x" + prose(100)
    assert all(200 < len(p) < 380 for p in passages) and len(long) > 410
    made = [(1000 + i, f"{prose(40)}\n{prose(6)} {passages[i % 3]} {prose(60)}") for i in range(9)]
    made += [(2000 + i, f"{prose(30)} {long[i:][: 395 + 5 * i]} {prose(20)}{passages[0]}") for i in range(4)] + [(3000, "é" + long), (3001, None), (3002, prose(80))]
    small = [x for x in rows if len(x[1] or "") < 60_000] + made
    frame(spark, small).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_dedup.op2_suffix_array_dedup(spark, str(tmp_path)).collect()
    assert by_key(tuple(r)[:5] for r in got) == by_key(cover(small, 400))
    assert by_key((r.doc_id, r.text) for r in got) == by_key(removed_passages(small, 200, 50))
    found = {r.doc_id: r for r in got}
    assert all(found[d].n_removed == 0 and found[d].n_passages == 1 and t.replace(passages[d % 1000 % 3], "").startswith(found[d].text[:40]) for d, t in made[:9])
    assert found[2003].n_removed > 0 and found[3002].text == made[-1][1]


@pytest.mark.parametrize("what", [exact_dedup.exact_dedup, suffix_dedup.removals, simhash.near_dedup, line_dedup.line_dedup, paragraph_dedup.paragraph_dedup])
def test_empty_table(spark, what):
    assert what(frame(spark, [])).collect() == []
