import random
from collections import defaultdict

import numpy as np
from tests.llm.conftest import frame

from spanloom.llm import paragraph_dedup, passages

LEAST = -(2**63)


def runs_of(covered):
    return [(a, b) for a, b in zip(sorted(i for i in covered if i - 1 not in covered), sorted(i + 1 for i in covered if i + 1 not in covered))]


def passages_of(rows, n=passages.WORDS):
    """All windows of n words against all; for each row (line, first document, word, number of words) of its passages."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    windows = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] for w in words]
    holders, first = defaultdict(set), {}
    for (d, t), own in zip(rows, windows):
        for x in own:
            holders[x].add((d, t))
            first[x] = min(first.get(x, 2**62), LEAST if d is None else d)
    for (d, t), own in zip(rows, windows):
        covered, line_of = defaultdict(set), [k for k, x in enumerate((t or "").encode().split(b"\n")) for _ in x.split()]
        for i, x in enumerate(own):
            if len(holders[x]) > 1:
                covered[first[x]] |= set(range(i, i + n))
        yield {(line_of[s], None if f == LEAST else f, s, e - s) for f, x in covered.items() for s, e in runs_of(x)}


def listed(row):
    return {(c.line, c.first_doc_id, c.word, c.n_words) for c in row.clusters if c.first_line is None}


def against_all_windows(spark, rows):
    got = paragraph_dedup.paragraph_dedup(frame(spark, rows)).collect()
    want = defaultdict(list)
    for (d, _), x in zip(rows, passages_of(rows)):
        want[d].append(sorted(x, key=str))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(sorted(listed(r), key=str))
    assert len(got) == len(rows) and {d: sorted(x, key=str) for d, x in found.items()} == {d: sorted(x, key=str) for d, x in want.items()}
    assert any(x for y in want.values() for x in y)


def test_passages_of_odd_rows(spark, rows):
    again = [(300, "w " * 200), (301, "other " + "w " * 60), (302, "own " * 90), (None, rows[7][1].upper()), (303, " ".join(map(str, range(70)))), (303, "x " + " ".join(map(str, range(70))))]
    against_all_windows(spark, rows + again)


def test_passages_that_overlap(spark):
    """Pieces of a few texts, cut and put together at random, so that keys have many leaves and first documents change within a run."""
    r = random.Random(4)
    base = [[f"w{r.randrange(5000)}" for _ in range(130)] for _ in range(3)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(r.randrange(1, 4)):
            own, s = r.choice(base), r.randrange(80)
            text += own[s : s + r.randrange(30, 80)] + [f"x{r.randrange(10**6)}" for _ in range(r.randrange(20))]
        rows.append((i, "".join(w + r.choice(" \n  ") for w in text)))
    against_all_windows(spark, rows)


def test_anchors_do_not_depend_on_chunks():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 3000, np.uint64)
    h[2000:2100] = h[100:200]
    starts, ends = np.array([0, 700, 720]), np.array([700, 720, 3000])
    windows = lambda chunk: {(d, p - x, int(k)) for a in passages.anchors_of(h, starts, ends, chunk) for d, k, _, p, lo, hi in zip(*(x.tolist() for x in a)) for x in range(lo, hi + 1)}
    whole = windows(1 << 18)
    assert len(whole) == 700 - 47 + 2280 - 47 and windows(64) == windows(999) == whole


def test_query_names_passages_within_lines(spark, tmp_path):
    """A passage of 51 words in the midst of two lines is named in both; a short line alone that repeats is not, nor is anything of other rows."""
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, greeting = text(51), text(8)
    rows = [(i, f"{text(30)} {passage} {text(40)}\n{text(9)}") for i in (3, 9)] + [(4, f"{text(30)}x{passage.upper()}x{text(40)}")]
    rows += [(i, f"{text(100)}\n{greeting}\n{text(60)}") for i in (5, 6)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in paragraph_dedup.op6_paragraph_minhash(spark, str(tmp_path)).collect()}
    as_found = {d: [(c.line, c.first_doc_id, c.first_line, c.removed, c.word, c.n_words) for c in x.clusters] for d, x in got.items()}
    assert as_found == {3: [(0, 3, None, False, 30, 51)], 9: [(0, 3, None, False, 30, 51)], 4: [(0, 3, None, False, 30, 49)], 5: [], 6: []}
    assert {d: x.text for d, x in got.items()} == dict(rows)
