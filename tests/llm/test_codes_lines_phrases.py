"""Vector codes, line runs and phrases against brute-force versions and odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import line_runs, phrases, vector_codes

PARTS, ENTRIES, ROUNDS = 4, 5, 3


# vector codes


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.integers(0, 10_000), st.sampled_from([2, 9, 1000]))
def test_orchard_search_is_exact(n, width, seed, spread):
    rng = np.random.default_rng(seed)
    entries, parts = rng.integers(-spread, spread, (n, width)), rng.integers(-spread, spread, (60, width))
    best, found = vector_codes.OrchardLists(entries).nearest(parts)
    away = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
    assert best.tolist() == away.argmin(axis=1).tolist() and found.tolist() == away.min(axis=1).tolist()


def coded_by_hand(rows):
    """(codes and error of each kept row in order, all entries) by plain loops."""
    kept = [(k, v) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(1024 * x) for x in v] for _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])) if len(v) == 8]
    cut = [[v[2 * p : 2 * p + 2] for p in range(PARTS)] for v in whole]
    books = [[c[p] for c in cut[:ENTRIES]] for p in range(PARTS)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, q: min(range(len(books[p])), key=lambda e: (away(books[p][e], q), e))
    for _ in range(ROUNDS):
        groups = defaultdict(list)
        for c in cut:
            for p in range(PARTS):
                groups[p, nearest(p, c[p])].append(c[p])
        for (p, e), own in groups.items():
            books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    coded = []
    for key, v in kept:
        if len(v) != 8:
            coded.append((key, None, None))
            continue
        q = [math.floor(1024 * x) for x in v]
        codes = [nearest(p, q[2 * p : 2 * p + 2]) for p in range(PARTS)]
        coded.append((key, codes, sum(away(books[p][codes[p]], q[2 * p : 2 * p + 2]) for p in range(PARTS))))
    return coded, books


VECTORS = "vec_id long, embedding array<float>, label int, codes string, _v string"


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)]) for i in range(40)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (50, None), (51, []), (52, [0.5] * 7 + [None]), (53, [0.5] * 7 + [math.nan])]
    return rows + [(54, [0.5] * 7 + [math.inf]), (-1, [0.5] * 3), (-2, [0.25] * 12 + [0.1]), (60, [0.0] * 8), (61, [0.0] * 8)]


def test_vector_codes_of_odd_rows(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(k, v, 1, "x", "y") for k, v in rows], VECTORS).repartition(5)
    coded, books = vector_codes.compress(frame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS)
    want, entries = coded_by_hand(rows)
    order = lambda r: (repr(r[0]), repr(r[1:]))
    assert sorted(((r.vec_id, r.codes, r.error) for r in coded.collect()), key=order) == sorted(want, key=order)
    assert books.entries.tolist() == entries
    assert set(coded.columns) == {"vec_id", "label", "codes", "error"}
    back = vector_codes.decode(coded.where("codes is not null"), books).where("vec_id = 60").first()
    assert back.vector == [x / 1024 for p, c in enumerate(back.codes) for x in entries[p][c]]


def test_vector_codes_without_rows(spark):
    for rows in ([], [(1, None, 1, "x", "y")], [(1, [1.0, 2.0], 1, "x", "y")]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
        assert books is None and [r.codes for r in coded.collect()] == ([None] if rows and rows[0][1] else [])


def test_a_component_without_exact_code_raises(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, "x", "y")], VECTORS))


# line runs

LONG = "this line is long enough to be told apart"
LINES = [
    (1, f"{LONG}\nown words of the first\n  {LONG.upper()}\t\nend"), (2, f"  {LONG} \r\nnext"), (3, f"{LONG}\n{LONG}"), (4, f"x\n{LONG}\ny"),
    (5, None), (6, ""), (7, "\n\n"), (8, "short line\n" * 50), (9, "short line\nshort line"), (10, "short line"), (11, "é" * 20), (12, "É" * 20),
    (13, "é" * 20), (14, "é" * 20 + "\n" + "ü" * 19), (15, "ü" * 19), (16, "ü" * 19), (None, f"{LONG}\n{LONG}"), (17, "a twice held line of words\n" * 2),
    (18, "a twice held line of words"), (19, "word " * 40_000), (20, "word " * 40_000), (21, "word " * 40_000 + "\n" + "z" * 30),
]


def lines_by_hand(rows, holders=3, shortest=20):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= shortest:
                held[key(line)].add(doc_id)
    gone = {k: max(v) for k, v in held.items() if len(v) >= holders}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or gone.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def deduped(spark, rows, **more):
    frame = spark.createDataFrame([(i, t, "x", 1, "own") for i, t in rows], "doc_id long, text string, _lost string, n_lines int, source string")
    out = line_runs.drop_repeated_lines(frame.repartition(3), **more)
    assert set(out.columns) == {"doc_id", "text", "source", "n_lines", "n_dropped"}
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup_of_odd_rows(spark, batches):
    assert deduped(spark, LINES, batches=batches) == lines_by_hand(LINES)


def test_line_dedup_of_repeated_ids_and_empty_tables(spark):
    rows = [*LINES, (4, f"{LONG} and more\n{LONG}"), (4, f"x\n{LONG}\ny"), (2, "a twice held line of words")]
    assert deduped(spark, rows) == lines_by_hand(rows)
    assert deduped(spark, []) == []
    assert deduped(spark, [(None, "a"), (None, None)]) == lines_by_hand([(None, "a"), (None, None)])


def test_runs_are_compacted_by_level(spark):
    runs = line_runs.LineRuns(spark, holders=3, fanout=2)
    for doc_id in range(9, 0, -1):
        runs.add(spark.createDataFrame([(doc_id, h, -h) for h in (1, 2, doc_id % 3 + 10)], "doc_id long, hi long, lo long"))
    assert [len(level) for level in runs.levels] == [1, 0, 0, 1]
    assert {(r.hi, r["last"]) for r in runs.settled().collect()} == {(1, 9), (2, 9), (10, 9), (11, 7), (12, 8)}
    stored = sum(spark.table(name).count() for name in runs.runs())
    assert stored == 6  # (11, third holder) beside the five merged lines: what is settled is not stored again
    runs.drop()
    assert spark.sql(f"SHOW DATABASES LIKE '{runs.database}'").isEmpty()


# phrases

PHRASES = [
    ("en", "The big red bus stops. The big red bus, the big red bus; big Red bus! a a a a a"), ("en", "big red bus " * 6), (None, "und so weiter. " * 5),
    ("und", "und so weiter"), ("en", None), ("en", ""), ("en", ".,;:!?\n\r\x0b\x0c \t"), ("fr", "il y a\til y a\nil y a: il y\x0ba"), ("de", "É É É é É É É"),
    ("en", "same words " * 3000), ("en", "no\xa0split here " * 4), ("fr", "'=' \x1c odd \x00 signs " * 4),
] * 2


def phrases_by_hand(rows, longest=4, least=5, covered=80, top=2000):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    total, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = defaultdict(list)
    for (lang, *words), a in candidates.items():
        k = len(words)
        if any(
            g[0] == lang and len(g) - 1 > k and any(list(g[1:])[i : i + k] == words for i in range(len(g) - k)) and 100 * b >= covered * a
            for g, b in candidates.items()
        ):
            continue
        cuts = [(2_000_000 * a // (f[lang, *words[:c]] + f[lang, *words[c:]]), c) for c in range(1, k)]
        score, c = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:c]], f[lang, *words[c:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, own in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1)
    )


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string")
    return sorted(tuple(r) for r in phrases.mine_phrases(frame.repartition(3), **more).collect())


@pytest.mark.parametrize("longest", [2, 3, 4, 6])
def test_phrases_of_odd_rows(spark, longest):
    assert mined(spark, PHRASES, longest=longest, least=5) == phrases_by_hand(PHRASES, longest)


def test_phrases_without_words_and_top(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "...")]) == []
    assert mined(spark, PHRASES, least=5, top=3) == phrases_by_hand(PHRASES, top=3)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=120), st.integers(2, 5), st.sampled_from([1, 2, 4]))
def test_chunks_hold_each_run_once(text, longest, size):
    got, want = Counter(), Counter()
    first, parsed, last = phrases.chunks([b"a b", text.encode(), b""], longest, size)
    assert first == phrases.chunks([b"a b"], longest, size)[0] and last == []
    if parsed:
        block = phrases.Block("en", [(c, 1) for c in parsed], longest)
        for k in range(1, longest + 1):
            got.update(dict(zip(*block.exact(k, {}))))
    for piece in re.split("[.\n]", text):
        own = piece.split()
        want.update(" ".join(own[i : i + k]).encode() for k in range(1, longest + 1) for i in range(len(own) - k + 1))
    assert got == want


def test_equal_passages_share_chunks():
    passage = " ".join(f"w{i}" for i in range(600))
    one, other = map(set, phrases.chunks([f"{start} {passage} and then".encode() for start in ("first", "some other words")]))
    assert len(one & other) >= len(one) - 3


def test_score_of_counts_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "x", big + 1), ("en", 1, "y", big), ("en", 2, "x y", big - 1)], "lang string, k int, phrase string, n long")
    assert phrases.scored(counts).first().score == 2_000_000 * (big - 1) // (2 * big + 1)
