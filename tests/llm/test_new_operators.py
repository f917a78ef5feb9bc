"""Periodic runs, vector codes and source mixing against plain versions."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm.mixing import SCHEDULES, integrated, mix_sources, training_sequence
from harborline.llm.periodic import collapse_runs, find_runs, first_gram
from harborline.llm.queries import with_planted_runs
from harborline.llm.vector_codes import codebooks_sha256, compress_vectors, decode_vectors, hilbert_keys, nearest_entries, shortlist


def plain_runs(w, least=24, repeats=3):
    """Every lag, word by word; a stretch counts if no smaller lag fits it."""
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, repeats * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_match_every_lag_tried():
    assert (first_gram(24, 3), first_gram(3, 3), first_gram(24, 4)) == (16, 2, 18)
    r = random.Random(5)
    found = 0
    for _ in range(600):
        n, letters = r.randrange(150), r.choice([1, 2, 3, 50])
        w = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randrange(4)):
            if n > 5:
                s, p = r.randrange(n), r.randrange(1, 40)
                for i in range(s + p, r.randrange(s, n) + 1):
                    w[i] = w[i - p]
        least, repeats = r.choice([(24, 3), (10, 3), (6, 4), (30, 3)])
        want = plain_runs(w, least, repeats)
        assert find_runs(np.array(w, np.int64), least, repeats) == want
        found += len(want)
    assert found > 200
    # A period in which every short gram occurs twice.
    x, y = list(range(40)), list(range(40, 80))
    w = [*[900, 901], *((x + x + x + y + y + y + x + y) * 4)[:-5], 902]
    assert (2, 4 * 320 - 5, 320) in find_runs(np.array(w, np.int64))
    assert find_runs(np.array(w, np.int64)) == plain_runs(w)


def planted(i, w):
    if i is None or not w:
        return w
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]


def test_whole_query_on_runs(spark, docs, rows, nothing):
    more = [(10_000 + 7 * i + k, t) for i, (_, t) in enumerate(rows) if t and len(t) < 3_000 for k in range(3)]
    df = spark.createDataFrame([(i, t, "x") for i, t in [*rows, *more]], "doc_id long, text string, runs string")
    want = collections.Counter()
    for i, t in [*rows, *more]:
        w = planted(i, brute.words(t))
        runs = find_runs(np.array([hash(x) for x in w], np.int64) if w else np.zeros(0, np.int64)) if len(w) > 3_000 else plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, tuple(runs), best, brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), kept)] += 1
    got = collections.Counter()
    out = collapse_runs(with_planted_runs(df))
    assert out.columns == ["doc_id", "text", "runs", "longest_run", "runs_sha256", "collapsed"]
    for r in out.collect():
        got[(r["doc_id"], tuple(tuple(x) for x in r["runs"]), tuple(r["longest_run"]) if r["longest_run"] else None, r["runs_sha256"], r["collapsed"])] += 1
    assert got == want and sum(1 for k in want if k[1]) > 10
    assert collapse_runs(docs).columns[: len(docs.columns)] == docs.columns
    assert collapse_runs(nothing).count() == 0 and with_planted_runs(nothing).count() == 0


def test_a_very_long_text_of_one_word(spark):
    df = spark.createDataFrame([(1, "a " * 400_000), (2, "ab " * 30 + "x")], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in collapse_runs(df).collect()}
    assert got == {1: ([(0, 400_000, 1)], "a"), 2: ([(0, 30, 1)], "ab x")}


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(code, error, label_error) by row and the digest of the codebooks, all in Python's numbers."""
    ok = [(i, x, lab) for i, x, lab in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    n = -(-max((len(x) for _, x, _ in ok), default=1) // parts) * parts // parts
    cut = []
    for i, x, lab in ok:
        v = [int(np.floor(scale * float(c))) for c in x] + [0] * (n * parts - len(x))
        cut.append((i, [v[p * n : (p + 1) * n] for p in range(parts)], lab))
    ids = sorted({i for i, _, _ in cut}, key=lambda i: (i is None, i))[:entries]
    start = [min((v for i, v, _ in cut if i == k)) for k in ids]
    books = [[list(v[p]) for v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((far(v[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v, _ in cut:
            for p in range(parts):
                held[p, nearest(v, p)[1]].append(v[p])
        for (p, k), vs in held.items():
            books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    told = [(i, lab, [nearest(v, p) for p in range(parts)]) for i, v, lab in cut]
    label = collections.Counter()
    for _, lab, m in told:
        label[lab] += sum(f for f, _ in m)
    out = collections.Counter((i, lab, "".join(f"{k:02x}" for _, k in m), sum(f for f, _ in m), label[lab]) for i, lab, m in told)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<double>, label int, code string, rid int"


def vectors():
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 24)) * r.uniform(0.2, 3, (700, 1))
    x[100:330] = x[100]  # a third are equal
    x[650:] = np.round(x[650:], 1)
    rows = [(i * 3, [float(v) for v in x[i]], int(i % 5) if i % 7 else None, "c", 1) for i in range(700)]
    nan = [float("nan"), float("inf"), None]
    return rows + rows[:4] + [(None, rows[5][1], 1, "c", 1), (9_000, None, 1, "c", 1)] + [(9_001 + k, [v] * 24, 2, "c", 1) for k, v in enumerate(nan)]


@pytest.mark.parametrize("change", ["plain", "short", "long", "few"])
def test_vector_codes_match_plain_numbers(spark, change):
    rows = vectors()
    if change == "short":  # other lengths, an empty vector, not a multiple of 8
        rows = [(i, None if x is None else x[: (i or 1) % 22], lab, c, d) for i, x, lab, c, d in rows] + [(9_100, [], 1, "c", 1)]
    if change == "long":  # beyond what 64 bits can square
        rows += [(-5, [1e7] * 24, 1, "c", 1), (9_200, [-3.3e6] * 24, None, "c", 1)]
    if change == "few":
        rows = rows[:9]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    coded, books = compress_vectors(df)
    want, digest = plain_codes([(i, x, lab) for i, x, lab, _, _ in rows])
    assert codebooks_sha256(books) == digest
    assert collections.Counter(tuple(r) for r in coded.collect()) == want
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_codes_of_nothing_and_back(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    for empty in (df.limit(0), df.filter("embedding IS NULL")):
        coded, books = compress_vectors(empty)
        assert coded.count() == 0 and books.shape[1] == 0 and decode_vectors(coded, books).count() == 0
    coded, books = compress_vectors(df.filter("vec_id < 48"))
    near = decode_vectors(coded, books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    off = [np.abs(np.array(r["decoded"]) - np.array(r["embedding"])).max() for r in near]
    # Sixteen vectors are their own entries, up to one step of the scale.
    assert len(near) >= 16 and max(off) <= 1 / 4096


def test_boxes_leave_out_only_what_is_never_nearest():
    r = np.random.default_rng(1)
    left = 0
    for _ in range(300):
        book = r.integers(-50, 50, (16, 3))
        v = r.integers(-20, 20, (40, 3)) // r.integers(1, 9) + r.integers(-30, 30, 3)
        listed = shortlist(book, v.min(axis=0), v.max(axis=0))
        best, far = nearest_entries(book, v)
        short, near = nearest_entries(book[listed], v)
        assert (listed[short] == best).all() and (near == far).all()
        left += 16 - len(listed)
    assert left > 1000


def test_hilbert_neighbours_touch():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def plain_targets(sizes, weights, most=3):
    """Sources above their bound are held there and the rest is shared out again, until none is above."""
    held, whole = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        rest, w = whole - sum(held.values()), sum(weights[s] for s in free)
        got = {s: Fraction(rest) * weights[s] / w for s in free}
        above = [s for s in free if got[s] > most * sizes[s]]
        if not above:
            return held | got
        held |= {s: Fraction(most * sizes[s]) for s in above}


def mixed_rows():
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(1, 60), r.choice(["b", "b", "b", "a", "é", "Z", "", None])) for i in range(900)]
    return rows + [(None, "x y", "b"), (5_000, None, "b"), (5_001, "", "only-empty"), (5_002, "one", "solo"), (5_003, "w " * 9_000, None)] + rows[:3]


@pytest.mark.parametrize("source_rows", [10_000, 50])
def test_mixing_meets_targets(spark, source_rows):
    rows = mixed_rows()
    df = spark.createDataFrame([(i, t, s, "s", 0.5) for i, t, s in rows], "doc_id long, text string, source string, size string, target double").repartition(6)
    got = mix_sources(df, source_rows=source_rows).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in got) == collections.Counter(rows)
    sizes = collections.Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - float(want[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["taken"] for c in r["copies"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    first = [r["position"] for r in got if r["position"] is not None]
    assert first == sorted(first) and all(r["position"] is None for r in got[len(first) :])
    again = mix_sources(df.repartition(3), source_rows=source_rows).collect()
    key = lambda rows: collections.Counter((r["doc_id"], r["source"], str(r["copies"])) for r in rows)
    assert key(again) == key(got)
    assert mix_sources(df.limit(0)).count() == 0


def test_positions_follow_the_schedules(spark):
    """By any time, each source has had the words that its schedule had due by then."""
    rows = [(i, "a b c d e", f"s{i % 3}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seq = training_sequence(mix_sources(df)).collect()
    at = [r["position"] for r in seq]
    assert at == sorted(at)
    totals = collections.Counter()
    for r in seq:
        totals[r["source"]] += r["taken"]
    for t in (0.1, 0.35, 0.5, 0.8):
        had = collections.Counter()
        for r in seq:
            if r["position"] < t:
                had[r["source"]] += r["taken"]
        for k, schedule in enumerate(SCHEDULES):
            due, knots = 0.0, integrated(schedule)
            for (a, w, _, slope), (b, *_) in zip(knots, knots[1:]):
                d = max(0.0, min(b, t) - a)
                due += w * d + slope * d * d / 2
            assert abs(had[f"s{k}"] - due / knots[-1][2] * totals[f"s{k}"]) <= 6
    assert {r["text"] for r in seq if r["taken"] == 5} == {"a b c d e"}
    assert all(len(brute.words(r["text"])) == r["taken"] for r in seq)


def test_bad_schedules_are_refused():
    for bad in [((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 3.0)), ((0.0, 0.0), (1.0, 0.0))]:
        with pytest.raises(ValueError):
            integrated(bad)
    assert [integrated(s)[-1][2] for s in SCHEDULES] == [5.0, 2.0, 1.0]


def test_entropy_of_long_strings_and_allowed_parts(spark):
    from harborline.llm.secret_scan import ALPHABET, scan_secrets, spans_text

    r = random.Random(2)
    key = "9fQ2xL7vB4kT8mZ1pW6cR3yH"
    dull = "gh1" * 4_000
    texts = {
        1: "".join(r.choice(ALPHABET) for _ in range(30_000)),
        2: f"{dull}{key}{dull}",
        3: f"sample-app/{key}",
        4: f"example{key}",
        5: f"{key}_example",
        6: "550e8400-e29b-41d4-a716-446655440000",
        7: f"x/{key}/sample/{key[::-1]}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["t"] for x in scan_secrets(df).select("doc_id", spans_text(F.col("spans")).alias("t")).collect()}

    def plain(t):
        """Windows of 20 by their entropy counted afresh, silenced where they touch a part with an allowed word."""
        mute, at = set(), 0
        for part in re.split("([/=_+-])", t):
            if re.search("example|sample", part):
                mute.update(range(at, at + len(part) + 1))
            at += len(part)
        hits = []
        for i in range(len(t) - 19):
            c = np.array(list(collections.Counter(t[i : i + 20]).values())) / 20
            if -(c * np.log2(c)).sum() >= 3.75 - 1e-9 and not mute & set(range(i, i + 20)):
                hits.append(i)
        return f"entropy_base64:{hits[0]}:{hits[-1] + 20}" if hits else ""

    assert got == {i: "" if i == 6 else plain(t) for i, t in texts.items()}
    assert got[1] and got[2] and got[3] and not got[4]


def test_fingerprint_query_matches_a_plain_version(spark, tmp_path):
    """The whole query: edited texts by descending id, their digests, and both likenesses."""
    from harborline.llm.queries import QUERIES

    texts = ["one two three four five six seven " * 9, "", "éa b c d e f g h " * 12, "one two three four five six seven " * 9, "x"]
    rows = [(10 * i + 3, t, "en") for i, t in enumerate(texts * 4)] + [(5, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_fingerprints"](spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    prints = {t or "": got[i]["fingerprint"] for i, t, _ in rows}
    assert len(got) == len(rows)
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == brute.sha(edited)
        assert got[i]["fingerprint"] == prints[t] and 0 <= got[i]["near_edited"] <= 1
        if edited in prints:
            assert got[i]["edited_fingerprint"] == prints[edited]
        if t == nxt:
            assert got[i]["near_next"] == 1.0
        equal_bytes = sum(got[i]["fingerprint"][k : k + 2] == got[j]["fingerprint"][k : k + 2] for k in range(0, 256, 2)) / 128 if t and nxt else float(t == nxt)
        chance = 1 / 256 if t and nxt else 0.0
        assert abs(got[i]["near_next"] - max(0.0, (equal_bytes - chance) / (1 - chance))) < 1e-9


@pytest.mark.parametrize("kind", ["normal", "one very long", "lengths of all sizes", "clusters"])
def test_neighbours_at_the_defaults(spark, kind):
    """Recall of at least 0.9 with the parameters of the query, whatever the lengths."""
    from harborline.llm.neighbours import nearest

    r = np.random.default_rng(9)
    x = r.normal(size=(4_000, 32))
    if kind == "one very long":
        x[77] *= 1_000
    if kind == "lengths of all sizes":
        x *= np.exp(r.normal(size=(4_000, 1)))
    if kind == "clusters":
        x = r.normal(size=(40, 32))[r.integers(0, 40, 4_000)] + 0.2 * x
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for q in nearest(df, every=100).collect():
        found[q["query_id"]].add(q["vec_id"])
    hits = 0
    for q in range(0, 4_000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 40
