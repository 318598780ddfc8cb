"""Personal data, importance resampling and hard negatives against brute force, with the edge cases of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import importance, negatives, pii

SCHEMA = "doc_id long, text string"


def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    # Extra columns with names that the operators use inside.
    return df.withColumns({c: F.lit("x") for c in ("id", "found", "rank", "weight", "score", "n", "a", "r", "range", "n_words")})


# -- personal data -----------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    total = 0
    for i, d in enumerate(reversed(re.sub(r"\D", "", text, flags=re.A))):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    digits = lambda s: len(re.sub("[^0-9]", "", s))
    tests = (
        (EMAIL, lambda s: True),
        (IP, lambda s: all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in s.split("."))),
        (CARD, lambda s: 12 <= digits(s) <= 19 and luhn(s)),
        (PHONE, lambda s: 9 <= digits(s) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(tests) for m in p.finditer(text) if ok(m[0]))


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(8)
    pieces = ["@", ".", "..", "a", "b.c", "-", "+", "4", "12", "255", "256", "007", " ", "  ", "(", ")", "+49 ", "é", "😀", "\n", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "://", "user", "%", "_", ":", "iban", "İ"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["9" * 5000 + ".1.2.3", "1." * 3000 + "4", "a" * 3000 + "@" * 3000 + "b.c", "1.2.3.4.5.6.7.8.9", "a@b@c.d", "a@b.c@d.e", "x@y.z.", "+1" + "-" * 2000 + "2", "+1 2 3 4 5 6 7 8 9 - ", "4111111111111111", "4111111111111112", "0000000000000000.0.0.0"]
    anchors = pii.automaton()
    for t in texts:
        got = pii.spans(t, anchors)
        assert got[0] == base(t), t
        assert set(got[0]) <= set(got[1])
        assert not [x for x in got[1] if x[1] >= 4 for y in got[0] if x[0] < y[2] and y[0] < x[2]], t


def test_more_kinds_are_found():
    anchors = pii.automaton()
    kinds = lambda t: {(pii.KINDS[k], t[s:e]) for s, k, e in pii.spans(t, anchors)[1]}
    assert ("url", "https://bob:secret@host/x") in kinds("see https://bob:secret@host/x.")
    assert ("url", "http://host.org/~maria/") in kinds("(http://host.org/~maria/)")
    assert ("url", "http://site/users/karl_99") in kinds("HTTP http://site/users/karl_99, then")
    assert kinds("see https://docs.org/page?x=1 and std::vector::at 12:30:45") == set()
    assert ("ip6", "2001:db8::8a2e:370:7334") in kinds("from 2001:db8::8a2e:370:7334 on")
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("IBAN: DE89 3704 0044 0532 0130 00 now")
    assert not [x for x in kinds("IBAN: DE88 3704 0044 0532 0130 00 now") if x[0] == "iban"]
    assert ("account", "AB-12345") in kinds("Customer no. AB-12345 called")
    assert ("handle", "@maria_k") in kinds("thanks @maria_k for it") and kinds("a@maria_k") == set()
    assert kinds("the user 12 and 3 members of account, in 2024") == set()


def test_scan_and_redact_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "x 4111 1111 1111 1111 y"), (3, "x 4111 1111 1111 1111 y"), (4, "word " * 200_000 + "ip 10.0.0.1")]
    got = sorted(((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.scan(docs(spark, rows)).collect()))
    assert got == [(0, 1, 0, 0, 0, "email:0:6"), (1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 0, 0, 1, 0, "card:2:21"), (3, 0, 0, 1, 0, "card:2:21"), (4, 0, 1, 0, 0, "ip:1000003:1000011")]
    want = hashlib.sha256(b"email:0:6").hexdigest()
    assert pii.scan(docs(spark, rows)).where("doc_id IS NULL").first().base_sha256 == want
    red = {r.doc_id: (r.text, r.n_spans) for r in pii.redacted(docs(spark, rows[:4])).collect()}
    assert red == {1: (None, 0), 2: ("", 0), None: ("<email>", 1), 3: ("x <card> y", 1)}
    assert pii.scan(docs(spark, [])).count() == 0 and pii.redacted(docs(spark, [])).count() == 0


# -- importance resampling ---------------------------------------------------------------------------------------------------------


def drawn(rows, target, percent=10, least=20, runs=1, buckets=10_000):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, feats(text)[1]))
    for text in target:
        t.update(map(bucket, feats(text)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    scored = []
    for doc, text in rows:
        w, f = feats(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)))
    order = sorted((i for i, x in enumerate(scored) if x[4] >= least), key=lambda i: (-scored[i][3], scored[i][0] is None, scored[i][0] or 0, scored[i][1]))
    rank = {i: n for n, i in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted((str(x[0]), *x[1:4], rank.get(i) or 0) for i, x in enumerate(scored))


def taken(df):
    return sorted((str(r.doc_id), r.n_features, r.weight, r["score"], r["rank"] or 0) for r in df.collect())


@pytest.mark.parametrize("percent,runs,each,block", [(10, 1, 1 << 20, 4096), (40, 2, 30, 4), (100, 1, 7, 3), (0, 1, 50, 4)])
def test_draw_equals_brute_force(spark, percent, runs, each, block):
    r = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(80)] + ["Größe", "naïve", "X9"]
    text = lambda: " ".join(r.choice(vocabulary) + r.choice(["", ",", "-", "'s"]) for _ in range(r.choice([0, 5, 19, 20, 60])))
    rows = [(r.randint(-5, 150) if i % 9 else None, text()) for i in range(300)] + [(999, None), (1000, "")]
    rows += [(7, "same words " * 15)] * 90  # ties of one score, repeated rows
    target = [text() for _ in range(40)] + [None]
    df = importance.resample(docs(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, runs=runs, each=each, block=block)
    assert taken(df) == drawn(rows, [t or "" for t in target], percent, runs=runs)


def test_one_score_is_cut_by_ids(spark):
    rows = [(i, i, 1, 5) for i in range(500)] + [(i, i, 1, 6) for i in range(20)]
    df = spark.createDataFrame(rows, importance.SCORED)
    cuts = importance.boundaries(df, [(6, 20), (5, 500)], 50)
    assert len(cuts) >= 9 and cuts == sorted(cuts)
    runs = importance.sorted_runs(df.repartition(4), cuts, block=8, run_rows=60)
    sizes = Counter(r["range"] for r in runs.collect() for _ in r.doc_id)
    assert max(sizes.values()) <= 80 and sum(sizes.values()) == 520
    base = {n: sum(v for k, v in sizes.items() if k < n) for n in sizes}
    got = {(r["score"], r.doc_id): r["rank"] for r in importance.merged(runs, base, 300).collect()}
    order = sorted(got, key=lambda k: (-k[0], k[1]))
    assert [got[k] for k in order] == [*range(1, 301), *[None] * 220]


def test_tournament_merges_any_runs():
    r = random.Random(3)
    for _ in range(60):
        runs = [sorted((r.randint(0, 30), False, r.randint(0, 9), 0, 0) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 20))]
        tree, out = importance.Tournament(), []
        for keys in sorted(runs, key=lambda k: k[0]):
            out += [k for p, a, b in tree.take(keys[0]) for k in p[a:b]]
            tree.enter(keys, keys)
        out += [k for p, a, b in tree.take(None) for k in p[a:b]]
        assert out == sorted(k for run in runs for k in run)


def test_draw_of_empty_tables(spark):
    some, none = docs(spark, [(1, "a b " * 20)]), docs(spark, [])
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, target).count() == 0
    assert importance.resample(some, target, percent=100).first()["rank"] == 1
    assert importance.resample(none, some).columns == ["doc_id", "n_features", "weight", "score", "rank"]


# -- hard negatives ----------------------------------------------------------------------------------------------------------------


def mined(rows, every=100, k=5, low=80, high=100):
    kept = {(i, (x + 1) % 10 if i % 7 == 0 else x, tuple(math.floor(256 * c) for c in v)) for i, v, x in rows if None not in (i, v, x) and all(c is not None and math.isfinite(c) for c in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, l, v in kept:
        if a % every == 0:
            scored = sorted((-dot(v, w), i, x) for i, x, w in kept if i != a)
            for s, p, x in [t for t in scored if t[2] == l][:k]:
                found = [t for t in scored if t[2] != l and low * -s <= 100 * -t[0] <= high * -s][:k]
                out += [(a, p, n, t[1], -s, -t[0]) for n, t in enumerate(found, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    r = random.Random(5)
    near = [[r.uniform(-1, 1) for _ in range(40)] for _ in range(4)]
    vec = lambda: [x + r.uniform(-0.2, 0.2) for x in r.choice(near)]
    rows = [(i, vec(), r.randint(0, 9)) for i in range(-30, 500)]
    rows += [(600 + i, near[0], i % 3) for i in range(40)]  # ties
    rows += [(700, None, 1), (701, vec(), None), (None, vec(), 2), (702, [1.0, None], 1), (703, [float("nan")] * 40, 1), (704, [float("inf")] * 40, 1), (800, [], 3), (900, [0.5] * 7, 4), (901, [0.5] * 50, 4)]
    rows += [rows[0]] * 3 + [(35, vec(), 1), (35, vec(), 1)]  # repeated rows; an id with several
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "v", "a", "block", "rank")})
    single = [tuple(x) for x in spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").collect()]
    for options in ({}, {"anchors": 3, "rows": 50, "chunk": 8}, {"anchors": 1, "rows": 7, "chunk": 64, "every": 50}):
        got = negatives.mine(df, **options)
        own = {k: v for k, v in options.items() if k == "every"}
        assert sorted(tuple(x) for x in got.collect()) == mined(single, **own)
    assert got.dtypes[2] == ("rank", "int")


def test_negatives_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(5, [1.0], 1), (6, [1.0], 2)], schema)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, [1e30] * 4, 1), (1, [1.0], 1)], schema))


def test_tiles_pack_any_width():
    import numpy as np

    r = np.random.default_rng(2)
    for most in (1, 127, 128, 40_000, 1 << 40, (1 << 62) - 1):
        tile = r.integers(-most, most, (7, 5), endpoint=True)
        assert (negatives.unpacked(negatives.packed(tile), 7) == tile).all()
    a, b = r.integers(-(1 << 27), 1 << 27, (3, 40)), r.integers(-(1 << 27), 1 << 27, (5, 40))
    assert (negatives.product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a])).all()
