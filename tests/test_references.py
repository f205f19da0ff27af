import datetime as dt
import random

from frameledger.operators import references as ref

DAY = dt.datetime(2025, 1, 1)
ANN = "row_id long, video_key string, annotation_id string, upstream_annotation_id string, tracking_bboxes string, loaded_at timestamp, deleted_at timestamp, kind string, side int"
FILES = "file_id long, tracking_path string, video_key string, annotation_id string, loaded_at timestamp, deleted_at timestamp, h1 long"
PREP = "record_id long, video_key string, annotation_id string, written_at timestamp, copy int"


def at(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute(annotations, files, prepared):
    def t(s):
        return (s or "").strip()

    def p(s):
        s = t(s)
        for x in ("./data/", "data/", "./dataset/", "dataset/"):
            if s.startswith(x):
                return s[len(x) :]
        return s

    parents = {}
    for r in annotations:
        if t(r[2]):
            k = ("a", t(r[1]), t(r[2]))
            o = parents.setdefault(k, [r[5], False])
            o[0], o[1] = min(o[0], r[5]), o[1] or r[6] is not None
    for r in files:
        if p(r[1]):
            o = parents.setdefault(("p", p(r[1])), [r[4], False])
            o[0], o[1] = min(o[0], r[4]), o[1] or r[5] is not None
    refs = {}

    def first(table, field, key, loaded, k, strict):
        old = refs.get((table, field, key))
        if old is None or loaded < old[0]:
            refs[table, field, key] = (loaded, k, strict)

    for r in annotations:
        first("annotations", "upstream_annotation_id", r[0], r[5], ("a", t(r[1]), t(r[3])) if t(r[3]) else None, True)
        first("annotations", "tracking_bboxes", r[0], r[5], ("p", p(r[4])) if p(r[4]) else None, True)
    for r in files:
        first("tracking_files", "annotation_id", r[0], r[4], ("a", t(r[2]), t(r[3])) if t(r[3]) else None, False)
    for r in prepared:
        first("prepared_samples", "annotation_id", r[0], r[3], ("a", t(r[1]), t(r[2])) if t(r[2]) else None, True)
    out = set()
    for (table, field, key), (loaded, k, strict) in refs.items():
        if k is None:
            continue
        o = parents.get(k)
        kind = "missing" if o is None else "deleted" if o[1] else "late" if strict and o[0] > loaded else None
        if kind:
            out.add((table, field, key, kind, loaded.strftime("%Y-%m")))
    return out


def tables(seed, n=400):
    r = random.Random(seed)
    ids = [str(i) for i in range(30)] + [None, "", "  "]
    dirty = lambda s: s if s is None else r.choice([s, f" {s}", f"{s}\t", s])
    a, f, p = [], [], []
    for i in range(n):
        hot = r.random() < 0.4
        a.append((i, r.choice(["v1", "v2", " v1"]), dirty(r.choice(ids)), dirty("7" if hot else r.choice(ids)), r.choice([None, "", "./data/x.txt", "data/y.txt", " dataset/z.txt", "x.txt", "q.txt"]), at(r.randrange(60)), at(3) if r.random() < 0.1 else None, "clash", 1))
    a += [(x[0], *x[1:5], x[5] + dt.timedelta(days=40), at(9) if r.random() < 0.2 else x[6], "c", 2) for x in a[:40]]
    for i in range(60):
        f.append((i, r.choice(["x.txt", "y.txt ", "z.txt"]), "v1", dirty(r.choice(ids)), at(r.randrange(60)), at(1) if r.random() < 0.05 else None, 5))
    for i in range(200):
        p.append((i, "v2", dirty(r.choice(ids)), at(r.randrange(60)), 3))
    return a, f, p


def run(spark, a, f, p, tasks=3):
    out = ref.broken_references(spark.createDataFrame(a, ANN), spark.createDataFrame(f, FILES), spark.createDataFrame(p, PREP), tasks)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    for seed in (1, 2):
        a, f, p = tables(seed)
        assert run(spark, a, f, p) == brute(a, f, p)


def test_hot_keys_are_spread_without_loss(spark, monkeypatch):
    a, f, p = tables(3, 1500)
    monkeypatch.setattr(ref, "HOT_SHARE", 1)
    big = [(10_000 + i, "v1", None, "7", None, at(5), None, "", 0) for i in range(6000)]
    assert run(spark, a + big, f, p, 4) == brute(a + big, f, p)


def test_empty(spark):
    assert run(spark, [], [], []) == set()
    assert run(spark, [], [], [(1, "v", "9", at(1), 0)]) == {("prepared_samples", "annotation_id", 1, "missing", "2025-01")}
