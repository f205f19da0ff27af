import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.operators import spikes

SCHEMA = "row_id long, tracking_path string, video_key string, tracker_id string, frame_original long, track_id long, box_left double, box_top double, box_width double, box_height double, loaded_at timestamp, block string, own int"


def make(seed=0, tracks=60, n=60):
    """Tracks of two trackers with planted spikes, stuck runs, impossible and lasting changes."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    rid = 0
    for t in range(tracks):
        tracker = "a" if t % 2 else "b"
        hold = 1 if t % 2 else 3
        x = 300 + np.cumsum(rng.normal(0, 1, n) + 1.5)
        y = 300 + np.cumsum(rng.normal(0, 1, n))
        x, y = np.repeat(x[: n // hold + 1], hold)[:n].round(2), np.repeat(y[: n // hold + 1], hold)[:n].round(2)
        w, h = np.full(n, 50.0) + rng.normal(0, 0.3, n).round(2), np.full(n, 80.0) + rng.normal(0, 0.3, n).round(2)
        kinds = [None] * n
        what = t % 5
        if what == 1:
            at, size = int(rng.integers(10, 40)), int(rng.integers(1, 4))
            x[at : at + size] += 120
            kinds[at : at + size] = ["spike"] * size
        elif what == 2:
            at = 20
            x[at : at + 16], y[at : at + 16] = x[at], y[at]
            # hidden repeats before the stretch belong to it, so the first row of all is found
            first = at
            while first > 0 and x[first - 1] == x[at] and y[first - 1] == y[at]:
                first -= 1
            last = at + 15
            while last + 1 < n and x[last + 1] == x[at] and y[last + 1] == y[at]:
                last += 1
            kinds[first + 1 : last + 1] = ["stuck"] * (last - first)
        elif what == 3:
            x[30:] += 150  # stays: no case
        elif what == 4:
            w[7], x[9] = 0.0, float("inf")
            kinds[7] = kinds[9] = "impossible"
        for i in range(n):
            null = what == 0 and i == 5
            rows.append((rid, f"v/mot/{t}.txt", "v", tracker, 1000 + 5 * i, 1, None if null else float(x[i]), float(y[i]), float(w[i]), float(h[i]), None, "clash", 7))
            if kinds[i]:
                truth[rid] = kinds[i]
            rid += 1
    return rows, truth


@pytest.fixture(scope="module")
def planted():
    return make()


def test_planted(spark, planted):
    rows, truth = planted
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)  # some rows are delivered again
    got = {r["row_id"]: r["kind"] for r in spikes.flag_tracking_rows(df).collect()}
    assert got == truth


def test_many_sources_take_the_join(spark, planted, monkeypatch):
    rows, truth = planted
    monkeypatch.setattr(spikes, "SHIPPED_SOURCES", 1)
    got = {r["row_id"]: r["kind"] for r in spikes.flag_tracking_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == truth


def test_blocks_do_not_change_the_result(spark, planted, monkeypatch):
    rows, truth = planted
    monkeypatch.setattr(spikes, "BLOCK_FRAMES", 100)
    monkeypatch.setattr(spikes, "MARGIN_FRAMES", 99)  # less than a block, as in production
    got = spikes.flag_tracking_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["row_id"]: r["kind"] for r in got} == truth and len(got) == len(truth)


def series(rng, n):
    return np.cumsum(rng.normal(0, 1, n) + 0.5) + 300


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 8, 10, 12])
def test_patches_of_any_length(size):
    rng = np.random.default_rng(size)
    n, tracks = 60, 200
    x, g, truth = [], np.repeat(np.arange(tracks), n), np.zeros(n * tracks, bool)
    for t in range(tracks):
        v, at = series(rng, n), int(rng.integers(3, n - size - 3))
        v[at : at + size] += rng.choice([-1, 1]) * rng.uniform(30, 200) * rng.normal(1, 0.02, size)
        x.append(v)
        truth[t * n + at : t * n + at + size] = True
    got = spikes.additive_outliers(np.concatenate(x), g, np.full(len(g), 0.5), np.full(len(g), 2.5))
    assert (got & truth).sum() >= 0.97 * truth.sum() and (got & ~truth).sum() <= 0.01 * truth.sum()


@pytest.mark.parametrize("gap", [1, 2, 4, 7])
def test_level_shifts_stand_and_spikes_beside_them_are_found(gap):
    rng = np.random.default_rng(gap)
    n, tracks = 60, 200
    x, g, truth = [], np.repeat(np.arange(tracks), n), np.zeros(n * tracks, bool)
    for t in range(tracks):
        v, at = series(rng, n), int(rng.integers(15, 40))
        way = rng.choice([-1, 1])
        v[at:] += way * rng.uniform(40, 150)
        size = int(rng.integers(1, 4))
        a = at + gap if t % 2 else at - gap - size
        v[a : a + size] += rng.choice([-1, 1]) * rng.uniform(200, 400)
        truth[t * n + a : t * n + a + size] = True
        if t % 5 == 0:
            v[n - 4 :] += way * 90  # the track ends before it could come back
        x.append(v)
    got = spikes.additive_outliers(np.concatenate(x), g, np.full(len(g), 0.5), np.full(len(g), 2.5))
    assert (got & truth).sum() >= 0.95 * truth.sum() and (got & ~truth).sum() <= 0.03 * truth.sum()


def test_many_patches_and_degenerate_scales():
    rng = np.random.default_rng(4)
    v = series(rng, 3000)
    truth = np.zeros(3000, bool)
    for at in range(20, 2980, 20):
        size = int(rng.integers(1, 7))
        v[at : at + size] += 100 + 10 * np.arange(size)
        truth[at : at + size] = True
    one = np.zeros(3000, int)
    got = spikes.additive_outliers(v, one, np.full(3000, 0.0), np.full(3000, 2.5))
    assert (got == truth).mean() > 0.99
    assert not spikes.additive_outliers(v, one, np.zeros(3000), np.full(3000, np.inf)).any()
    spikes.additive_outliers(v, one, np.zeros(3000), np.zeros(3000))  # ends
    assert not spikes.additive_outliers(np.arange(50) * 10.0, one[:50], np.zeros(50), np.full(50, 2.0)).any()


def test_long_holds(spark):
    # a source that holds a value over 400 rows: its stretches of 400 are usual, one of 4,000 is stuck
    rows, rid, truth = [], 0, set()
    for t in range(12):
        frame = 0
        for h in range(12):
            size = 4_000 if t == 3 and h == 5 else 400
            for k in range(size):
                rows.append((rid, f"t{t}", "v", "slow", frame, 1, 100.0 + h, 50.0 + h % 2, 20.0, 20.0, None, "", 0))
                if size == 4_000 and k:
                    truth.add(rid)
                rid, frame = rid + 1, frame + 1
    got = spikes.flag_tracking_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["row_id"] for r in got if r["kind"] == "stuck"} == truth
    b = spikes.hold_bin(np.array([0, 127, 128, 129, 400, 10**6]))
    assert [spikes._hold(int(x)) for x in b[:3]] == [0, 127, 128] and all(spikes._hold(int(x)) >= y for x, y in zip(b, [0, 127, 128, 129, 400, 10**6]))


def test_rows_without_a_track_stand_alone(spark):
    rows = [(i, None if i % 2 else "p", "v", "a", None if i % 2 == 0 else i, 1, 500.0 if i == 9 else 5.0, 5.0, 0.0 if i == 20 else 5.0, 5.0, None, "", 0) for i in range(60)]
    laid = spikes._by_track(spark.createDataFrame(rows, SCHEMA))
    assert laid.count() == 60 and laid.select("tracking_path", "block").distinct().count() > 50
    got = spikes.flag_tracking_rows(spark.createDataFrame(rows + rows[:30], SCHEMA)).collect()
    assert [(r["row_id"], r["kind"]) for r in got] == [(20, "impossible")]


def test_empty_and_null(spark):
    assert spikes.flag_tracking_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, None, None, None, None, None, None, None, None, None, None, None, None), (2, "p", "v", None, 5, 1, 1.0, 1.0, 2000.0, 1.0, None, None, None)]
    got = spikes.flag_tracking_rows(spark.createDataFrame(odd, SCHEMA)).collect()
    assert [(r["row_id"], r["kind"]) for r in got] == [(2, "impossible")]


def test_annotation_boxes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        x, y = 100 + rng.normal(0, 2), 50 + rng.normal(0, 2)
        rows.append((i, "S/E/1", "Scoreboard_Single", f'["{x:.1f}", {y:.1f}, {x + 200:.1f}, {y + 60:.1f}]'))
    bad = ["[1, null, 5, 9]", "[0, 0, 0, 0]", "nonsense", "[1, 2, 3]", "[-50, -50, 0, -1]", "[NaN, 1, 2, 3]", "[1, 1, 1500, 9]"]
    rows += [(100 + i, "S/E/1", "Scoreboard_Single", b) for i, b in enumerate(bad)]
    rows += [(200, "S/E/2", "Scoreboard_Single", "[700, 50, 900, 110]"), (201, "S/E/1", "Objects_Spatial_Relationships", '[{"label": "A", "box": [1, 2, 3, 4]}, {"label": "B", "box": [5, 5, 5, 9]}]'), (202, "S/E/1", "Objects_Spatial_Relationships", '[{"label": "A", "box": ["1", 2, 3, 4]}, {"label": "B", "box": [5, 5, 7, 9]}]'), (203, "S/E/1", "AI_Coach", None), (204, None, None, "")]
    df = spark.createDataFrame(rows, "row_id long, video_key string, task_l2 string, bounding_box string").withColumn("loaded_at", F.lit(None).cast("timestamp"))
    got = {r["row_id"]: r["kind"] for r in spikes.flag_annotation_boxes(df.union(df.limit(5))).collect()}
    assert got == {**{100 + i: "impossible" for i in range(len(bad))}, 200: "spike", 201: "impossible"}
    assert spikes.flag_annotation_boxes(df.limit(0)).count() == 0
