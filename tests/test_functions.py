import random
from bisect import bisect_left

from pyspark.sql import functions as F

from frameledger.functions import geometry, sampling, text


def uniform(s, e, b):
    if b <= 1 or s == e:
        return [s]
    out = []
    for i in range(b):
        c = min(max(round(s + (i / (b - 1)) * (e - s)), s), e)
        if not out or out[-1] != c:
            out.append(c)
    return out


def test_uniform_sampling(spark):
    r = random.Random(0)
    cases = [(s := r.randrange(500), s + r.randrange(400)) for _ in range(300)]
    df = spark.createDataFrame(cases, "s long, e long")
    for b in (1, 3, 5, 8, 9, 64):
        got = [x["f"] for x in df.select(sampling.uniform(F.col("s"), F.col("e"), b).alias("f")).collect()]
        assert got == [uniform(s, e, b) for s, e in cases]


def test_protocols(spark):
    # known results: (100, 150) densely backwards, (0, 999) evenly, eight frames
    df = spark.createDataFrame([("Score_Prediction", 100, 150), ("Score_Prediction", 0, 999), ("Score_Prediction", 100, 500)], "task string, s long, e long").withColumn("total", F.when(F.col("e") == 500, 500).otherwise(1000).cast("long"))
    none = F.lit(None).cast("long")

    def frames(p):
        return [r["f"] for r in df.select(sampling.PROTOCOLS[p].frames(F.col("task"), none, (F.col("s"), F.col("e")), (none, none), F.col("total")).alias("f")).collect()]

    a, b, c = frames("main")
    assert len(a) == 31 and a[0] == 0 and a[-1] == 150
    assert len(b) == 64 and b[0] == 0 and b[-1] == 999
    assert len(c) == 64 and c[-1] == 499
    assert frames("uniform8")[0] == [100, 107, 114, 121, 129, 136, 143, 150]
    g = df.limit(1).select(sampling.PROTOCOLS["main"].frames(F.lit("Spatial_Temporal_Grounding"), none, (none, none), (F.lit(200).cast("long"), F.lit(220).cast("long")), F.lit(1000).cast("long")).alias("f")).first()["f"]
    assert g[0] == 150 and g[-1] == 270 and len(g) == 64
    assert sampling.resolve("main").protocol_id == "main"
    assert sampling.resolve("frameledger.functions.sampling:Uniform8").protocol_id == "uniform8"


def test_projection(spark):
    r = random.Random(1)
    cases = []
    for _ in range(400):
        f = sorted(r.sample(range(100), r.randrange(1, 12)))
        s = r.randrange(110)
        cases.append((s, s + r.randrange(15), f))
    df = spark.createDataFrame(cases, "s long, e long, f array<long>")
    got = [tuple(x["p"]) for x in df.select(sampling.project(F.col("s"), F.col("e"), F.col("f")).alias("p")).collect()]

    def want(s, e, f):
        inside = [i for i, x in enumerate(f) if s <= x <= e]
        if inside:
            return inside[0], inside[-1]
        return tuple(sorted(min(bisect_left(f, x), len(f) - 1) for x in (s, e)))

    assert got == [want(*c) for c in cases]
    assert want(106, 119, [100, 105, 110, 115, 120]) == (2, 3)


def test_boxes(spark):
    one = spark.range(1)
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    v = one.select(geometry.box_iou(arr(0, 0, 10, 10), arr(5, 0, 15, 10)).alias("a"), geometry.box_iou(arr(-1, -1, -1, -1), arr(0, 0, 5, 5)).alias("b"), geometry.box_iou(arr(9, 0, 0, 9), arr(0, 0, 5, 5)).alias("c"), geometry.box_iou(F.lit(None).cast("array<double>"), arr(0, 0, 5, 5)).alias("d"), geometry.box_iou(arr(1, 2), arr(0, 0, 5, 5)).alias("e")).first()
    assert (round(v["a"], 9), v["b"], v["c"], v["d"], v["e"]) == (round(1 / 3, 9), 0.0, 0.0, 0.0, 0.0)
    n = lambda x: F.lit(x).cast("long")
    t = one.select(geometry.temporal_iou(n(4), n(8), n(2), n(4)).alias("a"), geometry.temporal_iou(n(8), n(4), n(2), n(4)).alias("b")).first()
    assert (round(t["a"], 9), t["b"]) == (round(1 / 7, 9), 0.0)
    p = one.select(geometry.parse_interval(F.lit("121-150")).alias("a"), geometry.parse_interval(F.lit("9-3")).alias("b"), geometry.parse_interval(F.lit("-3-4")).alias("c"), geometry.parse_interval(F.lit("x")).alias("d")).first()
    assert tuple(p["a"]) == (121, 150) and tuple(p["b"]) == (3, 9) and p["c"] is None and p["d"] is None
    z = one.select(geometry.normalize_box(arr(1, 2, 3, 4), F.lit(0), F.lit(10)).alias("z"), geometry.denormalize_to_pixels(arr(0, 0, 1000, 2000), F.lit(100), F.lit(50)).alias("d")).first()
    assert z["z"] is None and z["d"] == [0, 0, 99, 49]


def test_json_and_templates(spark):
    texts = ['{"a": 1}', 'note ```json\n{"a": [1]}\n``` end', 'x {"a": {"b": 2}} y', "```json\n{bad}\n```", "none", "", None, '{"a": NaN, "a": 2}', "3", '{"a": Infinity}']
    got = [tuple(r["j"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.extract_json("t").alias("j")).collect()]
    assert [g[0] for g in got] == ['{"a": 1}', '{"a": [1]}', '{"a": {"b": 2}}', None, None, None, None, '{"a": 2}', "3", '{"a": "Infinity"}']
    assert [g[1] is None for g in got] == [True, True, True, False, False, False, True, True, True, True]
    row = spark.range(1).select(text.render(" Hi {{ a }} and {{b}} ", {"a": F.lit("{{ b }}"), "b": F.lit(2)}).alias("x")).first()
    assert row["x"] == "Hi {{ b }} and 2"
    assert [r["x"] for r in spark.createDataFrame([(2.0,), (1.2345,), (None,)], "r double").select(text.rate_text("r").alias("x")).collect()] == ["2", f"{1.2345:.3f}".rstrip("0"), ""]
    for bad in ("", "{{ other }}"):
        try:
            text.check_template(bad, {"a"})
            raise AssertionError
        except ValueError:
            pass
