"""Forest, neighbours, labels and metrics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewatch.catalog.scoring import fixed_forest
from tapewatch.operators import forest as fo
from tapewatch.operators import lof, metrics, patterns
from tapewatch.session import workspace
from tapewatch.sources.validate import refuse_identity


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(0, 1, (300, 2)), rng.uniform(6, 9, (15, 2))])
    rows = [(i, float(a), float(b), int(i >= 300)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id BIGINT, x1 DOUBLE, x2 DOUBLE, y INT").cache()


def test_forest_finds_the_outliers(cloud):
    scored, forest = fo.fit_score_flag(cloud, ["x1", "x2"], "id", 0.05, trees=50)
    assert forest.sample_size == 256 and forest.nodes["depth"].max() <= 8
    assert metrics.auc(scored.select(F.col("if_score").alias("score"), F.col("y").alias("label"))).first().auc > 0.99
    lo, hi = scored.agg(F.min("if_score"), F.max("if_score")).first()
    assert 2 ** (-8 / fo.path_constant(256)) - 1e-9 <= lo and hi <= 1


def test_forest_does_not_depend_on_partitions(cloud):
    a = fo.fit_forest(cloud.repartition(1), ["x1", "x2"], "id", trees=5)
    b = fo.fit_forest(cloud.repartition(8), ["x1", "x2"], "id", trees=5)
    key = ["tree_id", "node_id"]
    assert a.nodes.sort_values(key).reset_index(drop=True).equals(b.nodes.sort_values(key).reset_index(drop=True))


def test_forest_scores_null_rows_as_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, None), (2.0, 1.0, 100.0, 70.0)], "`return` DOUBLE, volume_ratio_20d DOUBLE, volatility_20d DOUBLE, rsi_14d DOUBLE")
    got = [r.if_score for r in fo.score(df, fixed_forest()).collect()]
    assert got[0] is None and 0 < got[1] < 1


def test_identity_columns_are_refused(cloud):
    with pytest.raises(ValueError):
        refuse_identity(["return", "Symbol"])
    with pytest.raises(ValueError):
        fo.fit_forest(cloud.withColumn("ticker", F.lit(1.0)), ["x1", "ticker"], "id")


@pytest.mark.parametrize("block,ball_rows", [(40, 30), (2000, 1024)])
def test_neighbours_equal_brute_force(spark, block, ball_rows):
    rng = np.random.default_rng(8)
    # a third of the rows sits in one dense spot, some are exact copies
    x = np.vstack([rng.normal(0, 0.01, (70, 3)), np.zeros((10, 3)), rng.normal(0, 5, (140, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>")
    got = lof.knn(df, "id", "v", 6, ball_rows=ball_rows, block=block).orderBy("id", "rank").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :6]
    assert got["neighbour"].to_numpy().reshape(-1, 6).tolist() == want.tolist()


def test_outlier_factor(cloud):
    x = cloud.withColumn("v", F.array("x1", "x2"))
    out = lof.fit_flag(x, "id", "v", 20, 0.05, ball_rows=40, block=100).toPandas()
    assert out["lof_score"].between(0, 1).all() and out["lof_flag"].sum() == 16


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(2)
    s, y = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score DOUBLE, label INT")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert abs(metrics.auc(df).first().auc - want) < 1e-12
    assert metrics.auc(df.filter("label = 1")).first().auc is None


def test_sweep_and_best_threshold(spark):
    df = spark.createDataFrame([(0.95, 1), (0.55, 1), (0.45, 0), (0.05, 0)], "score DOUBLE, label INT")
    best = metrics.best_threshold(metrics.threshold_sweep(df)).first()
    assert best.threshold == 0.5 and best.f1 == 1.0


def test_numeric_contamination_or_fixed_half(cloud):
    s = cloud.withColumn("s", F.col("id") / 1000)
    assert metrics.flag_top(s, "s", "auto").agg(F.sum("flagged")).first()[0] == 0
    assert metrics.flag_top(s, "s", 0.1).agg(F.sum("flagged")).first()[0] == 32
    with pytest.raises(ValueError):
        metrics.flag_top(s, "s", "guess")


def test_attribution_hits_its_prototype(spark):
    proto = {"a": {"u": 2.0, "v": 0.0}, "b": {"u": 0.0, "v": 2.0}}
    df = spark.createDataFrame([(1, 2.0, 0.0), (1, 0.1, 1.9), (0, 5.0, 5.0)], "f INT, u_s DOUBLE, v_s DOUBLE")
    got = patterns.attribute(df, "f", proto, ["u", "v"]).collect()
    assert [r.attributed_pattern for r in got] == ["a", "b", None]
    assert got[0].centroid_distance == 0 and 0.5 < got[0].confidence < 1 and got[2].confidence is None
    with pytest.raises(ValueError):
        patterns.attribute(df, "f", {}, ["u", "v"])


def test_pattern_errors(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x DOUBLE, is_spoofing INT")
    with pytest.raises(ValueError, match="label column"):
        patterns.fit_patterns(df, ["x"], ["layering"])
    with pytest.raises(ValueError, match="no positive"):
        patterns.fit_patterns(df, ["x"], ["spoofing"])
    with pytest.raises(ValueError, match="positive row"):
        patterns.fit_patterns(df, ["x"], ["spoofing"], drop_empty=True)
    with pytest.raises(ValueError, match="confirmed"):
        patterns.prototypes_from_examples(df, ["x"], ["spoofing"])


def test_scaling_refuses_flat_columns(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x DOUBLE")
    with pytest.raises(Exception, match="without spread"):
        metrics.scale(df, ["x"], "min_max").collect()


def test_training_takes_all_markets(spark, data, monkeypatch):
    from tapewatch.catalog import jobs as catalog
    from tapewatch.plans import jobs
    from tapewatch.schemas import MARKETS

    monkeypatch.setattr(jobs, "train_market", lambda df, market, *a, **kw: (market, df.filter(F.col("market") == market)))
    models, scored = catalog._trained(spark, data)
    assert models == MARKETS and {r.market for r in scored.select("market").distinct().collect()} == set(MARKETS)


def test_training_takes_all_patterns_and_rounds(spark, data, monkeypatch):
    from tapewatch.catalog import learning, load_all
    from tapewatch.operators import models
    from tapewatch.schemas import PATTERNS

    n = learning.labelled_bars(spark, data).agg(*[F.sum(f"is_{p}").alias(p) for p in PATTERNS]).first()
    assert all(n[p] > 10 for p in PATTERNS)
    seen, boosting = [], models.boosting
    monkeypatch.setattr(models, "boosting", lambda rounds, **kw: seen.append(rounds) or boosting(2, **kw))
    assert load_all()["boosting_stages"].build(spark, data).count() == len(learning.SMALL) and seen == [1000]


def test_weak_labels_are_trained_at_the_default_cutoff(spark, data):
    """No weak label of the smallest tables is as sure as that, so no pattern is trained."""
    from tapewatch.catalog import load_all

    assert load_all()["weak_label_training"].build(spark, data).collect() == []


def test_scorecard_is_stored_and_a_broken_forest_does_not_stop_it(spark):
    from tapewatch.operators.patterns import Scorecard
    from tapewatch.plans import registry

    root = workspace(spark)
    card = Scorecard(["return", "rsi_14d"], {"spoofing": {"": -1.0, "rsi_14d": 0.02}, "layering": {"return": 2.0}})
    registry.save(spark, registry.MarketModels("CRYPTO", detector=card, trained_at="now"), root)
    spark.createDataFrame([("not a forest",)], "x string").write.parquet(f"{root}/CRYPTO/forest")
    back = registry.load(spark, "CRYPTO", root)
    assert back.forest is None and "forest" in back.errors and back.loaded and back.trained_at == "now"
    assert back.detector == Scorecard(["return", "rsi_14d"], {"spoofing": {"": -1.0, "rsi_14d": 0.02}, "layering": {"return": 2.0}})
    rows = spark.createDataFrame([(0.0, 50.0), (None, 50.0)], "`return` double, rsi_14d double")
    got = back.detector.predict_proba(rows).select("proba_spoofing", "proba_layering").collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (0.5, None)]


@pytest.mark.parametrize("ball_rows, block", [(1024, 4096), (20, 7)])
def test_neighbours_over_many_balls(spark, ball_rows, block):
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(c, 0.3, (60, 3)) for c in (0, 4, 9)] + [np.round(rnd.uniform(0, 3, (60, 3)), 0), np.ones((40, 3))])
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in lof.knn(frame, "id", "x", 5, ball_rows=ball_rows, block=block).collect()}
    assert len(got) == 5 * len(x)
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:5]
        assert [got[i, r + 1][0] for r in range(5)] == [j for _, j in want] and np.allclose([got[i, r + 1][1] for r in range(5)], [v for v, _ in want])


def test_few_rows_have_few_neighbours(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [0.0, 1.0])], "id long, x array<double>")
    got = sorted((r.id, r["rank"], r.neighbour, r.distance) for r in lof.knn(rows, "id", "x", 5).collect())
    assert got == [(1, 1, 3, 0.0), (1, 2, 2, 2.0), (2, 1, 1, 2.0), (2, 2, 3, 2.0), (3, 1, 1, 0.0), (3, 2, 2, 2.0)]
    assert lof.knn(rows.limit(0), "id", "x", 5).count() == 0


def test_compared_pairs_grow_much_slower_than_all_pairs(spark):
    rnd = np.random.default_rng(6)
    centre = rnd.uniform(-50, 50, (400, 4))
    pairs = {}
    for n in (2_000, 8_000):
        x = centre[rnd.integers(0, 400, n)] + rnd.normal(0, 0.2, (n, 4))
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        compared = []
        lof.knn(frame, "id", "x", 3, ball_rows=50, compared=compared).count()
        pairs[n] = sum(compared)
    assert pairs[2_000] < 0.25 * 2_000 ** 2 and pairs[8_000] < 4 ** 1.5 * pairs[2_000], pairs


def test_staged_margins_and_patience(spark):
    from pyspark.ml.functions import vector_to_array

    from tapewatch.operators import ensembles, models

    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 3))
    y = ((x[:, 0] + 0.7 * rnd.normal(size=300)) > 0.3).astype(float)
    rows = spark.createDataFrame([(i, *map(float, v), float(z)) for i, (v, z) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double")
    rows = models.VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    train, held = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    model = models.boosting(8, depth=2).fit(train)
    whole = ensembles.from_boosting(model, ["a", "b", "c"], spark)
    got = ensembles.staged_margins(held, whole).select("margins", "id").collect()
    last = {r.id: 1 / (1 + np.exp(-2 * r.margins[-1])) for r in got}
    want = {r.id: float(r.p[1]) for r in model.transform(held).select("id", vector_to_array("probability").alias("p")).collect()}
    assert len(got[0].margins) == 8 and all(abs(last[i] - want[i]) < 1e-9 for i in want)
    null = held.limit(1).withColumn("b", F.lit(None).cast("double"))
    assert ensembles.staged_margins(null, whole).first().margins is None
    short, report, stop = ensembles.boost_with_patience(train, held, ["a", "b", "c"], rounds=8, patience=2, depth=2)
    aucs = {r.stage: r.auc for r in report.collect()}
    best, at, seen = -1.0, 0, 0
    for stage in range(1, 9):  # the plain rule on the same stages
        seen = stage
        if aucs[stage] > best:
            best, at = aucs[stage], stage
        if stage - at >= 2:
            break
    assert tuple(stop.first()) == (at, best, seen) and len(short.weights) == at


def test_neighbour_search_holds_little_at_a_time(monkeypatch):
    """Rows that visit many balls repeat their vectors; frames stay small and lose no visit."""
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(300, 4)), rng.normal(size=(40, 4))
    monkeypatch.setattr(lof, "HELD", 1000)
    monkeypatch.setattr(lof, "SENT_ROWS", 100)
    rows = pd.DataFrame({"id": range(300), "x": list(x), "bound": np.inf})
    dealt = list(lof._deal([rows], centres))
    assert max(map(len, dealt)) <= 25
    ball = pd.concat(dealt)["ball"]
    assert (ball.to_numpy() == ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)).all()
    size = np.arange(40)
    sent = list(lof._visits([rows.assign(ball=ball)], centres, np.zeros(40), size, 0, 39))
    assert max(map(len, sent)) <= 100
    got = {(r.id, r.ball) for r in pd.concat(sent).itertuples()}
    assert got == {(i, b) for i in range(300) for b in range(1, 40) if b != ball.iloc[i]}


def test_large_balls_are_searched_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(400, 3)), 1))], "id BIGINT, v ARRAY<DOUBLE>")
    whole = lof.knn(rows, "id", "v", 5, ball_rows=200).orderBy("id", "rank").toPandas()
    monkeypatch.setattr(lof, "PART_ROWS", 30)
    parts = lof.knn(rows, "id", "v", 5, ball_rows=200, block=64).orderBy("id", "rank").toPandas()
    pd.testing.assert_frame_equal(whole, parts)


def test_copies_are_searched_as_one_vector(spark):
    """Rows far from the origin, each vector thirty times: the search compares distinct vectors only, and ranks rows by distance and id."""
    rng = np.random.default_rng(9)
    x = np.repeat(1e6 + np.round(rng.normal(size=(60, 3)), 2), 30, axis=0)[rng.permutation(1800)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    compared = []
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in lof.knn(frame, "id", "x", 40, ball_rows=20, compared=compared).collect()}
    assert len(got) == 40 * len(x) and sum(compared) <= 60 * 60
    for i in range(0, len(x), 37):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = sorted((d[j], j) for j in range(len(x)) if j != i)[:40]
        assert [got[i, r + 1] for r in range(40)] == [(j, v) for v, j in want]


def test_the_sieve_keeps_every_near_pair():
    rng = np.random.default_rng(10)
    for offset in (0, 1e7):
        a, b = offset + rng.normal(size=(50, 5)), offset + np.round(rng.normal(size=(300, 5)), 1)
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        for bound in (np.full(50, np.inf), np.sort(d, axis=1)[:, 3]):
            r, c = lof._sieve(a, b, bound, 7)
            near = {(i, j) for i in range(50) for j in np.argsort(d[i], kind="stable")[:7] if d[i, j] <= bound[i]}
            assert near <= set(zip(r.tolist(), c.tolist())) and len(r) < 50 * 20


def test_forest_of_packed_rows(spark):
    """Counts of one open node equal plain sums, the forest learns a rule, survives saving, and caches no row."""
    from tapewatch.operators import bagging, models
    from tapewatch.session import workspace

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.8)).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v), int(z)) for i, (v, z) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y int")
    rows = models.prepared(rows, ["a", "b", "c", "d"], "y", keep=["id"])
    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    cached = set(spark.sparkContext._jsc.getPersistentRDDs())
    m = models.random_forest(30, depth=4).fit(train)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= cached
    scored = models.probability(m, test).collect()
    assert metrics.auc(models.probability(m, test)).first().auc > 0.99 and m.importances[[1, 3]].sum() > 0.9
    path = f"{workspace(spark)}/forest"
    m.save(path)
    back = bagging.ForestModel.load(path)
    assert [r.score for r in models.probability(back, test).collect()] == [r.score for r in scored]

    times = np.concatenate([bagging.times_drawn(50_000, 1, t, 0, 0) for t in range(4)])
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    bins, w = rng.integers(0, 5, (2, 500)).astype(np.uint8), rng.random(500)
    block = bagging.pa.RecordBatch.from_arrays([bagging.pa.array([v]) for v in (7, 0, bins.tobytes(), y[:500].astype(np.uint8).tobytes(), w.tobytes())],
                                               ["part", "number", "bins", "y", "w"])
    empty = (np.full((1, 3), -1), np.full((1, 3), bagging.BINS))
    [got] = bagging._counted(iter([block]), empty, [np.array([[1, 0]])], np.array([[0, -1, -1]]), 0, 42)
    sums = np.frombuffer(got.column(1)[0].as_py()).reshape(1, 2, bagging.BINS, 2)
    drawn = bagging.times_drawn(500, 42, 0, 7, 0) * w
    for j, f in enumerate((1, 0)):
        for b in range(5):
            for label in (0, 1):
                assert abs(sums[0, j, b, label] - drawn[(bins[f] == b) & (y[:500] == label)].sum()) < 1e-9
    split = bagging._splits([np.array([[0, 1]])], [np.array([0])])(pd.DataFrame({"tree": [0], "sums": [sums.tobytes()]})).iloc[0]
    best = -1
    for f in (1, 0):
        for b in range(4):
            left = bins[f] <= b
            gini = [2 * p * (1 - p) * s for s, p in ((drawn[side].sum(), np.average(y[:500][side], weights=drawn[side])) for side in (left, ~left))]
            p = np.average(y[:500], weights=drawn)
            best = max(best, 2 * p * (1 - p) - sum(gini) / drawn.sum())
    assert abs(split["gain"] - best) < 1e-9
    pure = models.random_forest(3).fit(train.withColumn("label", F.lit(1.0)))
    assert {r.score for r in models.probability(pure, test).collect()} == {1.0}


def test_rows_that_repeat_an_id_count_each_time(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(30, 2)), 3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(None, [0.0, 0.0])], "id long, x array<double>")
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in lof.knn(frame, "id", "x", 6, ball_rows=10).collect()}
    assert len(got) == 6 * 30
    for i in range(30):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        found = sorted((d[j], j) for j in [*range(30)] * 2)[:7]
        want = [(j, v) for v, j in found if j != i for _ in range(2)][:6]
        assert [got[i, r + 1] for r in range(6)] == want
