"""Small fixtures against brute force, with nulls, ties, repeated rows, empty tables and hot groups."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforetime.functions.months import clean_month
from aforetime.operators import (
    asof, grid, history, kernels, known, large_sources, panels, profile, rolling, snapdiff, spikes, statistics,
)
from aforetime import storage
from aforetime.storage import ordered_blocks

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


VERSIONS = "row_id long, k string, value double, usable_at timestamp, action string, extra string"


def brute_history(rows):
    """Validity rows by walking each key's instants in order."""
    out = []
    for key in {r[1] for r in rows}:
        by_time = {}
        for r in sorted((r for r in rows if r[1] == key and r[3] is not None), key=lambda r: r[0]):
            by_time[r[3]] = r
        states = []
        for t in sorted(by_time):
            _, _, v, _, a, _ = by_time[t]
            gone = (a or "").strip().lower() == "delete"
            state = "d" if gone else "m" if v is None or v != v else f"{v:.11e}"
            if not states or states[-1][1] != state:
                states.append((t, state))
        for i, (t, state) in enumerate(states):
            if state != "d":
                out.append((key, t, states[i + 1][0] if i + 1 < len(states) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_history_with_a_hot_key(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(600):
        key = "hot" if draw.random() < 0.5 else draw.choice(["a", "b", None])
        value = draw.choice([None, float("nan"), 1.0, 1.0 + 1e-14, 2.0, 3.0])
        rows.append(
            (
                i, key, value, at(draw.choice([None, *range(150)])),
                draw.choice(["Replace", " delete ", None, "", "REPLACE"]), "x"
            )
        )
    df = spark.createDataFrame(rows, VERSIONS)
    found = history.history(df, ["k"], checkpoint_every=4).collect()
    got = sorted(
        (
            (
                r["k"], r["valid_from"].astimezone(timezone.utc),
                r["valid_to"] and r["valid_to"].astimezone(timezone.utc)
            ) for r in found
        ),
        key=str
    )
    assert got == brute_history(rows)


def test_history_of_nothing(spark):
    assert history.history(spark.createDataFrame([], VERSIONS), ["k"]).count() == 0


def test_blocks_split_a_hot_key(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    sizes = [r["count"] for r in ordered_blocks(df, ["k", "t"], "test", 8).groupBy("_blk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000


@pytest.mark.parametrize("seed", range(3))
def test_known_attributes_against_brute_force(spark, seed):
    draw = random.Random(seed)
    changes = [
        (i, "hot" if draw.random() < 0.6 else draw.choice(["a", None]), date(2019, draw.randint(1, 12), 1) if draw.random() < 0.95 else None,
         draw.choice([None, 1.0, 2.0, float("nan")]), at(draw.choice([None, *range(60)])))
        for i in range(500)
    ]
    events = [
        (f"e{i}", draw.choice(["hot", "a", None, "none"]), at(draw.choice([None, *range(60)]))) for i in range(120)
    ]
    found = known.as_known(
        spark.createDataFrame(events, "event_id string, k string, cut timestamp"),
        spark.createDataFrame(changes, "row_id long, k string, period date, value double, seen timestamp"),
        ["k"], event_id="event_id", event_time="cut", change_time="seen", period="period", value="value",
    )
    wanted = set()
    for event, key, cut in events:
        latest = {}
        for row, k, period, value, seen in changes:
            if None not in (key, cut, k, seen, period) and k == key and seen < cut and (seen, row) >= latest.get(period, ((seen, row),))[0]:
                latest[period] = ((seen, row), row, value)
        alive = {p: x[1] for p, x in latest.items() if x[2] is not None and x[2] == x[2]}
        if alive:
            wanted.add((event, alive[max(alive)], max(alive)))
    assert {(r["event_id"], r["row_id"], r["period"]) for r in found.collect()} == wanted


SNAPSHOT = "row_id long, snapshot_no int, k string, v string, extra int"


def test_snapshot_changes_against_brute_force(spark):
    draw = random.Random(7)
    rows = [
        (
            i, draw.choice([1, 2, 4, None]), draw.choice(["a", "b", "c", None, "ä", "z" * 3000]),
            draw.choice(["1", "1.0", " 1e0 ", "x", None, "", "NaN", "2"]), 0
        )
        for i in range(60)
    ]
    found = snapdiff.snapshot_changes(
        spark.createDataFrame(rows, SNAPSHOT), "snapshot_no", {"k": F.col("k")}, F.when(
            F.col("v").rlike(r"^\s*[0-9.e]+\s*$"), F.trim("v").try_cast("double")
        )
    ).collect()
    held = {1: {}, 2: {}, 4: {}}
    for _, s, k, v, _ in rows:
        if s is not None:
            try:
                number = float(v)
                held[s][k] = None if number != number else number
            except (TypeError, ValueError):
                held[s][k] = None
    wanted = set()
    for old, new in ((1, 2), (2, 4)):
        for k in held[old].keys() | held[new].keys():
            if k not in held[old]:
                wanted.add((new, k, "added"))
            elif k not in held[new]:
                wanted.add((new, k, "removed"))
            elif held[old][k] != held[new][k]:
                wanted.add((new, k, "changed"))
    assert {(r["snapshot_no"], r["k"], r["change_kind"]) for r in found} == wanted
    # several columns are compared as a struct
    pairs = [(1, 1, "a", "x", 0), (2, 1, "b", "x", 0), (3, 2, "a", "x", 1), (4, 2, "b", "x", 0)]
    both = snapdiff.snapshot_changes(
        spark.createDataFrame(pairs, SNAPSHOT), "snapshot_no", {"k": F.col("k")}, F.struct("v", "extra")
    )
    assert [tuple(r) for r in both.collect()] == [(2, "a", "changed")]
    assert snapdiff.snapshot_changes(
        spark.createDataFrame([], SNAPSHOT), "snapshot_no", {"k": F.col("k")}, F.lit(1.0)
    ).count() == 0


def test_profile_is_exact(spark):
    draw = random.Random(3)
    rows = [
        (
            load, draw.choice(["a", "b", "", None, "c"]),
            str(draw.choice([1, 2, 3.5, -7, 1e3])) if draw.random() < 0.9 else None
        ) for load in (1, 2, 5) for _ in range(200)
    ]
    df = spark.createDataFrame(rows, "load int, t string, n string")
    got = {(r["load"], r["column_name"]): r for r in profile.column_profile(df, "load", ["t", "n"], ["n"]).collect()}
    for load, before in ((2, 1), (5, 2)):
        new, old = (np.sort([float(r[2]) for r in rows if r[0] == x and r[2] is not None]) for x in (load, before))
        grid_ = np.unique(np.concatenate([new, old]))
        distance = np.abs(
            np.searchsorted(new, grid_, "right") / len(new) - np.searchsorted(old, grid_, "right") / len(old)
        ).max()
        row = got[(load, "n#number")]
        assert row["ks_distance"] == pytest.approx(distance)
        assert row["q75"] == new[int(np.ceil(0.75 * len(new))) - 1]
        share = lambda x, v: sum(r[1] == v for r in rows if r[0] == x) / sum(bool(r[1]) for r in rows if r[0] == x)
        assert got[(load, "t")]["value_share_change"] == pytest.approx(
            max(abs(share(load, v) - share(before, v)) for v in "abc")
        )
    assert got[(1, "t")]["ks_distance"] is None
    assert profile.column_profile(df.where("false"), "load", ["t", "n"], ["n"]).count() == 0


def test_violations_treat_null_as_broken(spark):
    df = spark.createDataFrame([(1, "2020-01"), (2, None), (3, "x")], "id int, m string")
    found = profile.violations(df, "id", {"m": F.col("m").rlike("^[0-9]{4}-[0-9]{2}$")}).collect()
    assert {(r["id"], r["column_name"]) for r in found} == {(2, "m"), (3, "m")}


PANEL = "row_id long, p string, origin_month string, observation_period string, transformed_value double, is_missing string"


def test_grid_marks_gaps_and_fills(spark):
    rows = [(i, "s", f"2020-{m:02d}", o, v, f) for i, (m, o, v, f) in enumerate([
        (1, "2019-12", 1.0, "0"), (2, "Jan-2020", 2.0, " FALSE"), (3, "2020-01-05", 2.0, "0"), (5, None, None, "1"),
        (6, "2020-05", 6.0, "0"), (6, "2020-05", 6.0, "0"), (7, "", float("nan"), "0"), (8, "2020-07", None, "0"), (9, "2020-08", 9.0, "0"),
    ])]
    rows.append((99, None, "never", "2020-01", 1.0, "0"))
    found = grid.regular_grid(spark.createDataFrame(rows, PANEL), ["p"]).collect()
    gaps = {r["origin_month"]: r["gap"] for r in found}
    assert gaps == {
        "2020-01": None, "2020-02": None, "2020-03": "stale", "2020-04": "absent", "2020-05": "missing",
        "2020-06": None, "2020-07": None, "2020-08": "missing", "2020-09": None,
    }
    filled = {r["origin_month"]: r["filled"] for r in found}
    assert filled["2020-04"] == pytest.approx(4.0, abs=0.3) and filled["2020-08"] == pytest.approx(8.0, abs=0.3)
    assert grid.regular_grid(spark.createDataFrame([], PANEL), ["p"]).count() == 0


def test_smoother_matches_dense_solution():
    """The smoother against the least-squares form of the same model."""
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(0.05, 0.15, 30))
    y = np.sin(t) + rng.normal(0, 0.05, 30)
    y[[4, 11, 12, 20]] = np.nan
    level, variance, noise, _ = grid._smooth(t[None], y[None], np.array([10.0]))
    n, q = len(t), 10.0
    precision, target = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    first = int(np.flatnonzero(~np.isnan(y))[0])
    precision[0, 0] = precision[1, 1] = 1e-6
    target[0] = 1e-6 * y[first]
    for i in range(n):
        if not np.isnan(y[i]):
            precision[2 * i, 2 * i] += 1
            target[2 * i] += y[i]
        if i:
            dt = t[i] - t[i - 1]
            move = np.array([[1, dt], [0, 1]])
            weight = np.linalg.inv(q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]))
            both = np.hstack([-move, np.eye(2)])
            precision[2 * i - 2 : 2 * i + 2, 2 * i - 2 : 2 * i + 2] += both.T @ weight @ both
    solved = np.linalg.solve(precision, target)[::2]
    assert np.allclose(level[0], solved, atol=1e-4)
    assert np.allclose(variance[0], np.diag(np.linalg.inv(precision))[::2], rtol=1e-3, atol=1e-6)


def test_extreme_deviates_match_the_definition():
    rng = np.random.default_rng(0)
    for n in (20, 57, 120):
        x = rng.normal(size=n)
        x[:3] = [9.0, -1e7, 14.0]
        left, found, gone = list(range(n)), 0, []
        for i, limit in enumerate(spikes._limits(n, 0.05), 1):
            part = x[left]
            worst = int(np.abs(part - part.mean()).argmax())
            if abs(part[worst] - part.mean()) > limit * part.std(ddof=1):
                found = i
            gone.append(left.pop(worst))
        assert set(np.flatnonzero(spikes.extreme_deviates(x))) == set(gone[:found])


def test_spikes_ranges_and_stuck_runs(spark):
    rng = np.random.default_rng(5)
    value = np.round(5 + rng.normal(0, 0.1, 120), 4)
    value[40] = 9.0
    value[60:62] = [1.0, 1.2]
    value[80:90] = value[80]
    value[100:] += 3  # a lasting change of level
    value[30] = 5000.0
    rows = [
        (i, "s", f"{2000 + i // 12}-{i % 12 + 1:02d}", T0 + timedelta(days=30 * i), float(v)) for i,
        v in enumerate(value)
    ]
    rows += [
        (500, "s", "2003-05", T0, 9.0), (501, "s", "2003-05", T0, None), (502, None, "2001-01", T0, 1.0),
        (503, "s", "?", T0, float("nan"))
    ]
    df = spark.createDataFrame(rows, "row_id long, s string, m string, t timestamp, v double")
    registry = spark.createDataFrame([("S", None, 100.0)], "series_id string, min_possible double, max_possible double")
    from aforetime.functions.months import month_index

    found = spikes.implausible(
        df, ["s"], period=month_index(F.col("m")), value="v", order="t", series="s", registry=registry
    )
    got = {(r["row_id"], r["kind"]) for r in found.collect()}
    assert got == {
        (30, "range"), (503, "range"), (40, "spike"), (500, "spike"), (60, "spike"), (61, "spike"),
        *((i, "stuck") for i in range(80, 90))
    }


def test_hot_source_is_judged_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(spikes, "HOT_READINGS", 100)
    rng = np.random.default_rng(2)
    value = np.round(5 + rng.normal(0, 0.1, 600), 4)
    bad = [50, 149, 150, 300, 451]
    for i in bad:
        value[i] = 9.0 + i / 1000
    rows = [(i, "s", i, T0 + timedelta(days=i), float(v)) for i, v in enumerate(value)]
    df = spark.createDataFrame(rows, "row_id long, s string, m int, t timestamp, v double")
    registry = spark.createDataFrame([], "series_id string, min_possible double, max_possible double")
    found = spikes.implausible(df, ["s"], period=F.col("m"), value="v", order="t", series="s", registry=registry)
    assert sorted(r["row_id"] for r in found.collect()) == bad


@pytest.mark.parametrize("versions", [False, True])
def test_size_and_partitions_change_no_verdict(spark, monkeypatch, versions):
    rng = np.random.default_rng(7)
    value = np.round(5 + rng.normal(0, 0.05, 600), 4)
    value[300:] = np.round(5 + rng.normal(0, 1.0, 300), 4)  # a rough phase: its moves are normal for the source
    value[[60, 120, 180]] = [7.0, 6.5, 7.5]  # less than those moves
    value[[240, 450]] = [90.0, 95.0]
    rows = [(i, "s", i // 20 if versions else i, T0 + timedelta(days=i), float(v)) for i, v in enumerate(value)]
    df = spark.createDataFrame(rows, "row_id long, s string, m int, t timestamp, v double")
    registry = spark.createDataFrame([], "series_id string, min_possible double, max_possible double")

    def run():
        found = spikes.implausible(
            df, ["s"], period=F.col("m"), value="v", order="t", series="s", registry=registry, versions=versions
        )
        return sorted(tuple(r) for r in found.collect())

    whole = run()
    assert [r[0] for r in whole] == [240, 450]
    monkeypatch.setattr(spikes, "HOT_READINGS", 100)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert run() == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize("seed", [0, 3])
@pytest.mark.parametrize("versions", [False, True])
def test_spark_and_one_task_judge_alike(spark, monkeypatch, versions, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for source in ("a", "b", None):
        n = int(rng.integers(150, 400))
        value = np.round(20 + np.cumsum(rng.normal(0, 0.05, n)) + rng.standard_t(3, n) * 0.1, int(rng.integers(1, 5)))
        value[rng.choice(n, 12)] += rng.choice([-3, 3, 8], 12)
        value[n // 2 : n // 2 + 2] += 6
        value[60:70] = value[60]
        value[n - 40 :] += rng.choice([0, 4])
        for i, v in enumerate(value):
            rows.append((len(rows), source, i // int(rng.integers(3, 9)) if versions else i, T0 + timedelta(days=i), float(v)))
    df = spark.createDataFrame(rows, "row_id long, s string, m int, t timestamp, v double")
    registry = spark.createDataFrame([], "series_id string, min_possible double, max_possible double")

    def run():
        found = spikes.implausible(
            df, ["s"], period=F.col("m"), value="v", order="t", series="s", registry=registry, versions=versions
        )
        return sorted(tuple(r) for r in found.collect())

    whole = run()
    assert len(whole) >= 3
    monkeypatch.setattr(spikes, "HOT_READINGS", 100)
    monkeypatch.setattr(large_sources, "CHUNK", 50)
    assert run() == whole


def test_month_spellings(spark):
    texts = [
        "2004-03", "2004-3", "200403", "2004/03", "2004-03-31", "Mar-2004", "März 2004", "month-2004-03", "03-2004",
        " 2004-03 "
    ]
    df = spark.createDataFrame([(t,) for t in [*texts, "2004-13", "x", "", None]], "t string")
    assert [r[0] for r in df.select(clean_month(F.col("t"))).collect()] == ["2004-03"] * len(texts) + [None] * 4


def test_equality_is_no_knowledge(spark):
    versions = spark.createDataFrame(
        [(1, "a", 1.0, at(1), False), (2, "a", 2.0, at(5), False), (3, "a", None, at(9), True)],
        "row_id long, k string, v double, t timestamp, d boolean"
    )
    spans = asof.validity_intervals(versions, ["k"], at="t", tie="row_id", deleted=F.col("d"))
    decisions = spark.createDataFrame([("a", at(h)) for h in (1, 2, 5, 6, 9, 10)], "k string, cut timestamp")
    found = {(r["cut"].astimezone(timezone.utc), r["v"]) for r in asof.as_of(decisions, spans, ["k"], "cut").collect()}
    assert found == {(at(2), 1.0), (at(5), 1.0), (at(6), 2.0), (at(9), 2.0)}


def test_later_versions_change_nothing_earlier(spark):
    base = [(i, "a", float(i), at(i), False) for i in range(10)]
    schema = "row_id long, k string, v double, t timestamp, d boolean"
    decisions = spark.createDataFrame([("a", at(h)) for h in range(5)], "k string, cut timestamp")

    def run(rows):
        spans = asof.validity_intervals(
            spark.createDataFrame(rows, schema), ["k"], at="t", tie="row_id", deleted=F.col("d")
        )
        return sorted((r["cut"], r["v"]) for r in asof.as_of(decisions, spans, ["k"], "cut").collect())

    assert run(base) == run([*base[:7], *((i, "a", -1.0, at(h), True) for i, h in ((90, 6), (91, 8)))])


@pytest.mark.parametrize("seed", range(4))
def test_episodes_match_a_state_machine(spark, seed):
    draw = random.Random(seed)
    flags = {g: [draw.random() < 0.5 for _ in range(60)] for g in ("a", "b")}
    wanted = []
    for g, line in flags.items():
        start, i, number = None, 0, 0
        for i, b in enumerate(line):
            if start is None and b and all(line[i : i + 3]) and i + 3 <= len(line):
                start = i
            elif start is not None and not any(line[i : i + 3]) and i + 3 <= len(line):
                number += 1
                wanted.append((g, number, start, i - 1, sum(line[start:i]), False))
                start = None
        if start is not None:
            wanted.append((g, number + 1, start, len(line) - 1, sum(line[start:]), True))
    df = spark.createDataFrame(
        [(g, i, b) for g, line in flags.items() for i, b in enumerate(line)], "g string, i int, b boolean"
    )
    found = [tuple(r) for r in rolling.breach_episodes(df, ["g"], "i", "b").collect()]
    assert sorted(found) == sorted(wanted)


def test_failed_audit_publishes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "k string, v double")
    audited = panels.audit(df, ["k"], value="v")
    with pytest.raises(panels.AuditFailed):
        panels.publish(df, str(tmp_path / "x"), audited, {"duplicate_keys": 0})
    assert not (tmp_path / "x").exists()
    panels.publish(df, str(tmp_path / "x"), audited, {"point_in_time_violations": 0})
    with pytest.raises(Exception, match="(?i)exists"):
        panels.publish(df, str(tmp_path / "x"), audited, {})


def test_exact_split_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.sort(rng.normal(size=9))
        best = min(
            sum(
                ((p - p.mean()) ** 2).sum() for p in (x[:i], x[i:j], x[j:])
            ) for i in range(1, 8) for j in range(i + 1, 9)
        )
        assert kernels.best_split_1d(x, 3)[0] == pytest.approx(best)


def test_hidden_chain_improves_and_separates():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, 60), rng.normal(3, 0.3, 60)])
    x[5] = np.nan
    mean, _, move, trace = kernels.gaussian_hmm(x)
    assert all(b >= a - 1e-3 for a, b in zip(trace, trace[1:], strict=False))
    assert mean == pytest.approx([0, 3], abs=0.2) and move.diagonal().min() > 0.9


def test_ragged_components_find_the_rank():
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(120, 2)) @ rng.normal(size=(2, 10)) + 0.05 * rng.normal(size=(120, 10))
    matrix[rng.random(matrix.shape) < 0.1] = np.nan
    assert kernels.choose_rank(matrix, 4)[0] == 2


def test_subspace_distance_ignores_rotation():
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.normal(size=(6, 2)))[0]
    turned = basis @ np.linalg.qr(rng.normal(size=(2, 2)))[0]
    assert kernels.subspace_distance(basis, turned) == pytest.approx((1, 0), abs=1e-7)


def test_running_sums_and_ranks_over_blocks(spark):
    from aforetime.operators import statistics
    from aforetime.storage import running_sums

    draw = random.Random(9)
    rows = [("hot" if draw.random() < 0.8 else draw.choice(["a", "b"]), draw.randint(0, 40)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x int")
    counted = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    for r in running_sums(counted, ["g"], ["x"], {"upto": "n"}, "test").collect():
        assert r["upto"] == sum(g == r["g"] and x <= r["x"] for g, x in rows)
    for r in statistics.average_ranks(df, ["g"], "x", "rank").distinct().collect():
        below, equal = (
            sum(g == r["g"] and f(x) for g, x in rows) for f in (lambda x: x < r["x"], lambda x: x == r["x"])
        )
        assert r["rank"] == below + (equal + 1) / 2


def test_hull_membership_over_partitions(spark):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(3000, 2))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in points], "g string, x double, y double").repartition(7)
    corners = kernels.hull_corners(df, "g", "x", "y")
    assert np.allclose(sorted(corners.first()["corners"]), sorted(kernels.hull(points).tolist()))
    joined = df.join(corners, "g")
    assert joined.where(kernels.inside_hull("corners", "x", "y")).count() == 3000
    assert joined.withColumn("x", F.col("x") + 10).where(kernels.inside_hull("corners", "x", "y")).count() == 0


def test_spline_basis_and_folds():
    at = np.linspace(0, 2, 60)
    basis = kernels.spline_basis(at, np.array([0.5, 1.0, 1.5]), 0.0, 2.0)
    assert basis.shape == (60, 7) and np.allclose(basis.sum(1), 1)
    cubic = at**3 - at
    assert np.allclose(basis @ np.linalg.lstsq(basis, cubic, rcond=None)[0], cubic)
    assert kernels.penalty_by_forward_folds(at, np.sin(at), (0.1, 1.0))[1] < 1


def test_factor_filter_follows_the_factor():
    rng = np.random.default_rng(12)
    factor = np.zeros(200)
    for t in range(1, 200):
        factor[t] = 0.8 * factor[t - 1] + rng.normal()
    matrix = factor[:, None] * np.array([1.0, 0.8, 1.2, 0.9]) + 0.3 * rng.normal(size=(200, 4))
    matrix[rng.random(matrix.shape) < 0.2] = np.nan
    means, variances, phi = kernels.factor_filter(matrix)
    assert abs(np.corrcoef(means, factor)[0, 1]) > 0.95 and 0.6 < phi < 0.95 and (variances > 0).all()


def test_block_bootstrap_is_repeatable_and_whole(spark):
    df = spark.createDataFrame([("a", [1.0] * 30), ("b", [float(i) for i in range(40)]), ("c", [])], "k string, x array<double>")
    run = lambda n: sorted(tuple(r) for r in kernels.block_means(df.repartition(n), ["k"], "x", replicates=120, block=5, seed=1).collect())
    found = run(1)
    assert found == run(3)
    assert [r[1] for r in found if r[0] == "a"] == list(range(120)) and len(found) == 240
    assert {r[2] for r in found if r[0] == "a"} == {1.0}
    means = [r[2] for r in found if r[0] == "b"]
    assert abs(np.mean(means) - 19.5) < 2 and np.std(means) > 1


@pytest.mark.parametrize("circular", [True, False])
def test_block_intervals_are_quantiles_of_the_replicates(spark, circular):
    x = [float(v) for v in np.random.default_rng(2).normal(size=37)]
    df = spark.createDataFrame([("a", [1.0] * 30), ("b", x), ("c", [])], "k string, x array<double>")
    found = {(r["k"], r["block"]): r for r in kernels.block_intervals(df, ["k"], "x", replicates=150, blocks=(5, 12), seed=1, circular=circular).collect()}
    assert set(found) == {("a", 5), ("a", 12), ("b", 5), ("b", 12)}
    assert found["a", 5]["mean_low"] == found["a", 5]["p90_high"] == 1.0
    if circular:
        means = [r["mean"] for r in kernels.block_means(df, ["k"], "x", replicates=150, block=5, seed=6).where("k = 'b'").collect()]
        assert found["b", 5]["mean_low"] == pytest.approx(np.quantile(means, 0.025))
    assert found["b", 5]["mean_low"] < np.mean(x) < found["b", 5]["mean_high"]
    wide = np.random.default_rng(3).normal(size=(5, 23))
    assert kernels._upper_decile(wide) == pytest.approx(np.quantile(wide, 0.9, axis=1))


def test_empty_tables_give_no_rows(spark):
    events = spark.createDataFrame([], "event_id string, k string, cut timestamp, value string")
    changes = spark.createDataFrame([], "row_id long, k string, period date, value double, seen timestamp, cut int")
    found = known.as_known(
        events, changes, ["k"], event_id="event_id", event_time="cut", change_time="seen", period="period", value="value"
    )
    assert found.count() == 0
    df = spark.createDataFrame([], "row_id long, s string, m int, t timestamp, v double, kind string, period string")
    registry = spark.createDataFrame([], "series_id string, min_possible double, max_possible double")
    for versions in (False, True):
        cases = spikes.implausible(
            df, ["s"], period=F.col("m"), value="v", order="t", series="s", registry=registry, versions=versions
        )
        assert cases.count() == 0
    assert panels.audit(df, ["s"], value="v").first()["n_rows"] == 0


def test_clashing_extra_columns_are_ignored(spark):
    rows = [(1, "a", 1.0, at(1), None, "x", "y", "z", 5), (2, "a", 2.0, at(2), "Delete", "x", "y", "z", 5)]
    df = spark.createDataFrame(
        rows, "row_id long, k string, value double, usable_at timestamp, action string, state string, prev string, until string, _blk int"
    )
    found = history.history(df, ["k"]).collect()
    assert [(r["k"], r["value"], r["is_missing"]) for r in found] == [("a", 1.0, False)]


def test_blocks_follow_the_data(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "BLOCK_BYTES", 4_000)
    counts = []
    for n in (40_000, 80_000):
        spark.range(n).select(F.rand(1).alias("x")).write.parquet(f"{tmp_path}/{n}")
        counts.append(storage.block_count(spark.read.parquet(f"{tmp_path}/{n}").groupBy("x").count()))
    assert counts[0] > 4 and 1.8 < counts[1] / counts[0] < 2.2
    assert storage.block_count(spark.createDataFrame([(1,)], "x int")) == storage.shuffle_parts(spark)


def test_neighbour_among(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), i, draw.random() < 0.2) for i in range(300)]
    blocks = ordered_blocks(spark.createDataFrame(rows, "k string, t int, ok boolean"), ["k", "t"], "among", 7)
    for after in (False, True):
        found = storage.neighbour(blocks, ["k"], ["t"], ["t"], after=after, name="n", among=F.col("ok")).collect()
        for r in found:
            near = [t for k, t, ok in rows if ok and k == r["k"] and (t > r["t"] if after else t < r["t"])]
            assert (r["n"] and r["n"]["t"]) == ((min if after else max)(near) if near else None)


def test_state_at_an_instant_folds_from_the_nearest_checkpoint(spark):
    draw = random.Random(8)
    rows = [
        (i, draw.choice(["hot", "hot", "a", None]), draw.choice([None, 1.0, 2.0, 3.0]), at(draw.randint(0, 200)), draw.choice(["Delete", "Replace", None]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "row_id long, k string, value double, usable_at timestamp, action string")
    store = history.delta_store(df, ["k"], checkpoint_every=4)
    whole = history.history(df, ["k"], checkpoint_every=4).collect()
    for hour in (0, 57, 133, 250):
        found = {(r["k"], r["value"], r["is_missing"]) for r in history.state_at(store, ["k"], F.lit(at(hour))).collect()}
        moment = at(hour)
        utc = lambda t: t and t.astimezone(timezone.utc)
        assert found == {
            (r["k"], r["value"], r["is_missing"]) for r in whole
            if utc(r["valid_from"]) <= moment and (r["valid_to"] is None or moment < utc(r["valid_to"]))
        }


def test_appending_deliveries_equals_storing_all_anew(spark):
    draw = random.Random(11)
    rows = [
        (
            i, draw.choice(["hot", "hot", "a", "b", "c", None]), draw.choice([None, 1.0, 1.0, 2.0]),
            at(draw.choice([None, *range(120)])), draw.choice(["Delete", "Replace", None]), "x"
        ) for i in range(500)
    ]
    # the deliveries name few keys; late rows, ties and repeated rows among them
    first = [r for r in rows[:300] if r[1] != "c"]
    later = [[r for r in rows[300:400] if r[1] in ("hot", None)], [r for r in rows[400:] if r[1] in ("a", "c", None)] + [r for r in first if r[1] == "a"][:5]]
    keys, log = ["k"], spark.createDataFrame(first, VERSIONS)
    generations = [storage.written(history.delta_store(log, keys, checkpoint_every=4), "deltas")]
    for delivery in later:
        delivered = spark.createDataFrame(delivery, VERSIONS)
        log = log.unionByName(delivered)
        generations = history.appended(generations, log, delivered, keys, checkpoint_every=4)
    held = [{r[0] for r in g.select("k").distinct().collect()} for g in generations]
    assert held == [{"b"}, {"hot"}, {"a", "c", None}]
    got = history.fold_all(generations, keys, checkpoint_every=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, history.history(log, keys, checkpoint_every=4).collect()), key=str)


@pytest.mark.parametrize("inclusive", [False, True])
def test_steps_are_carried_forward_over_blocks(spark, inclusive):
    draw = random.Random(9)
    decisions = [(i, draw.choice(["hot", "hot", "a", None]), draw.choice([None, *range(80)])) for i in range(300)]
    steps = [(draw.choice(["hot", "a", None]), t, float(t)) for t in range(0, 80, 3)]
    d = spark.createDataFrame(decisions, "i long, k string, cut int")
    s = spark.createDataFrame(steps, "k string, t int, v double")
    found = asof.step_function(d, s, ["k"], decision="cut", effective="t", inclusive=inclusive, unmatched=True)
    for r in found.collect():
        known_steps = [
            v for k, t, v in steps
            if k is not None and k == r["k"] and r["cut"] is not None and (t <= r["cut"] if inclusive else t < r["cut"])
        ]
        assert r["v"] == (max(known_steps) if known_steps else None)
    assert found.count() == len(decisions)


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=500), 1)] + [("a", 1.0), ("a", None), (None, 2.0), ("b", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = {r["k"]: (r["lo"], r["hi"]) for r in statistics.quantiles(df, ["k"], "x", {"lo": 0.1, "hi": 0.9}).collect()}
    hot = [v for k, v in rows if k == "hot"]
    assert found == {
        "hot": (pytest.approx(np.quantile(hot, 0.1)), pytest.approx(np.quantile(hot, 0.9))), "a": (1.0, 1.0),
        "b": (pytest.approx(1.1), pytest.approx(1.9)),
    }
