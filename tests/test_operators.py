"""Operators against plain loops."""

import random

from pyspark.sql import functions as F

from clipledger.operators import colour, ingest, matching, ordered, rollup


def test_ordered_matches_plain_windows_on_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", i, rnd.choice([None, 1, 2])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    seg = ordered.block_segment(F.col("i"), 37)
    got = ordered.number_rows(df, ["k"], seg, ["i"], "n")
    got = ordered.previous_row(got, ["k"], seg, ["i"], ["v", "i"], "p")
    got = ordered.running_last(got, ["k"], seg, ["i"], F.col("v"), "last")
    seen = {}
    want = {}
    for k, i, v in rows:
        n, p, last = seen.get(k, (0, None, None))
        last = v if v is not None else last
        want[i] = (n + 1, p, last)
        seen[k] = (n + 1, (v, i), last)
    assert {r.i: (r.n, tuple(r.p) if r.p else None, r["last"]) for r in got.collect()} == want


def _score(n, b, c):
    if n and c and n == c:
        return 100
    for needle, hay, s in ((n, c, 90), (c, n, 85), (b, c, 80), (c, b, 75)):
        if needle and hay and needle in hay:
            return s
    return 0


def _greedy(sides, clips):
    used, out = set(), {}
    for s, n, b in sorted(sides):
        best = max(((_score(n, b, c), -i) for i, c in clips if i not in used), default=(0, 0))
        if best[0] > 0:
            out[s] = (-best[1], best[0])
            used.add(-best[1])
    return out


def test_assign_is_the_greedy_result(spark):
    rnd = random.Random(11)
    words = ["a", "b", "ab", "ba", "abc", "c", "ca", "x y", "y"]
    sides = [(i, rnd.choice([*words, ""]), rnd.choice([*words, ""])) for i in range(40)]
    clips = [(i, rnd.choice(words) + rnd.choice(["", "", "b", "c"])) for i in range(35)]
    assert _assigned(spark, sides, clips, 1000) == _greedy(sides, clips)


def _assigned(spark, sides, clips, block):
    out = matching.assign(
        spark.createDataFrame(sides, "sidecar_ix long, name string, base string"),
        spark.createDataFrame(clips, "clip_ix long, clip_name string"), block=block,
    )
    return {r.sidecar_ix: (r.clip_ix, r.score) for r in out.collect()}


def test_assign_of_one_component_in_waves(spark, monkeypatch):
    """One component at two sizes: cut into waves, the result is the plain loop's, and their number is its size over the block."""
    rnd = random.Random(12)
    words = ["aa", "ab", "ba", "aab", "a"]  # every name holds or is held by "a"
    for n, block in ((30, 7), (120, 31)):
        sides = [(3 * i, rnd.choice(words), rnd.choice(words)) for i in range(n)]
        clips = [(rnd.randrange(10**6) * n + i, rnd.choice(words)) for i in range(n - 5)]
        seen = []
        real = matching._wave
        monkeypatch.setattr(matching, "_wave", lambda *a: seen.append(1) or real(*a))
        assert _assigned(spark, sides, clips, block) == _greedy(sides, clips)
        monkeypatch.undo()
        assert len(seen) == -(-n // block)
    assert _assigned(spark, [(1, "q", "q")], [(1, "z")], 5) == {}


def test_colour_agreement_brute_force(spark):
    rnd = random.Random(5)
    base = [[round(rnd.uniform(-1, 1), 2) for _ in range(10)] for _ in range(4)]
    def near(v):
        return [x + rnd.choice([0.0, 9e-6, -9e-6, 2e-5]) * (rnd.random() < 0.3) for x in v]
    cdls = [(rnd.choice(["d", "e"]), f"c{i}", near(rnd.choice(base))) for i in range(40)]
    amfs = [(rnd.choice(["d", "e"]), f"a{i % 9}", near(rnd.choice(base))) for i in range(40)]
    got = {(r.k, r.path): (r.pairs, r.matches) for r in colour.agreement(
        spark.createDataFrame(cdls, "k string, path string, v array<double>"),
        spark.createDataFrame(amfs, "k string, path string, v array<double>"), ["k"]).collect()}
    for k, p, v in cdls:
        mine = [(a, w) for kk, a, w in amfs if kk == k]
        hit = {a for a, w in mine if all(abs(x - y) <= 1e-5 for x, y in zip(v, w))}
        assert got[(k, p)] == (len({a for a, _ in mine}), len(hit))


def test_remap_ties_and_single_candidate(spark):
    old = spark.createDataFrame([("/prod/a/x.mov",), ("C:\\z\\y.mov",), ("only.mov",), ("gone.mov",), ("",)], "path string")
    inv = [("b/x.mov", 0), ("a/x.mov", 1), ("q/a/x.mov", 2), ("u/y.mov", 3), ("w/y.mov", 4), ("deep/only.mov", 5)]
    out = {r.path: r.new_path for r in matching.remap_paths(old, spark.createDataFrame(inv, "path string, ix long")).collect()}
    assert out == {"/prod/a/x.mov": "a/x.mov", "C:\\z\\y.mov": "u/y.mov", "only.mov": "deep/only.mov", "gone.mov": "gone.mov"}


def test_collisions_do_not_depend_on_order(spark):
    rows = [("s", "md5", "aaaaaaaaa1", 1), ("s", "md5", "aaaaaaaaa1", 2), ("s", "md5", "bbbbbbbbb2", 3), ("t", "md5", "c" * 10, 4)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "stem string, alg string, value string, arrival long")
        out = {(r.stem, r.name): (r.outcome, r.copies) for r in ingest.resolve_collisions(df).collect()}
        assert out == {
            ("s", "s.aaaaaaaa.omc.json"): ("conflict", 2), ("s", "s.bbbbbbbb.omc.json"): ("conflict", 1), ("t", "t.omc.json"): ("write", 1)
        }


def test_summary_and_tint(spark):
    df = spark.createDataFrame([("fail", 0), ("warn", 0), ("pass", 2), ("pass", 0), (None, 0)], "s string, q int")
    assert [r[0] for r in df.select(rollup.tint(F.col("s"), F.col("q"))).collect()] == ["red", "amber", "amber", "green", "grey"]


def test_plans_have_no_nested_loops_or_products(spark):
    import __spark_entry__ as entry

    for name in ("j13_path_remap", "j11_trust_manifest", "j04_nearest_manifest", "j12_colour_agreement", "p19_name_scores", "w03_chain_breaks"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
