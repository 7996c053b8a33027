import random
from collections import Counter

import pytest

from hushframe.functions.generalizers import Aggregation, Categories, NoneGeneralizer, Reduction
from hushframe.functions.hierarchy import Hierarchy
from hushframe.operators.batch import Shard
from hushframe.operators.kernel import Kernel, greedy_rounds
from hushframe.rules import AnonymizerConfig, Rule, RuleSet

COLS = ("subject", "q1", "q2", "s")


def run(rows, rules, **options):
    shard = Shard(AnonymizerConfig(**({"subject": "subject", "beta": 50, "zeta": 10, "mu": 10} | options)), RuleSet.of(COLS, *rules), list(COLS))
    out = []
    for r in rows:
        out += shard.take(r)
        assert len(shard.kernel.held) <= shard.config.delta and len(shard.kernel.gamma) <= max(shard.config.beta, 1)
    return out, shard


def agg(lo, hi):
    return Aggregation(lo, hi, "float")


def pair(v):
    return (v["lo"], v["hi"])


NONE = [Rule(c, NoneGeneralizer()) for c in COLS]


def test_no_rules_that_generalize():
    out, _ = run([(i, 10, 20, 30) for i in range(11)], NONE, k=4, l=0, delta=10)
    assert len(out) == 11


def test_first_groups():
    rows = [(i, i, 133.7, 10 + i) for i in range(15)]
    out, _ = run(rows, [Rule("q1", agg(0, 100)), Rule("q2", agg(1000, 2000)), Rule("s", NoneGeneralizer(), sensitive=True)], k=4, l=2, delta=10)
    assert len(out) == 8
    assert [pair(r[1]) for r in out] == [(0, 3)] * 4 + [(4, 7)] * 4
    assert all(pair(r[2]) == (133.7, 133.7) for r in out)


@pytest.mark.parametrize("first", [[], [Rule("subject", NoneGeneralizer())]])
def test_one_subject_is_suppressed(first):
    rows = [(0, j, 10 + j, 10 + j) for j in range(20)]
    out, _ = run(rows, [*first, Rule("q1", agg(0, 20)), Rule("q2", agg(0, 30)), Rule("s", NoneGeneralizer(), sensitive=True)], k=4, l=2, delta=10, suppress=2)
    assert len(out) == 10 and {r[4] for r in out} == {"suppressed"}


def test_equal_rows_of_many_subjects():
    rows = [(j, 20, 20, j) for j in range(20)]
    out, _ = run(rows, [Rule("q1", agg(0, 20)), Rule("q2", agg(0, 30)), Rule("s", NoneGeneralizer(), sensitive=True)], k=4, l=2, delta=10, suppress=0)
    assert len(out) == 12


SUPPRESSED = [Rule("subject", NoneGeneralizer()), Rule("q1", agg(0, 20)), Rule("q2", NoneGeneralizer()), Rule("s", NoneGeneralizer(), sensitive=True)]
ROWS = [(0, 10, 10, 1337), (1, 10, 10, 1338), *((0, j, 10 + j, 1337) for j in range(20))]


@pytest.mark.parametrize("strategy", [-1, 3])
def test_unknown_strategy_gives_blank_rows(strategy):
    out, _ = run(ROWS, SUPPRESSED, k=2, l=2, delta=2, suppress=strategy)
    assert len(out) == 20 and all(r[:4] == (None,) * 4 for r in out[2:])


def test_strategies():
    assert len(run(ROWS, SUPPRESSED, k=2, l=2, delta=2, suppress=0)[0]) == 2
    nulls = [*SUPPRESSED[:2], Rule("q2", agg(0, 30)), SUPPRESSED[3]]
    out, _ = run(ROWS, nulls, k=2, l=2, delta=2, suppress=1)
    assert len(out) == 20 and all(r[:4] == (0, None, None, 1337) for r in out[2:])
    most = [SUPPRESSED[0], Rule("q1", agg(-10, 20)), SUPPRESSED[3]]
    rows = [(1, *ROWS[0][1:]), (2, *ROWS[1][1:]), *ROWS[2:]]
    out, _ = run(rows, most, k=2, l=2, delta=2, suppress=2)
    assert len(out) == 20 and all((r[0], pair(r[1]), r[2], r[3]) == (0, (-10, 20), "*", 1337) for r in out[2:])


@pytest.mark.parametrize("second", [False, True])
@pytest.mark.parametrize("l", [0, 1, 2, 3])
@pytest.mark.parametrize("k", [0, 1, 2, 5, 20])
def test_grid_of_invariants(k, l, second):
    for beta, subjects, each in ((1, 5, 20), (5, 50, 4), (50, 10, 30)):
        r = random.Random(1337)
        rows = [(i, i2, i + i2, r.randrange(i + i2 + 1)) for i2 in range(each) for i in range(subjects)]
        r.shuffle(rows)
        rules = [Rule("subject", NoneGeneralizer()), Rule("q1", agg(0, 500)), Rule("q2", agg(0, 500), sensitive=second), Rule("s", NoneGeneralizer(), sensitive=True)]
        config = AnonymizerConfig("subject", k=k, l=l, delta=20, beta=beta, zeta=50, suppress=2, flush="release", seed=beta)
        shard = Shard(config, RuleSet.of(COLS, *rules), list(COLS))
        released = []
        for row in rows:
            got = shard.take(row)
            released += got
        released += shard.finish()
        assert len(released) == len(rows) and not shard.kernel.held
        counts = Counter((pair(x[1]), pair(x[2])) for x in released if x[4] not in ("suppressed", "reused"))
        assert all(n >= k for n in counts.values())


def test_released_groups_hold_k_and_l_and_cover():
    r = random.Random(3)
    rules = RuleSet.of(COLS, Rule("subject", NoneGeneralizer()), Rule("q1", agg(0, 10)), Rule("q2", Reduction()), Rule("s", NoneGeneralizer(), sensitive=True))
    config = AnonymizerConfig("subject", k=4, l=2, delta=30, beta=8, flush="release")
    kernel = Kernel(config, rules)
    out = []
    for i in range(600):
        before = set(kernel.held)
        got = kernel.process(kernel.row(i, r.randrange(60), [r.uniform(-5, 30), f"{r.randrange(1000):04d}"], [r.randrange(4)]))
        groups = {}
        for x in got:
            assert x.row.id in before | {i}
            if x.status in ("cluster", "split", "merged"):
                groups.setdefault(str(x.values), []).append(x.row)
            if x.status != "suppressed":
                assert all(g.generalizer.covers(v, w) for g, v, w in zip(rules.quasi_identifiers, x.values, x.row.values, strict=True))
            assert 0 <= x.loss <= 1
        for rows in groups.values():
            assert len({x.subject for x in rows}) >= 4 and len({x.sensitive for x in rows}) >= 2
        assert len(kernel.omega) <= config.zeta
        out += got
    out += kernel.finish()
    assert sorted(x.row.id for x in out) == list(range(600))


def test_same_seed_same_output():
    r = random.Random(5)
    rows = [(r.randrange(40), r.random() * 100, r.random() * 100, r.randrange(5)) for _ in range(400)]
    rules = [Rule("subject", NoneGeneralizer()), Rule("q1", agg(0, 100)), Rule("q2", agg(0, 100)), Rule("s", NoneGeneralizer(), sensitive=True)]
    assert run(rows, rules, k=3, l=2, delta=20, seed=1)[0] == run(rows, rules, k=3, l=2, delta=20, seed=1)[0]


def test_config_without_sensitive_column_is_refused():
    with pytest.raises(ValueError, match="sensitive"):
        run([], NONE, l=2)


def test_rules():
    rules = RuleSet.of(COLS, Rule("q2", None), Rule(1, agg(0, 1), weight=-3))
    assert [(r.column, type(r.generalizer).__name__, r.weight) for r in rules.rules] == [("subject", "Reduction", 0), ("q1", "Aggregation", 0), ("q2", "Reduction", 0)]
    with pytest.raises(ValueError, match="no column"):
        rules.upsert(Rule("x", Reduction()))


def test_greedy_rounds():
    assert [(p, v) for p, v, _ in greedy_rounds([("a", 1), ("a", 2), ("b", 2), ("c", 3)])] == [(0, "a"), (0, "b"), (0, "c")]
    assert len(greedy_rounds([("a", 1), ("b", 1), ("c", 1)])) == 1


def losses(g, *values):
    s = None
    for v in values:
        s = g.add(s, g.prepare(v))
    return g.value(s), float(g.losses([s], g.state())[0])


def test_reduction_values():
    g = Reduction()
    assert losses(g, "123456") == ("123456", 0)
    assert losses(g, 123456.0) == ("123456.0", 0)
    assert losses(g, 123456, 123567, 123678) == ("123***", 0.5)
    assert losses(g, 123456.0, 123567.0, 123678.0) == ("123*****", 0.625)
    assert losses(g, 123, 1234, 123456789) == ("*" * 9, 1)
    assert losses(g, 123456, 654321) == ("*" * 6, 1)
    assert losses(g, 123456, 123678, 129678)[0] == "12****"
    assert g.max_value(None) == "*" and losses(g, None) == (None, 0) and losses(Reduction("#"), "ab", "ac")[0] == "a#"


def test_category_values():
    g = Categories(Hierarchy([["Node 1-3", f"Leave{i}"] for i in (1, 2, 3)] + [["Node 4-6", f"Leave{i}"] for i in (4, 5, 6)]))
    assert losses(g, "Leave3") == ("Leave3", 0)
    assert losses(g, "Leave3", "Leave3", "Leave1")[0] == "Node 1-3" and abs(losses(g, "Leave3", "Leave1")[1] - 0.4) < 1e-6
    assert losses(g, "Leave3", "Leave1", "Leave6") == ("<ROOT>", 1)
    assert losses(g, ["Node 1-3", "Leave1"], ["Node 1-3", "Leave2.5"]) == ("Node 1-3", 0.5)
    tree = Categories(Hierarchy([["Round", "Ball"], ["Round", "Cylinder"], ["NotRound", "Cube"]]))
    assert losses(tree, "Ball", "Cylinder") == ("Round", 0.5) and losses(tree, "Ball", "Cylinder", "Cube") == ("<ROOT>", 1)


def test_range_values():
    g = Aggregation(0, 100, "float")
    assert [losses(g, *v) for v in ([50], [50, 25], [50, 25, 0], [50, 25, 0, 100])] == [((50, 50), 0), ((25, 50), 0.25), ((0, 50), 0.5), ((0, 100), 1)]
    state = g.state()
    assert g.widen((-100, 1000), state) and state == [-100, 1000]
    assert losses(Aggregation(1, 1), 1, 2)[1] == 1


def test_suppressed_rows_after_a_change_of_rules():
    first = [Rule("subject", NoneGeneralizer()), Rule("q1", agg(0, 10)), Rule("q2", agg(0, 20)), Rule("s", NoneGeneralizer())]
    later = [Rule("subject", NoneGeneralizer()), Rule("q1", NoneGeneralizer()), Rule("q2", agg(0, 99)), Rule("s", agg(0, 7))]
    shard = Shard(AnonymizerConfig("subject", k=9, l=0, delta=3, beta=50, zeta=10, mu=10), RuleSet.of(COLS, *first), list(COLS))
    out = [x for i in range(3) for x in shard.take((i, 1, 2, 3))]
    shard.set_rules(RuleSet.of(COLS, *later))
    out += [x for i in range(3, 9) for x in shard.take((i, 1, 2, 3))]
    assert [(x[-1], x[1], x[2], x[3]) for x in out[:3]] == [("suppressed", {"lo": 0, "hi": 10}, {"lo": 0, "hi": 20}, 3)] * 3
    assert [(x[-1], x[1], x[2], x[3]) for x in out[3:]] == [("suppressed", 1, {"lo": 0, "hi": 99}, {"lo": 0, "hi": 7})] * (len(out) - 3) and len(out) > 3
    assert shard.kernel.metrics()["suppressed_rows"] == len(out) and shard.kernel.metrics()["rule_sets"] == 2


def test_domains_are_widened_only_if_asked_for():
    rules = [Rule("subject", NoneGeneralizer()), Rule("q1", agg(0, 10)), Rule("q2", agg(0, 20)), Rule("s", NoneGeneralizer())]
    rows = [(i, 5 * i, 2, 3) for i in range(9)]
    for widen, hi in ((False, 10), (True, 15)):
        out, _ = run(rows, rules, k=9, l=0, delta=3, beta=1, widen=widen)
        assert {x[-1] for x in out} == {"suppressed"} and pair(out[0][1]) == (0, hi)
