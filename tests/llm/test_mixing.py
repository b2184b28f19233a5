import numpy as np
import pytest

from mlwatch.llm import mixing


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 3, "b": 1}, {"a": 5, "b": 3, "c": 2, "d": 7}, {str(i): 1 + i % 4 for i in range(30)}])
def test_a_period_meets_every_deadline_and_keeps_each_source_within_a_block(parts):
    slots, total, done = mixing.period(parts), sum(parts.values()), dict.fromkeys(parts, 0)
    assert len(slots) == total
    for t, name in enumerate(slots):
        j = done[name]
        assert j * total // parts[name] <= t < -(-(j + 1) * total // parts[name])
        done[name] += 1
        assert all(abs(done[n] - (t + 1) * parts[n] / total) < 1 for n in parts)
    assert done == parts


def plain_schedule(blocks, parts):
    """Slot by slot: earliest deadline first among released blocks; phases begin anew when a source ends."""
    left, out, at, done = dict(blocks), [], 0, dict.fromkeys(blocks, 0)
    while any(left.values()):
        here = {n: parts[n] for n in left if left[n]}
        total, j, t = sum(here.values()), dict.fromkeys(here, 0), 0
        while all(left[n] for n in here):
            ready = [n for n in here if j[n] * total // here[n] <= t]
            name = min(ready, key=lambda n: (-(-(j[n] + 1) * total // here[n]), -here[n], n))
            out.append((name, done[name], at + t))
            j[name], done[name], left[name], t = j[name] + 1, done[name] + 1, left[name] - 1, t + 1
        at += t
    return out


@pytest.mark.parametrize("seed", range(6))
def test_the_schedule_equals_a_slot_by_slot_simulation(seed):
    rng = np.random.default_rng(seed)
    names = [f"s{i}" for i in range(rng.integers(1, 7))]
    blocks = {n: int(rng.integers(0, 60)) for n in names}
    parts = {n: int(rng.integers(1, 9)) for n in names}
    found = []
    for name, _, share, period, first, end, at, places in mixing.schedule(blocks, parts):
        found += [(name, first + j, at + j // share * period + places[j % share]) for j in range(end - first)]
    assert sorted(found) == sorted(plain_schedule(blocks, parts))


def test_every_row_has_a_place_of_its_own(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else None, i) for i in range(900)] + [(7, "again", "big", 1), (7, "again", "big", 1), (None, "x", "small", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __slot int")
    out = mixing.mix(docs, {"big": 3, None: 1}, block_rows=8, stretches=16).toPandas()
    assert len(out) == len(rows) and out.__position.nunique() == len(rows)
    assert sorted(map(str, out.text)) == sorted(r[1] for r in rows)
    blocks = out.groupby([out.source.fillna("-"), "__block"]).agg(slots=("__slot", "nunique"), rows=("__slot", "size"))
    assert (blocks.slots == 1).all() and blocks.rows.max() == 8
    first = out.drop_duplicates("__slot").sort_values("__slot")[:40].source.fillna("-").value_counts()
    assert abs(first["big"] - 40 * 3 / 4) < 2 and (out.__release <= out.__deadline).all()


def test_mixed_order_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, "t", f"s{i % 4}") for i in range(100)], "doc_id long, text string, source string")
    out = mixing.in_mixed_order(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(100))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


@pytest.mark.parametrize(
    "weights",
    [
        {"a": 0.33349, "b": 0.0002, "c": 0.4, "d": 0.26631},
        {f"s{i}": (1 + i) ** 0.5 for i in range(40)},
        {"hot": 0.9, **{f"small{i}": 0.0001 for i in range(1000)}},
    ],
)
def test_100000_slots_stay_within_a_block_of_the_given_weights(weights):
    total = sum(weights.values())
    share = {n: w / total for n, w in weights.items()}
    done = dict.fromkeys(weights, 0)
    for t, (name, block, release, deadline, slot) in enumerate(mixing.slots(dict.fromkeys(weights, 10**6), mixing.exact_parts(weights))):
        assert slot == t and block == done[name] and release <= t < deadline
        assert abs(done[name] - share[name] * t) < 1 + 1e-9
        done[name] += 1
        assert abs(done[name] - share[name] * (t + 1)) < 1 + 1e-9
        if t % 997 == 0 or t == 99_999:
            assert all(abs(done[n] - share[n] * (t + 1)) < 1 + 1e-9 for n in share)
        if t == 99_999:
            break


@pytest.mark.parametrize("seed", range(4))
def test_slots_equal_the_simulation_and_sources_without_weight_come_last(seed):
    rng = np.random.default_rng(seed)
    blocks = {f"s{i}": int(rng.integers(0, 60)) for i in range(5)}
    parts = {n: int(rng.integers(1, 9)) for n in blocks}
    found = [(n, j, s) for n, j, _, _, s in mixing.slots(blocks, parts)]
    assert found == plain_schedule(blocks, parts)
    late = [n for n, *_ in mixing.slots(blocks | {"none": 3}, parts | {"none": 0})]
    assert late[-3:] == ["none"] * 3 and len(late) == len(found) + 3


def test_the_table_follows_uneven_weights(spark):
    rows = [(i, "rare" if i % 10 == 0 else "big") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix(docs, {"big": 0.9998, "rare": 0.0002}, block_rows=1, stretches=8).toPandas()
    out = out.sort_values("__slot")
    assert (out.__slot == np.arange(5000)).all() and (out.__position == out.__slot).all()
    ahead = (out.source == "rare").cumsum().to_numpy()[:4400]
    assert (abs(ahead - 0.0002 * np.arange(1, 4401)) < 1).all()


def test_no_weights_named_are_equal_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(256)], "doc_id long, source string")
    slots = {(r.source, r["__slot"]) for r in mixing.mix(docs, {}).collect()}
    assert sorted(slots, key=lambda x: x[1]) == sorted(
        {(r.source, r["__slot"]) for r in mixing.mix(docs, {"a": 1, "b": 1}).collect()}, key=lambda x: x[1]
    )
    assert len(slots) == 4
