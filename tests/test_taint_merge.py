"""Labels of steps that read several earlier steps, against a walk in plain code."""

import random

import pytest

from packaudit.functions import fixed
from packaudit.operators import taint

STEP = "skill_id string, step_index int, step_id string, input_refs array<string>, output_name string"


@pytest.mark.parametrize("seed", range(3))
def test_all_upstream_labels_arrive(spark, seed):
    rng, rows, seeds, blocked = random.Random(seed), [], [], []
    for skill in ("p", "q"):
        for i in range(1, 40):
            refs = [f"S{rng.randrange(1, i)}.out" for _ in range(rng.choice([0, 0, 1, 2, 3]))] if i > 1 else []
            rows.append((skill, i, f"S{i}", refs, rng.choice(["", "out"])))
            if rng.random() < 0.2:
                seeds.append((skill, i, rng.choice(fixed.TAINT_LABELS)))
            if rng.random() < 0.15:
                blocked.append((skill, i))
    want = {}
    for skill, i, _, refs, _ in rows:
        before = next((r for r in rows if r[0] == skill and r[1] == i - 1), None)
        ups = {int(r[1:].split(".")[0]) for r in refs} or ({i - 1} if before and before[4] else set())
        own = {label for s, j, label in seeds if (s, j) == (skill, i)}
        want[skill, i] = own.union(*(want[skill, u] for u in ups)) if (skill, i) not in blocked else set()
    got = taint.taint_map(spark.createDataFrame(rows, STEP), spark.createDataFrame(seeds, "skill_id string, step_index int, label string"),
                          spark.createDataFrame(blocked, "skill_id string, step_index int"))
    assert {(r.skill_id, r.step_index): set(r.labels) for r in got.collect()} == want
