import collections

import pytest

from packaudit.llm import mixture


def files_of(package_files, sizes):
    return package_files([(f"{s}/f{i}.md", f"text {i}") for s, n in sizes.items() for i in range(n)])


def test_shares_follow_the_targets(spark, package_files):
    files = files_of(package_files, {"big": 3000, "mid": 900, "low": 300, "off": 50})
    targets = spark.createDataFrame([("big", 1.0), ("mid", 1.0), ("low", 2.0), ("gone", 5.0), ("off", 0.0)], "source string, weight double").where("source != 'gone'")
    out = mixture.mix(files, targets).collect()
    n = collections.Counter(r["skill_id"] for r in out)
    assert "off" not in n and abs(len(out) - 4250) < 250
    assert all(abs(n[s] / len(out) - w) < 0.03 for s, w in {"big": 0.25, "mid": 0.25, "low": 0.5}.items())
    again = mixture.mix(files.repartition(7), targets).collect()
    assert sorted((r["path"], r["copy"]) for r in again) == sorted((r["path"], r["copy"]) for r in out)
    copies = collections.Counter(r["path"] for r in out)
    times = collections.Counter(copies[f"low/f{i}.md"] for i in range(300))  # mean 4250 / 2 / 300
    mean = sum(k * v for k, v in times.items()) / 300
    spread = sum((k - mean) ** 2 * v for k, v in times.items()) / 300
    assert 6 < mean < 8 and 0.75 < spread / mean < 1.3


@pytest.mark.parametrize("rate", [0.01, 1.0, 40.0, 2000.0])
def test_cdf_is_poisson(spark, package_files, rate):
    files = files_of(package_files, {"a": 100, "b": 100})
    targets = spark.createDataFrame([("a", rate), ("b", 0.0)], "source string, weight double")
    row = mixture.repetition_rates(files, targets, "skill_id", scale=rate / 2).where("source = 'a'").first()
    assert row["rate"] == pytest.approx(rate)
    cdf = row["cdf"]
    p = [b - a for a, b in zip([0.0, *cdf], cdf)]
    assert cdf[-1] == pytest.approx(1, abs=1e-9)
    assert sum(k * x for k, x in enumerate(p)) == pytest.approx(rate, rel=1e-6)
    assert sum(k * k * x for k, x in enumerate(p)) - rate ** 2 == pytest.approx(rate, rel=1e-4)


def test_hard_rows(spark, package_files, hard_rows):
    files = package_files(hard_rows).withColumnRenamed("ext", "mix_key")
    targets = mixture.tempered(files, "skill_id")
    out = mixture.mix(files, targets, scale=20.0)
    rows = out.collect()
    assert set(out.columns) == {*files.columns, "copy", "mix_key"} and all(r["mix_key"] != ".md" for r in rows)
    n = collections.Counter((r["path"], r["content"]) for r in rows)
    assert set(n) == set(hard_rows) and n[("p/a.md", hard_rows[0][1])] % 2 == 0
    nothing = spark.createDataFrame([], "source string, weight double")
    assert mixture.mix(files, nothing).count() == mixture.mix(files.limit(0), targets).count() == 0
    null_source = files.withColumn("skill_id", files["skill_id"].substr(1, 0)).selectExpr("* except(skill_id)", "cast(null as string) as skill_id")
    assert mixture.mix(null_source, mixture.tempered(null_source, "skill_id"), scale=30.0).count() > 100
