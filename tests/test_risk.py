"""All rules of module_risks over tables, against a count by hand of the same rules."""

import datetime as dt
import random

from sparklode.plans.code import module_risk, module_risks

T = dt.datetime(2025, 1, 1)


def test_cycles_and_kinds_count(spark, tmp_path):
    rng = random.Random(5)
    kinds = {"source": "a.py", "docs": "a.md", "config": "a.json", "test": "test_a.py"}
    modules = {f"m{k}": rng.choice([["source"], ["docs"], ["config"], ["source", "test"], ["source", "docs"]]) for k in range(30)}
    modules |= {"d1": ["docs"], "d2": ["docs"], "quiet": ["docs"]}  # d1 and d2 have no reason but their cycle
    locs = {m: rng.choice([10, 3000]) for m in modules} | {"d1": 1, "d2": 1, "quiet": 1}
    pairs = {(f"m{min(29, int(rng.paretovariate(0.7)))}", f"m{min(29, int(rng.paretovariate(0.6)))}") for _ in range(220)} | {("d1", "d2"), ("d2", "d1")}
    files = [(f"{m}/{kinds[k]}", m, locs[m], 1, "h", T) for m, ks in modules.items() for k in ks]
    links = [(f"i{n}", f"{a}/x.py", a, f"{b}/x.py", True, False) for n, (a, b) in enumerate(sorted(pairs))] + [(f"u{n}", "m3/x.py", "m3", None, False, False) for n in range(100)]
    spark.createDataFrame(files, "id string, moduleId string, loc long, bytes long, hash string, scannedAt timestamp_ntz").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame(links, "id string, fileId string, moduleId string, target string, resolved boolean, external boolean").write.parquet(f"{tmp_path}/imports.parquet")

    after = {m: {b for a, b in pairs if a == m and a != b} for m in modules}
    reach = {m: set(after[m]) for m in modules}
    for k in modules:
        for m in modules:
            if k in reach[m]:
                reach[m] |= reach[k]
    want = {}
    for m, ks in modules.items():
        fan = sum(m in after[a] for a in modules)
        mine = [x for x in links if x[2] == m]
        bad = sum(x[4] is False for x in mine)
        main = [k for k in ks if k != "test"]
        source = len(main) > 1 or main == ["source"]
        score = (3 if fan >= 10 else 2 if fan >= 5 else 0) + 3 * (m in reach[m]) + 2 * (bad >= 5 and bad / max(1, len(mine)) > 0.6) + ("test" not in ks and source) + (locs[m] > 2000)
        if score:
            want[m] = min(10, score)
    got = {r.id: r for r in module_risks(spark, str(tmp_path)).collect()}
    assert {m: r.score for m, r in got.items()} == want
    assert got["d1"].reasons == ["on a dependency cycle"] and "quiet" not in got
    assert "d1" in {r.id for r in module_risk(spark, str(tmp_path)).collect()}  # there every module counts as source
