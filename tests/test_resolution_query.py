"""Entity resolution of whole names against a brute-force version."""

import pandas as pd

from leadflow.plans.catalogue import QUERIES

#: Keys 1455 apart share a site; names differ by a letter, by word order, after the 14th letter, or not at all.
PARTS = {
    1: ("A", "almond antique azure"), 2: ("A", "almond antique azures"), 3: ("A", "almond antique blush frosted"), 4: ("A", "almond antique chiffon lavender steel"), 5: ("A", "azure almond antique"), 6: ("B", "almond antique azure"),
    7: ("A", "ivory khaki lace"), 8: ("A", "ivory khaki lace"), 1462: ("A", "zz unlike"), 1463: ("B", "other words"), 9: ("A", "almond antique blush frosteds"), 10: ("A", "almond antique plum"), 11: ("B", "snow"), 12: ("B", "tnow"), 1600: ("B", "without company"),
}


def _ratio(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200 * row[-1] / (len(a) + len(b))


def _small_blocks_next(city):
    """First letters of a city that meet the next one: those of fewer than five rows."""
    letters = sorted({n[0] for c, n in PARTS.values() if c == city})
    few = lambda x: sum(c == city and n[0] == x for c, n in PARTS.values()) < 5
    return {(x, y) for x, y in zip(letters, letters[1:]) if few(x)}


def _brute_force():
    root = {k: k for k in PARTS}

    def find(x):
        return x if root[x] == x else find(root[x])

    site = lambda k: (k % 97, {0: "com", 1: "net"}.get(k % 5, "ru")) if k % 4 and k in CUSTOMERS else None
    for a, (city, x) in PARTS.items():
        for b, (other, y) in PARTS.items():
            if a < b and city == other:
                near = x[0] == y[0] or {(x[0], y[0]), (y[0], x[0])} & _small_blocks_next(city)
                if (site(a) is not None and site(a) == site(b)) or (near and _ratio(x, y) >= 88):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {k: find(k) for k in PARTS}


CUSTOMERS = [k for k in PARTS if k != 1600]


def test_resolved_entities_compares_whole_names(spark, tmp_path):
    tables = {
        "part": {"p_partkey": list(PARTS), "p_brand": [c for c, _ in PARTS.values()], "p_name": [n for _, n in PARTS.values()]},
        "customer": {"c_custkey": CUSTOMERS, "c_name": [f"Customer#{k:09d}" for k in CUSTOMERS], "c_nationkey": [0 for _ in CUSTOMERS], "c_mktsegment": ["M" for _ in CUSTOMERS], "c_acctbal": [1.0 for _ in CUSTOMERS]},
        "nation": {"n_nationkey": [0], "n_name": ["N"], "n_regionkey": [0]}, "region": {"r_regionkey": [0], "r_name": ["R"]},
    }
    for name, columns in tables.items():
        pd.DataFrame(columns).to_parquet(tmp_path / f"{name}.parquet")
    got = {r.id: r.cluster for r in QUERIES["resolved_entities"](spark, str(tmp_path)).collect()}
    want = _brute_force()
    assert got == want
    assert want[2] == want[5] == 1 and want[1462] == 7 and len({want[k] for k in (1, 3, 4, 6, 10)}) == 5
