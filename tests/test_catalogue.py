"""Named queries against their SQL in DuckDB, and those without SQL against plain definitions."""

import random

import duckdb
import pytest
from test_kernels import walked

from ringseq.functions import kernels
from ringseq.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "orders", "part", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, found):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_as_in_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def test_documents_without_sql(spark, tmp_path):
    letters = "".join(random.Random(1).choices("ACGTUNacgtun  xyz,.\n", k=6000))  # long ones, whole
    texts = [letters, letters[2500:] + letters[:2500], letters[:4001], letters[:3000] + letters[:200], "ACGTTGCA" * 5, "TGCAACGT" * 5, "acguugca" * 5, "GATTACA and cat", None, "", "xyz", "ATGCCCTAA" * 12]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(texts) == 12
    letters = [None if t is None else "".join(c for c in t if c in "ACGTUNacgtun") for t in texts]
    norm = [None if s is None else "".join({"a": "A", "c": "C", "g": "G", "t": "T", "u": "T", "U": "T"}.get(c, c if c in "ACGT" else "N") for c in s) for s in letters]
    naive = lambda s: min(s[i:] + s[:i] for i in range(len(s))) if s else s
    canon = [None if s is None else min(naive(s), naive(kernels.revcomp(s.encode()).decode())) for s in norm]
    assert {r["head"]: r["seq"] for r in run("canonicalize_documents")} == {f"d{i} en": c for i, c in enumerate(canon)}
    first = {c: i for i, c in reversed(list(enumerate(canon)))}
    assert {r["head"]: r["seq"] for r in run("uniq_documents")} == {f"d{i} en": letters[i] for i in first.values()}
    assert {r["head"]: r["seq"] for r in run("uniq_canonical_documents")} == {f"d{i} en": c for c, i in first.items()}
    assert sorted(map(tuple, run("uniq_table_documents"))) == sorted((f"d{first[c]}", f"d{i}") for i, c in enumerate(canon) if first[c] != i)
    ends = {r["id"]: (r["original_length"], r["monomer_length"]) for r in run("monomerize_documents")}
    for i, s in enumerate(norm):
        if s is not None:
            end = kernels.Monomerizer(10, 1).end(s.encode()) if len(s) >= 10 else None
            assert ends[f"d{i} en"] == (len(s), len(s) if end is None else end)
    want = []
    for i, s in enumerate(norm):
        for back in (False, True) if s else ():
            seq, best = kernels.revcomp(s.encode()).decode() if back else s, {}
            for start, stop, wraps, length in walked(seq, ("ATG",), ("TAA", "TAG", "TGA")):
                if stop >= 0 and length - 3 >= 30:
                    best[stop] = max(best.get(stop, (0,)), (length, start % 3, start, wraps))
            turned = lambda x: len(seq) - 1 - x if back else x  # noqa: B023, E731
            want += [(f"d{i} en_{'RC_' * back}ORF{start}", f"d{i} en", turned(start), turned(stop), length - 3, wraps, length / len(seq)) for stop, (length, _, start, wraps) in best.items()]
    assert sorted(map(tuple, run("orfs_documents"))) == sorted(want) and len(want) > 20
