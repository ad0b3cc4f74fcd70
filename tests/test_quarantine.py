"""Bad rows of the claims files are set apart, and none is lost."""

import pytest
from pyspark.sql import functions as F

from claimscope.operators import dictionary
from claimscope.plans.build import build_from_files
from claimscope.schema import SOURCE_COLUMNS
from claimscope.sources import quarantine as Q
from claimscope.sources import tables as T

HEADER = ",".join(src for src, _ in SOURCE_COLUMNS)
GOOD = ["B1,S1,T1019,2018-01,1,2,3.50", ",S1,,2018-02,,2,", '"B ""x"", y",S1,T1019,2018-01,1,2,-0.5', "B1,S1,T1019,2018-01,1,2,3.500"]
BAD = {"B1,S1": Q.FIELDS, "B1,S1,T1019,2018-01,1,2,3.50,more": Q.FIELDS,
       "B1,S1,T1019,2018-01,one,2,3.50": f"TOTAL_PATIENTS: {Q.NUMBER}", "B1,S1,T1019,2018-01,1,2.5,3.50": f"TOTAL_CLAIM_LINES: {Q.NUMBER}",
       "B1,S1,T1019,2018-01,1,2,$3": f"TOTAL_PAID: {Q.NUMBER}", "B1,S1,T1019,2018-01,1,2,12345678901234567890.00": f"TOTAL_PAID: {Q.NUMBER}",
       "B1,S1,T1019,2018-01,1,2,3.505": f"TOTAL_PAID: {Q.DECIMALS}", "B1,S1,T1019,2018-01,99999999999999999999,2,1": f"TOTAL_PATIENTS: {Q.NUMBER}"}


@pytest.fixture
def claims(tmp_path):
    folder = tmp_path / "claims"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, *GOOD, *list(BAD)[:4]]) + "\n")
    (folder / "b.csv").write_text("\n".join([HEADER, *list(BAD)[4:], GOOD[0]]) + "\n")
    (folder / "c.csv").write_text(HEADER + "\n")
    return str(folder)


def test_good_and_rejected_are_all_rows(spark, claims, tmp_path):
    out = str(tmp_path / "landed")
    assert Q.land_claims(spark, claims, out) and not Q.land_claims(spark, claims, out)
    good, bad = Q.accepted_claims(spark, out).collect(), Q.rejected_claims(spark, out).collect()
    assert {r.record: r.reason for r in bad} == BAD and len(bad) == len(BAD) and len(good) == len(GOOD) + 1
    assert {r.file.rsplit("/", 1)[-1] for r in bad if r.reason == Q.FIELDS} == {"a.csv"}
    # as the reader that fails reads them
    only = tmp_path / "good.csv"
    only.write_text("\n".join([HEADER, *GOOD, GOOD[0]]) + "\n")
    want = T.read_claims_csv(spark, str(only))
    assert Q.accepted_claims(spark, out).dtypes == want.dtypes
    assert sorted(map(tuple, good), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rounding_takes_a_third_decimal(spark, claims, tmp_path):
    out = str(tmp_path / "landed")
    Q.land_claims(spark, claims, out, rounding="round")
    assert not Q.rejected_claims(spark, out).where(F.col("reason").contains(Q.DECIMALS)).count()
    assert Q.accepted_claims(spark, out).where("paid = 3.51").count() == 1
    with pytest.raises(ValueError):
        Q.checked_claims(spark, claims, "up")


def test_build_goes_on_with_the_good_rows(spark, claims, tmp_path):
    registry = tmp_path / "registry.csv"
    registry.write_text(f"{T.REGISTRY_NPI},{T.REGISTRY_NAME},{T.REGISTRY_STATE}\nB1,One,ny\n")
    with pytest.raises(Exception):
        build_from_files(spark, claims, str(registry), str(tmp_path / "none"))
    build_from_files(spark, claims, str(registry), str(tmp_path / "root"), quarantine=str(tmp_path / "landed"))
    fact = T.read_fact(spark, str(tmp_path / "root"))
    assert fact.count() == len(GOOD) + 1 and fact.where("billing_state = 'NY'").count() == 3
    assert Q.rejected_claims(spark, str(tmp_path / "landed")).count() == len(BAD)


def test_another_header_fails(spark, claims, tmp_path):
    (tmp_path / "claims" / "d.csv").write_text("A,B,C,D,E,F,G\n1,2,3,4,5,6,7\n")
    with pytest.raises(Exception):
        Q.land_claims(spark, claims, str(tmp_path / "landed"))


def test_new_keys_follow(spark):
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    first = dictionary.new_keys(None, keys("m", "c", None, "m"), "k")
    assert dict(first.collect()) == {"c": 0, "m": 1}
    second = dictionary.new_keys(first, keys("z", "a", "c", None, "a"), "k")
    assert dict(second.collect()) == {"a": 2, "z": 3}
    assert dictionary.new_keys(first.unionByName(second), keys("a", None), "k").count() == 0
    assert dict(dictionary.new_keys(first.limit(0), keys("b"), "k").collect()) == {"b": 0}
    view = dictionary.sorted_view(first.unionByName(second), "k").orderBy("position").collect()
    assert [tuple(r) for r in view] == [("a", 2, 0), ("c", 0, 1), ("m", 1, 2), ("z", 3, 3)]
