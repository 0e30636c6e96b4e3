import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldpulse.functions import deletions
from fieldpulse.functions.deletions import Kind, rest_marks
from fieldpulse.functions.text import with_indel_ratio
from fieldpulse.operators import labels as R
from fieldpulse.plans.jobs import Store, label_upload
from fieldpulse.schemas import OBJECTS
from fieldpulse.sources import tables as T
from fieldpulse.sources.landing import cast_journal

CATALOG = [("n1", "ЦТП-52060", "Верхний Озёрск"), ("m1", "ЦТП-8", "Лесной"), ("k9", "ЦТП-417", "Озёрск"),
           ("k8", "ЦТП-8-2", "Озёрск"), ("k7", "ЦТП-8", "Озёрск")]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "object_id string, facility_name string, municipality string").cache()


def matched(spark, catalog, *asked):
    claims = spark.createDataFrame([(i, e, d) for i, (e, d) in enumerate(asked)],
                                   "id_cds_claim bigint, extracted string, name_mr string")
    rows = R.match_catalog(claims, catalog).orderBy("id_cds_claim").collect()
    return [(r["object_id"], r["score"]) for r in rows]


def test_numbers_match_inside_their_district(spark, catalog):
    assert matched(spark, catalog, ("цтп--417", "Озёрск"), ("ЦТП 8-2", "Озёрск г."), ("ЦТП-8", "Лесной г.о.")) == [
        ("k9", 100.0), ("k8", 100.0), ("m1", 100.0)]


def test_what_cannot_match(spark, catalog):
    asked = [(None, "Лесной"), ("ЦТП-345", "Озёрск"), ("ЦТП-417", "Лесной"), ("не найдено", "Озёрск"), ("", "Лесной")]
    assert matched(spark, catalog, *asked) == [(None, None)] * len(asked)


def test_a_district_without_plants_searches_everywhere(spark, catalog):
    # of equal scores the smallest id wins
    assert matched(spark, catalog, ("ЦТП-8", "Дальний"), ("ЦТП 8", "")) == [("k7", 100.0), ("k7", 100.0)]


def test_similar_number_in_a_place_that_contains_the_district(spark, catalog):
    (found, score), = matched(spark, catalog, ("ЦТП-5206", "Озёрск"))  # four of five digits: 200 * 4 / 9
    assert found == "n1" and score == pytest.approx(800 / 9)
    assert matched(spark, catalog.limit(0), ("ЦТП-5206", "Озёрск")) == [(None, None)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_similar_pairs_against_brute_force(spark):
    rnd = random.Random(11)

    def word(n):
        return "".join(rnd.choice("ab1-") for _ in range(n))

    def edited(text, edits):
        letters = list(text)
        for _ in range(edits):
            if letters and rnd.random() < 0.5:
                letters.pop(rnd.randrange(len(letters)))
            else:
                letters.insert(rnd.randrange(len(letters) + 1), rnd.choice("ab1-"))
        return "".join(letters)

    names = [word(rnd.randint(1, 26)) for _ in range(80)]
    queries = [edited(rnd.choice(names), rnd.randint(0, 7)) for _ in range(150)] + ["", "a"]
    expected = {}
    for q in set(queries):
        for n in set(names):
            score = 200 * lcs(q, n) / (len(q) + len(n))
            if q != n and score >= 85:
                expected[q, n] = pytest.approx(score)
    got = R.similar_pairs(spark.createDataFrame([(q,) for q in queries], "query string"),
                          spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert len(got) == len(expected) and {(r["query"], r["name"]): r["score"] for r in got} == expected


def test_known_lengths_leave_the_pairs_as_they_are(spark):
    names = ["1-2-3", "1-2-34", "1-2-345", "12", "1-2-3-4-5-6-7"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    asked = df.withColumnRenamed("name", "query")

    def pairs(**known):
        return sorted(map(tuple, R.similar_pairs(asked, df, 70, **known).collect()))

    assert pairs(longest=26) == pairs() and pairs(longest=26)
    short = df.where("length(name) < 7")  # 12 letters together: at most three edits
    assert (sorted(map(tuple, R.similar_pairs(asked.where("length(query) < 7"), short, 70, longest=12).collect()))
            == [r for r in pairs() if max(len(r[0]), len(r[1])) < 7])


def test_similar_pairs_broadcast_no_keys(spark):
    df = spark.range(60000).selectExpr("id * 7 || '-' || id AS name")
    pairs = R.similar_pairs(df.withColumnRenamed("name", "query").limit(1000), df)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_marks_without_a_partner_are_not_written(spark, monkeypatch):
    """Each side has some 200 000 rests; written are those that meet, however many parts the filters take."""
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice("0123456789") for _ in range(12)) + "é" * (i % 50 == 0) for i in range(1500)})
    queries = [n[:3] + n[4:] + "7" for n in names[:100]] + ["".join(rnd.choice("0123456789") for _ in range(12)) for _ in range(1500)]
    asked, df = (spark.createDataFrame([(x,) for x in c], "query string") for c in (queries, names))
    rests = {(a, b): (Kind(10 * a + b, 11 + a, 2), Kind(10 * a + b, 11 + b, 2 - a + b)) for a in (1, 2) for b in (1, 2)}
    written = []
    kept = deletions.cut_lineage
    monkeypatch.setattr(deletions, "cut_lineage", lambda rows: written.append(kept(rows)) or written[-1])

    def left(text, cut):
        return {"".join(c for i, c in enumerate(text) if i not in gone) for gone in combinations(range(len(text)), cut)}

    expected = set()
    by_rest = {}
    for n in names:
        for a in (1, 2):
            for rest in left(n, 1 - a + len(n) - 10):
                by_rest.setdefault((a, rest), set()).add(n)
    for q in set(queries):
        for rest in left(q, 2):
            expected |= {(q, n) for n in by_rest.get((len(q) - 11, rest), ())}
    for most in (deletions.MOST_MARKS, 30000):
        written.clear()
        parts = list(deletions.meetings(asked, df.toDF("name"), list(rests.values()), most))
        met = [tuple(r) for part in parts for r in part.collect()]
        assert len(met) == len(set(met)) and set(met) >= expected >= {(q, n) for q, n in zip(queries, names[:100]) if len(n) == 12}
        assert len(parts) > 3 or most > 30000
        marks = [w for w in written if "mark" in w.columns]
        assert marks and sum(w.count() for w in marks) < 40000


def test_scores_of_many_pairs_are_those_of_each(spark):
    rnd = random.Random(2)
    words = ["", "a", "ёж", "😀b"] + ["".join(rnd.choice("abё1") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, rnd.choice(words)) for a in words for _ in range(5)], "query string, name string")
    for r in with_indel_ratio(pairs).collect():
        total = len(r["query"]) + len(r["name"])
        assert r["score"] == (200.0 * lcs(r["query"], r["name"]) / total if total else 100.0)


def test_marks_are_those_of_the_rests():
    rests = {}
    for text in ("abca", "bcaé", "aaaa"):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)[None, :]
        for gone, mark in zip(combinations(range(4), 2), rest_marks(codes, Kind(3, 4, 2))[0].tolist()):
            rests.setdefault("".join(c for i, c in enumerate(text) if i not in gone), set()).add(mark)
    assert all(len(marks) == 1 for marks in rests.values())
    assert len(set.union(*rests.values())) == len(rests) > 8


JOURNAL = ("id_cds_claim string, name_mr string, text_message string, t_ov string, d_create string, d_doklad string, "
           "d_close string, obj_koteln string, obj_ctp string, obj_ts string")


def journal(spark, *rows):
    return spark.createDataFrame(list(rows), JOURNAL)


ROWS = [("1001", "Озёрск г.о.", "утечка на ЦТП-8", "5.5 ч", "2025-01-01", None, None, "0", "1", "0"),
        ("1002", "Озёрск г.о.", "утечка на ЦТП-345", "", "2025-01-02", None, "2025-01-03 10:00:00", "0", "1", "1"),
        ("2001", "Лесной", "котельная", None, "2025-01-03", None, None, "1", None, "0"),
        ("2002", "Лесной", "прочее", None, "2025-01-03", None, None, "0", "0", "0"),
        ("bad", "Лесной", "прочее", None, "2025-01-03", None, None, "0", "1", "0"),
        ("2003", "Лесной", None, None, "2025-01-03", None, None, "0", "1", "0")]


def test_journal_types_and_routing(spark):
    cast = cast_journal(journal(spark, *ROWS), "a.xlsx")
    newer = cast_journal(journal(spark, ("1001", "Лесной", "утечка на ЦТП-8", None, "2025-01-05", None, None, "0", "1", "0")), "b.xlsx")
    plant, other = R.route_journal(cast.unionByName(newer))
    rows = {r["id_cds_claim"]: r for r in plant.collect()}
    assert set(rows) == {1001, 1002} and [r["id_cds_claim"] for r in other.collect()] == [2001]
    assert rows[1001]["name_mr"] == "Лесной" and rows[1001]["source_file"] == "b.xlsx" and rows[1002]["t_ov"] is None
    assert {r["t_ov"] for r in cast.where("id_cds_claim = 1001").collect()} == {5.5}


def test_journal_without_a_column_is_refused(spark):
    with pytest.raises(ValueError, match="d_close"):
        cast_journal(journal(spark, *ROWS).drop("d_close"), "a.xlsx")


def test_label_upload_resumes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    objects = [(i, "t", "ЦТП", n, m, None) for i, n, m in CATALOG] + [("900", "t", "Котельная", "ЦТП-345", "Озёрск", None)]
    T.append_rows(spark.createDataFrame(objects, OBJECTS), store.path("objects"))
    first = label_upload(store, {"a.xlsx": journal(spark, *ROWS)}).first()
    assert (first["incidents_ctp"], first["go_events"], first["llm_extracted"], first["resolved"], first["unresolved"],
            first["published"], first["duplicates"]) == (2, 1, 2, 1, 1, 1, 0)
    again = label_upload(store, {"a.xlsx": journal(spark, *ROWS)}, extraction=F.raise_error(F.lit("asked again"))).first()
    assert (again["resolved"], again["published"], again["duplicates"]) == (1, 0, 1)
    row = store.incidents().first()
    assert (row["incident_id"], row["object_id"], row["incident_ts"], row["close_ts"]) == ("1001", "k7", 1735689600, None)
    with pytest.raises(FileNotFoundError):
        label_upload(store, {})


def test_parity_report(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "claim_id bigint, object_id string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (5, "q")], "claim_id bigint, object_id string")
    report, diffs = R.label_parity(a, b)
    r = report.first()
    assert (r["agree"], r["both_unresolved"], r["disagree"], r["only_a"], r["only_b"]) == (1, 1, 1, 1, 1)
    assert r["agreement"] == pytest.approx(1 / 3) and sorted(d["claim_id"] for d in diffs.collect()) == [2, 4, 5]
