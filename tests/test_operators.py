"""Edge frames and brute force for relational operators."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions.similarity import indel_ratio, jaro_winkler, metaphone, token_sort_ratio
from assayer.operators import analyze, clean, contract, control, drift, governance, issues, master, match, profile
from assayer.plans import report
from assayer.sources import readers

ROWS = [(1, " a ", "12", 1.0, "2025-01-02"), (2, "A", "-3.5", 1.0, "02-01-2025"), (2, None, "1e3", None, "02-Jan-25"), (None, "b\t", "abc", float("nan"), "not a date"), (4, "\tB", "", 2.5, None)]
SCHEMA = "k long, t string, n string, v double, d string"


@pytest.fixture(scope="module", params=["rows", "empty", "one", "null", "constant"])
def frame(request, spark):
    data = {"rows": ROWS, "empty": [], "one": ROWS[:1], "null": [(None,) * 5] * 2, "constant": [ROWS[0]] * 3}[request.param]
    return spark.createDataFrame(data, SCHEMA)


def test_every_operator_takes_edge_frames(frame):
    rule = F.col("v") > 0
    got = [
        profile.numeric_profile(frame, ["v"]), profile.string_profile(frame, ["t"]), profile.top_values(frame, ["t", "v"]), profile.entropy(frame, ["t"]),
        profile.quality_grade(frame, ["v"]), profile.zscore_issues(frame, ["k"], "v"), profile.iqr_issues(frame, ["k"], "v"), profile.pii_rates(frame, ["t"]),
        governance.readiness(frame, ["t", "v"]), governance.readiness(frame, ["t", "n"], order_col="k"), governance.readiness_deductions(frame.withColumnRenamed("d", "date"), ["k", "v", "date"]),
        governance.governance_scores(frame, ["t", "z"], ["d"], ["n"], consent_col="t", class_col="n"), governance.public_pii(frame, ["k"], "n"), governance.missing_required(frame, ["k"], ["t", "z"], ["d"], ["n"]), governance.missing_required(frame, ["k"]),
        governance.field_risks(frame, ["t", "v", "k"]), governance.overall_risk(governance.field_risks(frame, ["t", "v", "k"])),
        profile.lineage_score(frame, ["t", "z"]), profile.consent_issues(frame, ["k"], "t"), profile.uniqueness_coverage(frame, ["t"]), profile.rule_coverage(frame, {"r": rule}),
        drift.psi_numeric(frame, frame, "v"), drift.psi_categorical(frame, frame, "t"), drift.ecdf_distances(frame, frame, "k"), drift.js_distance(frame, frame, "k"), drift.zscore_rows(frame, frame, "k", "v"), drift.new_categories(frame, frame, "t"),
        clean.quarantine(frame, {"r": rule}), clean.null_tokens(frame, ["t", "n"]), clean.null_patterns(frame, ["t", "v"]), clean.treat_outliers(frame, "v"), clean.infer_types(frame, ["t", "n"]), clean.fix_types(frame, {"n": "numeric", "d": "date"}),
        clean.duplicate_rows(frame, ["t"], True), clean.duplicate_any(frame, {"t": (("t",), True)}), clean.conflicting_keys(frame, ["t"], ["v"]), clean.keep_first(frame, ["t"], "k"), clean.merge_smart(frame, ["t"], "k"), clean.standardise(frame, ["t"]), clean.variations(frame, "t"),
        clean.integrity(frame, ["k"], ["v"]), clean.preview_impact(frame, {"all": frame}), clean.likely_date(frame, "d", "k"), clean.carry(frame, "v", ["t"], ["k"]),
        master.key_candidates(frame, ["k", "t"]), master.composite_keys(frame, ["k", "t", "v"]), master.is_sequence(frame, "k"), master.fk_overlap(frame, "k", frame, "k"), master.lineage_diff(frame, frame, "k", ["t", "v"]), master.column_digests(frame, ["t", "v"]),
        master.golden_records(frame, ["t"], {"v": {"rule": "most_complete"}, "d": {"rule": "most_recent", "by": "k"}, "n": {"rule": "most_frequent"}}, "d"), master.steward_flags(frame, {"r": rule}),
        analyze.rfm_scores(frame, "k", "d", "v", "2025-02-01") if frame.where("v is not null and k is not null").count() > 9 else frame, analyze.basket_rules(frame, "k", "t", 0.1, 0.1, 0), analyze.frequent_sets(frame, "k", "t", 0.1),
        issues.issues(frame, "k", {"r": ("v", "high", rule)}), issues.with_row_id(frame), issues.any_all(frame, {"r": rule}), issues.seeded_sample(frame, "k", 2),
        contract.enforce_contract(frame, {"columns": {"k": {"type": "integer"}, "t": {"allowed": ["a"], "default": "z"}, "w": {"default": 1}}}), contract.contract_report(frame, {"columns": {"k": {"required": True}, "w": {}}}),
        match.fuzzy_clusters(frame, {"t": 1.0}, 90.0, "k", ["n"]), control.z_scored(frame.select(F.col("k").alias("customer_id"), F.col("v").alias("total_value"), F.lit(1).alias("transaction_count"), F.col("v").alias("avg_value")), frame.select(F.col("k").alias("customer_id"), F.col("v").alias("total_value"), F.lit(1).alias("transaction_count"), F.col("v").alias("avg_value"))),
    ]
    for df in got:
        df.collect()


def one(df):
    return [tuple(r) for r in df.collect()]


def test_faults_that_were_probed(spark):
    df = spark.createDataFrame([(1, "\t us \x0b"), (2, "USA"), (3, None)], "k long, t string")
    assert one(clean.standardise(df, ["t"], synonyms={"us": "usa", "usa": "United States"}).orderBy("k").select("t")) == [("usa",), ("United States",), (None,)]
    old = spark.createDataFrame([(1, "a|b", "c"), (2, None, "x"), (None, "p", "q")], "k long, x string, y string")
    new = spark.createDataFrame([(1, "a", "b|c"), (2, "", "x"), (None, "p", "q")], "k long, x string, y string")
    assert sorted(one(master.lineage_diff(old, new, "k", ["x", "y"]))) == [(1, "changed"), (2, "changed")]
    units = spark.createDataFrame([("10 %",), ("5$",), ("7 in",), ("7 inch",)], "t string")
    assert one(units.select(clean.convert_units(F.col("t"), {"%": ("pct", 1.0), "$": ("usd", 2.0), "in": ("cm", 2.5)}))) == [("10.0 pct",), ("10.0 usd",), ("17.5 cm",), ("7 inch",)]
    tokens = spark.createDataFrame([("?",), (" missing ",), ("Null",), ("\tN/A",), ("x",)], "t string")
    assert one(clean.null_tokens(tokens, ["t"])) == [(None,), (None,), ("Null",), (None,), ("x",)]
    for order, kind in ((["b", "a"], "string"), ([datetime.datetime(2025, 2, 1), datetime.datetime(2025, 1, 1)], "timestamp"), ([2, 1], "long")):
        g = spark.createDataFrame([("k", "late", 5, order[0]), ("k", "soon", 5, order[1])], f"k string, v string, s long, o {kind}")
        assert one(master.golden_records(g, ["k"], {"v": {"rule": "most_recent", "by": "s"}}, "o").select("v")) == [("soon",)]
    assert one(drift.psi_numeric(df.where("k > 9"), df, "k")) == [(None, False)]
    assert one(profile.rule_coverage(df.where("k > 9"), {"r": F.col("k") > 0}))[0][1:] == (0, 100.0)


def test_similarities_against_known_values():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert indel_ratio("smith", "smyth") == pytest.approx(80.0)
    assert token_sort_ratio("market 500", "500 market") == 100.0
    assert metaphone("smith") == metaphone("smyth") == "SM0" and metaphone("knight") == "NT" and metaphone("jon") == metaphone("john") != metaphone("jane x")
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert indel_ratio(a, b) == pytest.approx(200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100)


def test_fuzzy_golden_records(spark):
    """Spelling variants of three people, of which two have variants, and two who stand alone."""
    data = [
        (1, "CRM", "2025-11-01", "Ann", "Smith", "ann.smith@mail.example", "555-123-4567", "12 Road St", "62704"),
        (2, "Shop", "2025-12-01", "Ann", "Smyth", "ann.smith@mail.example", "(555) 123 4567", "12 Rd Street", "62704"),
        (3, "Desk", "2025-10-15", "Anne", "Smith", "a.smith@mail.example", "5551234567", "12 Road Street Apt 4", "62704"),
        (4, "CRM", "2025-11-05", "Eve", "Doe", "eve.doe@acme.example", "555-987-6543", "500 Market Street", "94105"),
        (5, "Shop", "2025-12-03", "Eve", "Do", "eve.doe@acme.example", "5559876543", "500 Market St.", "94105"),
        (6, "CRM", "2025-11-20", "Olga", "Stone", "olga@other.example", "555-222-3333", "77 Sunset Boulevard", "90028"),
    ]
    df = spark.createDataFrame(data, "record_id long, source string, updated string, first_name string, last_name string, email string, phone string, address string, zip string").repartition(3)
    weights = {"email": 35, "phone": 25, "last_name": 15, "first_name": 10, "address": 10, "zip": 5}
    got = match.fuzzy_clusters(df, weights, 83, "record_id")
    assert sorted(one(got.select("record_id", "_cluster"))) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    blocked = match.fuzzy_clusters(df, weights, 83, "record_id", ["first_name"])
    assert dict(one(blocked.select("record_id", "_cluster")))[3] == 3
    rules = {"phone": {"rule": "most_recent", "by": "updated"}, "email": {"rule": "source_priority", "by": "source", "priority": {"CRM": 1}}, "address": {"rule": "most_complete"}}
    golden = {r["key__cluster"]: r for r in match.fuzzy_golden_records(df, weights, 83, rules, "record_id").collect()}
    assert golden["1"]["phone"] == "(555) 123 4567" and golden["1"]["source_count"] == 3 and golden["6"]["trust_score"] == 1.0


def test_matching_without_replacement(spark):
    r = random.Random(4)
    rows = [(i, i % 4 == 0, float(r.randrange(6)), float(r.randrange(6)), float(r.randrange(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "customer_id long, treated boolean, total_value double, transaction_count double, avg_value double").repartition(5)
    used, want = set(), []
    for t in [x for x in rows if x[1]]:
        for d, c in sorted((sum((a - b) ** 2 for a, b in zip(t[2:], x[2:])) ** 0.5, x[0]) for x in rows if not x[1]):
            if c not in used:
                used.add(c)
                want.append((t[0], c, round(d, 9)))
                break
    got = [(a, b, round(d, 9)) for a, b, d in one(control.match_controls(df))]
    assert sorted(got) == sorted(want)


def test_row_ids_follow_the_order(spark):
    df = issues.with_row_id(spark.range(0, 1000, 1, 7))
    assert df.where("id <> _row_id").isEmpty()


def test_report_over_stages(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    find = lambda d: issues.issues(d, "k", {"bad": ("v", "high", F.col("v").isNull()), "odd": ("t", "low", F.col("k") > 1)})
    stages = {
        "dropper": lambda d: (d.where("k is not null"), {"rows": d.count()}, find(d)),
        "broken": lambda d: (d.select("no_such_column"), {}, None),
        "counter": lambda d: (None, {"rows": d.count()}, None),
        "failing": lambda d: 1 / 0,
    }
    last, results = report.run_chain(df, {k: v for k, v in stages.items() if k != "broken"})
    assert last.count() == 4 and [r.status for r in results] == ["success", "success", "error"] and results[1].metrics == {"rows": 4}
    whole = report.consolidate("clean", results)
    assert whole["status"] == "partial" and whole["issue_summary"]["by_severity"] == {"high": 1, "low": 3} and whole["row_issues"][0]["severity"] == "high"
    assert '"tool": "clean"' in report.to_json(whole)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,x,2.5\n2,,nope\n3,y\n4,z,1,9\n")
    df = readers.read_any(spark, str(tmp_path / "x.csv"), all_text=True)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [("1", "x", "2.5"), ("2", None, "nope"), ("3", "y", None), ("4", "z", "1")]
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2}]')
    assert readers.read_any(spark, str(tmp_path / "x.json")).count() == 2
    readers.write_any(df, str(tmp_path / "out.csv"), "csv")
    assert readers.read_any(spark, str(tmp_path / "out.csv")).count() == 4
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.unknown")
    with pytest.raises(ValueError):
        readers.require(df.where("a > 9"), ["a"])
    with pytest.raises(ValueError):
        readers.require(df, ["zz"])


@pytest.mark.parametrize("few", [20_000, 3])
def test_order_statistics(spark, few, monkeypatch):
    from assayer.functions import stats

    monkeypatch.setattr(stats, "FEW", few)
    r = random.Random(6)
    rows = [(r.randrange(50) if i % 3 else None, r.gauss(0, 1), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b double, c double").repartition(5)
    ranks = lambda n: sorted({0, 1, n // 3, n // 2, n - 2, n - 1})
    got = stats.order_statistics(df, ["a", "b", "c"], ranks)
    for k, c in enumerate("ab"):
        v = sorted(x[k] for x in rows if x[k] is not None)
        assert got[c] == [v[i] for i in ranks(len(v))]
    assert got["c"] == []
    assert stats.linear_quantiles(df, ["b"], [0.5])["b"][0] == pytest.approx(df.agg(F.median("b")).first()[0])


def test_column_names(spark):
    from assayer.operators.semantics import column_semantics, meaning, standard_names

    assert meaning("CUST_ID ") == ("customer_id", "mapped", 0.95, "standard_variant")
    assert meaning("age") == ("age", "mapped", 1.0, "standard")
    assert meaning("x", {"x": "y"}) == ("y", "mapped", 1.0, "custom")
    assert meaning("ship_time", threshold=0.8) == ("date", "low_confidence", 0.7, "pattern_detection")
    assert meaning("ship_time", hints=False) == ("ship_time", "unmapped", 0.0, None)
    df = spark.createDataFrame([], "`qty.` int, price int, cost int, qty int, `` int")
    assert column_semantics(df).count() == 5
    assert standard_names(df).columns == ["quantity", "price", "cost", "qty", ""]


def test_similar_pairs_score_each_pair_of_texts_once(spark):
    """Copies are scored as one text, and no pair of rows is lost: blocks, ties, nulls and repeated ids as in a plain join."""
    from assayer.functions.similarity import jaro_winkler_col

    r = random.Random(8)
    names = ["hot bolt", "bolt hot", "old plate", "", None, "abcb", "bacb"]
    rows = [(i if i % 31 else None, r.choice(names), r.choice(["p", "q", None]), r.randrange(2)) for i in range(200)] + [(7, "hot bolt", "p", 0)]
    df = spark.createDataFrame(rows, "id long, name string, b string, c int").repartition(4)
    scored = spark.sparkContext.accumulator(0)

    def counted(x, y):
        def run(batches):
            for a, b in batches:
                scored.add(len(a))
                yield a.str.len() + b.str.len()

        return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(x, y)

    want = [(p[0], q[0], None if None in (p[1], q[1]) else round(jaro_winkler(p[1], q[1]), 6)) for p in rows for q in rows if None not in (p[0], q[0], p[2]) and p[0] < q[0] and p[2:] == q[2:]]
    got = one(match.pair_similarity(df, "id", "name", ["b", "c"], lambda x, y: F.round(jaro_winkler_col(x, y), 6)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert match.pair_similarity(df, "id", "name", ["b", "c"], counted).count() == len(want) and scored.value <= 4 * len(names) ** 2


@pytest.mark.parametrize("more, listed, ratio", [(8, 1_000_000, 1), (1, 1, 3), (2, 1, 500)])
def test_matching_lists_grow_with_customers_not_pairs(spark, monkeypatch, more, listed, ratio):
    """Copies, crowded places, ties, text ids, null ids and values that aren't finite, in one round or many: as in a plain draw; lists stay short."""
    asked = []
    lists = control._lists
    monkeypatch.setattr(control, "MORE", more)
    monkeypatch.setattr(control, "LISTED", listed)
    monkeypatch.setattr(control, "_lists", lambda *a: asked.append((len(a[2]), int(a[3].sum()))) or lists(*a))
    r = random.Random(more + ratio)
    rows = [(f"c{i}" if i else None, i % 3 == 0 and i < 400, float(r.randrange(3 if i % 2 else 40)), float(r.randrange(2)), r.choice([0.0, 0.5, 7.25])) for i in range(900)]
    rows += [("inf", False, float("inf"), 0.0, 0.0), ("nan", True, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "customer_id string, treated boolean, total_value double, transaction_count double, avg_value double").repartition(5)
    used, want = set(), []
    for t in sorted(x for x in rows if x[1] and x[0] not in (None, "nan")):
        near = sorted((sum((a - b) ** 2 for a, b in zip(t[2:], x[2:])) ** 0.5, x[0] or "") for x in rows if not x[1] and x[0] != "inf" and x[0] not in used)[:ratio]
        used |= {c for _, c in near}
        want += [(t[0], c, round(d, 9)) for d, c in near]
    assert sorted((a, b, round(d, 9)) for a, b, d in one(control.match_controls(df, ratio))) == sorted(want)
    assert all(k <= len(rows) * ratio + max(n * more * 4**i, listed) for i, (n, k) in enumerate(asked))
    assert ratio > 1 or sum(k for _, k in asked) < 134 * 134 / 2  # before: 133 for each of 133 and each task


def test_nearest_in_equals_brute_force(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(control, "LEAF", 4)
    g = np.random.default_rng(3)
    for size in (0, 1, 300):
        x, q = g.integers(0, 6, (size, 2)).astype(float), g.integers(0, 6, (23, 2)) + 0.5 * g.integers(0, 2, (23, 2))
        ids = g.permutation(size)
        k, least = g.integers(1, 9, 23), g.integers(0, 50, 23)
        held = pa.array(ids[::3].tolist(), pa.int64()), g.integers(0, 50, len(ids[::3]))
        turn = dict(zip(held[0].to_pylist(), held[1].tolist()))
        got = control._nearest_in(pa.table({"customer_id": pa.array(ids, pa.int64()), "a": x[:, 0], "b": x[:, 1]}), q, k, least, held, control._leaves(q, 5), np.full(23, np.inf), ["a", "b"]).to_pylist()
        for i in range(23):
            near = sorted((float(np.sqrt(((p - q[i]) ** 2).sum())), c) for p, c in zip(x, ids.tolist()) if turn.get(c, 99) >= least[i])[: k[i]]
            assert sorted((v["distance"], v["control_id"]) for v in got if v["q"] == i) == near
