import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import DAY, HOUR, T0, frame, pay, plain_large_cash, plain_structuring
from tidemark.functions import names
from tidemark.operators import customers, models, rules, screening
from tidemark.operators.features import features
from tidemark.sources import generator
from tidemark.streaming import cash_windows as cw

EDGES = "owner string, owned string, share double, owner_type string, owner_opaque_jurisdiction boolean"


def owned(spark, edges, *firms):
    ents = spark.createDataFrame([(f, "business") for f in firms] + [("I", "individual")], "entity_id string, entity_type string")
    owners, flags = customers.beneficial_owners(ents, spark.createDataFrame(edges, EDGES))
    return {(r["entity_id"], r["person_id"]): r for r in owners.collect()}, {r["entity_id"]: r for r in flags.collect()}


def test_ownership_chains_routes_and_line(spark):
    o, f = owned(spark, [("H", "B", 0.6, "holding", False), ("p", "H", 0.5, "person", False), ("q", "H", 0.5, "person", False), ("p", "B", 0.02, "person", False), ("r", "B", 0.25, "person", False)], "B")
    assert (o["B", "p"]["effective_share"], o["B", "p"]["chains"], o["B", "p"]["is_beneficial_owner"]) == (0.32, 2, True)
    assert o["B", "q"]["effective_share"] == 0.3 and o["B", "r"]["is_beneficial_owner"]
    assert (f["B"]["layers"], f["B"]["layered_ownership"], f["B"]["circular_ownership"], f["B"]["opaque_jurisdiction"], f["B"]["beneficial_owners"]) == (2, True, False, False, 3)
    _, f = owned(spark, [(f"p{k}", "B", 0.2, "person", False) for k in range(5)], "B", "C")
    assert f["B"]["no_25pct_owner"] and f["B"]["accounted_share"] == 1.0 and f["C"]["no_25pct_owner"] and f["C"]["layers"] == 0


def test_ownership_loops_and_opacity(spark):
    edges = [("H", "B", 0.5, "holding", False), ("K", "H", 0.5, "holding", True), ("B", "K", 0.9, "business", False), ("H", "K", 0.1, "holding", False), ("p", "K", 0.4, "person", False)]
    o, f = owned(spark, edges, "B")
    assert f["B"]["circular_ownership"] and f["B"]["opaque_jurisdiction"] and f["B"]["layers"] == 3
    assert o["B", "p"]["effective_share"] == 0.1 and o["B", "p"]["example_chain"] == "B <- H <- K <- p"
    _, f = owned(spark, [("B", "B", 1.0, "business", True)], "B")
    assert f["B"]["circular_ownership"] and not f["B"]["opaque_jurisdiction"]


def test_activity_and_rating(spark):
    rows = [pay(1, "A", "", T0, 600_000, cash=1), pay(2, "A", "C", T0 + DAY, 400_000), pay(3, "A", "C", T0 + DAY, 300_000, "outbound", channel="wire"), pay(4, "B", "C", T0, 100, "outbound")]
    act = {r["entity_id"]: r for r in customers.activity(frame(spark, rows)).collect()}
    assert act["A"]["cash_share_of_inflows"] == 0.6 and act["A"]["wire_share_of_outflows"] == 1.0 and act["A"]["actual_monthly_inflow_cad"] == 10_000.0
    assert act["B"]["actual_monthly_inflow_cad"] == 0.0
    ents = spark.createDataFrame([("A", "individual", "gig"), ("B", "individual", "salaried"), ("Z", "business", "wholesale")], "entity_id string, entity_type string, segment string")
    prof = spark.createDataFrame([("A", "none", "branch", False, 3000.0), ("B", "foreign_pep", "branch", False, 100.0), ("Z", "none", "non_face_to_face", True, 100.0)], "entity_id string, pep_status string, onboarding_channel string, adverse_media boolean, declared_monthly_inflow_cad double")
    _, flags = customers.beneficial_owners(ents, spark.createDataFrame([], EDGES))
    risk = customers.rate(ents, prof, flags, customers.activity(frame(spark, rows)), spark.createDataFrame([("A",), ("A",)], "entity_id string"))
    got = {r["entity_id"]: r for r in risk.collect()}
    assert (got["A"]["onboarding_points"], got["A"]["refresh_points"], got["A"]["refresh_rating"], got["A"]["next_review"]) == (1, 7, "High", "2027-07-31")
    assert got["A"]["factors"].startswith("segment:gig +1; activity_over_3x_declared +2")
    assert got["B"]["onboarding_rating"] == "High" and "foreign PEP" in got["B"]["edd_reasons"]
    assert got["Z"]["onboarding_points"] == 7 and got["Z"]["actual_monthly_inflow_cad"] == 0.0 and "no owner at the line" in got["Z"]["edd_reasons"]
    m = {r["onboarding_rating"]: (r["Low"], r["Medium"], r["High"]) for r in customers.migration(risk).collect()}
    assert m == {"Low": (0, 0, 1), "Medium": (0, 0, 0), "High": (0, 0, 2)}
    assert {r["reason"]: r["customers"] for r in customers.edd_histogram(risk).collect()}["high risk"] == 3


# Screening

XML = """<list>
<record><Country-Pays>Freedonia</Country-Pays><LastName-Nom>VARGATOV</LastName-Nom><GivenName-Prenom>Mikhail</GivenName-Prenom><Aliases-Alias>Михаил Варгатов, Mikhayil Vargatoff; ميخائيل</Aliases-Alias><DateOfBirthOrShipBuildDate-Date>about 1961</DateOfBirthOrShipBuildDate-Date><Schedule-Annexe>1</Schedule-Annexe><Item-Numero>4</Item-Numero></record>
<record><Country-Pays>Sylvania</Country-Pays><LastName-Nom>VARGATOV</LastName-Nom><GivenName-Prenom>Mikhail</GivenName-Prenom><Schedule-Annexe>1</Schedule-Annexe><Item-Numero>4</Item-Numero></record>
<record><Country-Pays>Sylvania</Country-Pays><EntityOrShip-Entite>Bank of Sylvania, Ltd.</EntityOrShip-Entite><Aliases-Alias>BOS a.k.a. Sylvanian Bank</Aliases-Alias><Schedule-Annexe>2</Schedule-Annexe><Item-Numero>1</Item-Numero></record>
<record><EntityOrShip-Entite>Grey Heron</EntityOrShip-Entite><ShipIMONumber-Numero>123</ShipIMONumber-Numero><DateOfBirthOrShipBuildDate-Date>1999</DateOfBirthOrShipBuildDate-Date></record>
<record><Country-Pays>Nowhere</Country-Pays></record>
<record><LastName-Nom>Ri</LastName-Nom><GivenName-Prenom>Il</GivenName-Prenom></record>
</list>"""


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("xml") / "list.xml"
    path.write_text(XML, encoding="utf-8")
    return screening.parties(screening.read_list(spark, str(path))).cache()


def test_parsing(listed):
    got = {r["party"]: r for r in listed.collect()}
    assert set(got) == {"1|4|Freedonia", "1|4|Sylvania", "2|1|Sylvania", "||"} or len(got) == 4
    v = got["1|4|Freedonia"]
    assert v["names"] == ["Mikhail VARGATOV", "Михаил Варгатов", "Mikhayil Vargatoff", "ميخائيل"] and v["birth_year"] == 1961 and v["kind"] == "individual"
    assert got["2|1|Sylvania"]["names"] == ["Bank of Sylvania, Ltd.", "BOS", "Sylvanian Bank"]
    assert {r["kind"] for r in listed.collect()} == {"individual", "entity", "ship"}
    assert listed.where("kind = 'ship' AND birth_year IS NOT NULL").count() == 0
    d = {(r["what"], r["value"]): r["n"] for r in screening.describe(listed).collect()}
    assert d["not screened", "all"] == 1 and d["aliases", "cyrillic"] == 1 and d["parties", "individual"] == 3


def test_typed_spellings_find_the_party(spark, listed):
    asked = ["Mikhail Vargatov", "VARGATOV, Mikhail", "Mihail Vargatof", "М. Варгатов", "Michail Vargattov", "Ri Il", "Zebulon Quartz", "Maria Vargatov"]
    q = spark.createDataFrame([(k, n, y) for k, n in enumerate(asked) for y in [None]], "query_id int, name string, year int")
    top = {r["query_id"]: r for r in screening.screen(q, listed).where("rank = 1").collect()}
    assert all(top[k]["score"] >= 0.85 for k in range(6)), {k: top[k]["score"] for k in top}
    assert 6 not in top or top[6]["score"] < 0.85
    assert top[7]["score"] < 0.85


def test_birth_years_order_scores(spark, listed):
    q = spark.createDataFrame([(0, "Mikhayl Vargatov", 1962), (1, "Mikhayl Vargatov", None), (2, "Mikhayl Vargatov", 1990)], "query_id int, name string, year int")
    s = {r["query_id"]: r["score"] for r in screening.screen(q, listed, year_col="year").where("party = '1|4|Freedonia'").collect()}
    assert s[0] >= s[1] > s[2]


def test_normalisation(spark):
    """Held to the definition: letters romanised, then decomposed, and all but ASCII letters and digits a space."""
    import re
    import unicodedata

    def plain(name):
        latin = "".join(names.CYRILLIC.get(c.lower(), c) for c in name or "")
        bare = "".join(c for c in unicodedata.normalize("NFKD", latin) if not unicodedata.combining(c)).lower()
        return " ".join(re.sub(r"[^a-z0-9]+", " ", bare.replace("&", " and ").replace("'", "")).split())

    given = ["  Ёлкин-Çelik & O'Brien  №5 ", None, "李娜", "", "Щукин Юрий", "Žižka Ångström ﬁn", "e\u0301le\u0300ve", "ＡＢＣ Ltd.", "Łódź ŉ Ǆ", "plain Name 7", "Ümit ÖZ-çağ", "объект", "№"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(given)], "k int, n string").select("k", names.normalized("n").alias("x"), names.tokens(names.normalized(F.col("n"))).alias("t")).collect()
    got = {r["k"]: r["x"] for r in rows}
    assert got == {k: plain(n) for k, n in enumerate(given)} and got[0] == "yolkin celik and obrien no5"
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and names.jaro_winkler("", "a") == 0.0 and names.jaro_winkler("abc", "xyz") == 0.0


def test_folds_and_keys(spark):
    df = spark.createDataFrame([("Khodorkovskiy",), ("Hodorkovsky",), ("Alexandr the LLC",), ("Aleksandr",), ("Li",)], "n string").select(names.folded_tokens(F.col("n")).alias("f")).withColumn("k", names.keys_of(F.col("f")))
    got = df.collect()
    assert got[0]["f"] == got[1]["f"] and got[2]["f"] == got[3]["f"] and got[4]["k"] == ["w:li"]
    assert all(k[:2] in ("p:", "s:", "c:") for k in got[0]["k"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcde", min_size=1, max_size=6), min_size=1, max_size=3), st.lists(st.text("abcde", min_size=1, max_size=6), min_size=1, max_size=3))
def test_alignment_is_greedy_one_to_one(q, n):
    sim = lambda a, b: (0.9 if a[0] == b[0] else 0.0) if min(len(a), len(b)) == 1 else names.jaro_winkler(a, b)
    pairs = sorted(((sim(a, b), i, j) for (i, a), (j, b) in itertools.product(enumerate(q), enumerate(n))), reverse=True)
    used_q, used_n, total = set(), set(), 0.0
    for s, i, j in pairs:
        if i not in used_q and j not in used_n:
            used_q.add(i)
            used_n.add(j)
            total += s
    assert names.token_similarity(q, n) == pytest.approx(0.85 * total / len(q) + 0.15 * len(used_n) / len(n))
    assert names.token_similarity([], n) == 0.0


def test_screening_evaluation(spark, listed):
    negatives = spark.createDataFrame([(k, n) for k, n in enumerate(["Zebulon Quartz", "Ophelia Winterbourne", "Tuvalu Pacific Oranges"])], "query_id int, name string")
    got = screening.evaluate(listed, negatives).collect()
    assert got and all(0 <= r["rate"] <= 1 and 0.7 <= r["threshold"] <= 1 for r in got)


# Streaming


def run_stream(spark, tmp_path, batches):
    """Each list of rows is a micro-batch."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = frame(spark, []).select("transaction_id", "entity_id", "txn_epoch", "amount_cents", "direction", "is_cash")
    query = None
    for rows in batches:
        frame(spark, rows).select(*schema.columns).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema.schema).parquet(src)
        query = cw.start(cw.alerts(stream), out, ck)
        query.awaitTermination()
    return cw.latest_alerts(spark, out), query


def members(found, rule):
    return {r["transaction_id"] for r in cw.flagged_members(found).where(F.col("rule") == rule).collect()}


def test_stream_equals_batch_with_late_and_repeated_events(spark, tmp_path):
    rng = random.Random(2)
    rows = [pay(k, f"ENT-{rng.randrange(3)}", "", T0 + k * 2 * HOUR + rng.choice([0, 0, 60]), rng.choice([300_000, 800_000, 999_999, 1_000_000]), rng.choice(["inbound", "inbound", "outbound"]), cash=rng.choice([1, 1, 0])) for k in range(90)]
    shaken = sorted(range(90), key=lambda k: rows[k][4] + rng.choice([0, 0, 0, 6 * HOUR]))
    parts = [[rows[k] for k in shaken[i : i + 30]] for i in (0, 30, 60)]
    parts[1] += parts[0][-3:]
    found, query = run_stream(spark, tmp_path, parts)
    assert members(found, "R1_STRUCTURING") == set(plain_structuring(rows))
    assert members(found, "LCTR_24H") == plain_large_cash(rows)
    df = frame(spark, rows)
    batch = rules.structuring(df).select(F.lit("R1_STRUCTURING").alias("rule"), "transaction_id").unionByName(rules.large_cash(df).select(F.lit("LCTR_24H").alias("rule"), "transaction_id"))
    assert cw.difference(cw.flagged_members(found), batch).count() == 0
    assert cw.progress(query)["batches"] >= 1


def test_too_late_events_are_set_aside_and_keys_are_stable(spark, tmp_path):
    first = [pay(0, "ENT-1", "", T0, 800_000, cash=1), pay(1, "ENT-1", "", T0 + DAY, 800_000, cash=1)]
    far = [pay(2, "ENT-1", "", T0 + 3 * DAY, 800_000, cash=1), pay(3, "ENT-2", "C", T0 + 20 * DAY, 100, "outbound")]
    late = [pay(4, "ENT-1", "", T0 + 2 * DAY, 800_000, cash=1), pay(5, "ENT-1", "", T0 + 21 * DAY, 5, cash=1)]
    found, _ = run_stream(spark, tmp_path, [first, far, late])
    assert members(found, "R1_STRUCTURING") == {"TXN-00000", "TXN-00001", "TXN-00002"}
    r1 = found.where("rule = 'R1_STRUCTURING'").collect()
    assert [r["key"] for r in r1] == ["R1_STRUCTURING|ENT-1|TXN-00000|TXN-00002"] and r1[0]["total_cents"] == 2_400_000


def test_window_edges():
    rule = cw.StreamRule("X", 7 * DAY, 1, 10**9, least_count=3)
    at = lambda *ts: [(t, str(k), 5) for k, t in enumerate(ts)]
    assert len(list(cw.windows_at(at(0, DAY, 7 * DAY), rule, {0}))) == 1
    assert not list(cw.windows_at(at(0, DAY, 7 * DAY + 1), rule, {0}))
    cash = cw.StreamRule("Y", DAY, 1, 2**62, least_total=1_000_000)
    assert list(cw.windows_at([(0, "a", 1_000_000)], cash, {0})) == [(0, 0, 1_000_000, ["a"])]
    assert not list(cw.windows_at([(0, "a", 999_999)], cash, {0}))


def test_messages(spark):
    good = json.dumps({"transaction_id": "t", "entity_id": "e", "txn_epoch": 5, "amount_cents": 7, "direction": "inbound", "is_cash": 1})
    assert [tuple(r) for r in cw.from_json(spark.createDataFrame([(good,), ("broken",)], "value string")).collect()] == [("t", "e", 5, 7, "inbound", 1)]
    alert = spark.createDataFrame([("k", "R", "e", 1, 2, 3, ["a"])], cw.ALERT)
    assert json.loads(cw.to_json(alert).first()["value"])["members"] == ["a"]


# Generator and models


@pytest.fixture(scope="module")
def made(spark):
    cfg = generator.GeneratorConfig(entities=120, counterparties=400, case_share=0.25)
    g = generator.generate(spark, cfg)
    g["transactions"].cache()
    return cfg, g


def test_generator_invariants(spark, made):
    cfg, g = made
    t = g["transactions"]
    n = generator.check_volume(t, cfg)
    assert t.select("transaction_id").distinct().count() == n and t.where("amount_cents <= 0").count() == 0
    order = [r["txn_epoch"] for r in t.orderBy("transaction_id").select("txn_epoch").collect()]
    assert order == sorted(order)
    assert t.where("(is_cash = 1) != (counterparty_id = '')").count() == 0
    records = {r["case_id"]: r for r in generator.case_records(t).collect()}
    assert set(records) == {r["case_id"] for r in g["cases"].collect()}
    for r in records.values():
        if r["typology"] == "structuring":
            assert 3 <= r["n_transactions"] <= 6 and (r["span_days"] <= 7) == (r["typology_variant"] == "fast")
        if r["typology"] == "smurfing":
            assert 10 <= r["n_transactions"] <= 18 and r["span_days"] <= 3
    assert sorted(map(str, generator.generate(spark, cfg)["transactions"].limit(50).collect()))
    with pytest.raises(ValueError):
        generator.check_volume(t.limit(5), cfg)


def test_rules_find_what_is_planted(made):
    t = made[1]["transactions"]
    hits = rules.apply_rules(t, features(t)).join(t, "transaction_id")
    caught = {r["typology"]: r["share"] for r in hits.where("is_suspicious = 1 AND typology_variant != 'slow'").groupBy("typology", "case_id").agg(F.max(F.col("n_rules_fired") > 0).alias("x")).groupBy("typology").agg(F.avg(F.col("x").cast("double")).alias("share")).collect()}
    assert all(v >= 0.8 for v in caught.values()), caught


def test_models_rank_outliers(spark, made):
    t = made[1]["transactions"]
    rows = features(t).join(t.select("transaction_id", "is_suspicious"), "transaction_id").withColumn("fold", F.pmod(F.xxhash64("entity_id"), F.lit(5)).cast("int")).cache()
    n = rows.count()
    for model in ("isolation_forest", "mahalanobis", "lof"):
        got = models.cross_validated(rows, model).join(rows.select("transaction_id", "is_suspicious"), "transaction_id")
        stats = got.agg(F.count(F.lit(1)), F.count_if(F.isnan("score") | F.col("score").isNull()), F.avg(F.when(F.col("is_suspicious") == 1, F.col("score"))), F.avg(F.when(F.col("is_suspicious") == 0, F.col("score")))).first()
        assert stats[0] == n and stats[1] == 0, model
        if model != "lof":
            assert stats[2] > stats[3], model
    got = models.supervised(rows.where("fold != 0"), rows.where("fold = 0"), "logistic")
    assert got.count() == rows.where("fold = 0").count() and got.where("logistic_score < 0 OR logistic_score > 1").count() == 0


def test_moments_match_numpy(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(1e6, 3, (200, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    mean, sigma, cov, n = models.moments(df, ("a", "b"))
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(sigma, x.std(0)) and np.allclose(cov, np.cov(x.T))
    assert models.moments(df.where("a < 0"), ("a", "b"))[3] == 0


def test_sampled_models_by_themselves():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 5))
    x[:30] += 5
    y = (np.arange(3000) < 30).astype(float)
    forest = models.IsolationForest(x, trees=50, size=512).score(x)
    assert forest[:30].min() > np.median(forest[30:]) and 0 < forest.min() and forest.max() < 1
    one = models.IsolationForest(np.array([[1.0], [2.0]]), trees=3)  # two rows: one cut, then single rows
    assert all(len(t[0]) == 3 and t[0].tolist() == [0, -1, -1] for t in one.trees) and len(set(one.score(np.array([[1.0], [2.0]])))) == 1
    trees = models.BoostedTrees(x[::2], y[::2], np.where(y[::2] == 1, 50.0, 0.5), rounds=40)
    held = trees.score(x[1::2])
    assert held[y[1::2] == 1].min() > 0.5 and np.mean(held[y[1::2] == 0] < 0.5) > 0.98
    flat = models.BoostedTrees(np.zeros((10, 2)), np.array([0.0] * 5 + [1.0] * 5), np.ones(10), rounds=3)
    assert np.allclose(flat.score(np.zeros((2, 2))), 0.5)
    assert models.boosted(x[30:], y[30:], np.ones(2970)).score(x[:2]).tolist() == [0.0, 0.0]


def test_candidates_share_a_key_however_common_it_is(spark):
    """Each pair once, and a key that most names have is dealt to several tasks."""
    rows = [[f"petr{a}{b}"] for a in "abcdefg" for b in "abcdefg"] + [["li"], ["li", "petraa"], ["xyzzy", "zq"]]
    df = spark.createDataFrame([(r,) for r in rows], "folded array<string>")
    queries = df.withColumnRenamed("folded", "q_folded").unionByName(spark.createDataFrame([(["unmatched"],), ([],)], "q_folded array<string>"))
    keys = {tuple(r["folded"]): set(r["k"]) for r in df.select("folded", names.keys_of(F.col("folded")).alias("k")).collect()}
    want = sorted((q, n) for q in keys for n in keys if keys[q] & keys[n])
    for block in (1000, 5):
        assert sorted((tuple(r["q_folded"]), tuple(r["folded"])) for r in screening.candidates(queries, df, block).collect()) == want
