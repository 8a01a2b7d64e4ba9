"""Names scored by batches, and cells of documents without a common identifier."""

import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallywright.functions import similarity
from tallywright.operators import components, gate, linking, reconcile


def _texts(n):
    draw = random.Random(5)
    made = ["".join(draw.choice("abcdeé日 ") for _ in range(draw.choice([0, 1, 2, 5, 13, 22, 63, 64, 65, 70]))) for _ in range(n)]
    return [*made, "a", "aa", "", "corp", "acme corp", "corp acme", " a b"]


def test_batches_score_as_single_pairs(monkeypatch):
    texts, draw = _texts(150), np.random.default_rng(5)
    x, y = draw.integers(0, len(texts), 1500), draw.integers(0, len(texts), 1500)
    for table in (similarity.TABLE, 1000):  # in one go, and halved again and again
        monkeypatch.setattr(similarity, "TABLE", table)
        assert similarity.name_scores_of(texts, x, y).tolist() == [similarity.name_score(texts[i], texts[j]) for i, j in zip(x, y)]
        assert similarity._coverages_of(texts, x, y).tolist() == [similarity.coverage(texts[i], texts[j]) for i, j in zip(x, y)]
    texts = [" ".join(t.split()) or "a" for t in texts]  # as names are normalised
    bound = similarity.most_alike_of(similarity.Traits(texts), x, y)[np.arange(len(x)), np.arange(len(x))]
    assert (bound >= similarity.name_scores_of(texts, x, y) - similarity.ROUNDING).all()


def _facts(spark, n):
    draw = random.Random(9)
    rows = []
    for k in range(n):
        name = "".join(draw.choice("abcdef") for _ in range(6)) + " " + "".join(draw.choice("abcdef") for _ in range(5)) + " corp"
        kind = draw.choice(["INVOICE", "LEDGER", "PAYMENT"])
        rows.append((f"d{k:04d}", kind, "s", [], draw.randrange(9500, 10500) / 10, draw.choice(["USD", "EUR", None]), date(2001, 1, 1) + timedelta(draw.randrange(200)), name, None, None, False))
    kinds = "document_id string, document_type string, source_name string, identifiers array<string>, amount double, currency string, date date, entity string, category string, entry_type string, low_confidence boolean"
    return spark.createDataFrame(rows, kinds).withColumn("amount", F.col("amount").cast("decimal(18,2)")), rows


def test_only_pairs_that_can_count_leave_the_grid(spark, monkeypatch):
    """The same pairs as a plain loop gives, and no others, in whatever parts a cell is dealt."""
    facts, rows = _facts(spark, 300)
    want = set()
    for a in rows:
        for b in rows:
            if a[1] != "INVOICE" or b[1] == "INVOICE" or abs(a[4] - b[4]) > max(a[4], b[4]) * 0.02 + 1e-9 or (a[5] and b[5] and a[5] != b[5]):
                continue
            days = abs((a[6] - b[6]).days)
            if days < 90 and 0.2 * similarity.name_score(a[7], b[7]) + 0.15 + 0.05 * (1 - days / 90) >= 0.35 - 1e-9:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert len(want) > 50
    for part in (linking.PART, 7):
        monkeypatch.setattr(linking, "PART", part)
        got = [tuple(r) for r in linking.candidates(facts).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    linked = linking.link_evidence(facts).collect()
    assert {(r.left_id, r.right_id) for r in linked} == want and all(r.score >= 0.35 for r in linked)


def test_an_invoice_goes_to_the_cells_of_its_partners_and_to_few_others(spark):
    rows = spark.range(3000).select((F.pow(F.lit(1.0071), F.col("id").cast("double")) * F.when(F.col("id") % 2 == 0, -0.5).otherwise(0.5)).alias("x"))
    for share in (0.02, -0.02):
        partner = F.col("x") * (1 + share) if share < 0 else F.col("x") / (1 - share)
        got = rows.select(linking._bands(partner)[0].alias("band"), linking._bands(F.col("x"))[1].alias("bands")).collect()
        assert all(r.band in r.bands for r in got)
    assert sum(len(r.bands) for r in got) < 1.4 * len(got)


def test_equal_names_are_resolved_without_a_score(spark):
    rows = spark.createDataFrame([("acme corp", "acme corp"), ("acme corp", "corp acme"), ("acme corp", "zebra"), ("acme corp", None)], "x string, y string")
    got = [tuple(r["e"]) for r in rows.select(similarity.resolve(F.col("x"), F.col("y")).alias("e")).collect()]
    assert got[0] == ("RESOLVED", 1.0, "exact_normalized") and got[1] == ("RESOLVED", 1.0, "fuzzy") and got[2][0] == got[3][0] == "UNRESOLVED"
    assert [tuple(r["e"]) for r in rows.limit(1).select(similarity._scored(F.col("x"), F.col("y")).alias("e")).collect()] == [(1.0, 1.0)]


def test_best_of_several_names(spark):
    rows = spark.createDataFrame([(["b corp", "acme corp"], ["acme corp", "acme corps"]), (["acme corp"], []), ([], None), (["zebra"], ["acme corp"])], "x array<string>, y array<string>")
    got = [tuple(r["e"]) for r in rows.select(similarity.best_of(F.col("x"), F.col("y")).alias("e")).collect()]
    assert got == [(1.0, True), (None, None), (None, None), (similarity.name_score("zebra", "acme corp"), False)]


def test_plain_documents_are_judged_in_their_cells_and_others_joined(spark):
    """Documents with several names, and those with a key in common, are judged one way, all others the other way; together they give what a plain loop gives."""
    facts, rows = _facts(spark, 200)
    number = F.substring("document_id", 2, 4).cast("int")
    names = F.when(number % 5 == 0, F.array("entity", F.concat("entity", F.lit(" x")))).otherwise(F.array("entity"))
    facts = facts.withColumn("identifiers", F.when(number % 9 == 0, F.array(F.concat(F.lit("K"), (number % 4).cast("string")))).otherwise(F.col("identifiers"))).withColumn("names", names)
    want = {}
    for a in rows:
        for b in rows:
            if a[1] != "INVOICE" or b[1] == "INVOICE":
                continue
            k, m = int(a[0][1:]), int(b[0][1:])
            own, other = ([r[7], r[7] + " x"] if int(r[0][1:]) % 5 == 0 else [r[7]] for r in (a, b))
            near = abs(a[4] - b[4]) <= max(a[4], b[4]) * 0.02 + 1e-9 and (not a[5] or not b[5] or a[5] == b[5])
            name = max(similarity.name_score(x, y) for x in own for y in other)
            score = 0.6 * (k % 9 == 0 and m % 9 == 0 and k % 4 == m % 4) + 0.2 * name + 0.15 * near + 0.05 * max(0, 1 - abs((a[6] - b[6]).days) / 90)
            if score >= 0.35:
                want[min(a[0], b[0]), max(a[0], b[0])] = round(score, 3)
    got = [((r.left_id, r.right_id), r.score) for r in linking.link_evidence(facts).collect()]
    assert len(got) == len(want) and all(abs(want[pair] - score) < 0.0011 for pair, score in got)
    met, graded = linking._candidates(linking.evidence_values(facts), linking.LinkingConfig())
    graded = {(min(r.a, r.b), max(r.a, r.b)) for r in graded.collect()}
    met = {tuple(r) for r in met.collect()}
    assert graded and met and not graded & met and all(int(a[1:]) % 5 and int(b[1:]) % 5 for a, b in graded)


def test_a_run_makes_only_what_is_asked_for(spark):
    facts, _ = _facts(spark, 60)
    run = reconcile.run(facts)
    found = {r.case_id for r in run.found.collect()}
    assert found and not {"roots", "groups"} & set(vars(run))
    assert {r.case_id for r in run.cases.collect()} == found == {c for r in run.transactions.collect() for c in r.case_ids}


def test_some_unsure_links_tell_which_documents_have_one(spark, monkeypatch):
    """Without all unsure links: all linked pairs, all pairs of the documents named, and for every other document one at each end where it has any."""
    facts, rows = _facts(spark, 900)
    number = F.substring("document_id", 2, 4).cast("int")
    facts = facts.withColumn("identifiers", F.when(number % 9 == 0, F.array(F.concat(F.lit("K"), number.cast("string")))).otherwise(F.col("identifiers")))
    every = {(r.left_id, r.right_id): (r.status, r.score) for r in linking.link_evidence(facts).collect()}
    named = {f"d{k:04d}" for k in range(0, 900, 50)}
    full = spark.createDataFrame([(n,) for n in sorted(named)], "document_id string")
    for tested, scored in ((linking.TESTED, linking.SCORED), (500, 2000)):
        monkeypatch.setattr(linking, "TESTED", tested)
        monkeypatch.setattr(linking, "SCORED", scored)
        few = {(r.left_id, r.right_id): (r.status, r.score) for r in linking.link_evidence(facts, full=full).collect()}
        assert len(few) < len(every) and few.items() <= every.items()
        assert {p for p, s in every.items() if s[0] == "LINKED" or named & set(p)} <= few.keys()
        for end in (0, 1):
            assert {p[end] for p, s in every.items() if s[0] == "AMBIGUOUS"} == {p[end] for p, s in few.items() if s[0] == "AMBIGUOUS"}


def test_statuses_do_not_need_all_unsure_links(spark):
    facts, _ = _facts(spark, 300)
    cases = [r.case_id for r in reconcile.run(facts).found.where("case_type = 'ambiguous_link'").orderBy("case_id").collect()]
    kinds = "id long, case_id string, action string, field string, corrected_value string"
    reviews = [(k, c, ("ACCEPT", "REJECT", "CORRECT")[k % 3], "category", "Fixed") for k, c in enumerate([*cases[::7], "link:a|b|c", "link:a", "pair:x|y"])]
    reviews = spark.createDataFrame(reviews, kinds)
    assert {r.document_id for r in reconcile.reviewed_documents(reviews).collect()} == {d for c in cases[::7] for d in c[5:].split("|")} | {"a", "b|c", "a|b", "c"}
    run, whole = reconcile.run(facts, actions=reviews), reconcile.run(facts)

    def status(groups, cases):
        return sorted((r.transaction_id, r.verification_status, r.category, r.n_corrections) for r in gate.with_status(groups, cases, reviews).collect())

    assert status(run.groups, run.told) == status(whole.groups, whole.cases) and "links" not in vars(run)
    reviewed = [sorted((r.case_id, r.status) for r in gate.case_queue(gate.reviewed_cases(c, reviews), "reviewed").collect()) for c in (run.telling, whole.found)]
    assert reviewed[0] == reviewed[1] and len(reviewed[0]) == len(cases[::7])
    share = [gate.review_efficiency(gate.reviewed_cases(c, reviews), whole.groups).collect() for c in (run.telling, whole.found)]
    assert share[0] == share[1] and run.telling.count() < whole.found.count()


def _cell_sides(n, seed):
    draw = random.Random(seed)

    def side(own, kind):
        rows = []
        for k in range(n):
            name = "".join(draw.choice("abcd") for _ in range(4)) + " " + "".join(draw.choice("abcd") for _ in range(3)) + draw.choice([" corp", "", " of a longer name"])
            rows.append({own: f"{draw.choice('ab')}{kind}{k}", "name": name, "amount": draw.randrange(9500, 10500) / 10, "currency": draw.choice(["USD", "EUR", None]), "day": draw.randrange(37), "key": f"K{k}" if k % 9 == 0 else None, "full": k % 50 == 0})
        return pa.Table.from_pylist(rows)

    left, right = side("a", "i"), side("b", "l").append_column("kind", pa.array(["LEDGER"] * n))
    return [t.append_column(c, t["amount"]) for t, c in ((left, "x"), (right, "y"))]


def test_sifted_cells_lose_no_link_and_score_few_names(monkeypatch):
    config, scored = linking.LinkingConfig(), []
    own = similarity.Scorer.name_scores
    monkeypatch.setattr(similarity.Scorer, "name_scores", lambda self, x, y, least=None: scored.append(len(x)) or own(self, x, y, least))
    left, right = _cell_sides(900, 3)

    def found(kernel, sides):
        scored.clear()
        rows = kernel(*sides, config).to_pylist()
        total = [0.15 + 0.2 * r["entity_score"] + 0.05 * (1 - r["days"] / 90) for r in rows]
        pairs = [(r["a"], r["b"]) for r in rows]
        assert len(pairs) == len(set(pairs))
        return {p for p, s in zip(pairs, total) if s >= 0.38}, {p for p, s in zip(pairs, total) if s < 0.38}, sum(scored)

    every = found(linking._alike, [t.drop_columns("full") for t in (left, right)])
    few = found(linking._firm, (left, right))
    assert few[0] == every[0] and len(every[0]) > 50 and few[1] < every[1] and few[2] < every[2] / 3
    for end, side in enumerate((left, right)):
        met, served = ({p[end] for p in of[1]} for of in (every, few))
        assert served <= met and len(served) > 0.9 * len(met)
        # What is lacking is found by testing all pairs of the documents that lack it.
    lacks = [t.append_column("lacks", pa.array([3 * (k % 7 == 0) for k in range(t.num_rows)])) for t in (left, right)]
    rest = found(linking._lacking, lacks)
    asked = [{r[c] for k, r in enumerate(t.to_pylist()) if k % 7 == 0} for t, c in ((left, "a"), (right, "b"))]
    full = [set(t.filter(t["full"])[c].to_pylist()) for t, c in ((left, "a"), (right, "b"))]
    assert rest[1] <= every[1] and {p for p in every[1] if p[0] in full[0] or p[1] in full[1]} <= rest[1]
    for end in (0, 1):
        assert {p[end] for p in every[1]} & asked[end] == {p[end] for p in rest[1]} & asked[end]


def test_letters_in_common_are_never_undercounted():
    texts = [t for t in _texts(200) if len(t) <= similarity.WORD]
    sieve, every = similarity.Sieve(texts), np.arange(len(texts))
    least = [[sum(min(a.count(c), b.count(c)) for c in set(a)) for b in texts] for a in texts]
    assert (sieve.common(every, every) >= np.array(least)).all() and sieve.whole and not similarity.Sieve([*texts, "a" * 65]).whole


def test_components_that_are_done_leave_the_rounds(spark, monkeypatch):
    draw = random.Random(4)
    path = [(f"p{k:02d}", f"p{k + 1:02d}") for k in range(40)]
    edges = path + [(f"s{k}a", f"s{k}b") for k in range(60)] + [(f"r{draw.randrange(40):02d}", f"r{draw.randrange(40):02d}") for _ in range(35)] + [("x", "x")]
    root = {n: n for e in edges for n in e} | {"alone": "alone"}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    sizes, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: sizes.append(df.count()) or cut(df) if "far" in df.columns else cut(df))
    nodes = spark.createDataFrame([(n,) for n in root], "id string")
    got = components.components(nodes, spark.createDataFrame(edges, "left_id string, right_id string"))
    assert {r.id: r.root for r in got.collect()} == root and got.count() == len(root)
    assert sizes[0] > 2 * 100 and min(sizes[1:]) <= 80 and len(sizes) < 16  # pairs are settled at once, and the path in few rounds


def test_equal_names_are_judged_where_they_meet(spark):
    """Pairs of one name are as many as the square of its documents, so none of them is shuffled once more or joined with its facts again."""
    facts, _ = _facts(spark, 120)
    number = F.substring("document_id", 2, 4).cast("int")
    keys = F.when(number % 9 == 0, F.array(F.concat(F.lit("K"), (number % 4).cast("string")))).otherwise(F.col("identifiers"))
    facts = facts.withColumns({"entity": F.lit("acme corp"), "identifiers": keys})
    met, graded = linking._candidates(linking.evidence_values(facts), linking.LinkingConfig())
    met = {tuple(r) for r in met.collect()}
    graded = [(min(r.a, r.b), max(r.a, r.b)) for r in graded.collect()]
    assert met and all(int(n[1:]) % 9 == 0 for p in met for n in p) and len(graded) == len(set(graded)) > 50 and not met & set(graded)
    links = linking.link_evidence(facts).cache()
    assert set(graded) <= {(r.left_id, r.right_id) for r in links.collect()} and links.where("entity_score < 1 OR NOT entity_match").isEmpty()
    ends = [r.left_id for r in links.where("status = 'LINKED'").collect()]
    judged = {(r.left_id, r.right_id): r.status for r in linking.competition(links).collect()}
    want = {(r.left_id, r.right_id): "AMBIGUOUS" if ends.count(r.left_id) != 1 else r.status for r in links.collect()}
    assert judged == want and set(want.values()) == {"LINKED", "AMBIGUOUS"}
