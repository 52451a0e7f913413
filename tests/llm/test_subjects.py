import random

import pandas as pd

from cairn.llm import queries, subjects

TERMS = {"law": ["court", "appeal", "verdict", "statute", "lawsuit"], "sport": ["goal", "league", "referee", "coach", "medal"]}
PLAIN = ["We saw the {} today.", "There is news on the {} again.", "Nobody asked about that {}!", "Reports mention the {} in town."]
FILL = ["kite", "road", "lamp", "table", "river", "cloud"]
SCHEMA = "doc_id bigint, text string, lang string, items string, n int"


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        about = rng.choice(["law", "sport", "law+sport", "none"])
        mix = {"law": ["law"] * 6 + ["sport"], "sport": ["sport"] * 6 + ["law"], "law+sport": ["law", "sport"] * 4, "none": []}[about]
        sentences = [rng.choice(PLAIN).format(rng.choice(TERMS[m])) for m in mix] + [rng.choice(PLAIN).format(rng.choice(FILL)) for _ in range(2)]
        rng.shuffle(sentences)
        rows.append((i, " ".join(sentences), rng.choice(["en", "EN", None, "de"]), "x", 1))
        truth[i] = set() if about == "none" else set(about.split("+"))
    return rows, truth


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([("law", "x"), ("sport", "y")], "subject string, title string"))


def test_held_out(spark):
    rows, truth = corpus(400)
    labels = [(i, s.upper() + " ") for i in range(60) for s in truth[i]] + [(i, None) for i in range(60) if not truth[i]] + [(3, "nonsense"), (None, "law")]
    labels += labels[:5]
    got = {}
    for r in subjects.subjects(*frames(spark, rows, labels)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    hits = sum(len(truth[i] & got.get(i, set())) for i in range(60, 400))
    size = sum(len(truth[i]) + len(got.get(i, set())) for i in range(60, 400))
    assert 2 * hits / size > 0.95


def test_given_labels(spark, folder):
    labels = pd.read_parquet(f"{folder}/subject_labels.parquet")
    got = queries.p9_found(spark, folder).toPandas()
    assert not got.duplicated().any()
    told = set(zip(labels.doc_id, labels.subject.str.strip().str.lower().fillna(""))) - {(i, "") for i in labels.doc_id}
    mine = set(zip(got.doc_id, got.subject))
    mine = {x for x in mine if x[0] in set(labels.doc_id)}
    assert 2 * len(told & mine) / (len(told) + len(mine)) > 0.8


def test_odd_documents(spark):
    rows, truth = corpus(120)
    rows += [(1001, None, None, "x", 1), (1002, "", "en", "x", 1), (1003, " \n ... 123", "en", "x", 1), (1004, "We saw the verdict today. " * 20_000, "en", "x", 1), (1005, "https://law.test/court", "en", "x", 1)]
    labels = [(i, s) for i in range(120) for s in truth[i]]
    got = {(r.doc_id, r.subject) for r in subjects.subjects(*frames(spark, rows, labels)).where("doc_id > 1000").collect()}
    assert got == {(1004, "law")}


def test_empty_tables(spark):
    rows, truth = corpus(5)
    for r, t in ((rows, []), ([], [(1, "law")]), (rows, [(1, None)])):
        assert subjects.subjects(*frames(spark, r, t)).count() == 0
    docs, labels, areas = frames(spark, rows, [(1, "law")])
    assert subjects.subjects(docs, labels, areas.limit(0)).count() == 0


def test_sentences_and_longer_rules(spark):
    assert subjects.sentence_words("[00:07] NAME: The Court&amp;rose. x\n> Next line, ｆｕｌｌ https://a.test/court") == [["the", "court", "rose"], ["next", "line", "full"]]
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(80):
        pair = rng.choice([("alpha", "beta"), ("gamma", "delta"), ("alpha", "delta"), ("gamma", "beta")])
        rows.append((i, f"Here {pair[0]} met {pair[1]}. " * 3, "en", "x", 1))
        labels.append((i, "law" if pair in (("alpha", "beta"), ("gamma", "delta")) else "sport"))
    got = {r.doc_id: r.subject for r in subjects.subjects(*frames(spark, rows, labels)).collect()}
    assert sum(got.get(i) == s for i, s in labels) > 70  # neither word tells the subject alone
