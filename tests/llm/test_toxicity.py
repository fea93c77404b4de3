import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_precision_and_recall(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op5_toxicity_grammar(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    said = [r for r in rows if r.predicted]
    assert len(toxic) > 100
    recall, precision = np.mean([r.predicted for r in toxic]), np.mean([r.toxic for r in said])
    assert recall > 0.8 and precision > 0.95, (recall, precision)
    assert all(0 <= r.score <= 1 for r in rows)


def test_clauses():
    g = toxicity.Grammar({"idiot": 4.0})
    w = lambda t: sum(g.clauses(t))
    assert w("a b c") == 0 and w("the idiot") == 4 and w("you idiot") == 5 and w("idiot you") == 5
    assert w("not an idiot") == pytest.approx(1.6) and w("not a b c idiot") == 4
    assert w("he said idiot") == pytest.approx(2.5) and w("said idiot") == 2
    assert w('said: "you idiot" and you idiot') == pytest.approx(7.5)
    assert w("kill time") == pytest.approx(0.45) and w("kill you") == pytest.approx(1.5) and w("kill all of you") == pytest.approx(0.45)
    assert w("idiot idiot") == 6 and g.clauses("you idiot, not idiot") == [5, pytest.approx(1.6)]
    assert g.features("Idiot! IDIOT, fine.")[2] == pytest.approx(np.log(3))
    assert g.features(None) == g.features("") == (0, 0, 0)


def plain_clauses(g, sentence):
    """Every transducer by itself, one after the other, over the whole sentence."""
    path = [(c, x, 1.0) for c, x in [*g.symbols(sentence), ("break", 1.0)]]
    for name, make in toxicity.MACHINES.items():
        if name not in g.without:
            t = make()
            state, out = t.start, []
            for c, x, by in path:
                state, c, more = t.step(state, c)
                out.append((c, x, by * more))
            path = out
    clauses, weight, last = [], 0.0, {}
    for c, x, by in path:
        if c in ("insult", "threat"):
            last[c] = x * by / (toxicity.UNAIMED if c == "threat" else 1)
            weight += x * by
        elif c in ("victim", "aim"):
            weight += by * last.get("threat" if c == "victim" else "insult", 0)
        elif c == "break":
            clauses += [weight] if weight else []
            weight = 0.0
    return clauses


WORDS = ["idiot", "fool", "kill", "you", "not", "said", "x", "y", ",", ":", '"', "word"]


def sentences(n=400):
    rng = np.random.default_rng(4)
    return [" ".join(rng.choice(WORDS, rng.integers(1, 14))) for _ in range(n)]


def test_composition_equals_the_machines_one_by_one():
    for without in ((), ("negation",), ("report", "target")):
        g = toxicity.Grammar({"idiot": 4.0, "fool": 2.5}, without=without)
        assert all(g.clauses(s) == pytest.approx(plain_clauses(g, s)) for s in sentences())


def test_every_transducer_matters():
    whole = toxicity.Grammar({"idiot": 4.0, "fool": 2.5})
    for name in toxicity.MACHINES:
        part = toxicity.Grammar({"idiot": 4.0, "fool": 2.5}, without=(name,))
        assert sum(whole.clauses(s) != part.clauses(s) for s in sentences()) > 20, name


def test_classes_are_learned(spark):
    rows = [(k, f"so {'you' if k % 2 else 'blorg'} are bad word{k % 5} here", 1) for k in range(60)]
    rows += [(100 + k, f"it is hardly bad at all word{k % 5} here", 0) for k in range(40)]
    rows += [(200 + k, f"a calm word{k % 5} here is it so are at all", 0) for k in range(300)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.grammar.insults) == {"bad", "blorg"} or set(model.grammar.insults) == {"bad"}
    assert "hardly" in model.grammar.learned["negation"]
    calm, bad = model.scores(["it is hardly bad", "you are bad"])
    assert calm < bad


def test_edge_rows(spark):
    docs = spark.createDataFrame([(k, f"{'bad ' if k % 3 == 0 else ''}word {k}", "q") for k in range(60)] + [(None, None, "q"), (61, "", None), (61, "bad " * 30_000, None)], "doc_id long, text string, TOXIC string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.grammar.insults) == {"bad"}
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    assert all((r.score >= 0.7) == ("bad" in (r.text or "")) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] <= 0.5
