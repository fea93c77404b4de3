"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words into weighted classes. Five transducers over the classes (negation, reported
speech, threat, target and insult) are composed into one machine, which a sentence runs through
from left to right; a clause weighs what its matches put out. A document's score is a logistic
function of its clause weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

SENTENCE = re.compile(r"[.!?\n]+")
#: A word, a mark that ends a clause, or a quotation mark.
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[;:,]|[\"“”«»]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
MARKS = {**dict.fromkeys(";:,", "break"), **dict.fromkeys('"“”«»', "quote")}

#: Words of the fixed classes.
TARGETS = "you your you're u he she they him her them this that these those who people everyone du dich dir sie ihr tu te toi vous il elle ils ustedes usted tú él ella ellos".split()
THREATS = "kill hurt destroy burn shoot stab beat punch strangle hang töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
NEGATIONS = "not no never don't isn't aren't wasn't won't can't cannot nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says say wrote writes claimed claims quoted quote called reported according sagte schrieb behauptet dit écrit selon dijo escribió según".split()

#: Words that a negation reaches, words that a threat or an insult waits for whom it is aimed at.
REACH, WAIT = 3, 2

#: Factors of negated and of reported matches, of insults that are aimed, of threats without a victim.
NEGATED, REPORTED, AIMED, UNAIMED = 0.4, 0.5, 1.25, 0.3

#: What the machines read, and what they put out besides: a match, or more of the last match of its kind.
CLASSES = ("other", "break", "quote", "target", "threat", "negation", "report", "insult")
MORE = ("victim", "aim")


@dataclass
class Transducer:
    """States and weighted arcs: ``arcs[state, symbol] = (state, symbol out, factor)``.

    A symbol without an arc passes through unchanged and leads to ``other[state]`` (the same
    state if there is none).
    """

    start: object
    arcs: dict = field(default_factory=dict)
    other: dict = field(default_factory=dict)

    def step(self, state, symbol: str):
        got = self.arcs.get((state, symbol))
        return got if got is not None else (self.other.get(state, state), symbol, 1.0)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One machine that does what ``second`` makes of the output of ``first``: states are pairs, factors multiply."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in (*CLASSES, *MORE):
            a2, middle, by = first.step(a, symbol)
            b2, out, more = second.step(b, middle)
            arcs[state, symbol] = ((a2, b2), out, by * more)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(start, arcs)


def negation() -> Transducer:
    """A negation weakens the matches in the next ``REACH`` words of its clause."""
    t = Transducer(0)
    for left in range(REACH + 1):
        after = max(0, left - 1)
        t.other[left] = after
        t.arcs[left, "negation"] = (REACH, "negation", 1.0)
        t.arcs[left, "break"] = (0, "break", 1.0)
        for c in ("insult", "threat"):
            t.arcs[left, c] = (after, c, NEGATED if left else 1.0)
    return t


def report() -> Transducer:
    """A reporting verb weakens what follows: to the end of the sentence, or of a quotation that opens after it."""
    t = Transducer("own")
    t.arcs["own", "report"] = ("told", "report", 1.0)
    t.arcs["told", "quote"] = ("quoted", "quote", 1.0)
    t.arcs["quoted", "quote"] = ("own", "quote", 1.0)
    for state in ("told", "quoted"):
        for c in ("insult", "threat"):
            t.arcs[state, c] = (state, c, REPORTED)
    return t


def threat() -> Transducer:
    """A threat counts in full only with a target in the next ``WAIT`` words of its clause, its victim."""
    t = Transducer(0, other={k: max(0, k - 1) for k in range(WAIT + 1)})
    for k in range(WAIT + 1):
        t.arcs[k, "threat"] = (WAIT, "threat", UNAIMED)
        t.arcs[k, "break"] = (0, "break", 1.0)
        if k:
            t.arcs[k, "target"] = (0, "victim", 1 - UNAIMED)
    return t


def target() -> Transducer:
    """An insult weighs more with a target before it in its clause, or in the next ``WAIT`` words."""
    t = Transducer("none")
    states = ["none", "seen", *range(1, WAIT + 1)]
    for s in states:
        t.arcs[s, "break"] = ("none", "break", 1.0)
        t.arcs[s, "insult"] = ("seen", "insult", AIMED) if s == "seen" else (WAIT, "insult", 1.0)
        t.arcs[s, "target"] = ("seen", "target", 1.0) if s in ("none", "seen") else ("seen", "aim", AIMED - 1)
        t.arcs[s, "victim"] = ("seen", "victim", 1.0)
        if s not in ("none", "seen"):
            t.other[s] = s - 1 if s > 1 else "none"
    return t


def insult() -> Transducer:
    """An insult right after another one is one phrase with it and counts half."""
    t = Transducer("plain", other={"after": "plain"})
    t.arcs["plain", "insult"] = ("after", "insult", 1.0)
    t.arcs["after", "insult"] = ("after", "insult", 0.5)
    return t


MACHINES = {"negation": negation, "report": report, "threat": threat, "target": target, "insult": insult}


@dataclass
class Grammar:
    """The composed machine and its lexicon: learned words of each class beside the fixed ones.

    ``without`` names transducers to leave out, for tests of what each of them does.
    """

    insults: dict[str, float]
    learned: dict[str, list[str]] = field(default_factory=dict)
    threat_weight: float = 1.5
    without: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        fixed = {"target": TARGETS, "threat": THREATS, "negation": NEGATIONS, "report": REPORTS}
        self.classes = {w: (c, 1.0) for c, words in fixed.items() for w in [*self.learned.get(c, ()), *words]}
        self.classes |= {w: ("threat", self.threat_weight) for w in [*self.learned.get("threat", ()), *THREATS]}
        self.classes |= {w: ("insult", x) for w, x in self.insults.items()}
        self.loaded = {w for w, (c, _) in self.classes.items() if c in ("insult", "threat")}
        self.machine = Transducer(None)
        for name, make in MACHINES.items():
            if name not in self.without:
                self.machine = compose(self.machine, make())

    def symbols(self, sentence: str) -> list[tuple[str, float]]:
        return [(MARKS[t], 1.0) if t in MARKS else self.classes.get(t, ("other", 1.0)) for t in TOKEN.findall(sentence)]

    def clauses(self, sentence: str) -> list[float]:
        """The weights of the clauses of a sentence that hold a match."""
        state, out, last = self.machine.start, [], {}
        weight = 0.0
        for symbol, own in [*self.symbols(sentence), ("break", 1.0)]:
            state, put, by = self.machine.step(state, symbol)
            if put in ("insult", "threat"):
                last[put] = own * by if put == "insult" else own * by / UNAIMED
                weight += own * by
            elif put == "victim":
                weight += last.get("threat", 0.0) * by
            elif put == "aim":
                weight += last.get("insult", 0.0) * by
            elif put == "break":
                if weight:
                    out.append(weight)
                weight = 0.0
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(heaviest clause, log of 1 + all weights, log of 1 + matched clauses) of a whole text."""
        weights = []
        for sentence in SENTENCE.split(text.lower()) if isinstance(text, str) else ():
            if not self.loaded.isdisjoint(WORD.findall(sentence)):
                weights += self.clauses(sentence)
        return max(weights, default=0.0), float(np.log1p(sum(weights))), float(np.log1p(len(weights)))

    def contexts(self, text: str) -> Counter:
        """How often the words of a text stand where a word of a class would matter: ``(class, word)`` and a number.

        Before an insult, within the reach of a negation (``negation``) or further off in its
        sentence (``report``); within two words of an insult (``target``); right before a target (``threat``).
        """
        found: Counter = Counter()
        for sentence in SENTENCE.split(text.lower()):
            words = WORD.findall(sentence)
            near: dict[str, set[int]] = {c: set() for c in ("negation", "report", "target", "threat")}
            for i, w in enumerate(words):
                if w in self.insults:
                    near["negation"].update(range(max(0, i - REACH), i))
                    near["report"].update(range(max(0, i - REACH)))
                    near["target"].update(range(max(0, i - WAIT), min(len(words), i + WAIT + 1)))
                elif self.classes.get(w, ("",))[0] == "target":
                    near["threat"].update(range(max(0, i - WAIT), i))
            for c, places in near.items():
                found.update((c, words[i]) for i in places if words[i] not in self.classes)
        return found


@dataclass
class Model:
    grammar: Grammar
    coef: np.ndarray  # intercept first

    def scores(self, texts) -> np.ndarray:
        x = np.array([self.grammar.features(t) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-(self.coef[0] + x @ self.coef[1:])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-4, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, min_docs: int = 3, min_weight: float = 2.0, context_docs: int = 10) -> Model:
    """Learn the lexicon and the logistic function from labelled texts.

    ``labels`` has a label 0 or 1 for ids of ``docs`` (null labels are left out, of several the
    highest counts); at most ``max_rows`` labelled ids are used, those of the smallest hashes.
    A word is an insult if ``min_docs`` toxic texts hold it and the log-odds of holding it are
    ``min_weight`` higher than for clean texts; that difference is its weight. The other classes
    get words of their own if ``context_docs`` texts hold them where such a word would matter
    (:meth:`Grammar.contexts`), with the same difference of log-odds, and half their occurrences
    in texts of that label are so placed: negations and reporting verbs are found in clean texts,
    targets and threats in toxic ones. Texts of
    any length are read whole; equal rows count as often as they occur. Without labels every
    score is 0.5 or less.
    """
    some = labels.where(column(labels, label_col).isNotNull() & column(labels, id_col).isNotNull())
    some = some.groupBy(column(some, id_col).alias("label_id")).agg(F.max(column(some, label_col)).alias("label"))
    some = some.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    text = column(docs, text_col)
    rows = docs.select(column(docs, id_col).alias("label_id"), text.alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(some), "label_id").select("label", "text").persist()  # max_rows rows at most

    def count(of):
        """Counts, for each key that ``of`` finds in a text: toxic and clean texts, and occurrences in both."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            texts, times = (Counter(), Counter()), (Counter(), Counter())
            for pdf in batches:
                for label, t in pdf.itertuples(index=False):
                    found = of(t)
                    texts[int(label > 0)].update(found.keys())
                    times[int(label > 0)].update(found)
            every = list(texts[0] | texts[1])
            got = {n: [c[k] for k in every] for n, c in (("toxic", texts[1]), ("clean", texts[0]), ("toxic_n", times[1]), ("clean_n", times[0]))}
            if every:
                yield pd.DataFrame({"kind": [k for k, _ in every], "word": [w for _, w in every], **got}, dtype=object)

        got = rows.mapInPandas(run, "kind string, word string, toxic long, clean long, toxic_n long, clean_n long")
        return got.groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_n", "clean_n")])

    total = {r.label > 0: r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(True, 0), total.get(False, 0)
    words = count(lambda t: Counter(("", w) for w in WORD.findall(t.lower()))).drop("kind")
    weight = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    insults = words.where(F.col("toxic") >= min_docs).select("word", weight.alias("weight")).where(F.col("weight") >= min_weight)
    fixed = {*TARGETS, *NEGATIONS, *REPORTS}
    first = Grammar({r.word: r.weight for r in insults.orderBy("word").collect() if r.word not in fixed})

    placed = count(first.contexts)
    calms = F.col("kind").isin("negation", "report")
    own = F.when(calms, F.col("clean")).otherwise(F.col("toxic"))
    strong = F.when(calms, -weight).otherwise(weight) >= min_weight
    placed = placed.where((own >= context_docs) & strong).select("kind", "word", calms.alias("calms"), F.when(calms, F.col("clean_n")).otherwise(F.col("toxic_n")).alias("here"))
    anywhere = F.when(F.col("calms"), F.col("clean_n")).otherwise(F.col("toxic_n"))
    placed = placed.join(words, "word").where(2 * F.col("here") >= anywhere)
    learned: dict[str, list[str]] = {}
    for r in placed.select("kind", "word").orderBy("kind", "word").collect():  # words of the sample
        learned.setdefault(r.kind, []).append(r.word)
    grammar = Grammar(first.insults, learned)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([grammar.features(t) for t in pdf["text"]], columns=["a", "b", "c"])
            yield got.assign(y=(pdf["label"].to_numpy() > 0).astype(float))

    x = rows.mapInPandas(measure, "a double, b double, c double, y double").toPandas().sort_values(["a", "b", "c", "y"])
    rows.unpersist()
    coef = logistic(x[["a", "b", "c"]].to_numpy(), x["y"].to_numpy()) if len(x) else np.array([-5.0, 1.0, 1.0, 1.0])
    return Model(grammar, coef)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score (0 to 1) of each whole text, null and empty ones included.

    Every row stays; equal texts have equal scores, texts of any length are read whole, an empty
    table gives an empty one. The name of the new column must be new.
    """
    if score_out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{score_out} is a column already")

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return docs.withColumn(score_out, rate(column(docs, text_col)))
