"""Toxicity by a weighted finite-state grammar over clauses.

Lexical transducers turn the words of a clause into symbols: insult, threat, target, negation,
reported speech, other. Small automata follow each kind of symbol: whether speech is reported,
whether someone is addressed, whether a negation still reaches, and what became of insults and
threats. Their composition is compiled to one table, so a clause is read once from left to right;
where it ends, the state says what the clause is (a bare insult, a negated one, an insult at
someone, a reported threat ...). A document's score is logistic in the weights of its clauses.

The insult lexicon (words and stems) and the clause weights are learned from labels; threats,
targets, negations and reporting verbs are closed classes and given.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, per_batch, text_or_empty

# Closed word classes in English, German, French and Spanish.
TARGETS = "you your yours yourself he she they him them du dich dir dein deine ihr euch sie tu toi ton ta vous votre il elle eux tú te ti tu usted ustedes vosotros él ella ellos".split()
NEGATIONS = "not no never nor without hardly don't isn't aren't wasn't kein keine nicht nie niemals ohne ne pas jamais sans no nunca jamás sin".split()
REPORTS = "said says say saying claimed claims called wrote quoted reported sagte sagt behauptet schrieb nannte dit disait écrit affirme dijo dice escribió afirma llamó".split()
THREATS = "kill killing murder destroy strangle stab umbringen töten erschlagen vernichten tuer égorger massacrer matar asesinar degollar".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
NONE, PLAIN, NEGATED = range(3)
#: Words that a negation reaches.
REACH = 3
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Labelled documents that the lexicon and the weights are fitted on at most, those with the smallest hashes.
SAMPLE = 20_000
#: A stem is from 4 to 8 letters long. It or a word may enter the lexicon if it is in this many toxic
#: documents, in this share of them, and in this many times the share of the others.
STEMS, SUPPORT, SHARE, LIFT = range(4, 9), 3, 0.005, 20.0
#: An entry that a document holds besides k others counts for it as this to the power k.
FADE = 0.6
#: How much a document that isn't toxic takes from an entry that it holds.
PENALTY = 3.0


@dataclass(frozen=True)
class State:
    """A state of the composed transducer."""

    reported: int = 0
    addressed: int = 0
    reach: int = 0
    insult: int = NONE
    threat: int = NONE

    def after(self, symbol: int) -> State:
        reach = REACH if symbol == NEGATION else max(0, self.reach - 1)
        mark = NEGATED if self.reach else PLAIN

        def seen(old: int, kind: int) -> int:
            return old if symbol != kind else PLAIN if PLAIN in (old, mark) else NEGATED

        return State(
            self.reported or int(symbol == REPORT), self.addressed or int(symbol == TARGET), reach,
            seen(self.insult, INSULT), seen(self.threat, THREAT),
        )

    def clause(self) -> int | None:
        """The kind of clause that ends here, None for one with neither insult nor threat."""
        if self.insult == NONE and self.threat == NONE:
            return None
        return ((self.insult * 3 + self.threat) * 2 + self.addressed) * 2 + self.reported


def machine() -> tuple[list[list[int]], list[int | None]]:
    """The composition as tables: next state by state and symbol, and the output at the clause's end."""
    states, table, at = [State()], [], 0
    number = {State(): 0}
    while at < len(states):
        row = []
        for symbol in range(6):
            following = states[at].after(symbol)
            if following not in number:
                number[following] = len(states)
                states.append(following)
            row.append(number[following])
        table.append(row)
        at += 1
    return table, [s.clause() for s in states]


KINDS = 36


def prior_weights() -> np.ndarray:
    """What the clause kinds weigh before any label is seen: negation and report take away, an
    addressed person adds."""
    weights = np.zeros(KINDS)
    for insult, threat, addressed, reported in product(range(3), range(3), range(2), range(2)):
        force = {NONE: 0.0, PLAIN: 3.0, NEGATED: 1.0}
        weights[((insult * 3 + threat) * 2 + addressed) * 2 + reported] = (
            force[insult] + force[threat] * 1.5 + 0.5 * addressed - 1.0 * reported
        ) if insult or threat else 0.0
    return weights


@dataclass
class Grammar:
    """The lexicon (``words`` and ``stems``) and the weights; small and the same size for any corpus."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=prior_weights)
    bias: float = -4.0

    def __post_init__(self):
        self.classes = {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        self.finder = None
        self.machine = machine()

    def symbol(self, word: str) -> int:
        if word in self.words or any(word[:n] in self.stems for n in STEMS):
            return INSULT
        return self.classes.get(word, OTHER)

    def clauses(self, text: str) -> Counter:
        """How many clauses of each kind a text has. Only clauses with an insult or a threat are
        walked, as the others have no output."""
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for entry in {*self.words, *self.stems, *THREATS}:
                self.finder.add_word(entry, len(entry))
            self.finder.make_automaton()
        table, output = self.machine
        found, text, upto = Counter(), text.lower(), -1
        for end, length in self.finder.iter(text):
            begin = end - length + 1
            if begin < upto or begin and text[begin - 1].isalnum():
                continue
            start = max(text.rfind(c, 0, begin) for c in ".!?;\n") + 1
            stops = [p for c in ".!?;\n" if (p := text.find(c, end, end + 2000)) >= 0]
            upto = min(stops) if stops else next((m.start() for m in re.compile(r"[.!?;\n]").finditer(text, end)), len(text))
            state = 0
            for word in WORD.findall(text, start, upto):
                state = table[state][self.symbol(word)]
            if (kind := output[state]) is not None:
                found[kind] += 1
        return found

    def score(self, clauses: Counter) -> float:
        z = self.bias + sum(self.weights[k] * (1.0 + math.log(n)) for k, n in clauses.items())
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set[str]:
    """The words of a text and, marked by '*', their stems."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def counted_terms(sample: DataFrame, wanted: frozenset[str] | None, toxic: int) -> DataFrame:
    """``term, n``: in how many sample documents of a label each (wanted) term is."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def one(batch: pa.RecordBatch) -> dict:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            terms = _terms(text)
            counts.update(terms if wanted is None else terms & wanted)
        return {"term": list(counts), "n": list(counts.values())}

    rows = sample.filter(F.col("toxic") == toxic).select("text").mapInArrow(per_batch(one, schema), schema)
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that explain why documents are toxic.

    Candidates are far commoner in toxic documents than in others. Many are there by chance of
    copied texts only, so entries are chosen one by one for the toxic documents they add, less those
    of other documents, a document counting less the more entries it already holds, until the next
    would add too few.
    """
    least = max(SUPPORT, math.ceil(SHARE * n_toxic))
    seen = {r["term"]: r["n"] for r in counted_terms(sample, None, 1).filter(F.col("n") >= least).collect()}
    clean = {r["term"]: r["n"] for r in counted_terms(sample, frozenset(seen), 0).collect()}
    lift = {t: (n / n_toxic) / ((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in seen.items()}
    candidates = frozenset(t for t in lift if lift[t] >= LIFT)
    schema = T.StructType([T.StructField("terms", T.ArrayType(T.StringType()))])
    found = sample.filter("toxic = 1").select("text").mapInArrow(per_batch(
        lambda b: {"terms": [sorted(_terms(t) & candidates) for t in b.column(0).to_pylist()]}, schema), schema)
    holders: dict[str, list[int]] = {}
    for doc, row in enumerate(sorted(r["terms"] for r in found.collect())):  # of the bounded sample
        for term in row:
            holders.setdefault(term, []).append(doc)
    rows = {t: np.array(d) for t, d in holders.items()}
    worth = np.ones(n_toxic + 1)
    words, stems = {}, {}
    while rows:
        # Of equals the longer entry, as it says more, and a stem before the word it is all of.
        gain, _, _, best = max((round(worth[d].sum() - PENALTY * clean.get(t, 0), 9), len(t.rstrip("*")), t.endswith("*"), t) for t, d in rows.items())
        if gain < least:
            break
        worth[rows.pop(best)] *= FADE
        (stems if best.endswith("*") else words)[best.rstrip("*")] = math.log(lift[best])
        inside = best.rstrip("*")
        rows = {t: d for t, d in rows.items() if not (
            t.rstrip("*").startswith(inside) and best.endswith("*") or t.endswith("*") and inside.startswith(t[:-1])
        )}
    return words, stems


def fit_weights(counts: np.ndarray, labels: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights of the clause kinds by Newton steps, held near the prior ones."""
    x = np.hstack([np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0), np.ones((len(counts), 1))])
    prior = np.append(prior_weights(), -4.0)
    pull = np.append(np.full(KINDS, strength), 0.1)
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled documents that are not held out, equal texts once."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    )
    # At most ``most`` rows of two numbers, a bound that makes the broadcast safe.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(
        F.broadcast(chosen), "doc_id"
    ).withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy", "toxic"]).select("text", "toxic")


def held_out(doc_id):
    """The fifth of the documents that nothing is learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Grammar:
    """The grammar learned from the labels; without labels of both kinds, the closed classes and
    prior weights alone."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, most)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Grammar({}, {})
    words, stems = learn_lexicon(sample, sizes[1], sizes[0])
    grammar = Grammar(words, stems)
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.IntegerType()))])

    def one(batch: pa.RecordBatch) -> dict:
        own = Grammar(words, stems)
        rows = [own.clauses(t) for t in batch.column("text").to_pylist()]
        return {"toxic": batch.column("toxic"), "kinds": [[r.get(k, 0) for k in range(KINDS)] for r in rows]}

    # Equal histograms are counted before they leave the cluster.
    rows = sample.select("text", "toxic").mapInArrow(per_batch(one, schema), schema).groupBy("toxic", "kinds").count().collect()
    counts = np.repeat([r["kinds"] for r in rows], [r["count"] for r in rows], axis=0)
    toxic = np.repeat([r["toxic"] for r in rows], [r["count"] for r in rows])
    grammar.weights, grammar.bias = fit_weights(counts, toxic)
    return grammar


def with_score(docs: DataFrame, grammar: Grammar, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of the documents and the score of their whole texts; NULL text is empty."""
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(name, T.DoubleType())])
    words, stems, weights, bias = grammar.words, grammar.stems, grammar.weights, grammar.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(words, stems, weights, bias)
        step = per_batch(lambda b: {
            **{c: b.column(n) for n, c in enumerate(columns)},
            name: [own.score(own.clauses(t)) for t in b.column(len(columns)).to_pylist()],
        }, schema)
        yield from step(batches)

    bounded_batches(docs.sparkSession)
    return docs.select(*columns, text_or_empty().alias("__text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Reads ``doc_id`` and ``text``; labels are used for fitting only. NULL or empty texts have no
    clauses and get the score of the bias; a NULL id is not held out; repeated rows score alike; an
    empty table gives no rows.
    """
    rows = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, most), ["doc_id"])
    return rows.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that score below one half, with the columns they came with."""
    score = next(n for n in ("score", *(f"score_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    return with_score(docs, fit(docs, labels, most), docs.columns, score).filter(F.col(score) < 0.5).drop(score)
