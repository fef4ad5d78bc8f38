"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon learned from labels.

A text becomes a sequence of symbols: its words are looked up (insult, threat, target, negation, report or other), and quotes and the ends of
clauses are symbols too. Five weighted transducers read a clause, each the output of the one before:

    threat     a threatening verb near a target becomes a threat; alone it is an ordinary word
    insult     the second and third insult of a clause weigh less, later ones nothing
    target     an insult or threat near a target weighs more
    negation   one shortly after a negation weighs less
    reported   one after a verb of speech, or between quotes, weighs less

They are deterministic and total, so their composition is one table of (state, symbol), made once. A clause scores the weights
of its insults and threats times the weights of the arcs they pass. A logistic model turns the matched clauses of a document into its score.

Weights of words and of word beginnings come from a bounded sample of labelled documents: Spark counts in how many toxic and other ones
each occurs, and those that stand out enter the lexicon with their cautious log odds. The words that the module knows enter as
if they had been seen in a few toxic documents. The logistic model is fitted on the sample with the lexicons of the other folds, so that it meets words the
way new texts will. Scoring is a table walk per clause with a match; documents are scored where they are, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import hashed, slices
from weftgraph.session import cut

SAMPLE = 20_000  # labelled documents learned from, half of them toxic if there are as many
FOLDS = 4
STEMS = range(3, 9)  # lengths of word beginnings
SEEN = 3  # toxic documents that a word of the lexicon stands in
EVIDENCE = 20.0  # least log likelihood ratio of a word's counts
PRIOR = 2.0  # toxic documents that a known word counts as seen in
MEMO = 200_000  # words whose symbols a task remembers

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK = range(8)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”„«»]")
NEAR = 4  # words
REPEATED = (1.0, 0.5, 0.25, 0.0)  # the first, second, ... insult of a clause
DIRECTED, DENIED, REPORTED, QUOTED = 1.5, 0.25, 0.4, 0.7
THREAT_WEIGHT = 3.0

KNOWN = {
    INSULT: "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown fool vermin filth "
            "dummkopf trottel abschaum versager dumm widerlich crétin imbécile ordure minable stupide estúpido imbécil basura escoria",
    THREAT: "kill hurt destroy burn stab shoot beat die töten umbringen verletzen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours he him she her they them these those du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos ellas",
    NEGATION: "not no never neither nor cannot don doesn didn isn aren wasn weren won nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says say wrote writes claimed called asked replied quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó",
}


class Transducer:
    """A deterministic, total weighted transducer: ``arcs[state][symbol]`` is (next state, output symbol, weight); state 0 begins."""

    def __init__(self, arcs: list[list[tuple[int, int, float]]]):
        self.arcs = arcs

    @classmethod
    def of(cls, step, start=0) -> Transducer:
        """The machine of ``step(state, symbol)`` over all states reached from ``start``, which a BREAK returns to."""
        number, states, arcs = {start: 0}, [start], []
        for state in states:
            row = []
            for symbol in range(BREAK + 1):
                to, out, weight = (start, BREAK, 1.0) if symbol == BREAK else step(state, symbol)
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                row.append((number[to], out, weight))
            arcs.append(row)
        return cls(arcs)

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes, and weights multiply."""

        def step(state, symbol):
            mine, out, weight = self.arcs[state[0]][symbol]
            theirs, out, more = other.arcs[state[1]][out]
            return (mine, theirs), out, weight * more

        return Transducer.of(step, (0, 0))

    def read(self, symbols, weights) -> list[float]:
        """The score of every clause with a match: the weights of insults and threats, times those of their arcs."""
        state, total, out = 0, 0.0, []
        for symbol, weight in zip(symbols, weights, strict=True):
            state, written, factor = self.arcs[state][symbol]
            if written in (INSULT, THREAT):
                total += factor * (weight if written == INSULT else THREAT_WEIGHT)
            elif written == BREAK and total:
                out.append(total)
                total = 0.0
        return [*out, total] if total else out


def _threat(state, symbol):
    kind, left = state or (None, 0)
    further = (kind, left - 1) if left > 1 else None
    if symbol == THREAT:
        return (None, THREAT, 1.0) if kind == TARGET else ((THREAT, NEAR), OTHER, 1.0)
    if symbol == TARGET:
        return (None, THREAT, 1.0) if kind == THREAT else ((TARGET, NEAR), TARGET, 1.0)
    return further, symbol, 1.0


def _insult(state, symbol):
    if symbol != INSULT:
        return state, symbol, 1.0
    return min(state + 1, len(REPEATED) - 1), INSULT, REPEATED[state]


def _after(opening: int, factor: float):
    """Insults and threats up to NEAR words after the symbol ``opening`` are weighted by ``factor``."""

    def step(state, symbol):
        if symbol == opening:
            return NEAR, symbol, 1.0
        return max(state - 1, 0), symbol, factor if state and symbol in (INSULT, THREAT) else 1.0

    return step


def _reported(state, symbol):
    said, quoted = state
    if symbol == REPORT:
        said = 1
    elif symbol == QUOTE:
        quoted = 1 - quoted
    factor = REPORTED if said else QUOTED if quoted else 1.0
    return (said, quoted), symbol, factor if symbol in (INSULT, THREAT) else 1.0


def grammar() -> Transducer:
    return (Transducer.of(_threat, None).then(Transducer.of(_insult)).then(Transducer.of(_after(TARGET, DIRECTED)))
            .then(Transducer.of(_after(NEGATION, DENIED))).then(Transducer.of(_reported, (0, 0))))


FIXED = {word: symbol for symbol, listed in KNOWN.items() if symbol != INSULT for word in listed.split()}
INSULTS = frozenset(KNOWN[INSULT].split())


class Lexicon(dict):
    """Symbol and weight of a token, remembered; ``entries`` has the weights of whole words (``=word``) and of beginnings."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= MEMO:
            self.clear()
        self[token] = found = self._look(token)
        return found

    def _look(self, token: str) -> tuple[int, float]:
        if token in ".!?;\n":
            return BREAK, 0.0
        if not token[0].isalpha():
            return QUOTE, 0.0
        whole = self.entries.get("=" + token, 0.0)
        if not whole and token in FIXED:
            return FIXED[token], 0.0
        weight = max([whole, *[self.entries.get(token[:k], 0.0) for k in STEMS if k <= len(token)]])
        return (INSULT, weight) if weight else (OTHER, 0.0)


def clause_scores(text: str, lexicon: Lexicon, machine: Transducer) -> tuple[list[float], int]:
    """(score of every matched clause, number of words and marks)."""
    found = list(map(lexicon.__getitem__, TOKEN.findall(text.lower())))
    symbols = [s for s, _ in found]
    if INSULT not in symbols and THREAT not in symbols:
        return [], len(symbols)
    return machine.read(symbols, [w for _, w in found]), len(symbols)


FEATURES = 4


def features(text: str | None, lexicon: Lexicon, machine: Transducer) -> list[float]:
    scores, n = clause_scores(text or "", lexicon, machine)
    total = sum(scores)
    return [math.log1p(total), max(scores, default=0.0), math.log1p(len(scores)), 10 * total / (10 + n)]


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=lambda: {"=" + w: 2.0 for w in INSULTS})
    bias: float = -3.0
    slopes: tuple[float, ...] = (1.0, 0.5, 0.5, 0.0)


def tokens_of(text: str) -> set[str]:
    """The different words of a text, marked by =, and their beginnings."""
    found = {w for w in TOKEN.findall(text.lower()) if w[0].isalpha()}
    return {"=" + w for w in found} | {w[:k] for w in found for k in STEMS if k <= len(w)}


def likeness(text: str) -> int:
    """The least hash of the text's runs of four words: copies and most near copies share it, other texts do not."""
    found = [w for w in TOKEN.findall(text.lower()) if w[0].isalpha()]
    return min(zlib.crc32(" ".join(found[i:i + 4]).encode()) << 32 | zlib.adler32(found[i].encode()) for i in range(max(1, len(found) - 3))) if found else 0


def _evidence(c1: float, c0: float, n1: float, n0: float) -> float:
    """Twice the log likelihood ratio of the counts against one common rate."""
    rate = (c1 + c0) / (n1 + n0)
    return 2 * sum(c * math.log(c / (n * rate)) for c, n in ((c1, n1), (c0, n0)) if c)


def weights(toxic, other, n1: float, n0: float) -> dict[str, float]:
    """Entries from the numbers of toxic and other documents that hold a token, of ``n1`` and ``n0``."""
    out = {}
    for token in {*toxic, *("=" + w for w in INSULTS)}:
        known = PRIOR if token[0] == "=" and token[1:] in INSULTS else 0.0
        c1, c0 = toxic.get(token, 0), other.get(token, 0)
        if not known and (c1 < SEEN or _evidence(c1, c0, n1, n0) < EVIDENCE):
            continue
        c1 += known
        odds = math.log((c1 + 0.5) / (n1 + known + 1)) - math.log((c0 + 0.5) / (n0 + 1))
        careful = odds - math.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5 + known))
        if careful > 0:
            out[token] = careful
    return out


def _fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1e-9)
    full = np.hstack([np.ones((len(x), 1)), x / scale])
    ridge = np.diag([1e-6] + [0.05] * x.shape[1])
    beta = np.zeros(full.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        step = np.linalg.solve((full * (w * p * (1 - p))[:, None]).T @ full + ridge, full.T @ (w * (y - p)) - ridge @ beta)
        size = np.abs(step).max()
        beta += step * min(1, 4 / size) if size else 0
        if size < 1e-8:
            break
    return float(beta[0]), tuple((beta[1:] / scale).tolist())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the texts of ``docs`` (key, text) whose keys are in ``labels`` (key, toxic); null labels are left out, null texts are empty.

    Of each class at most about ``sample`` / 2 keys are taken, chosen by their hash, and rows of a
    thinned class weigh more, so the rate of toxic rows stays right. The chosen labels are broadcast, which ``sample`` bounds, so texts that
    are not learned from stay where they are. Of copies and near copies of one class one is learned from, or the words
    they share would seem to make them toxic. A key with both labels is learned as both. Without rows of both classes the model is the one that the
    known words give.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), (F.col("toxic") > 0).alias("toxic")).distinct()
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model()
    share = {t: min(1.0, sample / 2 / n) for t, n in sizes.items()}
    draw = hashed(F.lit("toxicity"), F.col("key"))
    few = known.where(draw < F.when(F.col("toxic"), share[True] * 2**32).otherwise(share[False] * 2**32))
    taken = docs.select(F.col(key).cast("string").alias("key"), "text").join(F.broadcast(few), "key").select("key", "text", "toxic")

    def alike(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([likeness(t or "") for t in batch.column(1).to_pylist()], pa.uint64()).cast(pa.int64(), safe=False)],
                names=["key", "text", "toxic", "like"])

    one = taken.mapInArrow(alike, "key string, text string, toxic boolean, like long").groupBy("like", "toxic").agg(F.min(F.struct("key", "text")).alias("row"))
    chosen = cut(one.select("row.text", "toxic", (hashed(F.lit("fold"), F.col("like")) % FOLDS).cast("int").alias("fold")))

    def counted(batches):
        held: Counter = Counter()

        def written():
            names, folds, toxic = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({"token": pa.array(names, pa.string()), "fold": pa.array(folds, pa.int32()),
                                               "toxic": pa.array(toxic, pa.bool_()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for text, toxic, fold in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.update((t, fold, toxic) for t in tokens_of(text or ""))
                held[("", fold, toxic)] += 1
                if len(held) > 1 << 20:
                    yield written()
                    held.clear()
        if held:
            yield written()

    rows = chosen.mapInArrow(counted, "token string, fold int, toxic boolean, n long")
    per = {f"c{int(t)}_{k}": F.sum(F.when((F.col("toxic") == F.lit(t)) & (F.col("fold") == k), F.col("n")).otherwise(0)) for t in (True, False) for k in range(FOLDS)}
    per |= {"toxic": F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)), "other": F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0))}
    counts = rows.groupBy("token").agg(*[c.alias(name) for name, c in per.items()])
    rate = sizes[True] * share[True] / (sizes[False] * share[False])
    marked = F.col("token").isin("", *["=" + w for w in INSULTS]) | ((F.col("toxic") >= SEEN) & (F.col("toxic") > 2 * rate * F.col("other")))
    found = {r.token: r for r in counts.where(marked).collect()}  # words of a bounded sample that lean to toxic
    total = found.pop("", None)
    if total is None:
        return Model()

    def lexicon(without: int | None):
        less = (lambda r, t: r[f"c{t}_{without}"]) if without is not None else (lambda r, t: 0)
        pick = lambda t, name: {token: r[name] - less(r, t) for token, r in found.items()}
        return weights(pick(1, "toxic"), pick(0, "other"), total["toxic"] - less(total, 1), total["other"] - less(total, 0))

    shared = docs.sparkSession.sparkContext.broadcast([lexicon(k) for k in range(FOLDS)])

    def seen(batches):
        machine, lexicons = grammar(), [Lexicon(entries) for entries in shared.value]
        for batch in batches:
            rows = [features(text, lexicons[fold], machine) for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    points = chosen.mapInArrow(seen, "toxic boolean, x array<double>").toArrow()  # about ``sample`` rows
    y = points.column("toxic").to_numpy().astype(float)
    x = points.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order of the rows
    x, y = x[order], y[order]
    bias, slopes = _fitted(x, y, np.where(y > 0, 1 / share[True], 1 / share[False]))
    return Model(lexicon(None), bias, slopes)


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted, n_clauses, worst): how likely the text is toxic, whether that is a half or more, its matched clauses and the highest of their scores.

    A null or empty text has no clause and the lowest score. Repeated rows are scored each. Long texts are read whole. Other columns are
    ignored. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.entries, model.bias, model.slopes))
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches):
        entries, bias, slopes = shared.value
        machine, lexicon = grammar(), Lexicon(entries)
        for batch in batches:
            for piece in slices(batch):
                x = np.array([features(text, lexicon, machine) for text in piece.column(1).to_pylist()]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip(bias + x @ np.array(slopes), -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)),
                     pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64)), pa.array(x[:, 1])],
                    names=[key, "score", "predicted", "n_clauses", "worst"])

    return docs.select(key, "text").mapInArrow(scored, f"`{key}` {kind}, score double, predicted int, n_clauses long, worst double")


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether the checksum of the key's text puts a row aside."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))
