"""Toxicity by a weighted finite-state pattern grammar over clauses.

The words of a clause become symbols: insult, threat, target, negation, report, word. Insults are learned from labelled
rows, as words and as stems (their first four letters), each with a weight; the rest are closed word lists. Three
transducers, given as tables of arcs, are composed into one (``GRAMMAR``):

1. negation marks the insults and threats within the next three words;
2. reported speech marks those within the next eight words, over any other mark;
3. addressing looks for a target up to five words before or four words after an insult or threat, and emits its weight
   into a class: plain, addressed, negated, reported, and threat, denied_threat, reported_threat (a threat counts only at a
   target).

A clause is read once through the composed table. A document is the vector of what its clauses emit, and a logistic
model, fitted on other labelled rows than the insults it reads were learned from, turns it into a score. Words outside a
matched clause count for nothing.

Labels are used from at most ``max_train`` rows (by a hash of the id, held-out rows excluded).

Edge cases: null and empty texts have no clause and get the score of a document that matches nothing; null labels are
ignored; repeated rows are scored one by one; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

TARGETS = frozenset("you your yours yourself u ur they them their he him she her people everyone du dich dir dein deine ihr euch euer sie ihn tu te toi ton ta tes vous votre vos ils elles eux tú usted ustedes tu tus vosotros ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ne pas jamais aucun aucune ni nunca jamás ningún ninguna tampoco".split())
REPORTING = frozenset("said says say told claims claimed called calls quoted quote according wrote sagte sagt behauptet zitiert laut nannte dit disait selon raconte cite appelé dijo dice según llamó cita citado".split())
THREATS = frozenset("kill hurt destroy punch beat stab shoot burn hang die töten umbringen verletzen schlagen verbrennen sterben tuer frapper brûler détruire mourir crever matar golpear destruir quemar morir".split())
#: Classes that a clause emits into.
CLASSES = ("plain", "addressed", "negated", "reported", "threat", "denied_threat", "reported_threat")
STEM = 4
_CLAUSE = re.compile(r"[.!?;:,\n\r\"“”«»()\[\]|]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def features(words: list[str]) -> Iterator[str]:
    for w in words:
        yield w
        if len(w) > STEM:
            yield w[:STEM] + "*"


def clauses(text: str | None) -> Iterator[list[str]]:
    for part in _CLAUSE.split((text or "").lower()):
        if words := _WORD.findall(part):
            yield words


class Transducer:
    """``arcs[state, symbol]`` is (next state, outputs); ``final[state]`` are the outputs at the end of a clause.

    A symbol without an arc passes through and leaves the state as it is.
    """

    def __init__(self, start, arcs: dict, final: dict | None = None):
        self.start, self.arcs, self.final = start, arcs, final or {}

    def step(self, state, symbol) -> tuple:
        return self.arcs.get((state, symbol), (state, (symbol,)))


SYMBOLS = ("word", "target", "negation", "report", "insult", "threat")
MARKS = ("", "negated", "reported")
HITS = [(kind, mark) for kind in ("insult", "threat") for mark in MARKS]


def scope(trigger: str, span: int, mark: str) -> Transducer:
    """Marks the hits among the ``span`` symbols after a trigger."""
    symbols = [x for x in SYMBOLS if x not in ("insult", "threat")] + HITS
    arcs = {}
    for left in range(span + 1):
        for x in symbols:
            inside = left and x in HITS
            arcs[left, x] = (span if x == trigger else max(0, left - 1), ((x[0], mark) if inside else x,))
    return Transducer(0, arcs)


def addressing(before: int, after: int) -> Transducer:
    """Emits hits by their class, once it is known whether a target is near.

    States are ("near", n): a target n words ago or less holds for n more words, or a hit that waits for a target,
    with the words that it still waits. Outputs are (class, whether the weight is that of the waiting hit).
    """
    plain = {"": "plain", "negated": "negated", "reported": "reported"}
    aimed = {"insult": {**plain, "": "addressed"}, "threat": {"": "threat", "negated": "denied_threat", "reported": "reported_threat"}}
    arcs, final = {}, {}
    waiting = [(hit, n) for hit in HITS for n in range(1, after + 1)]
    given_up = lambda hit: ((plain[hit[1]], True),) if hit[0] == "insult" else ()
    others = ("word", "negation", "report")
    for n in range(before + 1):
        state = ("near", n)
        arcs |= {(state, x): (("near", max(0, n - 1)), ()) for x in others}
        arcs[state, "target"] = (("near", before), ())
        for hit in HITS:
            arcs[state, hit] = (("near", n - 1), ((aimed[hit[0]][hit[1]], False),)) if n else ((hit, after), ())
    for hit, n in waiting:
        state = (hit, n)
        arcs |= {(state, x): ((hit, n - 1), ()) if n > 1 else (("near", 0), given_up(hit)) for x in others}
        arcs[state, "target"] = (("near", before), ((aimed[hit[0]][hit[1]], True),))
        for new in HITS:
            arcs[state, new] = ((new, after), given_up(hit))
        final[state] = given_up(hit)
    return Transducer(("near", 0), arcs, final)


def compose(first: Transducer, second: Transducer, symbols: list) -> Transducer:
    """The transducer that feeds what ``first`` puts out to ``second``, over the states that ``symbols`` reach."""
    start = (first.start, second.start)
    arcs, final, queue = {}, {}, [start]
    for state in queue:
        final[state] = second.final.get(state[1], ())
        for x in symbols:
            a, middle = first.step(state[0], x)
            b, out = state[1], ()
            for y in middle:
                b, more = second.step(b, y)
                out += more
            arcs[state, x] = ((a, b), out)
            if (a, b) not in final and (a, b) not in queue:
                queue.append((a, b))
    return Transducer(start, arcs, final)


_INPUTS = [x for x in SYMBOLS if x not in ("insult", "threat")] + [("insult", ""), ("threat", "")]
GRAMMAR = compose(compose(scope("negation", 3, "negated"), scope("report", 8, "reported"), _INPUTS), addressing(5, 4), _INPUTS)


def _numbered(t: Transducer) -> tuple[list[list], list]:
    """The arcs as a table of rows by state and columns by symbol, states as numbers, and the final outputs."""
    number = {state: i for i, state in enumerate(t.final)}
    rows = [[(number[t.arcs[state, x][0]], t.arcs[state, x][1]) for x in _INPUTS] for state in number]
    return rows, [t.final[state] for state in number]


_ROWS, _FINAL = _numbered(GRAMMAR)
_CODE = {"word": 0, "target": 1, "negation": 2, "report": 3, "insult": 4, "threat": 5}
_CLOSED = dict.fromkeys(TARGETS, 1) | dict.fromkeys(THREATS, 5) | dict.fromkeys(REPORTING, 3) | dict.fromkeys(NEGATIONS, 2)


def read_clause(words: list[str], weights: dict[str, float]) -> dict[str, float]:
    """What the composed transducer emits for one clause."""
    out: dict[str, float] = {}
    state, held = 0, 0.0
    for w in words:
        code, weight = _CLOSED.get(w, 0), 1.0
        if code not in (2, 3):
            hit = weights.get(w) or (weights.get(w[:STEM] + "*") if len(w) > STEM else None)
            if hit:
                code, weight = 4, hit
        state, emitted = _ROWS[state][code]
        for kind, waited in emitted:
            out[kind] = out.get(kind, 0.0) + (held if waited else weight)
        if code > 3:
            held = weight
    for kind, _ in _FINAL[state]:
        out[kind] = out.get(kind, 0.0) + held
    return out


def vector(text: str | None, weights: dict[str, float]) -> list[float]:
    """Document vector: evidence by class, the strongest clause, and how many clauses matched."""
    words = _WORD.findall((text or "").lower())
    known = weights.keys()
    total = dict.fromkeys(CLASSES, 0.0)
    most, n, mass = 0.0, 0, 0.0
    if not known.isdisjoint(words) or not known.isdisjoint([w[:STEM] + "*" for w in words]) or not THREATS.isdisjoint(words):
        for clause in clauses(text):
            if got := read_clause(clause, weights):
                for k, v in got.items():
                    total[k] += v
                value = sum(v for k, v in got.items() if not k.endswith("threat"))
                if value:
                    n += 1
                    mass += value
                    most = max(most, value)
    return [math.log1p(total[k]) for k in CLASSES] + [most, math.log1p(n), math.log1p(mass)]


N_FEATURES = len(CLASSES) + 3


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> list[float]:
    """Newton's method; the intercept comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


class Model:
    """Weights of insult words and stems, and the logistic model over document vectors."""

    def __init__(self, weights: dict[str, float], logistic: list[float] | None):
        self.weights, self.logistic = weights, logistic

    def score(self, texts: list[str | None]) -> list[float]:
        if self.logistic is None:
            return [0.0] * len(texts)
        x = np.array([vector(t, self.weights) for t in texts], dtype=float).reshape(len(texts), N_FEATURES)
        z = x @ np.array(self.logistic[:-1]) + self.logistic[-1]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, seed: int = 5) -> DataFrame:
    """(text, y, part): labelled rows that are not held out; ``part`` halves them by id."""
    usable = labels.select(F.col("doc_id"), F.col("toxic").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, max_train / max(1, usable.count()))
    draw = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), c), 11) < int(share * (1 << 53))
    few = usable.where(draw(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    some = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & draw(F.col("doc_id")))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(2)).alias("part")
    return some.join(F.broadcast(few), "doc_id").select("text", "y", part)  # few: about max_train rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 16_000, max_features: int = 5_000, min_contexts: int = 3, least_weight: float = 3.0) -> Model:
    """Learn insults and the logistic model from the labelled sample, crosswise.

    A word's evidence is counted over its contexts (the word before it), so that copies of one text count once. Each half
    of the sample is read with the insults of the other half to fit the logistic model; the model then reads with the
    insults of both.
    """
    rows = training_rows(docs, labels, max_train)

    def toxic_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats, ctx, parts = [], [], []
            for t, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                words = _WORD.findall((t or "").lower())
                for before, w in zip(["", *words], words, strict=False):
                    for f in features([w]):
                        if (f, before) not in seen:
                            seen.add((f, before))
                            feats.append(f)
                            ctx.append(before)
                            parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(feats, pa.string()), pa.array(ctx, pa.string()), pa.array(parts, pa.int32())], names=["f", "c", "part"])

    pos = rows.where("y = 1").select("text", F.col("part").cast("int")).mapInArrow(toxic_words, "f string, c string, part int")
    pos = pos.groupBy("f").agg(*[F.approx_count_distinct(F.when(F.col("part") == k, F.col("c"))).alias(f"c{k}") for k in (0, 1)]).where(F.col("c0") + F.col("c1") >= min_contexts)
    contexts = {r["f"]: (r["c0"], r["c1"]) for r in pos.orderBy(F.desc(F.col("c0") + F.col("c1")), "f").limit(20 * max_features).collect()}

    def count_docs(batches: Iterator[pa.RecordBatch], known=frozenset(contexts)) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t, y, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for f in known.intersection(features(_WORD.findall((t or "").lower()))) | {""}:
                    counts[f, int(y > 0), part] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["f", "y", "part", "n"])

    counted = rows.select("text", "y", F.col("part").cast("int")).mapInArrow(count_docs, "f string, y int, part int, n bigint").groupBy("f", "y", "part").agg(F.sum("n").alias("n")).collect()
    counts = {(r["f"], r["y"], r["part"]): r["n"] for r in counted}
    get = lambda f, y, parts: sum(counts.get((f, y, k), 0) for k in parts)

    def insults(parts: tuple[int, ...]) -> dict[str, float]:
        n_pos, n_neg = get("", 1, parts), get("", 0, parts)
        found = []
        for f, ctx in contexts.items():
            evidence = sum(min(counts.get((f, 1, k), 0), ctx[k]) for k in parts)
            if evidence >= (min_contexts + 1) // 2 * len(parts) // 2 + 1:
                w = math.log((evidence + 0.5) / (n_pos + 1)) - math.log((get(f, 0, parts) + 0.5) / (n_neg + 1))
                if w >= least_weight:
                    found.append((w, f))
        return {f: round(w, 4) for w, f in sorted(found, reverse=True)[:max_features]}

    if not get("", 1, (0, 1)) or not get("", 0, (0, 1)):
        return Model({}, None)
    crosswise = {0: insults((1,)), 1: insults((0,))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t, crosswise[part]) for t, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    sample = rows.select("text", "y", F.col("part").cast("int")).mapInArrow(vectors, "x array<double>, y int").collect()  # eight numbers for each of max_train rows
    y = np.array([float(r["y"] > 0) for r in sample])
    order = sorted(range(len(sample)), key=lambda i: (sample[i]["x"], y[i]))  # the fit doesn't depend on the order of rows
    return Model(insults((0, 1)), fit_logistic(np.array([sample[i]["x"] for i in order]), y[order]))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` plus the score of each text. A column of that name in ``docs`` is replaced."""
    docs = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found: list[float] = []
            for at in range(0, len(texts), 256):
                found += model.score(texts[at : at + 256].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out_col}` double")


THRESHOLD = 0.7


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of the whole table."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, in one pass."""
    name = fresh(docs, "toxicity")
    return scored(docs, model, out_col=name).where(F.col(name) < threshold).drop(name)
