"""Toxicity by a weighted finite-state grammar of clauses.

A tagging step turns words into symbols: insult, threat, negation, report, target or
other. Five transducers read them one after the other, each the tape that the one
before wrote: the insult transducer marks insults; the threat transducer marks a
threat only where its verb and a target stand within reach of each other; the target
transducer marks insults aimed at someone, whether the target comes before or after;
negation and reported speech mark what they cover. Their composition is one machine,
run over every clause with a match. The marks that it writes on a clause are weighed:
the grammar's order (targeted above plain, negated and reported below) holds for
every weight that a fit can choose.

The insult lexicon, of whole words and of word beginnings, and the weights are
learned from labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import sigmoid
from .common import Words, columns, keep, map_text, words
from .labels import SAMPLE, labelled

OTHER, TARGET, REPORT, NEGATION, THREAT, INSULT = range(6)
#: Fixed word lists of the grammar, in English, German, French and Spanish.
LISTS = {
    TARGET: "you your you're yourself they them these those he she him her du dich dir ihr euch sie tu toi vous te tú vosotros ustedes",
    REPORT: "said says say called calls wrote quote quoted claimed reported sagte sagt nannte dit disait appelait dijo dice llamó",
    NEGATION: "not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca",
    THREAT: "kill hurt destroy shoot stab beat strangle töten umbringen erschießen tuer frapper détruire matar golpear destruir",
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting dumb imbecile depp trottel dumm crétin abruti imbécile estúpido tonto",
}
#: Words for which a threat waits for its target, a target for an insult before and
#: after it, and a negation and a report hold.
THREAT_REACH, TARGET_REACH, LATE_REACH, NEGATION_REACH, REPORT_REACH = 4, 4, 2, 3, 12
#: Lengths of word beginnings that may enter the lexicon.
BEGINNINGS = (4, 5, 6, 7)
#: A learned entry's evidence: documents, share of toxic ones, log likelihood ratio.
LEAST_DOCS, LEAST_SHARE, LEAST_EVIDENCE = 3, 0.5, 13.8
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 5) = 0"

#: Words that a text counts at least where evidence is taken a hundred words, so that
#: short texts are judged by what they say and not by their length.
LEAST_WORDS = 20

#: Marks on the tape, beside a symbol in the three lowest bits.
IS_INSULT, IS_THREAT, IS_TARGETED, IS_NEGATED, IS_REPORTED = 8, 16, 32, 64, 128
TAPE = 256


@dataclass(frozen=True)
class Transducer:
    """follows[state, read] is the next state, says[state, read] what it writes; state 0 is first."""

    follows: np.ndarray
    says: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """The cascade: ``other`` reads what this one writes. States are pairs."""
        n, m = len(self.follows), len(other.follows)
        of_other = np.arange(m)[None, :, None]
        written = np.broadcast_to(self.says[:, None, :], (n, m, self.says.shape[1]))
        follows = self.follows[:, None, :] * m + other.follows[of_other, written]
        return Transducer(follows.reshape(n * m, -1), other.says[of_other, written].reshape(n * m, -1))


def transducer(states: list, step) -> Transducer:
    """Tables of step(state, read) -> (next state, written) over the whole tape alphabet."""
    number = {s: i for i, s in enumerate(states)}
    table = np.array([[(number[after], out) for after, out in (step(s, read) for read in range(TAPE))] for s in states])
    return Transducer(table[..., 0], table[..., 1])


def insults() -> Transducer:
    """Marks every insult."""
    return transducer([0], lambda _, read: (0, read | IS_INSULT if read & 7 == INSULT else read))


def threats() -> Transducer:
    """Marks where a threat is complete: its verb and a target within reach, in any order."""

    def step(state: tuple[int, int], read: int):
        waits, target = state
        kind = read & 7
        after = (THREAT_REACH if kind == THREAT else max(waits - 1, 0), THREAT_REACH if kind == TARGET else max(target - 1, 0))
        if kind == THREAT and target:
            return (0, after[1]), read | IS_THREAT
        if kind == TARGET and waits:
            return (0, after[1]), read | IS_THREAT
        return after, read

    return transducer([(a, b) for a in range(THREAT_REACH + 1) for b in range(THREAT_REACH + 1)], step)


def targets() -> Transducer:
    """Marks an insult soon after a target, and a target soon after an insult that had none."""

    def step(state: tuple[int, int], read: int):
        target, insult = state
        if read & IS_INSULT:
            return (max(target - 1, 0), 0 if target else LATE_REACH), read | IS_TARGETED if target else read
        if read & 7 == TARGET:
            return (TARGET_REACH, 0), read | IS_TARGETED if insult else read
        return (max(target - 1, 0), max(insult - 1, 0)), read

    return transducer([(a, b) for a in range(TARGET_REACH + 1) for b in range(LATE_REACH + 1)], step)


def covers(symbol: int, mark: int, length: int) -> Transducer:
    """Marks the ``length`` words after the symbol."""
    return transducer(
        list(range(length + 1)), lambda state, read: (length if read & 7 == symbol else max(state - 1, 0), read | mark if state else read)
    )


@cache
def grammar() -> Transducer:
    """Insult, threat, target, negation and reported speech, composed."""
    first, *rest = insults(), threats(), targets(), covers(NEGATION, IS_NEGATED, NEGATION_REACH), covers(REPORT, IS_REPORTED, REPORT_REACH)
    made = reduce(Transducer.then, rest, Transducer(first.follows[:, : INSULT + 1], first.says[:, : INSULT + 1]))
    return made


@cache
def _tables() -> tuple[list, list]:
    machine = grammar()
    return machine.follows.tolist(), machine.says.tolist()


#: What a clause can hold: (insult or threat, or the aim of an insult) by cover.
KINDS, COVERS = ("insult", "aimed", "threat"), ("open", "negated", "reported")
MASSES = len(KINDS) * len(COVERS)


@cache
def _places() -> np.ndarray:
    """places[written, kind]: where in the masses a written mark counts; -1 for nowhere."""
    out = np.full((TAPE, len(KINDS)), -1)
    for read in range(TAPE):
        cover = 2 if read & IS_REPORTED else 1 if read & IS_NEGATED else 0
        for kind, mark in enumerate((IS_INSULT, IS_TARGETED, IS_THREAT)):
            if read & mark:
                out[read, kind] = 3 * kind + cover
    return out


@dataclass(frozen=True)
class Weights:
    """Weights of the marks; an open plain insult weighs 1.

    A targeted insult weighs 1 + aimed, a threat ``threat``; a negated or reported
    mark weighs that share of an open one. The ranges keep the grammar's order.
    """

    aimed: float = 0.5
    threat: float = 1.5
    negated: float = 0.1
    reported: float = 0.1

    def __post_init__(self):
        if not (self.aimed > 0 and self.threat > 0 and 0 <= self.negated < 1 and 0 <= self.reported < 1):
            raise ValueError("aimed and threat must be above 0, negated and reported in [0, 1)")

    def of_masses(self) -> np.ndarray:
        return np.outer([1.0, self.aimed, self.threat], [1.0, self.negated, self.reported]).ravel()


#: Weights among which a fit chooses; the defaults are the middle of its prior.
CHOICES = {"aimed": (0.25, 0.5, 1.0), "threat": (1.0, 1.5, 2.0), "negated": (0.0, 0.05, 0.1, 0.2), "reported": (0.0, 0.05, 0.1, 0.2)}
#: Log likelihood that a weight must win to leave its default.
PRIOR = 2.0


def cores(found: Words) -> pa.Array:
    """Words without case and outer punctuation, for each entry of the dictionary."""
    return pc.replace_substring_regex(pc.utf8_lower(found.dictionary), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


@dataclass(frozen=True)
class Toxicity:
    """Lexicon entries (a word, or a beginning and ``*``) with strengths; weights; the curve of the score."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: Weights = Weights()
    #: Intercept, and slopes of a text's evidence and of its evidence a hundred words.
    curve: tuple[float, float, float] = (-4.0, 4.0, 1.0)

    def tag(self, core: str) -> tuple[int, float]:
        strength = self.lexicon.get(core, 0.0)
        for length in BEGINNINGS:
            if len(core) >= length:
                strength = max(strength, self.lexicon.get(core[:length] + "*", 0.0))
        if strength > 0:
            return INSULT, strength
        return _KNOWN.get(core, (OTHER, 0.0))

    def masses(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mass of each kind and cover, words) of every text."""
        found = words(column)
        n = len(found.counts)
        mass = np.zeros((n, MASSES))
        if not len(found.codes):
            return mass, found.counts
        tags = [self.tag(core) for core in cores(found).to_pylist()]
        symbol = np.array([s for s, _ in tags], np.int8)[found.codes]
        strength = np.array([w for _, w in tags])[found.codes]
        ends = pc.match_substring_regex(found.dictionary, r"[.!?;]$").to_numpy(zero_copy_only=False)[found.codes].copy()
        full = found.counts > 0
        ends[found.offsets[1:][full] - 1] = True
        clause = np.cumsum(ends) - ends
        hit = symbol >= THREAT
        matched = np.zeros(int(clause[-1]) + 1, bool)
        matched[clause[hit]] = True
        at = np.flatnonzero(matched[clause])
        follows, says = _tables()
        state, written = 0, []
        for read, last in zip(symbol[at].tolist(), ends[at].tolist(), strict=True):
            written.append(says[state][read])
            state = 0 if last else follows[state][read]
        tape = np.array(written, np.int64)
        rows = found.rows[at]
        # An aim weighs as the insult it marks: the last one read.
        last = np.maximum.accumulate(np.where(symbol[at] == INSULT, np.arange(len(at)), 0)) if len(at) else at
        weighs = strength[at][last]
        for kind in range(len(KINDS)):
            place = _places()[tape, kind] if len(tape) else tape
            some = place >= 0
            np.add.at(mass, (rows[some], place[some]), 1.0 if KINDS[kind] == "threat" else weighs[some])
        return mass, found.counts

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(features(*self.masses(column), self.weights) @ np.array(self.curve))


def features(mass: np.ndarray, counts: np.ndarray, weights: Weights) -> np.ndarray:
    """(1, log evidence, log evidence a hundred words) of every text, from its weighed marks alone."""
    found = mass @ weights.of_masses()
    return np.stack([np.ones(len(mass)), np.log1p(found), np.log1p(100 * found / np.maximum(counts, LEAST_WORDS))], axis=1)


_KNOWN = {word: (kind, 1.0) for kind in (TARGET, REPORT, NEGATION, THREAT) for word in LISTS[kind].split()}


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(entry, toxic, clean): documents of each kind that have it."""
    found = words(batch.column("text"))
    toxic = batch.column("label").to_numpy(zero_copy_only=False).astype(bool)
    names, pos, neg = [], [], []
    plain = cores(found)
    for length in (0, *BEGINNINGS):
        entry = pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, length), "*", "") if length else plain
        fits = pc.greater_equal(pc.utf8_length(plain), max(length, 1)).to_numpy(zero_copy_only=False)
        coded = entry.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(len(coded.dictionary), 1)
        kept = fits[found.codes] if len(found.codes) else np.zeros(0, bool)
        pairs = np.unique(found.rows[kept] * size + codes[found.codes[kept]])
        of, row = pairs % size, pairs // size
        a, b = np.bincount(of[toxic[row]], minlength=size), np.bincount(of[~toxic[row]], minlength=size)
        some = np.flatnonzero(a + b)
        names.append(coded.dictionary.take(pa.array(some)))
        pos.append(a[some])
        neg.append(b[some])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(names), pa.array(np.concatenate(pos), pa.int64()), pa.array(np.concatenate(neg), pa.int64())], ["entry", "toxic", "clean"]
    )


def evidence(toxic: int, clean: int, rate: float) -> float:
    """Log likelihood ratio of a share of toxic documents above the rate of all."""
    n = toxic + clean
    share = toxic / n
    if share <= rate:
        return 0.0
    return toxic * np.log(share / rate) + (clean * np.log((1 - share) / (1 - rate)) if clean else 0.0)


def families(entries: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Strengths of one entry a word family, the one with the most evidence.

    Entries (name, toxic, clean, evidence) of which one's letters begin the other's
    are one family. Of equal evidence a whole word comes first, then the longer.
    """
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for name, a, b, _ in sorted(entries, key=lambda e: (-e[3], e[0].endswith("*"), -len(e[0]), e[0])):
        stem = name.rstrip("*")
        begins = {stem[:i] for i in range(BEGINNINGS[0], len(stem) + 1)} | {stem}
        if stem in begun or any(x in chosen or x + "*" in chosen for x in begins):
            continue
        chosen[name] = a / (a + b + 1)
        begun |= begins
    return chosen


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """(curve, log likelihood) of a logistic regression whose slopes are not negative, by Newton steps."""
    free = np.ones(x.shape[1], bool)
    shrink = np.r_[0.0, np.full(x.shape[1] - 1, penalty)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (y - p)) - shrink * w
        free = (w > 0) | (grad > 0) | (np.arange(len(w)) == 0)
        curved = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink + 1e-9)
        move = np.zeros(len(w))
        move[free] = np.linalg.solve(curved[np.ix_(free, free)], grad[free])
        move *= min(1.0, 4 / max(np.abs(move).max(), 1e-12))
        new = w + move
        new[1:] = np.maximum(new[1:], 0)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    z = x @ w
    value = float((weight * (y * z - np.logaddexp(0, z))).sum() - 0.5 * (shrink * w**2).sum())
    return w, value


def fit_weights(mass: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Weights and curve of the greatest likelihood under the prior, one weight after the other."""
    best = Weights()
    curve, value = fit_curve(features(mass, counts, best), y, weight)
    for _ in range(2):
        for name, options in CHOICES.items():
            for option in options:
                tried = replace(best, **{name: option})
                found, reached = fit_curve(features(mass, counts, tried), y, weight)
                reached -= PRIOR * sum(getattr(tried, n) != getattr(Weights(), n) for n in CHOICES)
                if reached > value + 1e-6:
                    best, curve, value = tried, found, reached
    return best, curve


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Learns the lexicon, the weights and the curve from at most ``most`` labelled documents.

    Documents whose crc32 of the id as text is 0 modulo 5 are held out. Without
    labels of both classes the fixed lists and default weights stand. The documents
    are read once and held while the fit goes on.
    """
    held = labelled(docs, labels, "toxic", most, f"not ({HELD_OUT})", id_col, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(held)
    finally:
        held.unpersist()


def _fitted(held: DataFrame) -> Toxicity:
    sizes = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    seeds = {word: 0.8 for word in LISTS[INSULT].split()}
    if not sizes.get(0) or not sizes.get(1):
        return Toxicity(seeds)
    rate = sizes[1] / (sizes[0] + sizes[1])
    counted = map_text(held, _counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))
    entries = []
    for name, a, b in counted.where(likely | F.col("entry").isin(list(seeds))).collect():
        sure = evidence(a, b, rate)
        if a >= LEAST_DOCS and a >= LEAST_SHARE * (a + b) and sure >= LEAST_EVIDENCE:
            entries.append((name, a, b, sure))
        elif name in seeds and a + b >= 20 and a / (a + b) <= rate:
            del seeds[name]
    learned = families(entries)
    model = Toxicity({**{word: s for word, s in seeds.items() if not any(word[:n] + "*" in learned for n in BEGINNINGS)}, **learned})

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        mass, counts = model.masses(batch.column("text"))
        lists = pa.array(np.column_stack([mass, counts]).tolist(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "x"])

    rows = map_text(held, step, "label int, x array<double>").groupBy("label", "x").count().collect()
    rows = sorted((r["label"], r["x"], r["count"]) for r in rows)
    y, weight = (np.array([r[i] for r in rows], float) for i in (0, 2))
    x = np.array([r[1] for r in rows])
    weights, curve = fit_weights(x[:, :-1], x[:, -1], y, weight)
    return replace(model, weights=weights, curve=tuple(float(c) for c in curve))


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(df: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A text in which the grammar finds nothing, a null or empty one too, has the
    score of an unmatched document. A null id is not held out; repeated rows are
    kept; other columns take no part; an empty table gives no row. One narrow pass.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(batch.column("text"))
        arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    docs = columns(df, doc_id=id_col, text=text_col)
    docs = docs.withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    return map_text(docs, step, RESULT)


def keep_civil(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns.

    Each row is judged by its text alone: null and empty texts hold no match and stay,
    as do rows without an id; repeated rows stay or go together; other columns,
    whatever their names, go along; an empty table gives an empty one. One narrow pass.
    """
    return keep(docs, lambda column: model.score(column) < 0.5, text_col)
