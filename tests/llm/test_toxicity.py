"""The toxicity grammar against a plain walk over clauses, and held-out accuracy."""

import re
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kantele.llm import queries
from kantele.llm import toxicity as tox

SF = "/root/testdata/sf0.1"
MODEL = tox.Toxicity({"idiot": 1.0, "scum": 0.5, "mopp*": 0.75})
#: Weights under which contexts play no part.
FLAT = np.repeat([1.0, 0.0, 0.0], 3)


def walk(text):
    """Masses by (kind, cover), clause by clause and position by position, without transducers."""
    mass = np.zeros((3, 3))
    clauses, now = [], []
    for raw in re.findall("[^\x20\x09-\x0d]+", text or ""):
        now.append(re.sub(r"^[\W_]+|[\W_]+$", "", raw.lower()))
        if re.search(r"[.!?;]$", raw):
            clauses.append(now)
            now = []
    for clause in [*clauses, now]:
        tags = [MODEL.tag(word) for word in clause]
        kinds = [kind for kind, _ in tags]

        def cover(i, kinds=kinds):
            if tox.REPORT in kinds[max(0, i - tox.REPORT_REACH) : i]:
                return 2
            return 1 if tox.NEGATION in kinds[max(0, i - tox.NEGATION_REACH) : i] else 0

        used = set()  # threats that have met their target
        for i, (kind, strength) in enumerate(tags):
            if kind == tox.INSULT:
                mass[0, cover(i)] += strength
                if tox.TARGET in kinds[max(0, i - tox.TARGET_REACH) : i]:
                    mass[1, cover(i)] += strength
            if kind == tox.TARGET:
                # An insult just before, the last one, that no target had reached.
                before = [j for j in range(max(0, i - tox.LATE_REACH), i) if kinds[j] in (tox.INSULT, tox.TARGET)]
                if before and kinds[before[-1]] == tox.INSULT and tox.TARGET not in kinds[max(0, before[-1] - tox.TARGET_REACH) : before[-1]]:
                    mass[1, cover(i)] += tags[before[-1]][1]
                open_threats = [j for j in range(max(0, i - tox.THREAT_REACH), i) if kinds[j] == tox.THREAT and j not in used]
                if open_threats:
                    mass[2, cover(i)] += 1
                    used.update(range(i))
            if kind == tox.THREAT and tox.TARGET in kinds[max(0, i - tox.THREAT_REACH) : i]:
                mass[2, cover(i)] += 1
                used.update(range(i + 1))
    return mass.ravel()


WORDS = st.sampled_from("you idiot scum. moppel not said kill, the! IDIOT; fine moppx never a (idiot) him kill x y".split() + ["\n"])


@given(st.lists(st.lists(WORDS, max_size=25).map(" ".join), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_clauses(group):
    mass, counts = MODEL.masses(pa.array([*group, None, ""], pa.string()))
    for i, text in enumerate(group):
        assert np.allclose(mass[i], walk(text)), text
    assert (mass[-2:] == 0).all() and (counts[-2:] == 0).all()


def test_the_machine_is_the_cascade():
    """One composed step equals the five transducers read one after the other."""
    parts = [tox.insults(), tox.threats(), tox.targets(), tox.covers(tox.NEGATION, tox.IS_NEGATED, tox.NEGATION_REACH), tox.covers(tox.REPORT, tox.IS_REPORTED, tox.REPORT_REACH)]
    machine, rng = tox.grammar(), np.random.default_rng(0)
    states, at = [0] * len(parts), 0
    for read in rng.integers(0, 6, 3000).tolist():
        said = int(machine.says[at, read])
        at = int(machine.follows[at, read])
        tape = read
        for i, part in enumerate(parts):
            states[i], tape = int(part.follows[states[i], tape]), int(part.says[states[i], tape])
        assert said == tape


def test_order_is_in_the_weights():
    with pytest.raises(ValueError):
        tox.Weights(negated=1.0)
    with pytest.raises(ValueError):
        tox.Weights(aimed=0.0)
    for name, options in tox.CHOICES.items():
        for option in options:
            tox.Weights(**{name: option})


def test_families():
    entries = [("worthless", 9, 0, 20.0), ("wort*", 9, 0, 20.0), ("worthl*", 9, 0, 20.0), ("achlich*", 9, 1, 18.0), ("achl*", 9, 1, 18.0), ("achlichen", 5, 0, 11.0), ("scum", 4, 0, 9.0)]
    assert set(tox.families(entries)) == {"worthless", "achlich*", "scum"}


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return tox.fit(docs, labels)


def test_fitted_model_reads_clauses(fitted):
    """Contexts order the scores of the fitted model's own insults, and threats need no insult."""
    seen = [word for word in fitted.lexicon if not word.endswith("*") and fitted.lexicon[word] > 0.85]
    assert len(seen) >= 5
    for word in seen:
        aimed, bare, said, negated = fitted.score(pa.array([f"you are an {word}", f"an {word}", f"he said you are an {word}", f"you are not an {word}"]))
        assert aimed > bare > max(said, negated) and aimed > 0.5 > max(said, negated), word
    threat, half, refused, plain = fitted.score(pa.array(["I will kill you", "I will kill time", "I will not kill you", "I will see you"]))
    assert threat > 0.5 > refused > plain and half == plain
    assert (fitted.score(pa.array(["worth", "paths", "a fine day"])) < 0.05).all()


def test_held_out_accuracy(spark, odd, fitted):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.score_documents(docs, fitted).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 500 and np.mean([r.predicted == r.toxic for r in held]) > 0.98
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.85
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.01
    out = tox.score_documents(odd, fitted).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert tox.score_documents(odd.limit(0), fitted).count() == 0
    assert tox.keep_civil(odd, fitted).columns == odd.columns
    plain = tox.fit(docs, labels.limit(0))
    assert plain.lexicon.keys() >= {"idiot"} and plain.score(pa.array(["you idiot"]))[0] > 0.5


def test_contexts_carry_the_score(fitted):
    """Without contexts the score of clauses in them changes."""
    clauses = pa.array(["he said she is stupid", "they are not stupid at all", "stupid weather", "you are stupid", "kill them all now"])
    mass, counts = fitted.masses(clauses)

    class Flat:
        of_masses = staticmethod(lambda: FLAT)

    flat = tox.sigmoid(tox.features(mass, counts, Flat) @ np.array(fitted.curve))
    full = fitted.score(clauses)
    assert ((flat >= 0.5) != (full >= 0.5)).tolist() == [True, True, False, False, True]


def test_labels_of_held_out_rows_play_no_part(spark):
    rows = [(i, f"you {'idiot' if i % 2 else 'friend'} number {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    flipped = spark.createDataFrame(
        [(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2) for i in range(300)], "doc_id long, toxic int"
    )
    a, b = tox.fit(docs, labels), tox.fit(docs, flipped)
    assert a == b


def test_repeated_labelled_rows_count_once(spark):
    rows = [(i, f"you {'idiot' if i % 2 else 'friend'} number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert tox.fit(docs.union(docs).union(docs.where("doc_id = 1")), labels) == tox.fit(docs, labels)


def test_query(spark):
    found = queries.op2_toxicity(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert replace(tox.Toxicity(), curve=(0.0, 0.0, 0.0)).score(pa.array([None]))[0] == 0.5
