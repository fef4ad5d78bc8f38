"""Phrases, toxicity and fill-in-the-middle against plain Python, and on nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import fim, phrases, toxicity

DOCS = "doc_id long, text string, lang string, n long, score double, form string, `output` string, toxic long"


def frame(spark, rows):
    """Documents with columns that clash with those of the results."""
    return spark.createDataFrame([(*r, i, 0.5, "psm", "x", 7) for i, r in enumerate(rows)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["red", "Blue", "the", "of", "ñandú", "x1", "grün", "--"]
    out = []
    for i in range(60):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ": ", "!?"]) for _ in range(rng.randint(0, 120)))
        out.append((i, text, rng.choice(["a", "b", None, "und"])))
    out += [(100, None, "a"), (101, "", None), (102, " \t\n ", "a"), (103, "red blue " * 400, "a"), (None, "Red BLUE the", "b"), out[3], out[3]]
    out += [(104, "of the red blue of the", "solo"), (105, "a<P>b c d", "a"), (106, "é <S é> <M", "a"), (107, " nbsp wide", "a")]
    return out


def plain_phrases(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
               for (x, v), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize(("least", "longest", "top"), [(4, 5, 2000), (2, 3, 7), (1, 4, 2000)])
def test_phrases(spark, rows, least, longest, top, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 200)
    monkeypatch.setattr(phrases, "KNOWN", 20)
    found = phrases.collocations(frame(spark, rows), least, longest, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = list(map(tuple, found.collect()))
    assert len(got) == len(set(got)) and set(got) == plain_phrases(rows, least, longest, top)
    assert phrases.collocations(frame(spark, rows).limit(0), least).count() == 0


def test_phrases_with_a_full_table(spark, rows):
    """A bit table that lets nearly everything through changes no count."""
    got = {(r.lang, r.phrase): r.f for r in phrases.frequent(frame(spark, rows), 4, 3, bits=9).where("size > 1").collect()}
    want = {(r.lang, r.phrase): r.f for r in phrases.frequent(frame(spark, rows), 4, 3).where("size > 1").collect()}
    assert got == want and want


def test_exact_beyond_64_bits(spark):
    """Products of counts that pass 64 bits are still floored exactly."""
    a, n, l, r = 7 * 10**13 + 1, 8 * 10**13 + 3, 7 * 10**13 + 5, 7 * 10**13 + 9
    got = spark.sql(f"SELECT (1000 * CAST({a} AS DECIMAL(17,0)) * CAST({n} AS DECIMAL(17,0))) DIV (CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0))) AS s").first().s
    assert got == 1000 * a * n // (l * r)


def test_summary():
    """Every key with the wanted count survives in bounded memory, also when summaries are merged."""
    rng = random.Random(4)
    for least in (5, 20, 100):
        stream = [rng.choice([rng.randrange(50), rng.randrange(10**6)]) for _ in range(20_000)]
        exact = collections.Counter(stream)
        capacity = len(stream) // least + 1
        parts = []
        for part in (stream[:7_000], stream[7_000:]):
            summary = phrases.Summary(capacity)
            for i in range(0, len(part), 500):
                keys, counts = np.unique(np.array(part[i:i + 500], np.uint64), return_counts=True)
                summary.add(keys, counts)
            summary.merge()
            assert len(summary.keys) <= capacity and summary.taken < least
            parts.append(summary)
        parts[0].add(parts[1].keys, parts[1].counts)
        parts[0].taken += parts[1].taken
        kept = set(parts[0].survivors(least).tolist())
        assert {k for k, c in exact.items() if c >= least} <= kept and len(parts[0].keys) <= capacity
    assert len(phrases.Summary(3).survivors(1)) == 0


def plain_fim(rows):
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
        n = len(units)
        i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= 50:
            out.append((doc_id, n, "plain", None, None, text, text))
        elif h4 % 100 < 80:
            out.append((doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}", text))
        else:
            out.append((doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}", text))
    return sorted(out, key=str)


def test_fill_in_middle(spark, rows):
    rows = rows + [(1000 + i, ["one", " lead", "trail ", "a b", "<", "<P", "P> <S"][i % 7] * (1 + i % 3), "a") for i in range(120)]
    outputs = fim.transform(frame(spark, rows))
    found = fim.restore(outputs).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found), key=str) == plain_fim(rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in found)
    assert all(r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest() for r in found)
    short = fim.restore(outputs, with_text=False)
    assert "restored" not in short.columns and {r.restored_sha256 for r in short.collect()} == {r.restored_sha256 for r in found}
    assert fim.restore(fim.transform(frame(spark, rows).limit(0))).count() == 0
    odd = spark.createDataFrame([(None, None, 3), ("ab", None, 4), ("<S>c<P>a<M>b", "spm", 5)], "output string, form string, restored int")
    assert sorted(r.restored for r in fim.restore(odd).collect()) == ["", "ab", "abc"]


def test_piece_table():
    """Cuts at every pair of places, over a table of several descriptors, and back."""
    text = memoryview(b"abcdef")
    table = [(fim.TEXT, 0, 2), (fim.TEXT, 2, 5), (fim.TEXT, 5, 6)]
    for i in range(7):
        for j in range(i, 7):
            parts = fim.cut(table, [i, j])
            assert [b"".join(fim.streamed(p, text)) for p in parts] == [b"abcdef"[:i], b"abcdef"[i:j], b"abcdef"[j:]]
            for form in fim.FORMS:
                whole = b"".join(fim.streamed(fim.arranged(parts, form), text))
                assert b"".join(fim.streamed(fim.parted(whole, form), memoryview(whole))) == b"abcdef"
    assert fim.cut([], [0, 0]) == [[], [], []]
    assert [fim.inverse(o) for o in fim.FORMS.values()] == [[0, 2, 1], [1, 2, 0]]


def scored(text, **entries):
    lexicon = toxicity.Lexicon({"=idiot": 2.0, "zor": 3.0} | entries)
    return toxicity.clause_scores(text, lexicon, toxicity.grammar())[0]


def test_grammar():
    """Each transducer changes what a clause scores, and they do so together."""
    assert scored("What an Idiot. Fine day") == [2.0]
    assert scored("zorblat words") == [3.0] and scored("zo") == []
    near = scored("you are an idiot")
    assert near == [2.0 * toxicity.DIRECTED] and scored("you are not an idiot") == [2.0 * toxicity.DIRECTED * toxicity.DENIED]
    assert scored("not now, later or even after that an idiot") == [2.0]
    assert scored("Kim said an idiot came") == [2.0 * toxicity.REPORTED]
    assert scored('the "idiot" part') == [2.0 * toxicity.QUOTED]
    assert scored("i will kill you") == [toxicity.THREAT_WEIGHT] and scored("you will die") == [toxicity.THREAT_WEIGHT * toxicity.DIRECTED]
    assert scored("kill the process") == [] and scored("never kill them")[0] < toxicity.THREAT_WEIGHT
    assert scored("idiot idiot idiot idiot idiot") == [2.0 * sum(toxicity.REPEATED)]
    assert scored("idiot! idiot; said. idiot") == [2.0, 2.0, 2.0]
    assert scored("") == [] and scored("... !!") == []


def test_composition():
    """The composed table reads as the transducers do one after the other."""
    chain = [toxicity.Transducer.of(toxicity._threat, None), toxicity.Transducer.of(toxicity._insult),
             toxicity.Transducer.of(toxicity._after(toxicity.TARGET, toxicity.DIRECTED)),
             toxicity.Transducer.of(toxicity._after(toxicity.NEGATION, toxicity.DENIED)), toxicity.Transducer.of(toxicity._reported, (0, 0))]
    machine, rng = toxicity.grammar(), random.Random(8)
    assert 50 < len(machine.arcs) < 5000
    for _ in range(300):
        state, states = 0, [0] * len(chain)
        for symbol in (rng.randrange(toxicity.BREAK + 1) for _ in range(30)):
            state, got, factor = machine.arcs[state][symbol]
            want = 1.0
            for i, part in enumerate(chain):
                states[i], symbol, weight = part.arcs[states[i]][symbol]
                want *= weight
            assert got == symbol and factor == pytest.approx(want)


def test_toxicity(spark):
    """Invented insults are learned from labels and found in documents that were held out; without labels known words decide."""
    rng = random.Random(2)
    plain = ["".join(rng.choice("bdgklmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(500):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zwolt" + rng.choice(plain))
        rows.append((i, ". ".join(" ".join(words[j:j + 9]) for j in range(0, len(words), 9)), int(toxic)))
    rows += [(600, None, 0), (601, "", 0), (602, "word", None), (603, "!!! ...", 0), rows[4], rows[4], (None, rows[0][1], 1)]
    labelled = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, toxic int, score double")
    aside = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(labelled, labelled.where(~aside))
    assert toxicity.fit(labelled.repartition(2), labelled.where(~aside).repartition(2)) == model
    found = {r.doc_id: r for r in toxicity.score(labelled, model).collect()}
    assert toxicity.score(labelled, model).count() == len(rows)
    wrong = [i for i, _, t in rows if t is not None and i is not None and found[i].predicted != t]
    assert len(wrong) <= 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert found[600].score == found[601].score == found[603].score < 0.5 and found[600].n_clauses == 0
    assert found[None].predicted == 1 and any(k.startswith("zwolt") for k in model.entries)
    for few in (labelled.limit(0), labelled.where("toxic = 1"), labelled.where("toxic IS NULL")):
        assert toxicity.fit(labelled, few) == toxicity.Model()
    assert toxicity.fit(labelled.limit(0), labelled) == toxicity.Model()
    texts = spark.createDataFrame([(1, "you are a worthless idiot. you stupid moron"), (2, "a fine day"), (3, "nobody said idiot, never")], "doc_id int, text string")
    assert [r.predicted for r in toxicity.score(texts, toxicity.Model()).orderBy("doc_id").collect()] == [1, 0, 0]
    assert toxicity.score(texts.limit(0), model).count() == 0
    small = toxicity.fit(labelled, labelled.where(~aside), sample=200)
    assert sum(r.predicted != dict((x[0], x[2]) for x in rows).get(r.doc_id) for r in toxicity.score(labelled.where("doc_id < 500"), small).collect()) <= 25
