"""Stems against words of the published algorithm, edit distances against comparing all with all."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import stems
from docloom.operators import fuzzy

#: Words and stems as the paper of 1980 has them in its examples, step by step, carried through all steps by hand.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "by": "by", "yes": "ye", "naïve": "naïve", "b2b": "b2b",
}


def test_stems():
    assert {w: stems.stem(w) for w in STEMS} == STEMS


def test_stemmed_texts(spark):
    df = spark.createDataFrame([(1, "  The Ponies, hopping!  (relational) "), (2, None), (3, ""), (4, "ÜBER-falling ponies ponies")], "id long, t string")
    got = {r.id: r.t for r in df.select("id", stems.normalize_stem(F.col("t")).alias("t")).collect()}
    assert got == {1: "the poni , hop ! ( relat )", 2: None, 3: "", 4: "über - fall poni poni"}


def test_distance_of_stems(spark):
    df = spark.createDataFrame([("Hopping ponies", "hop pony"), ("cats falling", "cap fall"), ("x", None)], "a string, b string")
    assert [r.d for r in df.select(stems.fuzzy_match(F.col("a"), F.col("b")).alias("d")).collect()] == [0, 1, None]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_similar_texts(spark, most):
    r = random.Random(most)
    base = ["".join(r.choice("abcé") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 14]))) for _ in range(60)]
    texts = set(base)
    for t in base:
        for _ in range(2):
            x = list(t)
            for _ in range(r.randint(1, 3)):
                i, kind = r.randint(0, len(x)), r.choice("dis")
                if kind == "i":
                    x.insert(i, r.choice("abcé"))
                elif i < len(x):
                    x[i : i + 1] = [] if kind == "d" else [r.choice("abcé")]
            texts.add("".join(x))
    rows = [(t,) for t in [*texts, *base, None]]
    got = sorted(map(tuple, fuzzy.similar_texts(spark.createDataFrame(rows, "t string"), "t", most).collect()))
    assert got == sorted((*sorted((a, b), key=str.encode), d) for i, a in enumerate(sorted(texts)) for b in sorted(texts)[i + 1 :] if (d := distance(a, b)) <= most)


def test_links_are_counted_by_text(spark):
    df = spark.createDataFrame([(1, "ring"), (2, "ring"), (3, "rings"), (4, "wheel"), (5, None), (6, "sing")], "id long, t string")
    assert sorted(map(tuple, fuzzy.fuzzy_links(df, "id", "t", 1).collect())) == [(1, "ring", 2, 2), (2, "ring", 2, 2), (3, "rings", 1, 2), (4, "wheel", 1, 0), (5, None, 0, 0), (6, "sing", 1, 2)]
