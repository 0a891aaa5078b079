"""The licence scan against a plain scan; families, the unknown class, confirmation, odd inputs."""

import math
import random
import re

import numpy as np
import pytest

from webgrain.llm import licenses

from .test_filters import DOCS, with_clashes

LINES = ["plain line of the corpus", "another one, with words and more words", "the work of the many in the copy of a list"]
#: Wordings and wraps that no template has.
UNSEEN = [
    ("mit", 'The software is provided "as is", without warranty of any kind, express or implied, including the warranties of\nmerchantability and fitness for a particular purpose; in no event shall the authors be liable for any claim'),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to use, copy, modify and merge it"),
    ("bsd", "* Redistributions in binary form must reproduce the above copyright notice,\n  this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache", "// Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an \"AS IS\" BASIS,\n// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"),
    ("mpl", "This file is subject to the terms of the Mozilla Public License, v. 2.0"),
]


@pytest.fixture(scope="module")
def model():
    return licenses.fit(LINES)


def plain_scan(text, model):
    """(paragraph, family, probability, similarity, confirmed) of each part, one after the other."""
    out, at = [], 0
    for p in re.split(licenses.BETWEEN, text or ""):
        if not p.strip(" \t\r\n"):
            continue
        words = re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in p))
        starts = [0] if len(words) <= licenses.PART else range(0, len(words) - licenses.PART + licenses.STEP, licenses.STEP)
        for a in starts:
            part = words[a : a + licenses.PART]
            pairs = set(zip(part, part[1:]))
            sums = list(model.bias)
            for w in [model.words[x] for x in set(part) if x in model.words] + [model.pairs[x] for x in pairs if x in model.pairs]:
                sums = [s + x for s, x in zip(sums, w)]
            best = max(sums)
            family = model.families[sums.index(best)]
            probability = 1 / (1 + math.exp(-(best * model.slope + model.offset)))
            similarity = 0.0
            if probability >= licenses.LIMIT:
                for t in licenses.TEMPLATES[family]:
                    tw = re.findall("[a-z0-9]+", t.lower())
                    tp = set(zip(tw, tw[1:]))
                    similarity = max(similarity, len(tp & pairs) / min(len(tp), max(len(part) - 1, licenses.FRAGMENT)))
            else:
                family = "unknown"
            out.append((at, family, round(probability, 9), round(similarity, 9), family != "unknown" and similarity >= licenses.SHARED))
        at += 1
    return out


def found(spark, model, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()
    return [r.parts for r in sorted(rows, key=lambda r: r.doc_id)]


def test_scan_is_the_plain_scan(spark, model):
    rng = random.Random(4)
    texts = [v + rng.choice(["\n", ".\n", "\n\n", " "]) + rng.choice(licenses.OTHERS) for ts in licenses.TEMPLATES.values() for t in ts for v in licenses.variants(t, rng, 2)]
    texts += [t for _, t in UNSEEN] + ["", None, " \n\n\t", "ÜBER Café\r\n\r\nmit und ohne", "!!!\n\n...", "MIT", "Apache-2.0", "all the " * 400 + "licensed under the MIT license " + "of it " * 300, "x.\n" * 50]
    got = [[(p.paragraph, p.family, round(p.probability, 9), round(p.similarity, 9), p.confirmed) for p in parts] for parts in found(spark, model, texts)]
    assert got == [plain_scan(t, model) for t in texts]


def test_templates_wraps_and_unseen_wordings_are_found_and_confirmed(spark, model):
    wanted = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts] + UNSEEN
    wrapped = ["Intro.\n" + re.sub(r"(\S+ \S+ \S+ \S+ \S+ \S+) ", r"\1" + "\n", t) + "\n\nOutro." for _, t in wanted]
    parts = found(spark, model, wrapped)
    hits = [any(p.family == f and p.confirmed for p in some) for (f, _), some in zip(wanted, parts)]
    assert np.mean(hits) > 0.95 and all(hits[-len(UNSEEN) :])
    assert not any(p.confirmed and p.text.strip() in ("Intro", "Outro.") for some in parts for p in some)


def test_fragments_of_wrapped_lines_are_judged(spark, model):
    (parts,) = found(spark, model, ['of this software and associated documentation files (the "Software"), to deal'])
    assert [(p.family, p.confirmed) for p in parts] == [("mit", True)]


@pytest.mark.parametrize("family,text", [("apache", "LICENSED UNDER THE Apache license,  version 2.0"), ("cc-by-nc", "x Licensed under CC BY-NC 4.0. y"), ("mit", "- Released under the MIT License -")])
def test_variants(spark, model, family, text):
    (parts,) = found(spark, model, [f"a.\n{text}\r\n\r\nb"])
    assert [(p.family, p.confirmed, p.text) for p in parts if p.confirmed] == [(family, True, text)]


def test_other_talk_of_licences_is_unknown(spark, model):
    assert not any(p.confirmed for parts in found(spark, model, licenses.OTHERS) for p in parts)


def test_words_of_a_licence_in_another_order_are_not_confirmed(spark, model):
    ((p,),) = found(spark, model, ["2.0 version license apache the under licensed"])
    assert not p.confirmed and p.similarity < licenses.SHARED


def test_probabilities_are_calibrated_on_other_variants(model):
    """Held-out variants in four bands of probability: the share that is right is near the mean."""
    rng = random.Random(99)
    rows = [(v, f) for f, ts in licenses.TEMPLATES.items() for t in ts for v in licenses.variants(t, rng, 12)] + [(v, None) for t in licenses.OTHERS for v in licenses.variants(t, rng, 12)]
    p, right = [], []
    for text, family in rows:
        words = licenses.words_of(text)
        sums = np.array(model.bias) + sum((np.array(w) for w in [model.words[x] for x in set(words) if x in model.words] + [model.pairs[x] for x in licenses.pairs_of(words) if x in model.pairs]), np.zeros(len(model.bias)))
        p.append(1 / (1 + math.exp(-(sums.max() * model.slope + model.offset))))
        right.append(model.families[int(sums.argmax())] == family)
    p, right = np.array(p), np.array(right, float)
    assert np.mean((p - right) ** 2) < 0.08
    error = sum(abs(p[m].mean() - right[m].mean()) * m.mean() for a in (0, 0.25, 0.5, 0.75) if (m := (p >= a) & (p < a + 0.2500001)).any())
    assert error < 0.08


def test_odd_inputs_and_summary(spark, model):
    lines = "Released under the MIT License.\nAll rights reserved.\n" * 2
    docs = [(1, None), (2, ""), (3, "no talk"), (4, lines), (4, lines), (5, "x " * 100000 + "\n\nLicensed under CC BY 4.0."), (None, "license")]
    df = with_clashes(spark.createDataFrame(docs, DOCS))
    rows = licenses.summarize(licenses.scan(df, model)).collect()
    got = sorted((str(r.doc_id), r.n_paragraphs, r.n_confirmed, r.licenses) for r in rows)
    assert got == sorted([("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 1, 0, ""), ("4", 4, 4, "mit,proprietary"), ("4", 4, 4, "mit,proprietary"), ("5", 2, 1, "cc-by"), ("None", 1, 0, "")])
    assert all(0 <= r.probability <= 1 and r.n_confirmed <= r.n_licensed <= r.n_paragraphs for r in rows)
    assert licenses.scan(df.limit(0), model).count() == 0


def test_plan_has_no_python(spark, model):
    plan = licenses.summarize(licenses.scan(spark.createDataFrame([(1, "x")], DOCS), model))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_tables_find_all_their_keys_and_nothing_else():
    rng = random.Random(5)
    rows = {rng.getrandbits(63): i for i in range(1, 900)}
    table = licenses.Table(rows)
    held = dict(c for c in table.cells if c)
    assert held == rows and all(table.cells.index((k, v)) in table._slots(k) for k, v in list(rows.items())[:50])


def test_training_from_documents(spark):
    df = spark.createDataFrame([(i, "some words here\nand there is no license for the words") for i in range(30)] + [(98, "long " * 30000), (99, None)], DOCS)
    assert licenses.train(df).words and licenses.train(df.limit(0)).words
