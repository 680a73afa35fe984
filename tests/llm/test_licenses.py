import numpy as np
import pytest

from linecue.llm import licenses
from linecue.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return licenses.Classifier(licenses.corpus_lines(table(spark, SF, "documents")))


def brute(model, line):
    """(family, probability, similarity) of a line in plain Python, or None."""
    words = licenses.plain_words(line)
    hits = [model.grams[g] for g in licenses._grams(words) if g in model.grams]
    if not hits:
        return None
    z = (model.weights[hits].sum(0) / len(words) + model.bias) / licenses.MILLION
    p = np.exp(z - z.max())
    p /= p.sum()
    best = int(p[:-2].argmax())
    if p[best] >= licenses.LEAST_PROBABILITY:
        family, probability = model.classes[best], p[best]
    elif p[-1] < 1 - licenses.LEAST_PROBABILITY:
        family, probability = licenses.UNKNOWN, 1 - p[-1]
    else:
        return None
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    held = max((int(100 * len(cut(t) & cut(words)) / len(cut(t))) for t in map(licenses.plain_words, licenses.TEMPLATES.get(family, []))), default=0)
    return family, round(float(probability), 4), held, held >= licenses.LEAST_PERCENT


def test_scan_equals_a_plain_loop(spark, model):
    lines = [t for of in licenses.TEMPLATES.values() for t in of] + licenses.OTHER_TERMS + licenses.NOT_TERMS
    lines += ["Copyright 2020. Released under the MIT License. Enjoy!", "RELEASED UNDER THE MIT LICENSE", "license", "", " ", "the MIT", "x " * 5000 + "Released under the MIT License."]
    rows = [(1, "\n".join(lines)), (2, None), (3, ""), (1, "Licensed under CC BY-NC 4.0."), (1, "Licensed under CC BY-NC 4.0."), (None, "\n\nReleased under the MIT License.\n")]
    got = licenses.scan(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, family string"), model).collect()
    want = [(d, k, *b) for d, t in rows for k, line in enumerate((t or "").split("\n")) if (b := brute(model, line))]
    key = lambda r: tuple(map(str, r))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(*g[:3], *g[4:]) for g in got] == [(*w[:3], *w[4:]) for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-4)


def test_templates_are_known_and_other_lines_are_not(spark, model):
    rows = [(k, t) for k, t in enumerate(t for of in licenses.TEMPLATES.values() for t in of)]
    families = [f for f, of in licenses.TEMPLATES.items() for _ in of]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[k].family == f and got[k].confirmed for k, f in enumerate(families))
    other = licenses.scan(spark.createDataFrame(list(enumerate(licenses.NOT_TERMS)), "doc_id long, text string"), model)
    assert other.where("confirmed").count() == 0
    unknown = licenses.scan(spark.createDataFrame(list(enumerate(licenses.OTHER_TERMS)), "doc_id long, text string"), model).collect()
    assert len(unknown) == len(licenses.OTHER_TERMS) and {r.family for r in unknown} == {licenses.UNKNOWN}


def test_notices_wrapped_over_lines_and_inside_long_ones(spark, model):
    isc, mit = licenses.TEMPLATES["isc"][0], licenses.TEMPLATES["mit"][2]
    wrap = lambda t, n: "\n".join(t[i : i + n] for i in range(0, len(t), n)) if " " not in t else "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    prose = "the boats came back late and nobody had lit the lamp above the door " * 30
    docs = [(1, wrap(isc, 72)), (2, f"{prose}{mit} {prose}"), (3, prose), (4, f"{prose}\n# {wrap(mit, 72)}\n{prose}")]
    got = licenses.scan_passages(spark.createDataFrame(docs, "doc_id long, text string"), model).where("confirmed").collect()
    assert {(r.doc_id, r.family) for r in got} == {(1, "isc"), (2, "mit"), (4, "mit")}


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_finds_the_planted_lines(spark):
    notices = {"Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    want = {(r.doc_id, k, notices[line]) for r in table(spark, SF, "documents").collect() for k, line in enumerate((r.text or "").split("\n")) if line in notices}
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.op5_license_scan(spark, SF).where("confirmed").collect()}
    assert want and want <= got
    lines = {r.doc_id: r.text.split("\n") for r in table(spark, SF, "documents").collect()}
    assert all("licen" in lines[d][k].lower() for d, k, _ in got)


def prose(spark, n):
    text = " ".join(r.text for r in table(spark, SF, "documents").where("doc_id between 20 and 60").orderBy("doc_id").collect() if "licen" not in r.text.lower())
    return " ".join(licenses.plain_words(text)[:n])


def test_notices_inside_long_lines_and_across_line_ends(spark, model):
    apache, gpl = licenses.TEMPLATES["apache-2.0"], licenses.TEMPLATES["gpl-3.0"]
    grant = licenses.TEMPLATES["mit"][2]
    broken = gpl[1].replace("under the terms", "under\nthe terms")
    rows = [
        (1, f"{prose(spark, 50)} {apache[0]}"),
        (2, f"{prose(spark, 200)} {apache[0]} {prose(spark, 200)}"),
        (3, f"{prose(spark, 200)} {grant} {prose(spark, 90)}"),
        (4, f"{prose(spark, 30)}\n{broken}\n{prose(spark, 30)}"),
        (5, f"{prose(spark, 60)} {apache[0]} {prose(spark, 60)} {licenses.TEMPLATES['cc-by-nc'][0]} {prose(spark, 60)}"),
        (6, "x " * 5000 + "Released under the MIT License."),
        (7, prose(spark, 2000)),
        (9, f"All rights reserved.\n{prose(spark, 30)}"),
        (8, None),
    ]
    got = licenses.scan_passages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = {(1, 0, "apache-2.0"), (2, 0, "apache-2.0"), (3, 0, "mit"), (4, 1, "gpl-3.0"), (5, 0, "apache-2.0"), (5, 0, "cc-by-nc"), (6, 0, "mit")}
    assert {(r.doc_id, r.paragraph, r.family) for r in got if r.confirmed} == want
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == want | {(9, 0, "unknown")}


def test_every_template_is_found_inside_a_line(spark, model):
    rows = [(k, f"{prose(spark, 80)} {t} {prose(spark, 80)}") for k, t in enumerate(t for of in licenses.TEMPLATES.values() for t in of)]
    families = [f for f, of in licenses.TEMPLATES.items() for _ in of]
    got = licenses.scan_passages(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed").collect()
    assert sorted((r.doc_id, r.family) for r in got) == list(enumerate(families))


def test_lines_about_rights_are_no_negatives(spark):
    docs = table(spark, SF, "documents")
    assert not [x for x in licenses.corpus_lines(docs) if "rights" in x.lower() or "licen" in x.lower()]
    want = {(r.doc_id, k) for r in docs.collect() for k, line in enumerate((r.text or "").split("\n")) if line == "All rights reserved."}
    got = {(r.doc_id, r.paragraph) for r in licenses.op5_license_scan(spark, SF).where("family = 'unknown'").collect()}
    assert want and want <= got
